"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Exact base patterns give spans that always stay. High-recall generators propose further, overlapping
candidates: several patterns a kind and, for cards, every run of digit groups of 13 to 19 digits and
the sub-runs of long groups. Each candidate has format and context features with few values. Boosted
depth-two trees score it and a threshold for each kind, calibrated on held-out rows, selects what is
redacted.

The trees learn from ``synthetic`` rows, whose spans are known from the way they are written: common
and rare forms of each kind, and look-alikes (versions, times, hardware addresses, decimals, order
numbers, scopes). Neither base patterns nor checks label them, and the corpus does not enter, so a
text is always treated alike. The number of rows is a parameter; their candidates are extracted by
the same plan as the corpus's, and the trees go back into the plan as CASE expressions.

Everything is linear in the text but for running sums and maxima over its matches, which are taken in
blocks of the square root of their number.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import as_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds without a base pattern; their spans come after the others'.
ADDED = ("iban", "ssn")
EVERY = KINDS + ADDED

#: A run can start where the run's class does not stretch to the left, or where the last match ended:
#: the same matches as without the condition, in time linear in the text. Repeats are possessive
#: where nothing after them could use a shorter one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )", r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )"
_WORD = r"[A-Za-z0-9_%+-]"
GENERATORS = {
    "email": (
        rf"(?<![A-Za-z0-9._%+-]){_WORD}++(?:\.{_WORD}++)*+{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)++",
        rf"(?<![A-Za-z0-9._%+-]){_WORD}++(?:\.{_WORD}++)*+@[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
        r"(?<![^\s@])[^\s@]++@[^\s@]++(?![^\s])",
    ),
    "ip": (
        r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ .()/-]{1,2}[0-9]{2,5}){2,5}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])(?:\+?1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z-])",
        r"(?<![0-9A-Za-z])\(?0[0-9]{2,5}\)?[ /-]?[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9A-Za-z-])",
    ),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",),
    "ssn": (r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",),
}
CARD_DIGITS = range(13, 20)
#: Forms with an issuer's number and length. Inside a group of more digits than a card's only these are proposed.
ISSUED = (r"4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}", r"4[0-9]{12}", r"4[0-9]{18}")
LONG_GROUP = r"[0-9]{20,}+"
#: A text has candidates or base spans of a kind only if it matches this.
NEEDS = {
    "email": r"@|[\[({<] ?(?:at|AT) ?[\])}>]| (?:at|AT) [A-Za-z0-9-]+ ?(?:\[|\(|\{|<|dot|DOT|\.[A-Za-z])",
    "ip": r"[0-9]\.[0-9]+\.[0-9]|[0-9A-Fa-f:]:[0-9A-Fa-f]{0,4}:",
    "card": r"[0-9](?:[ .-]?[0-9]){12}",
    "phone": r"\+[0-9]|[0-9)][ .()/-]{1,2}[0-9]|0[0-9]{8}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words before a candidate that speak for its kind.
CUES = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip|ipv[46]|host|server|addr|client|from",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|contact|ring",
    "iban": "iban|account|bank|transfer",
    "ssn": r"ssn|social|security|\bss\b",
}
BEFORE = 32

#: Features and the number of values of each.
FEATURES = {"digits": 5, "breaks": 4, "lead": 3, "cue": 2, "tail": 3, "check": 2, "wide": 3, "groups": 3, "edge": 2, "marks": 3}
#: Shapes of candidates: groups as of cards, accounts and national numbers; counts, times, dates and versions; words for signs.
GROUPED = (
    r"^[0-9A-Z]{4}([ .-]?)[0-9A-Z]{4}(?:\1[0-9A-Z]{4})+(?:\1[0-9A-Z]{1,3})?$|^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}$|::|^3[47][0-9]{2}.?[0-9]{6}.?[0-9]{5}$"
)
COUNTED = r"^[0-9]{1,2}[ .:/-][0-9]{1,2}(?:[ .:/-]|$)|^[0-9]{4}-[0-9]{2}-|^[0-9]{1,3}(?: [0-9]{3})+$|^[0-9]\.[0-9]"
SPELLED = r"[\[({<] ?(?i:at|dot|@|\.) ?[\])}>]| (?:at|AT) .* (?:dot|DOT) "
ROUNDS, RATE, PRECISION = 40, 0.4, 0.95
#: Synthetic rows the trees are fitted and calibrated on.
ROWS = 6000

SPAN = "array<struct<s:int,e:int,hit:string,before:string>>"
RANGE = "array<struct<s:int,e:int>>"


_names = itertools.count()


def _fn(body: Callable[..., str], many: int = 1) -> str:
    """A SQL lambda with variables of its own. Expressions are built as SQL text: as Column objects they would take half a minute."""
    own = [f"v{next(_names)}" for _ in range(many)]
    return f"{own[0] if many == 1 else f'({", ".join(own)})'} -> {body(*own)}"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is worked out once."""
    return f"element_at(transform(array({value}), {_fn(body)}), 1)"


def _running(values: str, op: Callable[[str, str], str]) -> str:
    """Running results of ``op`` over an array of int, in blocks of the square root of its size."""
    none = "cast(array() as array<int>)"

    def folded(array: str, pick: Callable[[str], str]) -> str:
        step = lambda a, x: f"concat({a}, array(coalesce({op(_last(a), pick(x))}, {pick(x)})))"
        return f"aggregate({array}, {none}, {_fn(step, 2)})"

    def within(v: str, wide: str) -> str:
        own = _fn(lambda i: folded(f"slice({v}, {i} + 1, {wide})", lambda x: x))
        return _let(f"transform(sequence(0, size({v}) - 1, {wide}), {own})", lambda blocks: _let(folded(blocks, _last), lambda ends: across(blocks, ends)))

    def across(blocks: str, ends: str) -> str:
        shifted = lambda block, i: f"transform({block}, {_fn(lambda x: f'coalesce({op(f'get({ends}, {i} - 1)', x)}, {x})')})"
        return f"flatten(transform({blocks}, {_fn(shifted, 2)}))"

    return _let(values, lambda v: f"if(size({v}) = 0, {none}, {_let(f'cast(ceil(sqrt(size({v}))) as int)', lambda wide: within(v, wide))})")


def _last(array: str) -> str:
    return f"get({array}, size({array}) - 1)"


def _sums(values: str) -> str:
    return _running(values, lambda a, b: f"{a} + {b}")


def _tops(values: str) -> str:
    return _running(values, lambda a, b: f"greatest({a}, {b})")


def _nothing(kind: str = SPAN) -> str:
    return f"cast(array() as {kind})"


def _span(start: str, end: str, hit: str, before: str) -> str:
    return f"named_struct('s', {start}, 'e', {end}, 'hit', {hit}, 'before', {before})"


def _spans(text: str, pattern: str) -> str:
    """Leftmost non-overlapping matches: code point offsets, end exclusive, the text, and what stands before since the last."""

    def placed(hits: str) -> str:
        sizes = lambda g: f"zip_with(slice({g}, 1, size({hits})), {hits}, {_fn(lambda a, b: f'length({a}) + length({b})', 2)})"
        each = lambda g, ends: _fn(lambda hit, i: _span(f"get({ends}, {i}) - length({hit})", f"get({ends}, {i})", hit, f"right(get({g}, {i}), {BEFORE})"), 2)
        return _let(f"split({text}, r'{pattern}', -1)", lambda g: _let(_sums(sizes(g)), lambda ends: f"transform({hits}, {each(g, ends)})"))

    return _let(f"regexp_extract_all({text}, r'{pattern}', 0)", lambda hits: f"if(size({hits}) = 0, {_nothing()}, {placed(hits)})")


def _overlapping(text: str, start: str, pattern: str) -> str:
    """A match of ``pattern`` at every place where ``start`` holds, overlapping ones too."""
    # A character before the text keeps a first match from being at its very start, where splitting drops the empty part.
    whole = f"concat(chr(10), {text})"

    def placed(hits: str) -> str:
        sizes = lambda g: f"transform(slice({g}, 1, size({hits})), {_fn(lambda x: f'length({x})')})"
        each = lambda g, at: _fn(lambda hit, i: _span(f"get({at}, {i}) - 1", f"get({at}, {i}) - 1 + length({hit})", hit, f"right(get({g}, {i}), {BEFORE})"), 2)
        return _let(f"split({whole}, r'{start}(?={pattern})', -1)", lambda g: _let(_sums(sizes(g)), lambda at: f"transform({hits}, {each(g, at)})"))

    return _let(f"regexp_extract_all({whole}, r'{start}(?=({pattern}))', 1)", lambda hits: f"if(size({hits}) = 0, {_nothing()}, {placed(hits)})")


def _cards(text: str) -> str:
    """Card candidates: runs of whole digit groups of 13 to 19 digits from each group on, and issued numbers inside long groups."""
    runs = [_overlapping(text, "(?<![0-9])", rf"[0-9](?:[ .-]?[0-9]){{{n - 1}}}(?![0-9])") for n in CARD_DIGITS]

    def inside(group: str) -> str:
        moved = lambda c: _span(f"{c}.s + {group}.s", f"{c}.e + {group}.s", f"{c}.hit", f"{group}.before")
        found = ", ".join(_overlapping(f"{group}.hit", "", p) for p in ISSUED)
        return f"transform(concat({found}), {_fn(moved)})"

    return f"concat({', '.join(runs)}, flatten(transform({_spans(text, LONG_GROUP)}, {_fn(inside)})))"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(hit: str) -> str:
    """Whether the digits of a text pass the Luhn check."""
    doubled = lambda d, i: f"if({i} % 2 = 0, try_cast({d} as int), try_cast(substring('0246813579', try_cast({d} as int) + 1, 1) as int))"
    each = f"transform(split(reverse({_digits(hit)}), ''), {_fn(doubled, 2)})"
    return f"(aggregate({each}, 0, {_fn(lambda a, b: f'{a} + coalesce({b}, 0)', 2)}) % 10 = 0)"


def _valid(kind: str, hit: str) -> str:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return f"{hit} rlike r'{OCTETS}'"
    if kind == "card":
        return f"length({_digits(hit)}) between 13 and 19 and {_luhn(hit)}"
    if kind == "phone":
        return f"length({_digits(hit)}) between 9 and 15"
    return "true"


def _checked(kind: str, hit: str) -> str:
    """A feature: whether a candidate passes its kind's own test of numbers."""
    if kind == "card":
        return _luhn(hit)
    if kind == "ip":
        short = rf"size(split({hit}, '::', -1)) = 2 and not contains({hit}, ':::') and {hit} rlike '^(?:::|[^:])' and {hit} rlike '(?:::|[^:])$' and {hit} rlike '[0-9A-Fa-f]'"
        return rf"({hit} rlike r'{OCTETS}' or {hit} rlike '^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$' or ({short}))"
    if kind == "phone":
        return f"length({_digits(hit)}) between 9 and 15"
    if kind == "iban":
        value = lambda d: f"if({d} rlike '[0-9]', try_cast({d} as int), ascii({d}) - 55)"
        step = lambda a, d: f"if({d} = '', {a}, ({a} * if({d} rlike '[0-9]', 10, 100) + {value(d)}) % 97)"
        turned = lambda x: f"split(concat(substring({x}, 5, 40), substring({x}, 1, 4)), '')"
        return "(" + _let(f"replace({hit}, ' ', '')", lambda x: f"aggregate({turned(x)}, 0, {_fn(step, 2)})") + " = 1)"
    if kind == "ssn":
        return f"not ({hit} rlike '^(?:000|666|9)|^....00|0000$')"
    return rf"{hit} rlike r'\.[\p{{L}}]{{2,24}}$|(?:dot|DOT|\.)[ \])}}>]*[A-Za-z]{{2,24}}$'"


def _features(kind: str, c: str) -> str:
    hit, before = f"{c}.hit", f"{c}.before"
    few = lambda n, *cuts: " + ".join(f"if({n} >= {x}, 1, 0)" for x in cuts)
    values = {
        "digits": few(f"length({_digits(hit)})", 9, 12, 16, 20),
        "breaks": few(f"length(regexp_replace({hit}, '[^ ./:()-]', ''))", 1, 2, 4),
        "lead": f"case when {hit} rlike '^(?:[+]|00)' then 2 when startswith({hit}, '(') then 1 else 0 end",
        "cue": rf"if({before} rlike r'(?i)(?:{CUES[kind]})[^\n]{{0,14}}$', 1, 0)",
        "tail": f"case when {hit} rlike '[A-Za-z]{{2,24}}$' then 2 when {hit} rlike '[0-9A-Fa-f]$' then 1 else 0 end",
        "check": f"if({_checked(kind, hit)}, 1, 0)",
        "wide": few(f"{c}.e - {c}.s", 8, 20),
        "groups": f"case when {hit} rlike r'{GROUPED}' then 2 when {hit} rlike r'{COUNTED}' then 1 else 0 end",
        "edge": rf"if({hit} rlike r'^[^\p{{L}}\p{{N}}+(:]|[^\p{{L}}\p{{N}}:)\]}}>]$' or {before} rlike r'[0-9][.,]$|[\p{{L}}_-]$', 1, 0)",
        "marks": rf"case when {hit} rlike r'{SPELLED}' then 2 when {hit} rlike '[@-]' then 1 else 0 end",
    }
    return f"named_struct('s', {c}.s, 'e', {c}.e, {', '.join(f"'{f}', {values[f]}" for f in FEATURES)})"


def _base(text: str, kind: str) -> str:
    found = f"filter({_spans(text, BASE[kind])}, {_fn(lambda c: _valid(kind, f'{c}.hit'))})"
    return f"if({text} rlike r'{NEEDS[kind]}', {found}, {_nothing()})"


def _candidates(text: str, kind: str) -> str:
    found = _cards(text) if kind == "card" else f"concat({', '.join(_spans(text, p) for p in GENERATORS[kind])})"
    fields = ",".join(f"{f}:int" for f in FEATURES)
    return f"if({text} rlike r'{NEEDS[kind]}', transform({found}, {_fn(lambda c: _features(kind, c))}), {_nothing(f'array<struct<s:int,e:int,{fields}>>')})"


def synthetic(rows: int = ROWS, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with the spans in them, by construction; about half of the rows hold look-alikes only."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = "the report shows that all of our orders were sent on time and nobody had to look at it again in winter".split()
    names = ["ana", "j.smith", "lee_k", "m-garcia", "info", "sales2", "bjorn", "x9"]
    hosts, ends = ["example", "mail-srv", "uni", "correo", "foo2", "acme"], ["com", "org", "net", "de", "co.uk", "io", "fr"]

    def luhn(head: str, n: int) -> str:
        body = head + digits(n - len(head) - 1)
        return next(body + d for d in "0123456789" if sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(body + d))) % 10 == 0)

    def not_luhn(n: int) -> str:
        good = luhn(pick("123456789"), n)
        return good[:-1] + str((int(good[-1]) + rng.randint(1, 9)) % 10)

    def in_groups(x: str, sizes: list[int], mark: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(x[at : at + n])
            at += n
        return mark.join(out)

    def email() -> str:
        name, host, end = pick(names), pick(hosts), pick(ends)
        at, dot = pick([(" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("{at}", "{dot}"), ("@", " dot "), ("@", ".")])
        if at == "@" and dot == ".":
            return pick(["josé", "müller", "åsa"]) + "@" + pick(["españa", host]) + "." + end.split(".")[0]
        return name + at + host + dot + end.replace(".", dot)

    def ip() -> str:
        part = lambda: f"{rng.randint(0, 65535):x}"
        full, a, b = [part() for _ in range(8)], rng.randint(0, 4), rng.randint(1, 3)
        short = ":".join(full[:a]) + "::" + ":".join(full[:b])
        return pick([":".join(full), short, short, "fe80::" + part() + ":" + part(), ".".join(str(rng.randint(0, 255)) for _ in range(4))])

    def card() -> str:
        mark = pick(["", " ", "-", "."])
        if rng.random() < 0.25:
            return in_groups(luhn(pick(["34", "37"]), 15), [4, 6, 5], mark)
        return in_groups(luhn(pick(["4", "51", "55", "6011", "2221", digits(1), digits(1)]), 16), [4, 4, 4, 4], mark)

    def phone() -> str:
        area, mid, last = f"{rng.randint(2, 9)}{digits(2)}", f"{rng.randint(2, 9)}{digits(2)}", digits(4)
        return pick([
            f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"1-{area}-{mid}-{last}", f"00{rng.randint(30, 49)} {digits(2)} {digits(4)} {digits(4)}",
            f"+{rng.randint(30, 49)} {digits(2)} {digits(4)} {digits(4)}", f"0{rng.randint(10, 99)}{digits(1)}/{digits(3)} {digits(4)}", f"{area} {mid} {last}",
        ])

    def iban(good: bool = True) -> str:
        # A mistyped number of a form with few digits: longer ones would hold numbers that pass for cards.
        land, n = pick([("DE", 18), ("GB", 18), ("FR", 23), ("ES", 20), ("NL", 14)]) if good else ("NL", 14)
        body = (pick(["ABNA", "INGB", "BARC"]) if land in ("GB", "NL") else digits(4)) + digits(n - 4)
        number = int("".join(str(int(c, 36)) for c in body + land)) * 100
        check = 98 - number % 97
        x = land + f"{check if good else (check + rng.randint(1, 90)) % 97 + 2:02d}" + body
        return x if rng.random() < 0.4 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def ssn() -> str:
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"

    def alike(kind: str) -> str:
        hexes = lambda n, m: m.join(f"{rng.randint(0, 255):02x}" for _ in range(n))
        return {
            "email": lambda: pick([f"@{pick(names)}", f"{pick(words)} @ {rng.randint(2, 9)}.50", f"root@{pick(hosts)}", f"{pick(words)} at {pick(hosts)} dot-com era", f"look at {pick(words)} dot {rng.randint(1, 9)}",
                                   f"meet at noon (at) the gate", f"{pick(words)} at 3.15", f"a@b@{pick(hosts)}!"]),
            "ip": lambda: pick([f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}:{rng.randint(10, 99)}", hexes(6, ":"), hexes(5, ":"),
                                "std::vec::add", "a::b", f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", "::", f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}"]),
            "card": lambda: pick([not_luhn(16), in_groups(not_luhn(16), [4, 4, 4, 4], " "), not_luhn(14), f"{rng.randint(0, 9)}.{not_luhn(15)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", not_luhn(13), digits(24), f"2024{digits(4)} {digits(6)} {digits(3)}",
                                  f"0.{luhn('4', 16)}", f"{rng.randint(1, 9)}.{luhn('3', 14)}"]),
            "phone": lambda: pick([f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} 10:20", f"{rng.randint(1, 28)}/{rng.randint(10, 12)}/2021", f"{rng.randint(1, 9)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}",
                                   f"{digits(3)}-{digits(3)}", f"{rng.randint(1, 9)}.{rng.randint(10, 99)}.{rng.randint(10, 99)}", f"1 000 {digits(3)} {digits(3)}", f"{digits(2)}-{digits(4)}-{digits(2)}", f"10.{digits(4)}/{digits(5)}", f"{digits(4)} {digits(4)} {digits(4)}"]),
            "iban": lambda: pick([iban(False), f"AB{digits(2)} {digits(4)} {digits(4)} {digits(2)}", f"XK{digits(2)}{digits(8)}"]),
            "ssn": lambda: pick([f"{pick(['000', '666'])}-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"{digits(3)}-{digits(2)}-0000"]),
        }[kind]()

    made = {"email": email, "ip": ip, "card": card, "phone": phone, "iban": iban, "ssn": ssn}
    cues = {"email": ["mail", "contact", "reach me"], "ip": ["host", "server ip", "client"], "card": ["card", "visa", "paid with"], "phone": ["phone", "tel", "call"], "iban": ["iban", "account"], "ssn": ["ssn", "social security"]}
    out = []
    for _ in range(rows):
        text, spans = " ".join(rng.choices(words, k=rng.randint(0, 6))), []
        for _ in range(rng.randint(1, 2)):
            kind = pick(EVERY)
            good = rng.random() < 0.5
            item = made[kind]() if good else alike(kind)
            cue = pick(cues[kind]) + pick([" ", ": ", " is "]) if rng.random() < (0.6 if good else 0.3) else ""
            text = f"{text} {cue}" if cue else text + pick([" ", "\n", " ("])
            if good:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + pick(["", ".", ",", ")", " "]) + " " + " ".join(rng.choices(words, k=rng.randint(0, 4)))
        out.append((text, spans))
    return out


def _histogram(spark: SparkSession, rows: int) -> list:
    """Candidates of the synthetic rows by kind, feature vector and fold: all, and how many are the spans written there.

    Candidates inside a span of another kind teach nothing: they are redacted with it.
    """
    made = [(i % 2, t, [(EVERY.index(k), a, b) for k, a, b in spans]) for i, (t, spans) in enumerate(synthetic(rows))]
    docs = spark.createDataFrame(made, "fold int, text string, truth array<struct<k:int,s:int,e:int>>")

    def labelled(i: int, c: str) -> str:
        good = _fn(lambda t: f"{t}.k = {i} and {t}.s = {c}.s and {t}.e = {c}.e")
        other = _fn(lambda t: f"{t}.k <> {i} and {t}.s < {c}.e and {c}.s < {t}.e")
        fields = ", ".join(f"'{f}', {c}.{f}" for f in FEATURES)
        return f"named_struct('kind', {i}, {fields}, 'good', exists(truth, {good}), 'other', exists(truth, {other}))"

    each = [f"transform({_candidates('text', k)}, {_fn(partial(labelled, i))})" for i, k in enumerate(EVERY)]
    found = docs.select("fold", F.explode(F.expr(f"concat({', '.join(each)})")).alias("c")).select("fold", "c.*").where("not other")
    counted = found.groupBy("kind", *FEATURES, "fold").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    return counted.orderBy("kind", *FEATURES, "fold").collect()


def fit_trees(rows: list, kind: int) -> tuple[float, list, float]:
    """Boost depth-two trees on one kind's table: (start, trees, threshold); logistic loss, Newton leaves.

    A tree is (feature, cut, (feature, cut, low, high), (feature, cut, low, high)): at most ``cut`` goes low.
    The threshold is the lowest score at which, in the held-out fold, the share of true spans reaches
    ``PRECISION``; infinite if none does, so that nothing is added.
    """
    own = [r for r in rows if r["kind"] == kind]
    train, held = [r for r in own if r["fold"] == 0], [r for r in own if r["fold"] == 1]
    n, good = sum(r["n"] for r in train), sum(r["good"] for r in train)
    if not good or not held:
        return 0.0, [], math.inf
    start = math.log((good + 1) / (n - good + 1))
    names, trees = list(FEATURES), []
    data = [(tuple(r[f] for f in names), r["n"], r["good"]) for r in train]
    score = [start] * len(data)

    def best(members: list[int], grads: list) -> tuple[int, int, float, float, float]:
        """The best stump on some rows: feature, cut, leaf values and gain."""
        out = (0, -1, 0.0, 0.0, -1.0)
        for f in range(len(names)):
            sums: dict[int, list[float]] = {}
            for i in members:
                s = sums.setdefault(data[i][0][f], [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
            g, h = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())
            lg = lh = 0.0
            for cut in sorted(sums):
                lg, lh = lg + sums[cut][0], lh + sums[cut][1]
                rg, rh = g - lg, h - lh
                gain = lg * lg / (lh + 1) + rg * rg / (rh + 1)
                if gain > out[4] + 1e-12:
                    out = (f, cut, RATE * lg / (lh + 1), RATE * rg / (rh + 1), gain)
        return out

    for _ in range(ROUNDS):
        grads = []
        for (_, c, k), s in zip(data, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            grads.append((k - c * p, max(c * p * (1 - p), 1e-9)))
        f, cut, *_ = best(list(range(len(data))), grads)
        low = best([i for i in range(len(data)) if data[i][0][f] <= cut], grads)
        high = best([i for i in range(len(data)) if data[i][0][f] > cut], grads)
        tree = (f, cut, low[:4], high[:4])
        trees.append(tree)
        score = [s + _leaf(tree, d[0]) for s, d in zip(score, data, strict=True)]
    ranked = sorted(((start + sum(_leaf(t, tuple(r[f] for f in names)) for t in trees), r["n"], r["good"]) for r in held), reverse=True)
    threshold, all_n, all_good = math.inf, 0, 0
    for i, (s, c, k) in enumerate(ranked):
        all_n, all_good = all_n + c, all_good + k
        if all_good >= PRECISION * all_n and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            threshold = s
    return start, trees, threshold


def _leaf(tree: tuple, values: tuple) -> float:
    f, cut, low, high = tree
    g, c, a, b = low if values[f] <= cut else high
    return a if values[g] <= c else b


def _score(c: str, start: float, trees: list) -> str:
    names = list(FEATURES)
    side = lambda g, at, a, b: f"if({c}.{names[g]} <= {at}, {a!r}D, {b!r}D)"
    each = [f"if({c}.{names[f]} <= {cut}, {side(*low)}, {side(*high)})" for f, cut, low, high in trees]
    return " + ".join([f"{start!r}D", *each])


def _two(spans: str) -> str:
    return f"transform({spans}, {_fn(lambda c: f"named_struct('s', {c}.s, 'e', {c}.e)")})"


def _clear(ranges: str, base: str) -> str:
    """Ranges, sorted and once each, that touch no base span; by running maxima and minima over all of them in order."""
    event = lambda new: _fn(lambda c: f"named_struct('s', {c}.s, 'e', {c}.e, 'new', {new})")

    def kept(events: str) -> str:
        ends = _tops(f"transform({events}, {_fn(lambda c: f'if({c}.new = 0, {c}.e, 0)')})")
        begins = f"transform(reverse({events}), {_fn(lambda c: f'if({c}.new = 0, -{c}.s, -2147483647)')})"
        good = lambda e, b: lambda c, i: (
            f"{c}.new = 1 and get({e}, {i}) <= {c}.s and -get({b}, size({events}) - 1 - {i}) >= {c}.e and ({i} = 0 or get({events}, {i} - 1) <> {c})"
        )
        return _let(ends, lambda e: _let(_tops(begins), lambda b: f"filter({events}, {_fn(good(e, b), 2)})"))

    both = f"array_sort(concat(transform({base}, {event(0)}), transform({ranges}, {event(1)})))"
    return f"if(size({ranges}) = 0, {_nothing(RANGE)}, {_two(_let(both, kept))})"


def _found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, base spans by kind (b_*) and selected candidates that touch no base span (a_*), of a text column without nulls."""
    histogram = _histogram(docs.sparkSession, ROWS)
    chosen = {}
    for i, k in enumerate(EVERY):
        start, trees, threshold = fit_trees(histogram, i)
        over = _fn(lambda c, m=(start, trees, threshold): f"{_score(c, *m[:2])} >= {m[2] - 1e-9!r}D")
        chosen[k] = _nothing(RANGE) if math.isinf(threshold) else _two(f"filter({_candidates('text', k)}, {over})")
    staged = docs.selectExpr(*keep, "text", *[f"{_two(_base('text', k))} as b_{k}" for k in KINDS], *[f"{chosen[k]} as c_{k}" for k in EVERY])
    staged = staged.selectExpr("*", f"concat({', '.join(f'b_{k}' for k in KINDS)}) as every")
    return staged.selectExpr("*", *[f"{_nothing(RANGE)} as b_{k}" for k in ADDED], *[f"{_clear(f'c_{k}', 'every')} as a_{k}" for k in EVERY])


def _written(kind: str, spans: str) -> str:
    return f"transform({spans}, {_fn(lambda c: f"concat('{kind}:', {c}.s, ':', {c}.e)")})"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the base spans, ``spans`` lists all as kind:start:end, the kinds of ``ADDED``
    last. Null and empty texts have none. Repeated rows give a row each; null doc_ids stay; other columns
    are ignored; an empty table gives no rows.
    """
    found = _found(docs.select("doc_id", as_empty("text").alias("text")), ["doc_id"])
    base = ", ".join(_written(k, f"b_{k}") for k in KINDS)
    every = ", ".join(_written(k, f"array_sort(concat(b_{k}, a_{k}))") for k in EVERY)
    return found.selectExpr(
        "doc_id", *[f"cast(size(b_{k}) as bigint) as n_{k}" for k in KINDS],
        f"sha2(array_join(concat({base}), ','), 256) as base_sha256", f"array_join(concat({every}), ',') as spans",
    )


#: Characters of the parts that a text is cut into, so that no piece is looked for from the text's start.
PART = 1024


def _merged(spans: str) -> str:
    """Sorted spans (s, e, k), those that overlap joined under the name of the first."""

    def joined(ends: str) -> str:
        first = _fn(lambda i: f"{i} = 0 or get({spans}, {i}).s >= get({ends}, {i} - 1)")
        one = lambda at: lambda i, j: (
            f"named_struct('s', get({spans}, {i}).s, 'e', get({ends}, coalesce(get({at}, {j} + 1), size({spans})) - 1), 'k', get({spans}, {i}).k)"
        )
        return _let(f"filter(sequence(0, size({spans}) - 1), {first})", lambda at: f"transform({at}, {_fn(one(at), 2)})")

    return _let(_tops(f"transform({spans}, {_fn(lambda c: f'{c}.e')})"), joined)


def _redacted(text: str, spans: str) -> str:
    def piece(parts: str, a: str, b: str) -> str:
        i, j = f"({a}) div {PART}", f"(({b}) - 1) div {PART}"
        from_i = lambda n: f"substring(get({parts}, cast({i} as int)), cast(({a}) - {i} * {PART} as int) + 1, cast({n} as int))"
        middle = f"array_join(slice({parts}, cast({i} as int) + 2, cast(greatest({j} - {i} - 1, 0) as int)), '')"
        tail = f"substring(get({parts}, cast({j} as int)), 1, cast(({b}) - {j} * {PART} as int))"
        return f"case when ({b}) <= ({a}) then '' when {i} = {j} then {from_i(f'({b}) - ({a})')} else concat({from_i(PART)}, {middle}, {tail}) end"

    def written(parts: str, m: str) -> str:
        until = lambda j: f"coalesce(get({m}, {j} - 1).e, 0)"
        each = _fn(lambda c, j: f"concat({piece(parts, until(j), f'{c}.s')}, '[', {c}.k, ']')", 2)
        return f"concat(array_join(transform({m}, {each}), ''), {piece(parts, until(f'size({m})'), f'length({text})')})"

    cut = f"regexp_extract_all({text}, r'(?s).{{1,{PART}}}', 0)"
    return _let(cut, lambda parts: _let(spans, lambda v: _let(_merged(v), lambda m: written(parts, m))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, as ``[EMAIL]``; same columns.

    Overlapping spans are replaced together, under the name of the first. A null text stays null;
    ``n_chars``, if there is one, is counted anew for texts that change. Rows are carried whole, so other
    columns may have any names; repeated rows stay; an empty table gives no rows.
    """
    columns = docs.columns
    found = _found(docs.select(F.struct(*columns).alias("row"), as_empty("text").alias("text")), ["row"])
    named = lambda k: _fn(lambda c: f"named_struct('s', {c}.s, 'e', {c}.e, 'k', '{k.upper()}')")
    spans = ", ".join(f"transform({x}_{k}, {named(k)})" for k in EVERY for x in "ba")
    picked = found.selectExpr("row", "text", f"array_sort(concat({spans})) as all")
    clean = F.expr(f"if(size(all) = 0, row.text, {_redacted('text', 'all')})")
    picked = picked.select("row", clean.alias("clean"), (F.size("all") > 0).alias("changed"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return picked.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns])
