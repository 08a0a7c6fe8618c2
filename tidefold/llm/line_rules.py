"""Quality rules of texts and of lines that many documents of a host share, in DataFrame expressions only.

Every text gives its base figures and a list of its lines as (key, words), where the key hashes the
host and the normalised line. Distinct documents are counted by key, lines in more than ``limit``
documents of their host are removed, and a document that loses too much by that is rejected. The narrow
table of figures and keys is written once; texts are read once.

Keys are 64-bit hashes: two lines of one host share one with a chance of 2^-64, which could only raise
a count. Windows of words are compared as text wherever hashes repeat, so the base figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import as_empty, materialise

#: What stands between words, and a character of a word.
GAP, INK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line goes if more documents of its host have it; a document goes if it loses more than so many of 100 words.
LIMIT, MAX_LOSS_PERCENT = 10, 50
#: Lines with more than this share of all lines are joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1 / 8192


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def normalised(text: Column) -> Column:
    """Lower-case, digits as 0, one space for white space inside a line; line breaks stay."""
    spaced = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.lower(F.regexp_replace(spaced, "[1-9]", "0"))


def _windows(words: str, made) -> Column:
    """``made(word, position, following words)`` for every window of ``WINDOW`` words; no window in shorter texts."""
    w = F.col(words)
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: made(x, i, [F.get(w, i + k) for k in range(1, WINDOW)]))


def base_figures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (text without nulls) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; ``text`` stays.

    Only texts in which a window's hash repeats sort their windows, by the words themselves.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(INK))
    rows = rows.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    rows = rows.withColumn("_hashes", _windows("_words", lambda x, i, after: F.xxhash64(x, *after)))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_sorted", F.when(some, F.sort_array(_windows("_words", lambda x, i, after: F.struct(F.concat_ws(" ", x, *after).alias("s"), i.alias("p"))))))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, i: (x["s"] == F.get(s, i - 1)["s"]) | (x["s"] == F.get(s, i + 1)["s"]))
    # A repeated window adds the words that the one before it, in order of position, does not have.
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["p"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.col(text), f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_words", "_lines", "_hashes", "_sorted")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_keys(text: Column, host: Column) -> Column:
    """The lines with a word as structs of k (hash of host and normalised line) and w (words)."""
    trimmed = F.filter(F.transform(F.split(normalised(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    # A null host is one of its own: it adds nothing to the hash, where others add a mark.
    return F.transform(trimmed, lambda x: F.struct(F.xxhash64(host, host.isNull(), x).alias("k"), n(x).alias("w")))


def frequent_lines(table: DataFrame, limit: int) -> DataFrame:
    """(k, n) of the keys that more than ``limit`` rows of ``table`` (lines) have, each row counted once."""
    once = table.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
    return once.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def _split(table: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Frequent keys: those with a large share of all lines (fewer than the inverse of ``HOT_SHARE``), and all others."""
    keys = materialise(frequent_lines(table, limit), "frequent")
    total = table.agg(F.sum(F.size("lines"))).first()[0] or 0
    return keys.where(F.col("n") > HOT_SHARE * total).select("k"), keys.where(F.col("n") <= HOT_SHARE * total).select("k")


def _of_keys(lines: DataFrame, keys: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows of ``lines`` (k and more) whose key is frequent; hot keys meet a broadcast, so no task gets all rows of one."""
    hot, others = keys
    few = F.broadcast(hot)
    return lines.join(few, "k", "left_semi").unionByName(lines.join(few, "k", "left_anti").join(others, "k", "left_semi"))


def quality_rules(docs: DataFrame, host: str = "source", limit: int = LIMIT, max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """(doc_id, text, host) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    A line, normalised, is removed if more than ``limit`` documents of its host have it, however often
    each has it. A document is kept if it does not fail the base rules and what is removed is at most
    ``max_loss_percent`` of its words and leaves it ``MIN_WORDS``. Null texts have no words and fail. Every
    row is a document of its own, also where doc_ids repeat or are null; rows without a host share one.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", as_empty("text").alias("text"), F.col(host).alias("host"))
    figures = base_figures(rows).withColumn("lines", line_keys(F.col("text"), F.col("host"))).drop("text", "host")
    table = materialise(figures, "lines")
    lines = table.select("row", F.inline("lines").alias("k", "w"))
    removed = _of_keys(lines, _split(table, limit)).groupBy("row").agg(F.sum("w").cast("long").alias("n_removed_words"))
    out = table.drop("lines").join(removed, "row", "left").drop("row").na.fill(0, ["n_removed_words"])
    lost, n = F.col("n_removed_words"), F.col("n_words")
    whole = (100 * lost <= max_loss_percent * n) & (n - lost >= MIN_WORDS)
    return out.select(*[c for c in out.columns if c != "n_removed_words"], (~F.col("base_failed") & whole).alias("kept"), "n_removed_words")


def without_frequent_lines(docs: DataFrame, host: str = "source", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``text`` less the lines that more than ``limit`` documents of its host have; nothing else of a text changes.

    Texts that lose no line stay as they are, null too. One that loses all of its lines with words keeps
    its blank ones.
    """
    columns = docs.columns
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc"), as_empty("text").alias("text"), F.col(host).alias("host"))
    rows = materialise(rows.withColumn("lines", line_keys(F.col("text"), F.col("host"))), "keyed")
    keys = _split(rows, limit)
    touched = _of_keys(rows.select("row", F.inline("lines").alias("k", "w")), keys).select("row").distinct()
    raw = F.col("line")
    parts = rows.join(touched, "row", "left_semi").select("row", "host", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = parts.withColumn("k", F.get(line_keys(raw, F.col("host")), F.lit(0))["k"])
    hot, others = keys
    left = keyed.join(F.broadcast(hot), "k", "left_anti").join(others, "k", "left_anti")
    texts = left.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("all"))
    texts = texts.select("row", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("short"))
    cut = rows.select("row", "doc").join(touched.withColumn("cut", F.lit(True)), "row", "left").join(texts, "row", "left")
    text = F.when(F.col("cut"), F.coalesce("short", F.lit(""))).otherwise(F.col("doc.text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns])


ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, source from documents),
w as (select r, list_filter(regexp_split_to_array(text, '{GAP}'), lambda x: x <> '') as ws from d),
i as (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW}),
g as (select r, i, count(*) over (partition by r, ws[i:i + {WINDOW - 1}]) as n from i),
rep as (select r, count(distinct i + k) as n from g, (select unnest(range({WINDOW})) as k) where n > 1 group by r),
l as (select r, source, unnest(string_split(text, chr(10))) as line from d),
t as (select r, source, line, trim(lower(regexp_replace(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[1-9]', '0', 'g'))) as norm from l where regexp_matches(line, '{INK}')),
dup as (select r, count(*) - count(distinct line) as n from t group by r),
f as (select source, norm from t group by source, norm having count(distinct r) > {LIMIT}),
gone as (select t.r, sum(len(string_split(t.norm, ' '))) as n from t join f on t.norm = f.norm and t.source is not distinct from f.source group by t.r),
b as (
  select d.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_words
  from d join w using (r) left join dup using (r) left join rep using (r) left join gone using (r)),
e as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from b)
select *, not base_failed and 100 * n_removed_words <= {MAX_LOSS_PERCENT} * n_words and n_words - n_removed_words >= {MIN_WORDS} as kept from e
"""
