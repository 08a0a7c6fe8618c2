"""Licence recognition by sentence rules, in DataFrame expressions only.

Known licence sentences are looked for between borders (sentence marks, line ends) of the normalised
text and mapped to identifiers; inside a sentence a line may end anywhere, with comment marks. What is
unknown becomes a gap. Rules, ordered from the most specific, are sequences of identifiers; each rule
takes its places out of the sequence, so that a shorter rule cannot count them again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_empty

#: Known sentences, as published with the licences, by identifier.
SENTENCES: dict[str, str] = {
    "mit-note": "Released under the MIT License",
    "mit-note2": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "apache-note": "Licensed under the Apache License, Version 2.0",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mpl-note": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}
for _v in ("2", "3"):
    for _name, _id in (("GNU General Public License", "gpl"), ("GNU Lesser General Public License", "lgpl"), ("GNU Affero General Public License", "agpl")):
        SENTENCES[f"{_id}-{_v}"] = f"This work is licensed under the {_name}, version {_v}"
        SENTENCES[f"{_id}-{_v}-free"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name}, version {_v}"
for _v in ("3.0", "4.0"):
    for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        SENTENCES[f"cc-{_kind.lower()}-{_v}"] = f"Licensed under CC {_kind} {_v}"

#: Licence and the sentence identifiers that stand for it, most specific first.
RULES: list[tuple[str, list[str]]] = [
    ("mit", ["mit-grant", "mit-keep"]),
    ("mit", ["mit-grant"]),
    ("apache-2.0", ["apache-head", "apache-comply", "apache-copy"]),
    ("apache-2.0", ["apache-head", "apache-comply"]),
    ("apache-2.0", ["apache-head"]),
    ("bsd", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd", ["bsd-grant", "bsd-source"]),
    ("mit", ["mit-note"]),
    ("mit", ["mit-note2"]),
    ("apache-2.0", ["apache-note"]),
    ("isc", ["isc-grant"]),
    ("unlicense", ["unlicense"]),
    ("mpl-2.0", ["mpl-note"]),
    *[(f"{i}-{v}.0", [f"{i}-{v}{e}"]) for i in ("gpl", "lgpl", "agpl") for v in ("2", "3") for e in ("-free", "")],
    *[(i, [i]) for i in SENTENCES if i.startswith("cc-")],
    ("all-rights-reserved", ["reserved"]),
]
BORDER = "[.!?;]+[ \t\r]+|[.!?;]*\n+"

#: Further sentences of the published texts: headers, titles and notices. The SQL has only ``SENTENCES`` and ``RULES``.
PUBLISHED: dict[str, str] = {
    "bsd-neither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission",
    "isc-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mpl-title": "Mozilla Public License Version 2.0",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"
    " and redistribute it freely, subject to the following restrictions:",
    "boost-note": "Distributed under the Boost Software License, Version 1.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-note": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this"
    " software to the public domain worldwide",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available"
    " at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-title": "Eclipse Public License - v 2.0",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies"
    " this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-1-title": "Eclipse Public License - v 1.0",
    "artistic-title": "The Artistic License 2.0",
    "cddl-head": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "cddl-title": "Common Development and Distribution License (CDDL) Version 1.0",
}
_GNU = {
    "gpl-2.0": ("General", "2", "June 1991"), "gpl-3.0": ("General", "3", "29 June 2007"), "lgpl-2.0": ("Library General", "2", "June 1991"),
    "lgpl-2.0b": ("Lesser General", "2", ""), "lgpl-2.1": ("Lesser General", "2.1", "February 1999"),
    "lgpl-3.0": ("Lesser General", "3", "29 June 2007"), "agpl-3.0": ("Affero General", "3", "19 November 2007"),
}
for _id, (_name, _v, _date) in _GNU.items():
    if _date:
        PUBLISHED[f"{_id}-title"] = f"GNU {_name} Public License Version {_v}, {_date}"
    for _what in ("program", "library", "software", "file"):
        _terms = f"This {_what} is free software; you can redistribute it and/or modify it under the terms of the GNU {_name} Public License"
        for _n, _tail in enumerate((
            f"as published by the Free Software Foundation; either version {_v} of the License, or (at your option) any later version",
            f"as published by the Free Software Foundation; either version {_v} of the License",
            f"as published by the Free Software Foundation; version {_v} of the License",
            f"as published by the Free Software Foundation; version {_v}",
            f"version {_v} as published by the Free Software Foundation",
            f"version {_v} only, as published by the Free Software Foundation",
        )):
            PUBLISHED[f"{_id}-{_what}-{_n}"] = f"{_terms} {_tail}"
_KINDS = {"SA": "ShareAlike", "NC": "NonCommercial", "NC-SA": "NonCommercial-ShareAlike"}
for _v, _where, _nd in (("3.0", "Unported", "NoDerivs"), ("4.0", "International", "NoDerivatives")):
    for _kind, _name in {"": "", **_KINDS, "ND": _nd, "NC-ND": f"NonCommercial-{_nd}"}.items():
        _title = f"Creative Commons Attribution{_name and '-' + _name} {_v} {_where}"
        for _n, _text in enumerate((_title, f"This work is licensed under a {_title} License", f"This work is licensed under the {_title} License")):
            PUBLISHED[f"cc-by{_kind and '-' + _kind.lower()}-{_v}/{_n}"] = _text

#: The rules that are used: those of the published sentences beside ``RULES``.
ALL_RULES: list[tuple[str, list[str]]] = [
    ("bsd", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither"]),
    *RULES[:-1],
    ("isc", ["isc-old"]),
    ("apache-2.0", ["apache-title"]),
    ("mpl-2.0", ["mpl-title"]),
    ("zlib", ["zlib-warranty", "zlib-grant"]),
    ("zlib", ["zlib-grant"]),
    ("bsl-1.0", ["boost-note"]),
    ("bsl-1.0", ["boost-title"]),
    ("0bsd", ["0bsd-grant"]),
    ("cc0-1.0", ["cc0-title"]),
    ("cc0-1.0", ["cc0-note"]),
    *[(f"epl-{v}.0", [i]) for v in "21" for i in (f"epl-{v}", f"epl-{v}-title")],
    ("artistic-2.0", ["artistic-title"]),
    ("cddl-1.0", ["cddl-head"]),
    ("cddl-1.0", ["cddl-title"]),
    *[(i[:-1] if i.endswith("b") else i, [s]) for i in _GNU for s in PUBLISHED if s.startswith(f"{i}-")],
    *[(s.split("/")[0], [s]) for s in PUBLISHED if s.startswith("cc-")],
    RULES[-1],
]
#: In lower case text B stands for a border that no sentence crosses, N for the end of a line within one.
HARD = r"(?<![.!?;])[.!?;]++(?:[ \t\r]+|\n)|\n(?:[^\p{L}\p{N}\n]*+\n)+"
LIST_MARK = "(?:[0-9]{1,2}|[a-d]|i{1,3}|iv)"


def _normal(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


KNOWN = {_normal(s): i for i, s in SENTENCES.items()}
ALL_KNOWN = KNOWN | {_normal(s): i for i, s in PUBLISHED.items()}
#: Identifiers stand in a sequence as numbers in angle brackets, gaps as <.>.
NUMBER = {i: n for n, i in enumerate([*SENTENCES, *PUBLISHED])}


def _across_lines(sentence: str) -> str:
    """Pattern of a normalised sentence that may be cut into lines; where it has a mark of its own, a border may stand."""
    out = ""
    for word in sentence.split():
        names = _normal(word).split()
        out += " (?:N )?".join(names)
        if names:
            out += " (?:[BN] ){0,2}" if word[-1] in ".!?;:," else " (?:N )?"
    return re.sub(r" \(\?:(?:N \)\?|\[BN\] \)\{0,2\})$", "", out)


def _known_pattern() -> str:
    """Any known sentence between borders, the longest first, grouped by first words."""
    groups: dict[str, list[str]] = {}
    for s in sorted([*SENTENCES.values(), *PUBLISHED.values()], key=lambda s: -len(_normal(s))):
        first, rest = _across_lines(s).split(" ", 1)
        groups.setdefault(first, []).append(rest)
    each = "|".join(f"{first} (?:{'|'.join(rests)})" for first, rests in groups.items())
    return f"(?<=[BN] )(?:{LIST_MARK} )?(?:{each})(?= [BN])"


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{NUMBER[i]}>" for i in ids)


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> per row: doc_id, n_sentences, n_known, licences (``name:count`` in the order of the rules).

    ``n_sentences`` counts the pieces between sentence marks and line ends, ``n_known`` the known sentences, however
    many lines each takes. A licence that several rules name is listed once for each rule that matched. Null and
    empty texts have no sentences; repeated rows give a row each; other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for s, i in ALL_KNOWN.items() for x in (s, f"<{NUMBER[i]}>")])
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(ids)).alias("ids")) for name, ids in ALL_RULES])
    pattern = _known_pattern()
    text = F.lower(as_empty("text"))
    pieces = F.filter(F.split(text, BORDER), lambda s: s.rlike("[a-z0-9]"))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HARD, " B "), "\n", " N "), "[^a-z0-9BN]+", " ")
    split = docs.select("doc_id", F.size(pieces).cast("long").alias("n_sentences"), F.concat(F.lit("B "), F.trim(marked), F.lit(" B")).alias("marked"))
    split = split.select("doc_id", "n_sentences", "marked", F.regexp_extract_all("marked", F.lit(pattern), F.lit(0)).alias("hits"))
    # A list number alone between two sentences is no gap.
    gap = lambda s: F.when(s.rlike(f"^[BN ]*(?:{LIST_MARK} )?[BN ]*$"), F.lit("")).otherwise(F.lit("<.>"))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, " [BN](?= )", ""), f"^{LIST_MARK} ", "")
    named = F.zip_with(
        F.split("marked", pattern, -1), "hits",
        lambda g, s: F.concat(gap(g), F.when(s.isNull(), F.lit("")).otherwise(F.element_at(known, plain(s)))),
    )
    seq = split.select(
        "doc_id", "n_sentences", F.size("hits").cast("long").alias("n_known"),
        F.when(F.size("hits") == 0, F.lit("")).otherwise(F.concat_ws("", named)).alias("seq"),
    )
    found = F.aggregate(
        rules,
        F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("out")),
        lambda acc, r: F.struct(
            F.replace(acc["seq"], r["ids"], F.lit("<.>")).alias("seq"),
            F.when(
                acc["seq"].contains(r["ids"]),
                F.concat(acc["out"], F.array(F.concat(r["name"], F.lit(":"), _times(acc["seq"], r["ids"]).cast("string")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat_ws(",", acc["out"]),
    )
    return seq.select("doc_id", "n_sentences", "n_known", F.when(F.col("n_known") == 0, F.lit("")).otherwise(found).alias("licences"))


def _times(seq, ids):
    gone = F.length(seq) - F.length(F.replace(seq, ids, F.lit("")))
    return (gone / F.length(ids)).cast("long")


def oracle_sql() -> str:
    """The same rows in DuckDB SQL, from the same tables of sentences and rules."""
    values = ", ".join(f"('{s}', '<{NUMBER[i]}>')" for s, i in KNOWN.items())
    sql = f"""
with known(s, id) as (values {values}),
split as (
  select row_number() over () as r, doc_id,
    list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{BORDER}'),
      lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') as sentences
  from documents),
each as (
  select u.r, u.pos, coalesce(k.id, '<.>') as id
  from (select r, unnest(sentences) as s, generate_subscripts(sentences, 1) as pos from split) u
  left join known k on k.s = u.s),
s0 as (
  select split.r, any_value(doc_id) as doc_id, any_value(len(sentences))::bigint as n_sentences,
    count(*) filter (where id <> '<.>')::bigint as n_known,
    coalesce(string_agg(id, '' order by pos), '') as seq, '' as licences
  from split left join each on each.r = split.r group by split.r)"""
    for n, (name, ids) in enumerate(RULES):
        p = _pattern(ids)
        sql += f""",
s{n + 1} as (
  select r, doc_id, n_sentences, n_known, replace(seq, '{p}', '<.>') as seq,
    case when contains(seq, '{p}') then licences || case when licences = '' then '' else ',' end || '{name}:'
      || ((length(seq) - length(replace(seq, '{p}', ''))) // {len(p)})::varchar else licences end as licences
  from s{n})"""
    return sql + f"\nselect doc_id, n_sentences, n_known, licences from s{len(RULES)}"
