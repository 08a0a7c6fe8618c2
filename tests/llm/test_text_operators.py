"""Corpus operators against brute force, round trips and held-out accuracy, and on awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import bpe, html_blocks, huffman, lexers, licenses, packing, pii, quality, simhash, token_store
from tidefold.llm.components import connected_components

AWKWARD = [
    (None, "no id a@b.co"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "ΑΣ café́ <|endoftext|> \x1c 日本 don't"), (5, "ΑΣ"), (6, "a  b\n\n c "),
    (7, "mail a.b_c@d.e_f@g.h +1 (499) 555-6503, 4111 1111 1111 1111, 10.0.0.256 1.2.3.4.5.6.7.8 😀 x@y.zz"), (8, "word " * 30000),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, long texts, repeated ids, and extra columns with names used inside."""
    rows = [(d, t, "src", 1, 2) for d, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fp string, part int, n int")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}
    assert connected_components(edges.limit(0)).count() == 0


def test_simhash(spark, docs, awkward):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    near = [(10**6 + i, " ".join(w if rng.random() > 0.004 else "zz" for w in words)) for i in range(80)]
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id bigint, text string")).union(awkward.select("doc_id", "text").where("doc_id <> 5"))
    mixed = mixed.dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in mixed.where("doc_id is not null").collect()]
    want = simhash.brute_force(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(mixed, tile_rows=64).collect() if r.doc_id is not None}
    assert got == want
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == kept.dropDuplicates(["doc_id", "text"]).count()
    assert simhash.simhash_components(awkward.limit(0)).count() == 0
    copies = [(1, "one two three four five six"), (5, "one two three four five six"), (5, "quite another text that is alone here"), (9, "quite another text that is alone here")]
    for rows in (copies, copies[::-1]):
        kept = simhash.drop_near_duplicates(spark.createDataFrame([*rows, rows[0], (None, "one two three four five six")], "doc_id bigint, text string")).collect()
        assert sorted((r.doc_id or 0, r.text[:3]) for r in kept) == [(0, "one"), (1, "one"), (5, "qui")]


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, awkward):
    rng = random.Random(2)
    odd = ["".join(rng.choice("0123456789 -.+()@abZ_%\n") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    odd += ["4111 1111-1111 1111 4111111111111111", "+1 234 567 8901", "a@b.c.d-e.f@g.h", "::1 fe80::1", "12345678901234567890123", "é" * 5 + "+12345678901😀a@b.cc"]
    mixed = awkward.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = sorted((hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest(), len(base_spans(r.text))) for r in mixed.collect())
    found = pii.find_pii(mixed).collect()
    assert sorted((r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in found) == texts
    clean = pii.redact(awkward.withColumnRenamed("n", "n_chars"))
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[1] is None and "[EMAIL]" in by_id[7] and "[PHONE]" in by_id[7] and "[CARD]" in by_id[7] and "555" not in by_id[7]
    assert pii.find_pii(awkward.limit(0)).count() == 0


def test_cards_side_by_side(spark, docs):
    pair = ["4465758382889437 4465758382889437", "7536784127813050 4845168114407329", "4111 1111 1111 1111 5500 0000 0000 0004", "41111111111111115500000000000004", "99 4111-1111-1111-1111 78"]
    texts = {10**7 + i: f"eñ, {t} end" for i, t in enumerate(pair)}
    texts[10**7 + 9] = "values 3.14159265358979 and 12345678901234567890 stay"
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    clean = {r.doc_id: r.text for r in pii.redact(mixed).where("doc_id >= 10000000").collect()}
    digits = {i: re.sub("[^0-9]", "", t) for i, t in clean.items()}
    assert [digits[10**7 + i] for i in range(5)] == ["", "", "", "", "9978"], clean
    assert clean[10**7 + 9] == texts[10**7 + 9]
    spans = {r.doc_id: r.spans.split(",") for r in pii.find_pii(mixed).where("doc_id >= 10000000").collect()}
    assert {"card:4:20", "card:21:37"} <= set(spans[10**7]) and {"card:4:20", "card:20:36"} <= set(spans[10**7 + 3])


FORMS = {
    "email": ["ana (at) example (dot) org", "j.smith [at] uni.edu", "lee AT acme DOT co DOT uk", "josé@correo.españa"],
    "ip": ["2001:db8:0:0:8:800:200c:417a", "2001:db8::ff00:42:8329", "fe80::1ff:fe23:4567"],
    "card": ["4111.1111.1111.1111", "3782.822463.10005"],
    "phone": ["(212) 555-0187", "415-555-2671", "0049 30 9018 2055"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["219-09-9999", "078-05-1120"],
}
ALIKE = [
    "at 12:34:56 on 2024-01-15 10:20", "00:1a:2b:3c:4d:5e is a device", "std::vec::add(a)", "version 10.2.33 of 3.14159265358979", "order 4111111111111112 of 4", "@ana looks at it (at) noon",
    "isbn 978-3-161-48410-0", "000-12-3456 and 123-00-4567", "NL00 ABNA 0417 1643 00", "1 000 000 000 people", "meet at the gate", "from 10 20 30 to 11/12/2020",
]


def test_planted_forms_are_found(spark):
    rows, want = [], {}
    for k, forms in FORMS.items():
        for form in forms:
            for lead in ("we wrote to é, ", f"{k}: "):
                want[len(rows)] = f"{k}:{len(lead)}:{len(lead) + len(form)}"
                rows.append((len(rows), f"{lead}{form}, and went home"))
    alike = range(len(rows), len(rows) + len(ALIKE))
    rows += list(zip(alike, ALIKE, strict=True))
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(made).collect()}
    missed = [(rows[i][1], got[i]) for i, w in want.items() if w not in got[i].split(",")]
    assert not missed
    assert not [(rows[i][1], got[i]) for i in alike if got[i]]
    clean = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert all(f"{rows[i][1].split(', and')[0]}" not in clean[i] for i in want) and all(clean[i] == rows[i][1] for i in alike)


def test_running_results(spark):
    rng = random.Random(5)
    made = [(i, [rng.randint(-9, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 8, 9, 10, 101])]
    rows = spark.createDataFrame(made, "i int, v array<int>").select("i", F.expr(pii._sums("v")).alias("sums"), F.expr(pii._tops("v")).alias("tops")).collect()
    for r in rows:
        assert r.sums == list(itertools.accumulate(made[r.i][1])) and r.tops == list(itertools.accumulate(made[r.i][1], max))


def test_many_matches_in_one_text(spark):
    many = 100_000
    began = time.time()
    made = spark.createDataFrame([(1, "a@b.cc " * many), (2, "x (at) y (dot) org " * 20_000), (3, "4" * 50_000), (4, "1.2.3.4 é" * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_pii(made).collect()}
    assert got[1].n_email == many and got[1].spans.endswith(f"email:{7 * many - 7}:{7 * many - 1}")
    assert got[1].base_sha256 == hashlib.sha256(",".join(base_spans("a@b.cc " * many)).encode()).hexdigest()
    assert got[2].n_email == 0 and len(got[2].spans.split(",")) == 20_000 and got[4].n_ip == 20_000
    clean = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert clean[1] == "[EMAIL] " * many and clean[2] == "[EMAIL] " * 20_000
    assert time.time() - began < 120


def test_boosted_trees_learn():
    rows = [
        {"kind": 0, "fold": fold, "n": 50, "good": 50 if check and not edge else 0} | {f: 0 for f in pii.FEATURES} | {"check": check, "edge": edge}
        for check in (0, 1) for edge in (0, 1) for fold in (0, 1)
    ]
    start, trees, threshold = pii.fit_trees(rows, 0)
    score = lambda **v: start + sum(pii._leaf(t, tuple({**{f: 0 for f in pii.FEATURES}, **v}[f] for f in pii.FEATURES)) for t in trees)
    assert score(check=1) >= threshold > max(score(), score(edge=1), score(check=1, edge=1))


def test_huffman_round_trip():
    rng = np.random.default_rng(0)
    for counts in (rng.geometric(0.01, 5000) - 1, np.array([0, 5]), 2 ** np.arange(30), np.ones(300, dtype=int)):
        lengths = huffman.code_lengths(counts, 16)
        assert lengths.max() <= 16 and (lengths[counts > 0] > 0).all() and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 + 1e-9
        ids = rng.choice(np.flatnonzero(counts), 3000)
        sizes = np.array([1, 700, 0, 256, 2043])
        data, offsets, marks = huffman.pack(ids, sizes, huffman.canonical_codes(lengths), lengths)
        assert len(data) == offsets[-1]
        assert np.array_equal(huffman.unpack(data, marks, sizes, huffman.decode_table(lengths)), ids)


def test_token_store(docs, awkward):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_digests(docs).collect()}
    assert got == token_store.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    rows = token_store.token_digests(awkward).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert token_store.token_digests(awkward.limit(0)).count() == 0


def test_cached_encoding_is_the_librarys(monkeypatch):
    rng = random.Random(3)
    texts = [t for _, t in AWKWARD] + ["".join(rng.choice("abcdeéßΣıİ’'sdtlre 12 \n\t.,!?<|>́ \x1f世Āſ…€™½\xa0\x00ŉÅ") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["".join(rng.choice("abcAB’ …Ā'éŉÅſ½ \n.x") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = lexers.ChunkEncoder.of(name)
        monkeypatch.setattr(lexers, "GROUP_CHARS", 300)
        monkeypatch.setattr(lexers, "CACHE", 150)
        ids, sizes = encoder.encode_all(texts)
        ends = np.cumsum(sizes).tolist()
        for text, a, b in zip(texts, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids
    codec = bpe.Codec.of("word_bpe_49k.json")
    library = lexers.ChunkEncoder.of("word_bpe_49k.json").library
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.digest(text)[2] == codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(docs, awkward):
    library = lexers.ChunkEncoder.of("word_bpe_49k.json").library
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for table in (docs, awkward):
        want = []
        for r in table.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id or 0, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(table).collect()) == sorted(want)
    assert bpe.bpe_digests(awkward.limit(0)).count() == 0


def test_cuts():
    doc, start, size = packing.cuts(np.array([5, 8, 3, 1]), 4)
    assert doc.tolist() == [0, 0, 1, 1, 2, 3] and start.tolist() == [0, 1, 0, 4, 0, 0] and size.tolist() == [1, 4, 4, 4, 3, 1]


def best_fit(sizes, length):
    """Plain best fit, longest first: number of sequences."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else length
        bisect.insort(gaps, gap - s)
    return len(gaps)


def best_fit_into(pieces, gaps):
    """Plain best fit, longest first, into given gaps alone: the pieces placed, and the sizes of what is left of the gaps."""
    left, placed = sorted(s for _, s in gaps), []
    for s, i in sorted(((s, i) for i, s in pieces), key=lambda x: (-x[0], x[1])):
        at = bisect.bisect_left(left, s)
        if at < len(left):
            bisect.insort(left, left.pop(at) - s)
            placed.append(i)
    return sorted(placed), [g for g in left if g]


def test_one_range_is_best_fit(spark):
    """A sweep of one range places the pieces that plain best fit places, and leaves the same gaps."""
    rng = np.random.default_rng(1)
    for most in (64, 9):
        pieces = [(2 * i, int(s)) for i, s in enumerate(rng.integers(1, most, 300))]
        gaps = [(2 * i, int(s)) for i, s in enumerate(rng.integers(1, 64, 120))]
        state = spark.createDataFrame([(packing.PIECE, *p) for p in pieces] + [(packing.GAP, *g) for g in gaps], "kind int, id bigint, size bigint")
        rows = packing._sweep(state, 1, 64, None, 0).collect()
        placed, left = best_fit_into(pieces, gaps)
        assert sorted(r.id for r in rows if r.kind == packing.PLACED) == placed
        assert sorted(r.size for r in rows if r.kind in (packing.GAP, packing.CHANGED)) == left


@pytest.mark.parametrize("fan", [1024, 3])
def test_partners_across_ranges(spark, monkeypatch, fan):
    """Pieces close what the nearest gaps before them open, however many groups of groups of ranges there are."""
    monkeypatch.setattr(packing, "FAN", fan)
    rng = np.random.default_rng(fan)
    rows, open_gaps, want, key = [], [], set(), 0
    for part in range(40):
        if part % 7 == 3:
            continue
        p, g = (int(x) for x in rng.integers(0, 6, 2))
        for rank in range(p):
            rows.append((part, packing.PIECE, key, 1, rank))
            if open_gaps:
                want.add((key, open_gaps.pop()))
            key += 1
        # Rank 0 is the gap nearest to what follows.
        rows += [(part, packing.GAP, key + rank, 2, rank) for rank in range(g)]
        open_gaps += [key + rank for rank in reversed(range(g))]
        key += g
    got = packing.across(spark.createDataFrame(rows, "part int, kind int, id bigint, size bigint, rank bigint"), 40)
    assert {(r.piece, r.bin) for r in got.collect()} == want and got.count() == len(want)


def test_small_pieces_in_few_rounds(spark, monkeypatch):
    """Many short pieces over several ranges: within a hundredth of plain best fit, in 25 rounds at most."""
    rounds = []
    sweep = packing._sweep
    monkeypatch.setattr(packing, "_sweep", lambda *a: rounds.append(a[1]) or sweep(*a))
    for low, high in ((20, 120), (1, 40)):
        rounds.clear()
        sizes = np.random.default_rng(7).integers(low, high, 20_000).tolist()
        text = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint")
        got = [tuple(r) for t in packing.assign(text, text.limit(0), range_rows=4096) for r in t.collect()]
        held = {}
        for i, place in got:
            held[place] = held.get(place, 0) + sizes[i]
        assert sorted(i for i, _ in got) == list(range(20_000)) and max(held.values()) <= 1024
        assert len(held) <= 1.01 * best_fit(sizes, 1024) and rounds[0] > 1 and len(rounds) <= 25, (len(held), len(rounds))


@pytest.mark.parametrize("sizes", ["even", "small", "equal"])
def test_rounds_need_no_more_sequences_than_best_fit(spark, sizes):
    rng = np.random.default_rng(0)
    made = {"even": rng.integers(1, 129, 600), "small": rng.integers(1, 6, 900), "equal": np.full(301, 39)}[sizes].tolist()
    text = spark.createDataFrame([(i, s) for i, s in enumerate(made)], "id bigint, size bigint")
    large = [(2 * i, 128 - s) for i, s in enumerate(made) if s > 64]
    gaps = spark.createDataFrame(large, "id bigint, size bigint") if large else text.limit(0)
    got = [tuple(r) for t in packing.assign(text.where("size <= 64"), gaps, 128, range_rows=100) for r in t.collect()]
    held = {i: 128 - g for i, g in large}
    for i, place in got:
        held[place] = held.get(place, 0) + made[i]
    assert sorted(i for i, _ in got) == [i for i, s in enumerate(made) if s <= 64] and max(held.values()) <= 128
    assert len(held) <= 1.01 * best_fit(made, 128) + 1


def test_packing(docs, awkward):
    for table in (docs, awkward, awkward.union(awkward)):
        got = packing.pack(table, range_rows=50).toPandas()
        assert got["sequence_id"].nunique() <= best_fit(got["length"], 1024) + 1
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    library = lexers.ChunkEncoder.of("byte_bpe_50k.json").library
    got = packing.pack(docs).toPandas()
    text = dict(docs.select("doc_id", "text").collect())
    for doc_id, own in got.groupby("doc_id"):
        ids = np.array([*library.encode(text[doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert own["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    assert packing.pack(awkward.limit(0)).count() == 0


def test_licences(spark, docs, awkward):
    notes = [
        "Released under the MIT License. More.", licenses.SENTENCES["mit-grant"] + "\n\n" + licenses.SENTENCES["mit-keep"] + ".",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "An MIT licence is not named here.",
    ]
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(notes)], "doc_id bigint, text string")
    got = {r.doc_id: r.licences for r in licenses.scan_licences(made).collect()}
    assert [got[10**6 + i] for i in range(4)] == ["mit:1", "mit:1", "cc-by-nc-4.0:2", ""]
    mixed = docs.select("doc_id", "text").union(made).union(awkward.select("doc_id", "text"))
    con = duckdb.connect()
    con.register("documents", mixed.toArrow())
    want = con.execute(licenses.oracle_sql()).fetchall()
    assert sorted(map(tuple, licenses.scan_licences(mixed).collect()), key=str) == sorted(want, key=str)


def test_licences_over_lines(spark):
    import textwrap

    def cut(text, mark=""):
        return "\n".join(mark + line for line in textwrap.wrap(text, 78 - len(mark)))

    def gnu(name, version, what="program", sep=";"):
        return (
            f"This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by"
            f" the Free Software Foundation{sep.replace(':', ',')} either version {version} of the License, or (at your option) any later version."
        )

    s = licenses.SENTENCES
    bsd = "\n\n".join(cut(t) for t in (s["bsd-grant"], "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + ".", "3. " + licenses.PUBLISHED["bsd-neither"] + "."))
    mit = cut(s["mit-grant"], " * ") + "\n *\n" + cut(s["mit-keep"] + ".", " * ")
    texts = {
        "mit:1": "/*\n * Copyright (c) 2020 A. Person\n" + mit + "\n */\nint main;",
        "mit:1 ": "Copyright (c) 2020 A. Person\r\n" + (cut(s["mit-grant"]) + "\n\n" + cut(s["mit-keep"] + ".")).replace("\n", "\r\n"),
        "bsd:1": "Copyright B\n\n" + bsd + "\n\nTHIS SOFTWARE IS",
        "isc:1": cut(s["isc-grant"] + ".", "# "),
        "gpl-3.0:1": cut(gnu("General", "3", sep=":"), "// "),
        "gpl-2.0:1": cut(gnu("General", "2")),
        "lgpl-2.1:1": cut(gnu("Lesser General", "2.1", "library")),
        "agpl-3.0:1": cut(gnu("Affero General", "3", sep=":")),
        "mpl-2.0:1": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not */",
        "cc-by-sa-4.0:1": cut("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        "zlib:1": cut("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable. Permission is granted"
                      " to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
                      " following restrictions:"),
        "bsl-1.0:1": "//  Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file)",
        "0bsd:1": cut("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.") + "\n\nTHE SOFTWARE",
        "cc0-1.0:1": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS",
        "epl-2.0:1": cut("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"
                         " https://www.eclipse.org/legal/epl-2.0/", " * "),
        "mit:2": "Some words\nReleased under the MIT License\nReleased under the MIT License\nmore words",
        "": "Permission is hereby granted, free\n\nof charge. Released under\n\nthe MIT License. Not released under the MIT License",
    }
    made = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    got = {r.doc_id: r.licences for r in licenses.scan_licences(made).collect()}
    assert [got[i] for i in range(len(texts))] == [name.strip() for name in texts]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    unary, move = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    marginal, pairs, logz = quality.forward_backward(unary, np.ones((1, 4), dtype=bool), move)
    weight = {}
    for path in np.ndindex(2, 2, 2, 2):
        weight[path] = np.exp(sum(unary[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
    total = sum(weight.values())
    assert np.log(total) == pytest.approx(logz[0])
    for t in range(4):
        assert sum(w for p, w in weight.items() if p[t]) / total == pytest.approx(marginal[0, t, 1])
    assert pairs.sum() == pytest.approx(3)


def plain_score(model, text):
    """A whole text's score by one plain chain in logarithms."""
    (features, _), *rest = quality.segments(text)
    assert not rest
    lines = (text or "").split("\n")
    unary = [np.array([0.0, f @ model.weights]) for f in features]
    alpha, beta = [unary[0]], [np.zeros(2)]
    for u in unary[1:]:
        alpha.append(np.array([np.logaddexp(alpha[-1][0] + model.move[0, y], alpha[-1][1] + model.move[1, y]) + u[y] for y in (0, 1)]))
    for u in reversed(unary[1:]):
        beta.append(np.array([np.logaddexp(model.move[y, 0] + u[0] + beta[-1][0], model.move[y, 1] + u[1] + beta[-1][1]) for y in (0, 1)]))
    good = [np.exp(a[1] + b[1] - np.logaddexp(*(a + b))) for a, b in zip(alpha, reversed(beta), strict=True)]
    size = [max(len(x), 1) for x in lines]
    mean = min(max(sum(g * n for g, n in zip(good, size, strict=True)) / sum(size), 1e-4), 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.shift)))


def test_whole_scores_are_those_of_a_plain_chain(docs, monkeypatch):
    rng = np.random.default_rng(3)
    model = quality.LineField(rng.normal(size=quality.WIDE), np.clip(rng.normal(size=(2, 2)) * 2, -2, 2), 1.3, -0.2)
    texts = [r.text for r in docs.limit(40).collect()] + [t for _, t in AWKWARD[:-1]] + ["\n" * 50, "A b.\n" * 3000 + "!!! @@@\n" * 3000]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-9)
    monkeypatch.setattr(quality, "SEGMENT", 2000)
    assert np.allclose(model.score(texts), want, atol=1e-9)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert np.allclose(model.score(texts[:30]), want[:30], atol=1e-9)
    began = time.time()
    monkeypatch.undo()
    assert 0 <= model.score(["\n" * 1_000_000])[0] <= 1 and time.time() - began < 120


def test_quality(spark, awkward):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.quality(table, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    rows = quality.quality(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(awkward.limit(0), labels).count() == 0


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_blocks.fit_labeller(pages)
    got = html_blocks.extract(model, [
        '<body><div class="sidebar">x</div><article><h1>T</h1><p>A &amp; B<b>c</b><br>d<div class="comments"><p>nice post</p></div></article>'
        '<script>if(a<b)"</p>"</script><footer>end</footer>', None, "", "<article><p>one<p>two<nav>menu</nav></article>",
    ])
    assert got == ["T\nA & Bc d", "", "", "one\ntwo"]
    rows = html_blocks.extract_text(pages, model).collect()
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        assert r.n_chars == len(r.text) and r.text and "<p" not in r.text
        inside = html_blocks._SPACE.sub("", re.sub("<[^>]*>", "", re.search("(?s)<article>(.*?)(?:</article>|$)", raw[r.page_id])[1]))
        assert html_blocks._SPACE.sub("", __import__("html").unescape(inside)) == html_blocks._SPACE.sub("", r.text)
    assert html_blocks.extract_text(pages.limit(0), model).count() == 0


def test_html_keeps_figures_formulas_and_short_blocks(spark, sf):
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><figure><pre>code</pre><figcaption>A caption</figcaption></figure></article>"
    blocks = html_blocks.leaves(page)
    assert [t for _, t, _ in blocks] == ["So x=2 holds.", "code", "A caption"] and html_blocks.teacher(blocks).all()
    model = html_blocks.fit_labeller(spark.read.parquet(f"{sf}/pages.parquet"))
    assert html_blocks.extract(model, [page]) == ["So x=2 holds.\ncode\nA caption"]
    plain = (
        "<body><ul><li><a>Home</a><li><a>About</a></ul><h1>Title</h1><p>Yes.</p><p>A paragraph that is longer than the rest.</p>"
        "<ul><li>salt<li>pepper</ul><div class=footer>imprint and so on and so forth</div></body>"
    )
    blocks = html_blocks.leaves(plain)
    want = ["Title", "Yes.", "A paragraph that is longer than the rest.", "salt", "pepper"]
    assert [b[1] for b, y in zip(blocks, html_blocks.teacher(blocks), strict=True) if y] == want


def test_every_name_of_an_element_counts():
    many = "div " + " ".join(f"p-{i}" for i in range(12))
    assert (html_blocks._path_vector(many) != html_blocks._path_vector(f"{many} cookie-banner")).any()
    block = lambda path: (path, "Some text of a block that is long enough.", 0)
    blocks = [block(f"html/body/article/{many} cookie-banner"), block("html/body/article/div article-header"), block("html/body/article/p"), block("html/body/article/div comment-list")]
    assert html_blocks.teacher(blocks).tolist() == [0, 1, 1, 0]


def test_html_query_on_made_pages(spark, sf):
    """The whole query against the text by construction: adverts inside paragraphs and 600 deep, words of a paragraph named like one."""
    rng = random.Random(6)
    vocabulary = "the of and in to water light after under between green seven people never always river stone".split()
    say = lambda n: (" ".join(rng.choice(vocabulary) for _ in range(n)) + ".").capitalize()
    rows, want = [], {}
    for i in range(60):
        body, text = [], []
        for _ in range(rng.randint(2, 6)):
            a, b = say(rng.randint(4, 30)), say(rng.randint(4, 30))
            kind = rng.randint(0, 4)
            deep = rng.choice([0, 3, 600])
            if kind == 0:
                body.append(f'<p>{a}<span class="ad">{"<b>" * deep}BUY NOW{"</b>" * deep}</span> {b}</p>')
                text.append(f"{a} {b}")
            elif kind == 1:
                body.append(f'<p>{a} See <code class="ad">x=1</code> and <a href="#" class="share">the shared data set</a>. {b}</p>')
                text.append(f"{a} See x=1 and the shared data set. {b}")
            elif kind == 2:
                body.append(f"<p>{a} {'<i>' * deep}{b}{'</i>' * deep} &amp;\n\t<em>more</em></p>")
                text.append(f"{a} {b} & more")
            elif kind == 3:
                body.append(f'<div class="ad"><p>{b}</p></div><h2>{a}</h2>')
                text.append(a)
            else:
                body.append(f"<ul><li>{a}</li><li>{b}</li></ul>")
                text += [a, b]
        rows.append((i, f"u{i}", f'<html><body><nav><ul><li><a href="#">{say(2)}</a></li></ul></nav><article><h1>Title {i}</h1>{"".join(body)}</article><footer><p>{say(4)}</p></footer></body></html>'))
        want[i] = "\n".join([f"Title {i}", *text])
    given = spark.read.parquet(f"{sf}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url", "html")
    pages = spark.createDataFrame(rows, given.schema).unionByName(given)
    got = {r.page_id: r.text for r in html_blocks.extract_text(pages).where("page_id < 1000").collect()}
    assert got == want


def test_inserted_adverts_and_deep_pages():
    page = '<article><p>Good <span class="ad">Buy <b>now</b></span>text <a class="nav-link" href="#">here</a>.</p></article>'
    blocks, found = html_blocks.read(page)
    assert [(p, t) for p, t, _ in blocks] == [("article/p", "Good text here."), ("article/p/span ad", "Buy now")]
    assert html_blocks.teacher(blocks).tolist() == [1, 0] and html_blocks.main_text(found, [True, False]) == "Good text here."
    assert html_blocks.main_text(found, [True, True]) == "Good Buy nowtext here."
    began = time.time()
    deep = "<div>" * 50_000 + "<p>inside</p>" + "</div>" * 50_000 + "<p>after</p>"
    blocks = html_blocks.leaves(deep)
    assert [t for _, t, _ in blocks] == ["inside", "after"] and blocks[1][0] == "p" and time.time() - began < 20
    assert len(html_blocks.leaves("<b>" * 20_000 + "x" + "</b>" * 20_000)) == 1 and time.time() - began < 40


def test_html_pages_of_other_shapes(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    real = given.limit(20)
    nulls = spark.range(3000).selectExpr("id + 1000000 as page_id", "'u' as url", "cast(null as string) as html")
    mixed = real.union(nulls).union(real.limit(1)).selectExpr("*", "1 as text", "2 as h", "'x' as n_chars")
    model = html_blocks.fit_labeller(mixed)
    rows = html_blocks.extract_text(mixed, model).collect()
    assert len(rows) == 3021 and all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id >= 1000000)
    raw = {r.page_id: r.html for r in real.collect()}
    for r in rows:
        if r.page_id < 1000000:
            inside = html_blocks._SPACE.sub("", re.sub("<[^>]*>", "", re.search("(?s)<article>(.*?)(?:</article>|$)", raw[r.page_id])[1]))
            assert html_blocks._SPACE.sub("", __import__("html").unescape(inside)) == html_blocks._SPACE.sub("", r.text)
    model = html_blocks.fit_labeller(given)
    long = "A paragraph that goes on and on about the matter at hand and says more than the rest of the page does. " * 3
    pages = [
        f"<body><h1>T</h1><p>{long}</p><p>Short.</p></body>",
        f'<article><div class="article-header"><h2>Sub</h2></div><p>{long}</p></article>',
        "<article>" + "".join(f"<p>Line {i} of a page with very many blocks.</p>" for i in range(9000)) + "</article><footer>end</footer>",
    ]
    got = html_blocks.extract(model, pages)
    assert got[0] == f"T\n{long.strip()}\nShort." and got[1] == f"Sub\n{long.strip()}" and got[2].count("\n") == 8999


def test_long_pages_are_scored_as_short_ones():
    net = html_blocks.BiLSTM(html_blocks.PATH + html_blocks.WORDS + html_blocks.PLAIN)
    blocks = [(f"html/body/div x{i % 5}/p", f"text {i}", 0) for i in range(50)]
    x, there = html_blocks._padded([html_blocks.vectors(blocks)])
    assert np.allclose(net.score(x, there)[0], net.score_long(blocks, 7))


def test_scores_are_those_of_plain_lstms():
    rng = np.random.default_rng(1)
    net = html_blocks.BiLSTM(5, 3)
    pages = [rng.normal(size=(n, 5)) for n in (4, 1, 7)]
    x, there = html_blocks._padded(pages)
    got = net.score(x, there)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for page, row in zip(pages, got, strict=True):
        logit = np.full(len(page), net.p["bias"][0])
        for d, weight in (("f", net.p["out"][:3]), ("b", net.p["out"][3:])):
            h, c = np.zeros(3), np.zeros(3)
            for t in range(len(page)) if d == "f" else range(len(page) - 1, -1, -1):
                z = page[t] @ net.p[f"x{d}"] + h @ net.p[f"h{d}"] + net.p[f"b{d}"]
                c = sigmoid(z[3:6]) * c + sigmoid(z[:3]) * np.tanh(z[9:])
                h = sigmoid(z[6:9]) * np.tanh(c)
                logit[t] += h @ weight
        assert np.allclose(row[: len(page)], sigmoid(logit))


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    net = html_blocks.BiLSTM(3, 2)
    x, there, y = rng.normal(size=(2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], dtype=bool), rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.score(x, there)
        return -(there * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / there.sum()

    for name, g in net.gradient(x, there, y).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        down = loss()
        net.p[name][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
