"""Each operator against brute force, an exact round trip or held-out accuracy, and on nulls, empty texts, repeats and empty tables."""

import bisect
import collections
import hashlib
import itertools
import math
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import jaccard_join, language_id, language_model, license_scan, line_dedup, media, mixing, packing, quality, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
EDGE = [(1, None, None, None), (2, "", "a", "en"), (None, "x y z w v", "a", None), (3, "one two three\n\none two three", "a", "en"), (3, "one two three\n\none two three", "a", "en"), (4, "é # 1 " * 3000, None, "fr"), (5, "  \n ", "b", "de")]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumn("size", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("n", F.lit(2)).withColumn("block", F.lit(3))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def union(items, links):
    up = {i: i for i in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in items}


# ------------------------------------------------------------------ 1
def test_license_scan(spark, docs):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/f.txt", "plain"), (3, "a/b/LICENSE", "x\nLicensed under the Apache License, Version 2.0."), (4, "a/g", "This work is licensed under the GNU General Public License, version 3."), (5, "h", ""), (6, None, "Released under the MIT License."), (7, "a/n", None)]
    got = {r.doc_id: (r.own, r.licence, r.inherited_from) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("GPL-3.0", "GPL-3.0", None), 5: (None, None, None), 6: (None, None, None), 7: (None, "MIT", "a")}


def license_units(text, whole):
    """Lines and blocks without comment marks, by hand."""
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^[ \t]*(/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)?[ \t]*", "", line)
        lines.append(re.sub(r"[ \t]*(\*+/|-->)?[ \t\r]*$", "", line))
    out, block = list(lines), []
    for line in [*lines, ""]:
        if line:
            block.append(line)
        elif block:
            out.append(" ".join(block))
            block = []
    return out + ([" ".join(lines)] if whole else [])


HEADERS = {
    "GPL-3.0": """/* prog.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful. */""",
    "MIT": """// Copyright (c) 2020 Somebody
//
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, subject to the following conditions:""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
import os""",
    "BSD-3-Clause": """; Redistribution and use in source and binary forms, with or without
; modification, are permitted provided that the following conditions are met:
; 1. Redistributions of source code must retain the above copyright notice, this
;    list of conditions and the following disclaimer.
; 2. Redistributions in binary form must reproduce the above copyright notice,
;    this list of conditions and the following disclaimer in the documentation
;    and/or other materials provided with the distribution.
; 3. Neither the name of Somebody nor the names of its contributors
;    may be used to endorse or promote products derived from this software
;    without specific prior written permission.""",
    "LGPL-2.1": """-- This program is free software; you can redistribute it and/or modify it under the terms of
-- the GNU Lesser General Public License as published by the Free Software Foundation; either
-- version 2.1 of the License, or (at your option) any later version.""",
}


def test_license_headers_and_files_are_found(spark):
    full = [t for i, t in license_scan.TEMPLATES if i == "MIT"][-1]
    wrapped = "\n".join(full[k : k + 70] for k in range(0, len(full), 70))
    rows = [(k, f"src/d{k}/a.c", f"int x;\n\n{t}\nint main() {{ }}\n") for k, t in enumerate(HEADERS.values())]
    rows += [(100, "lib/LICENSE", "Somebody's library\n\n" + "\n\n".join(wrapped.split(". "))), (101, "lib/deep/er/x.c", "int y;"), (102, "other/x.c", "nothing to see here")]
    rows += [(200 + k, f"more/{k}", f"plain text number {k} about the software you may use") for k in range(40)]
    got = {r.doc_id: (r.own, r.licence, r.inherited_from) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: got[k][0] for k in range(len(HEADERS))} == dict(enumerate(HEADERS))
    assert got[100][0] == "MIT" and got[101] == (None, "MIT", "lib") and got[102] == (None, None, None) and not any(got[200 + k][0] for k in range(40))


def test_license_scores_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(64_000 + k, t) for k, t in enumerate(HEADERS.values())]
    held = collections.Counter(w for _, t in rows for w in set(license_scan._python_terms(t)))
    idf = {w: math.log((1 + len(rows)) / (1 + held[w])) + 1 for w in {*held, *license_scan.vocabulary()}}
    unit = license_scan.template_vectors(idf)
    want = {}
    for i, t in rows:
        best = []
        for line in license_units(t, i % 64 == 0):
            tf = collections.Counter(license_scan._python_terms(line))
            v = {w: n * idf[w] for w, n in tf.items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            best += [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / norm, 6), k) for (k, _), u in zip(license_scan.TEMPLATES, unit)]
        s, k = min(best)
        want[i] = (k, -s) if -s >= license_scan.THRESHOLD else (None, None)
    files = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string").withColumn("path", license_scan.path_of())
    got = license_scan.scan(files).collect()
    assert {r.doc_id: (r.own, r.score and round(r.score, 6)) for r in got} == want and any(k for k, _ in want.values())


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_license_weighs_common_words_by_all_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(license_scan, "BROADCAST", limit)
    notice = license_scan.TEMPLATES[:1]
    header = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with it'
    texts = [f"plain{k}\n" + "you may not use this file except in compliance with it " * (k % 3 > 0) + "\napache\nversion\n2.0\nlicense" * (k % 10 == 0) for k in range(300)] + [header]
    held = collections.Counter(w for t in texts for w in set(license_scan._python_terms(t)))
    true = {w: math.log((1 + len(texts)) / (1 + held[w])) + 1 for w in {*held, *license_scan.vocabulary()}}

    def cosine(weight):
        v = {w: n * weight(w) for w, n in collections.Counter(license_scan._python_terms(header)).items()}
        unit = license_scan.template_vectors(true, notice)[0]
        return sum(x * unit.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()))

    known = set(license_scan.vocabulary(notice))
    assert cosine(true.get) >= license_scan.THRESHOLD > cosine(lambda w: true[w] if w in known else math.log(1 + len(texts)) + 1)
    rows = spark.createDataFrame([(k, f"d/{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own, r.score) for r in license_scan.scan(rows, notice).where("own is not null").collect()}
    assert got == {300: ("Apache-2.0", pytest.approx(cosine(true.get), abs=1e-6))}


def test_license_scores_only_units_that_can_match(spark, monkeypatch):
    """Prose holds needed terms of the templates, but not enough of any template: no term of it is written."""
    real, seen = license_scan.stored, {}

    def keep(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(license_scan, "stored", keep)
    prose = "the use of a file or the work of any program may be subject to the list above"
    rows = [(k, f"d/{k}", f"{prose} {k}\n\n{prose}\n{prose}") for k in range(40)] + [(99, "d/n", f"{prose}\nReleased under the MIT License.\n{prose}")]
    files, read = spark.createDataFrame(rows, "doc_id long, path string, text string"), {}
    monkeypatch.setattr(license_scan, "idf", lambda *a, f=license_scan.idf: read.setdefault("idf", f(*a)))
    own = license_scan.declared(files)
    assert [(r.path, r.own) for r in own.collect()] == [("d/n", "MIT")]
    assert {(r.path, r.line_no) for r in seen["terms"].collect()} == {("d/n", 1), ("d/n", 3)}  # the line and the block that it is in
    # The bound holds for every unit: what reaches the threshold by brute force is covered.
    vectors = license_scan.template_vectors(read["idf"][0])
    halves = [(" ".join(license_scan._python_terms(t)[::2]),) for _, t in license_scan.TEMPLATES]
    for r in spark.createDataFrame(halves, "t string").select("t", license_scan.covered(license_scan.terms(F.col("t")), vectors).alias("c")).collect():
        held = set(license_scan._python_terms(r.t))
        assert r.c >= max(sum(x * x for t, x in v.items() if t in held) for v in vectors) - 1e-9


def test_license_empty(spark, edge):
    got = {(r.doc_id, r.own, r.licence) for r in license_scan.scan(edge.withColumn("path", license_scan.path_of())).collect()}
    assert got == {(i, None, None) for i, *_ in EDGE} and len(EDGE) == license_scan.scan(edge.withColumn("path", license_scan.path_of())).count()
    assert license_scan.scan(edge.limit(0).withColumn("path", license_scan.path_of())).count() == 0


# ------------------------------------------------------------------ 2
def jaccard_model(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = union(sets, links)
    return {i: (len(sets[i]), top[i]) for i in sets}


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 60 if g % 3 else 10**6, 80)]
        for _ in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(df).collect()}
    want = jaccard_model(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_jaccard_of_rows_that_share_a_doc_id(spark):
    a, b, c = ("one two three four five six seven eight", "quite another text that has nothing in common with the first", "a third text of eight or more words here")
    rows = [(7, a), (3, a), (7, b), (7, b), (9, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 4, 3), (3, 4, 3), (7, 7, 7), (7, 7, 7), (9, 5, 9), (None, None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(df).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (7, b), (9, c), (None, a)], key=str)


def test_jaccard_hot_shingles_in_blocks(spark, monkeypatch):
    """Many documents share a passage but aren't similar; pairs are planted among them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(8)
    passage, rows = " ".join(f"p{k}" for k in range(20)), []
    for k in range(120):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        rows.append((k, passage + " " + " ".join(own)))
        if k % 10 == 0:
            rows.append((1000 + k, passage + " " + " ".join(own[:-1] + ["z"])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_model(rows)


def test_jaccard_compares_near_copies_with_one_centre(spark, monkeypatch):
    """Near copies share shingles with many centres; those that one comparison joins aren't compared again."""
    real, compared = jaccard_join._verified, []

    def count(pairs, segments, percent):
        compared.append(pairs.count())
        return real(pairs, segments, percent)

    monkeypatch.setattr(jaccard_join, "_verified", count)
    rng = np.random.default_rng(3)
    base, rows = [f"w{x}" for x in rng.integers(0, 10**6, 200)], []
    for k in range(120):
        at, w = int(rng.integers(0, 200)), list(base)
        w[at] = f"z{rng.integers(0, 12)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_model(rows) and sum(compared) < len(rows), compared


def test_jaccard_counts_no_pairs_that_bitmaps_tell_apart(spark, monkeypatch):
    """Near copies that are similar to few others share shingles with all of them; pairs are planted among them."""
    real, compared = jaccard_join._verified, []

    def count(pairs, segments, percent):
        compared.append(pairs.count())
        return real(pairs, segments, percent)

    monkeypatch.setattr(jaccard_join, "_verified", count)
    rng = np.random.default_rng(5)
    base, rows = [f"w{x}" for x in rng.integers(0, 10**6, 200)], []
    for k in range(160):
        w = [x if rng.random() > 0.025 else f"z{rng.integers(0, 10**6)}" for x in base]
        rows.append((k, " ".join(w)))
        if k % 8 == 0:
            rows.append((1000 + k, " ".join(w[:-1] + ["end"])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = jaccard_model(rows)
    assert got == want and len({c for _, c in want.values()}) > 20
    assert sum(compared) < 4 * len(rows), compared


def test_jaccard_edges(spark, edge):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.ngram_jaccard_components(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (5, 0, 5), (3, 2, 3), (None, None, None)} <= got
    assert jaccard_join.ngram_jaccard_components(edge.limit(0)).count() == 0
    same = spark.createDataFrame([(k, "a b c d e f g") for k in range(50)], "doc_id long, text string")
    assert [r.doc_id for r in jaccard_join.keep_one_of_each(same).collect()] == [0]


# ------------------------------------------------------------------ 3
def test_media_round_trip(spark, docs):
    for df, texts in ((docs, [(r.doc_id, r.text) for r in docs.collect()]),):
        want = {}
        for i, t in texts:
            b = (t or "").encode()
            p = b + bytes(-len(b) % 64 or (0 if b else 64))
            want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_columns(df).collect()}
        assert got == want


def test_media_edges_and_splits(spark, edge, tmp_path):
    got = media.media_columns(edge).collect()
    assert len(got) == len(EDGE) and all(r.error is None for r in got)
    assert len({r.feature for r in got if r.doc_id == 3}) == 1 and {r.payload_bytes for r in got if r.doc_id in (1, 2)} == {64}
    assert media.media_columns(edge.limit(0)).count() == 0
    folder = f"file://{tmp_path}/m"
    manifest = media.write_archives(edge.repartition(2), folder)
    split = media.read_archives(spark, folder, manifest, splitBytes=100)
    assert split.count() == len(EDGE) and split.rdd.getNumPartitions() > 3
    assert media.read_archives(spark, folder, splitBytes=100).count() == len(EDGE)
    damaged = spark.createDataFrame([(1, 3, bytearray(b"nothing"), None)], "doc_id long, n_bytes long, media binary, error string")
    bad = media.media_features(damaged).first()
    assert bad.payload_sha256 is None and bad.error


def test_media_retries():
    class Flaky:
        def __init__(self, fail):
            self.fail = fail

        def open_input_file(self, path):
            import io

            if self.fail:
                self.fail -= 1
                raise OSError("lost")
            return io.BytesIO(b"abcdef")

    reader = media.ArchiveReader({"path": "x", "retries": "2"})
    assert reader._member(Flaky(2), "p", None, 2, 3)[0] == b"cde"
    assert reader._member(Flaky(3), "p", None, 2, 3)[2] == "lost"
    assert reader._member(Flaky(0), "p", None, 5, 3)[2]
    assert reader._member(Flaky(0), "p", None, 2, 3, zlib.crc32(b"cde"))[0] == b"cde"
    assert "checksum" in reader._member(Flaky(0), "p", None, 2, 3, 1)[2]


# ------------------------------------------------------------------ 4
def full_shingles(x):
    x = x.lower()
    return {x[k : k + 5] for k in range(max(1, len(x) - 4))}


def similar_lines(a, b):
    a, b = full_shingles(a), full_shingles(b)
    return 100 * len(a & b) >= 80 * len(a | b)


def test_lines_are_compared_at_every_place(spark, docs):
    long = "".join(f"{k * 7919 % 1000:03d}ab" for k in range(60))
    odd = ["https://example.com/a", "https://elsewhere.org/b", "Andththwhes.", "Andththwhwh.", "col\tone\t1\tx", "col\tone\t2\tyyyyyyyy", "今日はとても良い天気ですね明日も晴れるでしょう", "今日はとても良い本を読みました昨日は雨でした", "😀😁😂🤣😃😄", "😀😁😂🤣😅😆", "abc", "abd", long, "x" + long, long.replace("ab", "cd")]
    texts = [(k, x) for k, x in enumerate(odd)] + [(1000 + r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lines = [(i, k, x) for i, t in sorted(texts) for k, x in enumerate(t.split("\n")) if re.search(WORD, x)]
    names = sorted({x for _, _, x in lines})
    sets = {x: full_shingles(x) for x in names}
    links = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and similar_lines(a, b)]
    top, seen, want = union(names, links), set(), {}
    for i, k, x in lines:
        want[i, k] = top[x] not in seen
        seen.add(top[x])
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_components(df).collect()}
    assert got.keys() == want.keys()
    assert {i: got[i, 0] for i in range(len(odd))} == {i: i != 13 for i in range(len(odd))}
    assert not any(want[k] and not got[k] for k in want)
    assert sum(got[k] != want[k] for k in want) <= 0.01 * sum(not v for v in want.values())


def test_lines_of_a_hot_band_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    rng = np.random.default_rng(6)
    # Nothing but the lines' own letters differs: all share one band, and pairs are planted among them.
    lines = ["".join(chr(97 + c) for c in rng.integers(0, 26, 60)) for _ in range(300)]
    lines += [x[:30] + "-" + x[31:] for x in lines[::10]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    signed = line_dedup.signatures

    def one_band(x):
        return signed(x).withColumn("bands", F.array(F.lit(1).cast("long")))

    monkeypatch.setattr(line_dedup, "signatures", one_band)
    got = {r.doc_id for r in line_dedup.line_components(rows).where("not kept").select("doc_id").collect()}
    assert got == set(range(300, 330)) and all(similar_lines(lines[10 * k], lines[300 + k]) for k in range(30))


def test_lines_are_compared_with_one_centre_first(spark, monkeypatch):
    """Near copies of a line share bands with many centres; those that one comparison joins aren't compared again."""
    real, compared = line_dedup._similar, []

    def count(pairs, *args):
        compared.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(line_dedup, "_similar", count)
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base, lines = [word() for _ in range(40)], []
    for _ in range(150):
        w = list(base)
        w[int(rng.integers(0, 40))] = word()
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = [r.doc_id for r in line_dedup.line_components(df).where("kept").collect()]
    assert kept == [0] and sum(compared) < 1.3 * len(lines), compared


def test_lines_that_bitmaps_tell_apart_are_not_compared(spark, monkeypatch):
    """Copies of a line that are similar to it hardly and to each other not share many bands; few of their pairs are verified."""
    real, compared = line_dedup._similar, []

    def count(pairs, *args):
        compared.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(line_dedup, "_similar", count)
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base, lines = [word() for _ in range(60)], []
    for _ in range(120):
        w = list(base)
        for k in rng.permutation(60)[:4]:
            w[int(k)] = word()
        lines.append(" ".join(w))
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if similar_lines(lines[a], lines[b])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.line_components(df).where("kept").collect()}
    print("COMPARED", compared, len(links), len(kept))
    assert kept == set(union(range(120), links).values())
    assert sum(compared) < 0.2 * 120 * 119 / 2, compared


def test_pairs_across_components_of_a_band_are_found_once(spark, monkeypatch):
    """The component of a band's centre meets the others only, in one pass; lines that are like some of its lines but not like the
    centre join it, and so do unlike components that only another line connects."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    lines = [[word() for _ in range(60)] for _ in range(6)]
    for k in range(6):
        line = list(lines[k])
        for i in range(12):  # a chain that leaves its first line
            line = list(line)
            line[4 * i] = word()
            lines.append(line)
    texts = [" ".join(w) for w in lines]
    texts += [texts[0]] * 3
    signed, across, calls = line_dedup.signatures, line_dedup._across, []
    monkeypatch.setattr(line_dedup, "signatures", lambda x: signed(x).withColumn("bands", F.array(F.lit(1).cast("long"))))

    def counted(*args):
        calls.append(across(*args))
        return calls[-1]

    monkeypatch.setattr(line_dedup, "_across", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.line_components(df).where("kept").collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b] or similar_lines(texts[a], texts[b])]
    assert kept == set(union(range(len(texts)), links).values()) == set(range(6))
    assert len(calls) == 1


def test_bitmaps_of_lines_tell_no_similar_pair_apart():
    rng = np.random.default_rng(7)
    lines = ["a", "AB", "aaaaaaaaa", "aaaaaa", "今日はとても良い天気ですね"]
    for _ in range(60):
        x = "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(6, 3000))))
        k = len(x) // 2
        lines += [x, x[:k] + "#" + x[k:], x[:k] + "#" + x[k + 1 :] + "%"]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(lines)), pa.int64()), "line": lines})
    (got,) = [pa.Table.from_batches(list(line_dedup._mapped([batch])))]
    n, maps = got.column("n").to_pylist(), np.stack([got.column(f"m{k}").to_numpy() for k in range(line_dedup.MAP)], axis=1)
    sets = [full_shingles(x) for x in lines]
    assert n == [len(x) for x in sets]
    for a, b in itertools.combinations(range(len(lines)), 2):
        unlike = sum(int(x).bit_count() for x in (maps[a] ^ maps[b]).view(np.uint64))
        assert unlike <= len(sets[a] ^ sets[b])


@pytest.mark.parametrize("shared", [22, 0])
def test_line_dedup_finds_planted_pairs_and_no_others(spark, shared):
    """Pairs of a similarity from 0.8 on, among lines that share a template of so many of 30 words."""
    rng = np.random.default_rng(shared)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    template, lines, similar = [word() for _ in range(30)], [], 0
    places = rng.permutation(30)[shared:]
    for _ in range(700):
        own = list(template)
        for k in places:
            own[k] = word()
        other = list(own)
        for k in rng.permutation(30)[: int(rng.integers(1, 3))]:
            other[k] = word()
        lines += [" ".join(own), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    of = {r.doc_id: r.component for r in line_dedup.line_components(df).collect()}
    pairs = [(k, k + 1) for k in range(0, len(lines), 2) if similar_lines(lines[k], lines[k + 1])]
    assert len(pairs) > 300 and sum(of[a] == of[b] for a, b in pairs) >= 0.98 * len(pairs)
    # Precision: what is removed is similar to another line of its component.
    groups = collections.defaultdict(list)
    for i, c in of.items():
        groups[c].append(i)
    for g in groups.values():
        assert len(g) == 1 or all(any(similar_lines(lines[i], lines[j]) for j in g if i != j) for i in g)


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    a, b = "the first line of all\nonly here and nowhere else", "quite another text\nthe first line of all"
    rows = [(5, a), (5, b), (5, b), (None, "a line without an id"), (None, "quite another text\nand more of it"), (9, "the first line of all\n\nkept line of nine")]
    kept = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((str(r.doc_id), r.text) for r in kept)
    # A null doc_id comes first; of doc 5 the row whose text has the smaller hash; equal rows are one document.
    assert [t for i, t in texts if i == "None"] == ["a line without an id", "quite another text\nand more of it"]
    assert [t for i, t in texts if i == "9"] == ["\nkept line of nine"]
    five = [t for i, t in texts if i == "5"]
    assert sum("only here and nowhere else" in t for t in five) == 1 and sum("the first line of all" in t for t in five) in (1, 2) and not any("quite another" in t for t in five)
    every = sorted(line for _, t in texts for line in t.split("\n") if line)
    assert set(every) == {"a line without an id", "quite another text", "and more of it", "the first line of all", "only here and nowhere else", "kept line of nine"}


def test_line_edges(spark, edge):
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.line_report(edge).collect()}
    assert got == {1: (0, 0), 2: (0, 0), None: (1, 1), 3: (4, 2), 4: (1, 1), 5: (0, 0)}
    assert line_dedup.line_report(edge.limit(0)).count() == 0
    kept = line_dedup.without_repeated_lines(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "4", "5", "None"]


# ------------------------------------------------------------------ 5
def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, letters, base in ((1, 1, 0), (9, 1, 0), (40, 2, 0), (300, 1, 7), (300, 2, 97), (700, 4, 0)):
        t = (base + rng.integers(0, letters, n)).astype(np.uint8)
        b = t.tobytes()
        sa, _ = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        common = lambda x, y: next(k for k in range(n + 1) if x + k >= n or y + k >= n or b[x + k] != b[y + k])
        assert suffix_dedup.common_prefixes(t, sa).tolist() == [0] + [common(x, y) for x, y in zip(sa, sa[1:])]


def repeats_model(rows, length=100):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) != (i, s):
                gone |= set(range(s, s + length))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split", [4096, 0.001])
def test_suffix_dedup_equals_brute_force(spark, docs, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_BLOCKS", split)
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rows += [(1000 + k, "ab" * int(rng.integers(40, 90)) + "é" * 30 + rows[k][1][50 : 50 + int(rng.integers(90, 240))]) for k in range(12)]
    rows += [(2000, "q" * 700), (2001, "ab " * 300), (2002, ("ab " * 300)[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()} == repeats_model(rows)


@pytest.mark.parametrize("split", [4096, 0.00001])
def test_suffix_dedup_of_rows_that_share_a_doc_id(spark, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_BLOCKS", split)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    a, b, shared = word(150), word(160), word(140)
    rows = [(1, a + shared), (2, b + shared), (2, shared + word(50)), (2, b + shared), (3, a), (None, shared)]
    got = collections.defaultdict(list)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    # Doc 1 is first; of doc 2's rows each loses what is in doc 1, and equal rows lose the same; doc 3 is all in doc 1.
    assert got[1] == [(290, 0, 0)] and got[3] == [(150, 150, 1)] and got[None] == [(140, 0, 0)]
    assert sorted(got[2]) == [(190, 140, 1), (300, 140, 1), (300, 140, 1)]


def test_strings_are_searched_by_their_bytes():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, 600).astype(np.uint8) * 255
    strings, raw = suffix_dedup.Strings(text, 12), text.tobytes()
    ordered = np.array(sorted(range(588), key=lambda i: raw[i : i + 12]))
    wanted = rng.integers(0, 588, 100)
    keys = [raw[i : i + 12] for i in ordered]
    assert strings.lower(ordered, wanted).tolist() == [bisect.bisect_left(keys, raw[i : i + 12]) for i in wanted]


def test_suffix_edges(spark, edge):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(edge).collect())
    assert got[0] == ("1", 0, 0) and got[1] == ("2", 0, 0) and [x for x in got if x[0] == "4"] == [("4", 21000, 20993)]
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0


# ------------------------------------------------------------------ 6
def test_packing_places_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = packing.pack(docs.repartition(5)).collect()
    have, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        have[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length, p.source))
    for i, x in ids.items():
        assert sum(n for _, n in have[i]) == len(x) and all(a + n == b for (a, n), (b, _) in zip(sorted(have[i]), sorted(have[i])[1:]))
    share = collections.Counter()
    for r in docs.collect():
        share[r.source] += len(ids[r.doc_id])
    total, last = sum(share.values()), max(windows)
    assert sorted(windows) == list(range(last + 1))
    for w, x in windows.items():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(x, x[1:]))
        if w < last:
            assert sum(n for _, n, _ in x) == packing.LENGTH
            for s in share:
                assert abs(sum(n for _, n, y in x if y == s) - packing.LENGTH * share[s] / total) < 2


@pytest.mark.parametrize("seed", range(12))
def test_round_robin_equals_the_rounds_one_by_one(seed):
    """Every slot is taken once, and each window's part of a queue is its quantum in exact fractions, less than two tokens off."""
    rng = np.random.default_rng(seed)
    totals = [int(x) for x in rng.integers(1, 400, int(rng.integers(1, 6)))]
    weights = [int(x) for x in rng.integers(1, 6, len(totals))] if seed % 3 else totals
    length, have = int(rng.choice([7, 16, 64])), collections.Counter()
    rounds, slots = packing.RoundRobin(totals, weights, length), []
    for q, total in enumerate(totals):
        place = 0
        while place < total:
            n, done = min(int(rng.integers(1, 60)), total - place), 0
            for start, size, window, offset in (packing.RoundRobin(totals, weights, length) if rng.random() < 0.3 else rounds).pieces(q, place, n):
                assert start == done and size > 0
                slots += range(window * length + offset, window * length + offset + size)
                have[window, q] += size
                done += size
            assert done == n
            place += n
    assert sorted(slots) == list(range(sum(totals)))
    sent = [Fraction(0)] * len(totals)
    for window in range(-(-sum(totals) // length)):
        need, got = Fraction(min(length, sum(totals) - window * length)), [Fraction(0)] * len(totals)
        while need > 0:
            open_ = [k for k in range(len(totals)) if sent[k] + got[k] < totals[k]]
            share = sum(weights[k] for k in open_)
            step = min([need] + [(totals[k] - sent[k] - got[k]) * share / Fraction(weights[k]) for k in open_])
            for k in open_:
                got[k] += step * Fraction(weights[k], share)
            need -= step
        assert all(abs(have[window, k] - got[k]) < 2 for k in range(len(totals)))
        sent = [a + b for a, b in zip(sent, got)]


def test_packing_follows_target_weights(spark, docs):
    small = docs.where("source in ('src1', 'src2', 'src3')")
    pieces = packing.pack(small.repartition(3), weights={"src1": 1, "src2": 2.5, "src3": 0.5}).collect()
    total = collections.Counter()
    for p in pieces:
        total[p.source] += p.length
    by_window = collections.defaultdict(collections.Counter)
    for p in pieces:
        by_window[p.sequence_id][p.source] += p.length
    # While all queues last every window has the weights' proportions.
    open_until = min(int(total[s] * 4 / w) for s, w in (("src1", 1), ("src2", 2.5), ("src3", 0.5))) // packing.LENGTH
    for w in range(open_until):
        assert all(abs(by_window[w][s] - packing.LENGTH * x / 4) < 2 for s, x in (("src1", 1), ("src2", 2.5), ("src3", 0.5)))
    assert all(sum(c.values()) == packing.LENGTH for w, c in by_window.items() if w < max(by_window))
    with pytest.raises(ValueError):
        packing.pack(small, weights={"src1": 1})


def test_packing_edges(spark, edge):
    got = packing.pack(edge).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.doc_tokens < 9 and r.start == 0) == [("1", 1), ("2", 1), ("3", 7), ("3", 7), ("5", 1), ("None", 6)]
    assert packing.pack(edge.limit(0)).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    encode, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in ["", " á  b\tc\r\n d", "İI ß 12,3 <|endoftext|>x", "a b c\x1cd e'll", "日本 語 ́x", "a§b § c§", "§", "End. end, END.. x's. Y., 5. J̌ J̌. <|EndOfText|>. É. Σ. .", "ΣΑΣ É́."]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_takes_plain_words_past_the_rules(spark):
    """Words of small letters, digits and marks go to the tokenizer's model by pieces, with the same ids as the whole tokenizer's."""
    from tokenizers import Tokenizer

    encode, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("text").collect()
    words = {w.encode() for r in docs for w in r.text.replace("\n", " ").split(" ")} | {"a<|endoftext|>".encode(), b"<<|x", b"<", b"a<b", b"x'd", b"a\tb", b"~~", b"1a2", "ñ́".encode(), "÷".encode(), "ªº".encode()}
    words |= {chr(c).encode() for c in range(33, 0x250)} | {f"a{chr(c)}b{chr(c)}".encode() for c in range(33, 0x250)}
    calls, real = [], encode._ids
    encode._ids = lambda text: calls.append(text) or real(text)
    encode._learn(set(words) - {b""})
    for w in words:
        assert np.frombuffer(encode.known[w], "<u4").tolist() == tokenizer.encode(w.decode(), add_special_tokens=False).ids, w
    encode.all([b"plain words only, 12 of them. \xc3\xa9t\xc3\xa9!! a@b.c (x)"])
    seen = len(calls)
    encode.all([b"others, quite new: 345 tralala-lala \xc3\xa9t\xc3\xa9s?"])
    assert len(calls) == seen


# ------------------------------------------------------------------ 7
def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: re.findall(WORD, lower(r.text)) + [None] for r in docs.collect()}
    c = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    total, known = sum(c.values()), len(c)
    got = language_model.score(docs).collect()
    assert len(got) == len(words)
    for r in got:
        x = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + known + 1)) for w in x))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert held and gain > 0.2


def test_language_model_is_normalised_and_learns_by_its_gradient():
    rng = np.random.default_rng(0)
    rows, n = 64, 300
    model = language_model.Maxent(rng.normal(0, 1, (language_model.LEVELS, language_model.KINDS, rows, language_model.WAYS)).astype(np.float32))
    contexts, leaf = rng.integers(0, 1 << 62, (language_model.KINDS, n)).astype(np.uint64), rng.integers(0, language_model.LEAVES, n)
    total = np.zeros(n)
    for level in range(language_model.LEVELS):
        f = language_model.features_of(contexts, leaf, level, rows)
        p = model.probabilities(level, f)
        assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
        for t in range(0, n, 37):  # by plain loops
            z = [sum(float(model.w[level, k, f[k, t], c]) for k in range(language_model.KINDS)) for c in range(language_model.WAYS)]
            y = leaf[t] // language_model.WAYS ** (language_model.LEVELS - 1 - level) % language_model.WAYS
            assert p[t, y] == pytest.approx(math.exp(z[y]) / sum(map(math.exp, z)), rel=1e-3)
        total += np.log10(p[np.arange(n), language_model.outcome(leaf, level)])
    assert np.allclose(model.log10(contexts, leaf), total, atol=1e-4)
    # A leaf's path is its own, and steps over the same tokens make them likelier.
    paths = np.stack([language_model.outcome(np.arange(language_model.LEAVES), k) for k in range(language_model.LEVELS)])
    assert len(np.unique(paths, axis=1).T) == language_model.LEAVES
    power, before = np.zeros_like(model.w), total.mean()
    for _ in range(5):
        model.learn(contexts, leaf, power)
    assert model.log10(contexts, leaf).mean() > before + 0.3


def test_language_model_steps_equal_sums_by_row_and_are_cheap():
    rng = np.random.default_rng(2)
    n, rows, ways = 4 * language_model.BATCH, language_model.ROWS, language_model.WAYS
    contexts, leaf = rng.integers(0, 900, (language_model.KINDS, n)).astype(np.uint64), rng.integers(0, language_model.LEAVES, n)
    fast, plain = language_model.Maxent(rows=rows), np.zeros((language_model.LEVELS, language_model.KINDS, rows, ways), np.float32)
    power, sums, slow = np.zeros_like(plain), np.zeros_like(plain), 0.0
    start = time.process_time()
    fast.learn(contexts, leaf, power)
    quick = time.process_time() - start
    start = time.process_time()
    for i in range(0, n, language_model.BATCH):
        x, y = contexts[:, i : i + language_model.BATCH], leaf[i : i + language_model.BATCH]
        for level in range(language_model.LEVELS):
            f = language_model.features_of(x, y, level, rows)
            z = sum(plain[level, k][f[k]] for k in range(language_model.KINDS))
            g = np.exp(z - z.max(axis=1, keepdims=True))
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), language_model.outcome(y, level)] -= 1
            for k in range(language_model.KINDS):
                by = np.argsort(f[k], kind="stable")
                row, first = np.unique(f[k][by], return_index=True)
                d = np.add.reduceat(g[by], first, axis=0)
                sums[level, k][row] += d * d
                plain[level, k][row] -= language_model.RATE * d / np.sqrt(sums[level, k][row] + 1.0)
    slow = time.process_time() - start
    assert np.allclose(fast.w, plain, atol=1e-4) and np.allclose(power, sums, rtol=1e-3, atol=1e-3)
    assert quick < 0.85 * slow, (quick, slow)


def test_language_model_steps_cost_less_than_flat_sums():
    """A step of the same sums by one flat index over all outcomes, as they were before, takes longer; the sums are the same."""
    rng = np.random.default_rng(3)
    n, rows, ways = 16 * language_model.BATCH, language_model.ROWS, language_model.WAYS
    contexts, leaf = rng.integers(0, 900, (language_model.KINDS, n)).astype(np.uint64), rng.integers(0, language_model.LEAVES, n)
    contexts[0] = 0

    def flat(model, power):
        for i in range(0, n, language_model.BATCH):
            x, y = contexts[:, i : i + language_model.BATCH], leaf[i : i + language_model.BATCH]
            for level in range(language_model.LEVELS):
                f = language_model.features_of(x, y, level, rows)
                g = model.probabilities(level, f)
                g[np.arange(len(y)), language_model.outcome(y, level)] -= 1
                weights = g.reshape(-1).astype(np.float64)
                for k in range(language_model.KINDS):
                    has = np.bincount(f[k], minlength=rows) > 0
                    row, place = np.flatnonzero(has), np.cumsum(has) - 1
                    at = (place[f[k]] * ways)[:, None] + np.arange(ways)
                    d = np.bincount(at.reshape(-1), weights, minlength=len(row) * ways).reshape(-1, ways).astype(np.float32)
                    power[level, k][row] += d * d
                    model.w[level, k][row] -= language_model.RATE * d / np.sqrt(power[level, k][row] + 1.0)

    took = {}
    for name, learn in (("now", lambda m, p: m.learn(contexts, leaf, p)), ("flat", flat)):
        took[name] = 1e9
        for _ in range(3):
            model, power = language_model.Maxent(rows=rows), np.zeros((language_model.LEVELS, language_model.KINDS, rows, ways), np.float32)
            start = time.process_time()
            learn(model, power)
            took[name] = min(took[name], time.process_time() - start)
        took[f"{name} weights"] = model.w
    assert np.allclose(took["now weights"], took["flat weights"], atol=1e-4)
    assert took["now"] < 0.9 * took["flat"], took


def test_language_model_scores_equal_brute_force(spark):
    """score by plain counts and the trained network's own probabilities."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen = {}
    real = language_model.train

    def keep(texts, size):
        seen["model"] = real(texts, size)
        return seen["model"]

    language_model.train = keep
    try:
        got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        language_model.train = real
    count, leaf_of, parts = collections.Counter(), {}, {}
    for i, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        h, tail, doc = language_model.tokens_of(raw, np.array([0, len(raw)]))
        leaf = language_model.leaves_of(h, tail)
        leaf_of |= dict(zip(h.tolist(), leaf.tolist()))
        parts[i] = (h.tolist(), leaf, language_model.contexts_of(h, tail, doc))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(h.tolist())
    tokens, words = collections.Counter(), collections.Counter()
    for w, n in count.items():
        tokens[leaf_of[w]] += n
        words[leaf_of[w]] += 1
    for i, (h, leaf, contexts) in parts.items():
        within = sum(math.log10((count[w] + 1) / (tokens[k] + words[k] + 1)) for w, k in zip(h, leaf.tolist()))
        assert got[i] == pytest.approx(seen["model"].log10(contexts, leaf).sum() + within, rel=1e-5)


def test_language_model_edges(spark, edge):
    got = {str(r.doc_id): (r.n_tokens, r.held_out) for r in language_model.score(edge).collect()}
    assert got["1"] == (1, True) and got["2"] == (1, False) and got["None"] == (6, False) and got["4"] == (9001, zlib.crc32(b"4") % 7 == 2)
    assert language_model.score(edge.limit(0)).count() == 0


# ------------------------------------------------------------------ 8
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got, want = mixing.mix(spark.read.parquet(path)).toPandas(), con.sql(mixing.ORACLE).df()
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all()


def test_mixing_edges(spark, edge):
    got = {str(r.doc_id): (r["size"], r.taken) for r in mixing.mix(edge).collect()}
    assert got["1"] == (0, 0) and got["2"] == (0, 0) and got["5"] == (0, 0) and got["None"][0] == 5
    assert all(t <= 3 * s for s, t in got.values())
    assert mixing.mix(edge.limit(0)).count() == 0 and mixing.mixed(edge).columns == edge.columns


def test_mixing_of_rows_that_share_a_doc_id(spark):
    rows = [(1, "a b c", "s"), (1, "d e f g", "s"), (1, "d e f g", "t"), (None, "h i", "s"), (None, "j", "t"), (2, "k l", "t"), (2, "k l", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("clash"))
    n = collections.Counter((r.doc_id, r["size"], r.copies) for r in mixing.mix(df).collect())
    assert sum(n.values()) == len(rows)
    out = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(df).collect())
    assert set(out) <= set(rows) and mixing.mixed(df).columns == df.columns
    taken = sum(r.taken for r in mixing.mix(df).collect())
    assert abs(taken - sum(len(t.split()) for _, t, _ in rows)) <= 8


# ------------------------------------------------------------------ 9
def quality_model(t):
    t = t or ""
    w, seen, again = re.findall(WORD, t), set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_quality_counts(spark, docs, edge):
    for df in (docs, edge):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.judge(df, quality.LineField()).collect():
            n = quality_model(texts[r.doc_id])
            assert tuple(r)[1:6] == n and r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert quality.judge(edge.limit(0), quality.LineField()).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    field = quality.LineField(rng.normal(0, 1, (quality.FEATURES, 2)), rng.normal(0, 1, (2, 2)))
    sizes = [0, 1, 5, 3, 7, 0]
    of = np.repeat(np.arange(len(sizes)), sizes)
    f = rng.normal(0, 1, (len(of), quality.FEATURES))
    labels, s = field.viterbi(f, of, len(sizes)), f @ field.emit
    value = lambda at, y: sum(s[k, z] for k, z in zip(at, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
    for d, n in enumerate(sizes):
        at = np.flatnonzero(of == d)
        best = max((tuple(int(c) for c in f"{x:0{n}b}") for x in range(2**n)), key=lambda y: value(at, y)) if n else ()
        assert tuple(labels[at]) == best


def test_field_gradient_equals_brute_force():
    rng = np.random.default_rng(2)
    size, field = np.array([4, 3, 1]), quality.LineField(rng.normal(0, 1, (quality.FEATURES, 2)), rng.normal(0, 1, (2, 2)))
    x, y = rng.normal(0, 1, (3, 4, quality.FEATURES)), rng.integers(0, 2, (3, 4))

    def likelihood():
        total = 0
        for k, n in enumerate(size):
            s = x[k, :n] @ field.emit
            value = lambda z: sum(s[t, c] for t, c in enumerate(z)) + sum(field.move[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            every = [value(z) for z in itertools.product((0, 1), repeat=int(n))]
            total += value(y[k, :n]) - math.log(sum(map(math.exp, every)))
        return total

    have, emit, move = field.gradient(x, y, size)
    assert have == pytest.approx(likelihood())
    for w, g in ((field.emit, emit), (field.move, move)):
        for at in np.ndindex(w.shape):
            keep = w[at]
            w[at] = keep + 1e-6
            up = likelihood()
            w[at] = keep - 1e-6
            down = likelihood()
            w[at] = keep
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_quality_marks_lines_of_mixed_documents(spark):
    """Clean documents, junk ones that begin with clean lines, and texts of both: shares lie between, by their lines."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, labels)
    assert field.move[0, 0] > field.move[0, 1] and field.move[1, 1] > field.move[1, 0]
    clean = [f"This is a plain sentence number {k} about quite ordinary things, and it ends well." for k in range(40)]
    junk = [" ".join(f"word{k}{j}{'***' if j % 2 else '&&&'} $$$ ###" for j in range(8)) + " %%%" for k in range(40)]
    texts = {1: clean[:20], 2: junk[:20], 3: clean[:10] + junk[:10], 4: clean[:5] + junk[:5] + clean[5:15]}
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    for r in quality.judge(rows, field).collect():
        want = sum(len(x) for x in texts[r.doc_id] if x in clean) / sum(map(len, texts[r.doc_id]))
        assert r.content_share == pytest.approx(want, abs=0.12), r.doc_id


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert quality.fit(docs, labels.limit(0)).emit.any() == 0


# ------------------------------------------------------------------ 10
def test_language_id(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {str(r.doc_id): (r.lang_pred, r.score) for r in language_id.identify(edge).collect()}
    assert all(odd[k] == ("und", 0) for k in ("1", "2", "5"))
    assert language_id.identify(edge.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}


def slow_forward(network, window):
    """One window by plain loops."""
    x = [[float(v) for v in network.p["e"][b]] for b in window]
    h = []
    for w in language_id.WIDTHS:
        for f in range(language_id.FILTERS):
            best = max(sum(x[t + i][e] * float(network.p[f"w{w}"][i * language_id.EMBED + e, f]) for i in range(w) for e in range(language_id.EMBED)) for t in range(len(x) - w + 1))
            h.append(max(best + float(network.p[f"b{w}"][f]), 0))
    z = [sum(v * float(network.p["o"][k, c]) for k, v in enumerate(h)) + float(network.p["ob"][c]) for c in range(len(network.langs))]
    top = max(z)
    return [math.exp(v - top) / sum(math.exp(u - top) for u in z) for v in z]


def test_network_equals_plain_loops_and_its_gradient_the_differences():
    rng = np.random.default_rng(3)
    network = language_id.Network(["a", "b", "c"])
    win = rng.integers(0, 256, (4, 20)).astype(np.uint8)
    assert np.allclose(network.forward(win), [slow_forward(network, w) for w in win], atol=1e-4)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    y = np.array([0, 1, 2, 1])
    loss = lambda: -np.log(network.forward(win)[np.arange(4), y]).mean()
    g = network.gradients(win, y)
    for name, value in network.p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in value.shape) if name != "e" else (int(win[rng.integers(0, 4), rng.integers(0, 20)]), int(rng.integers(0, language_id.EMBED)))
            keep, step = value[at], 1e-6
            value[at] = keep + step
            up = loss()
            value[at] = keep - step
            down = loss()
            value[at] = keep
            assert (up - down) / (2 * step) == pytest.approx(g[name][at], abs=1e-5)


def test_language_of_many_languages_and_rows(spark):
    rows = [(k, f"{chr(0x4E00 + k % 300)}{chr(0x4E00 + k % 300)} text", f"l{k % 300:03d}") for k in range(600)]
    network = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(network.langs) == len({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}) > 256
    odd = spark.createDataFrame([(None, "word", None, 1), (1, "12", "en", 2), (1, "word", "en", 3), (1, None, "en", 4)], "doc_id long, text string, lang string, c0 int")
    assert [tuple(r) for r in language_id.with_language(odd).orderBy("c0").collect()] == [(None, "word", None, 1), (1, "word", "en", 3)]
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.with_language(none).count() == 2 and language_id.with_language(none.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, one doc_id with unlike texts, a very long text and columns of clashing names."""
    long = " ".join(f"word{k * 7919 % 99991}" for k in range(300_000))
    rows = [(1, None, "a", "en", 0), (None, "text without an id", None, None, 1), (2, "same words again", "a", "en", 2), (2, "same words again", "a", "en", 3), (2, "unlike words of another row", "a", "en", 4), (3, long, "b", None, 5), (4, "12 34", "b", "en", 6), (None, None, None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, node long").withColumn("row", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    out = df
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, df.limit(0), SF)
        assert empty.count() == 0 and (name == "packed" or empty.columns == df.columns)
        out = stage(spark, out, SF)
        if name in ("language", "lines", "near_duplicates"):
            assert sorted(r.node for r in out.collect()) == [1, 2, 3, 4, 5]
    assert {r.doc_id for r in out.collect()} <= {None, 2, 3}


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, docs):
    rows, before = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF)
        rows = rows.cache()
        if name != "packed":
            assert rows.columns == docs.columns
        if name == "language":
            assert rows.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
        if name == "near_duplicates":
            model = jaccard_model([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in rows.collect()) == sorted(i for i, (_, c) in model.items() if c == i)
        if name == "mixture":
            n = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter({i: k for i, k in n.items() if k})
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == rows.agg(F.sum("length")).first()[0]
