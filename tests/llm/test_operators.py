"""The operators against plain versions, on rows with nulls, empty and long texts, ties and copies."""

import hashlib
import itertools
import math
import os
import random
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402

from tokenmill.llm import exact_dedup, hmm, jaccard, licenses, mixing, packing, quality, suffixes, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, `class` string"
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice(["the", "of", "Idea", "rain", "über", "x1", "stone", "|", "a", "blue", "green", "red"]) + rng.choice("abcd") for _ in range(n)]


def sample():
    rng = random.Random(5)
    base = [words(rng, n) for n in (60, 60, 90, 5, 3, 1, 40, 2500)]
    texts = [" ".join(b) for b in base]
    for b in base[:3]:
        for k in range(8):  # near copies, one or two words changed
            c = list(b)
            for _ in range(rng.choice([1, 1, 2, 5])):
                c[rng.randrange(len(c))] = f"edit{k}"
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].replace(" ", "\n "), texts[2].upper(), None, "", " \t\n", None]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[7], ids[9] = None, ids[8], ids[10]
    return [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), 1, "r", "n", "c") for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark):
    from tokenmill.llm.common import stage

    return stage(spark.createDataFrame(sample(), SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def none_last(x):
    return (x is None, x or 0)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(docs, empty, bits):
    rows = exact_dedup.exact_groups(docs, block_bytes=16, hash_bits=bits).collect()
    norm = [" ".join(x for x in [brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]) for _, t, *_ in sample()]
    groups = {}
    for (i, *_), n in zip(sample(), norm):
        groups.setdefault(n, []).append(i)
    want = Counter((i, min(groups[n], key=none_last), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, *_), n in zip(sample(), norm))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups) == exact_dedup.drop_exact_copies(docs).count()
    assert exact_dedup.exact_groups(empty).count() == 0


def sets_of(rows, width):
    out = []
    for _, t, *_ in rows:
        w = brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    return out


@pytest.mark.parametrize("few,width,percent", [(100, 4, 85), (1, 4, 85), (3, 5, 80)])
def test_jaccard(docs, empty, few, width, percent):
    rows = jaccard.near_groups(docs, jaccard.Join(width, percent), few=few).collect()
    sets, ids = sets_of(sample(), width), [r[0] for r in sample()]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    parts = {}
    for i, r in enumerate(root):
        parts.setdefault(r, []).append(ids[i])
    want = Counter((ids[i], len(sets[i]), min(parts[r], key=none_last)) for i, r in enumerate(root))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert sum(r.kept for r in rows) == len(parts)
    assert jaccard.near_groups(empty).count() == 0


def test_repeats(docs, empty):
    rows = [(i if i is not None else 10**9, t) for i, t, *_ in sample()]
    got = [(r.doc_id if r.doc_id is not None else 10**9, *r[1:]) for r in suffixes.remove_repeats(docs).collect()]
    assert Counter(got) == Counter(brute.repeats(rows))
    assert suffixes.remove_repeats(empty).count() == 0


def test_repeats_of_a_common_phrase(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    phrase = "The quick brown fox jumps over the lazy dog."
    fixed = [word() + " " + phrase + " " + word() + " " + word() for _ in range(4)]
    rows = [(i, " ".join([word(), word(), phrase if i % 3 else fixed[i % 4], word(), word(), word(), word()])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from tokenmill.llm.common import stage

    docs = stage(docs, "test-phrase")
    want = Counter(brute.repeats(rows))
    assert sum(r[2] for r in want) > 0
    for most in (1, 5, 10**6):
        assert Counter(tuple(r) for r in suffixes.remove_repeats(docs, most=most).collect()) == want


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_shared_kmers(cut):
    pa = suffixes.pa
    rng = random.Random(cut)
    for _ in range(50):
        rows = sorted((rng.randrange(12), r, rng.choice([(), (), (), (r + 100, r + 200)])) for r in range(rng.randrange(1, 30)))
        table = pa.RecordBatch.from_pydict({
            "kmer": pa.array([x for x, *_ in rows], pa.int64()), "row": pa.array([r for _, r, _ in rows], pa.int64()),
            "others": pa.array([suffixes.np.array(o, "int64").tobytes() if o else None for *_, o in rows], pa.binary())})
        batches = [table.slice(i, cut) for i in range(0, len(rows), cut)]
        got = Counter((r["kmer"], r["row"]) for b in suffixes._shared(batches) for r in b.to_pylist())
        every = Counter((x, y) for x, r, o in rows for y in (r, *o))
        per = Counter(x for x, _ in every)
        assert got == Counter({p: n for p, n in every.items() if per[p[0]] > 1})


@pytest.mark.parametrize("frequent", [0, 3, 30])
def test_repeats_of_frequent_surroundings(spark, docs, frequent):
    """Whether masks meet their rows by a join or are sent to them, the rows are the same."""
    rng = random.Random(9)
    line = "This line stands in every text, and more than once in some of them, word for word."
    rows = [(i, "\n".join([str(rng.random()) * 3, line, *[line] * (i % 3 == 0), str(rng.random())])) for i in range(60)]
    from tokenmill.llm.common import stage

    lines = stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-lines")
    want = Counter(brute.repeats(rows))
    assert sum(r[2] for r in want) > 59 * len(line)
    assert Counter(tuple(r) for r in suffixes.remove_repeats(lines, frequent=frequent).collect()) == want
    rows = [(i if i is not None else 10**9, t) for i, t, *_ in sample()]
    got = [(r.doc_id if r.doc_id is not None else 10**9, *r[1:]) for r in suffixes.remove_repeats(docs, frequent=frequent).collect()]
    assert Counter(got) == Counter(brute.repeats(rows))


def test_repeats_leave_no_shuffles(spark):
    """What the steps have written takes the place of their shuffles, which are gone when the result is asked for."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(9)) for _ in range(300))) for i in range(200)]
    from tokenmill.llm.common import stage

    docs = stage(spark.createDataFrame(rows + [(i + 1000, t) for i, t in rows], "doc_id long, text string").repartition(3), "test-freed")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f: os.path.getsize(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f and os.path.exists(f)}

    before = files()
    suffixes.remove_repeats(docs)
    for _ in range(50):
        left = sum(n for f, n in files().items() if f not in before)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert left < 20_000 < sum(len(t) for _, t in rows) / 10


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_minimizers(monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(block)
    common = bytes(rng.choice(b"abc ") for _ in range(120))
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 3, 200)] + [b"x" * 90, common, b"", b"y" + common[30:100]]
    raw, offsets = suffixes.np.frombuffer(b"".join(texts), "uint8"), suffixes.np.cumsum([0, *map(len, texts)])
    places, h = suffixes.minimizers(raw, offsets, 50, 24)
    assert sorted(set(places.tolist())) == places.tolist()
    found = {}
    for i, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        inside = [p for p in places.tolist() if a <= p and p + 24 <= z]
        for p in range(a, z - 49):  # each string has one, at the same place wherever it stands
            assert any(p <= q <= p + 26 for q in inside)
        found[i] = {q - a for q in inside}
    assert sum(len(x) for x in found.values()) == len(places)
    assert found[5] == set(range(41))  # of equal ones the first
    assert {q - 29 for q in found[6]} & found[8] and len({raw[p : p + 24].tobytes() for p in places}) == len(set(h.tolist()))
    alone = suffixes.minimizers(raw[offsets[6] : offsets[7]], offsets[6:8] - offsets[6], 50, 24)[0]
    assert set(alone.tolist()) == found[6]


@pytest.mark.parametrize("cut", [1, 5, 10**6])
def test_packed_kmers(cut):
    pa = suffixes.pa
    rng = random.Random(cut)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((0, 60, 300)))) for _ in range(60)]
    texts += texts[:20]
    row = [i * 5000 + 7 for i in range(len(texts))]  # further from the first than 16 bits say
    batches = [pa.RecordBatch.from_pydict({"row": pa.array(row[i : i + 30], pa.int64()), "text": texts[i : i + 30]}) for i in range(0, len(texts), 30)]
    table = pa.Table.from_batches(list(suffixes._kmers(iter(batches), 50, 24))).sort_by("part").combine_chunks()
    got = [r for b in suffixes._sorted(table.to_batches(cut)) for r in b.to_pylist()]
    want = Counter()
    for r, t in zip(row, texts):
        raw = suffixes.np.frombuffer(t.encode(), "uint8")
        h = suffixes.minimizers(raw, suffixes.np.array([0, len(raw)]), 50, 24)[1]
        want.update({(x >> (64 - suffixes.PART_BITS - suffixes.KMER_BITS), r) for x in h.tolist()})
    assert Counter((x["kmer"], x["row"]) for x in got) == want
    assert [x["kmer"] for x in got] == sorted(x["kmer"] for x in got)


def test_repeated_surroundings():
    rng = random.Random(4)
    for _ in range(300):
        k, width = 3, 8
        texts, at = [], []
        for _ in range(rng.randrange(2, 7)):
            left, right = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randrange(6), 5))
            texts.append((left + "xyx" + right).encode())
            at.append(len(left))
        first = [rng.randrange(4) for _ in texts]
        masks = suffixes.repeated(texts, at, first, width, k)
        for t, p, f, mask in zip(texts, at, first, masks):
            for o in range(max(0, p - width + k), min(p, len(t) - width) + 1):  # strings that hold the k-mer
                s = t[o : o + width]
                earlier = any(g < f and u[q - p + o : q - p + o + width] == s for u, q, g in zip(texts, at, first) if q >= p - o)
                assert (mask >> o & 1) == earlier


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(50))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_packing(spark, docs, empty):
    rows = packing.pack_documents(docs, length=128).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in sample():
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, n in enumerate(([len(ids) % 128] if len(ids) % 128 else []) + [128] * (len(ids) // 128)):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.15 * math.ceil(sum(r.length for r in rows) / 128) + 1
    assert packing.pack_documents(empty).count() == 0


def test_encoding_in_pieces():
    texts = ["a <|endoftext|> b  c  d \n e\t f  g 'll x's  　 z", "", " ", "  lead", "trail  ", "a\u0085 b été 1 2 345", "a b a b", "b a"]
    data = [t.encode() for t in texts]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, first = packing.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]), packing.ranks_file())
    assert [ids[a:z].tolist() for a, z in zip(first, first[1:])] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_mixing(docs, empty):
    rows = mixing.taken_words(docs, block_words=4).collect()
    size = [len(brute.WORD.findall(t or "")) for _, t, *_ in sample()]
    assert sorted(r.size for r in rows) == sorted(size)
    per = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        got = per.setdefault(r.source_size, [r.target, 0])
        got[1] += r.taken
    assert math.isclose(sum(t for t, _ in per.values()), 1.5 * sum(size), rel_tol=1e-9)
    assert all(abs(taken - target) <= 8 for target, taken in per.values())
    assert Counter(rows) == Counter(mixing.taken_words(docs, block_words=4).collect())
    whole = mixing.mixed_documents(docs, block_words=4)
    assert whole.columns == docs.columns
    assert sum(len(brute.WORD.findall(r.text)) for r in whole.collect()) == sum(r.taken for r in rows)
    assert mixing.taken_words(empty).count() == 0


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_quality(docs, empty):
    rows = quality.judge(docs).collect()
    want = Counter()
    for i, t, *_ in sample():
        w = brute.WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert quality.judge(empty).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(3)
    word = lambda n=5: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    text = lambda n: " ".join(word() for _ in range(n))

    def repeating(n):  # n words of 200, in one passage that stands twice
        passage = text(n // 2)
        return f"{text(100)} {passage} {text(100 - n)} {passage}"

    rows, want = [], {}
    for lang, source in (("en", "s1"), ("de", "s2")):
        rows += [(len(rows) + k, "\n".join(text(10) for _ in range(20)), lang, source) for k in range(150)]
        for rule, t in (("mean_chars", " ".join(word(9) for _ in range(200))), ("symbol_share", " ".join(word(4) + rng.choice("aa#") for _ in range(200))),
                        ("dup_line_share", "\n".join([text(10), "ab cde fghij"][k % 4 == 0] for k in range(40))), ("repeat_share", repeating(40))):
            want[len(rows)] = rule
            rows.append((len(rows), t, lang, source))
    # a group so even in its spread that its fence lies beyond what the base rules let pass
    rows += [(len(rows) + k, repeating(2 * (k % 16 + 4)), "fr", "s3") for k in range(160)]
    want[len(rows)] = "repeat_share"
    rows.append((len(rows), repeating(58), "fr", "s3"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id: r.broken_rule for r in got if not r.kept} == want


def test_hmm_base_and_forward(docs, empty):
    rows = hmm.score_texts(docs, rounds=2, classes=10).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [brute.WORD.findall(lower(t)) + [None] for _, t, *_ in sample()]
    c = Counter(w for (i, *_), ws in zip(sample(), tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((none_last(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
                  for (i, *_), ws in zip(sample(), tokens))
    assert sorted((none_last(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert hmm.score_texts(empty).count() == 0
    rng = np.random.default_rng(0)
    first, step, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 4, 3)
    seq = [0, 3, 1, 2]
    plain = sum(first[s[0]] * emit[s[0], seq[0]] * math.prod(step[s[t - 1], s[t]] * emit[s[t], seq[t]] for t in range(1, 4))
                for s in itertools.product(range(3), repeat=4))
    scale = hmm._forward(np.array(seq), np.arange(5), first, step, emit)[2]
    assert math.isclose(math.prod(scale), plain)


def test_hmm_beats_words(spark):
    rows = hmm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_toxicity(spark, empty):
    d = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    model = toxicity.fit(texts, labels.filter("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    test = toxicity.severities(texts, model).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert np.mean([r.toxic == bool(r.label) for r in test]) > 0.95
    assert toxicity.without_toxic(texts, model).columns == texts.columns
    assert toxicity.fit(texts, labels.limit(0)) is None and not toxicity.severities(texts, None).filter("toxic").count()
    assert toxicity.severities(empty, model).count() == 0


def test_licenses(spark, empty):
    mit = licenses.SENTENCES
    full = f"code here.\n{mit['mit-grant']}\n{mit['mit-notice']}.\n\n{mit['as-is']}. More words."
    rows = [(1, full), (2, "x. Licensed under the Apache License, Version 2.0. y"), (3, mit["mit-notice"] + ". " + mit["mit-grant"]), (4, None), (5, ""),
            (6, "Released under the MIT License.\nReleased under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.first_sentence, r.n_sentences) for r in got) == [
        (1, "MIT", 1, 3), (2, "Apache-2.0", 1, 1), (6, "MIT", 0, 1), (6, "MIT", 1, 1)]
    assert licenses.scan(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL = """%s program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2001, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADS = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California and its contributors.
"""
NAMES = """
%d. Neither the name of the copyright
   holder nor the names of its contributors may be used to endorse or promote
   products derived from this software without specific prior written permission.
"""


def test_licenses_wrapped(spark, empty):
    gpl2, gpl3 = GPL % ("This", ";", ";", 2), GPL % ("This", ":", ",", 3)
    comment = lambda sign, text, end="\n": end.join(f"{sign} {x}".rstrip() for x in text.split("\n"))
    texts = [MIT, comment("//", MIT), comment(" *", MIT, "\r\n"), gpl3, comment("#", gpl3), comment("dnl", "x\n" + gpl2), BSD, BSD + NAMES % 3,
             comment("--", BSD + ADS + NAMES % 4), "Permission is hereby granted, free of charge,\n\nto any person", "rain\nLicensed under CC BY 4.0\nrain",
             'Licensed under the Apache\nLicense, Version 2.0 (the\n"License"); you may not', "rain Licensed under CC BY 4.0\nLicensed under CC\n\nBY 4.0"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.n_sentences) for r in got) == [
        (0, "MIT", 3), (1, "MIT", 3), (2, "MIT", 3), (3, "GPL-3.0-or-later", 2), (4, "GPL-3.0-or-later", 2), (5, "GPL-2.0-or-later", 2),
        (6, "BSD-2-Clause", 3), (6, "proprietary", 1), (7, "BSD-3-Clause", 4), (7, "proprietary", 1), (8, "BSD-4-Clause", 5), (8, "proprietary", 1),
        (10, "CC-BY-4.0", 1), (11, "Apache-2.0", 1)]
    assert licenses.scan(empty).count() == 0
    # each known sentence in lines of three words
    flat = {n: s.replace("{}", "Some One") + "." for n, s in licenses.SENTENCES.items()}
    for n, s in flat.items():
        w = s.split(" ")
        flat[n] = "\n".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3))
    every = [(k, flat[n]) for k, n in enumerate(flat)]
    got = licenses.scan(spark.createDataFrame(every, "doc_id long, text string"), rules=[(n, (n,)) for n in flat]).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(flat))


def test_warc(spark, tmp_path):
    long = "<p>é" + "z" * 1200
    pages = [(1, "http://a/ b\n", long), (5, None, long), (5, "u", long), (2, "u", "short"), (7, "u", "short"), (None, "u", long), (9, "u", None), (-3, "u", "")]
    pages += [(100 + i, f"http://x/{i}", f"<html>page {i} " + "text of the page " * 20) for i in range(60)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.error is None for r in got) and len(got) == len(pages)
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 5 if i == 1 else None) for i, _, h in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_errors():
    good = warc.record(3, "u", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    assert warc.parse(good[:-1])["error"] == "wrong Content-Length"
    assert warc.parse(good.replace(b"payload\r", b"payl0ad\r"))["error"] == "wrong digest"
    assert warc.parse(good.replace(b"WARC-Date", b"WARC-Dote"))["error"] == "no WARC-Date"
    frame = warc.zstandard.ZstdCompressor().compress(good)
    whole = frame + warc.EMPTY_FRAME + frame
    assert [e for *_, e in warc.frames_of(memoryview(whole))] == [None, None]
    assert [e for *_, e in warc.frames_of(memoryview(whole[:-3]))] == [None, "cut frame"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(SF + "/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        from tokenmill.llm.common import stage as written

        after = written(stage(spark, before, SF), f"test-{name}")
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    assert before.count() > 0
