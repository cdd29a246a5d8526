"""Source divergence, benchmark leaks and periodic runs against plain versions."""

import itertools
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tokenmill.llm import divergence, leaks, runs  # noqa: E402
from tokenmill.llm.common import stage  # noqa: E402
from tokenmill.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, row string, `group` string, term string, window string, words string, runs string"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TOKENS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows():
    rng = random.Random(11)
    vocabulary = ["The", "the", "rain,", "rain", "Über", "über-rain", "x1y", "(stone)", "stone", "🙂", "a", "42", "--", "don't", "Ünder", "of"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "the the\nthe", "a" * 3000, "stone " * 2000, texts[0], texts[0], "x\x0bY z \x1f the"]
    ids = list(range(len(texts)))
    ids[3], ids[5], ids[6] = None, ids[7], ids[7]
    clash = ("r", "g", "t", "w", "o", "n")
    return [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None]), *clash) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return stage(spark.createDataFrame(rows(), SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------------------------- divergence
def plain_counts(table):
    counts, docs_of = Counter(), defaultdict(set)
    for number, (_, text, lang, source, *_rest) in enumerate(table):
        for t in LETTERS.findall(lowered(text)):
            counts[lang or "", source or "", t] += 1
            docs_of[lang or "", source or "", t].add(number)
    return counts, docs_of


def plain_divergences(table, least=3, ranks=200):
    counts, docs_of = plain_counts(table)
    groups = sorted({(r[2] or "", r[3] or "") for r in table})
    df = Counter()
    for (lang, _, t), d in docs_of.items():
        df[lang, t] += len(d)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        sources = [s for x, s in groups if x == lang]
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + 10**9 * (c + 1) // (sum(own.values()) + len(kept)) for t, c in own.items()} for s, own in n.items()}
        for s in sources:
            pairs = [(o, sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (share[s][t] - share[None][t]) ** 2 // share[None][t]) for t in kept if n[s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("block,span", [(24 << 20, 8), (1, 1)])
def test_term_counts(docs, monkeypatch, block, span):
    monkeypatch.setattr(divergence, "BLOCK", block)  # each slice a block of its own
    monkeypatch.setattr(divergence, "SLICE", 300 if block == 1 else 2 << 20)
    monkeypatch.setattr(divergence, "SPAN", span)
    counts, docs_of = plain_counts(rows())
    got = {(r.lang, r.source, r.term): (r.n_docs, r.n) for r in divergence.term_counts(docs).collect()}
    assert got == {k: (len(docs_of[k]), n) for k, n in counts.items()}


@pytest.mark.parametrize("least,ranks,pairs", [(3, 200, 1 << 20), (1, 2, 3), (50, 5, 1 << 20)])
def test_divergences(docs, monkeypatch, least, ranks, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)  # sums are handed on early
    got = sorted(tuple(r) for r in divergence.divergences(docs, least_docs=least, ranks=ranks).collect())
    assert got == plain_divergences(rows(), least, ranks)


def test_divergences_of_nothing(docs, none):
    assert divergence.divergences(none).count() == 0 and divergence.term_counts(none).count() == 0
    assert {tuple(r)[2:5] for r in divergence.divergences(docs.where("text IS NULL OR text = ''")).collect()} <= {("pair", s, 0) for s in ("", "s1", "s2", "s3")}


def test_lists_of_numbers():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 31, 62)])
    at = np.array([0, 0, 3, 200, 300])
    back, first = divergence.unpack(divergence.pack(values, at))
    assert back.tolist() == values.tolist() and first.tolist() == at.tolist()
    assert divergence._share(np.array([10**15]), np.array([3 * 10**15])).tolist() == [1 + 10**9 * (10**15 + 1) // (3 * 10**15)]


# ------------------------------------------------------------------------------------------- leaks
def plain_leaks(table, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = TOKENS.findall(lowered(text))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in table:
        w, hit, found = TOKENS.findall(lowered(text)), set(), set()
        for size, i in itertools.product(sizes, range(len(w))):
            part = tuple(w[i : i + size])
            if len(part) == size and part in windows:
                hit.update(range(i, i + size))
                found |= windows[part]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def items():
    table = rows()
    passage = " ".join(TOKENS.findall(lowered(table[1][1]))[2:30])
    return [(1, passage.upper()), (2, "Stone, stone"), (2, "over"), (3, None), (4, " -- "), (None, "don't"), (5, passage), (6, "stone " * 12),
            (7, "these words are in no document at all, not one of them"), (10, "x1y")]


@pytest.mark.parametrize("small,width,window", [(1_000_000, 3, 10), (1, 3, 10), (1_000_000, 1, 4), (1_000_000, 5, 3)])
def test_leaks(spark, docs, small, width, window):
    benchmark = spark.createDataFrame([(*x, "e") for x in items()], "item_id long, text string, window string")
    got = leaks.find_leaks(docs, benchmark, width=width, window=window, small=small).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_leaks(rows(), items(), window)
    assert sum(r.n_hit > 0 for r in got) > 5


def test_leaks_of_nothing(spark, docs, none):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    assert leaks.find_leaks(none, benchmark).count() == 0
    got = leaks.find_leaks(docs, benchmark.where("false")).collect()
    assert len(got) == len(rows()) and not any(r.n_hit or r.item_ids for r in got)
    left = leaks.without_leaks(docs, benchmark)
    bad = {r[0] for r in plain_leaks(rows(), items()) if r[2]}
    assert left.columns == docs.columns and left.count() == sum(r[0] not in bad for r in rows())


@needs_tables
def test_leaks_need_no_python(spark):
    text = QUERIES["op12_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


# -------------------------------------------------------------------------------------------- runs
def run_texts():
    rng, out = random.Random(1), []
    for k in range(300):
        unit = [rng.choice("abcdef") for _ in range(rng.randrange(1, 40))]
        w = [[rng.choice("ab") for _ in range(rng.randrange(0, 150))], unit * rng.randrange(1, 7), ["a"] * rng.randrange(0, 200),
             unit * 4 + unit[:3] * 9 + unit * 3][k % 4]
        if w and k % 3 == 0:
            w[rng.randrange(len(w))] = "z"
        out.append(" ".join(w))
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    return [*out, " ".join(b), None, "", " \n", "x " * 5000, "Über  über\n" * 30, "a" * 5000]


def test_runs(spark):
    texts = run_texts()
    df = spark.createDataFrame([(None if i == 5 else i % 290, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = runs.periodic_runs(df).collect()
    want = []
    for i, t in enumerate(texts):
        words = brute.WORD.findall(t or "")
        found = brute.runs(words)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        want.append((None if i == 5 else i % 290, len(words), found, " ".join(w for j, w in enumerate(words) if j not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert any(len(r.runs) > 1 for r in got)
    assert runs.periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, times=2)


def test_string_ids_and_other_bounds(spark):
    df = spark.createDataFrame([("x", "a b " * 30), ("y", "a b c d e f g " * 4)], "doc_id string, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(df, least=40, times=4).collect()}
    assert got == {"x": [(0, 60, 2)], "y": []}


def test_zero_shifts_are_exact():
    rng = np.random.default_rng(2)
    for b, largest in ((8, 3), (32, 40_000), (256, 1 << 20)):
        block = rng.integers(1, largest + 1, (20, b))
        window = rng.integers(1, largest + 1, (20, 2 * b))
        for i in range(20):
            window[i, i % b : i % b + b] = block[i]
            window[i, i % b] += i % 3  # off by one or two in one place
        want = np.array([[(window[i, d : d + b] == block[i]).all() for d in range(b)] for i in range(20)])
        assert (runs.zero_shifts(block, window, largest + 2) == want).all() and want.any()


def test_windows_of_long_distances(monkeypatch):
    monkeypatch.setattr(runs, "LARGEST", 16)  # distances above are searched window by window
    words = (list(range(1, 141)) * 4)[:500]
    first = np.array([0, 500])
    number, further = runs._numbered(np.array(words, np.uint64), first)
    found = runs.seeds(number, further, first)
    assert runs.extended(number, 0, 500, found) == brute.runs(words) == [(0, 500, 140)]


@needs_tables
def test_runs_query_matches_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op13_runs"](spark, SF).select(columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.run_row(r.doc_id, r.text) for r in table)
    assert sum(r.n_runs > 0 for r in got) > len(got) // 30
