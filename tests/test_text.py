"""Text rules on literal rows."""

import math
import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tokenmill.functions import text
from tokenmill.operators.compression import compress, compression_gate

LOG = "\x1b[31mError:\x1b[0m compilation failed.\n[=====>    ] 50%\n" + "\n".join(["Connection timeout."] * 3)
HELLO = "Hello! Please explain the quantum computing for me."


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def squash(spark, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.o for r in text.compress_log_text(df, "t", "o").orderBy("i").collect()]


def slow_collapse(value):
    """The line rules over runs of indices, as a check of the array form."""
    noisy = lambda t: t.startswith("Resolved ") or (t.startswith("test ") and t.endswith(" ... ok"))
    lines = [t for t in value.splitlines() if not noisy(t)]
    runs = [list(g) for _, g in groupby((i for i, t in enumerate(lines) if t.strip()), key=lines.__getitem__)]
    next_head = [r[0] for r in runs[1:]] + [len(lines)]
    note = {at: f"... [repeated {len(r) - 1} more times] ..." for r, at in zip(runs, next_head) if len(r) > 1}
    again = {i for r in runs for i in r[1:]}
    pieces = [([note[i]] if i in note else []) + lines[i:i + 1] * (i not in again) for i in range(len(lines) + 1)]
    return "\n".join(sum(pieces, []))


def test_log_text(spark):
    assert squash(spark, LOG) == ["Error: compilation failed.\nConnection timeout.\n... [repeated 2 more times] ..."]


@pytest.mark.parametrize("seed", range(3))
def test_collapse_matches_a_walk(spark, seed):
    import random

    rnd = random.Random(seed)
    pool = ["a", "a", "b", "", "  ", "Resolved x", "test t ... ok", "c"]
    values = ["".join(rnd.choice(pool) + rnd.choice(["\n", "\r\n", " ", "\n"]) for _ in range(rnd.randint(0, 14)))
              for _ in range(60)] + ["", "\n", "a", "a\n\na", "Resolved x", "x\n\n\nx\n\ny"]
    assert squash(spark, *values) == [slow_collapse(v) for v in values]


@pytest.mark.parametrize("level,want", [
    ("lite", "explain the quantum computing for me."),
    ("full", "explain quantum computing for me."),
    ("ultra", "explain quantum computing."),
])
def test_telegraphic(spark, level, want):
    assert one(spark, HELLO, lambda c: text.telegraphic(c, level)) == want


def test_words_next_to_accents_stay(spark):
    assert one(spark, "éa a aé\n\n a-b  x", lambda c: text.telegraphic(c, "full")) == "éa aé\n-b x"


def test_stacked(spark):
    value = "\x1b[33mWarning:\x1b[0m please check the logs for a database error?"
    df = spark.createDataFrame([(1, value)], "doc_id int, text string")
    assert "Warning: check logs for database error?" in compress(df, "stacked", "full").first().compressed_text
    out = compress(df, "stacked", "ultra").first()
    assert "Warning: check logs database error?" in out.compressed_text and out.method == "stacked_ultra"


def test_disabled_and_short(spark):
    df = spark.createDataFrame([(1, "Success! Command executed successfully."), (2, "word " * 40)], "doc_id int, text string")
    off = compress(df, "disabled").orderBy("doc_id").collect()
    assert [r.reason for r in off] == ["Compression disabled"] * 2 and off[0].compressed_text == off[0].text and off[0].ratio == 1.0
    gate = df.orderBy("doc_id").select(compression_gate(F.col("text"), "llmlingua").alias("r")).collect()
    assert [r.r for r in gate] == ["Prompt too short for compression", None]
    assert one(spark, "x", lambda c: compression_gate(c, "llmlingua", model_loaded=False)) == "Compressor not loaded"
    for method in ("llmlingua", "rtk+llmlingua"):
        rows = compress(df, method).orderBy("doc_id").collect()
        assert rows[0].bypassed and rows[0].compressed_text == df.orderBy("doc_id").first().text
        assert len(rows[1].compressed_text.split()) == 28
    with pytest.raises(ValueError):
        compress(df, "zip")


def test_budgeted_keeps_rare_words_and_marks(spark):
    from tokenmill.operators.compression import compress_budgeted

    df = spark.createDataFrame([(1, "the cat sat. the end"), (2, "the dog ran! the way"), (3, "")], "doc_id int, text string")
    rows = {r.doc_id: r for r in compress_budgeted(df, 0.5).collect()}
    assert rows[1].compressed_text == "cat sat ." and rows[1].tokens == 6 and rows[1].kept == 3
    assert rows[2].compressed_text == "dog ran !" and rows[3].compressed_text == ""


@pytest.mark.parametrize("most", [200_000, 0])  # counts at every task; all by the join
def test_budgeted_makes_no_row_of_a_token(spark, monkeypatch, capsys, most):
    from tokenmill.operators import compression

    monkeypatch.setattr(compression, "MAX_HOT_WORDS", most)
    texts = ["b a a.c - x\x85y\u3000z \U0001f600 \U0001f600!", " \n\n a\tb", None, "", "!?", "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = compression.compress_budgeted(df, 0.5)
    out.explain()
    assert "MapInArrow" in (plan := capsys.readouterr().out) and "Window" not in plan and "Generate" not in plan
    counts = Counter(w for t in texts for w in set(re.findall(r"[^\s?!.:\-]+|[\n?!.:\-]", t or "")))
    for r in out.collect():
        words = re.findall(r"[^\s?!.:\-]+|[\n?!.:\-]", texts[r.doc_id] or "")
        forced = [w in "\n?!.:-" for w in words]
        ranked = sorted(range(len(words)), key=lambda i: (0 if forced[i] else counts[words[i]], i))
        kept = sorted(ranked[:max(math.ceil(len(words) * 0.5), sum(forced))])
        assert (r.compressed_text, r.tokens, r.kept) == (" ".join(words[i] for i in kept), len(words), len(kept))


def test_bypass(spark):
    cases = {
        "/nocache Was ist die Hauptstadt der Schweiz?": "Was ist die Hauptstadt der Schweiz?",
        "foo /nocache bar": "foobar",
        "Sag es mir, (Ohne  Cache)!": "Sag es mir, (Ohne  Cache)!",
        "Sag es mir, (ohne cache)!": "Sag es mir",
        "/nocache": "/nocache",
        "cacheless kein cachemanager": "cacheless kein cachemanager",
        "Bitte CACHE NICHT BERÜCKSICHTIGEN - neu": "Bitteneu",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.o for r in df.select("t", text.strip_bypass(F.col("t")).alias("o")).collect()}
    assert got == cases
    hit = {r.t: r.o for r in df.select("t", text.is_bypass(F.col("t")).alias("o")).collect()}
    assert hit["/nocache"] and hit["foo /nocache bar"] and not hit["cacheless kein cachemanager"]


@pytest.mark.parametrize("value,want", [
    ("make an HTML page with bootstrap5", True), ("my gitlab", False), ("use git", True), ("decode this", False),
    ("PostgreSQL tips", True), ("sql-like", True), ("a typescript error", False), ("what is love", False),
])
def test_code_override(spark, value, want):
    assert one(spark, value, text.code_override) is want


def test_signatures(spark):
    assert one(spark, "order 007 of 7, ٣ and 007", text.digit_signature) == ["007", "7", "٣"]
    assert one(spark, "Turn ON, not off; annoying on", text.toggle_signature) == ["not", "off", "on"]
    assert one(spark, "", text.token_estimate) == 1
    assert one(spark, "a b　 c\x1cd", text.token_estimate) == 6
    assert one(spark, "  A\nB\t", text.normalise_prompt) == "a b"
