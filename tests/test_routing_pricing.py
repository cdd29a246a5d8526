import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokenmill.functions import scalars
from tokenmill.operators import changes, pricing, quality, routing

RULE = ("id long, intent string, provider string, model string, url string, weight int, fallback_provider string, "
        "fallback_model string, fallback_url string")


def rules_of(spark, *rows):
    return spark.createDataFrame([(i, n, "p", m, "u", w, "fp", fb, "fu") for i, n, m, w, fb in rows], RULE)


def requests_of(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, intent string, requested_model string, allowed_rules array<long>")


def routes(spark, rules, *rows):
    out = routing.route(requests_of(spark, *rows), rules).collect()
    return {r.request_id: (r.routed_by, r.rule.model if r.rule else None) for r in out}


@pytest.mark.parametrize("weights,want", [((100, 0), "m1"), ((0, 100), "m2"), ((0, 0), "m1")])
def test_weights(spark, weights, want):
    rules = rules_of(spark, (1, "code", "m1", weights[0], None), (2, "code", "m2", weights[1], None))
    got = routes(spark, rules, *[(i, "code", "x", None) for i in range(50)])
    assert {v for v in got.values()} == {("intent", want)}


def test_weights_share(spark):
    rules = rules_of(spark, (1, "code", "m1", 70, None), (2, "code", "m2", None, None))
    got = routes(spark, rules, *[(i, "code", "x", None) for i in range(3000)])
    assert abs(sum(m == "m1" for _, m in got.values()) / 3000 - 70 / 170) < 0.05


def test_code_beats_requested_model(spark):
    rules = rules_of(spark, (1, "code", "c", 100, None), (2, "general", "g", 100, "fb"), (3, "support", "s", 100, None))
    got = routes(spark, rules, (1, "code", "s", None), (2, "support", "g", None), (3, "support", "fb", None),
                 (4, "support", "none", None), (5, "unknown", "none", None), (6, "support", "s", [2]),
                 (7, "code", "x", []), (8, "support", "c", [1]))
    assert got == {1: ("intent", "c"), 2: ("model", "g"), 3: ("model", "g"), 4: ("intent", "s"), 5: ("intent", "g"),
                   6: ("intent", "g"), 7: ("refused", None), 8: ("model", "c")}


def test_no_rules_at_all(spark):
    assert routes(spark, rules_of(spark, (1, "code", "c", 1, None)), (1, "support", "x", [])) == {1: ("intent", "gpt-4o-mini")}


def test_failover(spark):
    rules = rules_of(spark, (1, "code", "c", 1, "fb"), (2, "general", "g", 1, None))
    routed = routing.route(requests_of(spark, (1, "code", "x", None), (2, "code", "x", None), (3, "general", "x", None)), rules)
    outcomes = spark.createDataFrame([(1, True, "down"), (2, False, None), (3, True, "down")], "request_id long, failed boolean, error string")
    out = routing.failover(routed, outcomes)
    assert {r.request_id: (r.status, r.final_model, r.final_url) for r in out.collect()} == {
        1: ("failed_over", "fb", "fu"), 2: ("ok", "c", "u"), 3: ("failed", "g", "u")}
    assert [(r.request_id, r.primary_model, r.fallback_model) for r in routing.failover_alerts(out).collect()] == [(1, "c", "fb")]


def test_models_per_key(spark):
    rules = rules_of(spark, (1, "code", "claude-x", 1, "gemini-y"), (2, "general", "gpt", 1, None))
    keys = spark.createDataFrame([(1, None), (2, [2]), (3, []), (4, [9])], "id long, allowed_rules array<long>")
    got = {}
    for r in routing.models_per_key(keys, rules).collect():
        got.setdefault(r.id, {})[r.model] = r.owned_by
    assert got[1] == {"claude-x": "anthropic", "gemini-y": "google", "gpt": "openai"} and got[2] == {"gpt": "openai"}
    assert set(got[3]) == set(got[4]) == {"gpt-4o-mini", "gemini-1.5-flash", "claude-3-5-sonnet-20240620"}


def test_prices(spark):
    prices = spark.createDataFrame([("exact", "0.001", "0.002")], "model_name string, i string, o string").select(
        "model_name", F.col("i").cast(scalars.MONEY).alias("input_price_per_token"), F.col("o").cast(scalars.MONEY).alias("output_price_per_token"))
    rows = spark.createDataFrame([("exact", "p", "u"), ("claude-3-5-sonnet-latest", None, None), ("openai/gpt-4o-mini-x", "p", "u"),
                                  ("unknown", "p", "u"), ("exact", "ollama", "u"), ("exact", "p", "http://ollama:1/v1")],
                                 "model string, provider string, url string")
    out = pricing.price_lookup(rows, prices, provider="provider", url="url").collect()
    assert [(float(r.rate_in), float(r.rate_out), r.price_source) for r in out] == [
        (0.001, 0.002, "exact"), (3e-6, 1.5e-5, "listed"), (1.5e-7, 6e-7, "listed"), (2e-6, 1e-5, "generic"), (0, 0, "local"), (0, 0, "local")]


def test_upsert_last_writer_wins(spark):
    row = "seq long, model_name string, input_price decimal(18,12), output_price decimal(18,12)"
    feed = spark.createDataFrame([(0, "google/gemini-flash-1.5", Decimal(1), Decimal(1)), (1, "google/gemini-1.5-flash", Decimal(2), Decimal(2))], row)
    base = spark.createDataFrame([("gemini-1.5-flash", "x", Decimal(9), Decimal(9)), ("old", "x", Decimal(5), Decimal(5))],
                                 "model_name string, provider string, input_price decimal(18,12), output_price decimal(18,12)")
    got = {r.model_name: (float(r.input_price), r.provider, r.inserted) for r in pricing.price_upsert(base, feed).collect()}
    assert got == {"google/gemini-flash-1.5": (1, "google", True), "google/gemini-1.5-flash": (2, "google", True),
                   "gemini-1.5-flash": (2, "google", False), "gemini-flash-1.5": (2, "google", True), "old": (5, "x", False)}


def test_model_names(spark):
    df = spark.createDataFrame([("gemma2",), ("gemma2:2b",), ("ns/name",), ("ns/name:v1:x",)], "n string")
    got = [tuple(r) for r in df.select(scalars.model_path(F.col("n")), scalars.model_tag(F.col("n"))).collect()]
    assert got == [("library/gemma2", "latest"), ("library/gemma2", "2b"), ("ns/name", "latest"), ("ns/name", "v1:x")]


@pytest.mark.parametrize("name,label", [
    (None, ""), ("semantic-cache", "cache"), ("claude-3-5-sonnet-20240620", "claude-3.5"), ("gpt-4o-mini", "gpt-4o-m"),
    ("gemini-1.5-flash-latest", "gemini-1.5-f"), ("a-very-long-model-name", "a-very-long…"), ("phi3:latest", "phi3"),
])
def test_labels(spark, name, label):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(scalars.model_label(F.col("n")).alias("l")).first().l == label


def test_messages_and_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("o")).first().o
    low = one(scalars.low_budget_text(F.lit("k"), F.lit("1234.5").cast("decimal(12,4)"), F.lit("20000").cast("decimal(12,4)")))
    assert "`$1,234.5000`" in low and "`$20,000.0000`" in low and low.startswith("⚠️ *Gateway Alert")
    assert "• **API Key**: `k`" in one(scalars.double_bold(F.lit(low)))
    assert one(scalars.with_scheme(F.lit(" host/x "))) == "http://host/x" and one(scalars.with_scheme(F.lit("HTTPS://h"))) == "HTTPS://h"
    assert [one(scalars.finish_reason(F.lit(x).cast("string"))) for x in ("end_turn", "max_tokens", "tool_use", None)] == ["stop", "length", "tool_use", "stop"]
    assert one(scalars.passes_score(F.lit(2.0))) is True and one(scalars.passes_score(F.lit(0.0))) is False
    assert one(scalars.provider_of(F.lit("a/b/c"))) == "a" and one(scalars.provider_of(F.lit("abc"))) == "unknown"
    assert one(scalars.ttl_seconds(F.lit("code"))) == 604800 and one(scalars.ttl_seconds(F.lit(None).cast("string"))) == 86400
    assert one(scalars.threshold_band(F.lit(0.12))).startswith("Very strict") and one(scalars.threshold_band(F.lit(0.33))).startswith("Very tolerant")


def test_local_models(spark):
    from tokenmill.operators import metrics

    gb = 1024**3
    df = spark.createDataFrame([("a", [(gb,), (gb // 2,)]), ("b", [(20 * gb,)]), ("c", [(16 * gb,)])], "name string, layers array<struct<size:long>>")
    assert [(r.name, r.size, r.over_limit) for r in metrics.local_model_sizes(df).collect()] == [
        ("a", "1.5 GB", False), ("b", "20.0 GB", True), ("c", "16.0 GB", False)]
    wanted = spark.createDataFrame([("phi3",), ("phi3:mini",), ("gemma",)], "name string")
    there = spark.createDataFrame([("phi3:latest",), ("gemma:2b",)], "name string")
    assert [r.name for r in metrics.installed_models(wanted, there).collect()] == ["phi3"]


def test_empty_summary(spark):
    from tokenmill.operators import metrics
    from tokenmill.sources.tables import TOKEN_LOGS

    assert tuple(metrics.summary_metrics(spark.createDataFrame([], TOKEN_LOGS)).first()) == (0, 0, 0, 0, 0.0, 0)


def test_changes_keep_pairs_unique(spark):
    base = spark.createDataFrame([(1, "a", "m"), (2, "a", "n"), (3, "b", "m")], "id long, intent string, model string")
    edits = spark.createDataFrame([(1, 2, "upsert", "a", "x"), (2, 2, "upsert", "a", "m"), (3, 3, "delete", None, None), (4, 4, "upsert", "c", "z")],
                                  "change_id long, id long, op string, intent string, model string")
    assert {r.id: r.model for r in changes.apply_changes(base, edits, "id").collect()} == {1: "m", 2: "m", 4: "z"}
    assert {r.id: r.model for r in changes.rule_change_apply(base, edits).collect()} == {1: "m", 2: "x", 4: "z"}


def plain_walk(base, edits):
    state = {i: (a, m) for i, a, m in base}
    for _, i, op, a, m in edits:
        if op == "delete":
            state.pop(i, None)
        elif a is None or not any(p == (a, m) and k != i for k, p in state.items()):
            state[i] = (a, m)
    return state


@pytest.mark.parametrize("most", [1_000_000, 40, 0])  # by intents; by pairs, what is larger in rounds; all in rounds
def test_rule_changes_match_a_walk(spark, most):
    rnd = random.Random(5)
    base = [(i, "ab"[i % 2], f"m{i % 5}") for i in range(8)]  # pairs held twice stay
    edits = [(n, rnd.randrange(14), rnd.choice(["upsert", "upsert", "delete"]), rnd.choice(["a", "b", None]), f"m{rnd.randrange(7)}") for n in range(300)]
    # rules and pairs that meet no others, in small groups
    edits += [(n, 100 + rnd.randrange(12), rnd.choice(["upsert", "delete"]), "c", f"n{rnd.randrange(12)}") for n in range(300, 330)]
    got = changes.rule_change_apply(spark.createDataFrame(base, "id long, intent string, model string"),
                                    spark.createDataFrame(edits, "change_id long, id long, op string, intent string, model string"), most)
    assert {r.id: (r.intent, r.model) for r in got.collect()} == plain_walk(base, edits)


def test_a_chain_of_changes_is_one_walk(spark, monkeypatch):
    base = [(i, "a", f"m{i}") for i in range(1000)]
    # each rule wants the place of the next one, which only the last one leaves; then the same backwards
    edits = [(n, n, "upsert", "a", f"m{n + 1}") for n in range(1000)] + [(2000 - n, n, "upsert", "a", f"m{n + 2}") for n in range(999)]
    edits.sort()
    monkeypatch.setattr(changes, "_in_rounds", None)  # would fail if it were asked
    got = changes.rule_change_apply(spark.createDataFrame(base, "id long, intent string, model string"),
                                    spark.createDataFrame(edits, "change_id long, id long, op string, intent string, model string"))
    assert {r.id: (r.intent, r.model) for r in got.collect()} == plain_walk(base, edits)


def test_a_large_group_takes_few_rounds(spark, monkeypatch):
    base = [(i, "a", f"m{i}") for i in range(1000)]
    # the chains of above: verdicts that hang on each other, a thousand deep
    edits = sorted([(n, n, "upsert", "a", f"m{n + 1}") for n in range(1000)] + [(3000 - n, n, "upsert", "a", f"m{n + 2}") for n in range(999)])
    written, stage = [], changes.stage
    monkeypatch.setattr(changes, "stage", lambda df, name: written.append(name) or stage(df, name))
    got = changes.rule_change_apply(spark.createDataFrame(base, "id long, intent string, model string"),
                                    spark.createDataFrame(edits, "change_id long, id long, op string, intent string, model string"), 500)
    assert {r.id: (r.intent, r.model) for r in got.collect()} == plain_walk(base, edits)
    assert written.count("round") == 4 and len(written) < 12


def test_cache_replay_matches_a_walk(spark):
    from tokenmill.operators.cache import cache_replay

    rnd = random.Random(8)
    rows = [(i, f"2024-01-{1 + rnd.randrange(28):02d} {rnd.randrange(24):02d}:00:00", k := rnd.choice("aaab"), "support" if k == "a" else "code",
             rnd.random() < 0.1, rnd.random() < 0.6) for i in range(400)]
    saved, want = {}, {}
    for i, ts, k, intent, bypass, answered in sorted(rows, key=lambda r: (r[1], r[0])):
        t = datetime.fromisoformat(ts).timestamp()
        want[i] = not bypass and k in saved and t < saved[k] + (14_400 if k == "a" else 604_800)
        if bypass:
            saved.pop(k, None)
        if answered and not want[i]:
            saved[k] = t
    df = spark.createDataFrame(rows, "request_id long, ts string, cache_key string, intent string, bypass boolean, answered boolean")
    assert {r.request_id: r.hit for r in cache_replay(df).collect()} == want and any(want.values())


def test_quality(spark):
    df = spark.createDataFrame([(1, "method", 0.5, "full"), (2, "rtk", 1.5, "max")], "id long, method string, ratio double, caveman_intensity string")
    got = sorted(tuple(r) for r in quality.validate_rows(df, "id", quality.compressor_checks()).collect())
    assert got == [(1, "method values"), (2, "caveman_intensity values"), (2, "ratio range")]
    alerts = spark.createDataFrame([(1, None), (2, "other"), (3, "failover")], "id long, type string")
    assert sorted(tuple(r) for r in quality.validate_rows(alerts, "id", quality.alert_checks()).collect()) == [(1, "type required"), (2, "type values")]
    phrase = spark.createDataFrame([(1, "ollama", " "), (2, "x", "m")], "id long, provider string, model string")
    assert sorted(tuple(r) for r in quality.validate_rows(phrase, "id", quality.rephrase_checks()).collect()) == [(1, "model required"), (2, "provider values")]
