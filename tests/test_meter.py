"""Order-dependent kernels against plain walks, with hot keys and tiny limits that force every path."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import meter, ordered
from tokenmill.operators.cache import cache_ttl_replay

T0 = 1_700_000_000


def events(seed, keys=3, n=400, span=40_000):
    """Rows where the first key has most of them; times repeat."""
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 6 + [f"k{i}" for i in range(keys)]), T0 + rnd.randrange(span), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, sec long, id long").withColumn("ts", F.timestamp_seconds("sec"))


def walk_greedy(rows, ttl):
    last, fired = {}, set()
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k] + ttl:
            last[k] = t
            fired.add(i)
    return fired


@pytest.mark.parametrize("seed,ttl,limit,span", [
    (1, 600, 50_000, 40_000), (2, 600, 5, 40_000), (3, 37, 5, 9_000), (4, 3600, 0, 40_000), (5, 10, 3, 400), (6, 900, 10, 1_000_000),
])
def test_greedy_ttl(spark, seed, ttl, limit, span):
    rows = events(seed, span=span)
    got = ordered.greedy_ttl(frame(spark, rows), ["key"], "ts", "id", F.lit(ttl), fold_rows=limit)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == walk_greedy(rows, ttl)


@pytest.mark.parametrize("inclusive,hot", [(False, 50), (True, 50), (True, 10**6)])
def test_running_total(spark, monkeypatch, inclusive, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rows = events(7)
    df = frame(spark, rows).withColumn("m", F.col("id") % 7)
    out = ordered.running_total(df, ["key"], ordered.time_slice(F.col("ts"), 500), ["ts", "id"], F.col("m"), "s", inclusive)
    seen, want = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = seen.get(k, 0) + (i % 7 if inclusive else 0)
        seen[k] = seen.get(k, 0) + i % 7
    assert {r.id: r.s for r in out.collect()} == want


@pytest.mark.parametrize("hot", [50, 10**6])
def test_previous_value(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rows = events(8)
    out = ordered.previous_value(frame(spark, rows), ["key"], ordered.time_slice(F.col("ts"), 500), ["ts", "id"], "sec", "p")
    seen, want = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], seen[k] = seen.get(k), t
    assert {r.id: r.p for r in out.collect()} == want


@pytest.mark.parametrize("hot", [20, 10**6])
def test_rate_limit(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rows = [("a", T0 - T0 % 60 + i // 3, i) for i in range(150)] + [("b", T0, 1000)]
    out = meter.rate_limit(frame(spark, rows), "key", row_id="id").collect()
    assert {r.id for r in out if r.limited} == set(range(60, 150))


def keys_of(spark, *rows):
    return spark.createDataFrame(
        [(i, n, Decimal(str(t)), b) for i, n, t, b in rows], "id long, name string, total_budget decimal(12,4), budget_type string")


def test_budget_may_overshoot_once(spark):
    keys = keys_of(spark, (1, "one", "0.0010", "one_time"))
    charges = spark.createDataFrame(
        [("1", T0 + i, i, Decimal("0.0006")) for i in range(4)], "api_key_id string, sec long, request_id long, cost_usd decimal(18,12)"
    ).withColumn("ts", F.timestamp_seconds("sec"))
    rows = {r.request_id: r for r in meter.running_budget(charges, keys).collect()}
    assert [rows[i].refused for i in range(4)] == [False, False, True, True]
    assert rows[1].balance_before == Decimal("0.0004") and rows[1].balance_after == 0
    durable = {r.request_id: r for r in meter.running_budget(charges, keys, mode="durable").collect()}
    assert durable[2].balance_before == Decimal("-0.0002")


def test_sub_cent_charges_are_free_on_the_durable_balance(spark):
    keys = keys_of(spark, (1, "one", "0.0010", "one_time"))
    logs = spark.createDataFrame([("1", Decimal("0.00004"))] * 3, "api_key_id string, cost_usd decimal(18,12)")
    r = meter.key_spend(logs, keys).first()
    assert r.spent == Decimal("0.00012") and r.durable_balance == Decimal("0.0010") and r.live_balance == Decimal("0.00088")


def test_monthly_budget_starts_anew_in_local_time(spark):
    keys = keys_of(spark, (1, "m", "1", "monthly"), (2, "o", "1", "one_time"))
    last_day = 1_706_745_600 - 3600  # 2024-01-31 23:00 UTC, already February in Tokyo
    charges = spark.createDataFrame(
        [(k, t, i, Decimal("0.8")) for i, (k, t) in enumerate([("1", last_day - 86_400), ("1", last_day), ("2", last_day - 86_400), ("2", last_day)])],
        "api_key_id string, sec long, request_id long, cost_usd decimal(18,12)").withColumn("ts", F.timestamp_seconds("sec"))
    out = lambda tz: {r.request_id: float(r.balance_before) for r in meter.running_budget(charges, keys, monthly=True, tz=tz).collect()}
    assert out("Asia/Tokyo") == {0: 1.0, 1: 1.0, 2: 1.0, 3: pytest.approx(0.2)}
    assert out("UTC")[1] == pytest.approx(0.2)


def test_verdict_order(spark):
    keys = spark.createDataFrame(
        [("good", 1, True, 1.0), ("off", 2, False, 1.0), ("empty", 3, True, 0.0)], "t string, id long, active boolean, b double"
    ).select(F.sha2("t", 256).alias("key_hash"), "id", "active", F.col("b").cast("decimal(12,4)").alias("total_budget"), F.lit("one_time").alias("budget_type"))
    rows = [(1, "Bearer good"), (2, "Bearer off"), (3, "Bearer empty"), (4, "Bearer nobody"), (5, "bearer good"), (6, None),
            (7, "Bearer good"), (8, "Bearer good")]
    requests = spark.createDataFrame([(i, T0 + i, h, Decimal("0.7")) for i, h in rows],
                                     "request_id long, sec long, auth_header string, cost_usd decimal(18,12)").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.request_id: (r.status, r.verdict) for r in meter.request_verdict(requests, keys).collect()}
    assert got == {1: (200, "ok"), 2: (401, "inactive"), 3: (402, "spent"), 4: (401, "unknown"), 5: (401, "malformed"),
                   6: (401, "malformed"), 7: (200, "ok"), 8: (402, "spent")}
    assert {r.verdict for r in meter.request_verdict(requests, keys, limit=1, width=86_400).where("request_id > 6").collect()} == {"limited"}


@pytest.mark.parametrize("seed", range(3))
def test_budget_adjust_matches_a_walk(spark, seed):
    rnd = random.Random(seed)
    keys = [(i, Decimal(rnd.randint(0, 20)), Decimal(rnd.randint(0, 20))) for i in range(30)]
    some = lambda p: Decimal(rnd.randint(0, 25)) if rnd.random() < p else None
    changes = [(c, rnd.randrange(30), some(0.7), some(0.2)) for c in range(400)]
    state = {i: [t, r] for i, t, r in keys}
    for _, k, total, left in changes:
        t, r = state[k]
        if total is not None and left is None:
            r = max(Decimal(0), r + total - t)
        state[k] = [t if total is None else total, r if left is None else left]
    kdf = spark.createDataFrame(keys, "id long, total_budget decimal(12,4), remaining_budget decimal(12,4)").selectExpr(
        "*", "'n' AS name", "'active' AS status", "'monthly' AS budget_type")
    cdf = spark.createDataFrame(changes, "change_id long, key_id long, total_budget decimal(12,4), remaining_budget decimal(12,4)").selectExpr(
        "*", "CAST(NULL AS STRING) AS status", "CAST(NULL AS STRING) AS budget_type")
    assert {r.id: [r.total_budget, r.remaining_budget] for r in meter.budget_adjust(kdf, cdf).collect()} == state


def test_cache_ttl_hits_do_not_extend(spark):
    rows = [("p", T0, 1), ("p", T0 + 10_000, 2), ("p", T0 + 14_399, 3), ("p", T0 + 14_400, 4)]
    df = frame(spark, rows).withColumnRenamed("key", "cache_key").withColumnRenamed("id", "request_id").withColumn("intent", F.lit("support"))
    assert {r.request_id: r.hit for r in cache_ttl_replay(df).collect()} == {1: False, 2: True, 3: True, 4: False}
