"""Streams against their batch twins, over several micro-batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import meter
from tokenmill.plans.queries import provider_lines
from tokenmill.operators.conversations import fold_provider_events
from tokenmill.sources import sinks, tables
from tokenmill.streaming import logs, stateful

T0 = 1_700_000_000


def in_time_order(df, path, n, spark):
    """The rows as ``n`` files, one per micro-batch, in order of time."""
    rows = df.orderBy("ts", "id").collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(spark, n=300, span=20_000, seed=1):
    rnd = random.Random(seed)
    rows = [(str(rnd.choice([1, 1, 1, 2, 3])), T0 + rnd.randrange(span), i, rnd.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "api_key_id string, sec long, id long, c long").withColumn("ts", F.timestamp_seconds("sec")).withColumn(
        "cost_usd", (F.col("c") * F.lit("0.0005").cast("decimal(18,12)")).cast("decimal(18,12)"))


def test_alert_silence_over_batches(spark, tmp_path):
    df = rows_of(spark)
    p = lambda n: str(tmp_path / n)
    stream = in_time_order(df, p("in"), 5, spark)
    logs.append_alerts(stateful.alert_silence_stream(stream, "api_key_id", silence=900), p("out"), p("at"), drain=True).awaitTermination()
    got = {r.id for r in spark.read.parquet(p("out")).collect()}
    last, want = {}, set()
    for r in df.orderBy("ts", "id").collect():
        if r.api_key_id not in last or r.sec >= last[r.api_key_id] + 900:
            last[r.api_key_id] = r.sec
            want.add(r.id)
    assert got == want and len([d for d in os.listdir(p("out")) if d.startswith("batch=")]) >= 5


def test_budget_over_batches(spark, tmp_path):
    df = rows_of(spark)
    keys = spark.createDataFrame([(1, "a", 0.2), (2, "b", 0.1), (3, "c", 9.0)], "id long, name string, b double").select(
        "id", "name", F.col("b").cast("decimal(12,4)").alias("total_budget"), F.lit("one_time").alias("budget_type"))
    p = lambda n: str(tmp_path / n)
    stream = in_time_order(df, p("in"), 4, spark)
    logs.append_alerts(stateful.budget_stream(stream, keys, row_id="id", silence=600), p("out"), p("at"), drain=True).awaitTermination()
    got = {r.request_id: (r.balance_before, r.balance_after, r.refused) for r in spark.read.parquet(p("out")).collect()}
    batch = meter.running_budget(df, keys, row_id="id")
    assert got == {r.id: (r.balance_before, r.balance_after, r.refused) for r in batch.collect()}
    alerts = {r.request_id for r in spark.read.parquet(p("out")).where("alert").collect()}
    assert alerts == {r.id for r in meter.low_budget_alerts(batch, row_id="id", silence=600).collect()} and alerts


def test_late_row_stays_silent_and_months_start_anew(spark, tmp_path):
    first = spark.createDataFrame([("1", 1_706_700_000, 1, 8), ("9", 1_706_700_000, 2, 8)], "api_key_id string, sec long, id long, c long")
    late = spark.createDataFrame([("1", 1_706_699_990, 3, 8), ("1", 1_706_750_000, 4, 8)], first.schema)
    with_ts = lambda df: df.select("api_key_id", F.timestamp_seconds("sec").alias("ts"), "id", (F.col("c") / 10).cast("decimal(18,12)").alias("cost_usd"))
    p = lambda n: str(tmp_path / n)
    keys = spark.sql("SELECT 1L AS id, 'm' AS name, CAST(1 AS DECIMAL(12,4)) AS total_budget, 'monthly' AS budget_type")
    for make, name in ((lambda x: stateful.alert_silence_stream(x, "api_key_id", silence=100), "a"),
                       (lambda x: stateful.budget_stream(x, keys, row_id="id", silence=100), "b")):
        for part in (first, late):
            with_ts(part).write.mode("append").parquet(p(f"in-{name}"))
            stream = spark.readStream.schema(with_ts(part).schema).parquet(p(f"in-{name}"))
            logs.append_alerts(make(stream), p(f"out-{name}"), p(f"at-{name}"), drain=True).awaitTermination()
    assert {r.id for r in spark.read.parquet(p("out-a")).collect()} == {1, 2, 4}
    got = {r.request_id: float(r.balance_before) for r in spark.read.parquet(p("out-b")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(0.2), 4: 1.0}


def test_log_ingest_and_dead_letters(spark, tmp_path):
    good = {"api_key_id": "1", "user_id": None, "intent": "code", "model": "m", "prompt_tokens": 3, "completion_tokens": 4, "latency_ms": 5}
    os.makedirs(tmp_path / "q")
    for i in range(3):
        (tmp_path / "q" / f"{i}.txt").write_text("\n".join([json.dumps(good), "{oops", json.dumps({**good, "completion_tokens": None}), json.dumps({**good, "cost_usd": 0.1234567890123})]))
    p = lambda n: str(tmp_path / n)
    for _ in range(2):  # a second drain finds nothing new
        q = logs.log_ingest_stream(logs.read_log_queue_stream(spark, p("q"), 1), p("t"), p("d"), p("c"), drain=True)
        q.awaitTermination()
    rows = spark.read.parquet(p("t"))
    assert sorted(r.id for r in tables.read_token_logs(spark, p("t")).collect()) == [1, 2, 3, 4, 5, 6] and not rows.where("created_at IS NULL").count()
    assert rows.count() == 6 and {r.total_tokens for r in rows.collect()} == {7} and {str(r.cost_usd) for r in rows.collect()} == {"0E-12", "0.123456789012"}
    assert spark.read.parquet(p("d")).count() == 6


def test_live_dashboard(spark, tmp_path):
    df = rows_of(spark, 60).select("id", "ts", F.lit("code").alias("intent"), F.concat(F.lit("m"), "api_key_id").alias("model"),
                                   *[F.col("c").alias(x) for x in ("prompt_tokens", "completion_tokens", "total_tokens", "latency_ms")], "cost_usd")
    p = lambda n: str(tmp_path / n)
    logs.live_dashboard(in_time_order(df, p("in"), 3, spark), p("snap"), p("c"), drain=True).awaitTermination()
    snap = logs.read_dashboard(spark, p("snap"))
    assert logs.snapshot_summary(snap).first().avg_latency_ms == round(df.agg(F.avg("latency_ms")).first()[0], 2)
    assert logs.snapshot_summary(logs.read_dashboard(spark, p("nothing"))).first().total_requests == 0
    want = {r.model: (r["count"], r.t) for r in df.groupBy("model").agg(F.count("*").alias("count"), F.sum("total_tokens").alias("t")).collect()}
    assert {r.model: (r["count"], r.tokens) for r in logs.dashboard_by_model(snap).collect()} == want
    assert logs.dashboard_by_intent(snap).first()["count"] == 60 and logs.snapshot_summary(snap).first().total_requests == 60


def test_rate_windows(spark, tmp_path):
    df = rows_of(spark, 200, 3_000).select("id", "ts", "api_key_id")
    p = lambda n: str(tmp_path / n)
    late = df.agg(F.lit(-1).cast("long").alias("id"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("x").alias("api_key_id"))
    stream = in_time_order(df.unionByName(late), p("in"), 4, spark)
    logs.append_alerts(logs.rate_limit_stream(stream, "api_key_id", limit=3), p("out"), p("c"), drain=True).awaitTermination()
    got = {(r.api_key_id, r.window_start): (r.requests, r.refused) for r in spark.read.parquet(p("out")).collect()}
    flags = meter.rate_limit(df, "api_key_id", row_id="id", limit=3).groupBy("api_key_id", F.date_trunc("minute", "ts").alias("m")).agg(
        F.count("*").alias("n"), F.count_if("limited").alias("r"))
    assert got == {(r.api_key_id, r.m): (r.n, r.r) for r in flags.collect()}


def test_every_request_has_its_flag(spark, tmp_path):
    df = rows_of(spark, 200, 3_000).select("id", "ts", "api_key_id")
    p = lambda n: str(tmp_path / n)
    out = stateful.rate_flags_stream(in_time_order(df, p("in"), 4, spark), "api_key_id", row_id="id", limit=3)
    logs.append_alerts(out, p("out"), p("c"), drain=True).awaitTermination()
    got = {r.id: (r.nth, r.limited) for r in spark.read.parquet(p("out")).collect()}
    assert got == {r.id: (r.nth, r.limited) for r in meter.rate_limit(df, "api_key_id", row_id="id", limit=3).collect()}
    # late ones: behind those of their window that came before, and anew where their window is no longer kept
    late = spark.createDataFrame([(-1, T0 + 3_000 + 30, "1"), (-2, T0 - 90_000, "1")], "id long, sec long, api_key_id string")
    late.select("id", F.timestamp_seconds("sec").alias("ts"), "api_key_id").write.mode("append").parquet(p("in"))
    logs.append_alerts(stateful.rate_flags_stream(spark.readStream.schema(df.schema).parquet(p("in")), "api_key_id", row_id="id", limit=3),
                       p("out"), p("c"), drain=True).awaitTermination()
    assert {r.id: r.nth for r in spark.read.parquet(p("out")).where("id < 0").collect()}[-2] == 1


def test_texts_are_labelled_once_an_hour(spark, tmp_path):
    df = rows_of(spark, 60, 12_000).select("id", "ts", F.concat(F.lit("Text "), "c", F.when(F.col("id") % 2 == 0, "\n").otherwise(" ")).alias("text"))
    p = lambda n: str(tmp_path / n)
    out = stateful.memo_label_stream(in_time_order(df, p("in"), 3, spark), lambda t: t.upper(), row_id="id")
    logs.append_alerts(out, p("out"), p("c"), drain=True).awaitTermination()
    got = {r.id: (r.intent, r.remembered) for r in spark.read.parquet(p("out")).collect()}
    last, want = {}, {}
    for r in df.orderBy("ts", "id").collect():
        k, t = r.text.strip().upper(), r.ts.timestamp()
        fresh = k not in last or t >= last[k] + 3600
        if fresh:
            last[k] = t
        want[r.id] = (k, not fresh)
    assert got == want and any(v[1] for v in want.values())


def test_newest_logs_over_batches(spark, tmp_path):
    df = rows_of(spark, 60).select("id", F.col("ts").alias("created_at"), "ts")
    p = lambda n: str(tmp_path / n)
    logs.newest_logs(in_time_order(df, p("in"), 3, spark), p("new"), p("c"), n=7, drain=True).awaitTermination()
    want = [r.id for r in df.orderBy(F.desc("ts"), F.desc("id")).limit(7).collect()]
    assert sorted(r.id for r in sinks.read_snapshot(spark, p("new"), df.schema).collect()) == sorted(want)


def test_settings_as_of_the_request(spark):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    asked = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(5)), (3, "a", t(3)), (4, "b", t(9)), (5, None, t(9))], "id long, k string, ts string")
    config = spark.createDataFrame([("a", t(3), "x"), ("a", t(4), "y"), ("a", t(4), "z")], "k string, valid_from string, model string")
    got = {r.id: r.config and r.config.model for r in logs.config_as_of(asked, config, "k").collect()}
    assert got == {1: None, 2: "z", 3: "x", 4: None, 5: None}


def test_snapshots_are_whole_or_absent(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "a long"
    assert sinks.read_snapshot(spark, path, schema).count() == 0
    sinks.publish_snapshot(spark.range(3).toDF("a"), path, 0)
    # a writer that has not yet set the pointer: readers stay with the one before
    spark.range(9).toDF("a").write.parquet(f"{path}/data/version=1")
    assert sinks.read_snapshot(spark, path, schema).count() == 3
    sinks.publish_snapshot(spark.range(5).toDF("a"), path, 1)
    assert sinks.read_snapshot(spark, path, schema).count() == 5 and sinks.read_snapshot(spark, path, schema, below=1).count() == 3


def test_generations_and_compaction(spark, tmp_path):
    schema, path = "cache_key string, saved_at long, expires_at long, answer string", str(tmp_path / "g")
    live = lambda at: {r.cache_key: r.answer for r in sinks.read_generations(spark, path, schema, at).collect()}
    assert live(0) == {} and sinks.compact_generations(spark, path, schema, 0) == -1
    sinks.write_generation(spark.createDataFrame([("a", 1, 10, "a1"), ("b", 1, 100, "b1"), ("c", 2, 100, "c1")], schema), path, 0)
    sinks.write_generation(spark.createDataFrame([("b", 3, 6, "b2"), ("c", 2, 100, "c2")], schema), path, 1)
    assert live(5) == {"a": "a1", "b": "b2", "c": "c2"} and live(7) == {"a": "a1", "c": "c2"}
    assert sinks.compact_generations(spark, path, schema, 7) == 1
    assert live(7) == {"a": "a1", "c": "c2"} and live(50) == {"c": "c2"}
    sinks.write_generation(spark.createDataFrame([("b", 8, 99, "b3")], schema), path, 2)
    assert live(8) == {"a": "a1", "b": "b3", "c": "c2"}


def test_config_is_read_per_batch(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    stream = in_time_order(rows_of(spark, 30).select("id", "ts"), p("in"), 3, spark)
    reads = []

    def config(session):
        reads.append(1)
        return session.createDataFrame([(len(reads),)], "version long")

    apply = lambda batch, cfg: batch.withColumn("version", F.lit(cfg.first().version))
    logs.config_stream_join(stream, config, apply, p("out"), p("c"), drain=True).awaitTermination()
    assert {r.version for r in spark.read.parquet(p("out")).collect()} == {1, 2, 3}


@pytest.mark.parametrize("files", [1, 4])
def test_event_fold_over_batches(spark, tmp_path, files):
    turns = spark.createDataFrame([(i, 1 + i % 2, "assistant", f"word{i} is " + "x " * i) for i in range(12)], "conv_id long, turn long, role string, text string")
    lines = provider_lines(turns)
    events = tables.parse_sse_lines(lines).withColumn("ts", F.timestamp_seconds(F.lit(T0) + F.col("seq"))).withColumn("id", F.col("msg_id"))
    p = lambda n: str(tmp_path / n)
    out = stateful.stream_fold_stateful(in_time_order(events, p("in"), files, spark))
    logs.append_alerts(out, p("out"), p("c"), drain=True).awaitTermination()
    pick = ["msg_id", "prompt_tokens", "completion_tokens", "text", "finish_reason", "finished"]
    got = sorted(tuple(r) for r in spark.read.parquet(p("out")).select(pick).collect())
    assert got == sorted(tuple(r) for r in fold_provider_events(tables.parse_sse_lines(lines)).select(pick).collect())
