"""Log queue and live figures as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenmill.functions import fixed
from tokenmill.operators.ordered import number_in_place
from tokenmill.operators.sizes import broadcast_if_small
from tokenmill.sources.sinks import append_batch, publish_snapshot, read_snapshot
from tokenmill.sources.tables import TOKEN_LOGS, parse_log_entries

MAX_CONFIG_KEYS = 1_000_000


def read_log_queue_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Queue entries as lines of ``value``, oldest files first, with the time of their file as ``queued_at``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("queued_at"))


def read_kafka_queue_stream(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """The same lines from Kafka, which admits ``per_batch`` entries at a time."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch).load().selectExpr("CAST(value AS STRING) AS value", "timestamp AS queued_at")
    )


def _trigger(drain: bool) -> dict:
    """All there is and then stop, or go on every five seconds."""
    return {"availableNow": True} if drain else {"processingTime": "5 seconds"}


def log_ingest_stream(lines: DataFrame, table: str, dead: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Good entries to the log table, broken ones to ``dead``; neither holds the other up.

    Rows of the table are whole log rows: ``created_at`` is the time when the entry was queued (``queued_at`` of the
    lines), and ``id`` goes on from batch to batch without gaps. Each batch writes folders of its own, so a batch
    that runs twice leaves no duplicates; the last number of each batch is kept beside the table.
    """
    numbers = f"{table}-numbers"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # each of the two writes reads the batch; parsing twice is cheaper than keeping it
        rows = parse_log_entries(batch.select("value", F.col("queued_at").alias("created_at")))
        spark.createDataFrame([], "last bigint").write.mode("ignore").parquet(f"{numbers}/batch=-1")
        kept = spark.read.schema("last bigint, batch bigint").parquet(numbers).where(F.col("batch") < batch_id)
        last = kept.agg(F.max("last")).first()[0] or 0  # one small number per batch
        placed = number_in_place(rows.where("ok").drop("ok", "value"), "id", last + 1)
        append_batch(placed.select(*TOKEN_LOGS.fieldNames()), batch_id, table)
        written = spark.read.schema(TOKEN_LOGS).parquet(f"{table}/batch={batch_id}").agg(F.coalesce(F.max("id"), F.lit(last)).alias("last"))
        append_batch(written.coalesce(1), batch_id, numbers)
        append_batch(rows.where("NOT ok").select("value"), batch_id, dead)

    return (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_trigger(drain)).start()
    )


FIGURES = (
    "intent string, model string, count bigint, tokens bigint, prompt_tokens bigint, completion_tokens bigint, "
    "latency_ms bigint, timed bigint, cost_usd decimal(38,12)"
)
NEWEST = 10


def live_dashboard(logs: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Requests, tokens, cost and latency per (intent, model), published as a snapshot after every batch.

    The stream's state has one row per pair. The figures of the dashboard are sums over the snapshot; see
    ``read_dashboard``.
    """
    counts = logs.groupBy("intent", "model").agg(
        F.count("*").alias("count"), F.sum("total_tokens").alias("tokens"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("latency_ms").alias("latency_ms"),
        F.count("latency_ms").alias("timed"), F.sum("cost_usd").cast("decimal(38,12)").alias("cost_usd"),
    )
    trigger = {"availableNow": True} if drain else {"processingTime": "3 seconds"}
    return (
        counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(**trigger)
        # at most intents times models rows
        .foreachBatch(lambda batch, batch_id: publish_snapshot(batch.coalesce(1), path, batch_id)).start()
    )


def newest_logs(logs: DataFrame, path: str, checkpoint: str, n: int = NEWEST, drain: bool = False) -> StreamingQuery:
    """The ``n`` newest log rows, published as a snapshot after every batch; of equal times the larger id is newer.

    A batch's own newest meet those of the snapshot before, so no more than ``n`` rows are carried on.
    """
    schema = logs.schema

    def replace(batch: DataFrame, batch_id: int) -> None:
        before = read_snapshot(batch.sparkSession, path, schema, below=batch_id)
        newest = batch.orderBy(F.desc("created_at"), F.desc("id")).limit(n).unionByName(before)
        publish_snapshot(newest.orderBy(F.desc("created_at"), F.desc("id")).limit(n).coalesce(1), path, batch_id)

    return logs.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(**_trigger(drain)).start()


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, FIGURES)


def dashboard_by_model(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("model").agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens"))


def dashboard_by_intent(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("intent").agg(F.sum("count").alias("count"))


def rate_limit_stream(
    requests: DataFrame, key: str, ts: str = "ts", limit: int = fixed.RATE_LIMIT, width: str = "1 minute",
    lateness: str = "1 minute",
) -> DataFrame:
    """Requests per key and clock window, and how many of them went over the limit.

    Counts are summed before the shuffle, so a busy key costs one row per task and window.
    """
    return (
        requests.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), key).count()
        .select(key, F.col("w.start").alias("window_start"), F.col("count").alias("requests"),
                F.greatest(F.col("count") - limit, F.lit(0)).alias("refused"))
    )


def config_as_of(requests: DataFrame, config: DataFrame, key: str, ts: str = "ts", since: str = "valid_from") -> DataFrame:
    """``requests`` with the configuration that held at their time, as ``config``: of the key's versions the last one from
    then or before; null where there is none yet.

    ``config`` has the key, ``valid_from`` and the settings; of versions from one moment the greatest counts. A key's versions are one
    sorted list, and only the small side is shuffled or broadcast, so requests keep their place.
    """
    rest = [c for c in config.columns if c not in (key, since)]
    version = F.struct(F.col(since).cast("timestamp").alias("since"), *rest)
    listed = config.groupBy(key).agg(F.sort_array(F.collect_list(version)).alias("_versions"))
    met = requests.join(broadcast_if_small(listed, MAX_CONFIG_KEYS), key, "left")
    at = F.col(ts).cast("timestamp")
    held = F.try_element_at(F.filter("_versions", lambda v: v["since"] <= at), F.lit(-1))
    return met.withColumn("config", held).drop("_versions")


def config_stream_join(
    stream: DataFrame, read_config: Callable[[SparkSession], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame],
    path: str, checkpoint: str, drain: bool = False,
) -> StreamingQuery:
    """``apply(batch, config)`` with the configuration read anew in every batch, so changes take effect.

    With ``config_as_of`` in ``apply`` a change takes effect for requests from its time on, whichever batch they come in."""
    def run(batch: DataFrame, batch_id: int) -> None:
        append_batch(apply(batch, read_config(batch.sparkSession)), batch_id, path)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**_trigger(drain)).start()
    )


def append_alerts(alerts: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Alert rows out, a folder per batch."""
    return (
        alerts.writeStream.foreachBatch(lambda b, i: append_batch(b, i, path)).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(drain)).start()
    )


def snapshot_summary(snapshot: DataFrame) -> DataFrame:
    """The dashboard's totals from a live snapshot; no rows give zeros."""
    zero = F.lit(0)
    return snapshot.agg(
        F.coalesce(F.sum("count"), zero).alias("total_requests"),
        F.coalesce(F.sum("tokens"), zero).alias("total_tokens_used"),
        F.round(F.coalesce(F.sum("cost_usd"), zero), 6).alias("total_cost_usd"),
        F.round(F.coalesce(F.sum("latency_ms") / F.nullif(F.sum("timed"), zero), F.lit(0.0)), 2).alias("avg_latency_ms"),
    )
