"""Sinks of the batch jobs and of the streams' ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.operators.ordered import rank_in_key

ID_SLICE = 1024


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch under its own folder, so that a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


# ------------------------------------------------------------------------------------- snapshots
def publish_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write a numbered snapshot, then the pointer that makes it the current one.

    The pointer is one small file, which is there or not: readers find the whole snapshot before or the whole new one.
    Writing a version again replaces it. Older versions stay until someone removes them.
    """
    df.write.mode("overwrite").parquet(f"{path}/data/version={version}")
    spark = df.sparkSession
    pointer = spark.range(1).coalesce(1).select(F.lit(True).alias("whole"))
    pointer.write.mode("overwrite").parquet(f"{path}/current/version={version}")


def current_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest whole snapshot's number (under ``below``); None where there is none."""
    spark.createDataFrame([], "whole boolean").write.mode("ignore").parquet(f"{path}/current/version=-1")
    seen = spark.read.schema("whole boolean, version bigint").parquet(f"{path}/current").where("whole")
    if below is not None:
        seen = seen.where(F.col("version") < below)
    return seen.agg(F.max("version")).first()[0]


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType, below: int | None = None) -> DataFrame:
    """The newest whole snapshot (under version ``below``); no rows where there is none."""
    version = current_version(spark, path, below)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data/version={version}")


PRICES = "model_name string, input decimal(18,12), output decimal(18,12), provider string"


def overwrite_price_snapshot(prices: DataFrame, path: str) -> bool:
    """Publish the serving prices as a new snapshot; an empty table leaves the old one in place."""
    if prices.isEmpty():
        return False
    last = current_version(prices.sparkSession, path)
    served = prices.select(
        "model_name", F.col("input_price").cast("decimal(18,12)").alias("input"),
        F.col("output_price").cast("decimal(18,12)").alias("output"), "provider")
    publish_snapshot(served, path, 0 if last is None else last + 1)
    return True


def read_price_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, PRICES)


# --------------------------------------------------------------------------- generations of entries
def write_generation(entries: DataFrame, path: str, generation: int) -> None:
    """New cache entries as one more generation, from 0 on; writing a generation again replaces it."""
    entries.write.mode("overwrite").parquet(f"{path}/generations/generation={generation}")


def _held(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Entries of the compacted snapshot and of the generations after it, and the last of these."""
    base = current_version(spark, f"{path}/base")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/generations/generation=-1")
    newer = spark.read.schema(f"{schema}, generation bigint").parquet(f"{path}/generations")
    newer = newer.where(F.col("generation") > (-1 if base is None else base))
    last = newer.agg(F.max("generation")).first()[0]
    both = read_snapshot(spark, f"{path}/base", schema).withColumn("generation", F.lit(-1).cast("bigint")).unionByName(newer)
    return both, max(-1 if base is None else base, -1 if last is None else last)


def read_generations(spark: SparkSession, path: str, schema: str, at: int, key: str = "cache_key") -> DataFrame:
    """The entries that are live at second ``at``: of each key the last one saved, if it has not expired.

    ``schema`` has the key, ``saved_at`` and ``expires_at`` in seconds, and the answer's columns. Of entries saved in
    the same second the later generation counts.
    """
    return _latest(_held(spark, path, schema)[0], key).where(F.col("expires_at") > at)


def _latest(entries: DataFrame, key: str) -> DataFrame:
    rest = [c for c in entries.columns if c not in (key, "generation")]
    order = F.struct("saved_at", "generation", *[c for c in rest if c != "saved_at"])
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, "_e.*")


def compact_generations(spark: SparkSession, path: str, schema: str, at: int, key: str = "cache_key") -> int:
    """Merge all generations so far into one snapshot of live entries; returns the last generation in it.

    Writers and readers go on meanwhile: a generation that comes later is read on top of the snapshot, and readers use
    the old snapshot until the new one is whole. An entry that is replaced is gone for good, also where its
    successor has expired.
    """
    entries, last = _held(spark, path, schema)
    if last >= 0:
        publish_snapshot(_latest(entries, key).where(F.col("expires_at") > at), f"{path}/base", last)
    return last


def write_token_logs(logs: DataFrame, path: str) -> None:
    """Logs by day, sorted by key inside a day's files, so that both kinds of filter skip data.

    The rows of a day spread over tasks by key and request, not by key alone: a busy key must not
    decide the size of a file.
    """
    day = logs.withColumn("log_date", F.to_date("created_at"))
    (
        day.repartitionByRange("log_date", "api_key_id", "id").sortWithinPartitions("log_date", "api_key_id", "id")
        .write.mode("append").partitionBy("log_date").parquet(path)
    )


def export_rules_document(rules: DataFrame, path: str) -> None:
    """All rules as JSON lines (intent, place, rule), in order of intent and rule, whatever their number."""
    placed = rank_in_key(rules, ["intent"], F.floor(F.col("id") / ID_SLICE), ["id"], "place")
    fields = [c for c in rules.columns if c != "intent"]
    ordered = placed.repartitionByRange("intent", "place").sortWithinPartitions("intent", "place")
    line = F.to_json(F.struct("intent", "place", F.struct(*fields).alias("rule")))
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)
