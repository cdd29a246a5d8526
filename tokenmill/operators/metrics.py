"""Dashboard figures over token logs. Every group is reduced before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import installed_names, size_gb

RECENT_COLUMNS = ["id", "api_key_id", "intent", "model", "total_tokens", "latency_ms", "cost_usd", "created_at"]


def _sum(c: str) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def summary_metrics(logs: DataFrame) -> DataFrame:
    """One row, also for an empty table."""
    latency = F.sum("latency_ms") / F.count("latency_ms")
    return logs.agg(
        F.count("*").alias("total_requests"),
        _sum("prompt_tokens").alias("total_prompt_tokens"),
        _sum("completion_tokens").alias("total_completion_tokens"),
        _sum("total_tokens").alias("total_tokens_used"),
        F.round(F.coalesce(F.when(F.count("latency_ms") > 0, latency), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)), 6).alias("total_cost_usd"),
    )


def by_intent(logs: DataFrame) -> DataFrame:
    return logs.groupBy("intent").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "intent")


def by_model(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy("model").agg(F.count("*").alias("count"), _sum("total_tokens").alias("tokens"))
        .orderBy(F.desc("count"), "model")
    )


def recent_logs(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.select(*RECENT_COLUMNS).orderBy(F.desc("id")).limit(n)


def intent_vector(logs: DataFrame) -> DataFrame:
    """One row with a count per classifier intent; other intents do not show."""
    return logs.agg(*[F.count_if(F.col("intent") == i).alias(i) for i in fixed.INTENTS])


def cache_hit_rate(logs: DataFrame) -> DataFrame:
    hit = (F.col("intent") == fixed.CACHED_INTENT) & (F.col("model") == fixed.CACHED_MODEL)
    return logs.agg(
        F.count_if(hit).alias("hits"), F.count("*").alias("requests"),
        F.when(F.count("*") > 0, F.count_if(hit) / F.count("*")).otherwise(0.0).alias("hit_rate"),
    )


def logs_by_key(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests, tokens and cost per key with the key's name; logs of unknown keys keep a null name.

    Logs are reduced per key before the join, so a busy key adds one row to it. The key is text in
    the logs and a number in the key table.
    """
    per_key = logs.groupBy("api_key_id").agg(
        F.count("*").alias("requests"), _sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )
    named = keys.select(F.col("id").cast("string").alias("api_key_id"), "name", "status")
    return per_key.join(named, "api_key_id", "left")


def compression_report(results: DataFrame) -> DataFrame:
    """Tokens before and after and mean ratio per method, and bypasses by reason."""
    return results.groupBy("method", "reason").agg(
        F.count("*").alias("prompts"), F.count_if("bypassed").alias("bypassed"),
        F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"),
        F.avg("ratio").alias("mean_ratio"),
    )


def label_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy("intent").agg(F.count("*").alias("samples"))


def local_model_sizes(manifests: DataFrame, limit_gb: float = fixed.MAX_LOCAL_MODEL_GB) -> DataFrame:
    """(name, layers array<struct<size>>) -> size in GB and whether the limit lets the model in."""
    total = F.aggregate("layers", F.lit(0).cast("bigint"), lambda acc, l: acc + F.coalesce(l.size, F.lit(0)))
    gb = size_gb(total)
    return manifests.select(
        "name", gb.alias("size_gb"), F.concat(gb.cast("string"), F.lit(" GB")).alias("size"),
        (total / F.lit(1024**3) > limit_gb).alias("over_limit"),
    )


def installed_models(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Wanted names that are installed, under the name itself or its ``:latest`` form."""
    forms = wanted.withColumn("_form", F.explode(installed_names(F.col("name"))))
    there = installed.select(F.col("name").alias("_form")).distinct()
    return forms.join(there, "_form", "left_semi").select(*wanted.columns).distinct()


def cache_clear_count(kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, cleared): the entries of each kind that a full clear removes, and all together as ``total``."""
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("cleared")) for kind, df in kinds.items()]
    each = reduce(DataFrame.unionByName, counts)
    return each.unionByName(each.agg(F.lit("total").alias("kind"), F.sum("cleared").alias("cleared")))
