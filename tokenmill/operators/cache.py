"""Exact-key reuse of answers over time, and the rows that a replay writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import ttl_seconds
from tokenmill.functions.text import prompt_key
from tokenmill.operators.ordered import greedy_ttl, micros, running_total, time_slice
from tokenmill.session import stage


def cache_ttl_replay(
    requests: DataFrame, key: str = "cache_key", intent: str = "intent", ts: str = "ts", row_id: str = "request_id"
) -> DataFrame:
    """Adds ``hit``: the key was saved less than its time to live ago. A miss saves and starts anew.

    Hits do not extend a saved answer, so the misses are exactly the rows that fire in the greedy
    kernel. A key's intent decides its time to live and has to be the same for all its rows.
    """
    misses = greedy_ttl(requests, [key], ts, row_id, ttl_seconds(F.col(intent)))
    return (
        requests.join(misses.select(key, row_id, F.lit(True).alias("_miss")), [key, row_id], "left")
        .withColumn("hit", F.col("_miss").isNull()).select(*requests.columns, "hit")
    )


def cache_replay(
    requests: DataFrame, key: str = "cache_key", intent: str = "intent", ts: str = "ts", row_id: str = "request_id",
    bypass: str = "bypass", answered: str = "answered",
) -> DataFrame:
    """Adds ``hit``, where not every miss saves: only those with ``answered``, and requests with ``bypass``.

    A request with ``bypass`` takes the key's entry away and, if it is answered, saves a new one; it begins the key's
    next age. In an age the rows that save are those that fire in the greedy kernel, over the answered rows alone. A
    row without an answer hits if one fired less than a time to live before: as firing rows lie a time to live apart,
    it meets those of its own and the last slice of that length by equality. A key's intent has to be the same for
    all its rows.
    """
    flagged = F.col(bypass).cast("bigint")
    aged = running_total(requests, [key], time_slice(F.col(ts), 3600), [ts, row_id], flagged, "_age", inclusive=True)
    aged = stage(aged.withColumn("_ttl", ttl_seconds(F.col(intent)).cast("bigint") * 1_000_000).withColumn("_t", micros(F.col(ts))), "ages")
    saves = aged.where(F.col(answered))
    fired = stage(greedy_ttl(saves, [key, "_age"], ts, row_id, F.expr("_ttl div 1000000")).select(key, "_age", row_id, micros(F.col(ts)).alias("_saved")), "saves")
    fresh = fired.select(row_id, F.lit(True).alias("_fresh"))
    slot = lambda t: F.floor(F.col(t) / F.col("_ttl"))
    unanswered = aged.where(~F.col(answered) & ~F.col(bypass))
    near = unanswered.withColumn("_slot", F.explode(F.array(slot("_t"), slot("_t") - 1)))
    placed = fired.join(aged.select(row_id, "_ttl"), row_id).select(
        key, "_age", slot("_saved").alias("_slot"), "_saved", F.col(row_id).alias("_saver"))
    met = near.join(placed, [key, "_age", "_slot"]).where(
        ((F.col("_saved") < F.col("_t")) | ((F.col("_saved") == F.col("_t")) & (F.col("_saver") < F.col(row_id)))) & (F.col("_t") < F.col("_saved") + F.col("_ttl")))
    served = met.select(row_id, F.lit(True).alias("_served")).distinct()
    hit = F.when(F.col(bypass), False).when(F.col(answered), F.col("_fresh").isNull()).otherwise(F.col("_served").isNotNull())
    return aged.join(fresh, row_id, "left").join(served, row_id, "left").withColumn("hit", hit).select(*requests.columns, "hit")


def cache_fill_rows(answered: DataFrame, text: str = "text", ts: str = "ts") -> DataFrame:
    """Entries that answered requests leave behind: no hit, an answer, and a text as content.

    The key is the hash of the prompt before compression.
    """
    keep = answered.where(~F.col("hit") & F.col("answer").isNotNull() & F.col(text).isNotNull())
    saved = F.unix_seconds(F.col(ts).cast("timestamp"))
    return keep.select(
        prompt_key(F.col(text)).alias("cache_key"), F.col("answer").alias("response"), saved.alias("saved_at"),
        (saved + ttl_seconds(F.col("intent"))).alias("expires_at"), "request_id",
    )


def build_log_rows(outcomes: DataFrame) -> DataFrame:
    """Log rows of (hit, intent, final_model, prompt_tokens, completion_tokens, cost_usd, ...)."""
    hit = F.col("hit")
    zero = lambda c: F.when(hit, F.lit(0)).otherwise(F.col(c))
    return outcomes.select(
        "request_id", "api_key_id", "user_id",
        F.when(hit, F.lit(fixed.CACHED_INTENT)).otherwise(F.col("intent")).alias("intent"),
        F.when(hit, F.lit(fixed.CACHED_MODEL)).otherwise(F.col("final_model")).alias("model"),
        zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"),
        (zero("prompt_tokens") + zero("completion_tokens")).alias("total_tokens"), "latency_ms",
        zero("cost_usd").cast("decimal(18,12)").alias("cost_usd"), F.col("ts").alias("created_at"),
    )
