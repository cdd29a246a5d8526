"""Conversations and provider event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import finish_reason
from tokenmill.functions.text import token_estimate
from tokenmill.operators.ordered import previous_value, running_total

TURN_SLICE = 256


def last_user_message(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of each conversation's last user turn; an empty text is left out."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text")
    )
    return last.where("text <> ''")


def merge_roles(turns: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Turns for providers that want alternating roles: (conv_id, place, role, content).

    With ``limits`` (conv_id, max_tokens) also ``max_tokens``, which such providers demand: the default where none is given.

    System turns become one row at place 0, joined by line breaks. Other roles speak as the user with
    their name in front; neighbours of one role become one message. Long conversations are cut by
    turn, so none has to fit one task; a message is as long as its turns.
    """
    known = F.col("role").isin("user", "assistant")
    spoken = turns.where("role <> 'system'").select(
        "conv_id", "turn", F.when(known, F.col("role")).otherwise("user").alias("role"),
        F.when(known, F.col("text")).otherwise(F.concat(F.lit("["), "role", F.lit("]: "), "text")).alias("text"),
    )
    cut = F.floor(F.col("turn") / TURN_SLICE)
    rows = previous_value(spoken, ["conv_id"], cut, ["turn"], "role", "_prev")
    starts = F.when(F.col("_prev").eqNullSafe(F.col("role")), 0).otherwise(1).cast("bigint")
    rows = running_total(rows, ["conv_id"], cut, ["turn"], starts, "place", inclusive=True)
    listed = lambda sep: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text), sep
    )
    merged = rows.groupBy("conv_id", "place", "role").agg(listed("\n\n").alias("content"))
    system = turns.where("role = 'system'").groupBy("conv_id").agg(listed("\n").alias("content")).select(
        "conv_id", F.lit(0).cast("bigint").alias("place"), F.lit("system").alias("role"), "content"
    )
    messages = merged.unionByName(system)
    if limits is None:
        return messages
    asked = limits.groupBy("conv_id").agg(F.max("max_tokens").alias("max_tokens"))
    return messages.join(asked, "conv_id", "left").withColumn("max_tokens", default_max_tokens("max_tokens"))


def default_max_tokens(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit(fixed.DEFAULT_MAX_TOKENS))


def fold_provider_events(events: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """One row per message of (msg_id, seq, type, message, delta, usage) events.

    Texts are joined in order of ``seq``; the last reported output count and stop reason count. A count
    of zero is replaced by an estimate, from the answer or from ``prompts`` (msg_id, text).
    """
    is_delta = F.col("type") == "content_block_delta"
    out_at = F.when((F.col("type") == "message_delta") & F.col("usage.output_tokens").isNotNull(), F.col("seq"))
    stop_at = F.when(
        (F.col("type") == "message_delta") & (F.coalesce("delta.stop_reason", F.lit("")) != ""), F.col("seq")
    )
    start_at = F.when(F.col("type") == "message_start", F.col("seq"))
    piece = F.when(is_delta, F.struct("seq", F.coalesce("delta.text", F.lit("")).alias("text")))
    folded = events.groupBy("msg_id").agg(
        F.coalesce(F.max_by("message.usage.input_tokens", start_at), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.max_by("usage.output_tokens", out_at), F.lit(0)).alias("output_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.text), "").alias("text"),
        F.max_by("delta.stop_reason", stop_at).alias("stop_reason"),
        F.max(F.col("type") == "message_stop").alias("finished"),
    )
    if prompts is not None:
        folded = folded.join(prompts.select("msg_id", F.col("text").alias("_prompt")), "msg_id", "left")
    else:
        folded = folded.withColumn("_prompt", F.lit(""))
    reported = lambda n, text: F.when(F.col(n) > 0, F.col(n)).otherwise(token_estimate(text))
    return folded.select(
        "msg_id", reported("input_tokens", F.coalesce("_prompt", F.lit(""))).alias("prompt_tokens"),
        reported("output_tokens", F.col("text")).alias("completion_tokens"), "text",
        finish_reason(F.col("stop_reason")).alias("finish_reason"), "finished",
    )
