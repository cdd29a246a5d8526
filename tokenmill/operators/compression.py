"""Prompt compression by method, and the word-budget compressor."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.text import SPACES, compress_log_text, telegraphic, token_estimate, word_count
from tokenmill.operators.sizes import at_most
from tokenmill.session import stage

HOT_SHARE = 1_000
MAX_HOT_WORDS = 200_000
FORCED = frozenset(fixed.FORCED_TOKENS)
# a run of other signs, or one mark; all whitespace but the line feed only parts words
TOKEN = re.compile("[^{0}{1}]+|[\n{1}]".format(re.escape(SPACES), re.escape("".join(m for m in fixed.FORCED_TOKENS if m != "\n"))))
# the token functions travel to the workers themselves, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def compression_gate(text: Column, method: str, model_loaded: bool = True) -> Column:
    """Why a prompt is left alone, or null."""
    if method == "disabled":
        return F.lit("Compression disabled")
    if method not in ("llmlingua", "rtk+llmlingua"):
        return F.lit(None).cast("string")
    if not model_loaded:
        return F.lit("Compressor not loaded")
    short = (F.length(text) < fixed.MIN_CHARS) | (word_count(text) < fixed.MIN_WORDS)
    return F.when(short, "Prompt too short for compression")


def compress(
    prompts: DataFrame, method: str, intensity: str = "full", text: str = "text", row_id: str = "doc_id",
    rate: float = fixed.DEFAULT_RATE, model_loaded: bool = True,
) -> DataFrame:
    """Adds ``compressed_text`` and the figures of the compression.

    Methods: disabled, rtk (log lines), caveman (telegraphic), stacked (both), llmlingua (word budget)
    and rtk+llmlingua. The token counts of the last are those of the untouched prompt and the end
    result, and ``rtk_tokens`` those in between.
    """
    method = method.lower()
    reason = compression_gate(F.col(text), method, model_loaded)
    rows = prompts.withColumn("reason", reason).withColumn("bypassed", F.col("reason").isNotNull())
    if method == "disabled":
        rows = rows.withColumn("_out", F.col(text))
    elif method == "rtk":
        rows = compress_log_text(rows, text, "_out")
    elif method == "caveman":
        rows = rows.withColumn("_out", telegraphic(F.col(text), intensity))
    elif method == "stacked":
        rows = compress_log_text(rows, text, "_rtk")
        rows = rows.withColumn("_out", telegraphic(F.col("_rtk"), intensity)).drop("_rtk")
    elif method in ("llmlingua", "rtk+llmlingua"):
        rows = _budgeted(rows, method, text, row_id, rate)
    else:
        raise ValueError(f"unknown compression method: {method}")
    label = f"{method}_{intensity}" if method in ("caveman", "stacked") else method
    out = F.when(F.col("bypassed") | (F.col(text) == ""), F.col(text)).otherwise(F.col("_out"))
    return (
        rows.withColumn("compressed_text", out)
        .withColumn("method", F.lit(label))
        .withColumn("original_tokens", token_estimate(F.col(text)))
        .withColumn("compressed_tokens", token_estimate(F.col("compressed_text")))
        .withColumn("ratio", F.when(F.col("original_tokens") > 0,
                                    F.col("compressed_tokens") / F.col("original_tokens")).otherwise(1.0))
        .drop("_out")
    )


def method_figures(prompts: DataFrame, text: str = "text", row_id: str = "doc_id", rate: float = fixed.DEFAULT_RATE) -> DataFrame:
    """The figures of ``compress`` by every method: method, reason, bypassed, original_tokens, compressed_tokens, ratio.

    Steps that methods share are done once for all of them: the log filter, the words of a prompt, and whatever is made
    of a prompt that the log filter leaves as it is.
    """
    rows = compress_log_text(prompts.select(F.col(row_id).alias("_d"), F.col(text).alias("_prompt")), "_prompt", "_rtk")
    rows = rows.withColumn("_same", F.col("_rtk").eqNullSafe(F.col("_prompt")))
    rows = stage(rows.select("_d", "_prompt", F.when(~F.col("_same"), F.col("_rtk")).alias("_rtk"), "_same",
                             compression_gate(F.col("_prompt"), "llmlingua").alias("_reason")), "rtk")
    tokens = rows.select(
        "_d", "_same", "_rtk", "_reason", token_estimate(F.col("_prompt")).alias("_n"),
        token_estimate(F.col("_rtk")).alias("_n_rtk"), token_estimate(telegraphic(F.col("_prompt"))).alias("_n_short"))
    either = lambda changed, plain: F.when(F.col("_same"), F.col(plain)).otherwise(changed)
    tokens = stage(tokens.select(
        "_d", "_reason", "_n", either(F.col("_n_rtk"), "_n").alias("_n_rtk"), "_n_short",
        either(token_estimate(telegraphic(F.col("_rtk"))), "_n_short").alias("_n_stacked")), "tokens")
    long = rows.where("_reason IS NULL").select("_d", "_prompt", "_rtk")
    small = stage(_rarest(long, rate).select("_d", token_estimate(F.col("_text0")).alias("_n0"), token_estimate(F.col("_text1")).alias("_n1")), "kept")
    budgeted = tokens.join(small, "_d", "left")
    unless = lambda n, out: F.when(F.col("_reason").isNotNull(), F.col("_n")).otherwise(F.coalesce(n, out))
    made = lambda method, n, reason=None: F.struct(
        F.lit(method).alias("method"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
        F.col("_n").alias("original_tokens"), (F.col(n) if isinstance(n, str) else n).alias("compressed_tokens"))
    gate, prompt = compression_gate, F.col("_n")
    plain = tokens.select(F.inline(F.array(
        made("disabled", prompt, gate(prompt, "disabled")), made("llmlingua", prompt, gate(prompt, "llmlingua", False)),
        made("rtk", "_n_rtk"), made("caveman_full", "_n_short"), made("stacked_full", "_n_stacked"))))
    words = budgeted.select(F.inline(F.array(
        made("llmlingua", unless(F.col("_n0"), prompt), F.col("_reason")), made("rtk+llmlingua", unless(F.col("_n1"), F.col("_n_rtk")), F.col("_reason")))))
    ratio = F.when(F.col("original_tokens") > 0, F.col("compressed_tokens") / F.col("original_tokens")).otherwise(1.0)
    return plain.unionByName(words).select(
        "method", "reason", F.col("reason").isNotNull().alias("bypassed"), "original_tokens", "compressed_tokens", ratio.alias("ratio"))


def _budgeted(rows: DataFrame, method: str, text: str, row_id: str, rate: float) -> DataFrame:
    """Only prompts that pass the gate are split into words."""
    source = text
    if method == "rtk+llmlingua":
        # written, as the steps below read it several times and its expression is large
        rows, source = stage(compress_log_text(rows, text, "_rtk"), "rtk"), "_rtk"
        rows = rows.withColumn("rtk_tokens", token_estimate(F.col("_rtk")))
    long = rows.where(~F.col("bypassed")).select(row_id, F.col(source).alias("text"))
    shorter = compress_budgeted(long, rate, "text", row_id).select(row_id, F.col("compressed_text").alias("_out"))
    return rows.join(shorter, row_id, "left").withColumn("_out", F.coalesce("_out", F.col(source))).drop("_rtk")


def compress_budgeted(
    docs: DataFrame, rate: float = fixed.DEFAULT_RATE, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """Keep ``rate`` of each text's tokens, the rarest of the corpus first, in their own order.

    Tokens are words and punctuation marks; marks of the forced list always stay. Rarity is the number
    of texts with the token, so no model is needed. Words that more than a ``HOT_SHARE``-th as many texts
    have as the commonest word are few, however many texts there are; their counts go to every task (if the check agrees).
    Only a text's other words meet their counts in a join and come back to it as a list, each word once. The tokens
    themselves are never rows.
    """
    small = _rarest(docs.select(F.col(row_id).alias("_d"), F.col(text).alias("_t")), rate)
    return small.toDF(row_id, "compressed_text", "tokens", "kept")


def _rarest(listed: DataFrame, rate: float) -> DataFrame:
    """(_d, texts) -> _d, then text, tokens and kept of each column of texts, by the counts of its own column.

    A null beyond the first column stands for the first column's text, which is then counted and split once for both.
    """
    key = listed.schema["_d"].dataType.simpleString()
    texts = listed.columns[1:]
    n = [f"_n{i}" for i in range(len(texts))]
    numbers = ", ".join(f"{c} bigint" for c in n)
    counted = listed.select(texts).mapInArrow(_counted, f"_w string, {numbers}")
    frequency = stage(counted.groupBy("_w").agg(*[F.sum(c).alias(c) for c in n]), "word-counts")
    top = frequency.agg(*[F.max(c).alias(c) for c in n]).first()
    hot = frequency.where(reduce(or_, [F.col(c) > (top[c] or 0) // HOT_SHARE for c in n]))
    common = {r["_w"]: [r[c] for c in n] for r in hot.collect()} if at_most(hot, MAX_HOT_WORDS) else {}
    known = listed.sparkSession.sparkContext.broadcast(common)
    rare = listed.mapInArrow(_others(known), f"_d {key}, _w string").join(frequency, "_w").groupBy("_d").agg(
        F.collect_list(F.struct("_w", *n)).alias("_rare"))
    weighed = listed.join(rare, "_d", "left").select("_d", *texts, "_rare._w", *[f"_rare.{c}" for c in n])
    each = "".join(f", _text{i} string, _tokens{i} int, _kept{i} bigint" for i in range(len(texts)))
    return weighed.mapInArrow(_kept(known, rate, len(texts)), f"_d {key}{each}")


def _words(text: str | None) -> list[str]:
    return [] if text is None else TOKEN.findall(text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that are not forced, with the number of the batch's texts that have them, for each column of texts."""
    for b in batches:
        first = b.column(0).to_pylist()
        counts = [Counter(chain.from_iterable(set(_words(t)) for t in first))]
        for column in b.columns[1:]:
            counts.append(counts[0].copy())
            for t, u in zip(first, column.to_pylist()):
                if u is not None:
                    counts[-1].subtract(set(_words(t)))
                    counts[-1].update(set(_words(u)))
        words = set().union(*counts) - FORCED
        yield pa.record_batch({"_w": pa.array(words, pa.string())} | {
            f"_n{i}": pa.array([c[w] for w in words], pa.int64()) for i, c in enumerate(counts)})


def _others(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's words that are not ``known``, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = FORCED.union(known.value)
        for b in batches:
            found = [set(chain.from_iterable(map(_words, row))) - skip for row in zip(*(c.to_pylist() for c in b.columns[1:]))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.record_batch({"_d": b.column("_d").take(rows), "_w": pa.array(chain.from_iterable(found), pa.string())})

    return run


def _kept(known: Broadcast, rate: float, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of their rarest tokens. Forced marks have no count and sort first, which takes them out of the budget."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {**known.value, **dict.fromkeys(FORCED, [0] * columns)}
        for b in batches:
            out = {f"_{c}{i}": [] for i in range(columns) for c in ("text", "tokens", "kept")}
            for row in zip(*(c.to_pylist() for c in b.columns[1:])):
                words, first = row[columns] or (), None
                for i in range(columns):
                    tokens = first if i and row[i] is None else _words(row[i])
                    first = tokens if first is None else first
                    rare = dict(zip(words, row[columns + 1 + i] or ()))
                    weights = np.array([common[w][i] if w in common else rare[w] for w in tokens], dtype=np.int64)
                    n = max(math.ceil(len(tokens) * rate), int((weights == 0).sum()))
                    places = np.sort(np.argsort(weights, kind="stable")[:n]).tolist()
                    out[f"_text{i}"].append(" ".join([tokens[j] for j in places]))
                    out[f"_tokens{i}"].append(len(tokens))
                    out[f"_kept{i}"].append(len(places))
            types = {"_text": pa.string(), "_tokens": pa.int32(), "_kept": pa.int64()}
            yield pa.record_batch({"_d": b.column("_d")} | {c: pa.array(v, types[c.rstrip("0123456789")]) for c, v in out.items()})

    return run
