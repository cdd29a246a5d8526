"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import (
    divergence, exact_dedup, hmm, jaccard, leaks, licenses, mixing, packing, quality, runs, suffixes, toxicity, warc,
)
from tokenmill.llm.common import input_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark, d):
    records = warc.round_trip(input_table(spark, d, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query
def op2_hmm(spark, d):
    return hmm.score_texts(input_table(spark, d, "documents"))


@query
def op3_toxicity(spark, d):
    docs = input_table(spark, d, "documents")
    return toxicity.severities(docs, toxicity.fit(docs, input_table(spark, d, "labels")))


@query
def op4_quality(spark, d):
    return quality.judge(input_table(spark, d, "documents"))


@query
def op5_exact_dedup(spark, d):
    groups = exact_dedup.exact_groups(input_table(spark, d, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op6_source_mix(spark, d):
    return mixing.taken_words(input_table(spark, d, "documents"))


@query
def op7_packing(spark, d):
    return packing.pack_documents(input_table(spark, d, "documents"))


@query
def op8_licenses(spark, d):
    found = licenses.scan(input_table(spark, d, "documents"))
    return found.select("doc_id", "license", "first_sentence", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"))


@query
def op9_suffix_dedup(spark, d):
    return suffixes.remove_repeats(input_table(spark, d, "documents"))


@query
def op10_jaccard(spark, d):
    groups = jaccard.near_groups(input_table(spark, d, "documents"), jaccard.Join(4, 85))
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op11_divergence(spark, d):
    return divergence.divergences(input_table(spark, d, "documents"))


@query
def op12_decontamination(spark, d):
    found = leaks.find_leaks(input_table(spark, d, "documents"), input_table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op13_runs(spark, d):
    found = runs.run_report(runs.periodic_runs(input_table(spark, d, "documents"), order=runs.repeated_tail))
    return found.drop("n_words")
