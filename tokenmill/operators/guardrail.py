"""Unsafe phrases in prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.operators.sizes import at_most

INLINE_PHRASES = 100
GRAM = 8
INLINE_GRAMS = 5_000


def guardrail_keywords(prompts: DataFrame, dynamic: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Adds ``blocked`` and ``phrase``, the first phrase found: dynamic ones by name, then the fixed list.

    ``dynamic`` has a ``keyword`` column. A short list becomes one expression over the lower-cased
    text. A longer one is matched by shared letter groups, see ``_phrases_by_gram``.
    """
    words = dynamic.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    some = words.limit(INLINE_PHRASES + 1).collect()
    low = F.col("_low")
    fixed_hit = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in fixed.UNSAFE_PHRASES])
    rows = prompts.withColumn("_low", F.lower(text))
    if len(some) <= INLINE_PHRASES:
        listed = sorted((r.keyword for r in some), key=lambda w: w.encode())
        hits = [F.when(low.contains(p), F.lit(p)) for p in listed]
        phrase = F.coalesce(*hits, fixed_hit)
    else:
        first = _phrases_by_gram(rows.select(row_id, "_low"), words, row_id)
        rows = rows.join(first, row_id, "left")
        phrase = F.coalesce(F.col("_dynamic"), fixed_hit)
    return (
        rows.withColumn("phrase", phrase).withColumn("blocked", F.col("phrase").isNotNull())
        .select(*prompts.columns, "blocked", "phrase")
    )


def _phrases_by_gram(texts: DataFrame, words: DataFrame, row_id: str) -> DataFrame:
    """First phrase per text for any number of phrases, without a broadcast.

    A text can only contain a phrase if it contains the phrase's first letters. Texts and phrases
    meet on that letter group (shorter phrases on their full length), and only then is the whole
    phrase looked for. Repeated groups of a text are dropped before the join. Each match is one row,
    reduced to the smallest phrase per text before the shuffle. Up to ``INLINE_GRAMS`` phrases, the
    groups that no phrase starts with are already dropped in the text's own row. Common letter groups
    make skewed join partitions, which adaptive execution splits.
    """
    sized = words.withColumn("_n", F.least(F.length("keyword"), F.lit(GRAM)))
    lengths = [r[0] for r in sized.select("_n").distinct().collect()]  # at most GRAM values
    keyed = sized.select("keyword", F.substr("keyword", F.lit(1), F.col("_n")).alias("_gram"))

    # a look-ahead of n letters at every place lists all groups in one pass
    groups = [F.regexp_extract_all("_low", F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) for n in lengths]
    grams = F.array_distinct(F.concat(*groups))
    if at_most(keyed, INLINE_GRAMS):
        known = F.array(*[F.lit(r[0]) for r in keyed.select("_gram").distinct().collect()])
        grams = F.array_intersect(F.concat(*groups), known)
    near = (
        texts.select(row_id, F.explode(grams).alias("_gram")).join(keyed, "_gram").select(row_id, "keyword")
        .join(texts, row_id).where(F.col("_low").contains(F.col("keyword")))
    )
    return near.groupBy(row_id).agg(F.min("keyword").alias("_dynamic"))


def keyword_set(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The keyword set after additions and removals; keywords are trimmed."""
    trimmed = lambda df: df.select(F.trim("keyword").alias("keyword")).where("keyword <> ''")
    return trimmed(current).union(trimmed(added)).distinct().join(trimmed(removed).distinct(), "keyword", "left_anti")
