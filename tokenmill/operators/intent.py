"""Intent of prompts: keyword override, then a trained classifier. Also the embedding stage."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import WS, code_override, normalise_prompt, plain_spaces
from tokenmill.session import stage

# the counting function travels to the workers itself, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SMOOTHING = 0.1
UNIT = 1_000_000  # scores are whole millionths of natural logarithms, so that their sums are exact
SMALL_MODEL = 1_000_000  # grams of a model that is broadcast
MAX_INTENTS = 1_000
PART_BYTES = 4 << 20  # of samples whose grams meet in one task
SLICE = 1_000  # texts whose grams are counted or met at once
HOT_WEIGHTS = 1_000_000  # weights of common grams that every task gets


@dataclass(frozen=True)
class IntentModel:
    """Naive Bayes over words and neighbouring pairs of words, as a table.

    ``grams`` has a row per gram: gram, counts and weights (one of each per intent, in the order of ``intents``).
    ``priors`` are the scores before the first word. The table may be of any size; only a row per intent is on the driver.
    """

    intents: list[str]
    priors: list[int]
    grams: DataFrame
    small: bool

    def table(self) -> DataFrame:
        """intent, gram, n and weight, for the grams that samples of the intent have."""
        every = F.arrays_zip(F.array(*map(F.lit, self.intents)).alias("intent"), F.col("counts").alias("n"), F.col("weights").alias("weight"))
        return self.grams.select("gram", F.inline(every)).where("n > 0").select("intent", "gram", "n", "weight")


def training_samples(*sources: DataFrame | None) -> DataFrame | None:
    """The first source with rows (file, then table); None where there is none."""
    for s in sources:
        if s is not None and not s.isEmpty():
            return s.select("intent", "sample_text")
    return None


def train_intent(samples: DataFrame | None) -> IntentModel | None:
    """Counts each intent's grams and turns the counts into weights.

    Counts are summed before the shuffle, so a common word costs a row per ``SLICE`` samples. The parts of that shuffle are as
    many as the size of the samples asks for, so the grams that a task holds don't grow with them. Samples without an intent teach
    nothing; a sample without words counts for its intent's prior alone. Without a sample there is no model.
    """
    if samples is None:
        return None
    labelled = samples.where("intent IS NOT NULL").select("intent", "sample_text")
    sizes = labelled.groupBy("intent").agg(F.count("*").alias("count"), F.sum(F.octet_length("sample_text")).alias("bytes"))
    sizes = sizes.orderBy("intent").limit(MAX_INTENTS + 1).collect()
    if len(sizes) > MAX_INTENTS:
        raise ValueError(f"more than {MAX_INTENTS} intents")
    if not sizes:
        return None
    intents, rows = [r.intent for r in sizes], sum(r["count"] for r in sizes)
    cores = samples.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-sum(r["bytes"] or 0 for r in sizes) // PART_BYTES))
    each = labelled.select("intent", _clean(F.col("sample_text")).alias("text")).mapInArrow(_counted, "intent string, gram string, n bigint")
    of = lambda i: F.coalesce(F.sum(F.when(F.col("intent") == i, F.col("n"))), F.lit(0))
    counts = each.repartition(parts, "gram").groupBy("gram").agg(F.array(*map(of, intents)).alias("counts"))
    counts = stage(counts, "intent-counts")
    sums = counts.agg(F.count("*").alias("grams"), *[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(len(intents))]).first()
    totals = F.array(*[F.lit((sums[f"n{i}"] or 0) + SMOOTHING * sums["grams"]) for i in range(len(intents))])
    weight = lambda n, i: F.round(F.ln((n + SMOOTHING) / F.get(totals, i)) * UNIT).cast("bigint")
    priors = [round(math.log(r["count"] / rows) * UNIT) for r in sizes]
    return IntentModel(intents, priors, counts.withColumn("weights", F.transform("counts", weight)), sums["grams"] <= SMALL_MODEL)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often some samples of each intent have each of their grams."""
    for b in batches:
        for part in (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE)):
            rows, found = _grams_of(part.column("text"))
            grams = pa.table({"intent": part.column("intent").take(pa.array(rows)), "gram": found})
            counts = grams.group_by(["intent", "gram"]).aggregate([([], "count_all")])
            yield from counts.rename_columns(["intent", "gram", "n"]).combine_chunks().to_batches()


def retrain(file: DataFrame | None, table: DataFrame | None) -> IntentModel | None:
    return train_intent(training_samples(file, table))


def _clean(text: Column) -> Column:
    return plain_spaces(normalise_prompt(text))


def _grams_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The grams of some cleaned texts as in ``_grams``, each with the place of its text."""
    split = pc.split_pattern(texts, " ")
    words, rows = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    some = pc.not_equal(words, "")
    words, rows = words.filter(some), rows[some.to_numpy(zero_copy_only=False)]
    inside = rows[1:] == rows[:-1]
    pairs = pc.binary_join_element_wise(words[:-1].filter(pa.array(inside)), words[1:].filter(pa.array(inside)), " ")
    return np.concatenate([rows, rows[:-1][inside]]), pa.concat_arrays([words, pairs])


def _grams(text: Column) -> Column:
    """Words and neighbouring pairs of words of the cleaned text."""
    words = F.filter(F.split(_clean(text), " +"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.coalesce(F.concat(words, F.array_compact(pairs)), F.array().cast("array<string>"))


def untrained_intent(text: Column) -> Column:
    """The intent where there is no model: code where the keyword rule says so, else general."""
    return F.when(F.coalesce(code_override(text), F.lit(False)), F.lit("code")).otherwise(F.lit("general"))


def intent_labels(prompts: DataFrame, model: IntentModel | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, intent): code where the keyword rule says so, else the model's label, else general.

    Grams that no sample has say nothing; a text without known grams gets the most frequent intent, and of
    equal scores the first intent by name counts. Grams meet the model by a broadcast where its size allows, and
    a text's scores are summed before they are shuffled, so no text is moved. Of a larger model every task gets the commonest
    grams, whose weights are summed in place, and only a text's other grams meet the model in a join, each once. Texts that
    the keyword rule decides are not scored. ``row_id`` names a text: rows with one id must have one text.
    """
    if model is None:
        return prompts.select(row_id, untrained_intent(F.col(text)).alias("intent"))
    override = F.when(F.coalesce(code_override(F.col(text)), F.lit(False)), F.lit("code"))
    decided = prompts.select(row_id, override.alias("_override"))
    open_text = F.when(override.isNull(), F.col(text))
    if model.small:
        grams = F.broadcast(model.grams.select("gram", "weights"))
        met = prompts.select(row_id, F.explode(_grams(open_text)).alias("gram")).join(grams, "gram")
    else:
        met = _met(prompts.select(F.col(row_id), _clean(open_text).alias("text")), model, row_id)
    sums = met.groupBy(row_id).agg(F.array(*[F.sum(F.col("weights")[i]) for i in range(len(model.intents))]).alias("_sums"))
    scores = [
        F.struct((F.lit(p) + F.coalesce(F.col("_sums")[i], F.lit(0))).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("intent"))
        for i, (p, name) in enumerate(zip(model.priors, model.intents))
    ]
    best = F.array_max(F.array(*scores))["intent"]
    return decided.join(sums, row_id, "left").select(row_id, F.coalesce("_override", best).alias("intent"))


def _met(texts: DataFrame, model: IntentModel, row_id: str) -> DataFrame:
    """(row_id, weights): of a text's common grams together, and of each other gram times its count."""
    k = len(model.intents)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    most = max(1, HOT_WEIGHTS // k)
    sizes = model.grams.groupBy(total.alias("total")).count().orderBy(F.desc("total")).limit(most).collect()
    grams = np.cumsum([r["count"] for r in sizes])
    least = sizes[int((grams <= most).sum()) - 1].total if len(grams) and grams[0] <= most else None
    common = model.grams.where(F.lit(False) if least is None else total >= least).select("gram", "weights").toArrow()
    weights = np.array(common.column("weights").combine_chunks().flatten(), dtype=np.int64).reshape(-1, k)
    hot = texts.sparkSession.sparkContext.broadcast((common.column("gram").combine_chunks(), weights))
    key = texts.schema[row_id].dataType.simpleString()
    found = texts.select(F.col(row_id).alias("_d"), "text").mapInArrow(_summed(hot), f"_d {key}, gram string, n bigint, sums array<bigint>")
    each = found.join(model.grams.select("gram", "weights"), "gram", "left").where("weights IS NOT NULL OR sums IS NOT NULL")
    return each.select(F.col("_d").alias(row_id), F.coalesce("sums", F.transform("weights", lambda w: w * F.col("n"))).alias("weights"))


def _summed(hot: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the weights of each text's common grams, and its other grams with their counts. The sums stand under a gram
    that no text has, one for each id, so that they spread over the parts of the join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weights = hot.value
        for b in batches:
            for part in (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE)):
                rows, grams = _grams_of(part.column("text"))
                coded = grams.dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary
                place = pc.fill_null(pc.index_in(names, value_set=common), -1).to_numpy()[codes]
                known = place >= 0
                # whole millionths: their sums are exact as doubles, too
                sums = [np.bincount(rows[known], weights[place[known], i], part.num_rows) for i in range(weights.shape[1])]
                some = np.unique(rows[known])
                flat = np.column_stack(sums)[some].astype(np.int64)
                other, n = np.unique(rows[~known] * max(1, len(names)) + codes[~known], return_counts=True)
                row, code = np.divmod(other, max(1, len(names)))
                ids = part.column("_d").take(pa.array(np.concatenate([row, some])))
                own = pc.binary_join_element_wise("", pc.cast(ids.slice(len(row)), pa.string()), " ", null_handling="replace")
                ends = np.concatenate([np.zeros(len(row)), np.arange(len(some) + 1) * flat.shape[1]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.arange(len(ends)) < len(row)), pa.array(flat.ravel()))
                yield pa.record_batch({
                    "_d": ids, "gram": pa.concat_arrays([names.take(pa.array(code)), own]),
                    "n": pa.array(np.concatenate([n, np.ones(len(some), np.int64)])), "sums": lists})

    return run


def classify_intent(prompts: DataFrame, model: IntentModel | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``prompts`` with ``intent``; see ``intent_labels``."""
    return prompts.join(intent_labels(prompts, model, text, row_id), row_id).select(*prompts.columns, "intent")


# ------------------------------------------------------------------------------------- embeddings
def fit_embedder(prompts: DataFrame, text: str = "text", dimension: int = 384) -> PipelineModel:
    """Hashed words with their rarity in ``prompts``; fit once, so that queries and entries share one space."""
    stages = [
        RegexTokenizer(inputCol="_clean", outputCol="_words", pattern=rf"[{WS}]+"),
        HashingTF(numFeatures=dimension, inputCol="_words", outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec"),
    ]
    return Pipeline(stages=stages).fit(prompts.select(normalise_prompt(F.col(text)).alias("_clean")))


def embed(prompts: DataFrame, model: PipelineModel | None = None,
          encode: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text") -> DataFrame:
    """Adds ``embedding``, a unit vector: by the given encoder, else by a model of ``fit_embedder``.

    ``encode`` gets a batch of texts inside the executors; load its weights lazily in there. A vector of
    zeros stays as it is.
    """
    if encode is not None:
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            rows = [np.asarray(v, dtype=float) for v in encode(s.tolist())]
            return pd.Series([(v / (np.linalg.norm(v) or 1.0)).tolist() for v in rows])

        return prompts.withColumn("embedding", run(text))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(prompts.withColumn("_clean", normalise_prompt(F.col(text))))
    return out.withColumn("embedding", vector_to_array("_vec").cast("array<float>")).select(*prompts.columns, "embedding")


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column, Column], Column]:
    """A logit for ``semantic_lookup`` from a batch function over (query, candidate) texts."""

    @F.pandas_udf("double")
    def run(q: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), e.tolist()), dtype="float64")

    return lambda q, e, dist: run(q, e)
