"""Similarity lookup with rule validation: nearest cached prompts within a radius.

The neighbour join is exact. Both sides are split by the nearest of a few pivot vectors; by the
triangle inequality an entry can only match queries of a cell if it lies no further from the cell's
pivot than the cell's outermost query plus the radius, so it is sent to those cells alone. Cells with
many rows are cut into blocks on both sides. Where the cells keep little apart, as in vectors that point
everywhere, there is only one. A task bounds the distances of a query block and an entry block in single
precision, computes those exactly that may count, and keeps ``k`` rows per query; pairs are never emitted.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import passes_score
from tokenmill.functions.text import digit_signature, toggle_signature

QUERY_BLOCK = 8_192
ENTRY_BLOCK = 32_768
CHUNK = 512  # queries multiplied at once inside a task
# the block functions travel to the workers themselves, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SLACK = 1e-6  # keeps rounding from pruning a pair that lies exactly on the radius


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors; the square is twice the cosine distance."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _to_pivots(vectors: pd.Series, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Distances of a batch to all pivots, some rows at once: with many pivots those of a whole batch would be large."""
    m = _unit(vectors)
    for at in range(0, len(m), CHUNK):
        yield _chord(m[at:at + CHUNK], pivots)


def _home_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``reach``, the nearest pivot and the distance to it."""

    @F.pandas_udf("cell int, reach double")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            near = [(d.argmin(axis=1), d.min(axis=1)) for d in _to_pivots(v, pivots)]
            cell, reach = (np.concatenate(x) for x in zip(*near))
            yield pd.DataFrame({"cell": cell.astype("int32"), "reach": reach})

    return df.withColumn("_h", home("embedding")).select("*", "_h.cell", "_h.reach").drop("_h")


def _target_cells(df: DataFrame, pivots: np.ndarray, bounds: dict[int, float]) -> DataFrame:
    """One row per cell that the entry may have to meet."""
    limit = np.array([bounds.get(i, -1.0) for i in range(len(pivots))])

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([np.flatnonzero(row).astype("int32") for d in _to_pivots(v, pivots) for row in d <= limit])

    return df.select("entry_id", "embedding", F.explode(cells("embedding")).alias("cell"))


def may_be_near(q: np.ndarray, e: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``e``) that can be among the ``k`` nearest within ``radius``; unit vectors.

    A product in single precision, at half the cost, is off by no more than the rounding of its
    terms, so it bounds the distance from below. Pairs beyond the radius, or surely behind ``k`` others, are out.
    """
    error = (q.shape[1] + 4) * 2.0**-23  # of a sum of products whose absolute values add up to 1 at most, and of their factors
    near = q.astype(np.float32) @ e.astype(np.float32).T
    least = np.full(len(q), 1.0 - radius - 1e-9)
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - error - 2e-9)
    return np.nonzero(near >= (least - error)[:, None].astype(np.float64))


def _block_top_k(k: int, radius: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def top_k(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(e):
            qv, ev, ids = _unit(q["embedding"]), _unit(e["embedding"]), e["entry_id"].to_numpy()
            for at in range(0, len(q), CHUNK):
                row, col = may_be_near(qv[at:at + CHUNK], ev, k, radius)
                d = np.round(1.0 - np.einsum("ij,ij->i", qv[at + row], ev[col]), 9)
                order = np.lexsort((ids[col], d, row))
                row, col, d = row[order], col[order], d[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                kept = (nth < k) & (d <= radius)
                found.append(pd.DataFrame({
                    "query_id": q["query_id"].to_numpy()[at + row[kept]], "entry_id": ids[col[kept]], "dist": d[kept],
                }))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "entry_id": [], "dist": []})

    return top_k


def nearest_within(
    queries: DataFrame, entries: DataFrame, k: int, radius: float, pivots: int | None = None,
    query_block: int = QUERY_BLOCK, entry_block: int = ENTRY_BLOCK,
) -> DataFrame:
    """(query_id, entry_id, dist, nth): up to ``k`` nearest entries of each query within ``radius``.

    ``dist`` is the cosine distance at nine places; equal distances are ordered by entry.
    """
    schema = "query_id bigint, entry_id bigint, dist double"
    spark = queries.sparkSession
    empty = spark.createDataFrame([], schema + ", nth int")
    chosen = pivots is None
    if chosen:  # more cells for more entries, but never many vectors on the driver
        pivots = min(max(int(entries.count() ** 0.5) // 8, 16), 2048)
    # a fixed number of vectors, picked by hash so that a rerun picks the same ones
    picked = entries.select("embedding", F.xxhash64("entry_id").alias("_o")).orderBy("_o").limit(pivots).collect()
    if not picked:
        return empty
    centre = _unit(pd.Series([np.array(r.embedding) for r in picked]))
    q = _home_cells(queries.select("query_id", "embedding"), centre)
    # per cell: at most one row per pivot comes back
    cells = {r.cell: r for r in q.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("far")).collect()}
    if not cells:
        return empty
    chord_radius = float(np.sqrt(2.0 * radius))
    e = _target_cells(entries, centre, {c: r.far + chord_radius + SLACK for c, r in cells.items()})
    entry_counts = {r.cell: r["count"] for r in e.groupBy("cell").count().collect()}
    if chosen and 2 * sum(entry_counts.values()) > len(cells) * entries.count():
        # most entries may meet most cells: one cell, so that an entry is sent once to each block of queries
        return nearest_within(queries, entries, k, radius, 1, query_block, entry_block)
    parts = lambda n, size: max(1, -(-int(n) // size))
    met = [(c, parts(r.n, query_block), parts(entry_counts[c], entry_block)) for c, r in cells.items() if c in entry_counts]
    if not met:
        return empty
    # at most one row per pivot, so it is small
    blocks = F.broadcast(spark.createDataFrame(met, "cell int, q_parts int, e_parts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q_blocks = q.join(blocks, "cell").select(
        "cell", mine("query_id", "q_parts").alias("qb"), every("e_parts").alias("eb"), "query_id", "embedding"
    )
    e_blocks = e.join(blocks, "cell").select(
        "cell", every("q_parts").alias("qb"), mine("entry_id", "e_parts").alias("eb"), "entry_id", "embedding"
    )
    block = ["cell", "qb", "eb"]
    found = (
        q_blocks.groupBy(*block).cogroup(e_blocks.groupBy(*block))
        .applyInPandas(_block_top_k(k, radius), schema)
    )
    order = Window.partitionBy("query_id").orderBy("dist", "entry_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _cutoff(threshold: float) -> float:
    return max(2.0 * threshold, 0.25)


def _rule_pairs(
    queries: DataFrame, entries: DataFrame, threshold: float, logit: Callable[[Column, Column, Column], Column] | None,
    **blocks: int,
) -> DataFrame:
    """Near pairs with equal digits and equal toggle words that the scorer, or the distance, accepts."""
    near = nearest_within(queries, entries, 3, _cutoff(threshold), **blocks)
    sides = lambda df, key, p: df.select(
        key, F.col("prompt").alias(p), digit_signature(F.col("prompt")).alias(f"{p}_digits"),
        toggle_signature(F.col("prompt")).alias(f"{p}_toggles"),
    )
    pairs = (
        near.join(sides(queries, "query_id", "q"), "query_id").join(sides(entries, "entry_id", "e"), "entry_id")
        .where("q_digits = e_digits AND q_toggles = e_toggles")
    )
    if logit is None:
        return pairs.where(F.col("dist") <= threshold)
    return pairs.where(passes_score(logit(F.col("q"), F.col("e"), F.col("dist"))))


def semantic_lookup(
    queries: DataFrame, entries: DataFrame, threshold: float = 0.1,
    logit: Callable[[Column, Column, Column], Column] | None = None, **blocks: int,
) -> DataFrame:
    """(query_id, entry_id, dist) of each query's first accepted candidate among its three nearest.

    ``logit`` scores (query prompt, entry prompt, distance), for instance by a pandas UDF around a
    model; the cheap rules run first. Without it the answer is ``semantic_lookup_simple``.
    """
    if logit is None:
        return semantic_lookup_simple(queries, entries, threshold, **blocks)
    pairs = _rule_pairs(queries, entries, threshold, logit, **blocks)
    return pairs.groupBy("query_id").agg(F.min_by(F.struct("entry_id", "dist"), "nth").alias("_b")).select(
        "query_id", "_b.*"
    )


def semantic_lookup_simple(queries: DataFrame, entries: DataFrame, threshold: float = 0.1, **blocks: int) -> DataFrame:
    """The single nearest entry, a hit within the threshold; texts are not compared."""
    return nearest_within(queries, entries, 1, threshold, **blocks).select("query_id", "entry_id", "dist")


def semantic_invalidate(
    queries: DataFrame, entries: DataFrame, threshold: float = 0.1,
    logit: Callable[[Column, Column, Column], Column] | None = None, **blocks: int,
) -> DataFrame:
    """Entries left after each query removed its first accepted candidate. Rules always apply here."""
    pairs = _rule_pairs(queries, entries, threshold, logit, **blocks)
    gone = pairs.groupBy("query_id").agg(F.min_by("entry_id", "nth").alias("entry_id")).select("entry_id").distinct()
    return entries.join(gone, "entry_id", "left_anti")


def guardrail_similarity(
    prompts: DataFrame, patterns: DataFrame, limit: float = fixed.GUARDRAIL_DISTANCE, **blocks: int
) -> DataFrame:
    """Blocked prompts (query_id, pattern_id, dist): nearest unsafe pattern strictly closer than the limit."""
    near = nearest_within(prompts, patterns.withColumnRenamed("pattern_id", "entry_id"), 1, limit, **blocks)
    return near.where(F.col("dist") < limit).select("query_id", F.col("entry_id").alias("pattern_id"), "dist")


# --------------------------------------------------------------------------------- cached answers
def cache_latest(saves: DataFrame, key: str = "cache_key", at: str = "saved_at") -> DataFrame:
    """One entry per key: the last save, which also sets the time to live."""
    rest = [c for c in saves.columns if c not in (key, at)]
    newest = F.max_by(F.struct(at, *rest), F.struct(at, *rest))
    return saves.groupBy(key).agg(newest.alias("_e")).select(key, "_e.*")


def cache_split(requests: DataFrame, hits: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Requests with and without a hit."""
    known = hits.select(key)
    return requests.join(known, key, "left_semi"), requests.join(known, key, "left_anti")


def live_entries(entries: DataFrame, at: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > at)
