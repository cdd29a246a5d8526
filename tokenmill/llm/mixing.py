"""Mixing sources to target weights by block indexes.

The words of a source stand in one stream and are cut into blocks of a fixed number of words. A source's
target decides how many block slots it gets; a multinomial draw deals these slots over the output shards.
A source's slots are counted through all shards, and slot j takes block perm(j mod blocks), where perm is
a pseudorandom permutation of the source's block indexes, another one for each round through the source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import WORD, free_name, stage, with_row

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_601


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order: range partitions are sorted and numbered, then shifted."""
    part = free_name(df, "part")
    rows = stage(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1))
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # one number per partition
    shift, total = [], 0
    for p in sorted(counts):
        shift.append((p, total))
        total += counts[p]
    if len(shift) < 2:
        return rows.drop(part)
    shifts = df.sparkSession.createDataFrame(shift, f"{part} int, shift_of_part long")
    return rows.join(F.broadcast(shifts), part).withColumn(name, F.col(name) + F.col("shift_of_part")).drop(part, "shift_of_part")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: rank, source, source_size, weight, target. ``sizes`` has source and size.

    Sources by code point, null last, take the weights in turn. All targets sum to ``share`` of all sizes;
    none is above ``most`` times its source's size, and what a source can't take goes to the others by
    weight, again and again until it fits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = in_order(per, [F.col("source").isNull(), "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = stage(per.withColumn("weight", weight), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, room = 0.0, F.col("source_size") * F.lit(float(most))
    while True:  # each round at least one more source is full
        full = room < F.col("weight") * F.lit(level)
        got = per.agg(
            F.sum(F.when(full, room).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not got["open"]:
            break
        new = (share * total - got["full"]) / got["open"]
        if new <= level:
            break
        level = new
    return per.withColumn("target", F.least(room, F.col("weight") * F.lit(level)))


def _places(batches):
    """Sorted rows of one partition: where each document starts in its source, counted in the partition."""
    rank_now, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        rank, size = b.column("rank").to_numpy(), b.column("size").to_numpy()
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        new = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        base = start[new].copy()
        if rank[0] == rank_now:
            base[0] -= total
        start = start - np.repeat(base, np.diff(np.concatenate([new, [len(rank)]])))
        rank_now, total = rank[-1], int(start[-1] + size[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("rank"), b.column("size"), pa.array(start, pa.int64())], ["row", "rank", "size", "start"]
        )


def _streams(sizes: DataFrame) -> DataFrame:
    """row, rank, size, start: each document's place in its source's stream of words.

    Range partitions split a large source, so none is put together in one task; only the sums per
    partition and source are added up.
    """
    ordered = sizes.filter("size > 0").select("row", "rank", "size", "doc_id")
    ordered = ordered.repartitionByRange("rank", F.xxhash64("doc_id"), "doc_id", "size", "row")
    ordered = ordered.sortWithinPartitions("rank", F.xxhash64("doc_id"), "doc_id", "size", "row")
    local = ordered.select("row", "rank", "size").mapInArrow(_places, "row long, rank long, size long, start long")
    local = stage(local.withColumn("part", F.spark_partition_id()), "streams")
    sums = local.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    shift = F.expr("coalesce(sum(words) over (partition by rank order by part rows between unbounded preceding and 1 preceding), 0)")
    shifts = sums.select("rank", "part", shift.alias("shift"))
    return local.join(shifts, ["rank", "part"]).select("row", "rank", "size", (F.col("start") + F.col("shift")).alias("start"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. size-1 for each key, at ``index``: a Feistel network of four rounds over the
    next even number of bits; results beyond the size go through it again."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    # log2 is exact enough for sizes below 2**48; a bit too much is harmless
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, out = index.astype(np.uint64), np.zeros(len(index), np.int64)
    live = np.arange(len(x))
    while len(live):
        left, right, b, m = x[live] >> bits[live], x[live] & mask[live], bits[live], mask[live]
        for r in range(4):
            left, right = right, left ^ (tb.mix(right + key[live] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[live] = (left << b) | right
        ok = x[live] < size[live].astype(np.uint64)
        out[live[ok]] = x[live[ok]].astype(np.int64)
        live = live[~ok]
    return out


def _draws(batches, shards: int, seed: int):
    """A source's slots, dealt over the shards by one multinomial draw."""
    for b in batches:
        for rank, slots, blocks in zip(b.column("rank").to_pylist(), b.column("slots").to_pylist(), b.column("blocks").to_pylist()):
            drawn = np.random.default_rng([seed, rank]).multinomial(slots, np.full(shards, 1 / shards))
            first = np.concatenate([[0], np.cumsum(drawn)[:-1]])
            some = np.flatnonzero(drawn)
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, rank), pa.int64()), pa.array(np.full(n, blocks), pa.int64()), pa.array(some, pa.int64()),
                 pa.array(first[some], pa.int64()), pa.array(drawn[some], pa.int64())],
                ["rank", "blocks", "shard", "first", "drawn"],
            )


def _permute(batches, seed: int):
    for b in batches:
        rank, blocks, slot = (b.column(c).to_numpy() for c in ("rank", "blocks", "slot"))
        turn = slot // np.maximum(blocks, 1)
        key = tb.mix(rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + turn.astype(np.uint64) + np.uint64(seed))
        index = permuted(slot - turn * blocks, blocks, key)
        yield pa.RecordBatch.from_arrays(
            [b.column("rank"), b.column("shard"), b.column("slot"), pa.array(turn, pa.int64()), pa.array(index, pa.int64())],
            ["rank", "shard", "slot", "turn", "block"],
        )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents' part in it.

    First table: one row per slot and document span: shard, slot, turn, rank, block, row, first_word, words;
    ``first_word`` counts in the document. Second: row, doc_id, rank, size, source_size, target per row of
    ``docs``. Words are counted in whole texts; null texts have none, so they are in no span. A null source
    is a source. Rows with one id are separate documents. An empty table, or one without words, gives an
    empty mix and targets of 0. The result depends on the rows alone, not on partitions; rows that are alike
    in id and size may stand for each other.
    ``docs`` must be a table or a plain scan, because it may be read again by its row numbers.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "row")
    sizes = stage(base.select("row", "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = stage(source_targets(sizes, weights, share, most), "targets")
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    named = sources.select(key[0].alias("name"), key[1].alias("none"), "rank", "source_size", "target")
    sizes = stage(
        sizes.withColumn("name", key[0]).withColumn("none", key[1]).join(named, ["name", "none"])
        .select("row", "doc_id", "rank", "size", "source_size", "target"), "ranked-sizes",
    )
    places = _streams(sizes)
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    spans = places.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = spans.select("rank", "block", "row", (begin - F.col("start")).alias("first_word"), (end - begin).alias("words"))

    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.least(F.round(F.col("target") * blocks / F.col("source_size")), F.floor(blocks * F.lit(float(most)))).cast("long")
    plan = sources.filter("source_size > 0").select("rank", blocks.alias("blocks"), slots.alias("slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_slots))
    dealt = plan.repartition("rank").mapInArrow(
        lambda b: _draws(b, shards, seed), "rank long, blocks long, shard long, first long, drawn long"
    )
    dealt = dealt.repartition("rank", "shard").withColumn("slot", F.explode(F.expr("sequence(first, first + drawn - 1)")))
    taken = dealt.select("rank", "blocks", "shard", "slot").mapInArrow(
        lambda b: _permute(b, seed), "rank long, shard long, slot long, turn long, block long"
    )
    # merged, because the slots' number is not seen before they are made, and must not be broadcast
    return taken.join(spans.hint("merge"), ["rank", "block"]), sizes


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix, repeats counted) of each row."""
    mix, sizes = mix_sources(docs, **how)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    return sizes.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _cut(batches, text: str):
    """Replaces each text by the words of its spans. Spans that follow each other keep the space between."""
    for b in batches:
        raw, offsets = tb.text_bytes(b.column(text))
        starts, ends, first = tb.spans(raw, offsets)
        data, texts = raw.tobytes(), []
        for i, spans in enumerate(b.column("spans_of_mix").to_pylist()):
            runs = []
            for s in sorted((x["first_word"], x["words"]) for x in spans):
                if runs and runs[-1][1] == s[0]:
                    runs[-1][1] = s[0] + s[1]
                else:
                    runs.append([s[0], s[0] + s[1]])
            if len(runs) == 1 and runs[0][0] == 0 and runs[0][1] == first[i + 1] - first[i]:
                texts.append(data[offsets[i] : offsets[i + 1]].decode())  # the whole text, as it is
            else:
                texts.append("\n".join(data[starts[first[i] + a] : ends[first[i] + z - 1]].decode() for a, z in runs))
        kept = [c for c in b.schema.names if c != "spans_of_mix"]
        columns = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in kept]
        yield pa.RecordBatch.from_arrays(columns, kept)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each document and each turn that takes words
    of it one row, whose text is these words. A document that is taken whole keeps its text as it is."""
    mix, _ = mix_sources(docs, id_col, text_col, source_col, **how)
    row = free_name(docs, "row_of_mix")
    per = mix.groupBy("row", "turn").agg(F.collect_list(F.struct("first_word", "words")).alias("spans_of_mix"))
    rows = with_row(docs, row).join(per.select(F.col("row").alias(row), "spans_of_mix"), row).drop(row)
    return rows.mapInArrow(lambda b: _cut(b, text_col), docs.schema)
