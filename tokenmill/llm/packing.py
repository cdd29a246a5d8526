"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every partition packs its own pieces by best fit, longest first. Nearly full bins are final. Underfull bins
become items of the next round, in fewer groups, until one group is left or a round gains nothing.
"""

from __future__ import annotations

import base64
import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import stage, with_row

LENGTH = 2048
SLACK = 4
FAN_IN = 8
GROUP_ROWS = 1 << 16
END_ID = 0
_SAFE = np.zeros(256, bool)  # bytes that can start no white space beyond ASCII
_SAFE[0x21:0x7F] = _SAFE[0xC3:0xE1] = _SAFE[0xE4:0xF8] = True


def ranks_file() -> str:
    """The ranks of the same vocabulary as byte_bpe_50k.json, which the faster library reads."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    """The tokenizer and the bytes of each token; loaded once in a worker process, not once in a task."""
    loaded = sys.modules.setdefault("worker_tokenizers", types.ModuleType("worker_tokenizers")).__dict__
    if path not in loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        end = len(ranks)
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end})
        size = np.zeros(end + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        size[end] = len("<|endoftext|>")
        loaded[path] = coder, size
    return loaded[path]


def encode(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts and each text's first; equal to encoding each text alone.

    The tokenizer never joins a space that a letter, digit or sign follows to what stands before. Texts are
    cut there, each distinct piece is encoded once, and the ids are put together again.
    """
    coder, size = _encoder(path)
    cut = np.zeros(len(raw) + 1, bool)
    cut[: max(len(raw) - 1, 0)] = (raw[:-1] == 0x20) & _SAFE[raw[1:]]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    data = raw.tobytes()
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    is_head = head[starts]
    _, first, inverse = np.unique(tb.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
    alone = np.zeros(len(first), bool)
    alone[inverse[is_head]] = True  # begins a text, so it can't follow another piece
    pieces = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    joined = [p for p, x in zip(pieces, alone.tolist()) if not x]
    ids = np.array(coder.encode(b"".join(joined).decode(), allowed_special="all"), np.uint32)
    reach = np.concatenate([[0], np.cumsum(size[ids])])
    stops = np.searchsorted(reach, np.cumsum([0] + [len(p) for p in joined]))
    tokens: list = [None] * len(pieces)
    k = 0
    for i, p in enumerate(pieces):
        if alone[i]:
            tokens[i] = np.array(coder.encode(p.decode(), allowed_special="all"), np.uint32)
        else:
            tokens[i] = ids[stops[k] : stops[k + 1]]
            k += 1
    lengths = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate([*tokens, np.zeros(0, np.uint32)])
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n = lengths[inverse]
    out = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(begin[inverse] - out[:-1], n) + np.arange(out[-1])]
    return ids, out[np.searchsorted(starts, offsets)]


def _pieces(batches, path: str, length: int):
    for b, raw, offsets in tb.slices(batches, "text", 8 << 20):
        ids, first = encode(raw, offsets, path)
        rows, nums, begins, sizes, sums = [], [], [], [], []
        for i in range(b.num_rows):
            mine = np.append(ids[first[i] : first[i + 1]], np.uint32(END_ID)).astype("<u4")
            cuts = [*range(len(mine) % length or length, len(mine) + 1, length)]
            for k, (a, z) in enumerate(zip([0, *cuts], cuts)):
                rows.append(i)
                nums.append(k)
                begins.append(a)
                sizes.append(z - a)
                sums.append(zlib.crc32(mine[a:z].tobytes()))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("row").take(take), b.column("doc_id").take(take), pa.array(nums, pa.int32()), pa.array(begins, pa.int64()),
             pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
            ["row", "doc_id", "piece", "start", "length", "ids_crc32"],
        )


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; items in the given order.

    ``free`` has a bit for every amount of room that some open bin has, so the tightest bin is one shift away.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    free = 0
    for i, size in enumerate(sizes.tolist()):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                free &= ~(1 << room)
        else:
            k, room = len(fills), length
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += size
        room -= size
        if room:
            by_room[room].append(k)
            free |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def _pack(rows: pa.Table, base: int, length: int) -> pa.Table:
    """Adds bin, place and fill; ``item`` orders equal sizes, so a repeated task packs alike."""
    sizes = rows.column("size").to_numpy()
    order = np.lexsort((rows.column("item").to_numpy(), -sizes))
    bins, offsets, fills = best_fit(sizes[order], length)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.table({"item": rows.column("item"), "bin": pa.array(bins[back] + base), "place": pa.array(offsets[back]),
                     "fill": pa.array(fills[bins[back]])})


_PACKED = "item long, bin long, place long, fill long"


def _pack_partition(batches, length: int):
    """All items of one partition. Bin numbers hold the partition."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield from _pack(pa.Table.from_batches(batches), TaskContext.get().partitionId() << 33, length).to_batches()


def _round(items: DataFrame, level: int, groups: int, length: int) -> DataFrame:
    """One round: ``groups`` of 0 packs the partitions as they are."""
    if groups:
        items = items.repartition(groups, F.pmod(F.xxhash64("item"), F.lit(groups)))
    packed = items.select("item", "size").mapInArrow(lambda b: _pack_partition(b, length), _PACKED)
    return stage(packed.withColumn("bin", F.col("bin") + (level << 57)), f"packed-{level}")


def pack_items(items: DataFrame, length: int = LENGTH, slack: int = SLACK, fan_in: int = FAN_IN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """item, sequence_id, offset for items (item, size), with 1 <= size <= length and distinct ``item``.

    A group of a later round has about ``group_rows`` items at most; rounds end when all underfull bins have
    met in one group, or a round merged less than a hundredth of them.
    """
    rounds = [_round(items, 0, 0, length)]
    groups = None
    while True:
        last = rounds[-1].filter(F.col("fill") < length - slack)
        open_bins = last.groupBy("bin").agg(F.max("fill").alias("size")).select(F.col("bin").alias("item"), "size")
        count = open_bins.count()
        if count < 2 or groups == 1 or (len(rounds) > 1 and count > 0.99 * before):
            break
        before = count
        many = -(-count // group_rows)
        groups = max(1, many) if groups is None else max(1, many, -(-groups // fan_in)) if many > 1 else 1
        rounds.append(_round(open_bins, len(rounds), groups, length))
    out = rounds[0].select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    for r in rounds[1:]:
        r = r.select(F.col("item").alias("sequence_id"), F.col("bin").alias("outer"), "place")
        out = out.join(r, "sequence_id", "left").select(
            "item", F.coalesce("outer", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset")
        )
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   length: int = LENGTH, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id, so an empty or null text is a piece of length 1. Documents
    longer than ``length`` are cut from the end, so that only the first piece can be shorter; the full pieces
    are sequences of their own. Null and repeated ids are documents like others; an empty table packs into
    nothing. Other columns are not looked at. ``path``: the tokenizer's ranks.
    """
    path = path or ranks_file()
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    kind = base.schema["doc_id"].dataType.simpleString()
    pieces = base.mapInArrow(
        lambda b: _pieces(b, path, length), f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = stage(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(pieces.select("item", F.col("length").alias("size")), length, **how)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
