"""Repeated strings of 50 bytes across documents, by suffix arrays of linear grouping.

Every string of ``width`` bytes has a minimizer: its smallest k-mer by hash. Only k-mers that are minimizers
in two documents can be in a repeated string, and around such a k-mer ``2 * width - k`` bytes hold all
strings that have it as minimizer. The distinct surroundings of a k-mer are put into one text, and its suffix
array tells which strings of ``width`` bytes are equal, and which document is the first with each. Beforehand
surroundings are cut to what two of them have in common, and copies of a whole text are left out. A k-mer
with more than ``MOST`` distinct surroundings is divided first: their strings of ``width`` bytes are dealt by hash,
equal strings to one place, so that no task sorts all surroundings of a common phrase.

The suffix array is built without renaming: suffixes are grouped by their Lyndon prefix. Groups are taken in
descending order; a suffix's previous smaller suffix moves behind its old group as often as the group follows
it. A second walk over the groups then puts each suffix at the front of its group.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import stage, with_row
from tokenmill.operators.sizes import at_most, broadcast_if_small

WIDTH = 50
KMER = 24
PART_BITS, KMER_BITS = 12, 32  # first bits of a k-mer's hash, which name its part, and further ones
BLOCK = 1 << 14  # strings whose minimizers are looked for at once
MOST = 2_000  # distinct surroundings of a k-mer that are sorted as one text
FREQUENT = 10_000  # equal surroundings from which their masks are sent to all tasks
WHOLE = -1  # place that stands for a whole text
LAST = (1 << 63) - 1  # place of null ids: behind all others
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes in ascending order. A suffix that ends is smaller than one that goes on."""
    n = len(text)
    previous, done = [-1] * n, [False] * n
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    after: list[int] = []  # group number -> number of the next higher group
    before: list[int] = []
    groups: list[list[int]] = []
    of = [0] * n
    for c in sorted(members):
        number = len(groups)
        groups.append(members[c])
        before.append(number - 1)
        after.append(-1)
        if number:
            after[number - 1] = number
        for i in members[c]:
            of[i] = number
    descending = []
    at = len(groups) - 1
    while at >= 0:
        group = sorted(i for i in groups[at] if of[i] == at)
        for i in group:
            done[i] = True
        followed: dict[int, int] = {}
        for i in group:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        if group:
            descending.append(group)
        lower = before[at]
        # by old group and times followed; more times is higher
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in followed.items():
            moved.setdefault((of[p], times), []).append(p)
        for old, times in sorted(moved, reverse=True):
            number = len(groups)
            groups.append(moved[old, times])
            for p in moved[old, times]:
                of[p] = number
            # directly behind the old group: those with fewer times come later here, and so stand lower
            nxt = after[old]
            after.append(nxt)
            before.append(old)
            after[old] = number
            if nxt >= 0:
                before[nxt] = number
            if old == lower:
                lower = before[at]
        at = before[at]
    place, front, start = [0] * n, [], 0
    for number, group in enumerate(reversed(descending)):
        front.append(start)
        start += len(group)
        for i in group:
            place[i] = number
    order, placed, k = [-1] * n, [False] * n, -1
    while k < n:
        j = n - 1 if k < 0 else order[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            order[front[place[j]]] = j
            front[place[j]] += 1
            j = previous[j]
        k += 1
    return order


def first_with(texts: list[bytes], first: list[int], width: int) -> list[int]:
    """For each text a mask: bit o says that the string of ``width`` bytes at o is also in a text with a smaller
    ``first``."""
    joined: list[int] = []
    owner, offset = [], []
    for k, t in enumerate(texts):
        joined += [c + 2 for c in t] + [1]
        owner += [k] * (len(t) + 1)
        offset += range(len(t) + 1)
    order = suffix_array(joined + [0])[1:]
    rank = [0] * (len(joined) + 1)
    for r, p in enumerate(order):
        rank[p] = r
    common, h = [0] * len(order), 0  # bytes that a suffix shares with the one before it
    for p in range(len(joined)):
        r = rank[p]
        if r:
            q = order[r - 1]
            most = min(len(texts[owner[p]]) - offset[p], len(texts[owner[q]]) - offset[q])
            h = min(h, max(most, 0))
            while h < most and joined[p + h] == joined[q + h]:
                h += 1
            common[r] = h
            h = max(h - 1, 0)
        else:
            h = 0
    masks, r = [0] * len(texts), 0
    while r < len(order):
        end = r + 1
        while end < len(order) and common[end] >= width:
            end += 1
        if end > r + 1:
            least = min(first[owner[p]] for p in order[r:end])
            for p in order[r:end]:
                if first[owner[p]] > least:
                    masks[owner[p]] |= 1 << offset[p]
        r = end
    return masks


def minimizers(raw: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``raw`` and hashes of the k-mers that are the smallest of some string of ``width`` bytes inside one
    text; of equal ones the first. ``offsets`` cut ``raw`` into texts."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (n - 7,), (1,))
    steps = [min(j, k - 8) for j in range(0, k, 8)]
    span = width - k + 1  # k-mers in a string
    found = []
    for start in range(0, n - width + 1, BLOCK):  # a block's arrays stay in the processor's cache
        count = min(BLOCK, n - width + 1 - start) + span - 1
        order = words[start + steps[0] : start + steps[0] + count] * _ODD[0]
        for odd, j in zip(itertools.cycle(_ODD[1:]), steps[1:]):
            order += words[start + j : start + j + count] * odd
        order ^= order >> np.uint64(32)
        order *= _ODD[0]
        # upper half: hash, lower half: place, so that the smallest is the first of equal ones
        order &= np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(count, dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            order, size = np.minimum(order[: len(order) - size], order[size:]), size * 2
        if span > size:
            order = np.minimum(order[: len(order) - span + size], order[span - size :])
        best = (order & np.uint64(0xFFFFFFFF)).astype(np.int64) + start
        for end in offsets[np.searchsorted(offsets, start, side="right") : np.searchsorted(offsets, start + len(best) + width)].tolist():
            if end < n:  # strings that end in another text
                best[max(0, end - width + 1 - start) : max(0, end - start)] = -1
        best = best[best >= 0]
        found.append(best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best)
    places = np.concatenate(found)
    if len(places):  # the smallest k-mer never moves back
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    h = tb.mix(words[places + steps[0]])
    for j in steps[1:]:
        h = tb.mix(h * _ODD[0] + words[places + j])
    return places, h


def _kmers(batches, width: int, k: int):
    """The k-mers of a slice of texts, each once for a row, by the first bits of their hashes: a part has the further bits
    of its k-mers as packed numbers, and their rows from the slice's first row on, in halves."""
    for b, raw, offsets in tb.slices(batches, "text"):
        places, h = minimizers(raw, offsets, width, k)
        if not len(places):
            continue
        rows = b.column("row").to_numpy()
        first = rows[0]
        at = np.searchsorted(offsets, places, side="right") - 1
        h = h >> np.uint64(64 - PART_BITS - KMER_BITS)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, rest = h[new], rows[at[new]] - first
        part = (h >> np.uint64(KMER_BITS)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(begin, len(part)).astype(np.int32)

        def packed(values):
            return pa.BinaryArray.from_buffers(
                pa.binary(), len(begin), [None, pa.py_buffer(ends * np.int32(values.itemsize)), pa.py_buffer(np.ascontiguousarray(values))]
            )

        yield pa.RecordBatch.from_arrays(
            [pa.array(part[begin]), pa.array(np.full(len(begin), first)), packed(h.astype(np.uint32)),
             packed(rest.astype(np.uint16)), packed((rest >> 16).astype(np.uint16))],
            ["part", "first", "kmers", "low", "high"],
        )


def _shared(batches):
    """The k-mers in two rows, with each of these rows; they come sorted. One that has been alone so far is kept for the
    next batch."""
    alone_kmer, alone_row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = None  # the last k-mer that is known to be shared
    for b in batches:
        if not b.num_rows:
            continue
        kmer = np.concatenate([alone_kmer, b.column("kmer").to_numpy()])
        row = np.concatenate([alone_row, b.column("row").to_numpy()])
        others, ahead = b.column("others"), len(alone_row)
        many = np.concatenate([np.zeros(ahead, bool), others.is_valid().to_numpy(zero_copy_only=False)])
        same = kmer[1:] == kmer[:-1]
        shared = many.copy()
        shared[1:] |= same
        shared[:-1] |= same
        if last is not None:
            shared |= kmer == last
        kmers, rows = [kmer[shared]], [row[shared]]
        for i in np.flatnonzero(many).tolist():
            more = np.frombuffer(others[i - ahead].as_py(), np.int64)
            kmers.append(np.full(len(more), kmer[i]))
            rows.append(more)
        last = kmer[-1] if shared[-1] else None
        keep = slice(len(kmer) if shared[-1] else len(kmer) - 1, None)
        alone_kmer, alone_row = kmer[keep], row[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(kmers))], ["row", "kmer"])


def _numbers(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    return np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]), np.diff(offsets) // size


def _sorted(batches):
    """The rows of ``_shared`` from those of ``_kmers``, which come sorted by part: whole parts are sorted, and the last
    one waits for the next batch."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def ready():
        kmer, row = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(kmer, kind="stable")
        for s in range(0, len(order), 1 << 18):
            o = order[s : s + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(kmer[o]), pa.array(row[o]), pa.nulls(len(o), pa.binary())], ["kmer", "row", "others"])

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("part").to_numpy()
        kmer, count = _numbers(b.column("kmers"), np.uint32)
        low, high = (_numbers(b.column(c), np.uint16)[0] for c in ("low", "high"))
        kmer = np.repeat(part.astype(np.int64) << KMER_BITS, count) | kmer
        row = np.repeat(b.column("first").to_numpy(), count) + (low | (high.astype(np.int64) << 16))
        if part[-1] != last and waiting or part[0] != part[-1]:
            cut = int(count[: np.searchsorted(part, part[-1])].sum())
            waiting.append((kmer[:cut], row[:cut]))
            yield from ready()
            waiting, kmer, row = [], kmer[cut:], row[cut:]
        waiting.append((kmer, row))
        last = part[-1]
    if waiting:
        yield from ready()


def _surroundings(batches, width: int, k: int):
    for b, raw, offsets in tb.slices(batches, "text"):
        places, h = minimizers(raw, offsets, width, k)
        # a k-mer that is shared is on the list of each of its rows
        wanted = np.isin((h >> np.uint64(64 - PART_BITS - KMER_BITS)).view(np.int64), b.column("kmers").flatten().to_numpy())
        places = places[wanted]
        for s in range(0, len(places), 20_000):
            p = places[s : s + 20_000]
            text = np.searchsorted(offsets, p, side="right") - 1
            begin, end = np.maximum(p - width + k, offsets[text]), np.minimum(p + width, offsets[text + 1])
            ends = np.concatenate([[0], np.cumsum(end - begin)])
            data = raw[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], end - begin)]
            around = pa.BinaryArray.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("row").to_numpy()[text]), pa.array(b.column("id").to_numpy()[text]),
                 pa.array(begin - offsets[text]), pa.array(p - begin), around],
                ["row", "id", "begin", "at", "around"],
            )


def _reach(parts: list[bytes]) -> list[int]:
    """For each part the longest prefix that it has in common with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    reach = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        a, b = parts[i], parts[j]
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        same = n - (differ.bit_length() + 7) // 8
        reach[i] = max(reach[i], same)
        reach[j] = max(reach[j], same)
    return reach


def repeated(texts: list[bytes], at: list[int], first: list[int], width: int, k: int) -> list[int]:
    """The masks of ``first_with`` for the surroundings of one k-mer, which stands ``at`` a place of each.

    Equal strings agree on both sides of the k-mer. What is farther to the left or right than any two surroundings
    agree is in no repeated string and needn't be sorted, and surroundings that are equal without it are sorted once.
    """
    left = _reach([t[:p][::-1] for t, p in zip(texts, at)])
    right = _reach([t[p + k :] for t, p in zip(texts, at)])
    masks, same = [0] * len(texts), {}
    for i, (t, p) in enumerate(zip(texts, at)):
        if left[i] + k + right[i] >= width:
            same.setdefault(t[p - left[i] : p + k + right[i]], []).append(i)
    cores = list(same)
    least = [min(first[i] for i in same[c]) for c in cores]
    if not cores:
        return masks
    for core, low, mask in zip(cores, least, first_with(cores, least, width) if len(cores) > 1 else [0]):
        every = (1 << (len(core) - width + 1)) - 1
        for i in same[core]:
            masks[i] = (every if first[i] > low else mask) << (at[i] - left[i])
    return masks


def _resolve(batches, width: int, k: int):
    """Masks of the distinct surroundings, k-mer by k-mer; rows come sorted by k-mer."""
    fields = ("kmer", "key", "first", "around", "at")
    group: dict[str, list] = {c: [] for c in fields}
    out: dict[str, list] = {c: [] for c in ("kmer", "key", "first", "mask")}

    def solve():
        out["mask"] += repeated(group["around"], group["at"], group["first"], width, k) if len(group["at"]) > 1 else [0] * len(group["at"])
        for c in ("kmer", "key", "first"):
            out[c] += group[c]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    for b in batches:
        if b.num_rows > 2:  # a k-mer with one surroundings needs nothing; those at the ends may go on in other batches
            kmer = b.column("kmer").to_numpy()
            several = np.ones(len(kmer), bool)
            several[1:-1] = (kmer[1:-1] == kmer[:-2]) | (kmer[1:-1] == kmer[2:])
            b = b.filter(pa.array(several))
        for values in zip(*(b.column(c).to_pylist() for c in fields)):
            if group["kmer"] and group["kmer"][0] != values[0]:
                solve()
                group = {c: [] for c in fields}
            for c, v in zip(fields, values):
                group[c].append(v)
        if len(out["kmer"]) > 10_000:
            yield batch()
            out = {c: [] for c in out}
    solve()
    yield batch()


def _remove(batches, width: int):
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spots in zip(b.column("text"), b.column("spots")):
            data = text.as_py().encode() if text.is_valid else b""
            gone = np.zeros(len(data), bool)
            if spots.is_valid:
                begin, mask = (spots.values.field(c).to_numpy() for c in ("begin", "mask"))
                place = begin != WHOLE
                gone[:] = not place.all() and len(data) >= width
                begin, mask = begin[place], mask[place]
                first = np.zeros(len(data) + width, bool)  # where a removed string begins
                many = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                spot, o = np.nonzero(many)
                first[begin[spot] + o] = True
                starts = np.flatnonzero(first)
                edge = np.zeros(len(data) + width + 1, np.int8)
                edge[starts] += 1
                edge[starts + width] -= 1
                gone |= np.cumsum(edge[: len(data)], dtype=np.int32) > 0
            raw = np.frombuffer(data, np.uint8)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())],
            ["doc_id", *out],
        )


def _divided(distinct: DataFrame, width: int) -> DataFrame:
    """The rows of ``_resolve`` for k-mers with many surroundings: equal strings are found by grouping, summed before the
    shuffle, so a common string is no more work for its task than others."""
    offsets = F.sequence(F.lit(0), F.octet_length("around") - width)
    strings = distinct.filter(F.octet_length("around") >= width).select("kmer", "key", "first", "around", F.explode(offsets).alias("o"))
    strings = strings.select("kmer", "key", "first", "o", F.xxhash64(F.substring("around", F.col("o") + 1, F.lit(width))).alias("string"))
    least = strings.groupBy("kmer", "string").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most")
    later = strings.join(least.select("kmer", "string", "least"), ["kmer", "string"]).filter("first > least")
    bits = later.groupBy("kmer", "key").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o"))).alias("mask"))
    out = distinct.select("kmer", "key", "first").join(bits, ["kmer", "key"], "left")
    return out.select("kmer", "key", "first", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = KMER,
                   most: int = MOST, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of ``width`` bytes that also starts in a document with a smaller id.
    Rows with one id take nothing from each other; a null id comes after all others. Null and empty texts, and
    texts shorter than ``width``, keep all bytes. An empty table gives an empty result; other columns are not
    looked at. ``docs`` must be a table or a plain scan, because it is read more than once.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    base = base.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    # copies of a text with a smaller id lose all their strings, and needn't be looked at further
    marks = base.select("row", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    least = marks.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    copies = stage(marks.join(least, "digest").filter("id > low").select("row"), "copies", free=True)
    # summed in each slice of texts before the shuffle
    kmers = base.select("row", "text").mapInArrow(
        lambda b: _kmers(b, width, k), "part int, first long, kmers binary, low binary, high binary"
    )
    shared = kmers.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _shared(_sorted(b)), "row long, kmer long")
    shared = shared.join(copies, "row", "left_anti")
    per = shared.groupBy("row").agg(F.collect_list("kmer").alias("kmers"))
    around = base.select("row", "id", "text").join(per, "row").mapInArrow(
        lambda b: _surroundings(b, width, k), "row long, id long, begin long, at long, around binary"
    )
    around = stage(around, "surroundings", free=True)
    ids = [F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")]
    distinct = stage(around.groupBy("at", "around").agg(*ids), "distinct-surroundings", free=True)
    # both follow from the bytes, and so are neither written nor sent with them
    named = {"kmer": F.xxhash64(F.substring("around", F.col("at").cast("int") + 1, F.lit(k))), "key": F.xxhash64("around", "at")}
    around, distinct = around.withColumns(named), distinct.withColumns(named)
    crowded = distinct.groupBy("kmer").count().filter(F.col("count") > most).select("kmer")
    crowded = broadcast_if_small(stage(crowded, "crowded", free=True), 1_000_000)
    masks = distinct.join(crowded, "kmer", "left_anti").repartition("kmer").sortWithinPartitions("kmer", "key").mapInArrow(
        lambda b: _resolve(b, width, k), "kmer long, key long, first long, mask long"
    )
    if not at_most(crowded, 0):
        masks = masks.unionByName(_divided(distinct.join(crowded, "kmer", "left_semi"), width))
    masks = stage(masks.filter("mask != 0").select("kmer", "key", "mask"), "masks", free=True)
    size = F.octet_length("around").alias("size")
    masks = distinct.select("kmer", "key", "first", "last", "n", size).join(masks, ["kmer", "key"], "left")
    masks = masks.withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    # one row's surroundings with nothing before them take nothing away
    rare = masks.filter("mask != 0 or first < last")
    found = around.select("kmer", "key", "row", "id", "begin")
    if at_most(distinct.filter(F.col("n") > frequent), 0):
        found = found.join(rare.drop("last", "n"), ["kmer", "key"])
    else:  # rows of frequent surroundings stay where they are
        common = stage(masks.filter(F.col("n") > frequent).drop("last", "n"), "frequent", free=True)
        common = broadcast_if_small(common, 1_000_000)
        rare = found.join(common, ["kmer", "key"], "left_anti").join(rare.filter(F.col("n") <= frequent).drop("last", "n"), ["kmer", "key"])
        found = found.join(common, ["kmer", "key"]).unionByName(rare)
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("size") - width + 1) - 1
    found = found.withColumn("mask", F.when(F.col("id") > F.col("first"), every).otherwise(F.col("mask"))).filter("mask != 0")
    spots = stage(found.groupBy("row").agg(F.collect_list(F.struct("begin", "mask")).alias("spots")), "spots", free=True)
    whole = F.array(F.struct(F.lit(WHOLE).cast("long").alias("begin"), F.lit(0).cast("long").alias("mask")))
    spots = spots.unionByName(copies.select("row", whole.alias("spots")))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("row", "doc_id", "text").join(spots, "row", "left").mapInArrow(
        lambda b: _remove(b, width), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
