"""Runs of repeated words inside a text, found by block convolution.

A run is a stretch of words with a smallest period q (words q apart are the same) that is long enough, and that no
neighbouring word prolongs. At each scale D = 8, 16, 32, ... a text is cut into blocks of D words. The squared
differences of a block and the window behind it are summed at all distances at once, by a number-theoretic
transform: whole numbers modulo a few primes whose product is above the largest sum, so a zero is a true zero. A
run with a period from D to 2 D - 1 has a whole block in front of its last period, whose sum at that distance is
zero (the scale 8 also takes the periods below 8). These distances seed extensions word by word, shortest first;
a stretch inside a run whose period divides the distance is that run.

A block with a word that doesn't come again within 2 D words can't have a zero, and is left out beforehand.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb

LEAST = 24  # words of a run, at least
TIMES = 3  # periods of a run, at least
SMALLEST = 8  # words of the smallest blocks; LEAST must be enough for one of them behind each smaller period
LARGEST = 1 << 16  # words of the largest blocks; longer distances are searched window by window
NUMBERS = 1 << 20  # numbers that are transformed at once
#: Primes with roots of unity of order 2 ** 23 at least, each with a generator. Fixed values.
PRIMES = [(998244353, 3), (469762049, 3), (167772161, 3)]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def transform(rows: np.ndarray, p: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in bit-reversed order."""
    m, n = rows.shape
    q, size = np.uint64(p), n
    while size > 1:
        half = size // 2
        turn = _powers(pow(root, (p - 1) // size, p), half, p)
        a = rows.reshape(m, n // size, 2, half)
        out = np.empty_like(a)
        out[:, :, 0] = (a[:, :, 0] + a[:, :, 1]) % q
        out[:, :, 1] = (a[:, :, 0] + q - a[:, :, 1]) * turn % q
        rows, size = out.reshape(m, n), half
    return rows


def untransform(rows: np.ndarray, p: int, root: int) -> np.ndarray:
    """Takes back ``transform``."""
    m, n = rows.shape
    q, size = np.uint64(p), 2
    while size <= n:
        half = size // 2
        turn = _powers(pow(root, (p - 1) - (p - 1) // size, p), half, p)
        a = rows.reshape(m, n // size, 2, half)
        low = a[:, :, 1] * turn % q
        out = np.empty_like(a)
        out[:, :, 0] = (a[:, :, 0] + low) % q
        out[:, :, 1] = (a[:, :, 0] + q - low) % q
        rows, size = out.reshape(m, n), size * 2
    return rows * np.uint64(pow(n, p - 2, p)) % q


def zero_shifts(blocks: np.ndarray, windows: np.ndarray, largest: int) -> np.ndarray:
    """Whether the squared differences of each block (m x b) and its window (m x 2 b) are all zero, at shifts 0 to
    b - 1. ``largest`` is a bound of the numbers, which aren't negative."""
    m, b = blocks.shape
    zero = np.ones((m, b), bool)
    turned = np.zeros((m, 2 * b), np.uint64)
    turned[:, 0], turned[:, b + 1 :] = blocks[:, 0], blocks[:, :0:-1]
    product = 1
    for p, root in PRIMES:
        q = np.uint64(p)
        x, y = turned % q, windows.astype(np.uint64) % q
        cross = untransform(transform(x, p, root) * transform(y, p, root) % q, p, root)[:, :b]
        sums = np.zeros((m, 2 * b + 1), np.uint64)
        np.cumsum(y * y % q, axis=1, out=sums[:, 1:])
        squares = (x * x % q).sum(1, keepdims=True) + sums[:, b : 2 * b] - sums[:, :b]
        zero &= (squares + np.uint64(2) * (q - cross)) % q == 0
        product *= p
        if product > b * largest * largest:
            return zero
    return zero  # a sum above the product only seeds an extension in vain


def _numbered(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words inside each text, from 1, and the distance to the next place of the same word."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((words, text))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    upto = np.cumsum(new)
    before = np.concatenate([[0], upto])[first[:-1]]  # sorted by text, so a text's words begin where they did
    number, further = np.empty(n, np.int64), np.full(n, 1 << 62)
    number[order] = upto - before[text[order]]
    further[order[:-1][~new[1:]]] = (order[1:] - order[:-1])[~new[1:]]
    return number, further


def seeds(number: np.ndarray, further: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES,
          smallest: int = SMALLEST) -> np.ndarray:
    """Rows (text, distance, start, length): the block at ``start`` comes again at the distance."""
    out, count, scale = [np.zeros((0, 4), np.int64)], np.diff(first), smallest
    padded = np.concatenate([number, np.zeros(2 * LARGEST, np.int64)])
    while len(count) and count.max() >= max(least, times * (scale if scale > smallest else 1)):
        b = min(scale, LARGEST)
        blocks = np.where(count >= max(least, times * (scale if scale > smallest else 1)), count // scale, 0)
        text = np.repeat(np.arange(len(count)), blocks)
        at = first[:-1][text] + scale * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        alone = np.concatenate([[0], np.cumsum(further >= 2 * scale)])
        back = alone[at + b] == alone[at]
        text, at = text[back], at[back]
        for near in range(1 if scale == smallest else scale, 2 * scale, b):
            step = max(1, NUMBERS // (2 * b))
            for i in range(0, len(at), step):
                t, a = text[i : i + step], at[i : i + step]
                end = first[1:][t]
                inside = a + near + b <= end
                t, a, end = t[inside], a[inside], end[inside]
                if not len(a):
                    continue
                place = (a + near)[:, None] + np.arange(2 * b)
                window = np.where(place < end[:, None], padded[np.minimum(place, len(padded) - 1)], 0)
                zero = zero_shifts(number[a[:, None] + np.arange(b)], window, int(number.max()))
                row, shift = np.nonzero(zero)
                found = np.stack([t[row], near + shift, a[row], np.full(len(row), b)], axis=1)
                out.append(found[found[:, 1] < 2 * scale])
        scale *= 2
    return np.concatenate(out)


def _same_until(number: np.ndarray, at: int, end: int, distance: int) -> int:
    """First place from ``at`` on, below ``end``, whose word differs from that ``distance`` later; else ``end``."""
    step = 64
    while at < end:
        stop = min(end, at + step)
        differ = number[at:stop] != number[at + distance : stop + distance]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = stop, step * 2
    return end


def _same_since(number: np.ndarray, at: int, begin: int, distance: int) -> int:
    """The place behind the last one below ``at`` whose word differs from that ``distance`` later; else ``begin``."""
    step = 64
    while at > begin:
        start = max(begin, at - step)
        differ = (number[start:at] != number[start + distance : at + distance])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = start, step * 2
    return begin


def extended(number: np.ndarray, begin: int, end: int, found: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the text at ``begin`` to ``end`` by its seeds; sorted by start, then period."""
    runs: list[tuple[int, int, int]] = []
    known: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends of its runs, ascending
    low = high = last = -1
    for d, at, size in sorted(found[:, 1:].tolist()):
        if d == last and at + size + d <= high and at >= low:
            continue
        covered = False
        for q, (starts, ends) in known.items():
            if d % q == 0:
                k = bisect_right(starts, at) - 1
                if k >= 0 and at + size + d <= ends[k]:
                    covered = True
                    break
        if covered:
            continue
        low, last = _same_since(number, at, begin, d), d
        high = _same_until(number, at + size, end - d, d) + d
        if high - low >= max(least, times * d):
            runs.append((low - begin, high - low, d))
            starts, ends = known.setdefault(d, ([], []))
            starts.append(low)
            ends.append(high)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _find(batches, order: Callable[[object, int], np.ndarray] | None, least: int, times: int):
    for b, raw, offsets in tb.slices(batches, "text"):
        starts, ends, first = tb.spans(raw, offsets)
        if order is not None and len(starts):
            for i, key in enumerate(b.column("doc_id").to_pylist()):
                a, z = first[i], first[i + 1]
                if z > a and (at := order(key, int(z - a))) is not None:
                    starts[a:z], ends[a:z] = starts[a:z][at], ends[a:z][at]
        number, further = _numbered(tb.hash_spans(raw, starts, ends), first)
        found = seeds(number, further, first, least, times)
        found = found[np.argsort(found[:, 0], kind="stable")]
        cut = np.searchsorted(found[:, 0], np.arange(len(first)))
        runs = [
            extended(number, int(first[i]), int(first[i + 1]), found[cut[i] : cut[i + 1]], least, times) if cut[i] < cut[i + 1] else []
            for i in range(len(first) - 1)
        ]
        edge = np.zeros(len(number) + 1, np.int64)
        for i, own in enumerate(runs):
            for start, length, period in own:
                edge[first[i] + start + period] += 1
                edge[first[i] + start + length] -= 1
        kept = np.cumsum(edge[:-1]) == 0
        size = np.where(kept, ends - starts + 1, 0)  # with a space behind
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
        joined = np.concatenate([raw, np.zeros(1, np.uint8)])[place]
        joined[at[1:][kept] - 1] = 0x20
        data, at = joined.tobytes(), at[first].tolist()
        texts = [data[a : max(a, z - 1)].decode() for a, z in zip(at[:-1], at[1:])]
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  order: Callable[[object, int], np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run has at least ``least`` words and ``times`` periods; ``least`` is 24 or more and ``times`` 3 or more, which the
    smallest blocks need. ``collapsed`` is the text's words with one space between, without the words that a run
    repeats: all behind its first period. ``order(doc_id, n)`` may put other words in place before: it returns the number
    of the original word for each place, or None. Null, empty and blank texts have no words and no runs. Rows with
    one id, null ids and ids of any type stay rows of their own; other columns are not looked at. An empty table
    gives an empty result. Words are told apart by 64-bit hashes inside their text. Nothing is shuffled; a text is
    one row of one task, and takes some hundred bytes a word there.
    """
    if least < 3 * SMALLEST or times < 3:
        raise ValueError("a run needs at least 24 words and 3 periods")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return base.mapInArrow(lambda b: _find(b, order, least, times), f"doc_id {kind}, n_words bigint, runs {runs}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with most periods, compared exactly; the first of equal ones. Null without runs."""
    return F.reduce(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)),
        lambda best, r: F.when(
            r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"], r).otherwise(best),
    )


def run_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, the number of runs, the strongest run, and digests of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_tail(doc_id: object, n: int) -> np.ndarray | None:
    """For one in ten ids: from some word on, the words of a short stretch again and again. Null ids are left alone."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    at, g = np.arange(n), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)
