"""Arrow text batches as byte arrays: words, hashes and slices, without Python strings.

Everything works on the UTF-8 bytes of a batch and keeps a few times ``SLICE`` bytes in memory; a single
longer text is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` text bytes, or a single row: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start), raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(32))) * _ODD[3]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return x ^ (x >> _U(32))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    return starts, np.flatnonzero(word & after) + 1, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _ODD[0] + _ODD[2])
    if not len(starts):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(raw) + 1,), (1,))
    live, at = np.arange(len(starts)), starts
    left = size
    while len(live):
        piece = loads[at]
        cut = np.minimum(left, 8).astype(np.uint64) * _U(8)
        mask = np.where(cut == 64, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (cut & _U(63))) - _U(1))
        h[live] = mix(h[live] * _ODD[0] + (piece & mask) * _ODD[1] + _ODD[2])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and each text's first run.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(count)), runs)
    begin = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    end = first[1:][text]
    h = np.full(len(begin), _ODD[2])
    for k in range(width):
        there = begin + k < end
        piece = np.where(there, words[np.minimum(begin + k, max(len(words) - 1, 0))] if len(words) else _U(0), _U(0))
        h = np.where(there, mix(h * _ODD[0] + piece), h)
    return h, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and each text's first."""
    values = values.copy()
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):  # many short sorts beat one long one
        values[a:z].sort()
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(at) - 1))])


_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x30] = _SIGN[0x3A:0x41] = _SIGN[0x5B:0x61] = _SIGN[0x7B:0x7F] = True


def trim(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the ASCII signs at their ends. A span of signs alone becomes empty."""
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live):
        live = live[(starts[live] < ends[live])]
        live = live[_SIGN[raw[starts[live]]]]
        starts[live] += 1
    live = np.arange(len(starts))
    while len(live):
        live = live[(starts[live] < ends[live])]
        live = live[_SIGN[raw[ends[live] - 1]]]
        ends[live] -= 1
    return starts, ends
