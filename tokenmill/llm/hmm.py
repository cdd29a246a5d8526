"""A hidden Markov language model over words, trained by Baum-Welch.

Frequent words are classes of their own, the end of a text is one, and all other words, known or not, share
one. The states emit classes; inside the shared class a word has the part of the class that its smoothed
count has. So the tables that tasks carry have a fixed size, while every word of the corpus is counted:

    P(text) = P(classes) * product over words of P(word) / P(class)

with P(word) = (count + 1) / (tokens + distinct + 1), which leaves the last part of it to all unseen words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import stage, with_row

STATES = 8
ROUNDS = 4
CLASSES = 32_768  # words with a class of their own, at most
PRIOR = 50.0  # tokens' worth of the smoothed word shares in every state
STAY = 0.9  # probability to stay in a state, before training
CHUNK = 400_000  # tokens that a task works on at once
SEED = 7
RARE, END = 0, 1


def held_out(doc_id):
    """crc32 of the id as text, mod 7, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(batches):
    """Words of one partition with their counts."""
    words, counts, held = [], [], 0

    def summed():
        w, at = np.unique(np.concatenate(words), return_inverse=True)
        return [w], [np.bincount(at, weights=np.concatenate(counts), minlength=len(w)).astype(np.int64)]

    for _, raw, offsets in tb.slices(batches, "text"):
        raw = tb.lower(raw)
        starts, ends, _ = tb.spans(raw, offsets)
        w, c = np.unique(tb.hash_spans(raw, starts, ends), return_counts=True)
        words.append(w)
        counts.append(c)
        held += len(w)
        if held > 4_000_000:
            words, counts = summed()
            yield from _pairs(words.pop(), counts.pop())
            words, counts, held = [], [], 0
    if words:
        words, counts = summed()
        yield from _pairs(words[0], counts[0])


def _pairs(words, counts):
    for a in range(0, len(words), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], ["word", "count"])


def _encode(batches, own: np.ndarray, share: np.ndarray, end: int):
    """Each text as classes; the words of the shared class as hashes. ``own``: sorted hashes with a class."""
    for b, raw, offsets in tb.slices(batches, "text"):
        raw = tb.lower(raw)
        starts, ends, first = tb.spans(raw, offsets)
        words = tb.hash_spans(raw, starts, ends)
        at = np.searchsorted(own, words)
        at[at == len(own)] = 0
        known = own[at] == words if len(own) else np.zeros(len(words), bool)
        cls = np.where(known, at + 2, RARE).astype(np.uint16)
        log = np.concatenate([[0], np.cumsum(np.where(known, np.log10(share[cls]), 0))])
        seen = np.concatenate([[0], np.cumsum(known)])
        tail = words[~known].view(np.int64)
        cut = first - seen[first]
        data = [np.append(cls[a:z], np.uint16(end)).tobytes() for a, z in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(first) + 1, pa.int64()),
             pa.array(np.diff(seen[first]), pa.int64()), pa.array(np.diff(log[first])), pa.array(data, pa.binary()),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tail))],
            ["row", "doc_id", "held_out", "n_tokens", "n_own", "own_score", "classes", "tail"],
        )


def _chunks(column):
    """Texts in chunks of about ``CHUNK`` tokens, longest first: (their places, classes, lengths), classes by
    position and then by text, so that position t of all texts that have one is a slice."""
    texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    length = np.array([len(x) for x in texts])
    order = np.argsort(-length, kind="stable")
    start = 0
    while start < len(order):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(length[order[start:]]), CHUNK)))
        part = order[start:stop]
        n = length[part]
        text = np.repeat(np.arange(len(part)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        by_place = np.lexsort((text, place))
        alive = np.bincount(place)
        yield part, np.concatenate([texts[i] for i in part])[by_place].astype(np.int64), text[by_place], np.concatenate([[0], np.cumsum(alive)])
        start = stop


def _forward(cls, at, first, step, emit):
    """Scaled forward recursion. Returns alpha and the scale of each token."""
    e = emit[:, cls]
    alpha, scale = np.empty_like(e), np.empty(len(cls))
    a = first[:, None] * e[:, : at[1]]
    for t in range(len(at) - 1):
        here = slice(at[t], at[t + 1])
        if t:
            a = (step.T @ a[:, : at[t + 1] - at[t]]) * e[:, here]
        s = a.sum(0)
        a = a / s
        alpha[:, here], scale[here] = a, s
    return e, alpha, scale


def _expect(batches, model):
    """Expected counts of one partition: emissions per class, and transitions and starts under the classes
    -1-state and -1000."""
    first, step, emit = model
    states = len(first)
    emitted, moved, started = np.zeros_like(emit), np.zeros((states, states)), np.zeros(states)
    for b in batches:
        for _, cls, _, at in _chunks(b.column("classes")):
            e, alpha, scale = _forward(cls, at, first, step, emit)
            beta = np.ones((states, at[-1] - at[-2]))
            for t in range(len(at) - 2, -1, -1):
                here = slice(at[t], at[t + 1])
                alpha_t = alpha[:, here]
                gamma = alpha_t * beta
                if t:
                    back = e[:, here] * beta / scale[here]
                    moved += alpha[:, at[t - 1] : at[t - 1] + at[t + 1] - at[t]] @ back.T
                    beta = np.ones((states, at[t] - at[t - 1]))
                    beta[:, : at[t + 1] - at[t]] = step @ back
                else:
                    started += gamma.sum(1)
                alpha[:, here] = gamma
            for k in range(states):
                emitted[k] += np.bincount(cls, weights=alpha[k], minlength=emit.shape[1])
    some = np.flatnonzero(emitted.any(0))
    keys = np.concatenate([some, -1 - np.arange(states), [-1000]])
    values = np.concatenate([emitted[:, some], (moved * step).T, started[:, None]], axis=1)
    for a in range(0, len(keys), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 10_000], pa.int32()), *[pa.array(v[a : a + 10_000]) for v in values]],
                                         ["class", *[f"s{k}" for k in range(states)]])


def _likelihood(batches, model):
    first, step, emit = model
    for b in batches:
        score = np.zeros(b.num_rows)
        for part, cls, text, at in _chunks(b.column("classes")):
            score[part] = np.bincount(text, weights=np.log10(_forward(cls, at, first, step, emit)[2]), minlength=len(part))
        kept = ["row", "doc_id", "held_out", "n_tokens", "n_own", "own_score"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(score)], [*kept, "class_score"])


def _initial(share: np.ndarray, states: int):
    rng = np.random.default_rng(SEED)
    emit = share[None, :] * np.exp(rng.normal(size=(states, len(share))))
    step = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(step, STAY if states > 1 else 1)
    return np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS,
                classes: int = CLASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows that are not held out: word counts, then ``rounds`` passes of Baum-Welch, whose
    expected counts are summed over partitions. Scores are log10 probabilities of whole texts with their end.
    A null or empty text is its end alone. Words are compared by 64-bit hashes. Null and repeated ids are rows
    like others; without any training rows all tokens are unseen and have probability 1; an empty table gives
    an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    base = with_row(base, "row")
    train = base.filter(~F.col("held_out"))
    words = train.select("text").mapInArrow(_count, "word long, count long")
    counts = stage(words.groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    texts = train.count()
    got = counts.agg(F.sum("count"), F.count("*")).first()
    tokens, distinct = (got[0] or 0) + texts, got[1] + (texts > 0)
    whole = tokens + distinct + 1

    # the most frequent words, by a histogram of counts, so that no more than ``classes`` are collected
    size = F.floor(F.log2("count") * 16).cast("int")
    bound, kept = 0, 0
    for bucket, n in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        kept += n
        if kept > classes:
            bound = bucket + 1
            break
    own = counts.filter(size >= bound).collect()
    own = sorted((np.uint64(r["word"] % 2**64), r["count"]) for r in own)
    hashes = np.array([w for w, _ in own], np.uint64)
    share = np.array([0.0, texts + 1 if texts else 1e-300] + [c + 1 for _, c in own]) / whole
    share[RARE] = max(1.0 - share[1:].sum(), 1 / whole)  # unseen words and all words without a class
    end = END if texts else RARE

    kind = base.schema["doc_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast((hashes, share))
    encoded = stage(base.mapInArrow(
        lambda b: _encode(b, *known.value, end),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_own long, own_score double, classes binary, tail array<long>",
    ), "encoded-texts")

    model = _initial(share, states)
    learn = encoded.filter(~F.col("held_out")).select("classes")
    columns = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        parts = learn.mapInArrow(lambda b, m=sent: _expect(b, m.value), "class int, " + ", ".join(f"{c} double" for c in columns))
        sums = {r["class"]: [r[c] for c in columns] for r in parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in columns]).collect()}
        emitted = PRIOR * np.repeat(share[None, :], states, axis=0)
        for c, v in sums.items():
            if c >= 0:
                emitted[:, c] += v
        moved = np.array([sums.get(-1 - k, [0.0] * states) for k in range(states)]).T + model[1]
        started = np.array(sums.get(-1000, [0.0] * states)) + 1 / states
        model = started / started.sum(), moved / moved.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True)

    sent = spark.sparkContext.broadcast(model)
    plain = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_own", "own_score", "classes").mapInArrow(
        lambda b: _likelihood(b, sent.value),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_own long, own_score double, class_score double",
    )
    tail = encoded.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(whole)))).alias("tail_score"),
        F.count("*").alias("n_tail"), F.count("count").alias("n_seen"),
    )
    both = plain.join(tail, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    of_end = float(np.log10(share[END])) if texts else float(-np.log10(whole))
    tail_score = F.coalesce("tail_score", F.lit(0.0))
    rare = zero("n_tail") + (0 if texts else 1)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_own") + zero("n_seen") + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("own_score") + tail_score + of_end).alias("base_score"),
        (F.col("class_score") + tail_score - rare * F.lit(float(np.log10(share[RARE])))).alias("score"),
    )
