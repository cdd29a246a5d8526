"""Toxicity by ordinal regression with cumulative links.

P(grade >= j) = 1 / (1 + exp(threshold_j - w.x)): one weight per word for all thresholds, and thresholds in
order. x holds log(1 + count) of words; an L1 penalty leaves weights only for words that tell the grades
apart, so a long text does not become toxic by the mass of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb

SAMPLE = 3000  # labelled documents of either kind that the model is fitted on, at most
WORDS = 4096  # words that may get a weight, at most
SURE = 4.5  # in standard errors: how surely such a word must tell toxic from other documents
GRADES = 3  # grades above 0
LIFT = 8  # and how many times as frequent it must be among the one kind
L1 = 5e-5
STEPS = 1500


@dataclass
class Severity:
    """A fitted model; ``words`` are sorted hashes."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .., a row per text."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (letters and signs as they stand, A-Z lowered, punctuation at the ends dropped): text and hash of
    each occurrence, and the words per text."""
    raw = tb.lower(raw)
    starts, ends, first = tb.spans(raw, offsets)
    starts, ends = tb.trim(raw, starts, ends)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), tb.hash_spans(raw, starts, ends), np.diff(first)


def _bags(batches):
    """For the labelled sample: distinct words and their counts."""
    for b, raw, offsets in tb.slices(batches, "text"):
        text, words, total = _counts(raw, offsets)
        order = np.lexsort((words, text))
        t, w = text[order], words[order]
        new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])])) if len(w) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([new, [len(w)]])).astype(np.int32)
        at = np.searchsorted(t[new], np.arange(len(total) + 1))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("toxic"),
             pa.array([w[new[a:z]].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary()),
             pa.array([n[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary()), pa.array(total, pa.int64())],
            ["doc_id", "toxic", "words", "counts", "total"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, grades: int = GRADES) -> Severity | None:
    """Fits on a bounded sample: up to ``sample`` toxic and as many other labelled documents, by hash of the id.

    Labels say toxic or not. Grades come from the sample itself: words that are much more frequent among its
    toxic documents make a lexicon, and a toxic document's grade is the band that its sum of log(1 + count)
    over the lexicon falls into (bands of equal size). An id with several labels is toxic if one of them says so; rows with a
    null id or label are passed over. Without both kinds of labels there is no model (None). The thresholds
    are moved to the share of toxic documents among all labels, which the sample does not keep.
    """
    per = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = per.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(
        per.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    share_of = per.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
    rows = texts.mapInArrow(_bags, "doc_id long, toxic int, words binary, counts binary, total long").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"], r["counts"]))
    y = np.array([r["toxic"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
    counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    vocabulary, word = np.unique(np.concatenate(hashes), return_inverse=True)

    toxic = y == 1
    # copies and near copies of one text share a vote, or all words of a text that was copied would seem to tell
    votes = _votes(hashes)
    in_toxic = np.bincount(word, weights=(votes * toxic)[doc], minlength=len(vocabulary))
    in_other = np.bincount(word, weights=(votes * ~toxic)[doc], minlength=len(vocabulary))
    with_word = in_toxic + in_other
    # signed root of the likelihood ratio: how sure it is that a word's share differs between the two kinds
    part = (votes * toxic).sum() / votes.sum()
    expected = with_word * part, with_word * (1 - part)
    ratio = sum(2 * o * np.log(np.maximum(o, 1e-300) / e) for o, e in zip((in_toxic, in_other), expected))
    z = np.sign(in_toxic - expected[0]) * np.sqrt(np.maximum(ratio, 0))
    ranked = np.argsort(-np.abs(z), kind="stable")
    odds = part / (1 - part)
    lexicon = (z > SURE) & (in_toxic > LIFT * odds * in_other)
    if not lexicon.any():
        lexicon = z == z.max()
    tells = lexicon | ((z < -SURE) & (in_other > LIFT / odds * in_toxic))
    chosen_words = np.sort(ranked[tells[ranked]][:words])
    weight_of = np.bincount(doc, weights=np.log1p(counts) * lexicon[word], minlength=len(rows))
    edges = np.quantile(weight_of[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(edges, weight_of, side="right"), 0)

    place = np.full(len(vocabulary), -1)
    place[chosen_words] = np.arange(len(chosen_words))
    use = place[word] >= 0
    d, f, v = doc[use], place[word[use]], np.log1p(counts[use])
    weights, thresholds = _ordinal(d, f, v, grade, len(rows), len(chosen_words), grades)
    in_sample = toxic.mean()
    thresholds = thresholds + np.log(in_sample / (1 - in_sample)) - np.log(share_of / (1 - share_of))
    some = np.flatnonzero(weights)
    return Severity(vocabulary[chosen_words[some]], weights[some], thresholds)


def _votes(hashes: list[np.ndarray]) -> np.ndarray:
    """1 / the number of sample texts that share two min-hashes of their words."""
    keys = [tuple(int(tb.mix(h ^ salt).min()) if len(h) else 0 for salt in (np.uint64(1), np.uint64(2))) for h in hashes]
    size: dict = {}
    for k in keys:
        size[k] = size.get(k, 0) + 1
    return np.array([1 / size[k] for k in keys])


def _largest(doc, feature, value, weight, docs, features, rounds=30) -> float:
    """Largest eigenvalue of the weighted second moments of x and the constant, by power iteration."""
    v, c, size = np.ones(features), 1.0, 1.0
    for _ in range(rounds):
        size = np.sqrt((v**2).sum() + c * c)
        v, c = v / size, c / size
        score = (np.bincount(doc, weights=value * v[feature], minlength=docs) + c) * weight
        v, c = np.bincount(feature, weights=value * score[doc], minlength=features), score.sum()
    return float(np.sqrt((v**2).sum() + c * c))


def _ordinal(doc, feature, value, grade, docs, features, grades, l1=L1, steps=STEPS):
    """Proximal gradient with momentum for all thresholds at once. Documents weigh so that toxic and other
    ones count alike."""
    above = grade[:, None] >= np.arange(1, grades + 1)[None, :]
    toxic = grade > 0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    w, theta = np.zeros(features), np.zeros(grades)
    vw, vt, t = w.copy(), theta.copy(), 1.0
    step = 4.0 / (grades * max(_largest(doc, feature, value, weight, docs, features), 1e-9))
    for _ in range(steps):
        score = np.bincount(doc, weights=value * vw[feature], minlength=docs)
        miss = (_sigmoid(score[:, None] - vt[None, :]) - above) * weight[:, None]
        gradient = np.bincount(feature, weights=value * miss.sum(1)[doc], minlength=features)
        nw = vw - step * gradient
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nt = np.sort(vt + step * miss.sum(0))
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vt = nw + (t - 1) / nxt * (nw - w), nt + (t - 1) / nxt * (nt - theta)
        w, theta, t = nw, nt, nxt
    return w, theta


def _scores(b, raw, offsets, model: Severity | None) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= j), and the words per text. Without a model nothing is toxic."""
    text, words, total = _counts(raw, offsets)
    if model is None:
        return np.zeros((len(total), 1)), total
    at = np.searchsorted(model.words, words)
    at[at == len(model.words)] = 0
    hit = np.flatnonzero(model.words[at] == words) if len(model.words) else np.zeros(0, np.int64)
    key, n = np.unique(text[hit] * max(len(model.words), 1) + at[hit], return_counts=True)
    size = max(len(model.words), 1)
    score = np.bincount(key // size, weights=np.log1p(n) * model.weights[key % size] if len(key) else None, minlength=len(total))
    return model.at_least(score), total


def severities(docs: DataFrame, model: Severity | None) -> DataFrame:
    """doc_id, n_words, expected_severity (sum of P(grade >= j)), grade (thresholds with P >= 1/2), toxic (grade
    above 0) per row. Whole texts are read; a null or empty text scores like a text without known words.
    Null and repeated ids are rows like others; an empty table gives an empty result.
    """
    def score(batches):
        for b, raw, offsets in tb.slices(batches, "text"):
            p, total = _scores(b, raw, offsets, model)
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(grade > 0)],
                ["doc_id", "n_words", "expected_severity", "grade", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, n_words long, expected_severity double, grade int, toxic boolean"
    )


def without_toxic(docs: DataFrame, model: Severity | None) -> DataFrame:
    """The rows whose grade is 0, with all their columns."""
    def keep(batches):
        for b, raw, offsets in tb.slices(batches, "text"):
            p, _ = _scores(b, raw, offsets, model)
            yield b.filter(pa.array((p >= 0.5).sum(1) == 0))

    return docs.mapInArrow(keep, docs.schema)
