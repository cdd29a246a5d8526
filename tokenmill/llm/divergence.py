"""How the sources of each language differ in their terms, by chunk factorization.

A chunk is what stands between whitespace. Chunks are counted per document; the counts of a block of documents travel
as one row for each distinct chunk, which lists the documents. All rows of a chunk come together, so that each chunk that is
distinct in the whole corpus is cut into terms once, and its terms are joined to these rows. Then the rows of a term
come together: a document under two chunks of one term counts once. A chunk or term of all documents is a row per
block or span of blocks, which a task reads one after the other.

Divergences are whole numbers of billionths. The sum over all terms of a pair of sources needs only terms that both
have and the counts of each: a term that one lacks has the same share there as any other such term.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import stage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 2 << 20  # bytes of text that are cut into chunks at once, about
BLOCK = 24 << 20  # bytes of text in a block, about
ROWS = 1 << 16  # chunks of a block that are packed at once
SPAN = 8  # partitions whose documents are merged together
LEAST_DOCS = 3
RANKS = 200
BILLION = 1_000_000_000
PAIRS = 1 << 20  # pairs of sources that are computed at once, and sums that a task holds


# ------------------------------------------------------------------------------ lists of small numbers
def pack(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Seven bits a byte, the lowest first; ``rows`` has the first value of each row, and one more at the end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        live = size > k
        more = (size[live] > k + 1).astype(np.uint8) << 7
        out[at[:-1][live] + k] = ((v[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(at[rows].astype(np.int64)), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values, and the first value of each row."""
    raw, offsets = tb.text_bytes(column)
    last = raw < 128
    end = np.flatnonzero(last)
    begin = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, end - begin + 1)
    part = (raw & 127).astype(np.int64) << (7 * place)
    values = np.add.reduceat(part, begin) if len(end) else np.zeros(0, np.int64)
    return values, np.searchsorted(end, offsets)


def _sums(steps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Running sums that begin anew in each row."""
    total = np.cumsum(steps)
    return total - np.repeat(np.concatenate([[0], total])[rows[:-1]], np.diff(rows))


def _entries(doc: np.ndarray, group: np.ndarray, n: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Lists of documents (ascending in a row), their groups and counts."""
    steps = np.diff(doc, prepend=0)
    steps[rows[:-1]] = doc[rows[:-1]]
    return pack(np.stack([steps, group, n], axis=1).ravel(), 3 * rows).cast(pa.binary())


def _changes(*columns) -> np.ndarray:
    """Whether a row differs from the one before it, in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        differ = c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        out[1:] |= differ
    return out


# --------------------------------------------------------------------------------------------- counting
def _chunks(batches, numbers: dict):
    """chunk, place (partition) and entries of each distinct chunk of a block."""
    place, docs = TaskContext.get().partitionId(), np.int64(0)
    held: list[tuple] = []
    size = 0

    def block():
        h = np.concatenate([x[0] for x in held])
        order = np.lexsort((np.concatenate([x[1] for x in held]), h))
        rows = np.append(np.flatnonzero(_changes(h[order])), len(h))
        doc, group, n = (np.concatenate([x[i] for x in held])[order] for i in (1, 2, 3))
        # each chunk's text, from the first slice that has it
        names = pa.concat_arrays([x[5] for x in held])
        _, first = np.unique(np.concatenate([x[4] for x in held]), return_index=True)
        held.clear()
        for i in range(0, len(rows) - 1, ROWS):
            some = rows[i : i + ROWS + 1]
            a, z = some[0], some[-1]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(first[i : i + ROWS])).cast(pa.string()), pa.array(np.full(len(some) - 1, place, np.int32)),
                 _entries(doc[a:z].astype(np.int64), group[a:z], n[a:z], some - a)],
                ["chunk", "place", "entries"])

    for b, raw, offsets in tb.slices(batches, "text", SLICE):
        raw = tb.lower(raw)
        own = np.array([numbers[x] for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist())], np.int32)
        starts, ends, first = tb.spans(raw, offsets)
        if len(starts):
            h = tb.hash_spans(raw, starts, ends)
            doc = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(first))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            chunk = np.flatnonzero(_changes(h))
            at = np.flatnonzero(_changes(h, doc))
            text = order[chunk]
            length = ends[text] - starts[text]
            to = np.concatenate([[0], np.cumsum(length)])
            data = raw[np.repeat(starts[text] - to[:-1], length) + np.arange(to[-1])]
            names = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data))
            held.append((h[at], docs + doc[at], own[doc[at]], np.diff(np.append(at, len(doc))).astype(np.int32), h[chunk], names))
        docs += b.num_rows
        size += len(raw)
        if size >= BLOCK and held:
            yield from block()
            size = 0
    if held:
        yield from block()


def _terms(batches):
    """span, term, times (how often the term is in the chunk) and entries. Rows come sorted by chunk and place; a chunk is
    cut into terms where its first row is."""
    cut, last, terms = re.compile(TERM), None, []
    for b in batches:
        if not b.num_rows:
            continue
        chunk, place = b.column("chunk"), b.column("place").to_numpy()
        span = place // SPAN
        fresh, run = _changes(chunk), _changes(chunk, span)
        values, at = unpack(b.column("entries"))
        at = at // 3
        row = np.repeat(np.arange(len(place)), np.diff(at))
        doc = _sums(values[0::3], at) + ((place[row] % SPAN).astype(np.int64) << 32)
        number = np.cumsum(run)[row]
        order = np.lexsort((doc, number))  # blocks of one partition may come in any order
        runs = np.flatnonzero(run)
        rows = np.searchsorted(number[order], np.arange(1, len(runs) + 2))
        packed = _entries(doc[order], values[1::3][order], values[2::3][order], rows)
        found, times, source = [], [], []
        which = np.cumsum(fresh)[runs].tolist()
        names = chunk.filter(pa.array(fresh)).to_pylist()
        own = []
        for name in names:
            if name != last:
                last, terms = name, list(Counter(cut.findall(name)).items())
            own.append(terms)
        for i, k in enumerate(which):
            for term, n in own[k - 1]:
                found.append(term)
                times.append(n)
                source.append(i)
        source = np.array(source, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(span[runs[source]]), pa.array(found, pa.string()), pa.array(times, pa.int32()), packed.take(pa.array(source))],
            ["span", "term", "times", "entries"])


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """group, term, n_docs and n of whole terms."""
    span, term = rows.column("span").to_numpy(), rows.column("term").combine_chunks()
    new = _changes(span, term)
    values, at = unpack(rows.column("entries"))
    at = at // 3
    row = np.repeat(np.arange(len(span)), np.diff(at))
    doc, group, n = _sums(values[0::3], at), values[1::3], values[2::3] * rows.column("times").to_numpy()[row]
    own = np.cumsum(new)[row]
    order = np.lexsort((doc, group, own))
    own, group, doc, n = own[order], group[order], doc[order], n[order]
    pair = np.flatnonzero(_changes(own, group))
    docs = np.add.reduceat(_changes(own, group, doc).astype(np.int64), pair)
    return pa.RecordBatch.from_arrays(
        [pa.array(group[pair].astype(np.int32)), term.take(pa.array(np.flatnonzero(new)[own[pair] - 1])), pa.array(docs), pa.array(np.add.reduceat(n, pair))],
        ["group", "term", "n_docs", "n"])


def _merge(batches):
    """Rows come sorted by span and term; the last term of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        span, term = b.column("span"), b.column("term")
        other = pc.or_(pc.not_equal(span, span[-1]), pc.not_equal(term, term[-1])).to_numpy(zero_copy_only=False)
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        same = waiting and waiting[-1].column("term")[-1] == term[-1] and waiting[-1].column("span")[-1] == span[-1]
        if not end and (same or not waiting):
            waiting.append(b)
            continue
        whole = [*waiting, b.slice(0, end)]  # all that waits, and what of this batch is before its last term
        yield _merged(pa.Table.from_batches(whole))
        waiting = [b.slice(end)]
    if waiting:
        yield _merged(pa.Table.from_batches(waiting))


def _prepared(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.col(text_col).alias("text"))


def _groups(base: DataFrame) -> list[tuple[str, str]]:
    """All pairs of language and source. There are far fewer than rows in a result that pairs the sources."""
    return sorted((r.lang, r.source) for r in base.select("lang", "source").distinct().collect())


def _group_terms(base: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """group, term, n_docs, n; several rows of one term, from different spans."""
    numbers = {g: i for i, g in enumerate(groups)}
    rows = base.mapInArrow(lambda b: _chunks(b, numbers), "chunk string, place int, entries binary")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "place")
    terms = rows.mapInArrow(_terms, "span int, term string, times int, entries binary")
    terms = terms.repartition("span", "term").sortWithinPartitions("span", "term")
    return terms.mapInArrow(_merge, "group int, term string, n_docs long, n long")


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n_docs (documents with the term) and n (occurrences).

    Terms are runs of letters, where all signs beyond ASCII count as letters and A-Z are lowered. Null languages,
    sources and texts are empty. Rows count one by one, copies and rows with equal ids too; no id is needed and other columns are
    not looked at. An empty table gives an empty result. Chunks are told apart by 64-bit hashes inside a block
    and by their text beyond it. The pairs of language and source are held on the driver. ``docs`` should be a table or
    a plain scan, so that a task that runs again after a loss numbers its documents alike.
    """
    base = _prepared(docs, lang_col, source_col, text_col)
    groups = _groups(base)
    found = _group_terms(base, groups).groupBy("group", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    return found.join(_names(docs, groups), "group").select("lang", "source", "term", "n_docs", "n")


def _names(docs: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, *g) for i, g in enumerate(groups)]
    return F.broadcast(docs.sparkSession.createDataFrame(rows, "group int, lang string, source string"))  # one row per group


# ------------------------------------------------------------------------------------------- divergences
def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 1) / total), exactly."""
    if len(count) and int(count.max()) >= 9 * BILLION:
        return 1 + (BILLION * (count.astype(object) + 1) // total).astype(np.int64)
    return 1 + BILLION * (count + 1) // total


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Totals:
    """Sums by pair (x, y) of groups; handed on when there are many."""

    def __init__(self, groups: int):
        self.groups, self.codes, self.values, self.held = groups, [], [], 0

    def add(self, x, y, values):
        self.codes.append((x * self.groups + y).ravel())
        self.values.append(values.ravel())
        self.held += self.codes[-1].size
        return self.held > 4 * PAIRS and self._sum() > PAIRS

    def _sum(self) -> int:
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, at, np.concatenate(self.values))
        self.codes, self.values, self.held = [codes], [sums], len(codes)
        return len(codes)

    def taken(self) -> pa.RecordBatch:
        if self.codes:
            self._sum()
        codes, sums = (self.codes[0], self.values[0]) if self.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.codes, self.values, self.held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(codes // self.groups), pa.array(codes % self.groups), pa.array(sums)], ["x", "y", "part"])


def _common(batches, total: np.ndarray):
    """What terms of both sources add to a pair, beyond what each of the two adds alone."""
    sums, none = _Totals(len(total)), _share(np.zeros(len(total), np.int64), total)
    for b in batches:
        lists = b.column("groups")
        at, flat = lists.offsets.to_numpy(), lists.values
        group, n = flat.field("group").to_numpy().astype(np.int64), flat.field("n").to_numpy()
        p, many = _share(n, total[group]), np.diff(at)
        for m in np.unique(many[many > 1]).tolist():
            here = at[:-1][many == m]
            step = max(1, PAIRS // (m * m))
            for i in range(0, len(here), step):
                place = here[i : i + step, None] + np.arange(m)
                for k in range(0, m, max(1, PAIRS // m)):  # one term of very many sources, some of them at a time
                    x, y = place[:, k : k + max(1, PAIRS // m), None], place[:, None, :]
                    gx, gy = group[x], group[y]
                    value = _apart(p[x], p[y]) - _apart(p[x], none[gy]) - _apart(none[gx], p[y]) + _apart(none[gx], none[gy])
                    gx, gy = np.broadcast_arrays(gx, gy)
                    if sums.add(gx, gy, value):
                        yield sums.taken()
    yield sums.taken()


def _alone(batches, total: np.ndarray, lang: np.ndarray):
    """What the terms of one source add to its pairs, as if the other source lacked them. ``lang`` is sorted."""
    sums, none = _Totals(len(total)), _share(np.zeros(len(total), np.int64), total)
    for b in batches:
        group, n, terms = (b.column(c).to_numpy() for c in ("group", "n", "terms"))
        p = _share(n, total[group])
        for g, own, times in zip(group.tolist(), p.tolist(), terms.tolist()):
            low, high = np.searchsorted(lang, lang[g]), np.searchsorted(lang, lang[g], side="right")
            for k in range(low, high, PAIRS):
                other = np.arange(k, min(high, k + PAIRS))
                mine, own_ = np.full(len(other), g), np.int64(own)
                more = sums.add(mine, other, times * (_apart(own_, none[other]) - _apart(none[mine], none[other])))
                if sums.add(other, mine, times * (_apart(none[other], own_) - _apart(none[other], none[mine]))) or more:
                    yield sums.taken()
    yield sums.taken()


def _share_column(count: Column, total: Column) -> Column:
    wide = (count + 1).cast("decimal(19,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, total.cast("decimal(19,0)"))


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: how far the source is from each other source (item) of its language, summed over all terms that at least
    ``least_docs`` documents of the language have. Part ``term``: the terms that the source has more often than its
    language, up to ``ranks`` of them. Terms, nulls, copies and empty tables: see ``term_counts``; a source without terms takes
    part with a count of zero for each. Ties are ordered by item.
    """
    base = _prepared(docs, lang_col, source_col, text_col)
    groups = _groups(base)
    spark = docs.sparkSession
    languages = sorted({g[0] for g in groups})
    lang_of = np.array([languages.index(g[0]) for g in groups], np.int64)
    names = F.broadcast(spark.createDataFrame(
        [(i, int(lang_of[i]), *g) for i, g in enumerate(groups)], "group int, lang_no long, lang string, source string"))  # one row per group
    # one exchange by language and term serves both sums
    found = _group_terms(base, groups).join(names.select("group", "lang_no"), "group").repartition("lang_no", "term")
    found = found.groupBy("lang_no", "term", "group").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    kept = found.groupBy("lang_no", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.collect_list(F.struct("group", "n")).alias("groups")
    ).filter(F.col("n_docs") >= least_docs)
    kept = stage(kept, "kept-terms")
    each = kept.select("lang_no", "term", F.col("n").alias("lang_n"), F.inline("groups"))
    in_group = {r.group: r.n for r in each.groupBy("group").agg(F.sum("n").alias("n")).collect()}  # a row per group
    in_lang = {r.lang_no: r for r in kept.groupBy("lang_no").agg(F.sum("n").alias("n"), F.count("*").alias("terms")).collect()}
    terms = [in_lang[i].terms if i in in_lang else 0 for i in range(len(languages))]
    total = np.array([in_group.get(i, 0) + terms[lang_of[i]] for i in range(len(groups))], np.int64)
    totals = F.broadcast(spark.createDataFrame(  # one row per group
        [(i, int(t), int(in_lang[lang_of[i]].n + terms[lang_of[i]]) if lang_of[i] in in_lang else 0) for i, t in enumerate(total)],
        "group int, total long, lang_total long"))

    p, q = F.col("p"), F.col("q")
    shares = each.join(totals, "group").select(
        "group", "term", _share_column(F.col("n"), F.col("total")).alias("p"), _share_column(F.col("lang_n"), F.col("lang_total")).alias("q"))
    own = shares.filter(p > q).select("group", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    ordered = Window.partitionBy("group").orderBy(F.desc("value"), "item")
    top = own.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= ranks).withColumn("part", F.lit("term"))

    common = kept.select("groups").mapInArrow(lambda b: _common(b, total), "x long, y long, part long")
    same = each.groupBy("group", "n").agg(F.count("*").alias("terms"))
    alone = same.mapInArrow(lambda b: _alone(b, total, lang_of), "x long, y long, part long")
    sums = common.unionByName(alone).groupBy("x", "y").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
    least = spark.createDataFrame(
        [(i, int(terms[lang_of[i]]), int(1 + BILLION // t) if t else 1) for i, t in enumerate(total.tolist())], "group int, terms long, p0 long")
    sides = names.join(least, "group")
    x = sides.select(F.col("group").alias("x"), "lang_no", "terms", F.col("p0").alias("px"))
    y = sides.select(F.col("group").alias("y"), "lang_no", F.col("source").alias("item"), F.col("p0").alias("py"))
    pairs = x.join(y, "lang_no").filter("x <> y").join(sums, ["x", "y"], "left")
    value = F.expr("cast(terms as decimal(19,0)) * ((px - py) * (px - py) div py) + coalesce(sum, 0)").cast("long")
    pairs = pairs.select(F.col("x").alias("group"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ordered)).withColumn("part", F.lit("pair"))
    out = pairs.select("group", "part", "item", "value", "rank").unionByName(top.select("group", "part", "item", "value", "rank"))
    return out.join(names.select("group", "lang", "source"), "group").select("lang", "source", "part", "item", "value", "rank")
