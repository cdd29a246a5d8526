"""Jaccard join on word shingles by parity sketches.

A sketch has one bit for every (part, position); each shingle flips the bit that its hash names, so a bit is
the parity of the shingles there. The Hamming distance of two sketches is at most the size of the symmetric
difference of the sets. In a band of sizes this difference is at most k for sets that link, so of k + s parts
at least s are equal: sets are joined on equal parts (pigeonhole), and what meets is verified. A sketch is
kept sparse: a part is the XOR of random codes of its set bits.

Documents with one set form a class and stand for each other. Classes in a part that few share are paired, and
pairs that share too few parts are dropped before any set is fetched. Classes that meet in a part that many
share form a family. A family is cut into blocks, and two blocks at a time are compared inside a task by dense
sketches; a pair whose Hamming distance allows a link is verified at once, unless links found before connect
it already. So a family yields no more links than it has members, for each pair of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import least_row, stage, with_row, free_name
from tokenmill.llm.components import components

BAND = 0.7  # ratio of a band's lower to its upper size
FEW = 100  # classes in a part that are paired with each other
BLOCK = 1 << 19  # shingles in a block of a family, about
_KEY_COLUMNS = ["key", "class", "n", "band", "given"]
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Join:
    """``width`` words a shingle; sets link when 100 * intersection >= percent * union."""

    width: int = 4
    percent: int = 85

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest size and number of parts of each band; k is the greatest difference of two sets that link. A set also goes into the
        band above if a set there can link with it, so two sets of one band have the larger k."""
        least = [1]
        while least[-1] < 1 << 40:
            least.append(max(least[-1] + 1, int(least[-1] / BAND)))
        top = np.array(least[1:]) - 1
        k = 2 * (100 - self.percent) * top // (100 + self.percent)
        return np.array(least), np.where(k > 0, k + 4 + k // 3, 0)

    def link(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def _sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    raw = tb.lower(raw)
    starts, ends, first = tb.spans(raw, offsets)
    hashes, at = tb.shingles(tb.hash_spans(raw, starts, ends), first, width)
    return tb.distinct(hashes, at)


def _class_of(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set. Each is over independent codes of the members."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    out = []
    for salt in (_A, _B):
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, text, tb.mix(values + salt))
        out.append(tb.mix(total + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _members(batches, width: int):
    for b, raw, offsets in tb.slices(batches, "text"):
        values, at = _sets(raw, offsets, width)
        one, two = _class_of(values, at)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(one), pa.array(two)],
            ["row", "doc_id", "n_shingles", "class", "check"],
        )


def part_keys(values: np.ndarray, at: np.ndarray, join: Join) -> tuple[np.ndarray, ...]:
    """Text, key, band and number of keys in the band, of every part to join on.

    Parts with fewer than two set bits say little and are left out; there are spare parts for that. A set
    that is left with no more parts than may differ also gets its smallest shingles as keys, as many as two linking sets can't
    both miss; their band is -1.
    """
    least, parts = join.bands()
    n = np.diff(at)
    own = np.searchsorted(least, n, side="right") - 1
    above = np.flatnonzero((n > 0) & (100 * n >= join.percent * least[own + 1]))
    rows = np.concatenate([np.flatnonzero(n > 0), above])
    band = np.concatenate([own[n > 0], own[above] + 1])
    rows, band = rows[parts[band] > 0], band[parts[band] > 0]
    size, p = n[rows], parts[band]
    begin = np.concatenate([[0], np.cumsum(size)])
    x = values[np.repeat(at[:-1][rows] - begin[:-1], size) + np.arange(begin[-1])]
    code = tb.mix(x + np.repeat(band, size).astype(np.uint64) * _A)
    part = ((code >> _U(32)) * np.repeat(p, size).astype(np.uint64)) >> _U(32)
    slots = np.concatenate([[0], np.cumsum(p)])
    slot = np.repeat(slots[:-1], size) + part.astype(np.int64)
    word, bits = np.zeros(slots[-1], np.uint64), np.bincount(slot, minlength=slots[-1])
    np.bitwise_xor.at(word, slot, tb.mix(x))
    row = np.repeat(np.arange(len(rows)), p)
    number = np.arange(slots[-1]) - slots[:-1][row]
    full = bits >= 2
    key = tb.mix(word + tb.mix(number.astype(np.uint64) * _B + band[row].astype(np.uint64)))[full]
    given = np.bincount(row[full], minlength=len(rows))
    top = np.minimum(100 * size // join.percent, least[band + 1] - 1)  # the largest set to link with, in this band
    poor = np.flatnonzero(given <= (100 - join.percent) * (size + top) // (100 + join.percent))
    ahead = size[poor] - (join.percent * size[poor] + 99) // 100 + 1
    where = np.repeat(begin[:-1][poor] - np.concatenate([[0], np.cumsum(ahead)])[:-1], ahead) + np.arange(ahead.sum())
    rest = tb.mix(x[where] ^ _B)
    none = np.zeros(len(rest), np.int64)
    return (
        np.concatenate([rows[row[full]], np.repeat(rows[poor], ahead)]), np.concatenate([key, rest]),
        np.concatenate([band[row[full]], none - 1]), np.concatenate([given[row[full]], none]),
    )


def _parts(batches, join: Join):
    """Keys of the classes; a task emits a class once, however many copies it meets."""
    seen: set[int] = set()
    for b, raw, offsets in tb.slices(batches, "text"):
        values, at = _sets(raw, offsets, join.width)
        one, _ = _class_of(values, at)
        new = []
        for i, c in enumerate(one.tolist()):
            if c not in seen:
                seen.add(c)
                new.append(i)
        text, key, band, given = part_keys(values, at, join)
        first = np.zeros(len(one), bool)
        first[new] = True
        keep = first[text]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[keep].view(np.int64)), pa.array(one[text[keep]]), pa.array(np.diff(at)[text[keep]], pa.int64()),
             pa.array(band[keep], pa.int32()), pa.array(given[keep], pa.int32())],
            _KEY_COLUMNS,
        )


def _stored(batches, width: int):
    for b, raw, offsets in tb.slices(batches, "text"):
        values, at = _sets(raw, offsets, width)
        one, _ = _class_of(values, at)
        data = values.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(np.diff(at), pa.int64()), pa.array([data[8 * a : 8 * z] for a, z in zip(at[:-1], at[1:])], pa.binary())],
            ["class", "n", "shingles"],
        )


def _verify(batches, join: Join):
    """Compares sets a and b."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            linked.append(bool(join.link(_shared(x, y), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _likely(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs of classes in parts that few share, without those that share too few such parts to link.

    Of the parts that a set gives in a band, at most as many differ in the other set as shingles may differ.
    A pair that also shares one of the other parts is in a family, so these need not be counted here.
    """
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, "key").filter("x.class < y.class")
    differ = F.floor((100 - join.percent) * (F.col("x.n") + F.col("y.n")) / (100 + join.percent))
    both = both.select(
        F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.band").alias("band"),
        (F.greatest("x.given", "y.given") - differ).alias("needed"),
    )
    both = both.groupBy("a", "b", "band").agg(F.count("*").alias("shared"), F.max("needed").alias("needed"))
    return both.filter("shared >= needed").select("a", "b").distinct()


def _dense(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity sketches of ``bits`` bits, as rows of 64-bit words."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, x in zip(out, sets):
        at = (tb.mix(x ^ _A) & _U(bits - 1)).astype(np.int64)
        odd = np.flatnonzero(np.bincount(at, minlength=bits) & 1)
        np.bitwise_or.at(row, odd >> 6, _U(1) << (odd & 63).astype(np.uint64))
    return out


def _block_links(group: pa.Table, join: Join) -> pa.Table:
    """Links between the classes of one block, or of two blocks: enough to connect what is connected."""
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    group = group.sort_by([("n", "ascending"), ("class", "ascending")])
    classes, block = group.column("class").to_pylist(), group.column("block").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
    n = np.array([len(x) for x in sets])
    differ = 2 * (100 - join.percent) * int(n.max()) // (100 + join.percent)
    sketch = _dense(sets, 1 << max(8, int(8 * differ).bit_length()))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i in range(len(sets)):
        end = int(np.searchsorted(n, 100 * n[i] // join.percent, side="right"))  # larger sets can't link
        apart = np.bitwise_count(sketch[i + 1 : end] ^ sketch[i]).sum(1)
        near = apart * (100 + join.percent) <= (100 - join.percent) * (n[i] + n[i + 1 : end])
        if low != high:
            near &= block[i + 1 : end] != block[i]  # pairs inside a block are compared in its own group
        for j in (np.flatnonzero(near) + i + 1).tolist():
            x, y = top(i), top(j)
            if x != y and join.link(_shared(sets[i], sets[j]), n[i], n[j]):
                root[y] = x
                a.append(classes[i])
                b.append(classes[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _family_links(many: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links inside families. ``many``: key and class of the parts that many classes share."""
    first = many.groupBy("key").agg(F.min("class").alias("least"))
    # each class goes with the least class of its parts; then only parts whose classes went to several need links
    went = stage(many.join(first, "key").groupBy("class").agg(F.min("least").alias("to")), "first-steps")
    rows = stage(many.join(went, "class", "left").select("key", "class", "to"), "stepped-parts")
    ends = rows.groupBy("key").agg(F.min("to").alias("a"), F.max("to").alias("z")).filter("a < z").select("key", "a")
    meet = rows.join(ends, "key").filter("to <> a").select("a", F.col("to").alias("b")).distinct()
    meet = meet.unionByName(went.select(F.col("to").alias("a"), F.col("class").alias("b")))
    family = components(meet).select(F.col("node").alias("class"), F.col("component").alias("family"))
    members = family.join(sets.select("class", "n"), "class")
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = stage(members.join(blocks, "family"), "families").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.join(sets.select("class", "shingles"), "class").select(
        "family", "class", "n", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "shingles"
    )
    return members.groupBy("family", "low", "high").applyInArrow(lambda t: _block_links(t, join), "a long, b long")


def _sets_of(base: DataFrame, members: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class, n and shingles; one row of each class is read again for it."""
    first = members.filter("n_shingles > 0").groupBy("class").agg(F.min("row").alias("row"))
    rows = first.join(classes.distinct(), "class", "left_semi").select("row")
    texts = base.join(rows, "row", "left_semi").select("text")
    return stage(texts.mapInArrow(lambda b: _stored(b, width), "class long, n long, shingles binary"), "sets")


def near_groups(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id among all documents that links lead to; ``kept`` marks one row of each
    component, that with the smallest id (nulls last; of equal ids the first). A text with fewer words than
    a shingle has its whole sequence as one; a text without words has an empty set, links with nothing and is
    a component of its own. A null text is empty. Two rows with the same set link, whatever their ids. Sets
    are compared by 64-bit hashes of their shingles. An empty table gives an empty result; other columns are
    not looked at. ``docs`` must be a table or a plain scan, because it is read more than once. ``few`` is the
    number of classes in a part up to which they are compared pair by pair; it does not change the result.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    kind = base.schema["doc_id"].dataType.simpleString()
    members = stage(
        base.mapInArrow(lambda b: _members(b, join.width), f"row long, doc_id {kind}, n_shingles long, class long, check long"), "members"
    )
    parts = base.select("text").mapInArrow(lambda b: _parts(b, join), "key long, class long, n long, band int, given int")
    by_key = Window.partitionBy("key")
    shared = parts.select("*", F.min("class").over(by_key).alias("low"), F.max("class").over(by_key).alias("high"))
    keys = stage(shared.filter("low < high").select(*_KEY_COLUMNS).distinct(), "shared-parts")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"))
    rows = stage(keys.join(sizes, "key"), "sized-parts")
    pairs = stage(_likely(rows.filter(F.col("size") <= few), join), "likely-pairs")
    many = rows.filter(F.col("size") > few).select("key", "class")
    wanted = many.select("class").unionByName(pairs.select(F.col("a").alias("class"))).unionByName(pairs.select(F.col("b").alias("class")))
    sets = _sets_of(base, members, wanted, join.width)
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    links = stage(both.mapInArrow(lambda x: _verify(x, join), "a long, b long"), "links-of-parts")
    if not many.isEmpty():
        links = links.unionByName(stage(_family_links(many, sets, join), "links-of-families"))
    label = components(links).select(F.col("node").alias("class"), "component")
    grouped = members.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # empty sets are components of their own: their row number takes the place of the class
    alone = F.col("n_shingles") == 0
    grouped = stage(
        grouped.select("row", "doc_id", "n_shingles", alone.alias("alone"), F.when(alone, F.col("row")).otherwise(F.col("component")).alias("component")),
        "grouped",
    )
    least = grouped.groupBy("alone", "component").agg(least_row(F.col("doc_id"), F.col("row")).alias("first"), F.count("*").alias("size"))
    # written, so that the join below has two plain inputs and a large component can be split
    least = stage(least.filter("size > 1").select("alone", "component", F.col("first.key").alias("key"), F.col("first.row").alias("first_row")), "least")
    grown = F.col("first_row").isNotNull()
    return grouped.join(least, ["alone", "component"], "left").select(
        "row", "doc_id", "n_shingles", F.when(grown, F.col("key")).otherwise(F.col("doc_id")).alias("component_id"),
        (~grown | (F.col("row") == F.col("first_row"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, join: Join = Join(5, 80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all columns of ``docs``."""
    row = free_name(docs, "row_of_set")
    kept = near_groups(docs, join, id_col, text_col).filter("kept").select(F.col("row").alias(row))
    return with_row(docs, row).join(kept, row, "left_semi").drop(row)
