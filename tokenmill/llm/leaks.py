"""Benchmark passages in documents: a prefix-filtered join of shingles, in DataFrame functions alone.

An item is cut into windows of ``WINDOW`` words, and a window into shingles of ``SHINGLE`` words. A document holds a
window only if it holds all of its shingles, so of the shingles in order of rarity the first one is the necessary
prefix: documents and windows meet on it alone. The rarity is counted over the documents. A place where they meet
fixes where the window must begin; it is left out if the window would begin before the text or end behind it. What
is left is verified: the document's words at that place, as long as the window, are joined with the windows' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import stage, with_row
from tokenmill.operators.sizes import broadcast_if_small

WINDOW = 10
SHINGLE = 3
SMALL = 1_000_000  # rows of shingles, windows or documents that are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z are lowered


def words_of(text: Column) -> Column:
    """Lower-cased words of letters and digits; all signs beyond ASCII count as letters. Null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), lambda w: w != "")


def _shingles(words: Column, size: Column, width: int) -> Column:
    """Places and hashes of the runs of ``width`` words."""
    hashes = F.transform(
        F.sequence(F.lit(0), size - width),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("key")),
    )
    return F.when(size >= width, hashes).otherwise(F.array().cast("array<struct<pos: int, key: bigint>>"))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id (a string), window (its words with spaces between) and size: each distinct window of each item. An item of
    fewer words is one window; one without words has none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = items.select("item_id", "words", F.explode(starts).alias("start"))
    cut = cut.select("item_id", F.slice("words", F.col("start"), window).alias("part"))
    return cut.select("item_id", F.array_join("part", " ").alias("window"), F.size("part").alias("size")).distinct()


def window_shingles(windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """window, size, pos and key of the shingles of distinct windows; a window of fewer words is one shingle."""
    out = None
    for k in range(1, width + 1):
        mine = windows.filter(F.col("size") >= k if k == width else F.col("size") == k)
        words = F.split("window", " ")
        cut = mine.select("window", "size", F.inline(_shingles(words, F.size(words), k)))
        out = cut if out is None else out.unionByName(cut)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", window: int = WINDOW, width: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (distinct, sorted as strings).

    A word is hit if it lies in an occurrence of a window of an item. Null, empty and blank texts have no words: as
    documents they have no hits, as items they never occur. Rows with equal ids stay rows of their own; items with
    equal ids count once, items with a null id hit words but are in no list. Other columns are not looked at. An empty
    table of documents gives an empty result, an empty benchmark no hits. ``docs`` must be a table or a plain scan,
    because it is read again where windows may occur. A table of more than ``small`` rows is joined by shuffle
    instead of broadcast, with the same result.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    items = stage(item_windows(benchmark, item_id_col, item_text_col, window), "item-windows")
    pieces = stage(window_shingles(items.select("window", "size").distinct(), width), "window-shingles")
    widths = sorted({min(r["size"], width) for r in pieces.select("size").distinct().collect()})  # at most ``width`` + window sizes
    keys = broadcast_if_small(pieces.select("key").distinct(), small).withColumn("known", F.lit(True))
    split = base.select("row", "doc_id", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # a first row stands for the document itself
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.col("row").alias("key")))
    places = F.concat(head, *[_shingles(F.col("words"), F.col("n_words"), k) for k in widths])
    met = split.select("row", "doc_id", "n_words", F.inline(places)).join(keys, "key", "left")
    met = stage(met.filter("pos < 0 or known").drop("known"), "known-shingles")
    hits, heads = met.filter("pos >= 0").select("row", "n_words", "pos", "key"), met.filter("pos < 0").select("row", "doc_id", "n_words")
    # the rarest shingle of each window, the first of equal ones; a window with a shingle that no document has is gone
    counts = hits.groupBy("key").agg(F.count("*").alias("n"))
    prefix = pieces.join(counts, "key", "left").groupBy("window", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pos").alias("offset"), F.col("key"))).alias("rarest"))
    prefix = stage(prefix.filter("rarest.n > 0").select("size", "rarest.offset", "rarest.key").distinct(), "prefixes")
    start = F.col("pos") - F.col("offset")
    begun = hits.join(broadcast_if_small(prefix, small), "key").filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    begun = stage(begun.groupBy("row").agg(F.collect_set(F.struct(start.alias("start"), F.col("size"))).alias("begun")), "places")
    texts = base.join(broadcast_if_small(begun.select("row"), small), "row", "left_semi").select("row", words_of(F.col("text")).alias("words"))
    cut = texts.join(begun, "row").select("row", F.inline(F.transform("begun", lambda b: F.struct(
        b["start"].alias("start"), b["size"].alias("size"),
        F.array_join(F.slice("words", b["start"] + 1, b["size"]), " ").alias("window")))))
    known = items.select("window").distinct()
    found = stage(cut.join(broadcast_if_small(known, small), "window", "left_semi"), "occurrences")
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    news = end - F.greatest("start", F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = found.select("row", news.cast("long").alias("news")).groupBy("row").agg(F.sum("news").alias("n_hit"))
    # each distinct window of a document once, then its items
    named = found.select("row", "window").distinct().join(broadcast_if_small(items.select("window", "item_id"), small), "window")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return heads.join(hit, "row", "left").join(named, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, whose id has no hit word; a null id stays only if no row with a null id has one."""
    bad = find_leaks(docs, benchmark, id_col, text_col).filter("n_hit > 0").select(F.col("doc_id").alias("_leaking_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_leaking_id"]), "left_anti")
