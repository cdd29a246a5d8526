"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get
integer names; then adjacent names are paired and the distinct pairs named again, until a document has one
name. Names stand for contents, so equal names at the same level mean equal texts, and there is nothing to
collide: hashes only route rows, and two blocks with one hash are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import free_name, least_row, numbered, stage, with_row
from tokenmill.operators.sizes import broadcast_if_small

BLOCK_BYTES = 8192
MISSING = -1  # right partner of a last name without one


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def _blocks(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """``docs`` has row and norm: one row per block."""
    data = docs.select("row", F.expr("cast(norm as binary)").alias("data"))
    names = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int")
    data = data.withColumn("names", names)
    parts = F.transform(
        F.sequence(F.lit(0), F.col("names") - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes))
    )
    rows = data.select("row", "names", F.posexplode(parts).alias("pos", "block"))
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1).cast("long")
    return rows.withColumn("h", F.xxhash64("block").bitwiseAND(mask))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                 hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; a null id comes last, and of rows with one id the
    first in the table stays. Null and empty texts are equal, and so are texts of white space only, which
    normalise to one space. An empty table gives an empty result. Other columns are not looked at.
    ``docs`` must be a table or a plain scan, because it is read twice. ``hash_bits`` is for tests.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    base = base.select("row", "doc_id", normalised(F.col("text")).alias("norm"))
    blocks = _blocks(base, block_bytes, hash_bits)

    named = stage(numbered(blocks, ["block", "h"], "name").select("h", "name"), "block-names")
    clash = stage(named.groupBy("h").count().filter("count > 1").select("h"), "block-clashes")
    index = blocks.join(named.join(broadcast_if_small(clash, 100_000), "h", "left_anti"), "h")
    if not clash.isEmpty():  # one hash, several contents: these blocks are named by content alone
        few = blocks.join(broadcast_if_small(clash, 100_000), "h", "left_semi")
        own = stage(numbered(few, ["block"], "name").select("block", (-2 - F.col("name")).alias("name")), "clash-names")
        index = index.select("row", "names", "pos", "name").unionByName(few.join(own, "block").select("row", "names", "pos", "name"))
    names = stage(index.select("row", "names", "pos", "name"), "names-0")
    most = names.agg(F.max("names")).first()[0] or 1

    one, level = names.filter("names = 1").select("row", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        level += 1
        pairs = names.filter("names > 1").groupBy("row", "names", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(MISSING)).alias("right"),
        )
        next_names = pairs.join(numbered(pairs, ["left", "right"], "name"), ["left", "right"])
        names = stage(next_names.select("row", F.expr("(names + 1) div 2").cast("int").alias("names"), "pos", "name"), f"names-{level}")
        one = one.unionByName(names.filter("names = 1").select("row", F.lit(level).alias("level"), "name"))
        most = (most + 1) // 2

    sums = base.select("row", "doc_id", F.sha2(F.expr("cast(norm as binary)"), 256).alias("text_sha256"))
    members = stage(sums.join(one, "row"), "named-documents")
    groups = members.groupBy("level", "name").agg(least_row(F.col("doc_id"), F.col("row")).alias("first"), F.count("*").alias("group_size"))
    # written, so that the join below has two plain inputs and a large group can be split; most texts have no copy
    groups = stage(groups.filter("group_size > 1").select("level", "name", "first.*", "group_size"), "groups")
    copied = F.col("group_size").isNotNull()
    return members.join(groups.withColumnRenamed("row", "first_row"), ["level", "name"], "left").select(
        "row", "doc_id", F.when(copied, F.col("key")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~copied | (F.col("row") == F.col("first_row"))).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    row = free_name(docs, "row_of_text")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("row").alias(row))
    return with_row(docs, row).join(kept, row, "left_semi").drop(row)
