"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import stage

__all__ = ["SPACE", "WORD", "free_name", "input_table", "least_row", "numbered", "stage", "with_row"]

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or a longer name if the table has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Adds a number for each row. The same table read again gives the same numbers, as long as it is a
    plain scan: the numbers come from the place in the scan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with a number each: hash partitions are sorted, and rows numbered in their order."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def least_row(key: Column, row: Column) -> Column:
    """The smallest key, nulls last, and the row that has it; the lower row number wins a tie."""
    return F.min(F.struct(key.isNull().alias("none"), key.alias("key"), row.alias("row")))
