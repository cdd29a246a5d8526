"""Order-dependent kernels that never put a hot key into one task.

A key may hold a third of all rows. Keys are counted first, which reads no other column and is
reduced before its shuffle. Up to ``HOT_ROWS`` rows, a key is a plain window over one shuffle. Keys
beyond that are cut into slices by a monotone expression of the order column: each slice is reduced
before the shuffle, what a slice inherits from the slices before it is worked out on that small
table, and single rows are only looked at slice by slice. The join to the inherited values and the
row window share one shuffle on (keys, slice).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.sizes import broadcast_if_small
from tokenmill.session import ensure_checkpoint_dir, stage


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_slice(ts: Column, seconds: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000))).cast("bigint")


HOT_ROWS = 1_000_000
PARTS = 64
MAX_HOT_KEYS = 1_000_000


class HotKeys(NamedTuple):
    """Keys with more than ``HOT_ROWS`` rows; ``rows`` is None where there are none."""

    by: list[str]
    rows: DataFrame | None


def find_hot_keys(df: DataFrame, by: list[str]) -> HotKeys:
    hot = df.groupBy(*by).count().where(F.col("count") > HOT_ROWS).select(*by, F.lit(True).alias("_hot"))
    return HotKeys(by, None if hot.isEmpty() else broadcast_if_small(stage(hot, "hot-keys"), MAX_HOT_KEYS))


def _cut_hot_keys(df: DataFrame, keys: list[str], slice_by: Column, hot: HotKeys | None) -> DataFrame | None:
    """Rows with ``_slice``, null for ordinary keys; None if there is no hot key at all."""
    hot = hot or find_hot_keys(df, keys)
    if hot.rows is None:
        return None
    return df.join(hot.rows, hot.by, "left").withColumn("_slice", F.when(F.col("_hot"), slice_by)).drop("_hot")


def running_total(
    df: DataFrame, keys: list[str], slice_by: Column, order: list[str], measure: Column, out: str,
    inclusive: bool = False, hot: HotKeys | None = None,
) -> DataFrame:
    """``out`` = sum of ``measure`` over the key's earlier rows (and the row itself if inclusive).

    ``slice_by`` must not decrease along ``order``. Null measures count as zero. ``hot`` saves the
    count where the hot keys are known, or where some of ``keys`` tell them as well.
    """
    upto = 0 if inclusive else -1
    zero = F.lit(0)
    rows = _cut_hot_keys(df, keys, slice_by, hot)
    if rows is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumn("_m", measure).withColumn(out, F.coalesce(F.sum("_m").over(plain), zero)).drop("_m")
    rows = rows.withColumn("_m", measure)
    totals = rows.where("_slice IS NOT NULL").groupBy(*keys, "_slice").agg(F.sum("_m").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_slice", F.sum("_t").over(before).alias("_base"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    return (
        rows.join(base, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_base", zero) + F.coalesce(F.sum("_m").over(local), zero))
        .select(*df.columns, out)
    )


def rank_in_key(
    df: DataFrame, keys: list[str], slice_by: Column, order: list[str], out: str, hot: HotKeys | None = None
) -> DataFrame:
    """1-based position of the row within its key."""
    return running_total(df, keys, slice_by, order, F.lit(1).cast("bigint"), out, inclusive=True, hot=hot)


def number_rows(df: DataFrame, order: list[str], out: str, start: int = 1) -> DataFrame:
    """``out`` = position of the row in the order of the whole table, from ``start`` on.

    Rows are dealt by ranges of the order and sorted inside them; only a count for each range meets on the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return number_in_place(ranged, out, start)


def number_in_place(df: DataFrame, out: str, start: int = 1) -> DataFrame:
    """``out`` = position of the row as the partitions stand, from ``start`` on, without gaps."""
    low = F.lit((1 << 33) - 1)  # monotonically_increasing_id keeps the partition above these bits
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(low)).drop("_id"), "placed")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row per partition
    before, offsets = start, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part bigint, _base bigint"))
    return placed.join(base, "_part").withColumn(out, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def previous_value(
    df: DataFrame, keys: list[str], slice_by: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """``lag`` by one row, with the slice's first row reading the last row of the slice before."""
    rows = _cut_hot_keys(df, keys, slice_by, None)
    if rows is None:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    last = rows.where("_slice IS NOT NULL").groupBy(*keys, "_slice").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_v"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    base = last.select(*keys, "_slice", F.lag("_v").over(by_slice).alias("_inherited"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    prev = F.coalesce(F.lag(F.struct(value)).over(local), F.col("_inherited"))
    return (
        rows.join(base, [*keys, "_slice"], "left")
        .withColumn(out, prev.getField(value))
        .select(*df.columns, out)
    )


# --------------------------------------------------------------------------------- greedy kernel
def greedy_ttl(
    df: DataFrame, keys: list[str], ts: str, row_id: str, ttl_seconds: Column, fold_rows: int = 50_000
) -> DataFrame:
    """Rows that fire: the first of a key, then each first row at least ``ttl`` after the last fired.

    Returns (keys, ts, row_id) of the rows that fire; equal times are ordered by ``row_id``. ``ttl``
    may differ between keys but not within one.

    A slice is one ttl long, so it holds at most one firing row, and a pause of a ttl or more, after
    which the next row always fires, can only lie between slices. That splits a key into independent
    sessions. Sessions of up to ``fold_rows`` rows are folded as an array; longer ones are solved by
    pointer doubling over slices, see ``_long_sessions``.
    """
    ev = df.select(
        *keys, F.col(ts).alias("_ts"), F.col(row_id).alias("_id"), micros(F.col(ts)).alias("_t"),
        (ttl_seconds.cast("bigint") * 1_000_000).alias("_ttl"),
    ).withColumn("_slice", F.floor(F.col("_t") / F.col("_ttl")).cast("bigint"))
    per_slice = ev.groupBy(*keys, "_slice").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n"), F.max("_ttl").alias("_ttl")
    )
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    starts = F.col("_lo") - F.lag("_hi").over(by_key) >= F.col("_ttl")
    sessions = per_slice.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_new").over(by_key)
    )
    whole = Window.partitionBy(*keys, "_session")
    sized = stage(
        sessions.withColumn("_rows", F.sum("_n").over(whole)).select(*keys, "_slice", "_session", "_rows", "_lo"),
        "sessions",
    )
    ev = ev.join(sized, [*keys, "_slice"])
    group = [*keys, "_session"]

    seen = F.col("_rows") <= fold_rows
    step = lambda acc, e: F.when(
        acc.last.isNull() | (e._t >= acc.last + F.col("_ttl")),
        F.struct(e._t.alias("last"), F.concat(acc.fired, F.array(e)).alias("fired")),
    ).otherwise(acc)
    folded = (
        ev.where(seen).groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_id", "_ts"))).alias("_all"), F.max("_ttl").alias("_ttl"))
        .withColumn(
            "_r",
            F.aggregate(
                "_all",
                F.struct(F.lit(None).cast("bigint").alias("last"), F.slice("_all", 1, 0).alias("fired")),
                step,
            ),
        )
        .select(*keys, F.explode("_r.fired").alias("_f"))
        .select(*keys, F.col("_f._ts").alias(ts), F.col("_f._id").alias(row_id))
    )
    span = (
        sized.where(~seen).groupBy(*group).agg((F.max("_slice") - F.min("_slice")).alias("s"))
        .agg(F.max("s")).first()[0]
    )
    if span is None:
        return folded
    return folded.unionByName(
        _long_sessions(ev.where(~seen), group, int(span)).select(
            *keys, F.col("_ts").alias(ts), F.col("_id").alias(row_id)
        )
    )


def _long_sessions(ev: DataFrame, group: list[str], span: int) -> DataFrame:
    """Greedy chain of long sessions without walking them.

    Every row points to the first row a ttl later. ``hop[j]`` leads from a row out of its block of
    ``2**j`` slices; it is only kept for rows through which a chain can enter such a block, so the
    tables halve from level to level. Going back down, the entry of a block and its first half's hop
    give the entry of the second half, until every slice knows its own entry, the row that fires.
    """
    ensure_checkpoint_dir(ev.sparkSession)
    rows = (
        ev.groupBy(*group, "_t").agg(
            F.min_by(F.struct("_id", "_ts"), "_id").alias("_row"), F.first("_slice").alias("_slice"),
            F.first("_ttl").alias("_ttl"), F.first("_lo").alias("_lo"),
        )
    ).checkpoint()

    # The first row at or after t + ttl: within its part of a slice by a window, else the first row of
    # the next part that has any. Parts keep the windows short where a slice holds very many rows.
    part = F.floor(F.col("_t") / (F.col("_ttl") / PARTS)).cast("bigint")
    null = F.lit(None).cast("bigint")
    marks = rows.select(*group, "_ttl", "_t", F.col("_t").alias("_row_t"), null.alias("_from"))
    probes = rows.select(*group, "_ttl", (F.col("_t") + F.col("_ttl")).alias("_t"), null.alias("_row_t"),
                         F.col("_t").alias("_from"))
    both = marks.unionByName(probes).withColumn("_part", part)
    later_parts = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = both.groupBy(*group, "_part").agg(F.min("_row_t").alias("_min")).select(
        *group, "_part", F.last("_min", ignorenulls=True).over(later_parts).alias("_beyond")
    )
    backwards = Window.partitionBy(*group, "_part").orderBy(F.desc("_t"), F.col("_from").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    to = F.coalesce("_hit", "_beyond")
    onwards = (
        both.join(beyond, [*group, "_part"])
        .withColumn("_hit", F.last("_row_t", ignorenulls=True).over(backwards))
        .where("_from IS NOT NULL")
        .select(*group, F.col("_from").alias("_t"), to.alias("_nt"), F.floor(to / F.col("_ttl")).cast("bigint").alias("_ns"))
    )
    hop = (
        rows.join(onwards, [*group, "_t"])
        .select(*group, "_t", "_slice", (F.col("_t") == F.col("_lo")).alias("_first"), "_nt", "_ns")
        .checkpoint()
    )
    hops = [hop]
    block = lambda c, j: F.shiftright(c, j)
    stays = lambda j: F.col("_ns").isNotNull() & (block(F.col("_ns"), j) == block(F.col("_slice"), j))
    levels = max(1, span.bit_length())
    for j in range(1, levels + 1):
        onward = hops[-1].select(
            *group, F.col("_t").alias("_nt"), F.col("_nt").alias("_nt2"), F.col("_ns").alias("_ns2")
        )
        entries = hops[-1].where(F.col("_first") | (F.col("_slice") % (1 << j) == 0))
        hops.append(
            entries.join(onward, [*group, "_nt"], "left")
            .select(*group, "_t", "_slice", "_first",
                    F.when(stays(j), F.col("_nt2")).otherwise(F.col("_nt")).alias("_nt"),
                    F.when(stays(j), F.col("_ns2")).otherwise(F.col("_ns")).alias("_ns"))
            .checkpoint()
        )
    reached = lambda d: d.select(*group, F.col("_nt").alias("_t"))
    fired = rows.groupBy(*group).agg(F.min("_t").alias("_t"))
    first_hop = fired.join(hops[-1], [*group, "_t"]).where(F.col("_nt").isNotNull())
    fired = fired.unionByName(reached(first_hop)).checkpoint()
    for j in range(levels - 1, -1, -1):
        second_half = fired.join(hops[j], [*group, "_t"]).where(stays(j + 1))
        fired = fired.unionByName(reached(second_half)).checkpoint()
    return rows.join(fired, [*group, "_t"], "left_semi").select(*group, "_row.*")
