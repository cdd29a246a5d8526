"""Change rows applied to rule and sample tables: the last change of a row wins."""

from __future__ import annotations

import sys
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.ordered import rank_in_key
from tokenmill.session import stage, work_dir

PAIR = ["intent", "model"]
BASE = -(2**63)
CHANGE_SLICE = 4096
WALK_ROWS = 1_000_000  # moves of a group that one task walks through
MOST_LINKS = 100_000  # pairs of intents on the driver
MOST_ROUNDS = 100  # of a group before it is cut finer
LEAST_ROUND = 64
# the walk travels to the workers itself, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def apply_changes(base: DataFrame, changes: DataFrame, row_id: str, order: str = "change_id") -> DataFrame:
    """``base`` after upserts and deletes of (order, row_id, op, fields...).

    ``max_by`` reduces a row's changes before the shuffle, so a row that changes all the time is cheap.
    """
    fields = [c for c in base.columns if c != row_id]
    newest = changes.groupBy(row_id).agg(
        F.max_by(F.struct("op", *fields), order).alias("_new")
    )
    old = base.select(row_id, F.struct(*fields).alias("_old"))
    merged = old.join(newest, row_id, "full_outer").where(F.coalesce(F.col("_new.op") != "delete", F.lit(True)))
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return merged.select(row_id, *[pick(c).alias(c) for c in fields])


def rule_change_apply(rules: DataFrame, changes: DataFrame, most: int = WALK_ROWS) -> DataFrame:
    """Rules after the changes, applied in order of ``change_id``.

    An upsert to an (intent, model) that another rule holds at that moment is refused, and its rule
    stays as it was. Pairs that the base holds twice stay; a null in a pair collides with nothing. A rule changes
    at most once under one ``change_id``; of several rules under one, the smaller id comes first.

    Whether a change is refused depends only on rules that meet it, directly or through others. Rules that share
    intents form a group; a group of up to ``most`` changes is one walk in order, in one task. A larger group
    is walked in rounds of up to ``most`` changes, each going on from what the round before left. Where that
    would take very many rounds, it is first cut finer, by the (intent, model) pairs that its rules share.
    """
    fields = ["id", "change_id", "op", *PAIR]
    base = rules.select("id", F.lit(BASE).alias("change_id"), F.lit("base").alias("op"), *PAIR)
    moves = stage(base.unionByName(changes.select(*fields)), "moves")
    groups = _by_intents(moves)
    walks, large, most_moves = _split(moves, _by_pairs(moves) if groups is None else groups, most)
    parts = [] if walks is None else [_walked(walks)]
    if groups is not None and most_moves > most * MOST_ROUNDS:
        large = stage(large.drop("group"), "large-groups")
        finer, large, most_moves = _split(large, _by_pairs(large), most)
        parts += [] if finer is None else [_walked(finer)]
    if large is not None:
        parts.append(_in_rounds(large, max(most, LEAST_ROUND)))
    refused = reduce(DataFrame.unionByName, parts)
    kept = changes.join(refused, ["id", "change_id"], "left_anti")
    return apply_changes(rules, kept, "id")


NAMED = "op <> 'delete' AND intent IS NOT NULL AND model IS NOT NULL"


def _by_intents(moves: DataFrame) -> DataFrame | None:
    """(id, group): rules whose intents are linked by rules that go from one to another; None with very many intents.

    Links of intents are distinct pairs, so they are few however many changes there are.
    """
    named = moves.where(NAMED)
    first = named.groupBy("id").agg(F.min("intent").alias("first"))
    links = named.select("id", "intent").distinct().join(first, "id").select("first", "intent").distinct()
    rows = links.limit(MOST_LINKS + 1).collect()
    if len(rows) > MOST_LINKS:
        return None
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in rows:
        a, b = sorted((top(r["first"]), top(r["intent"])))
        root[b] = a
    groups = moves.sparkSession.createDataFrame([(x, top(x)) for x in root], "first string, group string")
    return first.join(F.broadcast(groups), "first").select("id", "group")  # at most two rows a link


def _by_pairs(moves: DataFrame) -> DataFrame:
    """(id, group): rules that are linked by pairs that both name, each group by its smallest rule.

    Each round hands on the smallest label of a pair's rules, and then that label's own label, so a chain is
    done after about as many rounds as its length has binary digits.
    """
    named = stage(moves.where(NAMED).select("id", *PAIR).distinct(), "rule-pairs")
    labels, last = stage(named.select("id", F.col("id").alias("group")).distinct(), "labels"), None
    while True:
        met = named.join(labels, "id")
        of_pair = met.groupBy(*PAIR).agg(F.min("group").alias("near"))
        near = named.join(of_pair, PAIR).groupBy("id").agg(F.min("near").alias("near"))
        least = labels.join(near, "id").select("id", F.least("group", "near").alias("group"))
        beyond = least.select(F.col("id").alias("group"), F.col("group").alias("beyond"))
        labels = stage(least.join(beyond, "group", "left").select("id", F.least("group", F.coalesce("beyond", "group")).alias("group")), "labels")
        now = labels.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0]  # labels only fall
        if now == last:
            return labels.withColumn("group", F.col("group").cast("string"))
        last = now


def _split(moves: DataFrame, groups: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Moves of the groups with up to ``most`` moves, those of the larger ones, and how many the largest has.

    Rules without a named pair never collide and are in neither.
    """
    grouped = stage(moves.join(groups, "id"), "grouped-moves")
    sizes = grouped.groupBy("group").count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return grouped, None, largest
    large = sizes.where(F.col("count") > most).select("group")
    return grouped.join(large, "group", "left_anti"), grouped.join(large, "group", "left_semi"), largest


def _walk(group: pa.Table) -> tuple[list, list, dict]:
    """Rules and numbers of the refused changes of a group, and what each rule that moved holds in the end."""
    order = group.sort_by([("change_id", "ascending"), ("id", "ascending")])
    held: dict[int, tuple | None] = {}
    holders: Counter = Counter()
    moved: dict[int, tuple | None] = {}
    ids, numbers = [], []
    for rule, change, op, intent, model in zip(*(order.column(c).to_pylist() for c in ("id", "change_id", "op", *PAIR))):
        pair = (intent, model) if op != "delete" and intent is not None and model is not None else None
        old = held.get(rule)
        if op == "upsert" and pair is not None and holders[pair] > (pair == old):
            ids.append(rule)
            numbers.append(change)
            continue
        holders[old] -= 1
        holders[pair] += 1
        held[rule] = pair
        if op != "base":
            moved[rule] = pair
    return ids, numbers, moved


def _walked(moves: DataFrame) -> DataFrame:
    """(id, change_id) of the changes that a walk through each group refuses."""
    id_type = moves.schema["id"].dataType.simpleString()

    def walk(group: pa.Table) -> pa.Table:
        ids, numbers, _ = _walk(group)
        return pa.table({"id": pa.array(ids, group.schema.field("id").type), "change_id": pa.array(numbers, pa.int64())})

    return moves.groupBy("group").applyInArrow(walk, f"id {id_type}, change_id bigint")


def _in_rounds(moves: DataFrame, most: int) -> DataFrame:
    """(id, change_id) of the changes that are refused, of groups of any size.

    A round takes the next ``most`` changes of each group and the pairs that their rules hold. All other rules stand still
    in that round, so of these a row for each pair that the changes name is enough: a task gets a few times ``most``
    rows. Rounds are as many as the largest group has times ``most`` changes; groups are walked beside each other.
    """
    spark, key = moves.sparkSession, moves.schema["id"].dataType.simpleString()
    given = moves.where("op <> 'base'")
    cut = F.floor(F.col("change_id") / CHANGE_SLICE)
    ranked = rank_in_key(given, ["group"], cut, ["change_id", "id"], "nth").withColumn("round", F.floor((F.col("nth") - 1) / most).cast("int"))
    path = work_dir(spark, "rounds")
    placed = ranked.drop("nth")
    placed.write.partitionBy("round").parquet(path)
    rounds = spark.read.schema(placed.schema).parquet(path)
    last = rounds.agg(F.max("round")).first()[0]
    state = moves.where(f"op = 'base' AND {NAMED}").select("group", "id", *PAIR)
    schema = f"group string, id {key}, change_id bigint, intent string, model string"

    def walk(group: pa.Table) -> pa.Table:
        ids, numbers, moved = _walk(group)
        pairs = [p or (None, None) for p in moved.values()]
        none = [None] * len(ids)
        return pa.table({
            "group": pa.array([group.column("group")[0].as_py()] * (len(ids) + len(moved)), pa.string()),
            "id": pa.array([*ids, *moved], group.schema.field("id").type),
            "change_id": pa.array(numbers + [None] * len(moved), pa.int64()),
            "intent": pa.array(none + [p[0] for p in pairs], pa.string()), "model": pa.array(none + [p[1] for p in pairs], pa.string()),
        })

    parts = []
    for i in range(0 if last is None else last + 1):
        now = rounds.where(F.col("round") == i).drop("round")
        rules, pairs = now.select("group", "id").distinct(), now.where(NAMED).select("group", *PAIR).distinct()
        mine = state.join(rules, ["group", "id"], "left_semi")
        others = state.join(rules, ["group", "id"], "left_anti").join(pairs, ["group", *PAIR], "left_semi")
        others = others.groupBy("group", *PAIR).agg(F.min("id").alias("id"))
        before = mine.unionByName(others).withColumns({"change_id": F.lit(BASE), "op": F.lit("base")})
        done = stage(now.unionByName(before).groupBy("group").applyInArrow(walk, schema), "round")
        parts.append(done.where("change_id IS NOT NULL").select("id", "change_id"))
        if i < last:
            moved = done.where("change_id IS NULL").drop("change_id")
            still = state.join(moved, ["group", "id"], "left_anti")
            state = stage(still.unionByName(moved.where("model IS NOT NULL")), "held")
    return reduce(DataFrame.unionByName, parts) if parts else given.select("id", "change_id").limit(0)


def sample_search(samples: DataFrame, query: str) -> DataFrame:
    """Samples whose intent or text contains the query, whatever its case."""
    q = query.lower()
    return samples.where(F.lower("intent").contains(q) | F.lower("sample_text").contains(q))


def samples_recent(samples: DataFrame) -> DataFrame:
    return samples.orderBy(F.desc("updated_at"), "id")
