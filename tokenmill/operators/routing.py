"""Which rule answers a request: candidates by intent or model, access lists, weights, failover.

Rules are grouped once into short candidate lists, in rule order. Requests pick a list up by an
equality join, and filter and weigh it inside their own row, so routing never shuffles by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import owner
from tokenmill.operators.ordered import rank_in_key
from tokenmill.operators.sizes import at_most, broadcast_if_small

RULE_FIELDS = [
    "id", "intent", "provider", "model", "url", "weight", "fallback_provider", "fallback_model", "fallback_url",
]
ID_SLICE = 1024
MAX_BROADCAST_RULES = 10_000
EVERY_RULE = "every rule"


def _candidates(rules: DataFrame, by: str, out: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*RULE_FIELDS)))
    grouped = rules.groupBy(F.col(by).alias(f"_{out}_key")).agg(listed.alias(out))
    return F.broadcast(grouped) if at_most(rules, MAX_BROADCAST_RULES) else grouped


def _allowed(candidates: Column, allowed_rules: Column) -> Column:
    """Rules that the key may use: no list allows all, an empty list allows none."""
    return F.when(allowed_rules.isNull(), candidates).otherwise(
        F.filter(candidates, lambda r: r.id.isNull() | F.array_contains(allowed_rules, r.id))
    )


def _non_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def rules_for_intent(requests: DataFrame, rules: DataFrame, intent: str = "intent") -> DataFrame:
    """Adds ``candidates``: the intent's rules that the key may use, else the general ones.

    Without rules for intent and general, the fixed default rule. An empty list means refused (403).
    """
    own = _candidates(rules, "intent", "own")
    general = _candidates(rules.where(F.col("intent") == "general"), "intent", "general")
    default = F.array(F.struct(*[
        F.lit(fixed.DEFAULT_RULE.get(f)).cast(rules.schema[f].dataType).alias(f) for f in RULE_FIELDS
    ]))
    access = F.col("allowed_rules")
    nothing = F.slice(default, 1, 0)
    # only requests without a usable rule of their own look the general ones up
    own_allowed = _non_empty(_allowed(F.col("own"), access))
    rows = requests.join(own, F.col(intent) == F.col("_own_key"), "left").withColumn("_usable", own_allowed)
    rows = rows.withColumn("_spare", F.when(F.col("_usable").isNull(), "general")).join(
        general, F.col("_spare") == F.col("_general_key"), "left"
    )
    no_rules = F.col("own").isNull() & F.col("general").isNull()
    return rows.withColumn(
        "candidates",
        F.when(no_rules, default).otherwise(F.coalesce("_usable", _allowed(F.col("general"), access), nothing)),
    ).drop("_usable", "_spare", "_own_key", "_general_key", "own", "general")


def requested_model_rules(requests: DataFrame, rules: DataFrame, model: str = "requested_model") -> DataFrame:
    """Adds ``model_candidates``: allowed rules of any intent with that primary or fallback model.

    A rule is listed under each of its two models once; that turns the either-or into one equality.
    """
    names = F.array_distinct(F.filter(F.array("model", "fallback_model"), lambda m: m.isNotNull()))
    by_model = _candidates(rules.withColumn("_served", F.explode(names)), "_served", "served")
    return (
        requests.join(by_model, F.col(model) == F.col("_served_key"), "left")
        .withColumn("model_candidates", _non_empty(_allowed(F.col("served"), F.col("allowed_rules"))))
        .drop("_served_key", "served")
    )


def pick_weighted(candidates: Column, request_id: Column) -> Column:
    """The candidate whose running weight first reaches a number drawn from the request's id.

    The draw is a hash, so a rerun routes the same way. Weight 0 is never drawn; without any weight
    the first candidate is taken.
    """
    weight = lambda r: F.coalesce(r.weight, F.lit(fixed.DEFAULT_WEIGHT)).cast("bigint")
    total = F.aggregate(candidates, F.lit(0).cast("bigint"), lambda acc, r: acc + weight(r))
    draw = F.pmod(F.pmod(request_id, F.lit(2**31)) * F.lit(2654435761), total) + 1
    first = F.get(candidates, F.lit(0))
    walk = F.aggregate(
        candidates,
        F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(-1).alias("at"), F.lit(0).alias("i")),
        lambda acc, r: F.struct(
            (acc.upto + weight(r)).alias("upto"),
            F.when((acc.at < 0) & (acc.upto + weight(r) >= draw), acc.i).otherwise(acc.at).alias("at"),
            (acc.i + 1).alias("i"),
        ),
        lambda acc: acc.at,
    )
    return F.when(total > 0, F.get(candidates, walk)).otherwise(first)


def route(requests: DataFrame, rules: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Adds ``rule`` (null where the key may use none), for requests with intent, model and access list.

    Code requests follow their intent; others first try the model that they ask for.
    """
    rows = requested_model_rules(rules_for_intent(requests, rules), rules)
    by_model = F.when(F.col("intent") != "code", F.col("model_candidates"))
    final = F.coalesce(by_model, F.col("candidates"))
    return (
        rows.withColumn("_final", final)
        .withColumn("rule", pick_weighted(F.col("_final"), F.col(request_id)))
        .withColumn("routed_by", F.when(F.col("rule").isNull(), "refused").when(by_model.isNotNull(), "model")
                    .otherwise("intent"))
        .drop("_final", "candidates", "model_candidates")
    )


def rules_by_intent(rules: DataFrame) -> DataFrame:
    """Rules with their 1-based place in their intent's list."""
    return rank_in_key(rules, ["intent"], F.floor(F.col("id") / ID_SLICE), ["id"], "place")


def route_weights(rules: DataFrame) -> DataFrame:
    """Each rule's share of its intent's weight; null where the intent has no weight."""
    totals = rules.groupBy("intent").agg(F.sum("weight").alias("total_weight"))
    share = F.when(F.col("total_weight") > 0, F.col("weight") / F.col("total_weight"))
    return rules.join(totals, "intent").withColumn("share", share)


def models_per_key(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, model, owned_by) for every model a key can reach, or the three defaults if there is none.

    Keys with equal access lists reach equal models, so each distinct list is resolved once, by
    equality on the rule's id, and the keys then look their list up.
    """
    every = F.lit("every rule")
    listed = keys.select(
        "id", F.when(F.col("allowed_rules").isNull(), every).otherwise(F.to_json("allowed_rules")).alias("_list"),
        "allowed_rules",
    )
    served = rules.select(
        F.col("id").alias("_rule"), F.explode(F.array("model", "fallback_model")).alias("model")
    ).where("model IS NOT NULL AND model <> ''")
    # rules without a number are open to every list, as if each list named them
    unnumbered = F.lit(-1).cast("bigint")
    lists = listed.where("allowed_rules IS NOT NULL").select("_list", "allowed_rules").distinct()
    by_list = (
        lists.select("_list", F.explode(F.concat("allowed_rules", F.array(unnumbered))).alias("_rule"))
        .join(served.withColumn("_rule", F.coalesce("_rule", unnumbered)), "_rule").select("_list", "model")
    )
    found = by_list.unionByName(served.select(every.alias("_list"), "model")).distinct()
    defaults = F.explode(F.array(*map(F.lit, fixed.DEFAULT_MODELS)))
    missing = listed.select("_list").distinct().join(found, "_list", "left_anti").select("_list", defaults.alias("model"))
    reached = broadcast_if_small(found.unionByName(missing), MAX_BROADCAST_RULES)
    return listed.select("id", "_list").join(reached, "_list").select("id", "model").withColumn(
        "owned_by", owner(F.col("model"))
    )


def key_lists(keys: DataFrame) -> DataFrame:
    """(key_id, access): each key's access list as text; keys without a list are named ``every rule``."""
    numbers = F.array_join(F.transform(F.array_sort(F.array_distinct("allowed_rules")), lambda r: r.cast("string")), ",")
    return keys.select(F.col("id").alias("key_id"), F.coalesce(numbers, F.lit(EVERY_RULE)).alias("access"), "allowed_rules")


def rule_access(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(access, rule_id, ...) for every distinct access list of ``key_lists``; ``access`` leads to the keys.

    A rule without an id is open to every list. Keys with one list share its rows, so no row is made
    per key and rule.
    """
    lists = key_lists(keys).select("access", "allowed_rules").dropDuplicates(["access"])
    open_rules, every = (F.lit(-(2**63) + i).cast("bigint") for i in range(2))
    numbers = F.when(F.col("allowed_rules").isNull(), F.array(every)).otherwise(
        F.concat(F.array_distinct("allowed_rules"), F.array(open_rules))
    )
    # a rule is found by its number and, by lists without limits, among all rules
    found_by = F.explode(F.array(F.coalesce("id", open_rules), every)).alias("_rule")
    named = rules.select("*", found_by).withColumnRenamed("id", "rule_id")
    return lists.select("access", F.explode(numbers).alias("_rule")).join(named, "_rule").drop("_rule")


def failover(routed: DataFrame, outcomes: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Routed requests with their outcome and the model that answered in the end.

    A failed first try moves to the rule's fallback, if it has one. ``status`` is ok, failed_over or
    failed; provider and url follow the side that answered, as prices depend on them.
    """
    has_fallback = F.col("rule.fallback_provider").isNotNull() & F.col("rule.fallback_model").isNotNull()
    status = F.when(~F.col("failed"), "ok").when(has_fallback, "failed_over").otherwise("failed")
    side = lambda f: F.when(F.col("status") == "failed_over", F.col(f"rule.fallback_{f}")).otherwise(
        F.col(f"rule.{f}")
    )
    return (
        routed.join(outcomes, request_id).withColumn("status", status)
        .withColumn("final_model", side("model")).withColumn("final_provider", side("provider"))
        .withColumn("final_url", side("url"))
    )


def failover_alerts(answered: DataFrame) -> DataFrame:
    """Alert rows of requests that moved to the fallback."""
    return answered.where("status = 'failed_over'").select(
        "request_id", F.lit("failover").alias("type"), "intent", F.col("rule.model").alias("primary_model"),
        F.col("rule.fallback_model").alias("fallback_model"), "error",
    )
