"""The whole way of a request over a table of requests.

guardrail, cache bypass, intent, route, compress, outcome and cost of each request; then verdict and cache, together -> log
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.text import is_bypass, prompt_key, strip_bypass, token_estimate
from tokenmill.operators.cache import build_log_rows, cache_replay
from tokenmill.operators.compression import compress
from tokenmill.operators.guardrail import guardrail_keywords
from tokenmill.operators.intent import IntentModel, intent_labels, untrained_intent
from tokenmill.operators.meter import BUDGET_SLICE_SECONDS, bearer_token, request_verdict
from tokenmill.operators.ordered import find_hot_keys, running_total, time_slice
from tokenmill.operators.pricing import with_cost
from tokenmill.operators.routing import failover, route
from tokenmill.session import stage


def prepare_prompts(
    prompts: DataFrame, keywords: DataFrame, model: IntentModel | None, method: str = "stacked", row_id: str = "doc_id"
) -> DataFrame:
    """All that depends on a prompt's text alone, once per prompt and not per request."""
    blocked = guardrail_keywords(prompts.select(row_id, "text"), keywords, "text", row_id)
    wishes = blocked.select(
        row_id, "blocked", is_bypass(F.col("text")).alias("bypass"), strip_bypass(F.col("text")).alias("text")
    )
    figures = [prompt_key(F.col("text")).alias("cache_key"), "original_tokens", "compressed_tokens"]
    if model is None:
        labelled = wishes.withColumn("intent", untrained_intent(F.col("text")))
        return compress(labelled, method, text="text", row_id=row_id).select(row_id, "blocked", "bypass", "intent", *figures)
    # no text goes into the join
    small = compress(wishes, method, text="text", row_id=row_id).select(row_id, "blocked", "bypass", *figures)
    return small.join(intent_labels(wishes, model, row_id=row_id), row_id).select(
        row_id, "blocked", "bypass", "intent", "cache_key", "original_tokens", "compressed_tokens")


def replay(
    requests: DataFrame, prompts: DataFrame, keys: DataFrame, rules: DataFrame, prices: DataFrame,
    outcomes: DataFrame, keywords: DataFrame, model: IntentModel | None = None, method: str = "stacked",
    limit: int = fixed.RATE_LIMIT, width: int = fixed.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Log rows of all requests that are let in and answered, cached or not.

    What an answer would be and cost follows from the request alone and is worked out once. Who is let in and who
    finds a cached answer hang on each other: a charge may end a budget, a request that is let in may save an answer that
    others of any key then find free of charge. Both are judged for all requests at once, by the verdicts of the
    round before, until none moves; each round settles at least the earliest open request, so the end is
    the one result of a walk in order of time. Rounds are as many as verdicts that hang on each other.

    Only answered requests save: misses, and requests that asked for a fresh answer, which first take the old one away. No
    answer is saved for a request without a rule, or one that failed with its fallback. Hits cost nothing.
    Written in between: the facts of the prompts, the answers, and each round's verdicts. None carries a text.
    """
    facts = stage(prepare_prompts(prompts, keywords, model, method), "facts")
    # a request without a prompt row is one with an empty prompt
    none = {"blocked": F.lit(False), "bypass": F.lit(False), "intent": F.lit("general"), "cache_key": prompt_key(F.lit("")),
            "original_tokens": token_estimate(F.lit("")), "compressed_tokens": token_estimate(F.lit(""))}
    asked = requests.join(facts, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    token = F.sha2(bearer_token(F.col("auth_header")), 256)
    access = keys.select(F.col("key_hash").alias("_hash"), "user_id", "allowed_rules")
    known = asked.where("NOT blocked").withColumn("_hash", token).join(access, "_hash").drop("_hash")
    answers = stage(_answers(known, rules, prices, outcomes), "answers")
    costs = answers.select("request_id", "cost_usd", F.lit(True).alias("answered"))
    rows = asked.join(costs, "request_id", "left").select(
        "request_id", "ts", "auth_header", "blocked", "bypass", "intent", "cache_key", "cost_usd", F.coalesce("answered", F.lit(False)).alias("answered"))
    # tokens, rate limits and keys refuse whatever is charged; budgets only hang on what the rest is charged
    early = request_verdict(rows.withColumn("_charge", F.lit(0)), keys, cost="_charge", limit=limit, width=width)
    budgets = keys.select(F.col("id").alias("key_id"), "total_budget", "budget_type")
    rows = early.where("status = 200").drop("auth_header", "_charge", "status", "verdict").join(budgets, "key_id")
    month = F.when(F.col("budget_type") == "monthly", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM")).otherwise("")
    rows = rows.withColumn("month", month).withColumns({"let_in": F.lit(True), "hit": F.lit(False)})
    rows = stage(rows.drop("budget_type"), "requests")
    hot = find_hot_keys(rows, ["key_id"])
    while True:
        free = F.col("hit") | F.col("blocked") | ~F.col("answered") | ~F.col("let_in")
        charge = F.when(free, F.lit(0)).otherwise(F.col("cost_usd")).cast("decimal(38,12)")
        spent = running_total(rows, ["key_id", "month"], time_slice(F.col("ts"), BUDGET_SLICE_SECONDS), ["ts", "request_id"], charge, "_spent", hot=hot)
        judged = spent.withColumnsRenamed({"let_in": "_let_in", "hit": "_hit"}).withColumn("let_in", F.col("total_budget") - F.col("_spent") > 0)
        judged = stage(judged.drop("_spent"), "verdicts")
        hits = cache_replay(judged.where("let_in AND NOT blocked")).where("hit").select("request_id", F.lit(True).alias("hit"))
        rows = stage(judged.join(hits, "request_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "round")
        if rows.where("let_in <> _let_in OR hit <> _hit").isEmpty():
            break
        rows = rows.drop("_let_in", "_hit")
    let_in = rows.where("let_in AND NOT blocked").select("request_id", "hit")
    fresh = answers.join(let_in.where("NOT hit"), "request_id")
    # a hit never reached a provider, so it may have no outcome; its latency is then unknown
    hits = known.join(let_in.where("hit"), "request_id").join(outcomes.select("request_id", "latency_ms"), "request_id", "left").select(
        "*", F.lit(None).cast("string").alias("final_model"), F.lit(0).alias("prompt_tokens"),
        F.lit(0).alias("completion_tokens"), F.lit(0).cast("decimal(18,12)").alias("cost_usd"),
    )
    return build_log_rows(fresh).unionByName(build_log_rows(hits))


def _answers(known: DataFrame, rules: DataFrame, prices: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The requests that a provider would answer, with its token counts and their cost."""
    routed = route(known, rules).where("rule IS NOT NULL")
    answered = failover(routed, outcomes).where("status <> 'failed'")
    tokens = lambda n, est: F.when(F.col(n) > 0, F.col(n)).otherwise(est).cast("int")
    counted = answered.withColumn("prompt_tokens", tokens("prompt_tokens", F.col("compressed_tokens"))).withColumn(
        "completion_tokens", tokens("completion_tokens", token_estimate(F.col("answer")))
    )
    priced = with_cost(counted, prices, model="final_model", provider="final_provider", url="final_url")
    return priced.select("request_id", "api_key_id", "user_id", "ts", "intent", "final_model", "prompt_tokens", "completion_tokens",
                         "latency_ms", "cost_usd")
