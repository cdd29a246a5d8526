"""The registered queries: every operator over the given tables, whole."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenmill.functions import fixed, scalars, text
from tokenmill.operators import (
    cache, changes, compression, conversations, guardrail, intent, meter, metrics, ordered, pricing, quality, routing,
    similarity,
)
from tokenmill.plans import gateway
from tokenmill.plans.inputs import view
from tokenmill.session import stage, work_dir
from tokenmill.sources import sinks, tables
from tokenmill.sources.sinks import read_snapshot
from tokenmill.streaming import logs as stream_logs
from tokenmill.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LOOKUP_THRESHOLD = 0.34


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def real(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def listed(c: str) -> Column:
    return F.concat_ws(",", F.col(c).cast("array<string>"))


def token_logs(spark: SparkSession, d: str) -> DataFrame:
    logs = view(spark, d, "token_logs").withColumn("total_tokens", F.expr("prompt_tokens + completion_tokens"))
    return pricing.with_cost(logs, view(spark, d, "model_prices"))


def api_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.parse_api_keys(view(spark, d, "api_keys"))


def charges(spark: SparkSession, d: str) -> DataFrame:
    return token_logs(spark, d).select(
        F.col("id").alias("request_id"), "api_key_id", F.col("created_at").alias("ts"), "cost_usd"
    )


def scoped_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their logged intent and their key's access list."""
    access = api_keys(spark, d).select(F.col("id").alias("key_number"), "allowed_rules")
    return view(spark, d, "requests").join(access, "key_number").withColumn("intent", F.col("logged_intent"))


def score_by_distance(_q: Column, _e: Column, dist: Column) -> Column:
    return 5.0 - 5.5 * dist


# ---------------------------------------------------------------------------------------- sources
@query
def token_logs_scan(spark, d):
    logs = token_logs(spark, d)
    return logs.select("id", "api_key_id", "intent", "model", "total_tokens", "latency_ms", real("cost_usd").alias("cost_usd"))


@query
def api_keys_parse(spark, d):
    return api_keys(spark, d).select(
        "id", "active", real("total_budget").alias("total_budget"), F.col("allowed_rules").isNull().alias("all_rules"),
        F.coalesce(listed("allowed_rules"), F.lit("")).alias("rules"),
    )


@query
def rules_by_intent(spark, d):
    rules = tables.with_rule_defaults(view(spark, d, "rule_table"))
    return routing.rules_by_intent(rules).select("intent", "place", "id", "model", "weight")


@query
def labelled_text(spark, d):
    return tables.parse_labelled(tables.label_lines(view(spark, d, "samples").select("id", "intent", "sample_text")))


@query
def queue_entries(spark, d):
    """Queue entries as JSON text, some of them broken, back to rows."""
    logs = view(spark, d, "token_logs")
    line = F.to_json(F.struct(
        "api_key_id", "user_id", "intent", "model", "prompt_tokens",
        F.when(F.col("id") % 7 != 3, F.col("completion_tokens")).alias("completion_tokens"), "latency_ms",
        F.when(F.col("id") % 4 != 0, F.lit(0.25)).alias("cost_usd"),
    ))
    broken = F.when(F.col("id") % 11 == 5, F.concat(F.lit("{"), line)).otherwise(line)
    rows = tables.parse_log_entries(logs.select("id", broken.alias("value")))
    return rows.select(
        "id", "ok", F.when(F.col("ok"), F.col("total_tokens")).alias("total_tokens"),
        F.when(F.col("ok"), real("cost_usd")).alias("cost_usd"),
    )


@query
def chat_content(spark, d):
    """Message contents of chat payloads, as strings (some of which look like JSON) and as lists of parts."""
    turns = view(spark, d, "conversations")
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))
    looks = F.when(F.col("conv_id") % 3 == 0, F.lit('{"a": 1} ')).when(F.col("conv_id") % 3 == 1, "[1] ").otherwise("")
    quoted = F.to_json(F.array(F.concat(looks, "text")))
    body = (
        F.when(F.col("turn") % 4 == 1, F.to_json(F.array(part, image, part)))
        .when(F.col("turn") % 4 == 2, F.to_json(F.array("text", F.lit("and"))))
        .when(F.col("turn") % 4 == 3, F.to_json(part))
        .otherwise(F.substring(quoted, 2, F.length(quoted) - 2))
    )
    payload = F.concat(F.lit('{"model": "m", "messages": [{"role": "user", "content": '), body, F.lit("}]}"))
    asked = tables.parse_chat_requests(turns.select("conv_id", "turn", payload.alias("value")))
    return asked.select("conv_id", "turn", tables.flatten_content(F.col("messages")[0]["content"]).alias("content"))


# ----------------------------------------------------------------------------- projections, filters
@query
def last_user_message(spark, d):
    return conversations.last_user_message(view(spark, d, "conversations"))


@query
def request_verdict(spark, d):
    costs = charges(spark, d).select("request_id", "cost_usd")
    requests = view(spark, d, "requests").join(costs, "request_id")
    out = meter.request_verdict(requests, api_keys(spark, d), limit=2, width=86_400)
    return out.select("request_id", "key_id", "status", "verdict")


@query
def guardrail_keywords(spark, d):
    words = view(spark, d, "nation").select(F.regexp_replace(F.lower("n_name"), "nation_", "th").alias("keyword"))
    return guardrail.guardrail_keywords(view(spark, d, "prompts"), words).select("doc_id", "blocked", "phrase")


@query
def guardrail_keywords_many(spark, d):
    """A long phrase list: the first three and the first eight words of every benchmark text, the whole text, and every part's name."""
    some = view(spark, d, "benchmark")
    words = some.select(F.explode(F.array(
        F.substring_index("text", " ", 3), F.substring_index("text", " ", 8), F.col("text"))).alias("keyword"))
    words = words.union(view(spark, d, "part").select("p_name"))
    return guardrail.guardrail_keywords(view(spark, d, "prompts"), words).select("doc_id", "blocked", "phrase")


@query
def cache_bypass(spark, d):
    t = F.col("text")
    return view(spark, d, "prompts").select("doc_id", text.is_bypass(t).alias("bypass"), text.strip_bypass(t).alias("text"))


@query
def code_override(spark, d):
    return view(spark, d, "prompts").select("doc_id", text.code_override(F.col("text")).alias("is_code"))


@query
def digit_signature(spark, d):
    rows = view(spark, d, "prompts").withColumn("_s", text.digit_signature(F.col("text")))
    return rows.select("doc_id", listed("_s").alias("digits"))


@query
def toggle_signature(spark, d):
    rows = view(spark, d, "prompts").withColumn("_s", text.toggle_signature(F.col("text")))
    return rows.select("doc_id", listed("_s").alias("toggles"))


@query
def rule_access(spark, d):
    """Rules of every distinct access list, one rule without an id among them, and how many keys share the list."""
    rules = view(spark, d, "routing_rules").select("id", "model")
    unnumbered = rules.where("id = 1").select(F.lit(None).cast("bigint").alias("id"), F.lit("shared").alias("model"))
    keys = api_keys(spark, d)
    shared = routing.key_lists(keys).groupBy("access").agg(F.count("*").alias("keys"))
    return routing.rule_access(keys, rules.unionByName(unnumbered)).join(shared, "access").select(
        "access", "rule_id", "model", "keys")


@query
def compression_gate(spark, d):
    return view(spark, d, "prompts").select(
        "doc_id", compression.compression_gate(F.col("text"), "llmlingua").alias("reason")
    )


@query
def sample_search(spark, d):
    return changes.sample_search(view(spark, d, "samples"), "ERED").select("id", "intent")


@query
def constraint_violations(spark, d):
    parts = {
        "rules": ("rule_table", quality.rule_checks()), "keys": ("api_keys", quality.key_checks()),
        "samples": ("samples", quality.sample_checks()), "alerts": ("alert_requests", quality.alert_checks()),
        "compressor": ("compressor_settings", quality.compressor_checks()), "rephrase": ("rephrase_settings", quality.rephrase_checks()),
    }
    found = [quality.validate_rows(view(spark, d, n), "id", c).withColumn("source", F.lit(s)) for s, (n, c) in parts.items()]
    return reduce(DataFrame.unionByName, found)


@query
def build_log_rows(spark, d):
    requests = view(spark, d, "requests").select(
        "request_id", "api_key_id", "ts", F.col("logged_intent").alias("intent"), F.lit(None).cast("string").alias("user_id"),
        F.col("requested_model").alias("final_model"), (F.col("logged_intent") == "cached").alias("hit"),
    )
    done = requests.join(view(spark, d, "outcomes"), "request_id")
    rows = cache.build_log_rows(pricing.with_cost(done, view(spark, d, "model_prices"), model="final_model"))
    return rows.select("request_id", "intent", "model", "prompt_tokens", "completion_tokens", "total_tokens",
                       "latency_ms", real("cost_usd").alias("cost_usd"))


@query
def cache_fill_rows(spark, d):
    requests = view(spark, d, "requests").withColumn("hit", F.col("logged_intent") == "cached").withColumn(
        "intent", F.col("logged_intent"))
    answers = view(spark, d, "outcomes").select("request_id", F.when(~F.col("failed"), F.col("answer")).alias("answer"))
    docs = view(spark, d, "documents").select("doc_id", "text")
    rows = cache.cache_fill_rows(requests.join(answers, "request_id").join(docs, "doc_id"))
    return rows.select("request_id", "cache_key", "response", "saved_at", "expires_at")


# ------------------------------------------------------------------------------------------ joins
@query
def logs_by_key(spark, d):
    out = metrics.logs_by_key(token_logs(spark, d), api_keys(spark, d))
    return out.select("api_key_id", "name", "status", "requests", "tokens", real("cost_usd").alias("cost_usd"))


@query
def price_lookup(spark, d):
    out = pricing.price_lookup(view(spark, d, "token_logs"), view(spark, d, "model_prices"))
    return out.select("id", "model", real("rate_in").alias("rate_in"), real("rate_out").alias("rate_out"), "price_source")


@query
def key_auth(spark, d):
    return meter.key_auth(view(spark, d, "requests"), api_keys(spark, d)).select("request_id", "key_id", "key_name", "active")


@query
def rules_for_intent(spark, d):
    out = routing.rules_for_intent(scoped_requests(spark, d), view(spark, d, "routing_rules"))
    ids = F.concat_ws(",", F.transform("candidates", lambda r: r.id.cast("string")))
    return out.select("request_id", ids.alias("candidates"))


@query
def requested_model(spark, d):
    out = routing.requested_model_rules(scoped_requests(spark, d), view(spark, d, "routing_rules"))
    weight = F.aggregate("model_candidates", F.lit(0), lambda acc, r: acc + r.weight)
    ids = F.concat_ws(",", F.transform("model_candidates", lambda r: r.id.cast("string")))
    return out.select("request_id", ids.alias("candidates"), weight.cast("bigint").alias("weight"))


@query
def semantic_lookup(spark, d):
    out = similarity.semantic_lookup(
        view(spark, d, "lookups"), view(spark, d, "cache_entries"), LOOKUP_THRESHOLD, score_by_distance)
    return out.select("query_id", "entry_id", F.round("dist", 6).alias("dist"))


@query
def semantic_lookup_k1(spark, d):
    out = similarity.semantic_lookup_simple(view(spark, d, "lookups"), view(spark, d, "cache_entries"), 0.6)
    return out.select("query_id", "entry_id", F.round("dist", 6).alias("dist"))


@query
def guardrail_similarity(spark, d):
    prompts = view(spark, d, "embeddings").withColumnRenamed("vec_id", "query_id")
    out = similarity.guardrail_similarity(prompts, view(spark, d, "guardrail_patterns"), 0.35)
    return out.select("query_id", "pattern_id", F.round("dist", 6).alias("dist"))


@query
def semantic_invalidate(spark, d):
    out = similarity.semantic_invalidate(
        view(spark, d, "lookups"), view(spark, d, "cache_entries"), LOOKUP_THRESHOLD, score_by_distance)
    return out.select("entry_id", F.length("prompt").cast("bigint").alias("chars"))


@query
def cache_miss_requests(spark, d):
    requests = view(spark, d, "requests")
    hits = view(spark, d, "token_logs").where("model = 'semantic-cache'").select(F.col("id").alias("request_id"))
    return similarity.cache_split(requests, hits)[1].select("request_id", "requested_model")


@query
def price_alias_expand(spark, d):
    return pricing.alias_expand(view(spark, d, "price_feed")).select(
        "seq", "step", "model_name", "provider", real("input_price").alias("input_price"))


@query
def dangling_rule_refs(spark, d):
    return quality.dangling_rule_refs(api_keys(spark, d), view(spark, d, "routing_rules"))


@query
def cache_ttl_replay(spark, d):
    requests = view(spark, d, "requests").select(
        "request_id", "ts", F.col("doc_id").cast("string").alias("_doc"), "doc_id").withColumn(
        "cache_key", F.sha2("_doc", 256)).withColumn(
        "intent", F.element_at(F.array(*map(F.lit, fixed.INTENTS)), (F.col("doc_id") % 4 + 1).cast("int")))
    return cache.cache_ttl_replay(requests).select("request_id", "hit")


@query
def failover_pairs(spark, d):
    routed = routing.route(scoped_requests(spark, d), view(spark, d, "routing_rules")).where("rule IS NOT NULL")
    out = routing.failover(routed, view(spark, d, "outcomes"))
    return out.select("request_id", "status", "final_model", "final_provider")


@query
def failover_alerts(spark, d):
    routed = routing.route(scoped_requests(spark, d), view(spark, d, "routing_rules")).where("rule IS NOT NULL")
    alerts = routing.failover_alerts(routing.failover(routed, view(spark, d, "outcomes")))
    message = scalars.failover_text(*map(F.col, ("intent", "primary_model", "fallback_model", "error")))
    return alerts.select("request_id", "type", scalars.double_bold(message).alias("message"))


# ----------------------------------------------------------------------------------- aggregations
@query
def summary_metrics(spark, d):
    out = metrics.summary_metrics(token_logs(spark, d))
    return out.withColumn("total_cost_usd", real("total_cost_usd"))


@query
def by_intent(spark, d):
    return metrics.by_intent(token_logs(spark, d))


@query
def by_model(spark, d):
    return metrics.by_model(token_logs(spark, d))


@query
def key_spend(spark, d):
    out = meter.key_spend(token_logs(spark, d), api_keys(spark, d))
    return out.select("api_key_id", real("spent").alias("spent"), real("durable_balance").alias("durable_balance"),
                      real("live_balance").alias("live_balance"))


@query
def intent_pivot(spark, d):
    return metrics.intent_vector(token_logs(spark, d))


@query
def route_weights(spark, d):
    rules = tables.with_rule_defaults(view(spark, d, "rule_table"))
    return routing.route_weights(rules).select("id", "total_weight", F.round("share", 9).alias("share"))


@query
def cache_hit_rate(spark, d):
    return metrics.cache_hit_rate(token_logs(spark, d)).withColumn("hit_rate", F.round("hit_rate", 9))


@query
def models_per_key(spark, d):
    return routing.models_per_key(api_keys(spark, d), view(spark, d, "routing_rules"))


def provider_lines(turns: DataFrame) -> DataFrame:
    """Provider event lines of every assistant turn, one text delta per blank-separated piece."""
    msg = turns.where("role = 'assistant'").withColumn("msg_id", F.expr("conv_id * 1000 + turn"))
    given = F.when(F.col("turn") % 2 == 1, F.length("text")).otherwise(0)
    start = F.struct(F.lit("message_start").alias("type"),
                     F.struct(F.struct(given.alias("input_tokens")).alias("usage")).alias("message"))
    piece = lambda p: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(p.alias("text")).alias("delta")))
    reason = F.element_at(F.array(F.lit("end_turn"), F.lit("max_tokens"), F.lit("tool_use")), (F.col("conv_id") % 3 + 1).cast("int"))
    end = F.struct(
        F.lit("message_delta").alias("type"), F.struct(reason.alias("stop_reason")).alias("delta"),
        F.struct(F.when(F.col("conv_id") % 2 == 0, F.length("text")).otherwise(0).alias("output_tokens")).alias("usage"),
    )
    pieces = F.transform(F.split("text", " "), lambda p, i: piece(F.when(i == 0, p).otherwise(F.concat(F.lit(" "), p))))
    stop = F.lit('{"type":"message_stop"}')
    body = F.concat(F.array(F.to_json(start)), pieces, F.array(F.to_json(end), stop, F.lit("[DONE]"), F.lit("{broken")))
    return msg.select("msg_id", F.posexplode(body).alias("seq", "value")).withColumn(
        "value", F.concat(F.lit("data: "), "value"))


@query
def stream_fold(spark, d):
    events = tables.parse_sse_lines(provider_lines(view(spark, d, "conversations")))
    return conversations.fold_provider_events(events)


@query
def label_distribution(spark, d):
    return metrics.label_distribution(view(spark, d, "samples"))


@query
def compression_report(spark, d):
    out = metrics.compression_report(compression.method_figures(view(spark, d, "prompts")))
    return out.withColumn("mean_ratio", F.round("mean_ratio", 6))


@query
def monthly_reset(spark, d):
    return meter.monthly_reset(api_keys(spark, d)).select("id", "reset", real("remaining_budget").alias("remaining_budget"))


@query
def unique_violations(spark, d):
    rules = quality.unique_violations(view(spark, d, "rule_table"), ["intent", "model"])
    feed = quality.unique_violations(view(spark, d, "price_feed"), ["model_name"])
    keys = quality.unique_violations(view(spark, d, "api_keys"), ["key_hash"])
    named = lambda df, n, c: df.select(F.lit(n).alias("source"), F.concat_ws("/", *c).alias("value"), "copies")
    return named(rules, "rules", ["intent", "model"]).unionByName(named(feed, "prices", ["model_name"])).unionByName(
        named(keys, "keys", ["key_hash"]))


# ---------------------------------------------------------------------------------- order dependent
@query
def collapse_lines(spark, d):
    return text.compress_log_text(view(spark, d, "prompts"), "text", "compressed").select("doc_id", "compressed")


@query
def merge_roles(spark, d):
    return conversations.merge_roles(view(spark, d, "chat_turns"))


@query
def rate_limit(spark, d):
    out = meter.rate_limit(view(spark, d, "requests"), "api_key_id", limit=2, width=86_400)
    return out.select("request_id", "nth", "limited")


@query
def rate_limit_default(spark, d):
    out = meter.rate_limit(view(spark, d, "requests"), "api_key_id")
    return out.select("request_id", "nth", "limited")


@query
def running_budget(spark, d):
    out = meter.running_budget(charges(spark, d), api_keys(spark, d))
    return out.select("request_id", real("balance_before").alias("balance_before"), "refused")


@query
def running_budget_durable(spark, d):
    out = meter.running_budget(charges(spark, d), api_keys(spark, d), mode="durable")
    return out.select("request_id", real("balance_before").alias("balance_before"), "refused")


@query
def running_budget_monthly(spark, d):
    out = meter.running_budget(charges(spark, d), api_keys(spark, d), monthly=True, tz="Asia/Tokyo")
    return out.select("request_id", "budget_month", real("balance_before").alias("balance_before"), "refused")


@query
def low_budget_alerts(spark, d):
    balances = meter.running_budget(charges(spark, d), api_keys(spark, d))
    return meter.low_budget_alerts(balances).select("request_id", "api_key_id", real("balance_after").alias("balance_after"))


@query
def greedy_ttl(spark, d):
    events = view(spark, d, "events")
    out = ordered.greedy_ttl(events, ["event_type"], "ts", "event_id", F.lit(3600))
    return out.select("event_type", "event_id")


@query
def fifo_batches(spark, d):
    ranked = ordered.number_rows(view(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "nth")
    batch = F.floor((F.col("nth") - 1) / fixed.QUEUE_BATCH).cast("bigint")
    return ranked.select("event_id", batch.alias("batch"))


@query
def weighted_route(spark, d):
    out = routing.route(scoped_requests(spark, d), view(spark, d, "routing_rules"))
    return out.select("request_id", "routed_by", F.col("rule.id").alias("rule_id"), F.col("rule.model").alias("model"))


# -------------------------------------------------------------------------------- sorts and upserts
@query
def recent_logs(spark, d):
    out = metrics.recent_logs(token_logs(spark, d))
    return out.withColumn("cost_usd", real("cost_usd")).withColumn("created_at", stamp("created_at"))


@query
def samples_recent(spark, d):
    return changes.samples_recent(view(spark, d, "samples")).select("id", "intent", "updated_at")


@query
def price_upsert(spark, d):
    out = pricing.price_upsert(view(spark, d, "price_base"), view(spark, d, "price_feed"))
    return out.select("model_name", "provider", real("input_price").alias("input_price"),
                      real("output_price").alias("output_price"), "inserted")


@query
def keyword_set(spark, d):
    current = view(spark, d, "part").select(F.col("p_name").alias("keyword"))
    added = view(spark, d, "benchmark").select(F.concat(F.lit("  "), "text").alias("keyword"))
    removed = view(spark, d, "part").where("p_size = 7").select(F.concat("p_name", F.lit(" ")).alias("keyword"))
    return guardrail.keyword_set(current, added, removed)


@query
def cache_latest(spark, d):
    saves = view(spark, d, "requests").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("saved_at"), "request_id")
    return similarity.cache_latest(saves)


@query
def budget_adjust(spark, d):
    out = meter.budget_adjust(api_keys(spark, d), view(spark, d, "budget_changes"))
    return out.select("id", real("total_budget").alias("total_budget"), real("remaining_budget").alias("remaining_budget"),
                      "status", "budget_type", "changes")


@query
def rule_changes(spark, d):
    rules = tables.with_rule_defaults(view(spark, d, "rule_table")).select("id", "intent", "model", "weight")
    return changes.rule_change_apply(rules, view(spark, d, "rule_changes").withColumnRenamed("rule_id", "id"))


@query
def sample_changes(spark, d):
    samples = view(spark, d, "samples").select("id", "intent", "sample_text")
    edits = view(spark, d, "sample_changes").withColumnRenamed("sample_id", "id")
    return changes.apply_changes(samples, edits, "id")


# ---------------------------------------------------------------------------------------- scalars
@query
def token_estimate(spark, d):
    return view(spark, d, "prompts").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def strip_terminal(spark, d):
    return view(spark, d, "prompts").select("doc_id", text.strip_terminal(F.col("text")).alias("text"))


def _telegraphic(intensity):
    return lambda spark, d: view(spark, d, "prompts").select(
        "doc_id", text.telegraphic(F.col("text"), intensity).alias("text"))


QUERIES["caveman_lite"] = _telegraphic("lite")
QUERIES["caveman"] = _telegraphic("full")
QUERIES["caveman_ultra"] = _telegraphic("ultra")


@query
def compress_stacked(spark, d):
    return compression.compress(view(spark, d, "prompts"), "stacked", "ultra").select(
        "doc_id", "method", "original_tokens", "compressed_tokens", F.round("ratio", 9).alias("ratio"), "compressed_text")


@query
def compress_budgeted(spark, d):
    return compression.compress_budgeted(view(spark, d, "prompts"))


@query
def normalise_prompt(spark, d):
    clean = text.normalise_prompt(F.col("text"))
    return view(spark, d, "prompts").select("doc_id", text.prompt_key(clean).alias("memo_key"))


@query
def score_gate(spark, d):
    return view(spark, d, "events").select("event_id", scalars.passes_score(F.col("value") / 10 - 1).alias("accepted"))


@query
def ttl_by_intent(spark, d):
    return view(spark, d, "token_logs").select("id", scalars.ttl_seconds(F.col("intent")).alias("ttl"))


@query
def model_name_parse(spark, d):
    n = F.col("name")
    return view(spark, d, "local_models").select("id", scalars.model_path(n).alias("path"), scalars.model_tag(n).alias("tag"))


@query
def model_label(spark, d):
    names = view(spark, d, "token_logs").select("model").union(pricing.alias_expand(view(spark, d, "price_feed")).select("model_name"))
    return names.distinct().select("model", scalars.model_label(F.col("model")).alias("label"))


@query
def request_cost(spark, d):
    return token_logs(spark, d).select("id", real("cost_usd").alias("cost_usd"))


@query
def url_scheme(spark, d):
    pages = view(spark, d, "pages").select("page_id", F.expr(
        "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ' || replace(url, 'http://', '') ELSE upper(url) END").alias("url"))
    rules = view(spark, d, "rule_table").select((-F.col("id") - 1).alias("page_id"), "url")
    return pages.unionByName(rules).select("page_id", scalars.with_scheme(F.col("url")).alias("url"))


@query
def alert_text(spark, d):
    message = scalars.low_budget_text(F.col("name"), F.col("remaining_budget") * 12345, F.col("total_budget"))
    low = meter.is_low(F.col("remaining_budget"), F.col("total_budget"))
    return api_keys(spark, d).where(low).select("id", message.alias("message"))


@query
def threshold_band(spark, d):
    return view(spark, d, "events").select("event_id", scalars.threshold_band(F.col("value") / 100).alias("band"))


# -------------------------------------------------------------------------------------- whole plans
@query
def classify_intent(spark, d):
    model = intent.train_intent(view(spark, d, "intent_samples"))
    return intent.classify_intent(view(spark, d, "prompts"), model).select("doc_id", "intent")


@query
def train_intent(spark, d):
    """The trained model as a table: from the file where it has rows, else from the table."""
    none = view(spark, d, "intent_samples").limit(0)
    return intent.retrain(none, view(spark, d, "intent_samples")).table()


@query
def embed_prompts(spark, d):
    """Vectors of an encoder that is given: here one that counts signs, words and lines."""
    encode = lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("\n") + 1)] for t in texts]
    out = intent.embed(view(spark, d, "prompts"), encode=encode)
    return out.select("doc_id", *[F.round(real(F.col("embedding")[i]), 5).alias(f"e{i}") for i in range(3)])


@query
def pair_scores(spark, d):
    """Lookups and cached prompts of neighbouring numbers, scored by a given model: here by how much their lengths differ."""
    score = lambda qs, es: [3.0 - abs(len(q) - len(e)) / 500 for q, e in zip(qs, es)]
    queries, entries = view(spark, d, "lookups"), view(spark, d, "cache_entries")
    pairs = queries.select("query_id", F.col("prompt").alias("q"), (F.col("query_id") + 1).alias("entry_id")).join(
        entries.select("entry_id", F.col("prompt").alias("e")), "entry_id")
    scored = pairs.withColumn("logit", intent.pair_scorer(score)(F.col("q"), F.col("e"), F.lit(0.0)))
    return scored.select("query_id", "entry_id", F.round("logit", 9).alias("logit"), scalars.passes_score(F.col("logit")).alias("accepted"))


@query
def gateway_replay(spark, d):
    words = view(spark, d, "nation").select(F.regexp_replace(F.lower("n_name"), "nation_", "th").alias("keyword"))
    logs = gateway.replay(
        view(spark, d, "requests"), view(spark, d, "prompts"), api_keys(spark, d), view(spark, d, "routing_rules"),
        view(spark, d, "model_prices"), view(spark, d, "outcomes"), words, limit=2, width=86_400)
    return logs.select("request_id", "user_id", "intent", "model", "prompt_tokens", "completion_tokens", "total_tokens",
                       real("cost_usd").alias("cost_usd"))


# ------------------------------------------------------------------- streams, drained over the tables
def as_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of a table as a stream of files."""
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is and read what it wrote."""
    path = work_dir(spark, f"{name}-out")
    stream_logs.append_alerts(stream, path, work_dir(spark, f"{name}-state"), drain=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def thirds(ts: str, df: DataFrame) -> Column:
    """In which third of the table's time span a row lies."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = (x or 0 for x in df.agg(F.min(t), F.max(t)).first())
    return F.least(F.floor((t - F.lit(low)) / F.lit((high - low) // 3 + 1)), F.lit(2))


def replayed(
    spark: SparkSession, df: DataFrame, batch: Column, start: Callable[[DataFrame, str, str], StreamingQuery], name: str
) -> str:
    """Feed a stream in three batches, the rows with ``batch`` 0, 1 and 2: ``start(stream, out, checkpoint)``. Returns ``out``."""
    path, out, at = (work_dir(spark, f"{name}-{n}") for n in ("in", "out", "at"))
    for i in range(3):
        df.where(batch == i).write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path), out, at).awaitTermination()
    return out


def keyed(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str, str], StreamingQuery]:
    """Start a stream of rows that are appended, batch by batch."""
    return lambda stream, out, at: stream_logs.append_alerts(make(stream), out, at, drain=True)


@query
def stream_log_ingest(spark, d):
    """The ingested log table, read back: requests and tokens per model, what its numbers are, and the dead letters."""
    line = F.to_json(F.struct(
        "api_key_id", "user_id", "intent", "model", "prompt_tokens",
        F.when(F.col("id") % 7 != 3, F.col("completion_tokens")).alias("completion_tokens"), "latency_ms"))
    lines = view(spark, d, "token_logs").select(line.alias("value"), F.col("created_at").cast("timestamp").alias("queued_at"))
    dead = work_dir(spark, "dead")
    start = lambda stream, out, at: stream_logs.log_ingest_stream(stream, out, dead, at, drain=True)
    logs = tables.read_token_logs(spark, replayed(spark, lines, thirds("queued_at", lines), start, "ingest"))
    good = metrics.by_model(logs).select("model", F.col("count").alias("entries"), "tokens")
    numbers = logs.agg(F.lit("numbers").alias("model"), F.countDistinct("id").alias("entries"), F.max("id").alias("tokens"))
    lost = spark.read.schema("value string").parquet(dead).agg(
        F.lit("dead letters").alias("model"), F.count("*").alias("entries"), F.lit(0).cast("bigint").alias("tokens"))
    return good.unionByName(numbers).unionByName(lost)


@query
def stream_ingested_days(spark, d):
    """Dashboard figures by day over the ingested table: its rows have the time when they were queued."""
    line = F.to_json(F.struct("api_key_id", "user_id", "intent", "model", "prompt_tokens", "completion_tokens", "latency_ms"))
    lines = view(spark, d, "token_logs").select(line.alias("value"), F.col("created_at").cast("timestamp").alias("queued_at"))
    start = lambda stream, out, at: stream_logs.log_ingest_stream(stream, out, work_dir(spark, "dead"), at, drain=True)
    logs = tables.read_token_logs(spark, replayed(spark, lines, thirds("queued_at", lines), start, "ingest"))
    return logs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "intent").agg(
        F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms"))


@query
def stream_live_dashboard(spark, d):
    logs = token_logs(spark, d)
    start = lambda stream, out, at: stream_logs.live_dashboard(stream, out, at, drain=True)
    path = replayed(spark, logs, thirds("created_at", logs), start, "dashboard")
    return stream_logs.dashboard_by_model(stream_logs.read_dashboard(spark, path))


@query
def stream_dashboard_summary(spark, d):
    logs = token_logs(spark, d)
    start = lambda stream, out, at: stream_logs.live_dashboard(stream, out, at, drain=True)
    path = replayed(spark, logs, thirds("created_at", logs), start, "dashboard")
    out = stream_logs.snapshot_summary(stream_logs.read_dashboard(spark, path))
    return out.withColumn("total_cost_usd", real("total_cost_usd"))


@query
def stream_newest_logs(spark, d):
    logs = token_logs(spark, d).select(*metrics.RECENT_COLUMNS)
    start = lambda stream, out, at: stream_logs.newest_logs(stream, out, at, drain=True)
    path = replayed(spark, logs, thirds("created_at", logs), start, "newest")
    out = read_snapshot(spark, path, logs.schema)
    return out.withColumn("cost_usd", real("cost_usd")).withColumn("created_at", stamp("created_at"))


@query
def stream_rate_limit(spark, d):
    """Windows that the watermark has closed; the stream's last ones stay open."""
    requests = view(spark, d, "requests").select("request_id", "api_key_id", F.col("ts").cast("timestamp").alias("ts"))
    # a far later row closes every window of the data
    closing = requests.agg(F.max("request_id").alias("request_id"), F.max("api_key_id").alias("api_key_id"),
                           (F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"))
    path = work_dir(spark, "requests")
    requests.write.parquet(path)
    closing.write.mode("append").parquet(path)
    stream = spark.readStream.schema(requests.schema).parquet(path)
    out = drained(spark, stream_logs.rate_limit_stream(stream, "api_key_id", limit=2, width="1 day"), "rate")
    last = spark.read.parquet(path).agg(F.max("ts").alias("_last"))
    days = out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    return days.join(F.broadcast(last), F.col("window_start") < F.col("_last") - F.expr("INTERVAL 1 DAY")).select(
        "api_key_id", "day", "requests", "refused")


def arrival(df: DataFrame) -> Column:
    """The third of the time span, but one request in ten comes a third later than it should."""
    return F.least(thirds("ts", df) + F.when(F.col("request_id") % 10 == 0, 1).otherwise(0), F.lit(2))


@query
def stream_rate_flags(spark, d):
    """A flag for each request, late ones among them."""
    requests = view(spark, d, "requests").select("request_id", "api_key_id", "ts")
    make = keyed(lambda stream: stateful.rate_flags_stream(stream, "api_key_id", limit=2, width=86_400, keep=31 * 86_400))
    out = spark.read.parquet(replayed(spark, requests, arrival(requests), make, "flags"))
    return out.select("request_id", "nth", "limited")


@query
def stream_alert_silence(spark, d):
    events = view(spark, d, "events").select("event_id", "user_id", "ts")
    make = keyed(lambda stream: stateful.alert_silence_stream(stream, "user_id", "ts", "event_id", 86_400))
    out = spark.read.parquet(replayed(spark, events, thirds("ts", events), make, "alerts"))
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


@query
def stream_budget(spark, d):
    costs, keys = charges(spark, d), api_keys(spark, d)
    make = keyed(lambda stream: stateful.budget_stream(stream, keys))
    out = spark.read.parquet(replayed(spark, costs, thirds("ts", costs), make, "budget"))
    return out.select("request_id", F.round(real("balance_before"), 9).alias("balance_before"), "refused", "alert")


def code_or_general(prompt: str) -> str:
    """The keyword rule for one cleaned prompt."""
    words = re.findall("[a-z0-9]+", prompt)
    coded = any(w in fixed.CODE_WORDS or any(s in w for s in fixed.CODE_STEMS) for w in words)
    return "code" if coded else "general"


@query
def stream_memo_labels(spark, d):
    """Short prompts, many of them equal: each is labelled once an hour, its copies get the same label."""
    prompts = view(spark, d, "short_prompts")
    make = keyed(lambda stream: stateful.memo_label_stream(stream, code_or_general))
    out = spark.read.parquet(replayed(spark, prompts, thirds("ts", prompts), make, "memo"))
    return out.select("request_id", "intent", "remembered")


@query
def stream_config(spark, d):
    """Requests with the settings of their key as of their time; the settings change once, and some requests come late."""
    requests = view(spark, d, "requests").select("request_id", "key_number", "ts")
    changes_ = view(spark, d, "key_settings")
    apply = lambda batch, config: stream_logs.config_as_of(batch, config, "key_number")
    start = lambda stream, out, at: stream_logs.config_stream_join(
        stream, lambda session: changes_, apply, out, at, drain=True)
    out = spark.read.parquet(replayed(spark, requests, arrival(requests), start, "config"))
    return out.select("request_id", "config.model", "config.max_tokens")


@query
def stream_fold_live(spark, d):
    events = tables.parse_sse_lines(provider_lines(view(spark, d, "conversations"))).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("msg_id")))
    return drained(spark, stateful.stream_fold_stateful(as_stream(spark, events, "provider")), "fold")

# ------------------------------------------------------------------- snapshots, generations, readers
ENTRIES = "cache_key string, saved_at bigint, expires_at bigint, request_id bigint"


@query
def cache_generations(spark, d):
    """Three generations of entries, the first two compacted halfway, as they stand at the end."""
    requests = view(spark, d, "requests")
    saved = F.unix_seconds(F.col("ts").cast("timestamp"))
    entries = requests.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), saved.alias("saved_at"),
        (saved + scalars.ttl_seconds(F.col("logged_intent"))).alias("expires_at"), "request_id", thirds("ts", requests).alias("third"))
    path, last = work_dir(spark, "entries"), 0
    for i in range(3):
        mine = entries.where(F.col("third") == i).drop("third")
        sinks.write_generation(mine, path, i)
        last = mine.agg(F.max("saved_at")).first()[0] or last
        if i == 1:
            sinks.compact_generations(spark, path, ENTRIES, last)
    return sinks.read_generations(spark, path, ENTRIES, last).select("cache_key", "saved_at", "request_id")


@query
def price_snapshot(spark, d):
    """The served prices after two snapshots, and an empty table that leaves them in place."""
    base, feed = view(spark, d, "price_base"), pricing.alias_expand(view(spark, d, "price_feed"))
    path = work_dir(spark, "prices")
    for prices in (base, pricing.price_upsert(base, view(spark, d, "price_feed")), feed.limit(0)):
        sinks.overwrite_price_snapshot(prices, path)
    served = sinks.read_price_snapshot(spark, path)
    return served.select("model_name", "provider", real("input").alias("input_price"), real("output").alias("output_price"))


@query
def price_feed_files(spark, d):
    """Prices read from catalogue documents, in several files: a later document comes after all of an earlier one."""
    feed, path = view(spark, d, "price_feed"), work_dir(spark, "catalogue")
    item = F.struct(F.col("model_name").alias("id"), F.struct(
        F.col("input_price").cast("string").alias("prompt"), F.col("output_price").cast("string").alias("completion")).alias("pricing"))
    document = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("m")))), lambda x: x.m).alias("data")))
    documents = feed.groupBy(F.floor(F.col("seq") / 500).alias("file")).agg(document.alias("value"))
    documents.select(F.format_string("%08d", "file").alias("file"), "value").repartition("file").write.partitionBy("file").text(path)
    newest = tables.read_price_feed(spark, path).groupBy("model_name").agg(F.max_by(F.struct("input_price", "output_price"), "seq").alias("p"))
    return newest.select("model_name", real("p.input_price").alias("input_price"), real("p.output_price").alias("output_price"))


@query
def table_readers(spark, d):
    """The durable tables, written and read again through their readers."""
    logs, keys, rules = (work_dir(spark, n) for n in ("logs", "keys", "rules"))
    sinks.write_token_logs(token_logs(spark, d), logs)
    view(spark, d, "api_keys").select(*[F.col(f.name).cast(f.dataType) for f in tables.API_KEYS]).write.parquet(keys)
    view(spark, d, "rule_table").select(*[
        F.col(f.name).cast(f.dataType) if f.name in view(spark, d, "rule_table").columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in tables.ROUTING_RULES]).write.parquet(rules)
    row = lambda name, df, total: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), total.cast("bigint").alias("total"))
    return (
        row("logs", tables.read_token_logs(spark, logs), F.sum("total_tokens"))
        .unionByName(row("keys", tables.read_api_keys(spark, keys), F.sum(F.coalesce(F.size("allowed_rules"), F.lit(0)))))
        .unionByName(row("rules", tables.read_routing_rules(spark, rules), F.sum("weight")))
    )


@query
def local_model_sizes(spark, d):
    """Models as large as the lines of their part, in layers of some megabytes."""
    layers = view(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.collect_list(F.struct((F.col("l_quantity").cast("bigint") * 25_000_000).alias("size"))).alias("layers"))
    manifests = view(spark, d, "part").join(layers, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").cast("string").alias("name"), "layers")
    return metrics.local_model_sizes(manifests).select("name", "size_gb", "size", "over_limit")


@query
def installed_models(spark, d):
    installed = view(spark, d, "local_models").where("name LIKE '%:%'").select("name")
    plain = view(spark, d, "local_models").select(F.regexp_replace("name", ":.*", "").alias("name"))
    return metrics.installed_models(plain.unionByName(view(spark, d, "local_models").select("name")),
                                    installed.unionByName(plain.select(F.concat("name", F.lit(":latest")).alias("name")).where("length(name) % 2 = 0")))


@query
def cached_answers(spark, d):
    """What a cached answer says: a document's first choice, or the text itself where it is no answer document."""
    out = view(spark, d, "outcomes")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")).alias("message"))).alias("choices")))
    response = F.when(F.col("request_id") % 3 == 0, F.col("answer")).when(F.col("request_id") % 3 == 1, body).otherwise(F.to_json(F.struct("answer")))
    said = tables.parse_answer(response)["choices"][0]["message"]
    return out.select("request_id", said["role"].alias("role"), said["content"].alias("content"))


@query
def cache_clear(spark, d):
    """How many entries a full clear takes away, by kind."""
    hits = similarity.cache_latest(view(spark, d, "requests").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("saved_at"), "request_id"))
    memo = view(spark, d, "short_prompts").select(text.prompt_key(text.normalise_prompt(F.col("text"))).alias("cache_key"))
    return metrics.cache_clear_count({"exact": hits, "semantic": view(spark, d, "cache_entries"), "intent": memo.distinct()})


@query
def chat_defaults(spark, d):
    """What a provider is asked for: the given limit of tokens, or the default."""
    turns = view(spark, d, "chat_turns")
    asked = turns.select("conv_id", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") % 900 + 1).cast("int").alias("max_tokens")).distinct()
    merged = conversations.merge_roles(turns, limits=asked)
    return merged.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("max_tokens").alias("max_tokens"))
