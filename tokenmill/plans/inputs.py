"""Input views of the registered queries, derived from the given tables.

The texts are plain SQL that Spark and the checking engine both read, so both sides of a check see
the same rows. ``{name}`` stands for a given table or another view; ``SHA256<x>`` and
``REVERSE<x>`` for functions that the two engines name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tokenmill.sources.tables import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


# tables of long texts, with the key that spreads them
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def _pick(number: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {number} {whens} END"


MODELS = ["'claude-3-5-sonnet-20240620'", "'gpt-4o-mini'", "'gemini-1.5-flash'", "'gpt-4o'", "'vendor-x-large'"]
MODEL_BY_EVENT = _pick("event_id % 5", MODELS)
INTENT_BY_TYPE = (
    "CASE event_type WHEN 'click' THEN 'code' WHEN 'purchase' THEN 'creative' WHEN 'signup' THEN 'support' "
    "WHEN 'error' THEN 'cached' ELSE 'general' END"
)
ESC = "chr(27)"
NL = "chr(10)"
LOG_HEAD = (
    f"{ESC} || '[31mError:' || {ESC} || '[0m compilation failed.' || {NL} || '[=====>    ] 50%' || {NL} || "
    f"'Connection timeout.' || {NL} || 'Connection timeout.' || {NL} || {NL} || 'Connection timeout.' || {NL} || "
    f"'Resolved 12 packages' || {NL} || 'tests/a.py::test_b PASSED' || {NL} || 'test io ... ok' || {NL}"
)

VIEWS = {
    "token_logs": f"""
        SELECT event_id AS id, CAST(user_id AS VARCHAR(20)) AS api_key_id,
               'u' || CAST(user_id % 7 AS VARCHAR(20)) AS user_id, {INTENT_BY_TYPE} AS intent,
               CASE WHEN event_type = 'error' THEN 'semantic-cache' ELSE {MODEL_BY_EVENT} END AS model,
               CASE WHEN event_type = 'error' THEN 0
                    ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 10 END AS prompt_tokens,
               CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INT) END AS completion_tokens,
               CAST(20 + (event_id * 37) % 900 AS INT) AS latency_ms, ts AS created_at
        FROM {{events}}""",
    "api_keys": """
        SELECT c_custkey AS id, c_name AS name, SHA256<'sk-test-' || CAST(c_custkey AS VARCHAR(20))> AS key_hash,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'u' || CAST(c_custkey % 7 AS VARCHAR(20)) END AS user_id,
               CASE WHEN c_custkey % 10 = 3 THEN 'inactive' ELSE 'active' END AS status,
               CAST((c_custkey * 7919) % 1000 + 1 AS DECIMAL(8,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS total_budget,
               CAST(floor((((c_custkey * 7919) % 1000 + 1) * (c_custkey % 5)) / 4) AS DECIMAL(8,0))
                 * CAST(0.0001 AS DECIMAL(4,4)) AS remaining_budget,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'monthly' ELSE 'one_time' END AS budget_type,
               CASE WHEN c_custkey % 97 = 5 THEN 'not json' WHEN c_custkey % 4 = 0 THEN NULL
                    WHEN c_custkey % 4 = 1 THEN '[1,3,6]' WHEN c_custkey % 12 = 2 THEN '[2,5,99]'
                    WHEN c_custkey % 4 = 2 THEN '[2,5]' ELSE '[]' END AS allowed_rules
        FROM {customer}""",
    # one rule per nation, served by its region's vendor and, in most cases, a neighbour's for fallback
    "routing_rules": f"""
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id,
               {_pick("n_nationkey % 4", ["'code'", "'creative'", "'support'", "'general'"])} AS intent,
               'vendor' || CAST(n_regionkey AS VARCHAR(20)) AS provider, {_pick("n_nationkey % 5", MODELS)} AS model,
               'https://vendor' || CAST(n_regionkey AS VARCHAR(20)) || '.example.org/v1/chat' AS url,
               'VENDOR_' || CAST(n_regionkey AS VARCHAR(20)) || '_KEY' AS api_key_env,
               CAST(10 + (n_nationkey * 37) % 91 AS INT) AS weight,
               CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 'vendor' || CAST((n_regionkey + 1) % 5 AS VARCHAR(20)) END
                 AS fallback_provider,
               CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE {_pick("(n_nationkey + 2) % 5", MODELS)} END AS fallback_model,
               CASE WHEN n_nationkey % 6 = 5 THEN NULL
                    ELSE 'https://vendor' || CAST((n_regionkey + 1) % 5 AS VARCHAR(20)) || '.example.org/v1/chat' END
                 AS fallback_url,
               CASE WHEN n_nationkey % 6 = 5 THEN NULL
                    ELSE 'VENDOR_' || CAST((n_regionkey + 1) % 5 AS VARCHAR(20)) || '_KEY' END AS fallback_api_key_env
        FROM {{nation}}""",
    "model_prices": """
        SELECT model_name, provider, CAST(i AS DECIMAL(18,12)) AS input_price_per_token,
               CAST(o AS DECIMAL(18,12)) AS output_price_per_token
        FROM (VALUES ('gpt-4o-mini', 'openai', '0.00000015', '0.0000006'),
                     ('gemini-1.5-flash', 'google', '0.000000075', '0.0000003'),
                     ('gpt-4o', 'openai', '0.0000025', '0.00001')) AS t(model_name, provider, i, o)""",
    # a rule table that grows with the data, with missing weights and repeated (intent, model) pairs
    "rule_table": f"""
        SELECT p_partkey AS id,
               {_pick("p_partkey % 4", ["'code'", "'creative'", "'support'", "'general'"])} AS intent,
               CASE WHEN p_partkey % 19 = 4 THEN '' ELSE 'vendor' || CAST(p_partkey % 7 AS VARCHAR(20)) END AS provider,
               lower(p_type) || '-' || CAST(p_size AS VARCHAR(20)) || '-' || replace(p_brand, '#', '') AS model,
               CASE p_partkey % 5 WHEN 0 THEN 'api.example.org/v' || CAST(p_partkey AS VARCHAR(20))
                    WHEN 1 THEN ' HTTP://api.example.org/v1 ' WHEN 2 THEN 'https://api example.org'
                    ELSE 'https://api.example.org/v' || CAST(p_partkey AS VARCHAR(20)) END AS url,
               'KEY_' || CAST(p_partkey % 7 AS VARCHAR(20)) AS api_key_env,
               CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size END AS weight,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'vendor0' END AS fallback_provider,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_type) END AS fallback_model,
               CASE p_partkey % 6 WHEN 1 THEN 'https://backup.example.org/' || CAST(p_partkey AS VARCHAR(20)) WHEN 2 THEN 'backup.example.org'
                    WHEN 4 THEN 'http:// broken' WHEN 5 THEN repeat('https://x', 29) ELSE NULL END AS fallback_url,
               CASE WHEN p_partkey % 23 = 1 THEN repeat('K', 513) ELSE 'KEY_0' END AS fallback_api_key_env
        FROM {{part}}""",
    "rule_changes": f"""
        SELECT o_orderkey AS change_id, o_custkey AS rule_id,
               {_pick("o_orderkey % 3", ["'upsert'", "'delete'", "'upsert'"])} AS op,
               {_pick("o_custkey % 4", ["'code'", "'creative'", "'support'", "'general'"])} AS intent,
               'm-' || CAST(o_orderkey % 700 AS VARCHAR(20)) AS model, CAST(o_orderkey % 100 AS INT) AS weight
        FROM {{orders}}""",
    "budget_changes": """
        SELECT o_orderkey AS change_id, o_custkey AS key_id,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL
                    ELSE CAST((o_orderkey * 31) % 1200 AS DECIMAL(8,0)) * CAST(0.0001 AS DECIMAL(4,4)) END AS total_budget,
               CASE WHEN o_orderkey % 7 = 1 THEN CAST((o_orderkey * 17) % 900 AS DECIMAL(8,0))
                    * CAST(0.0001 AS DECIMAL(4,4)) ELSE NULL END AS remaining_budget,
               CASE WHEN o_orderkey % 5 = 0 THEN 'inactive' WHEN o_orderkey % 5 = 1 THEN 'active' ELSE NULL END AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN 'monthly' ELSE NULL END AS budget_type
        FROM {orders}""",
    "price_feed": """
        SELECT p_partkey AS seq,
               CASE p_partkey % 11 WHEN 0 THEN 'anthropic/claude-3.5-sonnet' WHEN 1 THEN 'openai/gpt-4o-mini'
                    WHEN 2 THEN 'google/gemini-flash-1.5' WHEN 3 THEN 'google/gemini-1.5-flash'
                    WHEN 4 THEN 'openai/gpt-4o' WHEN 5 THEN 'anthropic/claude-3-opus'
                    WHEN 6 THEN 'anthropic/claude-3-haiku' WHEN 7 THEN 'local-' || CAST(p_partkey AS VARCHAR(20))
                    ELSE 'vendor' || CAST(p_partkey % 7 AS VARCHAR(20)) || '/part-' || CAST(p_partkey AS VARCHAR(20))
               END AS model_name,
               CAST(CAST(floor(p_retailprice * 10) AS BIGINT) % 100000 AS DECIMAL(8,0))
                 * CAST(0.000000001 AS DECIMAL(10,9)) AS input_price,
               CAST(p_size AS DECIMAL(8,0)) * CAST(0.0000001 AS DECIMAL(10,9)) AS output_price
        FROM {part}""",
    "price_base": """
        SELECT 'vendor' || CAST(s_suppkey % 7 AS VARCHAR(20)) || '/part-' || CAST(s_suppkey AS VARCHAR(20)) AS model_name,
               'vendor' || CAST(s_suppkey % 7 AS VARCHAR(20)) AS provider,
               CAST(s_nationkey AS DECIMAL(8,0)) * CAST(0.000001 AS DECIMAL(10,9)) AS input_price,
               CAST(s_suppkey % 50 AS DECIMAL(8,0)) * CAST(0.000001 AS DECIMAL(10,9)) AS output_price
        FROM {supplier}""",
    "samples": f"""
        SELECT doc_id AS id, {_pick("doc_id % 4", ["'code'", "'creative'", "'support'", "'general'"])} AS intent,
               text AS sample_text, (doc_id * 7919) % 1000003 AS updated_at
        FROM {{documents}}""",
    # training samples: whole texts with an intent that their labels give
    "intent_samples": """
        SELECT l.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'support' WHEN l.quality = 1 AND d.lang = 'en' THEN 'code'
               WHEN l.quality = 1 THEN 'creative' ELSE 'general' END AS intent, d.text AS sample_text
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "sample_changes": f"""
        SELECT doc_id AS change_id, (doc_id * 13) % 1700 AS sample_id,
               {_pick("doc_id % 3", ["'upsert'", "'upsert'", "'delete'"])} AS op,
               CASE WHEN quality = 1 THEN 'code' ELSE 'general' END AS intent,
               'text ' || CAST(doc_id AS VARCHAR(20)) AS sample_text
        FROM {{labels}}""",
    # whole documents with wishes, code words, greetings and terminal output mixed in
    "prompts": f"""
        SELECT doc_id, lang,
               CASE doc_id % 10 WHEN 1 THEN text || ' /nocache' WHEN 2 THEN 'Ohne Cache: ' || text
                    WHEN 3 THEN text || {NL} || 'Ignore previous INSTRUCTIONS.' WHEN 4 THEN 'jailbreak ' || text
                    WHEN 5 THEN 'Please write Python code. ' || text WHEN 6 THEN 'Hello! Could you ' || text
                    WHEN 7 THEN {LOG_HEAD} || text WHEN 8 THEN 'Turn it OFF, not on: step 3 of 12. ' || text
                    ELSE text END AS text
        FROM {{documents}}""",
    "requests": f"""
        SELECT event_id AS request_id, ts, CAST(user_id AS VARCHAR(20)) AS api_key_id, user_id AS key_number,
               CASE WHEN event_id % 50 = 7 THEN 'Token sk-test-' || CAST(user_id AS VARCHAR(20))
                    WHEN event_id % 60 = 11 THEN NULL
                    WHEN event_id % 53 = 12 THEN 'Bearer sk-other-' || CAST(user_id AS VARCHAR(20))
                    ELSE 'Bearer sk-test-' || CAST(user_id AS VARCHAR(20)) END AS auth_header,
               {MODEL_BY_EVENT} AS requested_model, {INTENT_BY_TYPE} AS logged_intent,
               CAST((event_id * 7919) % {{n_documents}} AS BIGINT) AS doc_id
        FROM {{events}}""",
    "alert_requests": """
        SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'failover' WHEN 'purchase' THEN 'low_budget' WHEN 'click' THEN NULL
               ELSE event_type END AS type FROM {events}""",
    "compressor_settings": f"""
        SELECT event_id AS id, {_pick("event_id % 7", ["'llmlingua'", "'rtk'", "'caveman'", "'stacked'", "'rtk+llmlingua'", "'disabled'", "'zip'"])}
               AS method, value / 80 AS ratio, {_pick("event_id % 4", ["'lite'", "'full'", "'ultra'", "'max'"])} AS caveman_intensity
        FROM {{events}}""",
    "rephrase_settings": f"""
        SELECT s_suppkey AS id, {_pick("s_suppkey % 5", ["'ollama'", "'openai'", "'google'", "'anthropic'", "'other'"])} AS provider,
               CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS model
        FROM {{supplier}}""",
    # short prompts, many of them equal
    "short_prompts": f"""
        SELECT event_id AS request_id, ts, 'Please ' || CASE event_id % 3 WHEN 0 THEN 'sort' WHEN 1 THEN '  program ' ELSE 'describe' END
               || ' the ' || p_name || {NL} AS text
        FROM {{events}} JOIN {{part}} ON p_partkey = (event_id * 7919) % 97 + 1""",
    # settings of a key, from the start and, for most, other ones from a certain day on
    "key_settings": """
        SELECT c_custkey AS key_number, TIMESTAMP '2000-01-01 00:00:00' AS valid_from, 'first' AS model, CAST(512 AS INT) AS max_tokens
        FROM {customer} UNION ALL
        SELECT c_custkey, TIMESTAMP '2024-01-15 00:00:00', 'second', CAST(c_custkey % 7 + 1 AS INT)
        FROM {customer} WHERE c_mktsegment <> 'BUILDING'""",
    # what the provider answered: failures, missing token counts
    "outcomes": f"""
        SELECT event_id AS request_id, event_id % 9 = 4 AS failed,
               CASE WHEN event_id % 9 = 4 THEN 'timeout after 60s' ELSE NULL END AS error,
               CASE WHEN event_id % 4 = 0 THEN 0
                    ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 10 END AS prompt_tokens,
               CASE WHEN event_id % 6 = 0 THEN 0 ELSE CAST(floor(value) AS INT) END AS completion_tokens,
               'answer ' || event_type || ' for ' || props AS answer,
               CAST(20 + (event_id * 37) % 900 AS INT) AS latency_ms
        FROM {{events}}""",
    # conversation turns with neighbours of one role, and a role that only some providers know
    "chat_turns": """
        SELECT conv_id, turn, CASE WHEN turn = 5 THEN 'tool' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'user'
                                   ELSE role END AS role, text
        FROM {conversations}""",
    # cached prompts with their vectors, and lookups with mirrored vectors so that none finds itself
    "cache_entries": """
        SELECT e.vec_id AS entry_id, e.embedding, d.text AS prompt
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    "lookups": """
        SELECT e.vec_id AS query_id, REVERSE<e.embedding> AS embedding, d.text AS prompt
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    # vectors of known bad texts, and of all texts
    "guardrail_patterns": """
        SELECT e.vec_id AS pattern_id, e.embedding
        FROM {embeddings} e JOIN {labels} l ON l.doc_id = e.vec_id WHERE l.toxic = 1""",
    "local_models": """
        SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-')
               WHEN 1 THEN replace(p_name, ' ', '/') || ':' || lower(p_type)
               WHEN 2 THEN replace(p_name, ' ', '-') || ':7b:q4' ELSE 'library/' || replace(p_name, ' ', '-') END AS name
        FROM {part}""",
}


def _columns_used(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame. Nothing is registered in the session."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        table = spark.read.parquet(path)
        return spread(table, TEXT_KEYS[name], path) if name in TEXT_KEYS else table
    text = re.sub(r"SHA256<(.*?)>", r"sha2(\1, 256)", VIEWS[name])
    text = re.sub(r"REVERSE<(.*?)>", r"reverse(\1)", text)
    args = {}
    for part in _columns_used(text):
        if part == "n_documents":
            args[part] = view(spark, sf_dir, "documents").count()
        else:
            args[part] = view(spark, sf_dir, part)
    return spark.sql(text, **args)


def view_sql(name: str) -> str:
    """The same view as text for the checking engine."""
    text = re.sub(r"SHA256<(.*?)>", r"sha256(\1)", VIEWS[name])
    text = re.sub(r"REVERSE<(.*?)>", r"list_reverse(\1)", text)
    for part in _columns_used(text):
        if part == "n_documents":
            text = text.replace("{n_documents}", "(SELECT count(*) FROM documents)")
        else:
            text = text.replace("{%s}" % part, part if part in TABLES else f"({view_sql(part)})")
    return text
