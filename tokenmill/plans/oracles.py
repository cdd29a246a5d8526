"""The registered queries once more, as SQL for the checking engine. Written on their own, with other
means (row windows, recursion, all pairs), so that both sides agree only if both are right."""

from __future__ import annotations

from tokenmill.functions import fixed
from tokenmill.functions.text import LINE_END, WORD, WS
from tokenmill.plans.inputs import view_sql


def v(name: str) -> str:
    return f"({view_sql(name)})"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(number: str, values: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(values)) + " END"


def alternatives(words: list[str]) -> str:
    return "|".join(words)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def tokens(x: str) -> str:
    return f"CAST(floor({words(x)} * 1.3::DOUBLE) AS BIGINT) + 1"


def listed(side: int) -> str:
    cases = " ".join(f"WHEN contains(model, {q(p[0])}) THEN {p[side]}" for p in fixed.DEFAULT_PRICES)
    return f"CASE {cases} ELSE {fixed.GENERIC_PRICE[side - 1]} END"


def priced(rows: str) -> str:
    """Rows with model, prompt_tokens, completion_tokens -> plus total_tokens and cost_usd."""
    return f"""(SELECT r.*, prompt_tokens + completion_tokens AS total_tokens,
        CAST(prompt_tokens * CAST(coalesce(p.input_price_per_token, {listed(1)}) AS DECIMAL(18,12))
           + completion_tokens * CAST(coalesce(p.output_price_per_token, {listed(2)}) AS DECIMAL(18,12))
           AS DECIMAL(18,12)) AS cost_usd
        FROM {rows} r LEFT JOIN {v('model_prices')} p ON p.model_name = r.model)"""


LOGS = priced(v("token_logs"))
KEYS = f"(SELECT * REPLACE (TRY_CAST(allowed_rules AS BIGINT[]) AS allowed_rules) FROM {v('api_keys')})"
PROMPTS = v("prompts")
RULES = v("routing_rules")
RULE_TABLE = f"(SELECT * REPLACE (coalesce(weight, 100) AS weight) FROM {v('rule_table')})"
TTL = "CASE intent WHEN 'code' THEN 604800 WHEN 'support' THEN 14400 ELSE 86400 END"
DAY = "floor(epoch(ts) / 86400)"
LOW = "(remaining_budget / total_budget)"
SPEND = "CASE WHEN cost_usd > 0 THEN cost_usd ELSE 0 END"
SPEND4 = "round(cost_usd, 4)"
THRESHOLD = 0.34

ORACLES: dict[str, str] = {
    "token_logs_scan": f"""SELECT id, api_key_id, intent, model, total_tokens, latency_ms,
        CAST(cost_usd AS DOUBLE) AS cost_usd FROM {LOGS}""",
    "api_keys_parse": f"""SELECT id, status = 'active' AS active, CAST(total_budget AS DOUBLE) AS total_budget,
        allowed_rules IS NULL AS all_rules, coalesce(array_to_string(allowed_rules, ','), '') AS rules FROM {KEYS}""",
    "rules_by_intent": f"""SELECT intent, row_number() OVER (PARTITION BY intent ORDER BY id) AS place, id, model, weight
        FROM {RULE_TABLE}""",
    "labelled_text": f"""SELECT id, intent, {strip("regexp_replace(sample_text, '[\\r\\n]+', ' ', 'g')")} AS sample_text
        FROM {v('samples')}""",
    "queue_entries": f"""SELECT id, NOT (id % 11 = 5 OR id % 7 = 3) AS ok,
        CASE WHEN id % 11 = 5 OR id % 7 = 3 THEN NULL ELSE prompt_tokens + completion_tokens END AS total_tokens,
        CASE WHEN id % 11 = 5 OR id % 7 = 3 THEN NULL WHEN id % 4 = 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS cost_usd
        FROM {v('token_logs')}""",
    "chat_content": """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN text || ' ' || text WHEN 2 THEN text || ' and'
        WHEN 3 THEN '' ELSE CASE conv_id % 3 WHEN 0 THEN '{"a": 1} ' WHEN 1 THEN '[1] ' ELSE '' END || text END AS content FROM conversations""",
    "last_user_message": """SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1 AND text <> ''""",
    "guardrail_keywords": f"""WITH k AS (SELECT DISTINCT regexp_replace(lower(n_name), 'nation_', 'th') AS w FROM nation),
        hit AS (SELECT doc_id, min(w) AS w FROM {PROMPTS} p JOIN k ON contains(lower(p.text), w) GROUP BY doc_id)
        SELECT *, phrase IS NOT NULL AS blocked FROM (SELECT p.doc_id, coalesce(hit.w, CASE
        {" ".join(f"WHEN contains(lower(text), {q(x)}) THEN {q(x)}" for x in fixed.UNSAFE_PHRASES)} END) AS phrase
        FROM {PROMPTS} p LEFT JOIN hit ON hit.doc_id = p.doc_id)""",
    "guardrail_keywords_many": f"""WITH k AS (SELECT DISTINCT lower(w) AS w FROM (
          SELECT array_to_string(string_split(text, ' ')[1:3], ' ') AS w FROM benchmark UNION ALL
          SELECT array_to_string(string_split(text, ' ')[1:8], ' ') FROM benchmark UNION ALL
          SELECT text FROM benchmark UNION ALL SELECT p_name FROM part)),
        hit AS (SELECT doc_id, min(w) AS w FROM {PROMPTS} p JOIN k ON contains(lower(p.text), w) GROUP BY doc_id)
        SELECT *, phrase IS NOT NULL AS blocked FROM (SELECT p.doc_id, coalesce(hit.w, CASE
        {" ".join(f"WHEN contains(lower(text), {q(x)}) THEN {q(x)}" for x in fixed.UNSAFE_PHRASES)} END) AS phrase
        FROM {PROMPTS} p LEFT JOIN hit ON hit.doc_id = p.doc_id)""",
    "digit_signature": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(
        regexp_extract_all(text, '[\\p{{Nd}}]+'))), ',') AS digits FROM {PROMPTS}""",
    "toggle_signature": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(
        regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({", ".join(map(q, fixed.TOGGLE_WORDS))})))), ',')
        AS toggles FROM {PROMPTS}""",
    "code_override": f"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w:
        w IN ({", ".join(map(q, fixed.CODE_WORDS))}) OR regexp_matches(w, '{alternatives(fixed.CODE_STEMS)}'))) > 0
        AS is_code FROM {PROMPTS}""",
    "rule_access": f"""SELECT access, r.id AS rule_id, r.model, keys FROM
        (SELECT allowed_rules AS l, coalesce(array_to_string(list_sort(allowed_rules), ','), 'every rule') AS access, count(*) AS keys
          FROM {KEYS} GROUP BY ALL) k
        JOIN (SELECT id, model FROM {RULES} UNION ALL SELECT NULL, 'shared') r
        ON k.l IS NULL OR r.id IS NULL OR list_contains(k.l, r.id)""",
    "compression_gate": f"""SELECT doc_id, CASE WHEN length(text) < 150 OR {words('text')} < 30
        THEN 'Prompt too short for compression' END AS reason FROM {PROMPTS}""",
    "sample_search": f"""SELECT id, intent FROM {v('samples')} WHERE contains(lower(intent), 'ered')
        OR contains(lower(sample_text), 'ered')""",
    "constraint_violations": f"""SELECT source, row_id, violation FROM (
        SELECT 'rules' AS source, id AS row_id, unnest([
          CASE WHEN trim(provider) = '' THEN 'provider required' END,
          CASE WHEN NOT regexp_matches(CASE WHEN regexp_matches(trim(url), '^(?i)https?://') THEN url ELSE 'http://' || trim(url) END, '^https?://\\S+$') THEN 'url format' END,
          CASE WHEN NOT regexp_matches(CASE WHEN regexp_matches(trim(fallback_url), '^(?i)https?://') THEN fallback_url ELSE 'http://' || trim(fallback_url) END, '^https?://\\S+$') THEN 'fallback_url format' END,
          CASE WHEN length(fallback_url) > 255 THEN 'fallback_url max 255' END,
          CASE WHEN length(fallback_api_key_env) > 512 THEN 'fallback_api_key_env max 512' END,
          CASE WHEN weight < 0 THEN 'weight min 0' END]) AS violation FROM {v('rule_table')}
        UNION ALL SELECT 'alerts', id, unnest([CASE WHEN type IS NULL THEN 'type required' END,
          CASE WHEN type NOT IN ('failover', 'low_budget') THEN 'type values' END]) FROM {v('alert_requests')}
        UNION ALL SELECT 'compressor', id, unnest([CASE WHEN method = 'zip' THEN 'method values' END,
          CASE WHEN ratio NOT BETWEEN 0.01 AND 1 THEN 'ratio range' END,
          CASE WHEN caveman_intensity = 'max' THEN 'caveman_intensity values' END]) FROM {v('compressor_settings')}
        UNION ALL SELECT 'rephrase', id, unnest([CASE WHEN provider = 'other' THEN 'provider values' END,
          CASE WHEN trim(model) = '' THEN 'model required' END]) FROM {v('rephrase_settings')}
        UNION ALL SELECT 'keys', id, unnest([CASE WHEN name IS NULL THEN 'name required' END]) FROM {v('api_keys')}
        UNION ALL SELECT 'samples', id, unnest([
          CASE WHEN coalesce(trim(sample_text), '') = '' THEN 'sample_text required' END,
          CASE WHEN length(sample_text) > 1000 THEN 'sample_text max 1000' END]) FROM {v('samples')})
        WHERE violation IS NOT NULL""",
    "cache_fill_rows": f"""SELECT request_id, sha256(d.text) AS cache_key, answer AS response,
        CAST(floor(epoch(ts)) AS BIGINT) AS saved_at, CAST(floor(epoch(ts)) AS BIGINT) + {TTL} AS expires_at
        FROM (SELECT *, logged_intent AS intent FROM {v('requests')}) r JOIN {v('outcomes')} o USING (request_id)
        JOIN documents d USING (doc_id) WHERE logged_intent <> 'cached' AND NOT failed""",
    "logs_by_key": f"""SELECT api_key_id, any_value(name) AS name, any_value(status) AS status, count(*) AS requests,
        CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
        FROM {LOGS} l LEFT JOIN {KEYS} k ON CAST(k.id AS VARCHAR) = l.api_key_id GROUP BY api_key_id""",
    "price_lookup": f"""SELECT l.id, model, CAST(coalesce(p.input_price_per_token, {listed(1)}) AS DOUBLE) AS rate_in,
        CAST(coalesce(p.output_price_per_token, {listed(2)}) AS DOUBLE) AS rate_out,
        CASE WHEN p.model_name IS NOT NULL THEN 'exact'
             WHEN {" OR ".join(f"contains(model, {q(p[0])})" for p in fixed.DEFAULT_PRICES)} THEN 'listed'
             ELSE 'generic' END AS price_source
        FROM {v('token_logs')} l LEFT JOIN {v('model_prices')} p ON p.model_name = l.model""",
    "key_auth": f"""SELECT request_id, k.id AS key_id, k.name AS key_name, k.status = 'active' AS active
        FROM {v('requests')} r LEFT JOIN {KEYS} k
        ON auth_header LIKE 'Bearer %' AND k.key_hash = sha256(split_part(auth_header, ' ', 2))""",
    "cache_miss_requests": f"""SELECT request_id, requested_model FROM {v('requests')} WHERE request_id NOT IN
        (SELECT event_id FROM events WHERE event_type = 'error')""",
    "dangling_rule_refs": f"""SELECT key_id, rule_id FROM (SELECT id AS key_id, unnest(allowed_rules) AS rule_id
        FROM {KEYS}) WHERE rule_id NOT IN (SELECT id FROM {RULES})""",
    "summary_metrics": f"""SELECT count(*) AS total_requests, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
        CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
        CAST(sum(total_tokens) AS BIGINT) AS total_tokens_used,
        round(CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms), 2) AS avg_latency_ms,
        CAST(round(sum(cost_usd), 6) AS DOUBLE) AS total_cost_usd FROM {LOGS}""",
    "by_intent": f"SELECT intent, count(*) AS count FROM {LOGS} GROUP BY intent",
    "by_model": f"""SELECT model, count(*) AS count, CAST(sum(total_tokens) AS BIGINT) AS tokens
        FROM {LOGS} GROUP BY model""",
    "key_spend": f"""SELECT CAST(k.id AS VARCHAR) AS api_key_id, CAST(coalesce(s, 0) AS DOUBLE) AS spent,
        CAST(total_budget - coalesce(s4, 0) AS DOUBLE) AS durable_balance,
        CAST(greatest(total_budget - coalesce(s, 0), 0) AS DOUBLE) AS live_balance
        FROM {KEYS} k LEFT JOIN (SELECT api_key_id, sum({SPEND}) AS s, sum({SPEND4}) AS s4 FROM {LOGS} GROUP BY api_key_id) l
        ON l.api_key_id = CAST(k.id AS VARCHAR)""",
    "intent_pivot": f"""SELECT {", ".join(f"count(*) FILTER (intent = {q(i)}) AS {i}" for i in fixed.INTENTS)} FROM {LOGS}""",
    "route_weights": f"""SELECT id, CAST(sum(weight) OVER w AS BIGINT) AS total_weight,
        round(weight::DOUBLE / sum(weight) OVER w, 9) AS share FROM {RULE_TABLE} WINDOW w AS (PARTITION BY intent)""",
    "cache_hit_rate": f"""SELECT count(*) FILTER (model = 'semantic-cache') AS hits, count(*) AS requests,
        round(avg(CASE WHEN model = 'semantic-cache' THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM {LOGS}""",
    "models_per_key": f"""WITH served AS (SELECT id AS rule_id, model FROM {RULES} UNION ALL
          SELECT id, fallback_model FROM {RULES} WHERE fallback_model <> ''),
        found AS (SELECT DISTINCT k.id, s.model FROM {KEYS} k JOIN served s
          ON k.allowed_rules IS NULL OR list_contains(k.allowed_rules, s.rule_id)),
        all_models AS (SELECT * FROM found UNION ALL SELECT id, unnest([{", ".join(map(q, fixed.DEFAULT_MODELS))}])
          FROM {KEYS} WHERE id NOT IN (SELECT id FROM found))
        SELECT id, model, CASE WHEN contains(model, 'gemini') THEN 'google' WHEN contains(model, 'claude')
          THEN 'anthropic' ELSE 'openai' END AS owned_by FROM all_models""",
    "stream_fold": f"""SELECT conv_id * 1000 + turn AS msg_id, text,
        CASE WHEN turn % 2 = 1 AND length(text) > 0 THEN length(text) ELSE 1 END AS prompt_tokens,
        CASE WHEN conv_id % 2 = 0 AND length(text) > 0 THEN length(text) ELSE {tokens('text')} END AS completion_tokens,
        {pick("conv_id % 3", ["stop", "length", "tool_use"])} AS finish_reason, true AS finished
        FROM conversations WHERE role = 'assistant'""",
    "label_distribution": f"SELECT intent, count(*) AS samples FROM {v('samples')} GROUP BY intent",
    "monthly_reset": f"""SELECT id, budget_type = 'monthly' AS reset, CAST(CASE WHEN budget_type = 'monthly'
        THEN total_budget ELSE remaining_budget END AS DOUBLE) AS remaining_budget FROM {KEYS}""",
    "unique_violations": f"""SELECT 'rules' AS source, intent || '/' || model AS value, count(*) AS copies
          FROM {v('rule_table')} GROUP BY intent, model HAVING count(*) > 1
        UNION ALL SELECT 'prices', model_name, count(*) FROM {v('price_feed')} GROUP BY model_name HAVING count(*) > 1
        UNION ALL SELECT 'keys', key_hash, count(*) FROM {v('api_keys')} GROUP BY key_hash HAVING count(*) > 1""",
    "rate_limit": f"""SELECT request_id, nth, nth > 2 AS limited FROM (SELECT request_id, row_number() OVER
        (PARTITION BY api_key_id, {DAY} ORDER BY ts, request_id) AS nth FROM {v('requests')})""",
    "rate_limit_default": f"""SELECT request_id, nth, nth > 60 AS limited FROM (SELECT request_id, row_number() OVER
        (PARTITION BY api_key_id, floor(epoch(ts) / 60) ORDER BY ts, request_id) AS nth FROM {v('requests')})""",
    "fifo_batches": """SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 100) AS BIGINT)
        AS batch FROM events""",
    "recent_logs": f"""SELECT id, api_key_id, intent, model, total_tokens, latency_ms, CAST(cost_usd AS DOUBLE) AS cost_usd,
        strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM {LOGS} ORDER BY id DESC LIMIT 10""",
    "samples_recent": f"SELECT id, intent, updated_at FROM {v('samples')}",
    "keyword_set": """SELECT DISTINCT w AS keyword FROM (SELECT trim(p_name) AS w FROM part UNION ALL
        SELECT trim(text) FROM benchmark)
        WHERE w <> '' AND w NOT IN (SELECT p_name FROM part WHERE p_size = 7)""",
    "cache_latest": f"""SELECT cache_key, saved_at, request_id FROM (SELECT sha256(CAST(doc_id AS VARCHAR)) AS cache_key,
        epoch_us(ts) AS saved_at, request_id, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, request_id DESC)
        AS n FROM {v('requests')}) WHERE n = 1""",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM {PROMPTS}",
    "normalise_prompt": f"""SELECT doc_id, sha256({strip("lower(replace(text, chr(10), ' '))")}) AS memo_key
        FROM {PROMPTS}""",
    "score_gate": "SELECT event_id, 1 / (1 + exp(-(value / 10 - 1))) >= 0.85 AS accepted FROM events",
    "ttl_by_intent": f"SELECT id, CAST({TTL} AS BIGINT) AS ttl FROM {v('token_logs')}",
    "model_name_parse": f"""SELECT id, CASE WHEN contains(split_part(name, ':', 1), '/') THEN split_part(name, ':', 1)
        ELSE 'library/' || split_part(name, ':', 1) END AS path,
        CASE WHEN contains(name, ':') THEN regexp_replace(name, '^[^:]*:', '') ELSE 'latest' END AS tag
        FROM {v('local_models')}""",
    "request_cost": f"SELECT id, CAST(cost_usd AS DOUBLE) AS cost_usd FROM {LOGS}",
    "url_scheme": f"""SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://') THEN url
        ELSE 'http://' || trim(url) END AS url FROM (
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ' || replace(url, 'http://', '')
        ELSE upper(url) END AS url FROM pages UNION ALL SELECT -id - 1, url FROM {v('rule_table')})""",
    "alert_text": f"""SELECT id, '⚠️ *Gateway Alert: Budget Threshold Warning* ⚠️' || chr(10) || '• *API Key*: `' || name
        || '`' || chr(10) || '• *Remaining Balance*: `$' || format('{{:,.4f}}', CAST(remaining_budget * 12345 AS DOUBLE))
        || '`' || chr(10) || '• *Total Allocated Budget*: `$' || format('{{:,.4f}}', CAST(total_budget AS DOUBLE))
        || '`' || chr(10) || '• *Status*: Remaining budget has dropped below 10%. Please top up.' AS message
        FROM {KEYS} WHERE {LOW} < 0.1""",
    "threshold_band": """SELECT event_id, CASE WHEN value / 100 <= 0.12 THEN 'Very strict (identical wording)'
        WHEN value / 100 <= 0.22 THEN 'Moderately strict (minor variations)'
        WHEN value / 100 <= 0.32 THEN 'Recommended / Tolerant (synonymous)'
        ELSE 'Very tolerant (risk of false matches)' END AS band FROM events""",
}

# --------------------------------------------------------------------------------------- verdicts
def verdicts(requests: str) -> str:
    """requests: request_id, ts, auth_header, cost_usd -> plus key_id, status, verdict."""
    return f"""(WITH c AS (SELECT r.*, CASE WHEN auth_header LIKE 'Bearer %' THEN split_part(auth_header, ' ', 2) END AS token
          FROM {requests} r),
        n AS (SELECT c.*, k.id AS key_id, k.status AS key_status, k.total_budget,
          CASE WHEN k.budget_type = 'monthly' THEN strftime(ts, '%Y-%m') ELSE '' END AS month,
          row_number() OVER (PARTITION BY token, {DAY} ORDER BY ts, request_id) AS nth
          FROM c LEFT JOIN {KEYS} k ON k.key_hash = sha256(token)),
        e AS (SELECT n.*, CASE WHEN token IS NULL THEN 'malformed' WHEN nth > 2 THEN 'limited'
          WHEN key_id IS NULL THEN 'unknown' WHEN key_status = 'inactive' THEN 'inactive' END AS early FROM n),
        s AS (SELECT e.*, coalesce(sum(CASE WHEN early IS NULL THEN cost_usd ELSE 0 END) OVER (PARTITION BY token, month
          ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e),
        f AS (SELECT s.*, coalesce(early, CASE WHEN total_budget - spent <= 0 THEN 'spent' ELSE 'ok' END) AS verdict FROM s)
        SELECT f.*, CASE verdict WHEN 'ok' THEN 200 WHEN 'limited' THEN 429 WHEN 'spent' THEN 402 ELSE 401 END AS status
        FROM f)"""


ORACLES["request_verdict"] = f"""SELECT request_id, key_id, status, verdict FROM
    {verdicts(f"(SELECT r.*, l.cost_usd FROM {v('requests')} r JOIN {LOGS} l ON l.id = r.request_id)")}"""

ORACLES["build_log_rows"] = f"""SELECT request_id, CASE WHEN hit THEN 'cached' ELSE intent END AS intent,
    CASE WHEN hit THEN 'semantic-cache' ELSE model END AS model, CASE WHEN hit THEN 0 ELSE prompt_tokens END AS prompt_tokens,
    CASE WHEN hit THEN 0 ELSE completion_tokens END AS completion_tokens,
    CASE WHEN hit THEN 0 ELSE total_tokens END AS total_tokens, latency_ms,
    CASE WHEN hit THEN 0 ELSE CAST(cost_usd AS DOUBLE) END AS cost_usd
    FROM {priced(f'''(SELECT request_id, logged_intent AS intent, logged_intent = 'cached' AS hit, requested_model AS model,
      prompt_tokens, completion_tokens, latency_ms FROM {v('requests')} JOIN {v('outcomes')} USING (request_id))''')}"""

# ------------------------------------------------------------------------------------------- texts
BYPASS = (
    f"(?i)[,;:\\-{WS}]*[(\\[{{\\-]*[{WS}]*(?:"
    + "|".join(("" if p[0] == "/" else "\\b") + p + "\\b" for p in fixed.BYPASS_PHRASES)
    + f")[{WS}]*[)\\]}}]*[,;:!?.\\-{WS}]*"
)


def unwished(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({x}, '{BYPASS}', '', 'g'), '[{WS}]+', ' ', 'g')")


ORACLES["cache_bypass"] = f"""SELECT doc_id, regexp_matches(text, '{BYPASS}') AS bypass,
    CASE WHEN regexp_matches(text, '{BYPASS}') AND {unwished('text')} <> '' THEN {unwished('text')} ELSE text END AS text
    FROM {PROMPTS}"""


def terminal(x: str) -> str:
    for pattern in ("\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])", f"\\[[=#>-]+[ ]*\\][{WS}]*[\\p{{Nd}}]+%[{WS}]*",
                    "[\\p{Nd}]+%[" + WS + "]*\\|[█░ 🮆 ]*\\|"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def collapsed(rows: str) -> str:
    """(doc_id, text) -> (doc_id, compressed)."""
    return f"""(WITH src AS (SELECT doc_id, string_split_regex({terminal('text')}, '\\r\\n|[{LINE_END}]') AS l FROM {rows}),
      numbered AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, unnest(range(len(l))) AS i FROM src),
      lines AS (SELECT doc_id, i, line, NOT regexp_matches(line, '[^{WS}]') AS blank FROM numbered
        WHERE NOT (i = n - 1 AND line = '')),
      kept AS (SELECT * FROM lines WHERE blank OR NOT (regexp_matches(line, '::[{WORD}]+ PASSED')
        OR (line LIKE 'test %' AND line LIKE '% ... ok') OR line LIKE 'Resolved %' OR line LIKE 'Fetch %'
        OR line LIKE 'Downloading %')),
      prev AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM kept WHERE NOT blank),
      runs AS (SELECT *, sum(CASE WHEN line IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM prev),
      heads AS (SELECT doc_id, run, min(i) AS i, any_value(line) AS line, count(*) AS n FROM runs GROUP BY doc_id, run),
      nexts AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY run) AS ni FROM heads),
      pieces AS (SELECT doc_id, i * 2 AS pos, line FROM kept WHERE blank UNION ALL SELECT doc_id, i * 2, line FROM heads
        UNION ALL SELECT doc_id, coalesce(ni * 2 - 1, 1000000000), '... [repeated ' || (n - 1) || ' more times] ...'
        FROM nexts WHERE n > 1)
      SELECT s.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS compressed
      FROM src s LEFT JOIN pieces USING (doc_id) GROUP BY s.doc_id)"""


def telegraphic(x: str, level: str) -> str:
    """Words are framed by marks first, as this engine knows no look-around."""
    a, b = "chr(1)", "chr(2)"
    frame = lambda p: "chr(1) || '" + p.replace(" ", "' || chr(2) || ' ' || chr(1) || '") + "' || chr(2)"
    x = f"regexp_replace({x}, '([{WORD}]+)', {a} || '\\1' || {b}, 'g')"
    for p in fixed.PLEASANTRIES:
        x = f"regexp_replace({x}, {frame(p)} || '[!,.:;?]*', '', 'gi')"
    x = strip(f"regexp_replace({x}, ' +', ' ', 'g')")
    x = strip(f"regexp_replace({x}, '^[!,.;? ]+', '')")
    unframe = lambda y: f"replace(replace({y}, {a}, ''), {b}, '')"
    if level == "lite":
        return unframe(strip(f"regexp_replace({x}, '\\n+', chr(10), 'g')"))
    drop = fixed.ARTICLES + fixed.AUXILIARIES + (fixed.PREPOSITIONS_PRONOUNS if level == "ultra" else [])
    x = f"regexp_replace({x}, {a} || '(?:{alternatives(drop)})' || {b}, '', 'gi')"
    x = f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), ' +([?.!,;])', '\\1', 'g')"
    lines = f"list_transform(string_split_regex({x}, '\\r\\n|[{LINE_END}]'), lambda y: {strip('y')})"
    return unframe(f"array_to_string(list_filter({lines}, lambda y: y <> ''), chr(10))")


ORACLES["strip_terminal"] = f"SELECT doc_id, {terminal('text')} AS text FROM {PROMPTS}"
ORACLES["collapse_lines"] = f"SELECT * FROM {collapsed(PROMPTS)}"
for _name, _level in (("caveman_lite", "lite"), ("caveman", "full"), ("caveman_ultra", "ultra")):
    ORACLES[_name] = f"SELECT doc_id, {telegraphic('text', _level)} AS text FROM {PROMPTS}"
ORACLES["compress_stacked"] = f"""SELECT doc_id, 'stacked_ultra' AS method, original_tokens, compressed_tokens,
    round(compressed_tokens::DOUBLE / original_tokens, 9) AS ratio, compressed_text FROM (
    SELECT *, {tokens('text')} AS original_tokens, {tokens('compressed_text')} AS compressed_tokens FROM (
    SELECT doc_id, p.text, {telegraphic('c.compressed', 'ultra')} AS compressed_text
    FROM {PROMPTS} p JOIN {collapsed(PROMPTS)} c USING (doc_id)))"""
_MARKS = "[?!.:\\-\\n]"


def budgeted(rows: str) -> str:
    """(doc_id, text) -> doc_id, compressed_text, tokens, kept: the rarest tokens of each text, in their order."""
    return f"""(WITH t AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p, len(l) AS n FROM (
      SELECT doc_id, regexp_extract_all(text, '[^{WS}?!.:\\-]+|{_MARKS}') AS l FROM {rows})),
    f AS (SELECT w, count(DISTINCT doc_id) AS df FROM t WHERE NOT regexp_matches(w, '^{_MARKS}$') GROUP BY w),
    r AS (SELECT t.*, df, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 0), p) AS r FROM t LEFT JOIN f USING (w)),
    k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS compressed_text, max(n) AS tokens, count(*) AS kept FROM r
      WHERE df IS NULL OR r <= ceil(n * 0.7::DOUBLE) GROUP BY doc_id)
    SELECT p.doc_id, coalesce(compressed_text, '') AS compressed_text, coalesce(tokens, 0) AS tokens, coalesce(kept, 0) AS kept
    FROM {rows} p LEFT JOIN k USING (doc_id))"""


ORACLES["compress_budgeted"] = f"SELECT * FROM {budgeted(PROMPTS)}"
_TOO_SHORT = f"(length(text) < 150 OR {words('text')} < 30)"
ORACLES["compression_report"] = f"""WITH p AS MATERIALIZED (SELECT doc_id, text, {_TOO_SHORT} AS short FROM {PROMPTS}),
    c AS MATERIALIZED (SELECT doc_id, compressed FROM {collapsed(PROMPTS)}),
    one AS MATERIALIZED (SELECT * FROM {budgeted("(SELECT doc_id, text FROM p WHERE NOT short)")}),
    two AS MATERIALIZED (SELECT * FROM {budgeted("(SELECT doc_id, compressed AS text FROM p JOIN c USING (doc_id) WHERE NOT short)")}),
    r AS (SELECT 'rtk' AS method, NULL AS reason, text, compressed AS small FROM p JOIN c USING (doc_id)
      UNION ALL SELECT 'disabled', 'Compression disabled', text, text FROM p
      UNION ALL SELECT 'llmlingua', 'Compressor not loaded', text, text FROM p
      UNION ALL SELECT 'caveman_full', NULL, text, {telegraphic('text', 'full')} FROM p
      UNION ALL SELECT 'stacked_full', NULL, text, {telegraphic('compressed', 'full')} FROM p JOIN c USING (doc_id)
      UNION ALL SELECT 'llmlingua', CASE WHEN short THEN 'Prompt too short for compression' END, text,
        CASE WHEN short THEN text ELSE compressed_text END FROM p LEFT JOIN one USING (doc_id)
      UNION ALL SELECT 'rtk+llmlingua', CASE WHEN short THEN 'Prompt too short for compression' END, text,
        CASE WHEN short THEN text ELSE compressed_text END FROM p LEFT JOIN two USING (doc_id))
    SELECT method, reason, count(*) AS prompts, count(reason) AS bypassed, CAST(sum({tokens('text')}) AS BIGINT) AS original_tokens,
      CAST(sum({tokens('small')}) AS BIGINT) AS compressed_tokens,
      round(avg(({tokens('small')})::DOUBLE / ({tokens('text')})), 6) AS mean_ratio FROM r GROUP BY method, reason"""
ORACLES["model_label"] = f"""WITH a AS (SELECT DISTINCT model FROM {v('token_logs')} UNION SELECT DISTINCT model_name
      FROM ALIASED),
    s AS (SELECT model, regexp_replace(regexp_replace(model, '[-_][0-9]{{4,8}}', '', 'g'), '[-_][0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}',
      '', 'g') AS x FROM a),
    t AS (SELECT model, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(x, '-latest', ''), ':latest', ''), 'claude-3-5-sonnet', 'claude-3.5'), 'gemini-3\\.5-flash', 'gemini-3.5-f'),
      'gemini-1\\.5-flash', 'gemini-1.5-f'), 'gemini-1\\.5-pro', 'gemini-1.5-p'), 'gpt-4o-mini', 'gpt-4o-m') AS x FROM s)
    SELECT model, CASE WHEN model = 'semantic-cache' THEN 'cache' WHEN length(x) > 12 THEN left(x, 11) || '…' ELSE x END AS label
    FROM t"""

# ------------------------------------------------------------------------------------------ prices
_ALIASES = ", ".join(f"({q(c)}, {i + 1}, {q(a)})" for c, names in fixed.PRICE_ALIASES for i, a in enumerate(names))
ALIASED = f"""(SELECT seq, step, coalesce(alias, model_name) AS model_name,
    CASE WHEN contains(model_name, '/') THEN split_part(model_name, '/', 1) ELSE 'unknown' END AS provider,
    input_price, output_price FROM (
      SELECT f.*, 0 AS step, NULL AS alias FROM {v('price_feed')} f UNION ALL
      SELECT f.*, a.step, a.alias FROM {v('price_feed')} f JOIN (VALUES {_ALIASES}) AS a(catalogue_id, step, alias)
      ON a.catalogue_id = f.model_name))"""
ORACLES["model_label"] = ORACLES["model_label"].replace("ALIASED", ALIASED)
ORACLES["price_alias_expand"] = f"""SELECT seq, step, model_name, provider, CAST(input_price AS DOUBLE) AS input_price
    FROM {ALIASED}"""
ORACLES["price_upsert"] = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY seq DESC, step DESC) AS r
      FROM {ALIASED})
    SELECT coalesce(n.model_name, b.model_name) AS model_name, coalesce(n.provider, b.provider) AS provider,
      CAST(coalesce(n.input_price, b.input_price) AS DOUBLE) AS input_price,
      CAST(coalesce(n.output_price, b.output_price) AS DOUBLE) AS output_price, b.model_name IS NULL AS inserted
    FROM (SELECT * FROM n WHERE r = 1) n FULL JOIN {v('price_base')} b ON b.model_name = n.model_name"""

# ----------------------------------------------------------------------------------------- budgets
CHARGES = f"(SELECT id AS request_id, api_key_id, created_at AS ts, cost_usd FROM {LOGS})"


def balances(spend: str, group: str = "c.api_key_id") -> str:
    w = f"(PARTITION BY {group} ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND "
    return f"""(SELECT c.*, total_budget, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS tokyo, budget_type,
      total_budget - coalesce(sum({spend}) OVER {w} 1 PRECEDING), 0) AS before,
      total_budget - sum({spend}) OVER {w} CURRENT ROW) AS after
      FROM {CHARGES} c LEFT JOIN {KEYS} k ON CAST(k.id AS VARCHAR) = c.api_key_id)"""


ORACLES["running_budget"] = f"""SELECT request_id, CAST(greatest(before, 0) AS DOUBLE) AS balance_before,
    before <= 0 AS refused FROM {balances(SPEND)}"""
ORACLES["running_budget_durable"] = f"""SELECT request_id, CAST(before AS DOUBLE) AS balance_before,
    before <= 0 AS refused FROM {balances(SPEND4)}"""
_MONTH = "CASE WHEN budget_type = 'monthly' THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m') ELSE '' END"
ORACLES["running_budget_monthly"] = f"""SELECT request_id, CASE WHEN budget_type = 'monthly' THEN tokyo ELSE '' END AS budget_month,
    CAST(greatest(before, 0) AS DOUBLE) AS balance_before, before <= 0 AS refused
    FROM {balances(SPEND, f"c.api_key_id, {_MONTH}")}"""


def fired(rows: str, ttl: str) -> str:
    """(k, ts, id, ttl micros) -> all rows with ``fires``; walks each key row by row."""
    return f"""(WITH RECURSIVE n AS (SELECT k, epoch_us(ts) AS t, id, CAST({ttl} AS BIGINT) * 1000000 AS ttl,
        row_number() OVER (PARTITION BY k ORDER BY ts, id) AS rn FROM {rows}),
      walk AS (SELECT k, id, rn, t AS last, true AS fires FROM n WHERE rn = 1 UNION ALL
        SELECT n.k, n.id, n.rn, CASE WHEN n.t >= w.last + n.ttl THEN n.t ELSE w.last END, n.t >= w.last + n.ttl
        FROM walk w JOIN n ON n.k = w.k AND n.rn = w.rn + 1)
      SELECT k, id, fires FROM walk)"""


ORACLES["low_budget_alerts"] = f"""WITH low AS (SELECT *, greatest(after, 0) AS balance_after FROM {balances(SPEND)}
      WHERE cost_usd > 0 AND greatest(after, 0) / total_budget < 0.1),
    f AS (SELECT * FROM {fired("(SELECT api_key_id AS k, ts, request_id AS id FROM low)", "3600")})
    SELECT request_id, api_key_id, CAST(balance_after AS DOUBLE) AS balance_after FROM low JOIN f ON f.id = request_id WHERE fires"""
ORACLES["greedy_ttl"] = f"""SELECT k AS event_type, id AS event_id FROM
    {fired("(SELECT event_type AS k, ts, event_id AS id FROM events)", "3600")} WHERE fires"""
_REPLAY = f"""(SELECT doc_id AS k, ts, request_id AS id, {pick("doc_id % 4", fixed.INTENTS)} AS intent FROM {v('requests')})"""
ORACLES["cache_ttl_replay"] = f"SELECT id AS request_id, NOT fires AS hit FROM {fired(_REPLAY, TTL)}"
ORACLES["budget_adjust"] = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY change_id) AS rn
      FROM {v('budget_changes')}),
    walk AS (SELECT id, CAST(total_budget AS DECIMAL(12,4)) AS total, CAST(remaining_budget AS DECIMAL(12,4)) AS remaining, status,
        budget_type, 0 AS rn FROM {KEYS} UNION ALL
      SELECT w.id, CAST(coalesce(c.total_budget, w.total) AS DECIMAL(12,4)),
        CAST(CASE WHEN c.remaining_budget IS NOT NULL THEN c.remaining_budget
             WHEN c.total_budget IS NOT NULL THEN greatest(0, w.remaining + (c.total_budget - w.total))
             ELSE w.remaining END AS DECIMAL(12,4)),
        coalesce(c.status, w.status), coalesce(c.budget_type, w.budget_type), w.rn + 1
      FROM walk w JOIN c ON c.key_id = w.id AND c.rn = w.rn + 1)
    SELECT id, CAST(total AS DOUBLE) AS total_budget, CAST(remaining AS DOUBLE) AS remaining_budget, status, budget_type, rn AS changes
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS last FROM walk) WHERE last = 1"""

# ----------------------------------------------------------------------------------------- changes
# a walk in order of the changes, one per intent at a time, as a rule's changes all name one intent here
ORACLES["rule_changes"] = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY change_id) AS rn
      FROM {v('rule_changes')}),
    walk(id, intent, model, weight, gone, rn) USING KEY (id) AS (
      SELECT id, intent, model, CAST(weight AS INT), false, CAST(0 AS BIGINT) FROM {RULE_TABLE}
      UNION SELECT -ord, intent, NULL, NULL, true, 0 FROM (SELECT intent, row_number() OVER () AS ord FROM (SELECT DISTINCT intent FROM c))
      UNION SELECT unnest([step.id, CASE WHEN taken IS NULL THEN c.rule_id END]), c.intent, unnest([NULL, c.model]),
        unnest([NULL, c.weight]), unnest([true, c.op = 'delete']), c.rn
      FROM walk step JOIN c ON c.intent = step.intent AND c.rn = step.rn + 1
      LEFT JOIN (SELECT intent, model, id AS taken FROM recurring.walk WHERE NOT gone AND id >= 0) w
        ON c.op <> 'delete' AND w.intent = c.intent AND w.model = c.model AND w.taken <> c.rule_id
      WHERE step.id < 0)
    SELECT id, intent, model, weight FROM walk WHERE NOT gone AND id IS NOT NULL"""
ORACLES["sample_changes"] = f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY change_id DESC)
      AS r FROM {v('sample_changes')}) WHERE r = 1)
    SELECT id, intent, sample_text FROM {v('samples')} WHERE id NOT IN (SELECT sample_id FROM n) UNION ALL
    SELECT sample_id, intent, sample_text FROM n WHERE op <> 'delete'"""

# ----------------------------------------------------------------------------------------- routing
SCOPED = f"""(SELECT r.*, logged_intent AS intent, k.allowed_rules FROM {v('requests')} r JOIN {KEYS} k ON k.id = r.key_number)"""
_MAY = "(allowed_rules IS NULL OR list_contains(allowed_rules, u.id))"


def candidates(rows: str) -> str:
    """(request_id, kind, id, ...) with kind model, own or general, after the access list."""
    return f"""(SELECT r.request_id, r.intent, 'model' AS kind, u.* EXCLUDE (intent) FROM {rows} r JOIN {RULES} u
        ON (u.model = r.requested_model OR u.fallback_model = r.requested_model) AND {_MAY}
      UNION ALL SELECT r.request_id, r.intent, 'own', u.* EXCLUDE (intent) FROM {rows} r JOIN {RULES} u
        ON u.intent = r.intent AND {_MAY}
      UNION ALL SELECT r.request_id, r.intent, 'general', u.* EXCLUDE (intent) FROM {rows} r JOIN {RULES} u
        ON u.intent = 'general' AND {_MAY})"""


def routed(rows: str) -> str:
    """One row per request: routed_by and the picked rule's columns (null when refused)."""
    return f"""(WITH c AS (SELECT * FROM {candidates(rows)}),
      best AS (SELECT request_id, min(CASE WHEN kind = 'model' AND intent <> 'code' THEN 1 WHEN kind = 'own' THEN 2
        WHEN kind = 'general' THEN 3 END) AS best FROM c GROUP BY request_id),
      chosen AS (SELECT c.*, best FROM c JOIN best USING (request_id)
        WHERE (best = 1 AND kind = 'model') OR (best = 2 AND kind = 'own') OR (best = 3 AND kind = 'general')),
      w AS (SELECT *, sum(weight) OVER (PARTITION BY request_id ORDER BY id) AS upto,
        (request_id % 2147483648) * 2654435761 % CAST(sum(weight) OVER (PARTITION BY request_id) AS BIGINT) + 1 AS draw FROM chosen),
      picked AS (SELECT * FROM w WHERE upto >= draw AND upto - weight < draw)
      SELECT r.request_id, CASE WHEN p.id IS NULL THEN 'refused' WHEN best = 1 THEN 'model' ELSE 'intent' END AS routed_by,
        r.intent, p.* EXCLUDE (request_id, intent) FROM {rows} r LEFT JOIN picked p ON p.request_id = r.request_id)"""


ORACLES["rules_for_intent"] = f"""WITH c AS (SELECT request_id, kind, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
      FROM {candidates(SCOPED)} WHERE kind <> 'model' GROUP BY request_id, kind)
    SELECT r.request_id, coalesce(o.ids, g.ids, '') AS candidates FROM {SCOPED} r
    LEFT JOIN c o ON o.request_id = r.request_id AND o.kind = 'own'
    LEFT JOIN c g ON g.request_id = r.request_id AND g.kind = 'general'"""
ORACLES["requested_model"] = f"""SELECT r.request_id, coalesce(ids, '') AS candidates, weight FROM {SCOPED} r LEFT JOIN (
      SELECT request_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, CAST(sum(weight) AS BIGINT) AS weight
      FROM {candidates(SCOPED)} WHERE kind = 'model' GROUP BY request_id) c ON c.request_id = r.request_id"""
ORACLES["weighted_route"] = f"SELECT request_id, routed_by, id AS rule_id, model FROM {routed(SCOPED)}"


def answered(rows: str) -> str:
    return f"""(SELECT r.*, o.* EXCLUDE (request_id), CASE WHEN NOT failed THEN 'ok' WHEN fallback_model IS NOT NULL
        THEN 'failed_over' ELSE 'failed' END AS outcome,
      CASE WHEN failed AND fallback_model IS NOT NULL THEN fallback_model ELSE model END AS final_model,
      CASE WHEN failed AND fallback_model IS NOT NULL THEN fallback_provider ELSE provider END AS final_provider
      FROM {routed(rows)} r JOIN {v('outcomes')} o USING (request_id) WHERE routed_by <> 'refused')"""


ORACLES["failover_pairs"] = f"""SELECT request_id, outcome AS status, final_model, final_provider FROM {answered(SCOPED)}"""
ORACLES["failover_alerts"] = f"""SELECT request_id, 'failover' AS type,
    '🚨 **Gateway Alert: Downstream Failover** 🚨' || chr(10) || '• **Intent Category**: `' || intent || '`' || chr(10)
    || '• **Failed Model**: `' || model || '`' || chr(10) || '• **Failover Target**: `' || fallback_model || '`' || chr(10)
    || '• **Error Trigger**: `' || error || '`' || chr(10)
    || '• **Status**: Request automatically routed to backup model.' AS message
    FROM {answered(SCOPED)} WHERE outcome = 'failed_over'"""

# -------------------------------------------------------------------------------------- similarity
def nearest(queries: str, entries: str, k: int, radius: float) -> str:
    dist = "round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9)"
    return f"""(SELECT * FROM (SELECT query_id, entry_id, {dist} AS dist, row_number() OVER (PARTITION BY query_id
      ORDER BY {dist}, entry_id) AS nth FROM {queries} q, {entries} e) WHERE nth <= {k} AND dist <= {radius})"""


_DIGITS = "list_sort(list_distinct(regexp_extract_all({}.prompt, '[\\p{{Nd}}]+')))"
_TOGGLES = (
    "list_sort(list_distinct(list_filter(regexp_extract_all(lower({}.prompt), '[a-z]+'), lambda w: w IN ("
    + ", ".join(map(q, fixed.TOGGLE_WORDS)) + "))))"
)
ACCEPTED = f"""(SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS place FROM
    {nearest(v('lookups'), v('cache_entries'), 3, 2 * THRESHOLD)} n JOIN {v('lookups')} l USING (query_id)
    JOIN {v('cache_entries')} c USING (entry_id) WHERE {_DIGITS.format('l')} = {_DIGITS.format('c')}
    AND {_TOGGLES.format('l')} = {_TOGGLES.format('c')} AND 1 / (1 + exp(-(5.0 - 5.5 * dist))) >= 0.85)"""
ORACLES["semantic_lookup"] = f"SELECT query_id, entry_id, round(dist, 6) AS dist FROM {ACCEPTED} WHERE place = 1"
ORACLES["semantic_lookup_k1"] = f"""SELECT query_id, entry_id, round(dist, 6) AS dist
    FROM {nearest(v('lookups'), v('cache_entries'), 1, 0.6)}"""
ORACLES["guardrail_similarity"] = f"""SELECT query_id, entry_id AS pattern_id, round(dist, 6) AS dist FROM
    {nearest("(SELECT vec_id AS query_id, embedding FROM embeddings)",
             f"(SELECT pattern_id AS entry_id, embedding FROM {v('guardrail_patterns')})", 1, 0.35)} WHERE dist < 0.35"""
ORACLES["semantic_invalidate"] = f"""SELECT entry_id, length(prompt) AS chars FROM {v('cache_entries')} WHERE entry_id NOT IN
    (SELECT entry_id FROM {ACCEPTED} WHERE place = 1)"""

# ----------------------------------------------------------------------------------- conversations
ORACLES["merge_roles"] = f"""WITH s AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END AS r,
      CASE WHEN role IN ('user', 'assistant') THEN text ELSE '[' || role || ']: ' || text END AS t
      FROM {v('chat_turns')} WHERE role <> 'system'),
    b AS (SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS brk FROM s),
    g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS place FROM b)
    SELECT conv_id, place, r AS role, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, place, r
    UNION ALL SELECT conv_id, 0, 'system', string_agg(text, chr(10) ORDER BY turn) FROM {v('chat_turns')} WHERE role = 'system'
    GROUP BY conv_id"""

# --------------------------------------------------------------------------------------- whole way
_GUARD = ORACLES["guardrail_keywords"]
_WISH = ORACLES["cache_bypass"]
_FACTS = f"""(SELECT doc_id, b.blocked, w.bypass, sha256(w.text) AS cache_key,
    CASE WHEN i.is_code THEN 'code' ELSE 'general' END AS intent,
    {tokens(telegraphic('z.compressed', 'full'))} AS small
    FROM ({_GUARD}) b JOIN ({_WISH}) w USING (doc_id)
    JOIN (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w:
        w IN ({", ".join(map(q, fixed.CODE_WORDS))}) OR regexp_matches(w, '{alternatives(fixed.CODE_STEMS)}'))) > 0
        AS is_code FROM ({_WISH})) i USING (doc_id)
    JOIN {collapsed(f"({_WISH})")} z USING (doc_id))"""
# a walk through all requests in order of time: one row of state for each budget, each rate window and each cache key
_STEPS = f"""(SELECT row_number() OVER (ORDER BY r.ts, r.request_id) AS rn, r.request_id, epoch_us(r.ts) AS t, r.requested_model, r.ts,
      token, k.id AS key_id, k.status AS key_status, k.total_budget, k.user_id, k.allowed_rules, f.*,
      'b' || k.id || CASE WHEN k.budget_type = 'monthly' THEN strftime(r.ts, '%Y-%m') ELSE '' END AS budget,
      'r' || coalesce(token, '') || {DAY.replace('ts', 'r.ts')} AS minute
    FROM (SELECT *, CASE WHEN auth_header LIKE 'Bearer %' THEN split_part(auth_header, ' ', 2) END AS token FROM {v('requests')}) r
    LEFT JOIN {KEYS} k ON k.key_hash = sha256(token) JOIN {_FACTS} f USING (doc_id))"""
ORACLES["gateway_replay"] = f"""WITH RECURSIVE facts AS MATERIALIZED {_STEPS},
    done AS MATERIALIZED (SELECT a.*, m.small FROM {answered("(SELECT * FROM facts WHERE key_id IS NOT NULL)")} a
      JOIN facts m USING (request_id) WHERE outcome <> 'failed'),
    counted AS (SELECT request_id, intent, final_model AS model,
      CAST(CASE WHEN prompt_tokens > 0 THEN prompt_tokens ELSE small END AS INT) AS prompt_tokens,
      CAST(CASE WHEN completion_tokens > 0 THEN completion_tokens ELSE {tokens('answer')} END AS INT) AS completion_tokens FROM done),
    cost AS MATERIALIZED (SELECT * FROM {priced("counted")}),
    step AS MATERIALIZED (SELECT f.*, c.cost_usd, c.cost_usd IS NOT NULL AS answers, 'c' || cache_key AS place,
      CAST({TTL} AS BIGINT) * 1000000 AS ttl FROM (SELECT *, row_number() OVER (ORDER BY rn) AS n FROM facts
        WHERE key_status = 'active') f
      LEFT JOIN (SELECT request_id, cost_usd FROM cost) c USING (request_id)),
    nth AS MATERIALIZED (SELECT request_id, row_number() OVER (PARTITION BY minute ORDER BY rn) > 2 AS limited FROM facts WHERE token IS NOT NULL),
    walk(place, amount, last, n, verdict) USING KEY (place) AS (
      SELECT 'step', CAST(0 AS DECIMAL(38,12)), CAST(0 AS BIGINT), CAST(0 AS BIGINT), ''
      UNION SELECT unnest(['step', CASE WHEN charged THEN budget END, CASE WHEN saves OR drops THEN place END, 'q' || request_id]),
        unnest([0, spent + cost_usd, 0, 0]::DECIMAL(38,12)[]), unnest([0, 0, CASE WHEN saves THEN t ELSE -1000000000000000 END, 0]::BIGINT[]),
        unnest([n, 0, 0, n]), unnest(['', '', '', verdict])
      FROM (SELECT *, verdict = 'miss' AND answers AS saves, bypass AND verdict = 'miss' AS drops, verdict = 'miss' AND answers AS charged
        FROM (SELECT s.*, coalesce(b.amount, 0) AS spent, CASE WHEN l.limited THEN 'limited' WHEN total_budget - coalesce(b.amount, 0) <= 0 THEN 'spent'
            WHEN blocked THEN 'blocked' WHEN NOT bypass AND s.t < c.last + ttl THEN 'hit' ELSE 'miss' END AS verdict
          FROM walk w JOIN step s ON s.n = w.n + 1 JOIN nth l USING (request_id)
          LEFT JOIN recurring.walk b ON b.place = s.budget LEFT JOIN recurring.walk c ON c.place = s.place
          WHERE w.place = 'step'))),
    told AS (SELECT s.request_id, s.user_id, w.verdict FROM walk w JOIN step s ON w.place = 'q' || s.request_id)
    SELECT request_id, user_id, intent, model, prompt_tokens, completion_tokens, total_tokens, CAST(cost_usd AS DOUBLE) AS cost_usd
      FROM cost JOIN told USING (request_id) WHERE verdict = 'miss'
    UNION ALL SELECT request_id, user_id, 'cached', 'semantic-cache', 0, 0, 0, 0.0 FROM told WHERE verdict = 'hit'"""

# ----------------------------------------------------------------------------------------- streams
def in_thirds(rows: str, ts: str) -> str:
    """Rows with ``third``, the part of the time span that they lie in."""
    span = f"(SELECT min(epoch_us({ts})) AS low, (max(epoch_us({ts})) - min(epoch_us({ts}))) // 3 + 1 AS wide FROM {rows})"
    return f"(SELECT r.*, least((epoch_us({ts}) - low) // wide, 2) AS third FROM {rows} r, {span})"


_GOOD = f"(SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM {v('token_logs')} WHERE id % 7 <> 3)"
ORACLES["stream_log_ingest"] = f"""SELECT model, count(*) AS entries, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {_GOOD} GROUP BY model
    UNION ALL SELECT 'numbers', count(*), count(*) FROM {_GOOD}
    UNION ALL SELECT 'dead letters', count(*), 0 FROM {v('token_logs')} WHERE id % 7 = 3"""
ORACLES["stream_ingested_days"] = f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, intent, count(*) AS requests,
    CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM {v('token_logs')} GROUP BY ALL"""
ORACLES["stream_live_dashboard"] = ORACLES["by_model"]
ORACLES["stream_dashboard_summary"] = f"""SELECT total_requests, total_tokens_used, total_cost_usd, avg_latency_ms
    FROM ({ORACLES['summary_metrics']})"""
ORACLES["stream_newest_logs"] = ORACLES["recent_logs"].replace("ORDER BY id DESC", "ORDER BY created_at DESC, id DESC")
_LATE = f"""(SELECT *, least(third + CAST(request_id % 10 = 0 AS INT), 2) AS batch FROM {in_thirds(v('requests'), 'ts')})"""
ORACLES["stream_rate_flags"] = f"""SELECT request_id, nth, nth > 2 AS limited FROM (SELECT request_id,
    row_number() OVER (PARTITION BY api_key_id, {DAY} ORDER BY batch, ts, request_id) AS nth FROM {_LATE})"""
_SHORT = f"""(SELECT *, {strip("lower(replace(text, chr(10), ' '))")} AS k FROM {v('short_prompts')})"""
_IS_CODE = ORACLES["code_override"].split("SELECT doc_id, ")[1].split("AS is_code")[0]
ORACLES["stream_memo_labels"] = f"""SELECT request_id, CASE WHEN {_IS_CODE} THEN 'code' ELSE 'general' END AS intent, NOT fires AS remembered
    FROM {_SHORT} p JOIN {fired(f"(SELECT k, ts, request_id AS id FROM {_SHORT})", "3600")} f ON f.id = request_id"""
ORACLES["stream_config"] = f"""SELECT request_id, arg_max(s.model, valid_from) AS model, arg_max(max_tokens, valid_from) AS max_tokens
    FROM {v('requests')} r LEFT JOIN {v('key_settings')} s ON s.key_number = r.key_number AND s.valid_from <= r.ts GROUP BY request_id"""
_SAVES = f"""(SELECT sha256(CAST(doc_id AS VARCHAR)) AS cache_key, epoch_us(ts) // 1000000 AS saved_at, request_id, third,
    epoch_us(ts) // 1000000 + {TTL} AS expires_at FROM {in_thirds(f"(SELECT *, logged_intent AS intent FROM {v('requests')})", 'ts')})"""
ORACLES["cache_generations"] = f"""SELECT cache_key, saved_at, request_id FROM (SELECT *, max(saved_at) OVER () AS now,
      row_number() OVER (PARTITION BY cache_key ORDER BY saved_at DESC, third DESC, expires_at DESC, request_id DESC) AS n FROM {_SAVES})
    WHERE n = 1 AND expires_at > now"""
ORACLES["price_snapshot"] = f"SELECT model_name, provider, input_price, output_price FROM ({ORACLES['price_upsert']})"
ORACLES["price_feed_files"] = f"""SELECT model_name, CAST(input_price AS DOUBLE) AS input_price, CAST(output_price AS DOUBLE) AS output_price
    FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY seq DESC) AS n FROM {v('price_feed')}) WHERE n = 1"""
ORACLES["table_readers"] = f"""SELECT 'logs' AS name, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total FROM {LOGS}
    UNION ALL SELECT 'keys', count(*), CAST(sum(coalesce(len(allowed_rules), 0)) AS BIGINT) FROM {KEYS}
    UNION ALL SELECT 'rules', count(*), CAST(sum(weight) AS BIGINT) FROM {RULE_TABLE}"""
ORACLES["local_model_sizes"] = f"""SELECT CAST(l_partkey AS VARCHAR) AS name, gb AS size_gb, CAST(gb AS VARCHAR) || ' GB' AS size,
    bytes / 1073741824 > {fixed.MAX_LOCAL_MODEL_GB} AS over_limit
    FROM (SELECT l_partkey, bytes, round(bytes / 1073741824, 2) AS gb FROM
      (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT) * 25000000) AS bytes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey))"""
_PLAIN = f"(SELECT split_part(name, ':', 1) AS name FROM {v('local_models')})"
ORACLES["installed_models"] = f"""WITH i AS (SELECT name FROM {v('local_models')} WHERE contains(name, ':') UNION
      SELECT name || ':latest' FROM {_PLAIN} WHERE (length(name) + 7) % 2 = 0)
    SELECT DISTINCT w.name FROM (SELECT name FROM {_PLAIN} UNION SELECT name FROM {v('local_models')}) w JOIN i
    ON i.name = w.name OR (NOT contains(w.name, ':') AND i.name = w.name || ':latest')"""
ORACLES["cached_answers"] = f"""SELECT request_id, 'assistant' AS role,
    CASE WHEN request_id % 3 = 2 THEN CAST(to_json({{'answer': answer}}) AS VARCHAR) ELSE answer END AS content FROM {v('outcomes')}"""
ORACLES["cache_clear"] = f"""WITH c AS (SELECT 'exact' AS kind, count(DISTINCT doc_id) AS cleared FROM {v('requests')}
      UNION ALL SELECT 'semantic', count(*) FROM {v('cache_entries')} UNION ALL SELECT 'intent', count(DISTINCT k) FROM {_SHORT})
    SELECT kind, cleared FROM c UNION ALL SELECT 'total', CAST(sum(cleared) AS BIGINT) FROM c"""
ORACLES["chat_defaults"] = f"""SELECT conv_id, count(*) AS messages, CASE WHEN conv_id % 3 <> 0 THEN CAST(conv_id % 900 + 1 AS INT)
    ELSE {fixed.DEFAULT_MAX_TOKENS} END AS max_tokens FROM ({ORACLES['merge_roles']}) GROUP BY conv_id"""
ORACLES["stream_rate_limit"] = f"""SELECT api_key_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests,
    greatest(count(*) - 2, 0) AS refused FROM {v('requests')} GROUP BY ALL"""
ORACLES["stream_alert_silence"] = f"""SELECT CAST(k AS VARCHAR) AS user_id, id AS event_id FROM
    {fired("(SELECT user_id AS k, ts, event_id AS id FROM events)", "86400")} WHERE fires"""
UTC_MONTH = "CASE WHEN budget_type = 'monthly' THEN strftime(ts, '%Y-%m') ELSE '' END"
ORACLES["stream_budget"] = f"""WITH low AS (SELECT * FROM {balances(SPEND, f"c.api_key_id, {UTC_MONTH}")} WHERE cost_usd > 0
      AND greatest(after, 0) / total_budget < 0.1),
    f AS (SELECT * FROM {fired("(SELECT api_key_id AS k, ts, request_id AS id FROM low)", "3600")})
    SELECT request_id, round(CAST(greatest(before, 0) AS DOUBLE), 9) AS balance_before, before <= 0 AS refused,
    coalesce(fires, false) AS alert FROM {balances(SPEND, f"c.api_key_id, {UTC_MONTH}")} b LEFT JOIN f ON f.id = request_id"""
ORACLES["stream_fold_live"] = ORACLES["stream_fold"]

# ------------------------------------------------------------------------------------------ intents
_CLEAN = strip("lower(replace(t, chr(10), ' '))")
INTENT_GRAMS = f"""(SELECT * EXCLUDE (t, ws), list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams
    FROM (SELECT *, coalesce(regexp_extract_all({_CLEAN}, '[^{WS}]+'), []) AS ws FROM """
INTENT_MODEL = f"""s AS (SELECT intent, grams FROM {INTENT_GRAMS} (SELECT intent, sample_text AS t FROM {v('intent_samples')})))),
    g AS (SELECT intent, gram, count(*) AS n FROM (SELECT intent, unnest(grams) AS gram FROM s) GROUP BY ALL),
    size AS (SELECT count(DISTINCT gram) AS grams FROM g),
    c AS (SELECT intent, count(*) AS samples, CAST(round(ln(count(*) / (SELECT count(*) FROM s)) * 1000000) AS BIGINT) AS prior FROM s GROUP BY intent),
    t AS (SELECT c.intent, prior, coalesce(sum(n), 0) + 0.1::DOUBLE * max(grams) AS total
      FROM c LEFT JOIN g USING (intent), size GROUP BY c.intent, prior),
    w AS (SELECT v.gram, t.intent, coalesce(g.n, 0) AS n, CAST(round(ln((coalesce(g.n, 0) + 0.1::DOUBLE) / total) * 1000000) AS BIGINT) AS weight
      FROM (SELECT DISTINCT gram FROM g) v CROSS JOIN t LEFT JOIN g ON g.gram = v.gram AND g.intent = t.intent)"""
ORACLES["train_intent"] = f"WITH {INTENT_MODEL} SELECT intent, gram, n, weight FROM w WHERE n > 0"
ORACLES["classify_intent"] = f"""WITH {INTENT_MODEL},
    p AS (SELECT doc_id, unnest(grams) AS gram FROM {INTENT_GRAMS} (SELECT doc_id, text AS t FROM {PROMPTS})))),
    k AS (SELECT doc_id, w.intent, sum(weight) AS score FROM p JOIN w USING (gram) GROUP BY ALL),
    r AS (SELECT d.doc_id, t.intent, prior + coalesce(score, 0) AS score FROM {PROMPTS} d CROSS JOIN t
      LEFT JOIN k ON k.doc_id = d.doc_id AND k.intent = t.intent),
    b AS (SELECT doc_id, intent, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent) AS place FROM r)
    SELECT doc_id, CASE WHEN o.is_code THEN 'code' ELSE b.intent END AS intent FROM b JOIN ({ORACLES['code_override']}) o USING (doc_id) WHERE place = 1"""
_COUNTS = """[length(text)::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE,
    (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE]"""
ORACLES["embed_prompts"] = "SELECT doc_id, " + ", ".join(
    f"round((c[{i + 1}] / sqrt(list_sum(list_transform(c, lambda x: x * x))))::FLOAT::DOUBLE, 5) AS e{i}" for i in range(3)
) + f" FROM (SELECT doc_id, {_COUNTS} AS c FROM {PROMPTS})"
ORACLES["pair_scores"] = f"""SELECT query_id, entry_id, round(logit, 9) AS logit, 1 / (1 + exp(-logit)) >= 0.85 AS accepted
    FROM (SELECT query_id, entry_id, 3.0::DOUBLE - abs(length(q.prompt) - length(e.prompt)) / 500::DOUBLE AS logit
      FROM {v('lookups')} q JOIN {v('cache_entries')} e ON e.entry_id = q.query_id + 1)"""
