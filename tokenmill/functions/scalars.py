"""Small scalar rules: prices, labels, names and messages, as native Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions import fixed

MONEY = "decimal(18,12)"


def money(v: str) -> Column:
    return F.lit(v).cast(MONEY)


def request_cost(prompt_tokens: Column, completion_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """Tokens times rates, in decimal, at 12 places."""
    total = prompt_tokens.cast("int") * rate_in + completion_tokens.cast("int") * rate_out
    return total.cast(MONEY)


def listed_price(model: Column, which: int) -> Column:
    """Rate of the first listed name that the model's name contains, else the generic rate."""
    chain = reduce(
        lambda acc, row: acc.when(model.contains(row[0]), money(row[which])), fixed.DEFAULT_PRICES[1:],
        F.when(model.contains(fixed.DEFAULT_PRICES[0][0]), money(fixed.DEFAULT_PRICES[0][which])),
    )
    return chain.otherwise(money(fixed.GENERIC_PRICE[which - 1]))


def is_free(provider: Column, url: Column) -> Column:
    return F.coalesce(provider == fixed.FREE_PROVIDER, F.lit(False)) | F.coalesce(
        url.contains(fixed.FREE_PROVIDER), F.lit(False)
    )


def owner(model: Column) -> Column:
    return (
        F.when(model.contains("gemini"), "google").when(model.contains("claude"), "anthropic").otherwise("openai")
    )


def provider_of(catalogue_id: Column) -> Column:
    return F.when(catalogue_id.contains("/"), F.split_part(catalogue_id, F.lit("/"), F.lit(1))).otherwise("unknown")


def model_path(name: Column) -> Column:
    base = F.split_part(name, F.lit(":"), F.lit(1))
    return F.when(base.contains("/"), base).otherwise(F.concat(F.lit("library/"), base))


def model_tag(name: Column) -> Column:
    at = F.instr(name, ":")
    return F.when(at > 0, name.substr(at + 1, F.length(name))).otherwise("latest")


def installed_names(name: Column) -> Column:
    """The names under which a local model may be listed."""
    return F.when(name.contains(":"), F.array(name)).otherwise(F.array(name, F.concat(name, F.lit(":latest"))))


def size_gb(size_bytes: Column) -> Column:
    return F.round(size_bytes / F.lit(1024**3), 2)


def model_label(name: Column) -> Column:
    """Short axis label of a model's name."""
    short = F.regexp_replace(name, "[-_][0-9]{4,8}", "")
    short = F.regexp_replace(short, "[-_][0-9]{4}-[0-9]{2}-[0-9]{2}", "")
    for old, new in [("-latest", ""), (":latest", ""), *fixed.MODEL_RENAMES]:  # first place only
        short = F.regexp_replace(short, rf"^(.*?)\Q{old}\E", "$1" + new)
    cut = F.when(F.length(short) > 12, F.concat(short.substr(1, 11), F.lit("…"))).otherwise(short)
    return (
        F.when(name.isNull() | (name == ""), "").when(name == fixed.CACHED_MODEL, "cache").otherwise(cut)
    )


def ttl_seconds(intent: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.CACHE_TTL_SECONDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, intent), F.lit(fixed.DEFAULT_TTL_SECONDS)).cast("bigint")


def passes_score(logit: Column, gate: float = fixed.SCORE_GATE) -> Column:
    return 1 / (1 + F.exp(-logit)) >= F.lit(gate)


def finish_reason(reason: Column) -> Column:
    return (
        F.when(reason.isNull() | (reason == ""), "stop")
        .when(reason == "end_turn", "stop")
        .when(reason == "max_tokens", "length")
        .otherwise(reason)
    )


def with_scheme(url: Column) -> Column:
    """A URL as typed, made absolute. Empty stays empty; a URL with a scheme stays as typed."""
    trimmed = F.trim(url)
    return F.when(url.isNull() | (url == "") | trimmed.rlike("(?i)^https?://"), url).otherwise(
        F.concat(F.lit("http://"), trimmed)
    )


def threshold_band(v: Column) -> Column:
    chain = reduce(lambda acc, b: acc.when(v <= b[0], b[1]), fixed.THRESHOLD_BANDS[1:],
                   F.when(v <= fixed.THRESHOLD_BANDS[0][0], fixed.THRESHOLD_BANDS[0][1]))
    return chain.otherwise(fixed.THRESHOLD_TOP_BAND)


def low_budget_text(name: Column, remaining: Column, total: Column, source: str = "Gateway") -> Column:
    return F.format_string(fixed.LOW_BUDGET_TEXT, F.lit(source), name, F.format_number(remaining, 4), F.format_number(total, 4))


def failover_text(intent: Column, primary: Column, fallback: Column, error: Column, source: str = "Gateway") -> Column:
    return F.format_string(fixed.FAILOVER_TEXT, F.lit(source), intent, primary, fallback, error)


def double_bold(message: Column) -> Column:
    """The message for a chat that marks bold text with two stars."""
    return F.replace(message, F.lit("*"), F.lit("**"))
