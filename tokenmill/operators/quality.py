"""Data quality: field rules, references and uniqueness, as reports over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import with_scheme


def required(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def longer_than(c: str, n: int) -> Column:
    return F.length(c) > n


def not_in(c: str, values: list[str]) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*values)


def below(c: str, least: int) -> Column:
    return F.col(c) < least


def not_url(c: str) -> Column:
    """No URL, after the scheme that may be left out is added; an empty value is a matter of ``required``."""
    return (F.col(c) != "") & ~with_scheme(F.col(c)).rlike(r"^https?://\S+$")


def rule_checks() -> dict[str, Column]:
    checks = {}
    for c, n in (("intent", 100), ("provider", 50), ("model", 100), ("url", 255), ("api_key_env", 512)):
        checks[f"{c} required"] = required(c)
        checks[f"{c} max {n}"] = longer_than(c, n)
    for c, n in (("fallback_provider", 50), ("fallback_model", 100), ("fallback_url", 255), ("fallback_api_key_env", 512)):
        checks[f"{c} max {n}"] = longer_than(c, n)
    checks["url format"] = not_url("url")
    checks["fallback_url format"] = not_url("fallback_url")
    checks["weight min 0"] = below("weight", 0)
    return checks


def key_checks() -> dict[str, Column]:
    return {
        "name required": required("name"),
        "name max 255": longer_than("name", 255),
        "user_id max 255": longer_than("user_id", 255),
        "status values": not_in("status", ["active", "inactive"]),
        "total_budget min 0": below("total_budget", 0),
        "remaining_budget min 0": below("remaining_budget", 0),
        "budget_type values": not_in("budget_type", ["one_time", "monthly"]),
    }


def sample_checks() -> dict[str, Column]:
    return {
        "intent required": required("intent"),
        "intent values": not_in("intent", fixed.INTENTS),
        "sample_text required": required("sample_text"),
        "sample_text max 1000": longer_than("sample_text", 1000),
    }


def alert_checks() -> dict[str, Column]:
    return {"type required": required("type"), "type values": not_in("type", ["failover", "low_budget"])}


def compressor_checks() -> dict[str, Column]:
    return {
        "method values": not_in("method", ["llmlingua", "rtk", "caveman", "stacked", "rtk+llmlingua", "disabled"]),
        "ratio range": (F.col("ratio") < 0.01) | (F.col("ratio") > 1.0),
        "caveman_intensity values": not_in("caveman_intensity", ["lite", "full", "ultra"]),
    }


def rephrase_checks() -> dict[str, Column]:
    return {
        "provider values": not_in("provider", ["ollama", "openai", "google", "anthropic"]),
        "model required": required("model"),
    }


def validate_rows(df: DataFrame, row_id: str, checks: dict[str, Column]) -> DataFrame:
    """(row_id, violation): one row per broken check. One pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return df.select(F.col(row_id).alias("row_id"), F.explode(broken).alias("violation"))


def dangling_rule_refs(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key_id, rule_id) of access list entries that name no rule."""
    named = keys.select(F.col("id").alias("key_id"), F.explode("allowed_rules").alias("rule_id"))
    return named.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_anti").select("key_id", "rule_id")


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that several rows share. As for a unique key in SQL, rows with a null in it are no copies."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")
