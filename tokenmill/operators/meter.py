"""Who may ask, how often, and for how much: keys, rate limits, budgets and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.operators.ordered import HotKeys, find_hot_keys, greedy_ttl, rank_in_key, running_total, time_slice

MONEY4 = "decimal(12,4)"
EXACT = "decimal(38,12)"
BUDGET_SLICE_SECONDS = 60


def bearer_token(header: Column) -> Column:
    """The token of a well-formed header, else null."""
    return F.when(header.startswith("Bearer "), F.split_part(header, F.lit(" "), F.lit(2)))


def key_auth(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with the key that their token's hash names; unknown tokens get nulls."""
    named = keys.select(
        "key_hash", F.col("id").alias("key_id"), F.col("name").alias("key_name"),
        F.col("user_id").alias("key_user"), "active", "total_budget", "remaining_budget", "budget_type",
        "allowed_rules",
    )
    return requests.withColumn("key_hash", F.sha2(bearer_token(F.col("auth_header")), 256)).join(
        named, "key_hash", "left"
    )


def rate_limit(
    requests: DataFrame, key: str, ts: str = "ts", row_id: str = "request_id",
    limit: int = fixed.RATE_LIMIT, width: int = fixed.RATE_WINDOW_SECONDS, hot: HotKeys | None = None,
) -> DataFrame:
    """Adds ``nth`` in the key's clock window and ``limited``; refused requests count as well.

    Windows are cut further by time, so that a key with very many requests per window is spread.
    """
    windowed = requests.withColumn("_window", time_slice(F.col(ts), width))
    ranked = rank_in_key(windowed, [key, "_window"], time_slice(F.col(ts), width / 64), [ts, row_id], "nth",
                         hot or find_hot_keys(requests, [key]))
    return ranked.withColumn("limited", F.col("nth") > limit).drop("_window")


def spend(cost: Column, mode: str) -> Column:
    """A charge as booked: ``exact`` on the live balance, ``durable`` rounded to cents of a cent."""
    booked = F.round(cost, 4) if mode == "durable" else cost
    return F.when(booked > 0, booked).otherwise(0).cast(EXACT)


def running_budget(
    charges: DataFrame, keys: DataFrame, mode: str = "exact", monthly: bool = False, tz: str = "UTC",
    key: str = "api_key_id", ts: str = "ts", row_id: str = "request_id", cost: str = "cost_usd",
    slice_seconds: int = BUDGET_SLICE_SECONDS, opening: DataFrame | None = None,
) -> DataFrame:
    """Balance before and after each charge, and whether the request found the budget used up.

    A request is refused on the balance before it, so the last one may overshoot. The exact balance
    stops at zero, the durable one may go below. With ``monthly``, keys of that type start again
    with their full budget on the first of each month in the time zone ``tz``. ``opening`` has what
    was spent before: (key, spent), and budget_month if ``monthly``.
    """
    budgets = keys.select(F.col("id").cast("string").alias(key), "name", "total_budget", "budget_type")
    rows = charges.join(budgets, key, "left").withColumn("_spend", spend(F.col(cost), mode))
    group = [key]
    if monthly:
        local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
        month = F.when(F.col("budget_type") == "monthly", F.date_format(local, "yyyy-MM")).otherwise("")
        rows = rows.withColumn("budget_month", month)
        group = [key, "budget_month"]
    rows = running_total(
        rows, group, time_slice(F.col(ts), slice_seconds), [ts, row_id], F.col("_spend"), "_before"
    )
    floor = (lambda c: F.greatest(c, F.lit(0).cast(EXACT))) if mode == "exact" else (lambda c: c)
    if opening is not None:
        rows = rows.join(opening.select(*group, F.col("spent").alias("_spent")), group, "left")
        rows = rows.withColumn("_before", F.col("_before") + F.coalesce("_spent", F.lit(0).cast(EXACT))).drop("_spent")
    left = F.col("total_budget").cast(EXACT) - F.col("_before")
    before, after = floor(left), floor(left - F.col("_spend"))
    return (
        rows.withColumn("balance_before", before).withColumn("balance_after", after)
        .withColumn("refused", F.col("balance_before") <= 0).drop("_before", "_spend")
    )


def is_low(remaining: Column, total: Column, share: float = fixed.LOW_BUDGET_SHARE) -> Column:
    """Strictly less than the share of a positive total. In decimal: no division, no rounding."""
    return (total > 0) & (remaining < total * F.lit(str(share)).cast("decimal(4,2)"))


def low_budget_alerts(
    balances: DataFrame, key: str = "api_key_id", ts: str = "ts", row_id: str = "request_id", cost: str = "cost_usd",
    silence: int = fixed.ALERT_SILENCE_SECONDS,
) -> DataFrame:
    """Charges that leave a key low, at most one per key and ``silence`` seconds since the last alert."""
    low = balances.where((F.col(cost) > 0) & is_low(F.col("balance_after"), F.col("total_budget")))
    fired = greedy_ttl(low, [key], ts, row_id, F.lit(silence))
    return low.join(fired.select(key, row_id), [key, row_id], "left_semi")


def key_spend(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Charged sums per key and both balances left of its budget."""
    per_key = logs.groupBy("api_key_id").agg(
        F.sum(spend(F.col("cost_usd"), "exact")).alias("spent"),
        F.sum(spend(F.col("cost_usd"), "durable")).alias("spent_durable"),
    )
    zero = F.lit(0).cast(EXACT)
    spent, durable = F.coalesce("spent", zero), F.coalesce("spent_durable", zero)
    return (
        keys.withColumn("api_key_id", F.col("id").cast("string")).join(per_key, "api_key_id", "left")
        .select(
            "api_key_id", "name", "total_budget", spent.alias("spent"),
            (F.col("total_budget") - durable).alias("durable_balance"),
            F.greatest(F.col("total_budget") - spent, zero).alias("live_balance"),
        )
    )


def monthly_reset(keys: DataFrame) -> DataFrame:
    """Keys with monthly budgets back at their total, whatever their status."""
    monthly = F.coalesce(F.col("budget_type") == "monthly", F.lit(False))
    return keys.withColumn("reset", monthly).withColumn(
        "remaining_budget", F.when(monthly, F.col("total_budget")).otherwise(F.col("remaining_budget"))
    )


VERDICTS = [("malformed", 401), ("limited", 429), ("unknown", 401), ("inactive", 401), ("spent", 402)]


def request_verdict(
    requests: DataFrame, keys: DataFrame, cost: str = "cost_usd", ts: str = "ts", row_id: str = "request_id",
    limit: int = fixed.RATE_LIMIT, width: int = fixed.RATE_WINDOW_SECONDS, tz: str = "UTC",
) -> DataFrame:
    """First rule that refuses each request, in a replay where ``cost`` is what an answer would cost.

    Refused requests are not charged. Charges are not negative, so once a key's budget is used up it
    stays so (till the next month for monthly keys), and the sum over requests that pass the earlier
    rules decides the budget rule.
    """
    token = bearer_token(F.col("auth_header"))
    # requests without a token stay apart from the counting, one group for each of them
    tagged = requests.withColumn(
        "_caller", F.coalesce(F.sha2(token, 256), F.concat(F.lit("#"), F.col(row_id).cast("string")))
    ).withColumn("_malformed", token.isNull())
    hot = find_hot_keys(tagged.where("NOT _malformed"), ["_caller"])
    if hot.rows is None:
        # clock windows and budgets then share one shuffle, as both group by caller
        tagged = tagged.repartition("_caller")
    counted = rate_limit(tagged, "_caller", ts, row_id, limit, width, hot)
    named = keys.select(F.col("key_hash").alias("_caller"), F.col("id").alias("key_id"), "active", "total_budget", "budget_type")
    # monthly keys start each month with their full budget
    month = F.when(F.col("budget_type") == "monthly", F.date_format(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz), "yyyy-MM"))
    rows = counted.join(named, "_caller", "left").withColumn("_month", F.coalesce(month, F.lit("")))
    passes = ~F.col("_malformed") & ~F.col("limited") & F.coalesce("active", F.lit(False))
    rows = running_total(
        rows.withColumn("_passes", passes), ["_caller", "_month"], time_slice(F.col(ts), BUDGET_SLICE_SECONDS), [ts, row_id],
        F.when(passes, F.col(cost)).otherwise(0).cast(EXACT), "_spent", hot=hot,
    )
    refusals = {
        "malformed": F.col("_malformed"),
        "limited": F.col("limited"),
        "unknown": F.col("key_id").isNull(),
        "inactive": ~F.col("active"),
        "spent": F.col("total_budget") - F.col("_spent") <= 0,
    }
    code, reason = F, F
    for name, status in VERDICTS:
        code = code.when(refusals[name], F.lit(status))
        reason = reason.when(refusals[name], F.lit(name))
    return rows.select(
        *requests.columns, "key_id", code.otherwise(200).alias("status"), reason.otherwise("ok").alias("verdict")
    )


def budget_adjust(keys: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys after change rows (change_id, key_id, total_budget, remaining_budget, status, budget_type).

    Null fields keep the old value. A change of the total alone moves the remainder by the
    difference, but not below zero; a given remainder is set as it is. Several changes of one key
    apply in order of ``change_id``. With ``T`` the total after a change, the running remainder is
    ``T`` minus the smallest of its start gap and the totals passed since then (a total passed is
    where the floor of zero may have been touched), so no walk through a key's changes is needed.
    """
    given = changes.where("key_id IS NOT NULL")
    resets = given.where("remaining_budget IS NOT NULL").groupBy("key_id").agg(
        F.max("change_id").alias("_reset_at"), F.max_by("remaining_budget", "change_id").alias("_reset_to")
    )
    since = F.coalesce(F.col("_reset_at"), F.lit(-(2**63)))
    total_at = F.when(F.col("total_budget").isNotNull(), F.col("change_id"))
    early = F.when(F.col("total_budget").isNotNull() & (F.col("change_id") <= since), F.col("change_id"))
    late = (F.col("change_id") > since) & F.col("total_budget").isNotNull()
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_id")))
    per_key = (
        given.join(resets, "key_id", "left").groupBy("key_id").agg(
            F.max_by("total_budget", total_at).alias("_total"),
            F.max_by("total_budget", early).alias("_total_at_reset"),
            F.min(F.when(late, F.col("total_budget"))).alias("_lowest"),
            F.max("_reset_to").alias("_reset_to"),
            latest("status").alias("_status"), latest("budget_type").alias("_type"),
            F.count("*").alias("changes"),
        )
    )
    rows = keys.join(per_key.withColumnRenamed("key_id", "id"), "id", "left")
    total = F.coalesce("_total", "total_budget")
    start_total = F.coalesce("_total_at_reset", "total_budget")
    start_left = F.coalesce("_reset_to", "remaining_budget")
    gap = start_total - start_left
    lowest = F.least(gap, F.coalesce(F.col("_lowest"), gap))
    return rows.select(
        "id", "name", total.cast(MONEY4).alias("total_budget"), (total - lowest).cast(MONEY4).alias("remaining_budget"),
        F.coalesce("_status", "status").alias("status"), F.coalesce("_type", "budget_type").alias("budget_type"),
        F.coalesce("changes", F.lit(0)).alias("changes"),
    )
