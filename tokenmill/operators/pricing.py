"""Model prices: feed, aliases, upsert, lookup and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed
from tokenmill.functions.scalars import MONEY, is_free, listed_price, provider_of, request_cost
from tokenmill.operators.sizes import broadcast_if_small

MAX_BROADCAST_PRICES = 50_000


def alias_expand(feed: DataFrame) -> DataFrame:
    """Feed rows plus one row per alias of the catalogue id, right after the row itself.

    The alias list is a constant map, so the expansion is a projection.
    """
    entries = []
    for catalogue_id, aliases in fixed.PRICE_ALIASES:
        entries += [F.lit(catalogue_id), F.array(*map(F.lit, aliases))]
    aliases = F.try_element_at(F.create_map(*entries), F.col("model_name"))
    names = F.concat(F.array("model_name"), F.coalesce(aliases, F.array().cast("array<string>")))
    provider = provider_of(F.col("model_name"))
    return feed.select(
        "seq", F.col("model_name").alias("catalogue_id"), F.posexplode(names).alias("step", "model_name"),
        provider.alias("provider"), "input_price", "output_price",
    )


def price_upsert(base: DataFrame, feed: DataFrame) -> DataFrame:
    """Base prices with the feed's on top; of several rows for one name the feed's last one counts."""
    last = F.struct("provider", "input_price", "output_price")
    newest = alias_expand(feed).groupBy("model_name").agg(F.max_by(last, F.struct("seq", "step")).alias("_new"))
    old = base.select("model_name", last.alias("_old"))
    return old.join(newest, "model_name", "full_outer").select(
        "model_name", F.coalesce("_new", "_old").alias("_p"), F.col("_old").isNull().alias("inserted")
    ).select("model_name", "_p.provider", "_p.input_price", "_p.output_price", "inserted")


def price_lookup(
    rows: DataFrame, prices: DataFrame, model: str = "model", provider: str | None = None, url: str | None = None
) -> DataFrame:
    """Adds ``rate_in``, ``rate_out`` and ``price_source``.

    Local providers are free; then an exact name; then the first listed name that the model's name
    contains; then a generic rate. Only the exact lookup needs a join.
    """
    exact = prices.select(
        F.col("model_name").alias("_name"), F.col("input_price_per_token").cast(MONEY).alias("_in"),
        F.col("output_price_per_token").cast(MONEY).alias("_out"),
    )
    null = F.lit(None).cast("string")
    free = is_free(F.col(provider) if provider else null, F.col(url) if url else null)
    listed = F.array(*[F.lit(p[0]) for p in fixed.DEFAULT_PRICES])
    is_listed = F.exists(listed, lambda n: F.col(model).contains(n))
    zero = F.lit(0).cast(MONEY)
    source = (
        F.when(free, "local").when(F.col("_name").isNotNull(), "exact").when(is_listed, "listed").otherwise("generic")
    )
    return (
        rows.join(broadcast_if_small(exact, MAX_BROADCAST_PRICES), F.col(model) == F.col("_name"), "left")
        .withColumn("rate_in", F.when(free, zero).otherwise(F.coalesce("_in", listed_price(F.col(model), 1))))
        .withColumn("rate_out", F.when(free, zero).otherwise(F.coalesce("_out", listed_price(F.col(model), 2))))
        .withColumn("price_source", source)
        .drop("_name", "_in", "_out")
    )


def with_cost(rows: DataFrame, prices: DataFrame, **lookup: str) -> DataFrame:
    """Adds ``cost_usd`` of prompt and completion tokens."""
    priced = price_lookup(rows, prices, **lookup)
    cost = request_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("rate_in"), F.col("rate_out"))
    return priced.withColumn("cost_usd", cost).drop("rate_in", "rate_out", "price_source")
