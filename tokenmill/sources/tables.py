"""Schemas and readers of the durable tables and of JSON and line-based feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import fixed
from tokenmill.functions.text import WS, strip
from tokenmill.operators.ordered import number_rows

TOKEN_LOGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("api_key_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()),
    T.StructField("latency_ms", T.IntegerType()),
    T.StructField("cost_usd", T.DecimalType(18, 12)),
    T.StructField("created_at", T.TimestampType()),
])
API_KEYS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("key_hash", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_budget", T.DecimalType(12, 4)),
    T.StructField("remaining_budget", T.DecimalType(12, 4)),
    T.StructField("budget_type", T.StringType()),
    T.StructField("allowed_rules", T.StringType()),
])
ROUTING_RULES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("intent", "provider", "model", "url", "api_key_env")]
    + [T.StructField("weight", T.IntegerType())]
    + [T.StructField(f"fallback_{n}", T.StringType()) for n in ("provider", "model", "url", "api_key_env")]
)
LOG_ENTRY = T.StructType([
    T.StructField("api_key_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("latency_ms", T.IntegerType()),
    T.StructField("cost_usd", T.DoubleType()),
])
# content may be a string or a list of parts, so it stays a variant until it is flattened
CHAT_REQUEST = "model string, messages array<struct<role:string,content:variant>>, temperature double, stream boolean, max_tokens int"
ANSWER = "choices array<struct<message:struct<role:string,content:string>>>"
PROVIDER_EVENT = (
    "type string, message struct<usage:struct<input_tokens:bigint>>, "
    "delta struct<text:string,stop_reason:string>, usage struct<output_tokens:bigint>"
)
PRICE_FEED = "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>"


SPREAD_BYTES = 8 << 20  # of a file; its texts are larger


def spread(texts: DataFrame, key: str, path: str) -> DataFrame:
    """Long texts over all cores, where they come in fewer files than there are cores.

    A row group is one task's work, and the text rules are bound by the processor. With enough files,
    the normal case at scale, the table is left as it is and nothing is shuffled. The parts are as many as the
    size of the files asks for, so a task's share doesn't grow with the table; joins by ``key`` keep them.
    """
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(texts.inputFiles()) >= cores:
        return texts
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)  # lengths alone are read
    size = files.agg(F.sum("length")).first()[0] or 0
    return texts.repartition(max(cores, -(-size // SPREAD_BYTES)), key)


def read_token_logs(spark: SparkSession, path: str) -> DataFrame:
    """The fact table. Columns and filters that the caller asks for reach the Parquet scan."""
    return spark.read.schema(TOKEN_LOGS).parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, parts: int, lower: int, upper: int) -> DataFrame:
    """The same tables from a database, read in ``parts`` ranges of ``id``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=lower, upperBound=upper, numPartitions=parts)
        .load()
    )


def parse_api_keys(keys: DataFrame) -> DataFrame:
    """Keys with ``allowed_rules`` as an array: null allows every rule, unreadable text reads as null."""
    listed = F.from_json("allowed_rules", "array<bigint>", {"mode": "PERMISSIVE"})
    return keys.select(
        *[c for c in keys.columns if c not in ("allowed_rules", "total_budget", "remaining_budget", "plain_key")],
        F.col("total_budget").cast("decimal(12,4)").alias("total_budget"),
        F.col("remaining_budget").cast("decimal(12,4)").alias("remaining_budget"),
        listed.alias("allowed_rules"),
        (F.col("status") == "active").alias("active"),
    )


def read_api_keys(spark: SparkSession, path: str) -> DataFrame:
    return parse_api_keys(spark.read.schema(API_KEYS).parquet(path))


def with_rule_defaults(rules: DataFrame) -> DataFrame:
    return rules.withColumn("weight", F.coalesce("weight", F.lit(fixed.DEFAULT_WEIGHT)))


def read_routing_rules(spark: SparkSession, path: str) -> DataFrame:
    return with_rule_defaults(spark.read.schema(ROUTING_RULES).parquet(path))


def read_price_feed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq, model_name, input_price, output_price) of catalogue documents, one per file.

    ``seq`` follows the order in a document, and documents follow each other by their paths, so the last
    price of a model is that of the last document that has it. Entries without id or pricing are left out.
    """
    read = spark.read.schema(PRICE_FEED).option("multiLine", True).json(path).select("data", F.col("_metadata.file_path").alias("_file"))
    # one small row per file is numbered
    files = number_rows(read.select("_file").distinct(), ["_file"], "_document", 0)
    docs = read.join(files, "_file")
    price = lambda c: F.coalesce(F.expr(f"try_cast(m.pricing.{c} AS decimal(18,12))"), F.lit(0)).cast("decimal(18,12)")
    return (
        docs.select("_document", F.posexplode("data").alias("seq", "m"))
        .where("m.id IS NOT NULL AND m.id <> '' AND m.pricing IS NOT NULL")
        .select((F.shiftleft("_document", 32) + F.col("seq")).alias("seq"), F.col("m.id").alias("model_name"),
                price("prompt").alias("input_price"), price("completion").alias("output_price"))
    )


# ---------------------------------------------------------------------------- labelled text lines
def label_lines(samples: DataFrame, intent: str = "intent", text: str = "sample_text") -> DataFrame:
    """One training line per sample. Line breaks inside a text become blanks."""
    flat = strip(F.regexp_replace(F.col(text), r"[\r\n]+", " "))
    return samples.select(
        *[c for c in samples.columns if c not in (intent, text)],
        F.concat(F.lit("__label__"), F.col(intent), F.lit(" "), flat).alias("value"),
    )


def parse_labelled(lines: DataFrame) -> DataFrame:
    """(intent, sample_text) of labelled lines; blank lines are left out."""
    line = strip(F.col("value"))
    shape = rf"(?s)^__label__([^{WS}]+)(?: (.*))?$"
    return (
        lines.where(line != "")
        .select(
            *[c for c in lines.columns if c != "value"],
            F.regexp_extract(line, shape, 1).alias("intent"),
            F.regexp_extract(line, shape, 2).alias("sample_text"),
        )
    )


def read_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled(spark.read.text(path))


def write_labelled_text(samples: DataFrame, path: str) -> None:
    label_lines(samples).select("value").write.mode("overwrite").text(path)


# -------------------------------------------------------------------------------- chat and answers
def parse_chat_requests(lines: DataFrame) -> DataFrame:
    """Chat payloads from JSON text in ``value``, with the defaults for what is not given."""
    body = F.from_json("value", CHAT_REQUEST)
    return lines.withColumn("_b", body).select(
        *[c for c in lines.columns if c != "value"], "_b.model", "_b.messages",
        F.coalesce("_b.temperature", F.lit(fixed.DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce("_b.stream", F.lit(False)).alias("stream"), "_b.max_tokens",
    )


def flatten_content(content: Column) -> Column:
    """Text of a message's content, a variant: a string as it is; of a list the text parts and strings; else ''.

    The type decides, so a string that looks like JSON stays the string it is.
    """
    parts = F.try_variant_get(content, "$", "array<variant>")
    text = F.transform(
        parts,
        lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(
            F.try_variant_get(p, "$.type", "string") == "text",
            F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
        ),
    )
    joined = F.array_join(F.filter(text, lambda t: t.isNotNull()), " ")
    is_text = F.schema_of_variant(content) == "STRING"
    return F.when(parts.isNotNull(), joined).when(is_text, F.try_variant_get(content, "$", "string")).otherwise("")


def parse_answer(response: Column) -> Column:
    """A cached answer as a struct; text that is no answer document becomes one assistant choice."""
    parsed = F.from_json(response, ANSWER)
    one = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), response.alias("content")).alias("message")))
    return F.when(parsed.choices.isNotNull(), parsed).otherwise(F.struct(one.alias("choices")))


def parse_sse_lines(lines: DataFrame) -> DataFrame:
    """Provider events from ``value``: only ``data: `` lines count, ``[DONE]`` and broken JSON do not."""
    data = strip(F.substring("value", 7, 2**31 - 1))
    return (
        lines.where(F.col("value").startswith("data: ")).withColumn("_d", data).where("_d <> '[DONE]'")
        .withColumn("_e", F.from_json("_d", PROVIDER_EVENT)).where("_e.type IS NOT NULL")
        .select(*[c for c in lines.columns if c != "value"], "_e.*")
    )


# ------------------------------------------------------------------------------------- queue logs
def parse_log_entries(lines: DataFrame) -> DataFrame:
    """Queue entries from JSON text in ``value``; ``ok`` is false where a token count is missing.

    ``total_tokens`` is derived, a missing cost is zero and costs are kept at 12 places.
    """
    e = F.from_json("value", LOG_ENTRY, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_e", e)
    ok = F.coalesce(F.col("_e.prompt_tokens").isNotNull() & F.col("_e.completion_tokens").isNotNull(), F.lit(False))
    cost = F.coalesce("_e.cost_usd", F.lit(0.0)).cast("decimal(18,12)")
    return rows.select(
        *lines.columns, ok.alias("ok"), "_e.api_key_id", "_e.user_id", "_e.intent", "_e.model", "_e.prompt_tokens",
        "_e.completion_tokens", (F.col("_e.prompt_tokens") + F.col("_e.completion_tokens")).alias("total_tokens"),
        "_e.latency_ms", cost.alias("cost_usd"),
    )
