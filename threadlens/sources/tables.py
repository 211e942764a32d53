"""Sources and sinks: parquet tables, quoted multi-line CSV, required columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from threadlens.functions.text import norm_flag

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def require_columns(df: DataFrame, required, what: str = "input") -> DataFrame:
    """A3: fail before any action when columns are missing (names listed sorted)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A1: CSV with quoted multi-line cells ("" escapes a quote), header row.

    With an explicit schema the scan does not infer types (one pass, no driver
    sampling); without one every column is read as string.
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"'))
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """A2: write a result table (parquet by default; csv keeps the quoting of A1)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def coerce_messages(raw: DataFrame) -> DataFrame:
    """B7/B8 on the raw message schema: ids to numbers (bad -> null), author
    trimmed, text null -> '', inbound normalised to a boolean."""
    require_columns(raw, ["tweet_id", "author_id", "text"], "messages")

    def as_id(c):
        # '123' and '123.0' (a float written by another tool) -> 123; anything
        # else -> null. No detour through double: 18-digit ids stay exact.
        return F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0+$", "").try_cast("bigint")
    out = (raw
           .withColumn("tweet_id", as_id("tweet_id"))
           .withColumn("author_id", F.trim(F.col("author_id").cast("string")))
           .withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    if "in_response_to_tweet_id" in raw.columns:
        out = out.withColumn("in_response_to_tweet_id", as_id("in_response_to_tweet_id"))
    if "inbound" in raw.columns:
        out = out.withColumn("inbound", norm_flag("inbound") == F.lit("true"))
    return out


def messages_from_conversations(conversations: DataFrame, support_author: str = "support") -> DataFrame:
    """Stand the driver's ``conversations`` in for a raw message table.

    id = conv_id*100 + turn; the parent is the previous turn; every message lists
    the next id as its response (C1 keeps only targets that exist); assistant
    turns are written by the support account, user turns are inbound.
    """
    c = conversations
    tid = c.conv_id * 100 + c.turn
    return c.select(
        tid.alias("tweet_id"),
        F.when(c.role == "assistant", F.lit(support_author))
         .otherwise(F.concat(c.role, F.lit("_"), c.conv_id.cast("string"))).alias("author_id"),
        (c.role == "user").alias("inbound"),
        F.lit(None).cast("string").alias("created_at"),
        F.coalesce(c.text, F.lit("")).alias("text"),
        (tid + 1).cast("string").alias("response_tweet_id"),
        F.when(c.turn > 0, tid - 1).cast("bigint").alias("in_response_to_tweet_id"),
    )


def input_order(df: DataFrame):
    """A column that orders the rows as they lie in the input: file, start of the split,
    position in it (the scan's hidden ``_metadata`` columns). A frame that is not a scan with
    projections and filters on it has the order of its partitions."""
    place = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start").schema
    except AnalysisException:
        return place
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), place.alias("p"))
