"""The driver's tables in the roles of the graph's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def instant(c: str):
    """Zoneless moments as UTC instants."""
    return F.col(c).cast("timestamp")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """events: a user is an artifact, an event a version of it."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, d, "events").select(
        F.col("user_id").alias("artifact_id"), F.col("event_id").alias("id"), instant("ts").alias("ts"),
        F.concat_ws(":", "event_type", k, F.floor("value").cast("string")).alias("fingerprint"), F.floor(F.col("value") * 10).cast("long").alias("lines"), "event_type", "value",
    )


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: an order is a commit, a part a file."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents as two trees: all of them before; after, a third moved to another path and some texts changed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    moved = F.when(F.col("path") % 3 == 0, F.col("path") + 1_000_000_000).otherwise(F.col("path"))
    changed = F.when(F.col("path") % 4 == 0, F.concat("text", F.lit("\nadded line"))).otherwise(F.col("text"))
    return docs, docs.select(moved.alias("path"), changed.alias("text"))
