"""Directory trees as tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a scan passes over; the engine's own folder among them.
SKIPPED = (".git", "node_modules", "target", "dist", ".tracelake", ".venv")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of each UTF-8 file under `root`, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    whole = F.regexp_replace("path", "^[a-z]+:/{1,3}", "/")
    at = F.locate(base, whole) + len(base)
    inner = "|".join(d.replace(".", r"\.") for d in SKIPPED)
    files = raw.select(whole.substr(at, F.length(whole)).alias("path"), "content").where(~F.col("path").rlike(f"(^|/)(?:{inner})/"))
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def one_shot(files: DataFrame) -> DataFrame:
    """Every file as modified, with all its lines added."""
    return files.select("path", F.lit("modified").alias("status"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n"))).alias("lines_added"), F.lit(0).alias("lines_removed"))


def named(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """(path, text) of the named files that exist."""
    found = [(p, os.path.join(root, p)) for p in paths if os.path.isfile(os.path.join(root, p))]
    rows = []
    for p, full in found:
        with open(full, "rb") as f:
            rows.append((p, f.read().decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, text string")
