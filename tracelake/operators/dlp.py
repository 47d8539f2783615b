"""Findings about what a model was given to read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def first_reads(reads: DataFrame, any_turn: bool = False) -> DataFrame:
    """One row for each (task, path): that of the first version, whose secret kinds decide; with `any_turn` the kinds of all."""
    if any_turn:
        kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("secret_kinds"))))
        return reads.groupBy("task_id", "path").agg(F.max("remote").alias("remote"), kinds.alias("secret_kinds"), F.min("ts").alias("ts"))
    w = Window.partitionBy("task_id", "path").orderBy("ts", "version_id")
    return reads.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def findings(reads: DataFrame, globs: Iterable[str] = S.SENSITIVE_GLOBS, flag_external: bool = True, require_remote: bool = True) -> DataFrame:
    """A row for each broken rule of each read (path, secret_kinds, remote): a secret is critical, a sensitive or outside path a warning. Local reads break none."""
    found = lambda rule, severity, detail: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))
    kinds = F.coalesce(F.col("secret_kinds"), F.array().cast("array<string>"))
    secrets = F.transform(kinds, lambda k: found("secret-in-read", "critical", F.concat(F.lit("secret ["), k, F.lit("] in a file read by a remote-model agent"))))
    paths = F.array(
        F.when(S.is_sensitive(F.col("path"), globs), found("sensitive-path", "warn", F.lit("matched a sensitive-path policy glob"))),
        F.when(F.lit(flag_external) & S.is_external(F.col("path")), found("external-read", "warn", F.lit("read of a file outside the repository"))),
    )
    some = reads.where("remote") if require_remote else reads
    return some.select("*", F.explode(F.concat(secrets, F.array_compact(paths))).alias("_x")).select(*reads.columns, "_x.*")


def at_least(found: DataFrame, floor: str) -> DataFrame:
    return found.where(S.severity_rank(F.col("severity")) >= S.severity_rank(F.lit(floor)))


def excluded(rows: DataFrame, column: str, globs: Iterable[str]) -> DataFrame:
    """Rows that no exclusion glob matches; * crosses directories."""
    globs = tuple(globs)
    return rows.where(~S.matches_any(F.col(column), globs, crossing=True)) if globs else rows


def scan(files: DataFrame) -> DataFrame:
    """(path, kinds) of files (path, text) that hold secrets; the values are never shown."""
    return files.select("path", S.secret_kinds(F.col("text")).alias("kinds")).where(F.size("kinds") > 0)
