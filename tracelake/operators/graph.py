"""Views of the graph: snapshot, neighbours, context, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def snapshot(artifacts: DataFrame, tasks: DataFrame, contains: DataFrame, modifies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges to draw: all artifacts, commits (tasks without an adapter), containment and what commits changed."""
    commits = tasks.where("source_adapter IS NULL")
    nodes = artifacts.select("id", "level", "fused").union(commits.select("id", F.lit("task"), F.lit(0.0)))
    edges = contains.select(F.lit("contains").alias("kind"), "src", "dst").union(modifies.join(commits.select(F.col("id").alias("src")), "src", "left_semi").select(F.lit("modifies"), "src", "dst"))
    return nodes, edges.distinct()


def level_at(zoom: Column) -> Column:
    """Level of detail: what is drawn at a zoom; tasks from 1.2 on."""
    return F.when(zoom < 0.4, "repo").when(zoom < 0.8, "module").when(zoom < 1.6, "file").otherwise("symbol")


def visible(nodes: DataFrame, zoom: float) -> DataFrame:
    ranks = {"repo": 0, "module": 1, "file": 2, "symbol": 3}
    rank = lambda c: F.when(c == "repo", 0).when(c == "module", 1).when(c == "file", 2).when(c == "symbol", 3)
    now = 0 if zoom < 0.4 else 1 if zoom < 0.8 else 2 if zoom < 1.6 else 3
    assert len(ranks) == 4
    return nodes.where(F.when(F.col("level") == "task", F.lit(zoom >= 1.2)).otherwise(rank(F.col("level")) <= now))


def until(nodes: DataFrame, cutoff: Column) -> DataFrame:
    """Nodes up to a moment; highlighted ones always."""
    return nodes.where((F.col("ts") <= cutoff) | F.col("highlighted"))


def highlight(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """The tasks and what they point to."""
    hit = edges.join(tasks.select(F.col("id").alias("src")), "src", "left_semi")
    return tasks.select("id").union(hit.select("dst")).distinct()


def neighbours(edges: DataFrame, id_: Column) -> DataFrame:
    return edges.where(F.col("src") == id_).select(F.col("dst").alias("id"), "kind").union(edges.where(F.col("dst") == id_).select("src", "kind")).distinct()


def artifact_context(artifacts: DataFrame, edges: DataFrame, tasks: DataFrame, task_drift: DataFrame) -> DataFrame:
    """Each artifact with the agent sessions that touched it: how many, the last one, their greatest drift."""
    agents = tasks.where("source_adapter IS NOT NULL").select(F.col("id").alias("src"), "created_at")
    touched = edges.join(agents, "src").join(task_drift.select(F.col("task_id").alias("src"), "drift"), "src", "left")
    facts = touched.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("sessions"), F.max_by("src", F.struct("created_at", "src")).alias("last_session"), F.max("drift").alias("max_drift"))
    return artifacts.join(facts, "id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0))).withColumn("max_drift", F.coalesce("max_drift", F.lit(0.0)))


def enclosing_symbol(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """The narrowest symbol (file, path, first, last) around each line (file, line)."""
    inside = lines.join(spans, "file").where(F.col("line").between(F.col("first"), F.col("last")))
    return inside.groupBy("file", "line").agg(F.min_by("path", F.struct(F.col("last") - F.col("first"), "first", "path")).alias("symbol"))


def diff_of(versions: DataFrame, parents: DataFrame) -> DataFrame:
    """Each version's diff: its own, else its parent's at the same source, else its parent's latest."""
    same = parents.select(F.col("artifact_id").alias("parent_id"), F.col("source").alias("source"), F.col("diff").alias("_same")).dropDuplicates(["parent_id", "source"])
    last = parents.where("diff IS NOT NULL").groupBy(F.col("artifact_id").alias("parent_id")).agg(F.max_by("diff", F.struct("ts", "id")).alias("_last"))
    out = versions.join(same, ["parent_id", "source"], "left").join(last, "parent_id", "left")
    return out.withColumn("diff", F.coalesce("diff", "_same", "_last")).drop("_same", "_last")


def commit_detail(edges: DataFrame, artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of each commit in path order with the recorded version, or the artifact's latest where that is unknown."""
    last = versions.groupBy("artifact_id").agg(F.max_by("id", F.struct("ts", "id")).alias("_latest"))
    known = versions.select(F.col("id").alias("version"), F.lit(True).alias("_known"))
    out = edges.join(artifacts.select(F.col("id").alias("dst"), "path"), "dst").join(known, "version", "left").join(last.withColumnRenamed("artifact_id", "dst"), "dst", "left")
    return out.select(F.col("src").alias("commit"), "path", F.when(F.col("_known"), F.col("version")).otherwise(F.col("_latest")).alias("version"))


def attribution(commit_files: DataFrame) -> DataFrame:
    """(commit, path, first, last): line ranges that each commit's diffs wrote."""
    return commit_files.select("commit", "path", F.inline(S.hunks(F.col("diff"))))
