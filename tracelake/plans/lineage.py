"""Identity of files over a repository's history, for all commits at once.

A path's life runs from a commit that has it to the one that deletes it. A commit that deletes some paths and adds
others is a scope for identity.resolve: what matches is a rename or a move, and the new path's life goes on from the old
one's. A path that comes back without a match goes on from its own earlier life. Lives point to the one they go on from,
and pointer jumping finds the first: the artifact. So commits need not be folded one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import identity
from ..operators.coupling import checkpointed


def lives(commit_files: DataFrame) -> DataFrame:
    """commit_files with `life` (a number for each path), the content before, and whether the row begins a life."""
    w = Window.partitionBy("repo", "rel_path").orderBy("timestamp", "sha")
    before = F.lag("content").over(w)
    starts = F.col("content").isNotNull() & before.isNull()
    rows = commit_files.withColumn("starts", starts).withColumn("before", before)
    return rows.withColumn("life", F.sum(F.col("starts").cast("int")).over(w))


def renames(rows: DataFrame, least: float = identity.THRESHOLD) -> DataFrame:
    """(repo, sha, path, life, from_path, from_life, status): which life goes on from which, by content within a commit."""
    scope = F.concat_ws(S.UNIT, "repo", "sha")
    gone = rows.where("content IS NULL AND before IS NOT NULL").select(scope.alias("scope"), F.col("rel_path").alias("path"), F.col("life").cast("string").alias("id"), F.md5("before").alias("hash"), S.line_shingles(F.col("before")).alias("shingles"))
    new = rows.where("starts").select(scope.alias("scope"), F.col("rel_path").alias("path"), F.md5("content").alias("hash"), S.line_shingles(F.col("content")).alias("shingles"))
    resolved, _ = identity.resolve(gone, new, least)
    found = resolved.where("status IN ('renamed', 'moved')")
    part = lambda i: F.split("scope", S.UNIT)[i]
    to = rows.where("starts").select("repo", "sha", F.col("rel_path").alias("path"), "life")
    return found.select(part(0).alias("repo"), part(1).alias("sha"), "path", F.col("from_path"), F.col("id").cast("long").alias("from_life"), "status").join(to, ["repo", "sha", "path"])


def artifacts(commit_files: DataFrame, least: float = identity.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(repo, path, life, artifact_id) of every life, and the renames."""
    rows = checkpointed(lives(commit_files))
    moved = checkpointed(renames(rows, least))
    name = lambda path, life: F.concat_ws(S.UNIT, "repo", path, F.col(life).cast("string"))
    every = rows.where("life > 0").select("repo", F.col("rel_path").alias("path"), "life").distinct().withColumn("node", name("path", "life"))
    by_rename = moved.select(name("path", "life").alias("node"), name("from_path", "from_life").alias("up"))
    earlier = F.when(F.col("life") > 1, F.concat_ws(S.UNIT, "repo", "path", (F.col("life") - 1).cast("string")))
    up = every.withColumn("earlier", earlier).join(by_rename, "node", "left").select("node", F.coalesce("up", "earlier", "node").alias("up"))
    up = checkpointed(up)
    while True:
        step = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
        step = checkpointed(step)
        if step.where("moved").isEmpty():
            break
        up = step.select("node", "up")
    roots = every.join(up, "node").select("repo", "path", "life", F.split("up", S.UNIT).alias("r"))
    return roots.select("repo", "path", "life", S.content_id("art", F.col("r")[0], F.lit("file"), F.col("r")[1], F.col("r")[2]).alias("artifact_id")), moved
