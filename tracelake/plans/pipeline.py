"""The engine's own jobs: facts from commits, declarations from transcripts, risk, and the hybrid query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import coupling, drift, history, search


def file_versions(commit_files: DataFrame) -> DataFrame:
    """Versions of file artifacts, in the chain operators' columns, from commit_files."""
    fingerprint = F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 32)
    artifact = S.content_id("art", F.col("repo"), F.lit("file"), F.col("rel_path"))
    return commit_files.select(
        "repo", artifact.alias("artifact_id"), S.content_id("ver", artifact, F.col("sha"), F.col("timestamp"), S.author_key(F.col("author_email"), F.col("author_name"))).alias("id"),
        F.col("timestamp").alias("ts"), F.when(F.col("content").isNull(), "").otherwise(fingerprint).alias("fingerprint"), (F.col("lines_added") + F.col("lines_removed")).cast("long").alias("lines"),
        F.col("sha").alias("commit"), F.col("rel_path").alias("path"), F.when(F.col("content").isNull(), "deleted").otherwise("modified").alias("change_kind"),
    )


def commit_tasks(commit_files: DataFrame) -> DataFrame:
    """One task for each commit."""
    one = commit_files.groupBy("repo", "sha").agg(*(F.min(c).alias(c) for c in ("timestamp", "author_name", "author_email", "message")))
    return one.select(S.content_id("tsk", F.col("repo"), F.col("sha")).alias("id"), "repo", "sha", F.col("timestamp").alias("created_at"), "author_name", "author_email", "message", S.review_trailers(F.col("message")).alias("reviewers"), F.lit(None).cast("string").alias("source_adapter"))


def task_edges(versions: DataFrame) -> DataFrame:
    """What each commit modified; the first version of an artifact in a commit stays."""
    first = F.min_by(F.struct(F.col("id").alias("version"), "change_kind", "lines"), F.struct("ts", "id"))
    return versions.groupBy(S.content_id("tsk", F.col("repo"), F.col("commit")).alias("src"), F.col("artifact_id").alias("dst")).agg(first.alias("x")).select(F.lit("task_modifies_artifact").alias("kind"), "src", "dst", "x.*")


def declared_turns(turn_rows: DataFrame) -> DataFrame:
    """Turns with the paths declared so far in their session and the session's span."""
    so_far = drift.cumulative(turn_rows, "session_id", ["ordinal"], "declared")
    start = F.min("timestamp").over(Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return so_far.withColumn("started", start)


def observe(turn_rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Each turn's drift: paths declared so far against files of the session's repository that changed within its span, half an hour to either side. Turns: repo, null where it isn't known; versions: repo, path, ts."""
    t = declared_turns(turn_rows).withColumns({"key": F.col("repo"), "first": F.col("started"), "last": F.col("timestamp")})
    return drift.observed(t, versions.select(F.col("repo").alias("key"), "ts", "path")).drop("key", "first", "last")


def session_repo(turn_rows: DataFrame, versions: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """Adds `repo`, the repository that a session's directory belongs to.

    By `roots` (repository to its directory, a stated list): the deepest root around the directory. Without roots, the
    deepest part of the directory that is a known repository's last name; where only one repository is known, that one.
    """
    if roots:
        found = F.lit(None).cast("string")
        for repo, root in sorted(roots.items(), key=lambda x: len(x[1].rstrip("/"))):
            found = F.when(S.in_scope(F.col("cwd"), root), F.lit(repo)).otherwise(found)
        return turn_rows.withColumn("repo", found)
    repos = versions.select("repo").distinct()
    names = repos.select("repo", F.substring_index("repo", "/", -1).alias("name"))
    parts = turn_rows.select("cwd").distinct().select("cwd", F.posexplode(F.split("cwd", "/")).alias("at", "name"))
    homes = parts.join(names, "name").groupBy("cwd").agg(F.max_by("repo", F.struct("at", "repo")).alias("_home"))
    only = repos.agg(F.when(F.count("*") == 1, F.min("repo")).alias("_only"))
    return turn_rows.join(homes, "cwd", "left").crossJoin(F.broadcast(only)).withColumn("repo", F.coalesce("_home", "_only")).drop("_home", "_only")  # one row


def recompute_risk(versions: DataFrame, task_drift: DataFrame | None = None, window_s: int = history.FIX_WINDOW_S) -> DataFrame:
    """Risk of every artifact from its history, its coupling, its last change and the worst drift on its path.

    All within its repository: churn decays from the repository's own last version, equal shas of two repositories are
    two commits, and drift (drift, and repo where it is known) counts for paths of that repository.
    """
    pairs = coupling.cochange(versions.select(F.concat_ws(S.UNIT, "repo", "commit").alias("commit"), F.col("artifact_id").alias("file")))
    pairs = coupling.checkpointed(pairs)
    deg = coupling.degree(coupling.depends_on(pairs)).withColumnRenamed("id", "artifact_id")
    blast = coupling.blast_radius(pairs).withColumnRenamed("id", "artifact_id")
    out = history.signals(versions, window_s=window_s, scope="repo").join(deg, "artifact_id", "left").join(blast, "artifact_id", "left").join(history.latest_diff(versions).select("artifact_id", "diff_size"), "artifact_id", "left")
    if task_drift is not None:
        repo = "repo" if "repo" in task_drift.columns else F.lit(None).cast("string").alias("repo")
        worst = task_drift.select(repo, F.explode("drift.undeclared").alias("path"), F.col("drift.score").alias("drift")).groupBy("repo", "path").agg(F.max("drift").alias("drift"))
        paths = versions.select("repo", "artifact_id", "path").distinct()
        named, open_ = paths.join(worst.where("repo IS NOT NULL"), ["repo", "path"]), paths.join(worst.where("repo IS NULL").drop("repo"), "path")
        out = out.join(named.select("artifact_id", "drift").union(open_.select("artifact_id", "drift")).groupBy("artifact_id").agg(F.max("drift").alias("drift")), "artifact_id", "left")
    return history.risk(out.fillna(0, ["degree", "blast", "diff_size"]))


def debug_query(embeddings: DataFrame, tasks: DataFrame, edges: DataFrame, risks: DataFrame, versions: DataFrame, query: list[float], k: int = 8) -> tuple[DataFrame, DataFrame]:
    """The k best tasks for a question's vector, and up to twenty versions of the riskiest artifacts they touched."""
    from ..operators import reports

    pool = search.top_k(embeddings, query, search.POOL * k)
    now = tasks.agg(F.max("created_at").alias("now"))
    scored = pool.join(tasks.select("id", "created_at"), "id").join(reports.task_risk(edges, risks).withColumnRenamed("src", "id"), "id", "left").fillna(0.0, ["risk"]).crossJoin(F.broadcast(now))
    hits = search.hybrid(scored, k, F.col("now"))
    touched = edges.join(F.broadcast(hits.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("artifact_id")).distinct()
    ranked = touched.join(risks.select(F.col("id").alias("artifact_id"), "fused"), "artifact_id")
    return hits, history.top_versions(versions, ranked)
