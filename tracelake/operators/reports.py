"""Reports over sessions, commits and files. Drift, reads and sessions span all repositories, file figures one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def histogram(risks: DataFrame) -> DataFrame:
    """One row: how many artifacts (apriori, aposteriori) are green, yellow and red, and how many looked safe and proved dangerous."""
    fused, gold = S.fuse(F.col("apriori"), F.col("aposteriori")), S.transition(F.col("apriori"), F.col("aposteriori")) == "safe_to_dangerous"
    return risks.select(S.band(fused).alias("band"), gold.alias("gold")).agg(
        *(F.count_if(F.col("band") == b).alias(b) for b in ("green", "yellow", "red")), F.count_if("gold").alias("gold"), F.count("*").alias("artifacts")
    )


def top_risk(risks: DataFrame, k: int) -> DataFrame:
    """The k riskiest; zero risk goes after the cut."""
    return risks.orderBy(F.desc("fused"), "id").limit(k).where("fused > 0")


def task_risk(edges: DataFrame, risks: DataFrame) -> DataFrame:
    """Each task's greatest risk among the artifacts it touched, 0 if it touched none that is known."""
    return edges.join(risks.select(F.col("id").alias("dst"), "fused"), "dst", "left").groupBy("src").agg(F.coalesce(F.max("fused"), F.lit(0.0)).alias("risk"))


def shared_versions(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(commit, agent): agent sessions that made a version which the commit recorded: edges on the same (artifact, version)."""
    kinds = tasks.select(F.col("id").alias("src"), F.col("source_adapter").isNotNull().alias("is_agent"))
    e = edges.join(kinds, "src")
    commits = e.where(~F.col("is_agent")).select(F.col("src").alias("commit"), "dst", "version")
    agents = e.where("is_agent").select(F.col("src").alias("agent"), "dst", "version")
    return commits.join(agents, ["dst", "version"]).where("commit <> agent").select("commit", "agent").distinct()


def provenance(behind: DataFrame, task_versions: DataFrame) -> DataFrame:
    """Per (commit, agent): the sorted union of what the agent read, the secret kinds by path, and its drift sets.

    read_secrets is array<struct<path, kinds>>, a row for each path with the union of its kinds; task_versions has
    task_id, reads, read_secrets, undeclared and phantom.
    """
    v = behind.join(task_versions.withColumnRenamed("task_id", "agent"), "agent")
    sorted_set = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    sets = v.groupBy("commit", "agent").agg(*(sorted_set(c).alias(c) for c in ("reads", "undeclared", "phantom")))
    kinds = v.select("commit", "agent", F.inline("read_secrets")).select("commit", "agent", "path", F.explode("kinds").alias("kind")).distinct()
    kinds = kinds.groupBy("commit", "agent", "path").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    kinds = kinds.groupBy("commit", "agent").agg(F.array_sort(F.collect_list(F.struct("path", "kinds"))).alias("read_secrets"))
    none = F.array().cast("array<struct<path: string, kinds: array<string>>>")
    return sets.join(kinds, ["commit", "agent"], "left").select("commit", "agent", "reads", F.coalesce("read_secrets", none).alias("read_secrets"), "undeclared", "phantom")


def compliance(commits: DataFrame, behind: DataFrame, agents: DataFrame) -> DataFrame:
    """Per commit (commit, reviewers): whether agents helped, whether someone else reviewed, which models, secret reads and drift."""
    facts = behind.join(agents, "agent").groupBy("commit").agg(F.count("*").alias("n_agents"), F.array_sort(F.collect_set("model")).alias("models"), F.sum("secret_reads").alias("secret_reads"), F.max("drift").alias("max_drift"))
    out = commits.join(facts, "commit", "left")
    assisted = F.coalesce(F.col("n_agents"), F.lit(0)) > 0
    return out.select(
        "commit", assisted.alias("ai_assisted"), (assisted & (F.size("reviewers") == 0)).alias("unreviewed"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), F.coalesce("secret_reads", F.lit(0)).cast("long").alias("secret_reads"), F.coalesce("max_drift", F.lit(0.0)).alias("max_drift")
    )


def compliance_total(per_commit: DataFrame) -> DataFrame:
    return per_commit.agg(F.count("*").alias("commits"), F.count_if("ai_assisted").alias("ai_assisted"), F.count_if("unreviewed").alias("unreviewed"), F.sum("secret_reads").alias("secret_reads"), F.count_if(F.col("max_drift") > 0).alias("drifted"))


def totals(sessions: DataFrame, commits: DataFrame, reads: DataFrame, verdicts: DataFrame, footprint: DataFrame) -> DataFrame:
    """One row of report figures: sessions, commits, drift incidents, reads with secrets and from outside, touched files and lines."""
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(sessions, F.count("*").alias("sessions")), one(commits, F.count("*").alias("commits")), one(verdicts, F.count("*").alias("drift_incidents")),
        one(reads, F.count_if(F.size("secret_kinds") > 0).alias("secret_reads"), F.count_if(S.is_external(F.col("path"))).alias("external_reads")),
        one(footprint, F.countDistinct("dst").alias("touched_files"), F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def today(versions: DataFrame, cutoff) -> DataFrame:
    """Sessions with a turn since `cutoff`: turns, last moment, last drift, secret reads; those that need attention first."""
    recent = versions.where(F.col("ts") >= cutoff)
    out = recent.groupBy("session").agg(F.count("*").alias("turns"), F.max("ts").alias("last"), F.max_by("drift", F.struct("ts", "id")).alias("drift"), F.sum("secret_reads").alias("secret_reads"))
    return out.withColumn("attention", (F.col("secret_reads") > 0) | (F.coalesce("drift", F.lit(0.0)) > 0)).orderBy(F.desc("attention"), F.desc("secret_reads"), F.desc("drift"), "session")


def touched_lines(touched: DataFrame, most: int = 8) -> DataFrame:
    """Per task its artifacts by falling risk, the first `most` listed and how many more there are."""
    rank = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("fused"), "path"))
    first = touched.withColumn("_rn", rank).where(F.col("_rn") <= most)
    order = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "path"))), lambda x: x["path"])
    listed = touched.groupBy("task").agg(F.count("*").alias("total")).join(first.groupBy("task").agg(order.alias("paths")), "task")
    return listed.select("task", "total", S.listed(F.col("paths"), F.col("total")).alias("touched"))


def session_summary(turns: DataFrame, head: int = 10) -> DataFrame:
    """Per session its first `head` summaries, a line each, and how many more turns there are."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy("ordinal", "summary"))
    first = turns.withColumn("_rn", rank).where(F.col("_rn") <= head)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "summary"))), lambda x: x["summary"])
    s = turns.groupBy("session").agg(F.count("*").alias("n")).join(first.groupBy("session").agg(ordered.alias("s")), "session")
    more = F.col("n") - head
    return s.select("session", F.concat(F.array_join("s", "\n"), F.when(more > 0, F.concat(F.lit("\n(+"), more.cast("string"), F.lit(" more turns)"))).otherwise("")).alias("summary"))


def attention_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("secret_reads"), F.desc("drift"))


def render(rows: DataFrame, form: str = "text", most: int = 1000) -> str:
    """A report's first `most` rows as text, markdown or JSON lines; the last line says how many more there are."""
    some, cut = rows.limit(most + 1).collect(), ""
    if len(some) > most:
        left, some = rows.count() - most, some[:most]
        cut = "\n" + (json.dumps({"more_rows": left}) if form == "json" else f"(+{left} more rows)")
    if form == "json":
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in some) + cut
    data = [[str(v) for v in r] for r in some]
    if form == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *data]) + cut
    wide = [max(map(len, c)) for c in zip(rows.columns, *data)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [rows.columns, *data]) + cut
