"""Graph views, provenance, compliance and reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import dlp, graph, reports
from .queries_text import reads
from .standins import instant, table

EDGES = "e AS (SELECT l_orderkey AS src, l_partkey AS dst, min(l_suppkey) AS version, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2), t AS (SELECT o_orderkey AS id, o_orderkey % 2 = 1 AS agent, o_orderdate AS created_at, o_totalprice AS risk FROM orders)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_suppkey").alias("version"), F.sum("l_quantity").cast("long").alias("lines"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 1, "agent").alias("source_adapter"), instant("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("risk"))


def behind(spark: SparkSession, d: str) -> DataFrame:
    return reports.shared_versions(edges(spark, d), tasks(spark, d))


SHARED = f"{EDGES}, b AS (SELECT DISTINCT c.src AS commit, a.src AS agent FROM e c JOIN t tc ON tc.id = c.src AND NOT tc.agent JOIN e a ON a.dst = c.dst AND a.version = c.version JOIN t ta ON ta.id = a.src AND ta.agent WHERE a.src <> c.src)"


@query(f"WITH {SHARED} SELECT commit, agent FROM b")
def shared_version(spark: SparkSession, d: str) -> DataFrame:
    return behind(spark, d)


@query(f"""WITH {SHARED}, tv AS (SELECT l_orderkey AS agent, l_returnflag || l_linestatus AS read, CASE WHEN l_linenumber < 3 THEN 'k' || (l_suppkey % 3) END AS kind FROM lineitem),
k AS (SELECT commit, agent, read, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds FROM b JOIN tv USING (agent) WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT commit, agent, array_to_string(list_sort(list(read || '=' || kinds)), ',') AS secrets FROM k GROUP BY 1, 2)
SELECT commit, agent, array_to_string(list_sort(list_distinct(list(read))), ',') AS reads, coalesce(any_value(secrets), '') AS secrets FROM b JOIN tv USING (agent) LEFT JOIN p USING (commit, agent) GROUP BY 1, 2""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """A line is a read, and of the first two lines of an order one that found a secret."""
    none, path = F.array().cast("array<string>"), F.concat("l_returnflag", "l_linestatus")
    found = F.array(F.struct(path.alias("path"), F.array(F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string"))).alias("kinds")))
    secrets = F.when(F.col("l_linenumber") < 3, found).otherwise(F.array().cast("array<struct<path: string, kinds: array<string>>>"))
    tv = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.array(path).alias("reads"), secrets.alias("read_secrets"), none.alias("undeclared"), none.alias("phantom"))
    shown = F.transform("read_secrets", lambda x: F.concat(x["path"], F.lit("="), F.array_join(x["kinds"], "+")))
    return reports.provenance(behind(spark, d), tv).select("commit", "agent", F.array_join("reads", ",").alias("reads"), F.array_join(shown, ",").alias("secrets"))


COMPL = f"""{SHARED}, ag AS (SELECT id AS agent, 'm' || (id % 3) AS model, id % 5 AS secret_reads, (id % 4)::DOUBLE / 4 AS drift FROM t WHERE agent),
f AS (SELECT commit, count(*) AS n, array_to_string(list_sort(list_distinct(list(model))), ',') AS models, sum(secret_reads)::BIGINT AS s, max(drift) AS d FROM b JOIN ag USING (agent) GROUP BY 1),
c AS (SELECT t.id AS commit, n IS NOT NULL AS ai_assisted, n IS NOT NULL AND t.id % 4 <> 0 AS unreviewed, coalesce(models, '') AS models, coalesce(s, 0) AS secret_reads, coalesce(d, 0)::DOUBLE AS max_drift FROM t LEFT JOIN f ON f.commit = t.id WHERE NOT t.agent)"""


def per_commit(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d)
    commits = t.where("source_adapter IS NULL").select(F.col("id").alias("commit"), F.when(F.col("id") % 4 == 0, F.array(F.lit("Grace"))).otherwise(F.array().cast("array<string>")).alias("reviewers"))
    agents = t.where("source_adapter IS NOT NULL").select(F.col("id").alias("agent"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), (F.col("id") % 5).alias("secret_reads"), ((F.col("id") % 4).cast("double") / 4).alias("drift"))
    return reports.compliance(commits, behind(spark, d), agents)


@query(f"WITH {COMPL} SELECT * FROM c")
def compliance(spark: SparkSession, d: str) -> DataFrame:
    return per_commit(spark, d).withColumn("models", F.array_join("models", ","))


@query(f"WITH {COMPL} SELECT count(*) AS commits, count(*) FILTER (ai_assisted) AS ai_assisted, count(*) FILTER (unreviewed) AS unreviewed, sum(secret_reads)::BIGINT AS secret_reads, count(*) FILTER (max_drift > 0) AS drifted FROM c")
def compliance_total(spark: SparkSession, d: str) -> DataFrame:
    return reports.compliance_total(per_commit(spark, d))


@query(f"WITH {EDGES}, r AS (SELECT p_partkey AS id, (p_size % 21)::DOUBLE / 20 AS fused FROM part) SELECT src, max(coalesce(fused, 0)) AS risk FROM e LEFT JOIN r ON r.id = e.dst GROUP BY 1")
def task_risk(spark: SparkSession, d: str) -> DataFrame:
    risks = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 21).cast("double") / 20).alias("fused"))
    return reports.task_risk(edges(spark, d), risks)


@query(f"""WITH {EDGES}, r AS (SELECT src, (p_size % 21)::DOUBLE / 20 AS f, p_name || '#' || p_partkey AS p FROM e JOIN part ON p_partkey = dst), l AS (SELECT src, list(p ORDER BY f DESC, p) AS ps FROM r GROUP BY 1)
SELECT src AS task, len(ps) AS total, array_to_string(ps[1:3], ', ') || CASE WHEN len(ps) > 3 THEN ' +' || (len(ps) - 3) || ' more' ELSE '' END AS touched FROM l""")
def touched_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("dst"), ((F.col("p_size") % 21).cast("double") / 20).alias("fused"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("path"))
    return reports.touched_lines(edges(spark, d).join(parts, "dst").select(F.col("src").alias("task"), "fused", "path"), 3)


@query(f"""WITH {EDGES}, {{r}}, s AS (SELECT count(*) FILTER (agent) AS sessions, count(*) FILTER (NOT agent) AS commits, count(*) FILTER (agent AND id % 4 = 1) AS drift_incidents FROM t),
x AS (SELECT count(*) FILTER (len(kinds) > 0) AS secret_reads, count(*) FILTER (path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:')) AS external_reads FROM r), f AS (SELECT count(DISTINCT dst) AS touched_files, sum(lines)::BIGINT AS lines_added, 0::BIGINT AS lines_removed FROM e JOIN t ON t.id = src AND agent)
SELECT * FROM s, x, f""".replace("{r}", __import__("tracelake.plans.queries_text", fromlist=["READS"]).READS))
def report(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d)
    agents = t.where("source_adapter IS NOT NULL")
    footprint = edges(spark, d).join(agents.select(F.col("id").alias("src")), "src", "left_semi").select("dst", F.col("lines").alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))
    return reports.totals(agents, t.where("source_adapter IS NULL"), reads(spark, d), agents.where("id % 4 = 1"), footprint)


@query("""WITH v AS (SELECT user_id AS session, event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / 100, 4) END AS drift, event_id % 4 AS s FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR),
a AS (SELECT session, count(*) AS turns, max(ts) AS last, arg_max_null(drift, (ts, id)) AS drift, sum(s)::BIGINT AS secret_reads FROM v GROUP BY 1) SELECT *, secret_reads > 0 OR coalesce(drift, 0) > 0 AS attention FROM a""")
def today(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cutoff = e.agg((F.max("ts") - F.expr("INTERVAL 6 HOURS")).alias("cutoff"))
    v = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 100, 4)).alias("drift"), (F.col("event_id") % 4).alias("secret_reads"))
    return reports.today(v.crossJoin(F.broadcast(cutoff)), F.col("cutoff"))


NODES = "n AS (SELECT 'r' || r_regionkey AS id, 'repo' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'module' FROM nation UNION ALL SELECT 'c' || c_custkey, 'file' FROM customer), k AS (SELECT 'contains' AS kind, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'contains', 'n' || c_nationkey, 'c' || c_custkey FROM customer), m AS (SELECT DISTINCT 'modifies' AS kind, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders WHERE o_orderkey % 2 = 0)"


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def view(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation, customer, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    nodes = region.select(_id("r", "r_regionkey").alias("id"), F.lit("repo").alias("level")).union(nation.select(_id("n", "n_nationkey"), F.lit("module"))).union(customer.select(_id("c", "c_custkey"), F.lit("file")))
    contains = nation.select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst")).union(customer.select(_id("n", "c_nationkey"), _id("c", "c_custkey")))
    done = orders.select(_id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"))
    t = orders.select(_id("o", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 1, "agent").alias("source_adapter"))
    return graph.snapshot(nodes.withColumn("fused", F.lit(0.0)), t, contains, done)


@query(f"WITH {NODES} SELECT level AS kind, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'task', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT kind, count(*) FROM (SELECT * FROM k UNION ALL SELECT * FROM m) GROUP BY 1")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = view(spark, d)
    return nodes.groupBy(F.col("level").alias("kind")).agg(F.count("*").alias("n")).union(links.groupBy("kind").agg(F.count("*").alias("n")))


@query(f"WITH {NODES}, t AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_custkey % 50 = 0 AND o_orderkey % 2 = 0) SELECT id FROM t UNION SELECT dst FROM m JOIN t ON t.id = m.src")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").where("o_custkey % 50 = 0 AND o_orderkey % 2 = 0").select(_id("o", "o_orderkey").alias("id"))
    return graph.highlight(view(spark, d)[1], t)


@query(f"WITH {NODES}, x AS (SELECT * FROM k UNION ALL SELECT * FROM m) SELECT dst AS id, kind FROM x WHERE src = 'n3' UNION SELECT src, kind FROM x WHERE dst = 'n3'")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(view(spark, d)[1], F.lit("n3"))


@query(f"WITH {NODES} SELECT level, count(*) AS n FROM n WHERE level IN ('repo', 'module') GROUP BY 1")
def lod(spark: SparkSession, d: str) -> DataFrame:
    return graph.visible(view(spark, d)[0], 0.7).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id FROM events WHERE ts <= TIMESTAMP '2024-01-10' OR event_id % 100 = 0")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", (F.col("event_id") % 100 == 0).alias("highlighted"))
    return graph.until(e, F.expr("TIMESTAMP_NTZ '2024-01-10'")).select("id")


@query(f"""WITH {EDGES}, x AS (SELECT e.dst, e.src, t.created_at, (t.id % 4)::DOUBLE / 4 AS drift FROM e JOIN t ON t.id = e.src AND t.agent), a AS (SELECT dst, count(DISTINCT src) AS sessions, arg_max(src, (created_at, src)) AS last_session, max(drift) AS max_drift FROM x GROUP BY 1)
SELECT p_partkey AS id, coalesce(sessions, 0) AS sessions, last_session, coalesce(max_drift, 0)::DOUBLE AS max_drift FROM part LEFT JOIN a ON dst = p_partkey""")
def artifact_context(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d)
    drift = t.select(F.col("id").alias("task_id"), ((F.col("id") % 4).cast("double") / 4).alias("drift"))
    return graph.artifact_context(table(spark, d, "part").select(F.col("p_partkey").alias("id")), edges(spark, d), t, drift)


@query("""WITH s AS (SELECT l_orderkey AS f, l_partkey AS p, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) AS z FROM lineitem), l AS (SELECT o_orderkey AS f, (o_orderkey % 20)::INTEGER AS line FROM orders)
SELECT l.f AS file, l.line, arg_min(p, (z - a, a, p)) AS symbol FROM l JOIN s USING (f) WHERE line BETWEEN a AND z GROUP BY 1, 2""")
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("last"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 20).cast("int").alias("line"))
    return graph.enclosing_symbol(spans, lines)


@query("""WITH p AS (SELECT n_regionkey AS parent_id, n_nationkey % 3 AS source, n_name AS diff, n_nationkey AS id FROM nation), one AS (SELECT parent_id, source, min(diff) AS diff FROM p GROUP BY 1, 2), last AS (SELECT parent_id, arg_max(diff, id) AS diff FROM p GROUP BY 1)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, one.diff, last.diff) AS diff FROM customer LEFT JOIN one ON one.parent_id = c_nationkey % 6 AND one.source = c_custkey % 4 LEFT JOIN last ON last.parent_id = c_nationkey % 6""")
def diff_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 6).alias("parent_id"), (F.col("c_custkey") % 4).cast("int").alias("source"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("diff"))
    nation = table(spark, d, "nation")
    parents = nation.groupBy(F.col("n_regionkey").alias("artifact_id"), (F.col("n_nationkey") % 3).alias("source")).agg(F.min("n_name").alias("diff"))
    latest = nation.groupBy(F.col("n_regionkey").alias("artifact_id")).agg(F.max_by("n_name", "n_nationkey").alias("diff"))
    both = parents.select("artifact_id", "source", "diff", F.lit(0).alias("ts"), F.col("source").alias("id")).union(latest.select("artifact_id", F.lit(99), "diff", F.lit(1), F.lit(99)))
    return graph.diff_of(c, both).select("id", "diff")


@query(f"""WITH {EDGES}, v AS (SELECT DISTINCT l_partkey AS artifact_id, l_partkey || ':' || l_suppkey AS id, l_suppkey AS ts FROM lineitem WHERE l_suppkey % 3 <> 0), last AS (SELECT artifact_id, arg_max(id, ts) AS id FROM v GROUP BY 1)
SELECT src AS commit, p_name AS path, coalesce(v.id, last.id) AS version FROM e JOIN part ON p_partkey = dst LEFT JOIN v ON v.id = dst || ':' || version LEFT JOIN last ON last.artifact_id = dst WHERE src % 2 = 0""")
def commit_detail(spark: SparkSession, d: str) -> DataFrame:
    name = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    e = edges(spark, d).where("src % 2 = 0").withColumn("version", name("dst", "version"))
    artifacts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"))
    v = table(spark, d, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_partkey").alias("artifact_id"), name("l_partkey", "l_suppkey").alias("id"), F.col("l_suppkey").alias("ts")).distinct()
    return graph.commit_detail(e, artifacts, v)


@query("SELECT user_id AS task_id, event_type AS path, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2")
def guard_reads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("path"))
    return dlp.excluded(e, "path", ("view", "cli*", "sign?p")).groupBy("task_id", "path").agg(F.count("*").alias("n"))
