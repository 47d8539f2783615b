"""Payloads, retention, checkpoints, writes and lookups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import payload, tables
from .standins import table


@query("SELECT doc_id, 'sha256:' || sha256(text) AS ref FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.content_ref(F.col("text")).alias("ref"))


@query("SELECT DISTINCT 'sha256:' || sha256(text) AS ref, strlen(text) AS bytes FROM documents")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    return payload.put(table(spark, d, "documents"), "text").select("ref", F.octet_length("content").cast("long").alias("bytes"))


@query("""SELECT count(*) FILTER (doc_id % 10 > 1) AS ok, count(*) FILTER (doc_id % 10 = 1) AS corrupt, count(*) FILTER (doc_id % 10 = 0) AS missing FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1)""")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    refs = one.select(S.content_ref(F.col("text")).alias("ref"))
    store = one.where("doc_id % 10 > 0").select(S.content_ref(F.col("text")).alias("ref"), F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return payload.integrity(refs, store)


@query("""SELECT DISTINCT ref FROM (SELECT md5(text) AS ref FROM documents UNION ALL SELECT md5(text) FROM conversations UNION ALL SELECT md5(text) FROM benchmark) WHERE ref IS NOT NULL""")
def payload_refs(spark: SparkSession, d: str) -> DataFrame:
    return payload.references(*((table(spark, d, t).select(F.md5("text").alias("r")), "r") for t in ("documents", "conversations", "benchmark")))


RET = "o AS (SELECT o_orderkey AS id, o_custkey AS task_id, o_orderdate AS ts, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'r' || (o_custkey % 50) END AS ref, o_orderkey % 7 = 0 AS purged FROM orders), g AS (SELECT * FROM o WHERE ts < TIMESTAMP '1996-06-01' AND NOT purged AND ref IS NOT NULL)"


def retained(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("ts"), F.when(k % 9 != 0, F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string"))).alias("ref"), (k % 7 == 0).alias("payload_purged"))


CUT = "TIMESTAMP_NTZ '1996-06-01'"


@query(f"WITH {RET} SELECT id, ref FROM g")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return payload.due(retained(spark, d), F.expr(CUT)).select("id", "ref")


@query(f"WITH {RET}, live AS (SELECT DISTINCT ref FROM o WHERE ref IS NOT NULL AND NOT purged AND id NOT IN (SELECT id FROM g)) SELECT (SELECT count(*) FROM g) AS targets, (SELECT count(DISTINCT task_id) FROM g) AS tasks, (SELECT count(DISTINCT ref) FROM g WHERE ref NOT IN (SELECT ref FROM live)) AS shredded")
def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    v = retained(spark, d)
    store = v.where("ref IS NOT NULL").select("ref").distinct().withColumn("content", F.lit(b""))
    return payload.purge(v, store, F.expr(CUT))[2]


@query("SELECT user_id AS checkpoint_id, max(ts) AS at, count(*) AS files FROM events GROUP BY 1")
def checkpoint_list(spark: SparkSession, d: str) -> DataFrame:
    return payload.checkpoints(table(spark, d, "events").select(F.col("user_id").alias("checkpoint_id"), F.col("ts").alias("at")))


@query("SELECT (SELECT count(*) FROM events) AS n0, (SELECT max(ts) FROM events) AS last0, (SELECT count(*) FROM conversations) AS n1")
def generation(spark: SparkSession, d: str) -> DataFrame:
    return tables.generation((table(spark, d, "events"), "ts"), (table(spark, d, "conversations"), None))


@query("SELECT DISTINCT source AS repo FROM documents")
def distinct_repos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("repo")).distinct().orderBy("repo")


UP = "n AS (SELECT c_custkey AS id, c_name AS name, 0 AS v FROM customer UNION ALL SELECT c_custkey, c_name || '!', 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, 1 FROM customer WHERE c_custkey % 5 = 0)"


@query(f"WITH {UP} SELECT id, name, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS rn FROM n) WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("!")).alias("name"), F.lit(1).alias("v"))
    new = new.union(c.where("c_custkey % 5 = 0").select(F.col("c_custkey") + 1000000, "c_name", F.lit(1)))
    return tables.upsert(old, new, ["id"], ["v"])


@query("SELECT l_orderkey AS src, l_partkey AS dst, min(l_linenumber) AS v FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2")
def append_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("v"))
    return tables.append_new(e.where("v = 1"), e, ["src", "dst"], ["v"])


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 0 ELSE p_retailprice END AS price, p_size > 25 AS purged FROM part WHERE p_partkey % 10 <> 3")
def update_delete(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.lit(False).alias("purged"), "p_size")
    marked = tables.update(p, F.col("p_size") > 25, price=F.lit(0.0), purged=F.lit(True))
    return tables.delete(marked, F.col("id") % 10 == 3).drop("p_size")


@query("SELECT event_id AS id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    return tables.audit_tail(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "event_type"), 50)


@query("SELECT n_nationkey AS id, n_name AS path FROM nation WHERE n_regionkey = 2")
def children(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path")).orderBy("path")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7 UNION ALL SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 1)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return o.where("id = 7").drop("o_custkey").union(o.where("o_custkey = 10").orderBy("id").limit(1).drop("o_custkey"))


@query("SELECT event_id AS id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts")
    since = S.parse_since("24h")
    latest = e.agg((F.max("ts") - F.expr(f"INTERVAL {since} SECONDS")).alias("cutoff"))
    return e.crossJoin(F.broadcast(latest)).where("ts >= cutoff").drop("cutoff")


@query("SELECT doc_id, sha FROM (SELECT doc_id, sha256(text) AS sha FROM documents) WHERE sha LIKE 'a%'")
def sha_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).where(F.col("sha").startswith("a"))


@query("SELECT doc_id, source FROM documents WHERE NOT (source LIKE 'src1%' OR source = 'src0')")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import dlp

    return dlp.excluded(table(spark, d, "documents").select("doc_id", "source"), "source", ("src1*", "src0"))


@query("""WITH n AS (SELECT l_orderkey AS sha, l_partkey AS rel_path, CAST(sum(l_quantity) AS INTEGER) AS a, CAST(sum(l_linenumber) AS INTEGER) AS r FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2), s AS (SELECT l_orderkey AS sha, l_partkey AS rel_path, min(l_returnflag) AS status FROM lineitem GROUP BY 1, 2)
SELECT sha, rel_path, status, coalesce(a, 0) AS lines_added, coalesce(r, 0) AS lines_removed FROM s LEFT JOIN n USING (sha, rel_path)""")
def numstat_join(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import git

    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("rel_path"), "l_quantity", "l_linenumber", "l_returnflag")
    numstat = li.where("l_linenumber % 2 = 1").groupBy("sha", "rel_path").agg(F.sum("l_quantity").cast("int").alias("lines_added"), F.sum("l_linenumber").cast("int").alias("lines_removed"))
    return git.with_numstat(li.groupBy("sha", "rel_path").agg(F.min("l_returnflag").alias("status")), numstat)


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key, other = "00112233445566778899aabbccddeeff" * 2, "ffeeddccbbaa99887766554433221100" * 2
    store = payload.put(table(spark, d, "documents"), "text")
    opened = payload.open_sealed(payload.rewrap(payload.seal(store, key), key, other), other)
    return opened.select("ref", S.is_intact(F.col("ref"), F.col("content")).alias("intact"))


query("SELECT DISTINCT 'sha256:' || sha256(text) AS ref, TRUE AS intact FROM documents")(sealed_round_trip)
