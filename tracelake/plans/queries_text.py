"""Secrets, policies, trailers, patches and summaries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import dlp, reports
from .standins import table

ENV = S.ENV_SECRET.replace("'", "''")
KINDS = {"private_key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", **{k: v for k, v in S.SECRETS.items() if k != "private_key"}, "url_credentials": S.URL_CREDENTIALS, "env_secret": ENV}
SQL_KINDS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in KINDS.items()) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, array_to_string({SQL_KINDS}, ',') AS kinds FROM documents WHERE len({SQL_KINDS}) > 0")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return dlp.scan(files).select(F.col("path").alias("doc_id"), F.array_join("kinds", ",").alias("kinds"))


def _replaced(sql: str) -> str:
    for k, p in list(KINDS.items())[:-2]:
        sql = f"regexp_replace({sql}, '{p}', '[REDACTED:{k}]', 'g')"
    sql = f"regexp_replace({sql}, '{S.URL_CREDENTIALS}', '\\1[REDACTED:url_credentials]\\3', 'g')"
    return f"regexp_replace({sql}, '{ENV}', '\\1\\2[REDACTED:env_secret]', 'g')"


@query(f"SELECT doc_id, md5({_replaced('text')}) AS digest, length({_replaced('text')}) AS n FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.scrub_secrets(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{32,}'))) AS token FROM documents),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT doc_id, token, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT doc_id, md5(token) AS token, round(-sum(((k::DOUBLE / length(token)) * log2(k::DOUBLE / length(token)))::DECIMAL(18,12))::DOUBLE, 6) AS entropy FROM n GROUP BY doc_id, token""")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({S.OPAQUE})"), F.lit(1)))).alias("token"))
    return tokens.withColumn("entropy", F.round(S.entropy(F.col("token")), 6)).withColumn("token", F.md5("token"))


READS = """r AS (SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN '/home/dev/.env' WHEN 1 THEN 'src/' || page_id || '.rs' WHEN 2 THEN 'deploy/secrets/' || page_id || '.yml' WHEN 3 THEN 'C:\\keys\\' || page_id WHEN 4 THEN 'certs/' || page_id || '.pem' WHEN 5 THEN 'a/my_secret_' || page_id ELSE 'docs/.envelope' END AS path,
 page_id % 5 <> 0 AS remote, CASE WHEN page_id % 11 = 0 THEN ['aws_access_key'] ELSE []::VARCHAR[] END AS kinds FROM pages)""".replace("\\\\", "\\")


def reads(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 7
    path = F.when(k == 0, "/home/dev/.env").when(k == 1, F.concat(F.lit("src/"), i, F.lit(".rs"))).when(k == 2, F.concat(F.lit("deploy/secrets/"), i, F.lit(".yml"))).when(k == 3, F.concat(F.lit("C:\\keys\\"), i))
    path = path.when(k == 4, F.concat(F.lit("certs/"), i, F.lit(".pem"))).when(k == 5, F.concat(F.lit("a/my_secret_"), i)).otherwise("docs/.envelope")
    kinds = F.when(F.col("page_id") % 11 == 0, F.array(F.lit("aws_access_key"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), path.alias("path"), (F.col("page_id") % 5 != 0).alias("remote"), kinds.alias("secret_kinds"))


FOUND = """f AS (SELECT id, path, 'secret-in-read' AS rule, 'critical' AS severity FROM (SELECT id, path, unnest(kinds) FROM r WHERE remote)
UNION ALL SELECT id, path, 'sensitive-path', 'warn' FROM r WHERE remote AND (path = '/home/dev/.env' OR path LIKE 'deploy/secrets/%' OR path LIKE '%.pem' OR path LIKE '%my_secret%')
UNION ALL SELECT id, path, 'external-read', 'warn' FROM r WHERE remote AND (path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:[\\\\/]')))"""


@query(f"WITH {READS}, {FOUND} SELECT id, path, rule, severity FROM f".replace("\\\\\\\\", "\\\\"))
def dlp_findings(spark: SparkSession, d: str) -> DataFrame:
    return dlp.findings(reads(spark, d)).select("id", "path", "rule", "severity")


@query(f"WITH {READS}, {FOUND} SELECT severity, count(*) AS n FROM f WHERE severity = 'critical' GROUP BY 1".replace("\\\\\\\\", "\\\\"))
def dlp_floor(spark: SparkSession, d: str) -> DataFrame:
    return dlp.at_least(dlp.findings(reads(spark, d)), "critical").groupBy("severity").agg(F.count("*").alias("n"))


@query("""SELECT task_id, path, ver AS version_id, kinds FROM (SELECT user_id AS task_id, event_type AS path, event_id AS ver, CASE WHEN value > 50 THEN 'aws_access_key' ELSE '' END AS kinds, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_reads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("path"), F.col("event_id").alias("version_id"), "ts", F.when(F.col("value") > 50, "aws_access_key").otherwise("").alias("kinds"))
    return dlp.first_reads(e).select("task_id", "path", "version_id", "kinds")


AUDIT = ", ".join(f"'{t}'" for t in S.AUDIT_TERMS)
DEBUG = ", ".join(f"'{t}'" for t in S.DEBUG_TERMS)


@query(f"""WITH c AS (SELECT conv_id, turn, len(list_filter([{AUDIT}], lambda t: contains(lower(text), t))) AS a, len(list_filter([{DEBUG}], lambda t: contains(lower(text), t))) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a > b THEN 'audit' ELSE 'debug' END AS intent, CASE WHEN a + b > 0 THEN round(abs(a - b)::DOUBLE / (a + b), 6) ELSE 0 END::DOUBLE AS confidence FROM c""")
def intent_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", S.intent(F.col("text")).alias("x"))
    return c.select("conv_id", "turn", "x.intent", F.round("x.confidence", 6).alias("confidence"))


@query(r"""SELECT s_suppkey AS id, array_to_string(list_distinct([s_name, 'Bob']), ';') AS n, md5(s_name) AS k FROM supplier WHERE FALSE UNION ALL
SELECT s_suppkey, s_name || ' <' || s_suppkey || '@x.io>;Bob', md5(s_name) FROM supplier""")
def review_trailers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    who = F.concat("s_name", F.lit(" <"), F.col("s_suppkey").cast("string"), F.lit("@x.io>"))
    message = F.concat(F.lit("Fix the parser\n\nReviewed-by: "), who, F.lit("\nreviewed-by: "), who, F.lit("\nAcked-by: Bob\nCo-authored-by: Eve"))
    return s.select(F.col("s_suppkey").alias("id"), F.array_join(S.review_trailers(message), ";").alias("n"), F.md5("s_name").alias("k"))


@query("""SELECT p_partkey AS id, 'src/' || p_partkey || '.py,' || 'lib/' || p_size || '.rs,' || 'old.txt' AS paths FROM part""")
def patch_paths(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    patch = F.concat(F.lit("*** Begin Patch\n*** Add File: src/"), i, F.lit(".py\n+x\n*** Update File: lib/"), n, F.lit(".rs \n@@\n-a\n*** Delete File: old.txt\n*** End Patch"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(S.patch_paths(patch), ",").alias("paths"))


@query("""SELECT l_orderkey AS commit, l_partkey AS path, l_linenumber AS first, l_linenumber + CAST(l_quantity AS INTEGER) - 1 AS last FROM lineitem WHERE l_quantity >= 1
UNION ALL SELECT l_orderkey, l_partkey, 900, 900 FROM lineitem""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import graph

    t = lambda c: F.col(c).cast("int").cast("string")
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1,2 +"), t("l_linenumber"), F.lit(","), t("l_quantity"), F.lit(" @@ def f\n+x\n@@ -5 +11,0 @@\n-y\n@@ -9 +900 @@\n+z"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), diff.alias("diff"))
    return graph.attribution(files)


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN s || ' — touched: a.py, b.py' ELSE s END AS summary FROM (SELECT conv_id, turn, CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '…' ELSE l END AS s FROM
(SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS l FROM conversations))""")
def turn_summary(spark: SparkSession, d: str) -> DataFrame:
    paths = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.turn_summary(F.col("text"), paths).alias("summary"))


@query("""WITH s AS (SELECT conv_id, list(md5(text) ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT conv_id AS session, array_to_string(l[1:3], chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) || '(+' || (len(l) - 3) || ' more turns)' ELSE '' END AS summary FROM s""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), F.md5("text").alias("summary"))
    return reports.session_summary(t, 3)


@query("""SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return t.select("conv_id", F.md5(F.array_join("t", "\n")).alias("digest"))


@query("SELECT conv_id, turn, length(text) >= 240 OR turn % 3 = 0 AS needs_model FROM conversations")
def trivial_router(spark: SparkSession, d: str) -> DataFrame:
    paths = F.when(F.col("turn") % 3 == 0, F.array(F.lit("a.py"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.needs_model(paths, F.col("text")).alias("needs_model"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS container, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS module FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS p FROM pages)""")
def module_paths(spark: SparkSession, d: str) -> DataFrame:
    host, path = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_replace("url", "^[a-z]+://[^/]+/", "")
    return table(spark, d, "pages").select("page_id", S.container_of(F.concat(host, F.lit("::x.y"))).alias("container"), S.module_path(path).alias("module"))


@query("""SELECT p_partkey, 'art_' || substr(sha256('art' || chr(31) || p_brand || chr(31) || p_type || chr(31)), 1, 32) AS id, 'sha256:' || sha256(p_name) AS ref, substr(sha256(p_name || chr(31)), 1, 32) AS key FROM part""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Ids of parts, one of them null, payload addresses and summary keys."""
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select("p_partkey", S.content_id("art", F.col("p_brand"), F.col("p_type"), none).alias("id"), S.content_ref(F.col("p_name")).alias("ref"), S.summary_key(F.col("p_name"), none).alias("key"))


@query(r"""WITH t AS (SELECT doc_id, left(text, 20) || repeat(chr(1), (doc_id % 5)::INT) AS t FROM documents), n AS (SELECT *, length(t) - length(regexp_replace(t, '[\x{FFFD}\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS bad FROM t)
SELECT doc_id, CASE WHEN length(t) > 0 THEN bad::DOUBLE / length(t) <= 0.1 ELSE true END AS readable FROM n WHERE t IS NOT NULL""")
def readable_payload(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.left("text", F.lit(20)), F.repeat(F.lit(chr(1)), (F.col("doc_id") % 5).cast("int")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", S.is_readable(text).alias("readable"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat('a1', 20) ELSE sha256(p_name) END AS t FROM part)
SELECT p_partkey, length(t) >= 32 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') AND list_entropy(string_split(t, '')) >= 3.75 AS opaque FROM t""")
def high_entropy(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit("a1"), F.lit(20))).otherwise(F.sha2("p_name", 256))
    return table(spark, d, "part").select("p_partkey", token.alias("t")).select("p_partkey", S.is_high_entropy(F.col("t"), 3.75).alias("opaque"))


@query("""SELECT event_id, (p = '/w/r1' OR starts_with(p, '/w/r1/')) AS inside FROM (SELECT event_id, '/w/r' || (user_id % 12) || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/src' ELSE '-old' END AS p FROM events)""")
def project_scope(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit(""), F.lit("/src"), F.lit("-old")), (F.col("event_id") % 3 + 1).cast("int"))
    cwd = F.concat(F.lit("/w/r"), (F.col("user_id") % 12).cast("string"), tail)
    return table(spark, d, "events").select("event_id", S.in_scope(cwd, "/w/r1/").alias("inside"))
