"""Version chains, coupling, roll-up and drift on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import coupling, drift, history
from . import pipeline
from .standins import commit_files, table, turns, versions

V = """v AS (SELECT user_id AS artifact_id, event_id AS id, ts, event_type || ':' || regexp_extract(props, '([0-9]+)', 1) || ':' || CAST(floor(value) AS BIGINT) AS fingerprint,
 CAST(floor(value * 10) AS BIGINT) AS lines, event_type, value FROM events)"""
FIX = 6 * 3600

SIGNALS = f"""{V}, w AS (SELECT *, lag(lines) OVER c AS pl, lag(ts) OVER c AS pt, row_number() OVER (PARTITION BY artifact_id, fingerprint ORDER BY ts, id) AS again FROM v WINDOW c AS (PARTITION BY artifact_id ORDER BY ts, id)),
m AS (SELECT max(ts) AS now FROM v),
s AS (SELECT artifact_id,
 max(CASE WHEN epoch_us(ts) // 1000000 - epoch_us(pt) // 1000000 <= {FIX} AND lines > 0 AND lines < pl AND lines <= greatest(pl // 4, 5) THEN 1.0 ELSE 0.0 END)::DOUBLE AS immediate_fix,
 max(CASE WHEN again > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS reverted,
 sum(pow(0.5::DOUBLE, greatest(epoch_us(now) // 1000000 - epoch_us(ts) // 1000000, 0)::DOUBLE / 1209600.0::DOUBLE)::DECIMAL(18,9))::DOUBLE AS churn, count(*) AS n_versions
 FROM w, m GROUP BY artifact_id),
r AS (SELECT *, 1 - (1 - 0.5::DOUBLE * churn / (churn + 3.0::DOUBLE)) AS a, 1 - (1 - reverted) * (1 - 0.6::DOUBLE * immediate_fix) AS p FROM s),
risk AS (SELECT *, 1 - (1 - a) * (1 - p) AS f, CASE WHEN p < 0.05 THEN 'pending' WHEN a < 0.34 AND p >= 0.66 THEN 'safe_to_dangerous' WHEN p >= 0.66 THEN 'confirmed_dangerous' WHEN a >= 0.66 AND p < 0.34 THEN 'overestimated_risk' ELSE 'stable' END AS transition FROM r)"""


def risks(spark: SparkSession, d: str) -> DataFrame:
    return history.risk(history.signals(versions(spark, d), window_s=FIX))


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {SIGNALS} SELECT artifact_id, immediate_fix, reverted, round(churn, 6) AS churn, n_versions, round(a, 6) AS apriori, round(p, 6) AS aposteriori, round(f, 6) AS fused, transition FROM risk")
def risk_history(spark: SparkSession, d: str) -> DataFrame:
    return risks(spark, d).select("artifact_id", "immediate_fix", "reverted", *rounded("churn"), "n_versions", *rounded("apriori", "aposteriori", "fused"), "transition")


@query(f"WITH {SIGNALS} SELECT count(*) FILTER (f < 0.34) AS green, count(*) FILTER (f >= 0.34 AND f < 0.66) AS yellow, count(*) FILTER (f >= 0.66) AS red, count(*) FILTER (transition = 'safe_to_dangerous') AS gold, count(*) AS artifacts FROM risk")
def risk_histogram(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import reports

    return reports.histogram(risks(spark, d))


@query(f"WITH {SIGNALS} SELECT artifact_id AS id, round(f, 6) AS fused FROM (SELECT * FROM risk ORDER BY f DESC, artifact_id LIMIT 10) WHERE f > 0")
def top_risk(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import reports

    return reports.top_risk(risks(spark, d).select(F.col("artifact_id").alias("id"), "fused"), 10).select("id", *rounded("fused"))


SCORES = "(SELECT p_partkey AS id, (p_size % 21)::DOUBLE / 20 AS a, (p_partkey % 11)::DOUBLE / 10 AS p FROM part)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 21).cast("double") / 20).alias("a"), ((F.col("p_partkey") % 11).cast("double") / 10).alias("p"))


@query(f"SELECT id, CASE WHEN p < 0.05 THEN 'pending' WHEN a < 0.34 AND p >= 0.66 THEN 'safe_to_dangerous' WHEN p >= 0.66 THEN 'confirmed_dangerous' WHEN a >= 0.66 AND p < 0.34 THEN 'overestimated_risk' ELSE 'stable' END AS transition, round(1 - (1 - a) * (1 - p), 6) AS fused FROM {SCORES}")
def risk_transition(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return s.select("id", S.transition(F.col("a"), F.col("p")).alias("transition"), F.round(S.fuse(F.col("a"), F.col("p")), 6).alias("fused"))


@query(f"""SELECT id, '#' || lpad(lower(to_hex(round(least(1, 2 * t) * 255)::BIGINT)), 2, '0') || lpad(lower(to_hex(round(least(1, 2 - 2 * t) * 255)::BIGINT)), 2, '0') || '00' AS color FROM (SELECT id, round(1 - (1 - a) * (1 - p), 6) AS t FROM {SCORES})""")
def risk_color(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return s.select("id", S.color(F.round(S.fuse(F.col("a"), F.col("p")), 6)).alias("color"))


@query(f"WITH {V} SELECT artifact_id, src, id AS dst FROM (SELECT artifact_id, id, lag(id) OVER (PARTITION BY artifact_id ORDER BY ts, id) AS src FROM v) WHERE src IS NOT NULL")
def version_succession(spark: SparkSession, d: str) -> DataFrame:
    return history.succession(versions(spark, d))


@query(f"WITH {V} SELECT artifact_id, lines, CASE WHEN lines > 0 THEN round(lines::DOUBLE / (lines::DOUBLE + 50), 9) ELSE 0 END AS diff_size FROM (SELECT artifact_id, lines, row_number() OVER (PARTITION BY artifact_id ORDER BY ts DESC, id DESC) AS rn FROM v) WHERE rn = 1")
def latest_diff_size(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_diff(versions(spark, d)).select("artifact_id", "lines", F.round("diff_size", 9).alias("diff_size"))


@query(f"""WITH {SIGNALS}, top AS (SELECT artifact_id, row_number() OVER (ORDER BY round(f, 9) DESC, artifact_id) AS rank FROM risk QUALIFY rank <= 20),
n AS (SELECT artifact_id, id, row_number() OVER (PARTITION BY artifact_id ORDER BY ts DESC, id DESC) AS rn FROM v)
SELECT artifact_id, id, rank::BIGINT AS rank, rn::BIGINT AS rn FROM n JOIN top USING (artifact_id) WHERE rn <= 3 ORDER BY rank, rn LIMIT 20""")
def top_versions_per_artifact(spark: SparkSession, d: str) -> DataFrame:
    ranked = risks(spark, d).select("artifact_id", F.round("fused", 9).alias("fused"))
    return history.top_versions(versions(spark, d), ranked).select("artifact_id", "id", F.col("rank").cast("long").alias("rank"), F.col("rn").cast("long").alias("rn"))


@query(f"WITH {V} SELECT artifact_id, id, rn FROM (SELECT artifact_id, id, row_number() OVER (PARTITION BY artifact_id ORDER BY ts DESC, id DESC) AS rn FROM v) WHERE rn <= 5")
def last_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.newest(versions(spark, d), 5).select("artifact_id", "id", F.col("rn").cast("long").alias("rn"))


@query("""SELECT conv_id, turn, last(u IGNORE NULLS) OVER w AS last_user, first(u IGNORE NULLS) OVER w AS first_user FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN md5(text) END AS u FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")).alias("u"))
    return history.first_seen(history.carry(rows, "conv_id", ["turn"], "u", "last_user"), "conv_id", ["turn"], "u", "first_user").drop("u")


PAIRS = """sets AS (SELECT l_orderkey AS c, list_distinct(list(l_partkey)) AS fs FROM lineitem GROUP BY l_orderkey),
f AS (SELECT c, unnest(fs) AS f FROM sets WHERE len(fs) BETWEEN 2 AND {bulk}),
pairs AS (SELECT x.f AS a, y.f AS b, count(*) AS support FROM f x JOIN f y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2 HAVING count(*) >= {support})"""


@query(f"WITH {PAIRS.format(bulk=50, support=2)} SELECT * FROM pairs")
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return coupling.cochange(commit_files(spark, d))


@query(f"WITH {PAIRS.format(bulk=5, support=1)} SELECT count(*) AS pairs, sum(support)::BIGINT AS total FROM pairs")
def cochange_bulk_cap(spark: SparkSession, d: str) -> DataFrame:
    return coupling.cochange(commit_files(spark, d), bulk=5, support=1).agg(F.count("*").alias("pairs"), F.sum("support").alias("total"))


@query(f"WITH {PAIRS.format(bulk=50, support=2)}, e AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) SELECT id, 2 * count(*) AS degree, round((2 * count(*))::DOUBLE / (2 * count(*) + 5), 9) AS centrality FROM e GROUP BY id")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    deg = coupling.degree(coupling.depends_on(coupling.cochange(commit_files(spark, d))))
    return deg.select("id", "degree", F.round(S.saturate(F.col("degree"), S.HALF_DEGREE), 9).alias("centrality"))


@query(f"""WITH RECURSIVE {PAIRS.format(bulk=50, support=3)}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(root, id) AS (SELECT a, b FROM e UNION SELECT root, b FROM reach JOIN e ON id = a) SELECT root AS id, count(*) FILTER (id <> root) AS blast FROM reach GROUP BY root""")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return coupling.blast_radius(coupling.cochange(commit_files(spark, d), support=3))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey),
r(root, id) AS (SELECT s, s FROM (VALUES (1::BIGINT), (2), (3)) t(s) UNION SELECT root, src FROM r JOIN e ON id = dst) SELECT root, id FROM r WHERE root <> id""")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src <> dst").distinct()
    return coupling.dependents(e, spark.createDataFrame([(1,), (2,), (3,)], "id long"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS parent_id, greatest(0, max(o_totalprice), any_value(c_acctbal)) AS risk FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT n_nationkey AS id, n_regionkey AS parent_id, coalesce(max(risk), 0) AS risk FROM nation LEFT JOIN c ON c.parent_id = n_nationkey GROUP BY 1, 2)
SELECT r_regionkey AS id, r_name AS name, round(coalesce(max(risk), 0), 6) AS risk FROM region LEFT JOIN n ON n.parent_id = r_regionkey GROUP BY 1, 2""")
def rollup_max(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_totalprice").alias("risk"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent_id"), F.col("c_acctbal").alias("risk"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id"), F.lit(0.0).alias("risk"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(0.0).alias("risk"))
    up = coupling.rollup(orders, customers, ["risk"])
    up = coupling.rollup(up.drop("id"), nations, ["risk"])
    return coupling.rollup(up.drop("id"), regions, ["risk"]).select("id", "name", F.round("risk", 6).alias("risk"))


DRIFT = """p AS (SELECT l_orderkey AS o, l_suppkey AS s, bool_or(l_linenumber % 3 <> 0) AS d, bool_or(l_linenumber % 3 <> 1) AS a FROM lineitem GROUP BY 1, 2),
dr AS (SELECT o, coalesce(list(s ORDER BY s) FILTER (a AND NOT d), []) AS undeclared, coalesce(list(s ORDER BY s) FILTER (d AND NOT a), []) AS phantom, count(*) AS n FROM p GROUP BY o)"""


def session_drift(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(
        F.collect_set(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey"))).alias("declared"), F.collect_set(F.when(F.col("l_linenumber") % 3 != 1, F.col("l_suppkey"))).alias("actual")
    )
    return kept.select("session", drift.drift(F.col("declared"), F.col("actual")).alias("drift"))


@query(f"WITH {DRIFT} SELECT o AS session, array_to_string(undeclared, ',') AS undeclared, array_to_string(phantom, ',') AS phantom, round((len(undeclared) + len(phantom))::DOUBLE / n, 9) AS score FROM dr")
def drift_sets(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return session_drift(spark, d).select("session", text("drift.undeclared").alias("undeclared"), text("drift.phantom").alias("phantom"), F.round("drift.score", 9).alias("score"))


@query(f"""WITH {DRIFT} SELECT o_custkey AS session, any_value(arg) AS turn, any_value(sc) AS score FROM (SELECT o_custkey, o AS arg, round((len(undeclared) + len(phantom))::DOUBLE / n, 9) AS sc, len(undeclared) + len(phantom) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o DESC) AS rn FROM dr JOIN orders ON o_orderkey = o) WHERE rn = 1 AND k > 0 GROUP BY 1""")
def session_verdict(spark: SparkSession, d: str) -> DataFrame:
    each = session_drift(spark, d).withColumnRenamed("session", "turn").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("turn"), F.col("o_custkey").alias("session"), "o_orderdate"), "turn")
    held = each.select("session", "o_orderdate", "turn", F.struct("drift.*", "turn").alias("drift"))
    return drift.verdict(held, "session", ["o_orderdate", "turn"]).select("session", "drift.turn", F.round("drift.score", 9).alias("score"))


@query("""SELECT user_id AS artifact, ts, event_id, list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::VARCHAR AS seen FROM events""".replace("::VARCHAR", "").replace("list_sort(", "array_to_string(list_sort(").replace("event_id)))", "event_id))), ',')"))
def cumulative_declared(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("artifact"), "ts", "event_id", F.array("event_type").alias("paths"))
    return drift.cumulative(e, "artifact", ["ts", "event_id"], "paths").select("artifact", "ts", "event_id", F.array_join("declared_so_far", ",").alias("seen"))


SPAN = """s AS (SELECT user_id, min(ts) AS f, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1),
j AS (SELECT s.user_id AS session, e.user_id AS artifact_id, e.event_id AS version, e.ts, CAST(floor(e.value * 10) AS BIGINT) AS lines FROM s JOIN events e ON e.event_type = 'purchase' AND e.user_id % 10 = s.user_id % 10 AND e.ts BETWEEN s.f - INTERVAL 30 MINUTE AND s.t + INTERVAL 30 MINUTE)"""


def spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = versions(spark, d)
    sessions = v.where("event_type = 'error'").groupBy(F.col("artifact_id").alias("session")).agg(F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("key", F.col("session") % 10)
    return sessions, v.where("event_type = 'purchase'").select("artifact_id", F.col("id").alias("version"), "ts", "lines", (F.col("artifact_id") % 10).alias("key"))


@query(f"WITH {SPAN} SELECT session, count(*) AS versions, count(DISTINCT artifact_id) AS artifacts FROM j GROUP BY 1")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    return drift.span_counts(*spans(spark, d))


@query(f"WITH {SPAN} SELECT 'task_modifies_artifact' AS kind, session AS src, artifact_id AS dst, version, lines FROM (SELECT *, row_number() OVER (PARTITION BY session, artifact_id ORDER BY ts, version) AS rn FROM j) WHERE rn = 1")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return drift.gap_fill(*spans(spark, d))


@query("""SELECT conv_id, ordinal, count(*) AS records, min(turn) AS first_turn FROM (SELECT *, sum(CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS ordinal FROM conversations) WHERE ordinal >= 0 GROUP BY 1, 2""")
def turn_segmentation(spark: SparkSession, d: str) -> DataFrame:
    seg = drift.segment(turns(spark, d), "conv_id", "turn", (F.col("role") == "user") & (F.trim("text") != ""))
    return seg.groupBy("conv_id", "ordinal").agg(F.count("*").alias("records"), F.min("turn").alias("first_turn"))


@query("""WITH b AS (SELECT doc_id AS path, md5(text) AS h FROM documents), a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS path, md5(CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'added line' ELSE text END) AS h FROM documents)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    from .standins import slices

    before, after = slices(spark, d)
    hashed = lambda df: df.select("path", F.md5("text").alias("hash"))
    return drift.tree_diff(hashed(before), hashed(after))


@query("""WITH a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS path, unnest(string_split(CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'added line' ELSE text END, chr(10))) AS line, 1 AS n FROM documents),
b AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM documents), x AS (SELECT path, line, sum(n) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT path, sum(greatest(d, 0))::BIGINT AS lines_added, sum(greatest(-d, 0))::BIGINT AS lines_removed FROM x GROUP BY 1""")
def line_delta(spark: SparkSession, d: str) -> DataFrame:
    from .standins import slices

    before, after = slices(spark, d)
    return drift.line_delta(before, after)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 10000 DAY AS t FROM orders) SELECT o_orderkey, max(e.ts) AS ts FROM o LEFT JOIN events e ON e.user_id = o_custkey AND e.ts <= t GROUP BY 1""")
def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 10000 DAYS")).alias("t"))
    events = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "ts")
    return history.as_of(rows, events, "k", "t", "ts").select("o_orderkey", "ts")


@query("""WITH r AS (SELECT 'b' || (p_partkey % 7) AS repo, 'src/' || p_size || '/p' || p_partkey AS path, 'src/' || p_size AS module, p_retailprice AS risk FROM part)
SELECT repo, 'file' AS level, path, risk FROM r UNION ALL SELECT repo, 'module', module, max(risk) FROM r GROUP BY 1, 3 UNION ALL SELECT repo, 'repo', '.', max(risk) FROM r GROUP BY 1""")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    """Parts are files, their sizes modules: modules and repositories take the greatest risk below them."""
    key = F.col("p_partkey").cast("string")
    files = table(spark, d, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 7).cast("string")).alias("repo"), F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.lit("/p"), key).alias("path"), F.col("p_retailprice").alias("risk"))
    return coupling.levels_of(files, ["risk"])


#: Two repositories with the same paths; a user works on one path of one of them, and a session is a user's day.
TWO_REPOS = """v AS (SELECT event_id, user_id, ts, 'own/r' || (user_id % 2) AS repo, 'p' || (user_id // 2) AS path, user_id || '-' || ts::DATE AS session_id, event_type FROM events),
t AS (SELECT session_id, event_id AS ordinal, repo, path, ts AS last, min(ts) OVER (PARTITION BY session_id ORDER BY event_id) AS first FROM v WHERE event_type = 'signup'),
j AS (SELECT t.session_id, t.ordinal, list_sort(list(DISTINCT v.path)) AS done FROM t JOIN v USING (repo) WHERE v.event_type <> 'signup' AND v.ts BETWEEN t.first - INTERVAL 30 MINUTE AND t.last + INTERVAL 30 MINUTE GROUP BY ALL)"""


@query(f"""WITH {TWO_REPOS}, o AS (SELECT t.session_id, t.ordinal, t.repo, t.path, coalesce(list_filter(done, lambda x: x <> t.path), []) AS undeclared, CASE WHEN list_contains(coalesce(done, []), t.path) THEN 0 ELSE 1 END AS phantom FROM t LEFT JOIN j USING (session_id, ordinal))
SELECT session_id, ordinal, repo, array_to_string(undeclared, ',') AS undeclared, phantom, (len(undeclared) + phantom)::DOUBLE / (len(undeclared) + 1) AS score FROM o""")
def observe_two_repos(spark: SparkSession, d: str) -> DataFrame:
    """Drift of a session against its own repository's versions, found by the session's directory."""
    user = F.col("user_id")
    v = versions(spark, d).select(F.col("id"), F.col("artifact_id").alias("user_id"), "ts", "event_type")
    rows = v.select("id", "user_id", "ts", "event_type", F.concat(F.lit("own/r"), (user % 2).cast("string")).alias("repo"), F.concat(F.lit("p"), F.floor(user / 2).cast("string")).alias("path"), F.concat_ws("-", user.cast("string"), F.to_date("ts").cast("string")).alias("session_id"))
    t = rows.where("event_type = 'signup'").select("session_id", F.col("id").alias("ordinal"), F.col("ts").alias("timestamp"), F.array("path").alias("declared"), F.concat(F.lit("/home/dev/"), F.substring_index("repo", "/", -1), F.lit("/lib")).alias("cwd"))
    files = rows.where("event_type <> 'signup'")
    got = pipeline.observe(pipeline.session_repo(t, files), files.select("repo", "path", "ts"))
    return got.select("session_id", "ordinal", "repo", F.array_join("drift.undeclared", ",").alias("undeclared"), F.size("drift.phantom").alias("phantom"), F.col("drift.score").alias("score"))


@query("""SELECT conv_id, turn, min((turn * 7919) % 1000) OVER w AS started, len(list_distinct(list(role) OVER w)) AS roles FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def session_start(spark: SparkSession, d: str) -> DataFrame:
    """The first moment of a session up to each turn, whose moments are out of order, and what was declared by then."""
    moment = F.timestamp_seconds((F.col("turn") * 7919) % 1000)
    t = turns(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), moment.alias("timestamp"), F.array("role").alias("declared"))
    return pipeline.declared_turns(t).select(F.col("session_id").alias("conv_id"), F.col("ordinal").alias("turn"), F.unix_seconds("started").alias("started"), F.size("declared_so_far").alias("roles"))
