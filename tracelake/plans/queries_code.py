"""Identity, code structure, transcripts and streams on the driver's tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import code
from ..functions import scalars as S
from ..operators import drift, identity
from .standins import table


@query("SELECT source AS scope, CASE WHEN doc_id % 4 = 0 THEN 'old/' ELSE 'new/' END || doc_id AS path, doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'unchanged' ELSE 'moved' END AS status FROM documents")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters of the documents move. Each is most similar to itself, and of those with equal lines the order of
    paths decides, so every document must be found again: the SQL says which."""
    return _resolved(spark, d)[0].select("scope", "path", "id", "status")


@query("SELECT 0 AS added, 0 AS modified, 0 AS renamed, count_if(doc_id % 4 <> 0) AS moved, count_if(doc_id % 4 = 0) AS unchanged, 0 AS removed FROM documents")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return identity.ingest_stats(*_resolved(spark, d))


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", "text", S.line_shingles(F.col("text")).alias("shingles"), F.md5("text").alias("hash"))
    path = lambda k: F.concat_ws("/", F.lit(k), F.col("doc_id").cast("string"))
    known = docs.select(F.col("source").alias("scope"), path("old").alias("path"), F.col("doc_id").cast("string").alias("id"), "hash", "shingles")
    observed = docs.select(F.col("source").alias("scope"), F.when(F.col("doc_id") % 4 == 0, path("old")).otherwise(path("new")).alias("path"), "hash", "shingles")
    return identity.resolve(known, observed)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A small file for each part: two functions whose bodies differ by the part's size."""
    i, n = F.col("p_partkey").cast("string"), (F.col("p_size") % 4)
    body = F.concat(F.lit("def f"), i, F.lit("(x):\n    y = x + "), i, F.lit("\n"), F.repeat(F.lit("    y = y * 2\n"), n), F.lit("    return y\n\nclass C:\n    def g(self):\n        return f"), i, F.lit("(1)\n"))
    return table(spark, d, "part").select(F.concat(F.lit("src/p"), i, F.lit(".py")).alias("path"), body.alias("text"))


@query("SELECT 'src/p' || p_partkey || '.py::' || s AS symbol, k AS kind FROM part, (SELECT 'C' AS s, 'class' AS k UNION ALL SELECT 'C.g', 'function') UNION ALL SELECT 'src/p' || p_partkey || '.py::f' || p_partkey, 'function' FROM part")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return code.parse_files(_sources(spark, d)).where("symbol IS NOT NULL").select("symbol", "kind")


@query("SELECT count(DISTINCT p_size % 4) AS shapes, count(*) AS files FROM part")
def ast_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Files of the same shape have the same fingerprint whatever their names and literals."""
    return code.parse_files(_sources(spark, d)).where("kind = 'file'").agg(F.countDistinct("hash").alias("shapes"), F.count("*").alias("files"))


def _transcript(spark: SparkSession, d: str) -> DataFrame:
    """conversations as transcript lines in the messages dialect; every user record declares and reads files in its answer."""
    c = table(spark, d, "conversations").where("role IN ('user', 'assistant')")
    user = F.struct(F.lit("user").alias("type"), F.lit("2024-01-01T10:00:00Z").alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("/work").alias("cwd"), F.struct(F.lit(None).cast("string").alias("model"), F.col("text").alias("content")).alias("message"))
    tool = lambda i, name, path: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(i).alias("id"), F.lit(name).alias("name"), F.struct(path.alias("file_path")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(None).cast("string").alias("file_path")).alias("input"))
    parts = F.array(said, tool("t1", "Edit", F.concat(F.lit("/work/src/"), (F.col("turn") % 5).cast("string"), F.lit(".py"))), tool("t2", "Read", F.lit("/home/dev/.env")))
    answer = F.struct(F.lit("assistant").alias("type"), F.lit("2024-01-01T10:01:00Z").alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("/work").alias("cwd"), F.struct(F.lit("m1").alias("model"), parts.alias("content")).alias("message"))
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("long").alias("byte_offset"), F.when(F.col("role") == "user", F.to_json(user)).otherwise(F.to_json(answer)).alias("text"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN role = 'user' AND regexp_replace(text, '\\s', '', 'g') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS ordinal FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT conv_id, ordinal, md5(arg_min(text, turn)) AS prompt, count(*) FILTER (role = 'assistant') * 2 AS calls, coalesce(array_to_string(list_sort(list_distinct(list('src/' || (turn % 5) || '.py') FILTER (role = 'assistant'))), ','), '') AS declared FROM c WHERE ordinal >= 0 GROUP BY 1, 2)
SELECT conv_id::VARCHAR AS session_id, ordinal, prompt, calls, declared FROM k""")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import transcripts

    t = transcripts.paths(transcripts.turns(_transcript(spark, d)))
    return t.select("session_id", "ordinal", F.md5("prompt").alias("prompt"), F.size("tool_calls").cast("long").alias("calls"), F.array_join("declared", ",").alias("declared"))


def _streamed(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows; state and output are in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="streams-")
    at = f"{base}/{name}-{os.urandom(8).hex()}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    raise ValueError(mode)


@query("SELECT user_id AS task_id, event_type AS path, 'external-read' AS rule FROM events WHERE FALSE UNION ALL SELECT DISTINCT user_id, '/' || event_type, 'external-read' FROM events")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts from events as a stream of reads: each (task, path, rule, model) once."""
    from ..streaming import jobs

    schema = table(spark, d, "events").schema
    none = F.array().cast("array<string>")
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*") if os.path.isfile(f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    reads = e.select(F.col("user_id").alias("task_id"), F.lit("m").alias("model"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("remote"), none.alias("secret_kinds"))
    return _streamed(spark, jobs.alerts(reads, "400 days"), "alerts").select("task_id", "path", "rule")


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) FROM events) GROUP BY ALL""")
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Closed days of a watermarked count; the last day is still open."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    e = spark.readStream.schema(schema).parquet(f"{path}*" if os.path.isfile(path) else path)
    counts = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _streamed(spark, counts, "daily").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events) SELECT user_id AS session_id, count(DISTINCT event_type) AS paths FROM c GROUP BY 1""")
def declared_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.array("event_type").alias("declared"))
    so_far = drift.cumulative(e, "session_id", ["ts", "event_id"], "declared")
    return so_far.groupBy("session_id").agg(F.max(F.size("declared_so_far")).cast("long").alias("paths"))
