"""Search queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import search
from .standins import instant, table

FNV = """list_reduce([2166136261] || list_transform(string_split({t}, ''), lambda c: ord(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector with the smallest id: one row."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


Q = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], qv) AS cosine FROM embeddings, q)"


@query(f"WITH {Q} SELECT id, round(cosine, 6) AS cosine FROM s ORDER BY cosine DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.top_k(vectors, query_vector(spark, d), 10).select("id", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {Q}, pool AS (SELECT s.id, cosine, o_orderdate AS t, least(1, o_totalprice / 500000) AS risk FROM (SELECT * FROM s ORDER BY cosine DESC, id LIMIT 24) s JOIN orders ON o_orderkey = s.id),
m AS (SELECT max(o_orderdate) AS now FROM orders), r AS (SELECT id, pow(0.5::DOUBLE, greatest(epoch_us(now) // 1000000 - epoch_us(t) // 1000000, 0)::DOUBLE / 2592000.0::DOUBLE) AS recency, cosine, risk FROM pool, m)
SELECT id, round(0.6::DOUBLE * cosine + 0.3::DOUBLE * recency + 0.1::DOUBLE * risk, 6) AS score FROM r ORDER BY round(0.6::DOUBLE * cosine + 0.3::DOUBLE * recency + 0.1::DOUBLE * risk, 9) DESC, recency DESC, id LIMIT 8""")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), instant("o_orderdate").alias("created_at"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("risk"))
    now = tasks.agg(F.max("created_at").alias("now"))
    pool = search.top_k(vectors, query_vector(spark, d), search.POOL * 8).join(tasks, "id").crossJoin(F.broadcast(now))
    return search.hybrid(pool, 8, F.col("now")).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return search.missing(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE '%/en/%' OR lower(url) LIKE '%blog.%' OR lower(url) LIKE '%.html%'")
def lexical_match(spark: SparkSession, d: str) -> DataFrame:
    tokens = S.entity_tokens("who changed `/en/` and `blog.` or `.html`?")
    return search.lexical(table(spark, d, "pages").select("page_id", "url"), tokens, "url")


@query("""WITH l AS (SELECT o_orderkey AS id, o_orderdate AS t FROM orders WHERE o_orderpriority LIKE '%URGENT%'), half AS (SELECT id, t, row_number() OVER (ORDER BY t DESC, id) AS o FROM l QUALIFY o <= 4),
rest AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS o FROM orders WHERE o_orderkey NOT IN (SELECT id FROM half))
SELECT id, 'lexical' AS channel FROM half UNION ALL SELECT id, 'semantic' FROM rest WHERE o <= 8 - (SELECT count(*) FROM half)""")
def lexical_first(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    hits = orders.where(F.contains("o_orderpriority", F.lit("URGENT"))).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    semantic = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return search.lexical_first(hits, semantic, 8)


@query(f"""WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark),
c AS (SELECT item_id, ({FNV.format(t="t")} % 256)::INTEGER AS bucket, CASE WHEN {FNV.format(t="('sign:' || t)")} % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM t),
b AS (SELECT item_id, bucket, sum(sign)::DOUBLE AS x FROM c GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM b GROUP BY 1)
SELECT item_id, bucket, round(x / norm, 6) AS weight FROM b JOIN n USING (item_id) WHERE x <> 0""")
def local_embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = search.embed(table(spark, d, "benchmark"), "item_id", "text").select("item_id", F.posexplode("vec").alias("bucket", "w"))
    return vectors.where("w <> 0").select("item_id", "bucket", F.round("w", 6).alias("weight"))


LINES = "s AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS sh FROM documents)"


@query(f"WITH {LINES} SELECT id, len(sh) AS shingles FROM s")
def line_shingles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(S.line_shingles(F.col("text"))).cast("long").alias("shingles"))


@query(f"""WITH {LINES}, k AS (SELECT sh, min(id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh), x AS (SELECT rep, unnest(sh) AS l FROM k), n AS (SELECT rep, len(sh) AS n FROM k),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM x a JOIN x b ON a.l = b.l AND a.rep < b.rep GROUP BY 1, 2)
SELECT a, b, round(i::DOUBLE / (na.n + nb.n - i), 6) AS jaccard FROM c JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE i::DOUBLE / (na.n + nb.n - i) >= 0.5""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.line_shingles(F.col("text")).alias("shingles"))
    return search.similar_pairs(sets, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
