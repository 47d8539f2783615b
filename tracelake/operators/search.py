"""Search: vectors, hybrid ranking, lexical matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

POOL, WEIGHTS = 3, (0.6, 0.3, 0.1)


def vector_literal(vec: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vec))


def embed(rows: DataFrame, id_: str, text: str, dim: int = 256) -> DataFrame:
    """(id, vec): the hashing embedding of every row, by counting cells; for many or long texts, where the scalar form would walk all `dim` cells for each token."""
    cells = rows.select(id_, F.explode(S.embedding_cells(F.col(text), dim)).alias("c")).groupBy(id_, F.col("c.bucket").alias("bucket")).agg(F.sum("c.sign").alias("x"))
    by = cells.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    full = rows.select(id_).join(by, id_, "left")
    cell = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return full.select(id_, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), cell).alias("vec"))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_: str = "id", vec: str = "vec") -> DataFrame:
    """The k nearest by cosine. The query is a literal, so the scan is one pass and only k rows of each partition go on."""
    scored = vectors.select("*", S.cosine(F.col(vec), vector_literal(query)).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), id_).limit(k)


def hybrid(pool: DataFrame, k: int, now: Column, id_: str = "id") -> DataFrame:
    """Re-ranks a pool (cosine, created_at, risk) by cosine, recency and risk; equal scores by recency and id."""
    recency = S.decay(F.unix_seconds(now) - F.unix_seconds("created_at"), S.RECENCY_HALF_LIFE_S)
    scored = pool.withColumn("recency", recency).withColumn("score", F.round(WEIGHTS[0] * F.col("cosine") + WEIGHTS[1] * F.col("recency") + WEIGHTS[2] * F.col("risk"), 9))
    return scored.orderBy(F.desc("score"), F.desc("recency"), id_).limit(k)


def lexical(artifacts: DataFrame, tokens: Sequence[str], path: str = "path") -> DataFrame:
    """Artifacts whose path has one of the tokens."""
    words = F.array(*(F.lit(t.lower()) for t in tokens)).cast("array<string>")
    return artifacts.where(F.exists(words, lambda t: F.contains(F.lower(F.col(path)), t)))


def lexical_first(lexical_hits: DataFrame, semantic_hits: DataFrame, k: int, id_: str = "id") -> DataFrame:
    """At most half of k (rounded up) lexical hits, the newest first, then the best semantic ones that aren't among them."""
    half = lexical_hits.orderBy(F.desc("created_at"), id_).limit(-(-k // 2)).select(id_, F.lit("lexical").alias("channel"), F.lit(0.0).alias("_o"))
    rest = semantic_hits.join(half, id_, "left_anti").select(id_, F.lit("semantic").alias("channel"), (-F.col("score")).alias("_o"))
    return half.union(rest).orderBy("channel", "_o", id_).limit(k).drop("_o")


def missing(rows: DataFrame, having: DataFrame, key: str) -> DataFrame:
    """Rows without a partner."""
    return rows.join(having, key, "left_anti")


def similar_pairs(shingles: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of sets (id, shingles) with at least `least`: exact, by prefix filtering.

    Shingles are ordered from the rarest; two sets that similar share one among their first n - ceil(least * n) + 1, so
    only these meet, and of these only pairs whose sizes allow it. Equal sets are folded first and matched by their class, so copies aren't paired within the join.
    """
    sets = shingles.where(F.size("shingles") > 0).groupBy("shingles").agg(F.min("id").alias("rep"))
    df = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("rep", F.explode("shingles").alias("s")).join(df, "s").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("o"))
    n = F.size("o")
    prefix = ranked.select("rep", n.alias("n"), F.explode(F.slice("o", 1, (n - F.ceil(n * least) + 1).cast("int"))).alias("s"))
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least - 1e-9
    pairs = prefix.alias("x").join(prefix.alias("y"), F.expr("x.s = y.s AND x.rep < y.rep")).where(fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"s_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", S.jaccard(F.col("s_a"), F.col("s_b")))
    return joined.where(F.col("jaccard") >= least).select("a", "b", "jaccard")
