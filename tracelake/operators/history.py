"""Operators on the version chain of each artifact. Versions: artifact_id, id, ts (timestamp), lines, fingerprint; a chain is ordered by (ts, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

FIX_WINDOW_S = 1800
#: Sums of doubles go through this type so that their order doesn't matter.
EXACT = "decimal(18,9)"


def chain(key: str = "artifact_id") -> Window:
    return Window.partitionBy(key).orderBy("ts", "id")


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast(EXACT)).cast("double")


def succession(versions: DataFrame) -> DataFrame:
    """Edges from each version to the one after it."""
    return versions.select("artifact_id", F.lag("id").over(chain()).alias("src"), F.col("id").alias("dst")).where("src IS NOT NULL")


def signals(versions: DataFrame, now: DataFrame | None = None, window_s: int = FIX_WINDOW_S, scope: str | None = None) -> DataFrame:
    """immediate_fix, reverted, churn and n_versions of each artifact.

    A fix follows within `window_s` and has at most a quarter of the lines before it, or five. A fingerprint that comes
    again is a revert. Churn halves every fortnight before `now`, one row; by default the latest version's moment, of all
    or of those with the same `scope`.
    """
    horizon = now if now is not None else versions.groupBy(*([scope] if scope else [])).agg(F.max("ts").alias("now"))
    w = chain()
    before, gap = F.lag("lines").over(w), F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))
    fix = (gap <= window_s) & (F.col("lines") > 0) & (F.col("lines") < before) & (F.col("lines") <= F.greatest(F.floor(before / 4), F.lit(5)))
    again = (F.col("fingerprint") != "") & (F.row_number().over(Window.partitionBy("artifact_id", "fingerprint").orderBy("ts", "id")) > 1)
    marked = versions.select("*", F.coalesce(fix, F.lit(False)).alias("fix"), F.coalesce(again, F.lit(False)).alias("again"))
    marked = marked.join(horizon, scope) if scope and now is None else marked.crossJoin(F.broadcast(horizon))  # one row
    age = F.unix_seconds("now") - F.unix_seconds("ts")
    return marked.groupBy("artifact_id").agg(
        F.max("fix").cast("double").alias("immediate_fix"), F.max("again").cast("double").alias("reverted"), exact_sum(S.decay(age, S.CHURN_HALF_LIFE_S)).alias("churn"), F.count("*").alias("n_versions")
    )


def risk(scored: DataFrame) -> DataFrame:
    """Adds apriori, aposteriori, fused and transition; factors that are missing count for nothing."""
    early = {"churn": S.saturate(F.col("churn"), S.HALF_CHURN)}
    for name, make in {"centrality": lambda: S.saturate(F.col("degree"), S.HALF_DEGREE), "blast_radius": lambda: S.saturate(F.col("blast"), S.HALF_BLAST), "diff_size": lambda: F.col("diff_size"), "drift": lambda: F.col("drift"), "test_gap": lambda: F.col("test_gap")}.items():
        column = {"centrality": "degree", "blast_radius": "blast"}.get(name, name)
        if column in scored.columns:
            early[name] = F.coalesce(make(), F.lit(0.0))
    late = {k: F.col(k) for k in S.APOSTERIORI if k in scored.columns}
    out = scored.select("*", S.apriori(**early).alias("apriori"), S.aposteriori(**late).alias("aposteriori"))
    out = out.withColumn("fused", S.fuse(F.col("apriori"), F.col("aposteriori")))
    return out.withColumn("transition", S.transition(F.col("apriori"), F.col("aposteriori")))


def latest_diff(versions: DataFrame) -> DataFrame:
    """Saturated size of each artifact's last change."""
    last = F.max_by("lines", F.struct("ts", "id"))
    return versions.groupBy("artifact_id").agg(last.alias("lines")).withColumn("diff_size", S.saturate(F.col("lines"), S.HALF_DIFF))


def newest(versions: DataFrame, k: int) -> DataFrame:
    """The k latest versions of each artifact, numbered from the newest."""
    w = Window.partitionBy("artifact_id").orderBy(F.desc("ts"), F.desc("id"))
    return versions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def top_versions(versions: DataFrame, ranked: DataFrame, artifacts: int = 20, each: int = 3, most: int = 20) -> DataFrame:
    """Up to `each` newest versions of the first `artifacts` of `ranked` (artifact_id, fused), `most` in all."""
    top = ranked.orderBy(F.desc("fused"), "artifact_id").limit(artifacts)
    place = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "artifact_id")))
    return newest(versions, each).join(F.broadcast(place.select("artifact_id", "rank")), "artifact_id").orderBy("rank", "rn").limit(most)


def carry(rows: DataFrame, key: str, order: list[str], value: str, to: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(w))


def first_seen(rows: DataFrame, key: str, order: list[str], value: str, to: str) -> DataFrame:
    """The first value that isn't null up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(to, F.first(value, ignorenulls=True).over(w))


def as_of(rows: DataFrame, events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each row with the value of the latest event of its key at or before it, by one union and one window."""
    both = rows.withColumn("_v", F.lit(None).cast(events.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        events.select(key, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
