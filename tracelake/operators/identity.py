"""Identity of artifacts over renames and moves.

Known (scope, id, path, hash, shingles) and observed (scope, path, hash, shingles) artifacts of one level. An equal path
is the same artifact. What disappeared and what appeared in a scope is matched one to one by falling similarity, then
known path, then observed path. Shingle sets are arrays without repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .coupling import checkpointed

THRESHOLD = 0.6


def paired(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, known, observed): artifacts of equal shingle sets, the k-th path of either side with each other.

    Equal sets have similarity 1, so the greedy walk takes these pairs first, in the order of their paths; by rank they
    take one window each instead of a pair for every two copies.
    """
    rank = F.row_number().over(Window.partitionBy("scope", F.array_sort("shingles")).orderBy("path"))
    side = lambda df, name: df.select("scope", F.array_sort("shingles").alias("shingles"), F.col("path").alias(name), rank.alias("_rank"))
    return side(gone, "known").join(side(new, "observed"), ["scope", "shingles", "_rank"]).select("scope", "known", "observed")


def candidates(gone: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """(scope, known, observed, similarity): pairs of a scope that are similar enough, by prefix filter.

    Shingles are ordered from the rarest in their scope. Two sets that similar share one of the first
    n - ceil(least * n) + 1 of each, and their sizes differ by no more than `least` allows, so only such pairs are
    compared: a line that all files have brings none of them together.
    """
    sets = gone.select("scope", F.lit(0).alias("side"), "path", "shingles").union(new.select("scope", F.lit(1), "path", "shingles")).where(F.size("shingles") > 0)
    each = sets.select("scope", "side", "path", F.explode("shingles").alias("s"))
    often = each.groupBy("scope", "s").agg(F.count("*").alias("often"))
    ordered = each.join(often, ["scope", "s"]).groupBy("scope", "side", "path").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("o"))
    n = F.size("o")
    first = ordered.select("scope", "side", "path", n.alias("n"), F.explode(F.transform(F.slice("o", 1, (n - F.ceil(n * least) + 1).cast("int")), lambda x: x["s"])).alias("s"))
    left = first.where("side = 0").select("scope", "s", F.col("path").alias("known"), "n")
    right = first.where("side = 1").select("scope", "s", F.col("path").alias("observed"), F.col("n").alias("m"))
    met = left.join(right, ["scope", "s"]).where(F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9).select("scope", "known", "observed").distinct()
    g = gone.select("scope", F.col("path").alias("known"), F.col("shingles").alias("ks"))
    h = new.select("scope", F.col("path").alias("observed"), F.col("shingles").alias("ns"))
    scored = met.join(g, ["scope", "known"]).join(h, ["scope", "observed"]).withColumn("similarity", S.jaccard(F.col("ks"), F.col("ns")))
    return scored.where(F.col("similarity") >= least).select("scope", "known", "observed", "similarity")


def assign(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment within each scope, without gathering a scope in one task.

    The order (similarity falling, known, observed) has no ties, so a pair that is first for both its ends is what the
    greedy walk would take, whatever else there is. Each round takes all such pairs and drops those that share an end.
    Equal sets, where most ties would be, are matched before (paired).
    """
    left, taken = checkpointed(pairs), None
    place = F.struct((-F.col("similarity")).alias("s"), "known", "observed")
    while not left.isEmpty():
        by_known = left.groupBy("scope", "known").agg(F.min(place).alias("_k"))
        by_observed = left.groupBy("scope", "observed").agg(F.min(place).alias("_o"))
        first = left.join(by_known, ["scope", "known"]).join(by_observed, ["scope", "observed"]).where((place == F.col("_k")) & (place == F.col("_o")))
        first = checkpointed(first.select(*pairs.columns))
        taken = first if taken is None else taken.union(first)
        left = checkpointed(left.join(first.select("scope", "known"), ["scope", "known"], "left_anti").join(first.select("scope", "observed"), ["scope", "observed"], "left_anti"))
    return taken if taken is not None else left


def resolve(known: DataFrame, observed: DataFrame, least: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Resolved observations (scope, path, id, status, from_path) and removed known artifacts (scope, id)."""
    k = known.select("scope", "path", "id", F.col("hash").alias("old"), F.col("shingles").alias("_s"))
    same = observed.join(k, ["scope", "path"])
    edited = same.select("scope", "path", "id", F.when(F.col("hash") == F.col("old"), "unchanged").otherwise("modified").alias("status"), F.lit(None).cast("string").alias("from_path"))
    gone, new = known.join(observed, ["scope", "path"], "left_anti"), observed.join(known, ["scope", "path"], "left_anti")
    equal = checkpointed(paired(gone, new))
    rest = lambda df, name: df.join(equal.select("scope", F.col(name).alias("path")), ["scope", "path"], "left_anti")
    matched = equal.union(assign(candidates(rest(gone, "known"), rest(new, "observed"), least)).select("scope", "known", "observed"))
    ids = gone.select("scope", F.col("path").alias("known"), "id")
    renamed = matched.join(ids, ["scope", "known"]).select(
        "scope", F.col("observed").alias("path"), "id", F.when(S.container_of(F.col("known")) == S.container_of(F.col("observed")), "renamed").otherwise("moved").alias("status"), F.col("known").alias("from_path")
    )
    fresh = new.join(matched.select("scope", F.col("observed").alias("path")), ["scope", "path"], "left_anti")
    added = fresh.select("scope", "path", S.content_id("art", F.col("scope"), F.col("path"), F.col("hash")).alias("id"), F.lit("added").alias("status"), F.lit(None).cast("string").alias("from_path"))
    removed = gone.join(matched.select("scope", F.col("known").alias("path")), ["scope", "path"], "left_anti").select("scope", "id")
    return edited.unionByName(renamed).unionByName(added), removed


def ingest_stats(resolved: DataFrame, removed: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "renamed", "moved", "unchanged")]
    return resolved.agg(*counts).crossJoin(F.broadcast(removed.agg(F.count("*").alias("removed"))))
