"""Co-change coupling, degree and transitive reach."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

BULK, SUPPORT = 50, 2
#: So many edges are a few MB on the driver.
FEW = 1 << 18


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder of spark.checkpoint.dir. Only a session of one machine may make its own; a cluster without the setting is an error."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def cochange(commit_files: DataFrame, bulk: int = BULK, support: int = SUPPORT) -> DataFrame:
    """(a, b, support): file pairs a < b that share at least `support` commits of 2 to `bulk` files.

    Of a commit's files only the first bulk + 1 are kept, before the shuffle already, so a commit of any size is known
    for a bulk one and dropped without being gathered. Others make at most bulk * (bulk - 1) / 2 pairs, from one array,
    without a self-join. Counting is partial before the shuffle.
    """
    rank = F.dense_rank().over(Window.partitionBy("commit").orderBy("file"))
    few = commit_files.where("file IS NOT NULL").withColumn("_rank", rank).where(F.col("_rank") <= bulk + 1)
    sets = few.groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files").between(2, bulk))
    first = sets.select("files", F.posexplode("files").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def depends_on(pairs: DataFrame) -> DataFrame:
    """Both directed edges of each pair."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))


def degree(edges: DataFrame) -> DataFrame:
    """In-degree plus out-degree."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


class Forest:
    """Union-find over rows 0..n-1, by arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
        self.up = self.roots(self.up)


def _solved(edges: DataFrame) -> DataFrame:
    """components() of FEW edges (lo, hi) at most, by one union-find on the driver."""
    found = edges.toArrow()
    lo, hi = (found.column(c).combine_chunks() for c in ("lo", "hi"))
    ids = pc.unique(pa.concat_arrays([lo, hi]))
    ids = ids.take(pc.sort_indices(ids))
    forest = Forest(len(ids))
    forest.join(*(pc.index_in(x, value_set=ids).to_numpy().astype(np.int64) for x in (lo, hi)))
    return edges.sparkSession.createDataFrame(pa.table({"id": ids, "component": ids.take(pa.array(forest.up))}), f"id {edges.dtypes[0][1]}, component {edges.dtypes[0][1]}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges taken both ways, by alternating large-star and small-star contraction.

    FEW edges at most are sent to the driver instead: a round's shuffles cost more than so few edges do.
    """
    now = checkpointed(edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).where("lo < hi").distinct())
    shape = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("lo", "hi")), F.lit(0))).first())
    seen = shape(now)
    if seen[0] <= FEW and now.dtypes[0][1] in ("int", "bigint", "string"):
        return _solved(now)
    while seen[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        now = checkpointed(large.join(least, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(least.select("m", "hi")).where("lo < hi").distinct())
        if (after := shape(now)) == seen:
            break
        seen = after
    found = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return found.union(found.select("component", "component").distinct())


def blast_radius(pairs: DataFrame) -> DataFrame:
    """(id, blast): how many others depend on each file, directly or not. Co-change is symmetric, so that is the component's size less one."""
    comp = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sizes = comp.groupBy("component").agg((F.count("*") - 1).alias("blast"))
    return comp.join(sizes, "component").select("id", "blast")


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): everything that reaches each of a stated set of roots over directed edges src -> dst, the root left out.

    The frontier advances one level a round until nothing is new; what was seen is taken off by an anti-join, and each
    round is checkpointed.
    """
    seen = frontier = checkpointed(roots.select(F.col("id").alias("root"), F.col("id")).distinct())
    while True:
        step = frontier.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("next")), "id").select("root", F.col("next").alias("id")).distinct()
        frontier = checkpointed(step.join(seen, ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen.where("root <> id")
        seen = checkpointed(seen.union(frontier))


def levels_of(risks: DataFrame, measures: list[str]) -> DataFrame:
    """(repo, level, path, measures): files (repo, path, measures), their modules and repositories, each with the greatest measure below it."""
    module = risks.select("repo", S.module_path(F.col("path")).alias("path"), *measures).groupBy("repo", "path").agg(*(F.max(m).alias(m) for m in measures))
    repo = module.groupBy("repo").agg(*(F.max(m).alias(m) for m in measures)).withColumn("path", F.lit("."))
    shape = lambda df, level: df.select("repo", F.lit(level).alias("level"), "path", *measures)
    return shape(risks, "file").union(shape(module, "module")).union(shape(repo, "repo"))


def rollup(children: DataFrame, parents: DataFrame, measures: list[str]) -> DataFrame:
    """parents with each measure raised to the greatest among its children: one level of the hierarchy. children: parent_id and measures; parents: id and measures."""
    top = children.groupBy("parent_id").agg(*(F.max(m).alias(f"_{m}") for m in measures)).withColumnRenamed("parent_id", "id")
    up = parents.join(top, "id", "left")
    return up.select(*(F.greatest(F.coalesce(c, F.lit(0.0)), F.coalesce(f"_{c}", F.lit(0.0))).alias(c) if c in measures else up[c] for c in parents.columns))
