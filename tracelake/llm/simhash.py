"""SimHash near-duplicates with vantage-point trees.

Fingerprints (64 bits) are made from word shingles; equal ones are folded together before anything is compared. For
links within `radius` bits the 64 bits are cut into `blocks` parts: two fingerprints that differ in at most `radius`
bits differ in at most radius // blocks bits in one part. Each part has its own vantage-point tree. A node holds a
vantage point and a median distance mu; a fingerprint lives on the inner side if its distance is at most mu. By the
triangle bound all its partners within r have distances in [d - r, d + r], so fingerprints near the border are copied
to the overlapping side as visitors, and every other branch is pruned. The leaves are the shards.

The trees grow with the data. The first ones come from a sample of SAMPLE distinct fingerprints. Each shard of over
SPLIT rows then gives a bounded sample of its own, a subtree grows from that, and its rows are routed again, until no
shard is over SPLIT that can be split. A subtree takes the part's distance while the shard's fingerprints differ in that part, else the
distance over all 64 bits with the whole radius. A shard whose subtree would not halve the comparisons, visitors included, is
dealt as pairs of pieces of SPLIT rows, residents against others. Four parts for three bits leave r = 0 within a part: then no row has a visitor's
copy until a shard's part is all equal, and each fingerprint is dealt four times, however many there are.

Within a shard the tree goes on in memory, ends in exact Hamming comparisons over all 64 bits, and only a spanning
forest of the links leaves the task. So every pair within the radius is linked, and no group is spelled out as pairs.

Null text counts as empty; texts without words have fingerprint zero. Rows with a null doc_id keep their row and take
part in the links; the smallest non-null id names a component, null if there is none. Repeated ids keep their rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coupling
from ..operators.coupling import Forest
from . import similar
from .common import materialise, shared_dir, shuffle_width, table
from .shingle import BITS, fingerprint, hashes

SHINGLE, RADIUS, BLOCKS = 3, 3, 4
SAMPLE, SHARD, SPLIT, LEAF = 8192, 4096, 65536, 64
#: First leaves; then leaves a subtree, fingerprints it grows from, and rows of one shard routed in one task.
TOP, FAN, GROW, DEAL = 1024, 64, 2048, 1 << 20
ALL = (1 << BITS) - 1


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """doc_id, th (the text's hash) and fp (the 64 bits as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(hashes(t.as_py(), k)) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps], names=["doc_id", "th", "fp"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text)).alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


class Tree:
    """A vantage-point tree over masked Hamming distance. Node i: vantage[i], mu[i]; children inner[i], outer[i], or leaf number ~child."""

    def __init__(self, sample: np.ndarray, mask: int, r: int, shards: int):
        self.mask, self.r = np.uint64(mask), r
        self.vantage, self.mu, self.inner, self.outer, self.leaves = [], [], [], [], 0
        self.root = self._grow(np.unique(sample & self.mask), shards, np.random.default_rng(7))

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, points: np.ndarray, shards: int, rng) -> int:
        if shards <= 1 or len(points) < 2:
            return self._leaf()
        best = None
        for v in rng.choice(points, min(4, len(points)), replace=False):
            d = np.bitwise_count((points ^ v) & self.mask).astype(int)
            mu = int(np.median(d))
            inside = d <= mu
            if inside.all():
                mu -= 1
                inside = d <= mu
            crossing = np.mean((d > mu - self.r) & (d <= mu + self.r)) + abs(inside.mean() - 0.5)
            if inside.any() and not inside.all() and (best is None or crossing < best[0]):
                best = (crossing, v, mu, inside)
        if best is None or best[0] > 0.9:
            return self._leaf()
        _, v, mu, inside = best
        at = len(self.mu)
        self.vantage.append(np.uint64(v)), self.mu.append(mu), self.inner.append(0), self.outer.append(0)
        share = min(shards - 1, max(1, round(shards * inside.mean())))
        self.inner[at] = self._grow(points[inside], share, rng)
        self.outer[at] = self._grow(points[~inside], shards - share, rng)
        return at

    def route(self, fps: np.ndarray, resident: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index into fps, leaf, resident): one resident row of each resident, and its and the visitors' visits."""
        home = np.ones(len(fps), bool) if resident is None else resident
        out, stack = [], [(self.root, np.arange(len(fps)), home)]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), ~node, np.int64), home))
                continue
            d = np.bitwise_count((fps[at] ^ self.vantage[node]) & self.mask).astype(int)
            mu = self.mu[node]
            into, away = d <= mu + self.r, d > mu - self.r
            stack.append((self.inner[node], at[into], (home & (d <= mu))[into]))
            stack.append((self.outer[node], at[away], (home & (d > mu))[away]))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, int), np.empty(0, np.int64), np.empty(0, bool))

    def saves(self, points: np.ndarray) -> bool:
        """Whether comparing each leaf's residents with its rows takes at most half of comparing all with all."""
        _, leaf, home = self.route(points)
        all_, mine = np.bincount(leaf, minlength=self.leaves), np.bincount(leaf, home, minlength=self.leaves)
        return float((all_ * mine).sum()) <= 0.5 * len(points) ** 2


def local_links(fps: np.ndarray, home: np.ndarray, mask: int, r: int, radius: int, leaf: int = LEAF) -> Forest:
    """Joins each resident with every row within `radius` bits that is within r in the mask's bits.

    The tree goes on in memory, down to `leaf` rows: by the mask's bits while they tell rows apart, then by all bits.
    """
    forest, rng = Forest(len(fps)), np.random.default_rng(11)
    ways = [(np.uint64(mask), r), (np.uint64(ALL), radius)]
    stack = [(np.nonzero(home)[0], np.arange(len(fps)), 0)]
    while stack:
        mine, all_, way = stack.pop()
        if not len(mine) or not len(all_):
            continue
        if len(all_) > leaf and way < len(ways):
            m, near = ways[way]
            v = fps[mine[rng.integers(len(mine))]]
            dm = np.bitwise_count((fps[mine] ^ v) & m).astype(int)
            da = np.bitwise_count((fps[all_] ^ v) & m).astype(int)
            mu = int(np.median(dm))
            if (dm <= mu).all():
                mu -= 1
            inner, outer = da <= mu + near, da > mu - near
            inside = dm <= mu
            if inside.sum() * inner.sum() + (~inside).sum() * outer.sum() < 0.85 * len(mine) * len(all_):
                stack += [(mine[inside], all_[inner], way), (mine[~inside], all_[outer], way)]
            else:
                stack.append((mine, all_, way + 1))
            continue
        step = max(1, 2_000_000 // len(all_))
        for low in range(0, len(mine), step):
            part = mine[low : low + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[all_][None, :]) <= radius)
            a, b = part[i], all_[j]
            forest.join(a[a != b], b[a != b])
    return forest


ROUTED = "block int, shard long, fp long, home boolean"


def _rows(block, shard, fp, home) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "shard": pa.array(shard, pa.int64()), "fp": pa.array(fp, pa.int64()), "home": pa.array(home, pa.bool_())})


def route(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(block, shard, fp, home, pieces): every distinct fingerprint in its shards. pieces is 1 but for shards that can't be split."""
    spark, width, r = fps.sparkSession, BITS // blocks, radius // blocks
    total = fps.count()
    sample = np.array([x.fp for x in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks = [((1 << width) - 1) << (width * b) for b in range(blocks)]
    # SAMPLE fingerprints at most: a few hundred kB, whatever the corpus.
    trees = [Tree(sample, m, r, min(TOP, -(-total // SHARD))) for m in masks]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(fp), 4096):
                some = fp[low : low + 4096]
                for block, tree in enumerate(trees):
                    at, leaf, home = tree.route(some.view(np.uint64))
                    yield from _rows(np.full(len(at), block), TOP + leaf, some[at], home).to_batches()

    def grow(key: tuple, part: pa.Table) -> pa.Table:
        block, shard, n = (k.as_py() for k in key)
        points = part.column("fp").to_numpy().view(np.uint64)
        leaves = min(FAN, -(-n // SHARD))
        trees = (Tree(points, masks[block], r, leaves), Tree(points, ALL, radius, leaves))
        tree = next((t for t in trees if t.saves(points)), None)
        return pa.table({"block": pa.array([block], pa.int32()), "shard": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "splits": pa.array([tree is not None]), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def again(key: tuple, rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows([], [], [], [])
        fp = rows.column("fp").to_numpy()
        at, leaf, home = pickle.loads(tree.column("tree")[0].as_py()).route(fp.view(np.uint64), rows.column("home").to_numpy(zero_copy_only=False))
        return _rows(np.full(len(at), key[0].as_py()), key[1].as_py() * FAN + leaf, fp[at], home)

    rows, key, done = materialise(fps.select("fp").mapInArrow(first, ROUTED)), ["block", "shard"], []
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
        big = materialise(sizes)
        if big.isEmpty():
            return reduce(DataFrame.union, [*done, rows.withColumn("pieces", F.lit(1))])
        done.append(rows.join(big.select(*key), key, "left_anti").withColumn("pieces", F.lit(1)))
        heavy = rows.join(big, key)
        # About GROW rows of each shard, however large it is; numbers have room for eight levels of subtrees.
        some = heavy.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.ceil(F.lit(GROW << 30) / F.col("n")))
        found = materialise(some.groupBy(*key, "n").applyInArrow(grow, "block int, shard long, n long, splits boolean, tree binary"))
        split = found.where(F.col("splits") & (F.col("shard") < (1 << 57)))
        whole = big.join(split.select(*key), key, "left_anti")
        done.append(rows.join(whole, key).select("block", "shard", "fp", "home", F.ceil(F.col("n") / SPLIT).cast("int").alias("pieces")))
        parts = F.ceil(F.col("n") / DEAL).cast("int")
        dealt = rows.join(split.select(*key, "n"), key).withColumn("salt", F.pmod(F.xxhash64("fp"), parts).cast("int")).drop("n")
        copies = split.select(*key, "tree", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        rows = materialise(dealt.groupBy(*key, "salt").cogroup(copies.groupBy(*key, "salt")).applyInArrow(again, ROUTED))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) whose components are those of all links within `radius` bits."""
    spark, width, r = fps.sparkSession, BITS // blocks, radius // blocks
    masks = [((1 << width) - 1) << (width * b) for b in range(blocks)]
    routed = route(fps, radius, blocks)
    # Piece i of a shard's residents meets piece j of its rows; all but shards that can't be split are one piece.
    other = F.sequence(F.lit(0), F.col("pieces") - 1)
    meets = F.array_union(F.transform(other, lambda j: F.struct(F.col("piece").alias("i"), j.alias("j"))), F.transform(other, lambda i: F.struct(i.alias("i"), F.col("piece").alias("j"))))
    dealt = routed.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")).select("block", "shard", "fp", "home", "piece", F.inline(meets))
    dealt = dealt.select("block", "shard", "i", "j", "fp", (F.col("home") & (F.col("i") == F.col("piece"))).alias("home"))

    def link(key: tuple, part: pa.Table) -> pa.Table:
        fp, home = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "home"))
        top = local_links(fp.view(np.uint64), home, masks[key[0].as_py()], r, radius).up
        off = np.nonzero(top != np.arange(len(top)))[0]
        return pa.table({"a": pa.array(fp[off], pa.int64()), "b": pa.array(fp[top[off]], pa.int64())})

    # Given a number, Spark doesn't pack shards into few tasks; rows are small, but linking them isn't.
    spread = dealt.repartition(shuffle_width(spark, fps.count() * blocks, 8 * SHARD), "block", "shard", "i", "j")
    return spread.groupBy("block", "shard", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, th, fp, component_id of every row."""
    shared_dir(df.sparkSession)
    fps = materialise(fingerprints(df, text, doc_id, k))
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = coupling.components(links(reps.select("fp"), radius, blocks).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    linked = linked.select(F.col("id").alias("fp"), F.col("component").alias("group"))
    named = reps.join(linked, "fp").groupBy("group").agg(F.min("least").alias("least")).join(linked, "group").select("fp", F.struct("least").alias("linked"))
    named = reps.join(named, "fp", "left").select("fp", F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("linked.least")).alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row of each group of near duplicates: texts whose sets of five-word shingles have a Jaccard of at least 0.8.

    Five-word fingerprints go through the trees; links within the radius are checked by the exact similarity. Similar
    texts mostly differ in more bits than a tree can search for: similar.py finds these links from shared shingles.
    """
    rows = similar.described(docs)
    reps = materialise(rows.where("n > 0").groupBy("fp").agg(F.min("node").alias("node"), F.max("node").alias("last")))
    found = links(reps.select("fp"), radius, blocks)
    ends = lambda name: reps.select(F.col("fp").alias(name), F.col("node").alias(f"node_{name}"))
    near = found.join(ends("a"), "a").join(ends("b"), "b").select("node_a", "node_b")
    same = rows.join(reps.where("node < last").select("fp", F.col("node").alias("first")), "fp").where("node <> first").select("node", "first")
    pairs = near.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return similar.first_of_each(docs, rows, similar.groups(docs, rows, pairs))
