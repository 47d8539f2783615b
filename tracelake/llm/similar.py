"""Links between texts by the exact Jaccard similarity of five-word shingles: every pair of at least 4/5 is linked.

A text's set is that of the hashes of its K-word shingles. Equal sets are folded first. Two sets of similarity 4/5 share
one of the first n - ceil(4n/5) + 1 shingles of each, in any order that is the same for all sets; here shingles that
a bounded sample of texts shows to be common come last, the others go by hash. So only sets that share such a shingle
are candidates, and no candidate is left out: the sample decides the order only. All candidates are compared by their
whole sets.

A large group isn't spelled out as pairs. The pairs that the fingerprint trees give are compared first. Then in STARS
rounds the sets of each shingle that HOT or more sets share are compared with one of them, and sets that are linked by
then, over whatever way, are not compared any more; after the rounds all candidates of different components are. Of
these a pair is dropped only if the shared shingles of its two prefixes and all that is beyond the prefixes together
can't reach 4/5. Of all pairs those go whose signatures, bitmaps of their sets, differ in more bits than sets of
similarity 4/5 can: each such bit is a shingle that one set has and the other hasn't. Texts are read again only for sets
that are left to compare, which a bitmap of BITS text hashes picks without moving any text; what it lets through by
accident meets no pair.

Null text counts as empty; texts without words have the empty set and are one group.
"""


from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators import coupling
from .common import numbered, restored, stored
from .shingle import fingerprint, hashes

K, STARS, HOT, BITS = 5, 2, 32, 1 << 24
#: The sample: about this many texts; shingles in at least OFTEN of them are common ones, of which the first MOST count.
SAMPLE, OFTEN, MOST = 8192, 4, 65536


def shingles(data: bytes | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(hashes(data, k).view(np.int64))


def _node(grams: np.ndarray) -> int:
    """The set's hash."""
    h = xxh64_intdigest(grams.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def prefix(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share one. common: sorted; rank: the rarer, the less."""
    order = np.zeros(len(grams), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order = np.where(common[at] == grams, rank[at], 0)
    n = len(grams)
    return grams[np.lexsort((grams, order))[: n - -(-4 * n // 5) + 1]]


def signature(grams: np.ndarray) -> np.ndarray:
    """A bitmap of the shingles, as longs: the next power of two of n / 32 of them. One of half as many longs is the or of its halves."""
    words = 1 << max(0, (-(-len(grams) // 32) - 1).bit_length())
    out, at = np.zeros(words, np.uint64), grams.view(np.uint64) & np.uint64(64 * words - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def could(x: Column, y: Column, n: Column, m: Column) -> Column:
    """False only for signatures of sets, of sizes n and m, that are less similar than 4/5: similar ones differ in at most (n + m) / 9 shingles."""

    def folded(long: Column, short: Column) -> Column:
        return F.transform(short, lambda _, i: F.get(long, i).bitwiseOR(F.get(long, i + F.size(short))))

    a = F.when(F.size(x) > F.size(y), folded(x, y)).otherwise(x)
    b = F.when(F.size(y) > F.size(x), folded(y, x)).otherwise(y)
    return 9 * F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c) <= n + m


def _sets(rows: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """The named columns and `grams` instead of the text, which is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                grams = pa.array([shingles(t.as_py()) for t in part.column(len(names))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], grams], names=[*names, "grams"])

    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in zip(names, types)), "grams array<long>"]))


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    total = rows.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 20)) < min(1 << 20, -(-(SAMPLE << 20) // max(total, 1))))
    seen = _sets(some.select("th", "text"), ["th"], ["long"]).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = seen.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "gram").limit(MOST).toArrow()
    gram, n = found["gram"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, th, node (the set's hash), n, fp (the fingerprint), head (the set's prefix) and sig (its signature) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                nodes, sizes, fps, heads, sigs = [], [], [], [], []
                for t in part.column(2):
                    h = hashes(t.as_py(), K)
                    s = np.unique(h.view(np.int64))
                    nodes.append(_node(s)), sizes.append(len(s)), fps.append(fingerprint(h)), heads.append(prefix(s, *shared.value)), sigs.append(signature(s))
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "n", "fp", "head", "sig"])

    return stored(rows.mapInArrow(run, "doc_id long, th long, node long, n int, fp long, head array<long>, sig array<long>"))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """The row to keep for each key: the least id, then text hash; no id comes last."""
    return rows.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("x")).select(key, "x.doc_id", "x.th")


def _bitmap(spark: SparkSession, numbers: DataFrame):
    """Broadcast: the numbers, the only column, modulo BITS, a byte for eight."""
    bits = np.zeros(BITS, bool)
    # At most BITS numbers.
    bits[numbers.select(F.pmod(numbers[0], F.lit(BITS)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def _has(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bit = numbers & (BITS - 1)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def _posted(rows: DataFrame) -> DataFrame:
    """(gram, node, n) for each shingle in the prefixes of different sets. Most stand in one only: a bitmap keeps them from being moved again."""
    some = rows.where("n > 0")
    seen = some.select("node", F.explode("head").alias("gram")).groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = stored(seen.where("lo < hi").select("gram"))
    there = _bitmap(rows.sparkSession, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram = b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
            kept = _has(there.value, gram)
            yield pa.RecordBatch.from_arrays([pa.array(gram[kept]), b.column(0).take(pa.array(row[kept])), b.column(1).take(pa.array(row[kept]))], names=["gram", "node", "n"])

    return stored(some.select("node", "n", "head").mapInArrow(run, "gram long, node long, n int").join(shared, "gram").distinct())


def groups(docs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame | None:
    """(node, component) of the sets that are linked to others; None without any link. first: pairs (a, b) to compare first."""
    spark = docs.sparkSession
    posted = _posted(rows)
    near = "5 * least(n, m) >= 4 * greatest(n, m)"
    ends = [F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")]

    def known(pairs: DataFrame) -> DataFrame:
        """(node, n, sig, th) of the pairs' nodes, th of one of the texts."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))

    def sets(wanted: DataFrame) -> DataFrame:
        """(node, grams) of the sets of texts with the hashes `wanted`, and of some others."""
        there = _bitmap(spark, wanted)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in np.nonzero(_has(there.value, b.column(0).to_numpy()))[0]:
                    s = shingles(b.column(1)[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([_node(s)], pa.int64()), pa.array([s], pa.list_(pa.int64()))], names=["node", "grams"])

        texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(some, "node long, grams array<long>")
        return stored(texts.groupBy("node").agg(F.any_value("grams").alias("grams")))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those of similarity 4/5: the common part is at least 4/9 of both sizes together."""
        all_ = stored(known(pairs))
        side = lambda name, x: all_.select(F.col("node").alias(name), F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("th").alias(f"t{x}"))
        left = stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(could(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).select("a", "b", "tx", "ty"))
        if left.isEmpty():
            return left.select("a", "b")
        whole = sets(left.select("tx").union(left.select("ty")))
        both = left.select("a", "b").join(whole.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        return stored(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))

    edges = component = None
    for k in range(-1, STARS + 1):
        now = posted.withColumn("c", F.col("node")) if component is None else posted.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        if k < 0:
            pairs = first
        elif k < STARS:
            pick = F.max_by(F.struct("node", "n", "c"), F.xxhash64("node", F.lit(k)))
            star = now.groupBy("gram").agg(F.count("*").alias("sets"), pick.alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("sets") >= HOT).where("lo < hi")
            star = star.select("gram", F.col("s.node").alias("b"), F.col("s.n").alias("m"), F.col("s.c").alias("d"))
            pairs = now.join(star, "gram").where(f"c <> d AND {near}").select(*ends).distinct()
        else:
            # Pairs of components first, so that members of one component never meet.
            size = [F.min("n").alias("least"), F.max("n").alias("most")]
            kinds = now.groupBy("gram", "c").agg(F.min("node").alias("node"), F.max("node").alias("last"), *size)
            two = kinds.join(kinds.select("gram", *(F.col(x).alias(y) for x, y in zip(("c", "node", "last", "least", "most"), ("d", "b", "end", "low", "high")))), "gram")
            two = two.where("c < d AND 5 * most >= 4 * low AND 5 * high >= 4 * least")
            # Mostly each is one set: then the pair is known already.
            one = (F.col("node") == F.col("last")) & (F.col("b") == F.col("end"))
            alone = two.where(one).select("node", "b", F.col("least").alias("n"), F.col("low").alias("m"))
            other = now.select("gram", F.col("node").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
            many = two.where(~one).select("gram", "c", "d").join(now, ["gram", "c"]).join(other, ["gram", "d"]).where(near).select("node", "b", "n", "m")
            common = alone.union(many).groupBy("node", "b", "n", "m").agg(F.count("*").alias("common"))
            pairs = common.where("9 * (common + greatest(ceil(n * 4 / 5), ceil(m * 4 / 5)) - 1) >= 4 * (n + m)").select(*ends)
        pairs = stored(pairs)
        if pairs.isEmpty():
            continue
        found = similar(pairs)
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        component = stored(coupling.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "node"))
    return component


def first_of_each(docs: DataFrame, rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """One row of each group, that of the least id, then text hash. Rows without an id stay only if no row with an id is in their group; of rows that repeat id and text the one stays whose columns have the least hash."""
    if component is None:
        placed = rows.withColumn("c", F.col("node"))
    else:
        placed = rows.join(component, "node", "left").withColumn("c", F.coalesce("component", "node"))
    kept = _first(placed.select("doc_id", "th", "c"), "c").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    times = rows.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count("*").alias("_n"))
    kept = stored(kept.join(times, kept["_d"].eqNullSafe(times["_d"]) & (kept["_t"] == times["_t"])).select(kept["_d"], kept["_t"], "_n"))
    named = docs.select(*numbered(docs, ("doc_id", "text")))
    left = named.join(kept, named["doc_id"].eqNullSafe(kept["_d"]) & (F.xxhash64(named["text"]) == kept["_t"]))
    twice = left.where("_n > 1").groupBy("_d", "_t").agg(F.min_by(F.struct(*(F.col(c) for c in named.columns)), F.xxhash64(*(F.col(c).cast("string") for c in named.columns))).alias("x")).select("x.*")
    return left.where("_n = 1").select(*named.columns).union(twice).select(*restored(docs, ("doc_id", "text")))
