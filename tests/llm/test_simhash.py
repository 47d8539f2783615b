import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import simhash
from tracelake.llm.shingle import fingerprint, hashes
from tracelake.operators import coupling


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    """Component of each fingerprint's index, by brute force."""
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_fingerprint_equals_definition_and_spark(spark):
    texts = ["", "One", "one two", "One two  three", "a b c d e f g a b c", "É é É", "x\x1cy z w", "tab\tand\x0bmore\x0cwhite\r\nspace"]
    for t in texts:
        assert fingerprint(hashes(t.encode(), 3)) & (2**64 - 1) == plain(t)
    row = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("seed", range(4))
def test_tree_keeps_every_pair(seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in fps[:200]]
    arr = np.array(fps, np.uint64)
    for block in range(2):
        mask = ((1 << 32) - 1) << (32 * block)
        tree = simhash.Tree(arr[::3], mask, 1, 16)
        at, leaf, home = tree.route(arr)
        assert sorted(at[home]) == list(range(len(arr)))
        lives = dict(zip(at[home], leaf[home]))
        there = set(zip(at, leaf))
        near = [(i, j) for i in range(len(fps)) for j in range(len(fps)) if ((fps[i] ^ fps[j]) & mask).bit_count() <= 1]
        assert all((j, lives[i]) in there for i, j in near)


def test_local_links_equal_brute_force():
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(200)]
    fps += [f ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for f in fps for _ in range(2)]
    arr = np.array(sorted(set(fps)), np.uint64)
    forest = simhash.local_links(arr, np.ones(len(arr), bool), (1 << 64) - 1, 3, 3, leaf=8)
    assert forest.up.tolist() == classes(arr.tolist(), 3)


def rows_of(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))], "fp long")


def linked(spark, fps, **how):
    """Component of each distinct fingerprint, as the least in it by its signed value."""
    edges = simhash.links(rows_of(spark, fps), **how).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = {r["id"]: r["component"] for r in coupling.components(edges).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(set(fps))]
    return [found.get(f, f) for f in signed], signed


def wanted(fps, signed, radius):
    comp = classes([f & (2**64 - 1) for f in signed], radius)
    least = {c: min(f for f, d in zip(signed, comp) if d == c) for c in set(comp)}
    return [least[c] for c in comp]


@pytest.mark.parametrize("blocks", [2, 4])
def test_components_equal_brute_force(spark, monkeypatch, blocks):
    """With shards far over SPLIT: subtrees of subtrees, visitors, and many parts that are equal."""
    for name, value in {"SHARD": 16, "SPLIT": 60, "TOP": 4, "FAN": 16, "SAMPLE": 64, "GROW": 32, "DEAL": 90}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)] + [rng.getrandbits(48) << 16 for _ in range(80)]
    fps = base + [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in base for k in (1, 2, 3, 5)]
    got, signed = linked(spark, fps, blocks=blocks)
    assert got == wanted(fps, signed, 3)


def test_shards_that_cannot_be_split(spark, monkeypatch):
    """All within few bits of each other: no vantage point parts them, so pieces meet in pairs."""
    for name, value in {"SHARD": 8, "SPLIT": 12, "TOP": 4, "FAN": 4, "SAMPLE": 64, "GROW": 16, "DEAL": 50}.items():
        monkeypatch.setattr(simhash, name, value)
    near = [1 << i | 1 << j for i in range(12) for j in range(i)] + [0x7 << 40, 0x7F << 40, 0xFFFF << 40]
    routed = simhash.route(rows_of(spark, near))
    assert routed.agg(F.max("pieces")).first()[0] > 1
    got, signed = linked(spark, near)
    assert got == wanted(near, signed, 3)


def test_two_thousand_shards_over_the_limit(spark, monkeypatch):
    for name, value in {"SHARD": 2, "SPLIT": 4, "SAMPLE": 4096, "GROW": 64}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5200)]
    close = {f: f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))) for f in base[:800]}
    rows = rows_of(spark, base + [*close.values()])
    sizes = []
    plain_route = simhash.route
    monkeypatch.setattr(simhash, "route", lambda *a, **k: sizes.append(plain_route(*a, **k)) or sizes[-1])
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(rows).collect()}
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    want = {tuple(sorted((sign(f), sign(g)))) for f, g in close.items() if (f ^ g).bit_count() <= 3}
    assert pairs == want
    shards = sizes[0].groupBy("block", "shard").count()
    assert shards.agg(F.max("shard")).first()[0] >= 1 << 16  # subtrees were grown
    # Each fingerprint lives in four shards, whatever was split.
    assert sizes[0].where("home").count() == 4 * rows.count()


def test_rows_dealt_stay_flat():
    """Four a fingerprint, at a thousand and at a million: parts within r = 0 have no visitors."""
    rng = np.random.default_rng(1)
    for n in (1_000, 1_000_000):
        fps = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        dealt = sum(len(simhash.Tree(fps[:8192], 0xFFFF << (16 * b), 0, min(simhash.TOP, -(-n // simhash.SHARD))).route(fps)[0]) for b in range(4))
        assert dealt == 4 * n


def test_odd_rows(odd, empty):
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(odd.withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("th", F.lit(1))).collect())
    assert got[0] == (-1, None) and [g for g in got if g[0] in (1, 2, 3)] == [(1, 1), (2, 1), (3, 1)]
    assert [g for g in got if g[0] in (5, 6)] == [(5, 5), (5, 5), (6, 5)] and len(got) == 11
    assert simhash.near_duplicates(empty).count() == 0


def test_ids_of_any_size(docs):
    """Ids at either end of the range, and texts that only rows without an id have."""
    rows = docs((2**63 - 1, "a b c"), (2**63 - 2, "d e f"), (-(2**63), "g h i"), (None, "j k l"), (None, "m n o"), (None, "a b c"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(2**63 - 1, 2**63 - 1), (2**63 - 2, 2**63 - 2), (-(2**63), -(2**63)), (None, None), (None, None), (None, 2**63 - 1)], key=str)


def test_query(spark, tmp_path, docs):
    docs((1, "a b c d"), (2, "A b C d"), (3, None)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash_vptree(spark, str(tmp_path)).collect()}
    assert got == {1: (f"{plain('a b c d'):016x}", 1), 2: (f"{plain('a b c d'):016x}", 1), 3: ("0" * 16, 3)}
