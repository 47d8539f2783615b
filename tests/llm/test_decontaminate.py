import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from tracelake.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def words(t):
    return (t or "").lower().split()


def grams(w):
    return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            n, theirs = len(words(x)), grams(words(x))
            best = 0.0
            for s in range(len(w)):
                mine = grams(w[s : s + n])
                union = sum((mine | theirs).values())
                best = max(best, sum((mine & theirs).values()) / union if union else 0.0)
            if n and best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 13, 14, 20, 28, 29, 40, 54, 70, 120])]
    docs = []
    for d in range(60):
        i, x = rng.choice(items)
        w = x.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(at, word())
            elif kind == 1 and len(w) > 1:
                del w[at % len(w)]
            else:
                w[at % len(w)] = word()
        around = lambda: [word() for _ in range(rng.randint(0, 15))]
        docs.append((d, " ".join([*around(), *(w if rng.random() < 0.8 else []), *around()])))
    return docs, items


def mark(w):
    """Fingerprint by the operator's definition: shingles are hashes of word hashes."""
    signed = lambda h: (h - (1 << 64) if h >> 63 else h).to_bytes(8, "little", signed=True)
    hashes = [xxh64_intdigest(x.encode(), 42) for x in w]

    def chain(part):
        seed = 42
        for h in part:
            seed = xxh64_intdigest(signed(h), seed)
        return seed

    grams = [chain(hashes[i : i + 5]) for i in range(max(1, len(w) - 4))]
    return sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))


def within_radius(docs, items, radius):
    """The brute-force pairs, each with its best window of those whose fingerprint is within the radius."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            theirs, best, print_ = grams(v), 0.0, mark(v)
            for s in range(len(w)):
                mine = grams(w[s : s + len(v)])
                value = sum((mine & theirs).values()) / sum((mine | theirs).values())
                if value >= 0.8 and value > best and (mark(w[s : s + len(v)]) ^ print_).bit_count() <= radius:
                    best = value
            if best:
                out[d, i] = round(best, 9)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs, seed):
    """At the shipped radius: all windows within it, and on these texts no pair is lost beyond it."""
    rows, items = make(seed)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dc.contaminated(docs(*rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == within_radius(rows, items, dc.RADIUS)
    assert len(brute(rows, items).keys() - got.keys()) <= 1


def test_near_finds_all_within_the_radius(spark):
    rng = random.Random(4)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    items = [(i, 9 + i % 2, rng.getrandbits(64)) for i in range(12)]
    windows = [(n, k, f ^ sum(1 << b for b in rng.sample(range(64), d))) for k, (i, n, f) in enumerate(items * 22) for d in [k // 12]]
    left = spark.createDataFrame([(n, w, sign(f)) for n, w, f in windows], "n int, w long, fp long")
    right = spark.createDataFrame([(i, n, sign(f)) for i, n, f in items], "item_id long, n int, fp long")
    got = {(r["w"], r["item_id"], r["hamming"]) for r in dc.near(left, right).collect()}
    want = {(w, i, (f ^ g).bit_count()) for n, w, f in windows for i, m, g in items if n == m and (f ^ g).bit_count() <= 18}
    assert got == want and len(want) >= 12 * 19
    assert dc.thresholds(18) == [4, 4, 4, 3] and [sum(t + 1 for t in dc.thresholds(r)) for r in (0, 1, 3, 7, 24)] == [1, 2, 4, 8, 25]
    assert len(dc.within(16, 4)) == 2517


def test_anchors_follow_rarity_and_keep_all(spark, docs, monkeypatch):
    rows, items = make(3)
    bench = spark.createDataFrame(items, ITEMS)
    run = lambda: sorted(tuple(r) for r in dc.contaminated(docs(*rows), bench).collect())
    first = run()
    monkeypatch.setattr(dc, "SAMPLE", 2)
    monkeypatch.setattr(dc, "MARKS", 1 << 7)  # nearly every text is let through
    assert run() == first and first


def test_long_items(spark, docs):
    """More shingles than sixteen bits count."""
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(50_000)}" for _ in range(66_000))
    got = dc.contaminated(docs((1, f"before {item} after"), (2, item[: len(item) // 3])), spark.createDataFrame([(1, item)], ITEMS), least=0.99999).collect()
    assert [(r["doc_id"], r["start"], r["n_words"], r["similarity"], r["hamming"]) for r in got] == [(1, 1, 66_000, 1.0, 0)]


def test_anchors_cover_what_may_be_missing(spark):
    items = [(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 200)]
    rows = dc.anchors(spark.createDataFrame(items, ITEMS).select("item_id", dc.words(F.col("text")).alias("words"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["item_id"], []).append(int(r["word"][1:]))
    for n, text in items:
        total = max(1, n - 4)
        covered = set()
        for p in by[n]:
            mine = {s for s in range(total) if s <= p < s + 5}
            assert not covered & mine
            covered |= mine
        assert len(covered) > int(total * 0.2 + 1e-9)


def test_simhash_equals_definition(spark):
    words_ = [f"s{i}" for i in range(9)]
    df = spark.createDataFrame([(1, words_)], "k int, w array<string>").select("k", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    hs = [xxh64_intdigest(w.encode(), 42) for w in words_]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert dc.simhash(df, "h", ["k"]).first()["fp"] & (2**64 - 1) == want


def test_clean_drops_only_contaminated(spark, docs):
    item = " ".join(f"question{i}" for i in range(20))
    rows = [(1, f"before it {item} after"), (2, f"Before\n\n{item.upper()}"), (3, "quite another text that has question1 in it and nothing else"), (4, None), (5, "")]
    kept = dc.clean(docs(*rows), spark.createDataFrame([(1, item), (2, None), (3, "")], ITEMS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "x y z"), (4, "alone")], ITEMS)
    got = dc.contaminated(odd.withColumn("words", F.lit(1)).withColumn("start", F.lit(1)), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(5, 1), (6, 1), (5, 2), (6, 2), (10, 4)}
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(odd, spark.createDataFrame([], ITEMS)).count() == 0
