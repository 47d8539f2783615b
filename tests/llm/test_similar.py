import random

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicates
from tracelake.llm import similar, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    """Ids that stay: the least of each component of pairs with a Jaccard of at least 0.8."""
    sets, comp = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sorted(min(r[0] for r, c in zip(rows, comp) if c == x) for x in set(comp))


def test_stage_equals_brute_force(spark, docs, monkeypatch):
    """Copies with changed words on both sides of the bound, chains of them, a phrase that all share, and a large group."""
    monkeypatch.setattr(similar, "OFTEN", 3)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, phrase = [], [word() for _ in range(8)]
    for _ in range(25):
        text = [*phrase, *(word() for _ in range(rng.randint(3, 120)))]
        for step in range(6):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(80)]
    rows += [(1000 + i, " ".join([*base[:i], word(), *base[i + 1 :]])) for i in range(60)]
    rng.shuffle(rows)
    want = brute(rows)
    assert sorted(r["doc_id"] for r in near_duplicates(spark, docs(*rows), "").collect()) == want
    assert len(want) < len(rows) - 100


def test_odd_rows(odd, empty, docs):
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one(odd.withColumn("th", F.lit(1)).withColumn("node", F.lit(1))).select("doc_id").collect()) == [-1, 1, 5, 7, 8, 9, 10]
    assert simhash.keep_one(empty).count() == 0
    rows = docs((3, "the very first text of all"), (7, "the very first text of all"), (7, "another text with the same id"), (7, "another text with the same id"), (9, None), (10, ""))
    assert sorted((r["doc_id"], r["text"] or "") for r in simhash.keep_one(rows).collect()) == [(3, "the very first text of all"), (7, "another text with the same id"), (9, "")]


def test_repeated_rows_leave_one(docs):
    """Of rows with the same id and text one stays, always the same."""
    rows = [(4, "five words are in here", "en", f"s{i}") for i in range(5)]
    assert {tuple(simhash.keep_one(docs(*order)).collect()[0]) for order in (rows, rows[::-1])} in [{(4, "five words are in here", "en", f"s{i}", None)} for i in range(5)]


def test_signatures_drop_no_similar_pair(spark):
    """Random pairs of sets, of sizes on both sides of a power of two: none of similarity 4/5 goes, nearly all of half that do."""
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        n = rng.choice([1, 4, 9, 31, 33, 60, 70, 250, 270, 900])
        a = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        b = a[: int(n * rng.choice([0.3, 0.6, 0.8, 0.9, 1]))] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(int(n * rng.choice([0, 0.05, 0.1, 0.4])))]
        x, y = (np.array(sorted(set(v)), np.int64) for v in (a, b))
        rows.append((len(rows), similar.signature(x).tolist(), similar.signature(y).tolist(), len(x), len(y), len({*a} & {*b}) / len({*a} | {*b})))
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>, n int, m int, sim double")
    got = df.select("sim", similar.could(F.col("x"), F.col("y"), F.col("n"), F.col("m")).alias("could")).collect()
    assert all(r["could"] for r in got if r["sim"] >= 0.8) and any(r["sim"] >= 0.8 for r in got)
    assert sum(r["could"] for r in got if r["sim"] < 0.45) <= 0.1 * sum(r["sim"] < 0.45 for r in got)


def test_texts_that_share_a_phrase_are_not_fetched(spark, docs, monkeypatch):
    """Sets are only read again for pairs that may be similar, not for all that share a rare phrase."""
    fetched, real = [], similar.stored
    monkeypatch.setattr(similar, "stored", lambda df: (out := real(df), fetched.append(out.count()) if out.columns == ["node", "grams"] else None)[0])
    rng = random.Random(2)
    phrase = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*phrase, *(f"w{rng.randrange(10**6)}" for _ in range(50))])) for i in range(20)]
    rows += [(100, rows[0][1] + " more")]
    assert sorted(r["doc_id"] for r in near_duplicates(spark, docs(*rows), "").collect()) == list(range(20))
    assert sum(fetched) == 2
