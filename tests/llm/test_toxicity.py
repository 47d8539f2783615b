import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm import toxicity as tox

BAD = "idiot moron scum clown".split()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.25)
        w = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        if y:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, 0, y))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 6), st.integers(1, 4))
def test_search_is_exact(seed, block, k, first):
    rng = np.random.default_rng(seed)
    dense = (rng.random((40, 12)) < 0.3) * rng.random((40, 12))
    norm = np.linalg.norm(dense, axis=1)
    rows = [i for i in range(40) if norm[i]]
    tox.FIRST, before = first, tox.FIRST
    try:
        index = tox.Index(np.array(rows), np.array([i % 2 for i in rows]), [(np.nonzero(dense[i])[0], dense[i][dense[i] > 0] / norm[i]) for i in rows], 12, block)
        q = (rng.random(12) < 0.4) * rng.random(12)
        terms = np.nonzero(q)[0]
        got = index.nearest(terms, q[terms], k)
        cos = {i: float(dense[i] @ q / norm[i]) for i in rows}
        want = sorted((round(c, 9) for c in cos.values() if c > 0), reverse=True)[:k]
        assert [round(s, 9) for s, _ in got] == pytest.approx(want)
        assert all(round(cos[int(index.ids[i])], 9) == pytest.approx(round(s, 9)) for s, i in got)
        if got:
            assert got[0][1] not in [i for _, i in index.nearest(terms, q[terms], k, without=got[0][1])]
    finally:
        tox.FIRST = before


def test_spans():
    assert tox.spans(np.array([3, 5, 5, 0]), np.array([5, 5, 8, 1])).tolist() == [3, 4, 5, 6, 7, 0]
    assert tox.spans(np.array([2]), np.array([2])).tolist() == [] == tox.spans(np.array([], int), np.array([], int)).tolist()


def brute(rows, labels, k):
    """Scores from dense vectors of all words, all cosines, and a plain Newton fit of the curve."""
    known = {}
    for i, _, y in labels:
        if not held(i):
            known[i] = max(known.get(i, 0), y)
    texts = {i: Counter(re.findall(r"[^\W\d_]{2,}", t.lower())) for i, t in rows}
    train = sorted(i for i in known if i in texts)
    words = sorted({w for i in train for w in texts[i]})
    counts = lambda i: np.array([texts[i][w] for w in words], float)
    df = np.array([sum(w in c for c in texts.values()) for w in words])
    y = np.array([known[i] for i in train])
    x = np.array([counts(i) for i in train])
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    m0, m1 = (x[y == 0] > 0).sum(0), (x[y == 1] > 0).sum(0)
    p = (m0 + m1 + 1) / (n0 + n1 + 2)
    z = (m1 / n1 - m0 / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    weight = (np.log((1 + len(texts)) / (1 + df)) + 1) * (z * z + 1) / (z * z + tox.SHRINK)

    def vector(c):
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * weight
        return v / np.linalg.norm(v) if v.any() else v

    examples = np.array([vector(c) for c in x])
    share = np.array([sum(v == c for v in known.values()) / n for c, n in ((0, n0), (1, n1))])

    def vote(cos):
        best = [i for i in np.argsort(-cos)[:k] if cos[i] > 0]
        sums = tox.SMOOTH * share
        for i in best:
            sums = sums + np.eye(2)[y[i]] * cos[i] ** 2 * share[y[i]]
        return np.clip(np.log(sums[1] / sums[0]), -12, 12) if best else None

    cosines = examples @ examples.T
    np.fill_diagonal(cosines, 0)
    v = np.array([vote(c) for c in cosines])
    w = share[y]
    size = lambda c: (w * (y == c)).sum() / w.sum() * len(y)
    goal = np.where(y == 1, (size(1) + 1) / (size(1) + 2), 1 / (size(0) + 2))
    ab = np.array([1.0, 0.0])
    f = np.stack([v, np.ones(len(v))], 1)
    for _ in range(500):
        q = 1 / (1 + np.exp(-f @ ab))
        ab = ab - 0.5 * np.linalg.solve((f * (w * q * (1 - q))[:, None]).T @ f + 1e-3 * np.eye(2), f.T @ (w * (q - goal)) + 1e-3 * (ab - [1, 0]))
    prior = sum(known.values()) / len(known)
    out = {}
    for i, _ in rows:
        got = vote(examples @ vector(counts(i)))
        out[i] = prior if got is None else 1 / (1 + np.exp(-ab[0] * got - ab[1]))
    return out


def test_scores_equal_brute_force(spark, docs):
    rows, labels = corpus(160, seed=7)
    rows += [(9000, "nothing of this kind"), (9001, ""), (9002, "Idiot idiot IDIOT")]
    given_ = docs(*rows).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("held_out", F.lit(2))
    labelled = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash")).withColumn("y", F.lit(9))
    got = {r["doc_id"]: r["score"] for r in tox.score(given_, labelled, k=5).collect()}
    want = brute(rows, labels, 5)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in tox.score(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()}
    new = [(i, y) for i, _, y in labels if held(i)]
    assert len(new) > 30 and sum(got[i]["predicted"] == y for i, y in new) / len(new) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(i) for i, r in got.items())
    assert all(not held(e) for r in got.values() for e in r["evidence"])


def test_held_out_labels_have_no_say(spark, docs):
    rows, labels = corpus(200)
    flipped = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    run = lambda ls: {r["doc_id"]: r["score"] for r in tox.score(docs(*rows), spark.createDataFrame(ls, LABELS)).collect()}
    assert run(labels) == run(flipped)


def test_odd_rows(spark, docs, odd, empty):
    rows, labels = corpus(150)
    labels += [(None, 0, 1), (1, 0, None), (0, 0, 1), (0, 0, 0), (7, 0, 1)]
    table = spark.createDataFrame(labels, LABELS)
    got = tox.score(odd.union(docs(*((i + 1000, t) for i, t in rows))), table)
    assert got.count() == 161 and got.where("score IS NULL").count() == 0
    assert tox.score(empty, table).count() == 0
    none = tox.score(odd, spark.createDataFrame([], LABELS)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_words():
    assert tox.tokens("Ab, cd_ef 12 éa!".encode()) == {"ab": 1, "cd": 1, "ef": 1, "éa": 1} and tox.tokens(None) == {}


def test_many_texts_are_searched_and_numbered_at_once(monkeypatch):
    """Equal to one at a time and to the pattern of words, with common and rare terms, over several blocks."""
    monkeypatch.setattr(tox, "COMMON", 7)
    monkeypatch.setattr(tox, "QUERIES", 6)
    rng = np.random.default_rng(3)
    dense = (rng.random((300, 40)) < 0.2) * rng.random((300, 40)) + np.eye(300, 40)[:, ::-1]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-9)[:, None]
    index = tox.Index(np.arange(300), np.arange(300) % 2, [(np.nonzero(r)[0], r[r > 0]) for r in dense], 40, 16)
    queries = [(np.nonzero(r)[0], r[r > 0]) for r in dense[:40]] + [(np.empty(0, int), np.empty(0))]
    for q, near in zip(queries, index.search(queries, 9)):
        assert near == index.nearest(*q, 9)
        cosines = np.sort(np.round(dense[:, q[0]] @ q[1], 12))[::-1][:9]
        assert [c for c, _ in near] == pytest.approx([c for c in cosines if c > 0])
    texts = ["", "Straße ΣΑΣ İstanbul x² ab１２cd ١٢ab ñandú_é 日本語 ét \x00a\nbc de de", "aa AA b c_dd 7ee", None]
    counts = [Counter(re.findall(r"[^\W\d_]{2,}", (t or "").lower())) for t in texts]
    known = sorted({w for c in counts for w in c} - {"de"})
    got = tox.numbers([None if t is None else t.encode() for t in texts], tox.pa.array(known))
    assert [dict(zip((known[i] for i in terms), n)) for terms, n in got] == [{w: n for w, n in c.items() if w in known} for c in counts]
