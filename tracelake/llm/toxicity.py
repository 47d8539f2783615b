"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Fit: a bounded sample of labelled training rows is indexed: at most `per_class` rows of either class, the first by the
hash of their id among those whose text has at most LONGEST bytes. Every word of the sample is a term. A vector's weight
is (1 + ln count) * idf * relevance, of unit length. Document frequencies come from all documents. Relevance is
(z^2 + 1) / (z^2 + SHRINK) with z from the word's presence in the two classes of the sample: it is above zero for every
word and near one for words that surely tell the classes apart; no term is left out. Words that the sample lacks are in
no example and carry no weight. The vectors are put in an order that keeps likes together and
cut into blocks; a term's postings are kept by block with the block's largest weight. per_class and LONGEST bound the
index, whatever the corpus.

Search: of the COMMON commonest terms a block is a small matrix and each term has the block's largest weight; the
others have postings. For a text, the sum of its common terms' largest weights and the block's best sum over the rare
ones bound every cosine in the block. The FIRST blocks by bound give a k-th best cosine; of the others only those whose
bound reaches it are read. Texts are taken QUERIES at a time, and a block is read once for all of these that need it, in
single precision; rows that could be among the k by its error bound are compared in double precision, so the k nearest
examples are exact. Ties go to the example with the smaller id. Votes weigh the cosine squared and, since classes are sampled evenly, their class's share of
all labelled training rows; a logistic curve fitted on left-one-out votes of the sample makes them calibrated
probabilities. A text with no term of the sample gets the smoothed rate of toxic training rows.

Plan: one pass over all texts counts documents by term within each task, the left-one-out votes are a job over the
sample, and a second pass scores whole texts. Texts never move.

Null text counts as empty. Labels of one id that differ count as toxic; null labels are skipped. Without labelled rows
of both classes every score is the prior (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, sliced, table

FOLDS, HELD = 5, 0
PER_CLASS, LONGEST, NEIGHBOURS, BLOCK, FIRST = 4096, 1 << 14, 15, 64, 8
COMMON, QUERIES = 1024, 128
#: Of z squared: what it takes for half the weight.
SHRINK = 200.0
#: Added to either side of a vote.
SMOOTH = 0.05
WORD = re.compile(r"[^\W\d_]{2,}")
ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def tokens(text: bytes | None) -> Counter:
    """The words of a text and their counts."""
    return Counter(WORD.findall(text.decode().lower())) if text else Counter()


@cache
def letters() -> np.ndarray:
    """By code point: itself if it stands in words, else a space."""
    return np.array([c if chr(c).isalnum() and not chr(c).isdecimal() else 32 for c in range(0x110000)], np.uint32)


def lettered(text: bytes | None) -> str:
    """The text in lower case with spaces instead of all that stands in no word. Single letters stay; they are no terms."""
    lower = text.decode().lower() if text else ""
    if lower.isascii():
        return lower.translate(ASCII)
    return letters()[np.frombuffer(lower.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end, one after the other."""
    size = end - start
    out = np.ones(int(size.sum()), np.int64)
    if not len(out):
        return out
    some = size > 0
    start, end, size = start[some], end[some], size[some]
    at = np.cumsum(size)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - end[:-1] + 1
    return np.cumsum(out)


def likes(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int) -> list[int]:
    """The rows in an order that puts likes together: halved by the principal direction of their COMMON commonest terms, down to blocks. Only the speed of a search depends on it."""
    if not vectors:
        return []
    seen = np.bincount(np.concatenate([t for t, _ in vectors]), minlength=terms)
    common = np.argsort(-seen, kind="stable")[:COMMON]
    place = np.full(terms, -1)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(vectors), len(common)), np.float32)
    for row, (t, w) in zip(dense, vectors):
        at = place[t]
        row[at[at >= 0]] = w[at >= 0]
    out, stack = [], [np.arange(len(vectors))]
    while stack:
        rows = stack.pop()
        if len(rows) <= block:
            out += rows.tolist()
            continue
        x = dense[rows] - dense[rows].mean(0)
        v = x[np.argmax((x * x).sum(1))]
        for _ in range(8):
            v = x.T @ (x @ v)
            v = v / (np.linalg.norm(v) + 1e-30)
        half = -(-len(rows) // (2 * block)) * block  # whole blocks on the left
        order = np.argsort(x @ v, kind="stable")
        stack += [rows[order[half:]], rows[order[:half]]]
    return out


class Index:
    """Block-max index of unit vectors over numbered terms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        """vectors: (terms, weights) of each row, of length one."""
        order = likes(vectors, terms, block)
        self.n, self.block, self.blocks, self.terms = len(order), block, -(-len(order) // block), terms
        self.ids, self.labels = np.asarray(ids, np.int64)[order], np.asarray(labels, np.int8)[order]
        self.vectors = [vectors[i] for i in order]
        # Rows one after the other.
        self.begin = np.cumsum([0, *(len(t) for t, _ in self.vectors)])
        self.term = np.concatenate([t for t, _ in self.vectors]).astype(np.int64) if order else np.empty(0, np.int64)
        self.weight = np.concatenate([w for _, w in self.vectors]) if order else np.empty(0)
        seen = np.bincount(self.term, minlength=terms)
        common = np.argsort(-seen, kind="stable")[:COMMON]
        self.place = np.full(terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        # Postings of the rare terms.
        row = np.repeat(np.arange(self.n), np.diff(self.begin))
        rare = np.nonzero(self.place[self.term] < 0)[0] if self.n else np.empty(0, np.int64)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.start = np.searchsorted(self.term[rare], np.arange(terms + 1))
        self.row, self.rare = row[rare].astype(np.int32), self.weight[rare]
        #: A sum of so many products of single precision is wrong by less than this share; doubled for a comparison of two.
        self.error = 2.5 * (len(common) + 8) * 2.0**-24
        self.dense = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "top": None}

    def _open(self) -> None:
        """The common terms' weights by row, and their largest by block."""
        width = min(COMMON, self.terms)
        self.dense = np.zeros((self.blocks * self.block, width), np.float32)
        row, at = np.repeat(np.arange(self.n), np.diff(self.begin)), self.place[self.term]
        self.dense[row[at >= 0], at[at >= 0]] = self.weight[at >= 0]
        self.dense = self.dense.reshape(self.blocks, self.block, width)
        self.top = np.ascontiguousarray(self.dense.max(1).T)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, row) with a positive cosine, best first; row `without` is left out."""
        return self.search([(terms, weights)], k, [without])[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest() of each query."""
        out = []
        for low in range(0, len(queries), QUERIES):
            out += self._some(queries[low : low + QUERIES], k, (without or [-1] * len(queries))[low : low + QUERIES])
        return out

    def _some(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[list[tuple[float, int]]]:
        if not self.n or not sum(len(t) for t, _ in queries):
            return [[] for _ in queries]
        if self.dense is None:
            self._open()
        q, size = len(queries), self.blocks * self.block
        who, term = np.repeat(np.arange(q), [len(t) for t, _ in queries]), np.concatenate([t for t, _ in queries])
        weight, at = np.concatenate([w for _, w in queries]), self.place[term]
        common, rare = at >= 0, at < 0
        dense = np.zeros((q, self.top.shape[0]), np.float32)
        dense[who[common], at[common]] = weight[common]
        first, last = self.start[term[rare]], self.start[term[rare] + 1]
        post = spans(first, last)
        sums = np.bincount(np.repeat(who[rare] * size, last - first) + self.row[post], np.repeat(weight[rare], last - first) * self.rare[post], q * size)
        sums = sums.astype(np.float32).reshape(q, self.blocks, self.block)
        bound = (dense @ self.top + sums.max(2)) * np.float32(1 + self.error)
        cosines, left_out = np.zeros((q, self.blocks, self.block), np.float32), [(i, *divmod(r, self.block)) for i, r in enumerate(without) if r >= 0]

        def read(wanted: np.ndarray) -> None:
            for b in np.nonzero(wanted.any(0))[0]:
                i = np.nonzero(wanted[:, b])[0]
                cosines[i, b] = dense[i] @ self.dense[b].T + sums[i, b]
            for place in left_out:
                cosines[place] = 0

        chosen = np.zeros((q, self.blocks), bool)
        best = np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
        np.put_along_axis(chosen, best, True, 1)
        read(chosen)
        found = np.take_along_axis(cosines, best[:, :, None], 1).reshape(q, -1)
        # No less than the k-th best of all has to be.
        floor = np.partition(found, -k, axis=1)[:, -k] * np.float32(1 - self.error) if found.shape[1] >= k else np.zeros(q, np.float32)
        read((bound >= floor[:, None]) & (bound > 0) & ~chosen)
        cosines = cosines.reshape(q, size)
        out, exact = [], np.zeros(self.terms)
        near = (cosines >= floor[:, None]) & (cosines > 0)
        for i, (t, w) in enumerate(queries):
            rows = np.nonzero(near[i])[0]
            if len(rows) > k:
                c = cosines[i, rows]
                rows = rows[c >= np.partition(c, -k)[-k] * np.float32(1 - self.error)]
            if not len(rows):
                out.append([])
                continue
            exact[t] = w
            low, high = self.begin[rows], self.begin[rows + 1]
            entries = spans(low, high)
            found = np.round(np.add.reduceat(self.weight[entries] * exact[self.term[entries]], np.cumsum(high - low) - (high - low)), 12)
            exact[t] = 0
            out.append([(float(found[j]), int(rows[j])) for j in np.lexsort((self.ids[rows], -found))[:k] if found[j] > 0])
        return out


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector of a text; weight is idf * relevance by term."""
    w = (1 + np.log(counts)) * weight[terms]
    norm = np.sqrt((w * w).sum())
    return (terms, w / norm) if norm else (terms[:0], w[:0])


def relevance(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """Of each term, from its presence in the sampled rows of either class."""
    seen = [np.zeros(terms), np.zeros(terms)]
    for (t, _), y in zip(vectors, labels):
        seen[y][t] += 1
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    p = (seen[0] + seen[1] + 1) / (n[0] + n[1] + 2)
    z2 = (seen[1] / n[1] - seen[0] / n[0]) ** 2 / (p * (1 - p) * (1 / n[0] + 1 / n[1]))
    return (z2 + 1) / (z2 + SHRINK)


class Model:
    def __init__(self, index: Index, weight: np.ndarray, share: tuple[float, float], empty: float, k: int):
        self.index, self.weight, self.share, self.empty, self.k = index, weight, share, empty, k
        self.a, self.b = 1.0, 0.0

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        sums = [SMOOTH * self.share[0], SMOOTH * self.share[1]]
        for cosine, row in near:
            y = self.index.labels[row]
            sums[y] += cosine * cosine * self.share[y]
        return max(-12.0, min(12.0, math.log(sums[1] / sums[0]))) if near else None

    def left_out(self, rows: list[int]) -> list[float | None]:
        """The vote on each of these examples by the others."""
        return [self.vote(near) for near in self.index.search([self.index.vectors[r] for r in rows], self.k, rows)]

    def calibrate(self, rows: list[int], votes: list[float]) -> None:
        """Platt's curve on left-one-out votes; classes count by their share of all labelled rows."""
        x, y = np.array(votes), self.index.labels[np.array(rows, int)].astype(int)
        if len(set(y.tolist())) < 2:
            return
        weight = np.where(y == 1, self.share[1], self.share[0])
        n1, n0 = (weight * y).sum() / weight.sum() * len(y), (weight * (1 - y)).sum() / weight.sum() * len(y)
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        f, theta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])

        def loss(t: np.ndarray) -> float:
            z = f @ t
            return float((weight * (np.logaddexp(0, z) - goal * z)).sum() + 5e-4 * ((t - [1.0, 0.0]) ** 2).sum())

        for _ in range(100):
            p = 1 / (1 + np.exp(-f @ theta))
            grad = f.T @ (weight * (p - goal)) + 1e-3 * (theta - [1.0, 0.0])
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            step, now = np.linalg.solve(hess, grad), loss(theta)
            while np.abs(step).max() > 1e-9 and loss(theta - step) > now:
                step = step / 2
            theta = theta - step
            if np.abs(step).max() < 1e-9:
                break
        if theta[0] > 0:
            self.a, self.b = map(float, theta)

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Probability of each text (terms, counts), and the doc_ids of the nearest examples as evidence."""
        out = []
        for near in self.index.search([unit(*t, self.weight) for t in texts], self.k):
            v = self.vote(near)
            out.append((self.empty, []) if v is None else (1 / (1 + math.exp(-self.a * v - self.b)), [int(self.index.ids[i]) for _, i in near[:3]]))
        return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[tuple[int, int, bytes]], tuple[int, int]]:
    """Training rows (doc_id, label, text), at most per_class of each, and the counts of all training labels by class. Of rows that repeat an id the least text counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    short = docs.where(F.octet_length("text") <= LONGEST)
    there = known.join(short.select("doc_id"), "doc_id", "left_semi")
    picked = [r for y in (0, 1) for r in there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    # At most 2 * per_class texts of LONGEST bytes.
    chosen = docs.sparkSession.createDataFrame(picked or [(None, 0)], "doc_id long, y int")
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [(r["doc_id"], r["y"], bytes(r["text"])) for r in rows], (sizes.get(0, 0), sizes.get(1, 0))


def numbers(texts: list[bytes | None], known: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The known terms of each text, in order, and their counts. known: the words, in order."""
    found = pc.split_pattern(pa.array(map(lettered, texts), pa.string()), " ")
    term = pc.fill_null(pc.index_in(found.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())
    key, counts = np.unique((row * len(known) + term)[term >= 0], return_counts=True)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * len(known))
    term, counts = key % max(1, len(known)), counts.astype(float)
    return [(term[x:y], counts[x:y]) for x, y in zip(ends[:-1], ends[1:])]


def frequencies(docs: DataFrame, shared: Broadcast) -> tuple[np.ndarray, int]:
    """In how many of all rows each term stands, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(len(known) + 1, np.int64)
        for b in sliced(batches, 0):
            for terms, _ in numbers(b.column(0).to_pylist(), known):
                seen[terms] += 1
            seen[-1] += b.num_rows
        (at,) = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["t", "n"])

    out = np.zeros(len(shared.value) + 1)
    found = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out[found["t"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, examples: list[tuple[int, int, bytes]], sizes: tuple[int, int], shared: Broadcast, k: int = NEIGHBOURS) -> Model:
    spark, terms = docs.sparkSession, len(shared.value)
    df, total = frequencies(docs, shared)
    raw = [v for low in range(0, len(examples), 1024) for v in numbers([text for _, _, text in examples[low : low + 1024]], shared.value)]
    ids, labels = np.array([i for i, _, _ in examples], np.int64), np.array([y for _, y, _ in examples], np.int8)
    weight = (np.log((1 + total) / (1 + df)) + 1) * relevance(raw, labels, terms)
    vectors = [unit(*v, weight) for v in raw]
    some = [i for i, v in enumerate(vectors) if len(v[0])]
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    model = Model(Index(ids[some], labels[some], [vectors[i] for i in some], terms), weight, (sizes[0] / n[0], sizes[1] / n[1]), sizes[1] / max(1, sum(sizes)), k)
    whole = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = whole.value.left_out(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64())], names=["row", "vote"])

    # One row an example.
    votes = spark.range(0, model.index.n, 1, -(-model.index.n // 256) or 1).mapInArrow(run, "row long, vote double").where("vote IS NOT NULL").collect()
    votes.sort(key=lambda r: r["row"])
    whole.unpersist()
    model.calibrate([r["row"] for r in votes], [r["vote"] for r in votes])
    model.index.vectors = []
    return model


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (up to three nearest examples) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    examples, sizes = sample(docs, labels, per_class)
    held = (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    if len({y for _, y, _ in examples}) < 2:
        prior = F.lit(sizes[1] / max(1, sum(sizes)))
        return docs.select("doc_id", held, prior.alias("score"), (prior >= 0.5).cast("int").alias("predicted"), F.array().cast("array<long>").alias("evidence"))
    shared = spark.sparkContext.broadcast(pa.array(sorted({w for _, _, text in examples for w in tokens(text)}), pa.string()))
    model = spark.sparkContext.broadcast(fit(docs, examples, sizes, shared, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, done = model.value, shared.value, {}
        for b in sliced(batches, 1):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            keys = [blake2b(t, digest_size=16).digest() for t in texts]
            if len(done) > 50_000:
                done.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in done}
            done |= zip(new, m.scores(numbers([*new.values()], known)))
            out = [done[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    scored = docs.mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
