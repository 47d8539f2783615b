"""Language-model scores from a subword lattice.

The model gives a word the marginal probability over all its segmentations into pieces of an existing vocabulary. The
vocabulary's scores, which are negative ranks for a merge vocabulary, become weights 1 / (SHIFT + rank) (the
Zipf-Mandelbrot law), normalised once over pieces that open a word and the rest: an opening piece ends the word before
it, so the sum over all words is one. These weights are the prior and the start of one step of expectation
maximisation over all training words. A word that was seen in training is a piece as well: its lattice has one arc more,
over the whole word, of weight max(0, c(w) - d) / N, and the paths over other pieces share what the discount leaves,
d V / N; d = n1 / (n1 + 2 n2) from the words seen once and twice. A forward recursion in log space adds up all paths;
characters without a piece fall back to byte pieces. A text's score is the sum over its words and the end, which has its
discounted count alone; pieces_score is the same without the arcs that training added.

Plan: documents are dealt into blocks of about BLOCK rows or BLOCK_BYTES by the hash of id and text. Each block gives its distinct words with training
counts; these meet by word with the vocabulary of all words, whose lattice weights are computed once a word, and return
to their block, where whole texts are scored. So nothing larger than a block's own words is held anywhere, and a
frequent word moves once a block, not once a use. What is gathered grows with the corpus.

Null text counts as empty: one token, the end. A null id counts as the empty text for the fold. Rows with repeated ids
are scored one by one. Without training rows N = 0 and V = 0: the base is log10(1 / 1) a token, and all is left to the lattice.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, shuffle_width, stored, table

FOLDS, HELD, SHIFT = 7, 2, 2.7
BLOCK, BLOCK_BYTES, WORDS = 4096, 16 << 20, 100_000
END = b""
START = "▁"
LOG10 = math.log(10)
#: Uses of pieces that the existing scores count for.
PRIOR = 1000.0


class Pieces:
    """Natural-log weights of opening pieces, other pieces and the 256 bytes, and the beginnings of all pieces."""

    def __init__(self, opening: dict[str, float], rest: dict[str, float], raw: list[float]):
        total = math.log(sum(opening.values()) + sum(rest.values()) + sum(raw))
        self.opening = {k: math.log(v) - total for k, v in opening.items()}
        self.rest = {k: math.log(v) - total for k, v in rest.items()}
        self.raw = [math.log(v) - total if v else -math.inf for v in raw]
        self.begin = ({p[:k] for p in opening for k in range(1, len(p))}, {p[:k] for p in rest for k in range(1, len(p))})
        self.names = [*opening, *rest]

    def byte(self, char: str) -> float:
        return sum(self.raw[b] for b in char.encode())

    def arcs(self, s: str):
        """(from, to, piece or None for a character's bytes, weight) in order of `from`."""
        n = len(s)
        for i in range(n):
            known, begin = (self.rest, self.begin[1]) if i else (self.opening, self.begin[0])
            for j in range(i + 1, n + 1):
                p = s[i:j]
                w = known.get(p)
                if w is not None:
                    yield i, j, p, w
                if p not in begin:
                    break
            if i and s[i] not in known:
                yield i, i + 1, None, self.byte(s[i])


@lru_cache(maxsize=2)
def pieces(model: bytes) -> tuple[dict[str, float], dict[str, float], list[float]]:
    """Weights of the vocabulary's opening pieces, other pieces and bytes, from its own scores; they sum to one."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    last = 1 / (SHIFT + p.get_piece_size())
    opening, rest, raw = {START: last}, {}, [last] * 256
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)):
            (opening if p.id_to_piece(i).startswith(START) else rest)[p.id_to_piece(i)] = 1 / (SHIFT + abs(p.get_score(i)))
    total = sum(opening.values()) + sum(rest.values()) + sum(raw)
    return {k: v / total for k, v in opening.items()}, {k: v / total for k, v in rest.items()}, [v / total for v in raw]


def plus(x: float, y: float) -> float:
    """Natural log of the sum of two numbers given by theirs."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)


def marginal(word: str, known: Pieces) -> float:
    """Natural log of the summed probability of all segmentations of `word`: forward recursion in log space."""
    s, exp, log1p, none = START + word, math.exp, math.log1p, -math.inf
    alpha = [none] * (len(s) + 1)
    alpha[0] = 0.0
    for i, j, _, w in known.arcs(s):
        x, y = alpha[i] + w, alpha[j]
        if x > y:
            alpha[j] = x + log1p(exp(y - x)) if y > none else x
        elif x > none:
            alpha[j] = y + log1p(exp(x - y))
    return alpha[-1]


def expect(word: str, known: Pieces, counts: dict[str, float], raw: dict[int, float]) -> None:
    """Adds the expected uses of each piece in `word`: the posterior of its arcs over all segmentations."""
    s = START + word
    arcs = [*known.arcs(s)]
    front, back = [-math.inf] * (len(s) + 1), [-math.inf] * (len(s) + 1)
    front[0] = back[-1] = 0.0

    for i, j, _, w in arcs:
        front[j] = plus(front[j], front[i] + w)
    for i, j, _, w in reversed(arcs):
        back[i] = plus(back[i], back[j] + w)
    if (total := front[-1]) > -math.inf:
        for i, j, p, w in arcs:
            x = math.exp(front[i] + w + back[j] - total)
            if p is not None:
                counts[p] += x
            else:
                for b in s[i].encode():
                    raw[b] += x


def expect_short(word: str, known: Pieces, linear: tuple[dict, dict], counts: dict[str, float], raw: dict[int, float]) -> None:
    """As expect(), in plain numbers: for words too short to underflow."""
    s = START + word
    n = len(s)
    front, back, arcs = [0.0] * (n + 1), [0.0] * (n + 1), []
    front[0] = 1.0
    for i in range(n):
        a = front[i]
        if not a:
            continue
        pieces_, begin = (linear[1], known.begin[1]) if i else (linear[0], known.begin[0])
        for j in range(i + 1, n + 1):
            p = s[i:j]
            w = pieces_.get(p)
            if w is not None:
                front[j] += a * w
                arcs.append((i, j, p, w))
            if p not in begin:
                break
        if i and s[i] not in pieces_:
            w = math.exp(known.byte(s[i]))
            front[i + 1] += a * w
            arcs.append((i, i + 1, None, w))
    if front[n]:
        back[n] = 1 / front[n]
        for i, j, p, w in reversed(arcs):
            back[i] += w * back[j]
            if p is not None:
                counts[p] += front[i] * w * back[j]
            else:
                for b in s[i].encode():
                    raw[b] += front[i] * w * back[j]


def words(data: bytes | None) -> list[bytes]:
    return [*data.lower().split(), END] if data else [END]


def _tally(part: pa.Table) -> pa.Table:
    """A block's distinct words and their counts in its training texts."""
    seen, held = Counter(), set()
    for text, out in zip(part.column("text"), part.column("held_out")):
        if out.as_py():
            held.update(words(text.as_py()))
        else:
            seen.update(words(text.as_py()))
    kinds = list(seen.keys() | held)
    return pa.table({"block": pa.array([part.column("block")[0].as_py()] * len(kinds), pa.int32()), "word": pa.array(kinds, pa.binary()), "n": pa.array([seen[w] for w in kinds], pa.int64())})


def train(vocabulary: DataFrame, model: Broadcast) -> tuple[dict[str, float], dict[str, float], list[float]]:
    """The pieces' weights after one step of expectation maximisation over all training words, each word counting once.

    Starts from the vocabulary's own scores, which also count as PRIOR uses. Sums are kept in whole millionths, so that
    their order doesn't matter; one row a piece comes to the driver.
    """

    def run(batches):
        known = Pieces(*pieces(model.value))
        linear = ({k: math.exp(v) for k, v in known.opening.items()}, {k: math.exp(v) for k, v in known.rest.items()})
        counts, raw = defaultdict(float), defaultdict(float)
        for b in batches:
            for w in b.column(0):
                if word := w.as_py().decode("utf-8", "replace"):
                    expect_short(word, known, linear, counts, raw) if len(word) < 40 else expect(word, known, counts, raw)
        names = [*counts, *(f"<{b}>" for b in raw)]
        uses = [round(x * 1e6) for x in (*counts.values(), *raw.values())]
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(counts) + [True] * len(raw)), pa.array(names, pa.string()), pa.array(uses, pa.int64())], names=["raw", "piece", "uses"])

    opening, rest, raw = pieces(model.value)
    sums = vocabulary.where("c > 0").select("word").mapInArrow(run, "raw boolean, piece string, uses long").groupBy("raw", "piece").agg(F.sum("uses").alias("uses")).collect()
    used = {(r["raw"], r["piece"]): r["uses"] / 1e6 for r in sums}
    more = lambda d: {k: v * PRIOR + used.get((False, k), 0.0) for k, v in d.items()}
    return more(opening), more(rest), [v * PRIOR + used.get((True, f"<{b}>"), 0.0) for b, v in enumerate(raw)]


def score(df: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", block_rows: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and pieces_score of every row."""
    if len(model) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("bytes")).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["rows"] // block_rows), -(-size["bytes"] // BLOCK_BYTES))
    docs = df.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int").alias("block"),
        F.col(doc_id).alias("doc_id"),
        (fold(F.col(doc_id), FOLDS) == HELD).alias("held_out"),
        F.col(text).cast("binary").alias("text"),
    )
    tally = stored(docs.groupBy("block").applyInArrow(_tally, "block int, word binary, n long"))

    # In so many parts that weighing a part's words is a short task, and so many files that reading them back is too.
    vocabulary = stored(tally.repartition(shuffle_width(spark, tally.count(), WORDS), "word").groupBy("word").agg(F.sum("n").alias("c")))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = total["n"], total["v"]
    discount = total["once"] / (total["once"] + 2 * total["twice"]) if total["once"] else 0.5
    mass = discount * v / n if n else 1.0
    trained = spark.sparkContext.broadcast(train(vocabulary, shared))

    def weigh(batches):
        known = Pieces(*trained.value)
        share, end = math.log(mass), math.log(mass / (n + v + 1))
        for b in batches:
            whole, pieces_ = [], []
            for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                arc = math.log((c - discount) / n) if c > discount else -math.inf
                if word == END:  # with a share of its own where training never saw it
                    whole.append(max(arc, end)), pieces_.append(max(arc, end))
                else:
                    pieces_.append(marginal(word.decode("utf-8", "replace"), known))
                    whole.append(plus(share + pieces_[-1], arc))  # the arc over the whole word ends where all paths do
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.float64()), pa.array(pieces_, pa.float64())], names=["word", "c", "whole", "pieces"])

    weighed = vocabulary.mapInArrow(weigh, "word binary, c long, whole double, pieces double")

    def grade(part: pa.Table, of: pa.Table) -> pa.Table:
        index = {w: i for i, w in enumerate(of.column("word").to_pylist())}
        c = of.column("c").to_numpy().astype(float)
        base = np.log10((c + 1) / (n + (v + 1)))
        whole, pieces_ = (of.column(x).to_numpy() / LOG10 for x in ("whole", "pieces"))
        out = []
        for text in part.column("text"):
            at = np.fromiter(map(index.__getitem__, words(text.as_py())), np.int32)
            out.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(whole[at].sum()), float(pieces_[at].sum())))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()),
            "train_tokens": pa.array([n] * len(out), pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64()), "pieces_score": pa.array(cols[4], pa.float64()),
        })

    graded = tally.select("block", "word").join(weighed, "word").select("block", "word", "c", "whole", "pieces")
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pieces_score double"
    return docs.groupBy("block").cogroup(graded.groupBy("block")).applyInArrow(grade, schema)


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
