import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import lattice

MODEL = lattice.vocabulary(P.path("piece_bpe_32k.model"))
KNOWN = lattice.Pieces({"▁": 0.2, "▁a": 0.3}, {"a": 0.1, "b": 0.15, "ab": 0.2, "ba": 0.05}, [1e-4] * 256)


def every(word):
    """Probability of each segmentation, by trying all cuts."""
    s, out = "▁" + word, []
    for cuts in product((False, True), repeat=len(s) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(s[at:i])
                at = i
        parts.append(s[at:])
        p = 1.0
        for k, x in enumerate(parts):
            w = (KNOWN.rest if k else KNOWN.opening).get(x)
            p *= math.exp(w) if w is not None else math.exp(KNOWN.byte(x)) if k and len(x) == 1 else 0.0
        out.append((parts, p))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé", max_size=7))
def test_marginal_and_expectation_equal_enumeration(word):
    all_ = every(word)
    total = sum(p for _, p in all_)
    assert lattice.marginal(word, KNOWN) == pytest.approx(math.log(total))
    want = Counter()
    for parts, p in all_:
        for k, x in enumerate(parts):
            if x in (KNOWN.rest if k else KNOWN.opening):
                want[x] += p / total
    linear = ({k: math.exp(v) for k, v in KNOWN.opening.items()}, {k: math.exp(v) for k, v in KNOWN.rest.items()})
    for run in (lambda c, r: lattice.expect(word, KNOWN, c, r), lambda c, r: lattice.expect_short(word, KNOWN, linear, c, r)):
        counts, raw = defaultdict(float), defaultdict(float)
        run(counts, raw)
        assert {k: v for k, v in counts.items() if v > 1e-12} == pytest.approx({k: v for k, v in want.items() if v > 1e-12})


def test_words_sum_to_at_most_one():
    total = sum(math.exp(lattice.marginal("".join(w), KNOWN)) for n in range(9) for w in product("ab", repeat=n))
    assert 0.5 < total <= 1 + 1e-9
    opening, rest, raw = lattice.pieces(MODEL)
    assert sum(opening.values()) + sum(rest.values()) + sum(raw) == pytest.approx(1)


def test_long_word_does_not_underflow():
    x = lattice.marginal("ab" * 5000, KNOWN)
    assert math.isfinite(x) and x < -1000


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = [(d, held(d), lattice.words((t or "").encode())) for d, t in rows]
    c = Counter(w for _, h, ws in words if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((d or -1, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, h, ws in words)


def test_query_equals_definition(spark, odd):
    got = lattice.score(odd.withColumn("block", odd["lang"]).withColumn("word", odd["lang"]), MODEL, block_rows=3).collect()
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


def paths(word, opening, rest, raw):
    """(pieces and bytes used, probability) of every segmentation of a word, by plain recursion over the definition."""
    s = "▁" + word

    def go(at):
        if at == len(s):
            yield (), 1.0
            return
        table = rest if at else opening
        for to in range(at + 1, len(s) + 1):
            if s[at:to] in table:
                for used, p in go(to):
                    yield (s[at:to], *used), p * table[s[at:to]]
        if at and s[at] not in rest:
            for used, p in go(at + 1):
                yield (*s[at].encode(), *used), p * math.prod(raw[b] for b in s[at].encode())

    return [*go(0)]


def test_score_equals_brute_force(spark, docs):
    """Expected uses, weights, discount and marginals over all segmentations, on the shipped vocabulary."""
    rows = [(0, "a cat sat"), (1, "the cat é ran on"), (2, "the the rat"), (3, "zq a"), (4, ""), (5, None), (6, "The mat sat on a hat"), (7, "rat 日"), (8, "cat")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = {d: (t or "").lower().split() + [""] for d, t in rows}
    c = Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v, once, twice = sum(c.values()), len(c), *(sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    opening, rest, raw = lattice.pieces(MODEL)
    uses = Counter()
    for w in c:
        all_ = paths(w, opening, rest, raw) if w else []
        total = sum(p for _, p in all_)
        for used, p in all_:
            for x in used:
                uses[x] += p / total
    new = [{k: lattice.PRIOR * x + uses[k] for k, x in t.items()} for t in (opening, rest)] + [[lattice.PRIOR * x + uses[b] for b, x in enumerate(raw)]]
    whole = sum(new[0].values()) + sum(new[1].values()) + sum(new[2])
    new = [{k: x / whole for k, x in t.items()} for t in new[:2]] + [[x / whole for x in new[2]]]
    sub = {w: sum(p for _, p in paths(w, *new)) for ws in words.values() for w in ws if w}
    log = lambda w: math.log10((max(0, c[w] - d) / n + d * v / n * sub[w]) if w else (c[w] - d) / n)
    got = {r["doc_id"]: r for r in lattice.score(docs(*rows), MODEL).collect()}
    for i, ws in words.items():
        assert got[i]["score"] == pytest.approx(sum(map(log, ws)), abs=1e-5)
        assert got[i]["pieces_score"] == pytest.approx(sum(math.log10(sub[w]) for w in ws if w) + log(""), abs=1e-5)


def test_blocks_do_not_matter(spark, docs):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 30))) for i in range(60)]
    one, many = (sorted((r["doc_id"], round(r["score"], 6)) for r in lattice.score(docs(*rows), MODEL, block_rows=b).collect()) for b in (1000, 2))
    assert one == many


def test_training_helps_known_words(spark, docs):
    rows = [(i, "the lexer reads tokens and the parser builds trees") for i in range(40)]
    got = {r["doc_id"]: r for r in lattice.score(docs(*rows, (100, "qzx vvk jjq")), MODEL).collect()}
    assert got[1]["score"] / got[1]["n_tokens"] > got[100]["score"] / got[100]["n_tokens"]


def test_without_rows_or_training(empty, docs):
    assert lattice.score(empty, MODEL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lattice.score(docs((held, "only held out")), MODEL).collect()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0 and math.isfinite(row["score"])
