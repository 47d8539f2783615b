import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.load(bpe.vocabulary(PATH), P.PATTERN)
TEXT = st.text(alphabet=st.sampled_from(" \n\t'aslé𝛼1.日 \x1c"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT | st.text(max_size=60), st.integers(1, 12), st.integers(1, 8))
def test_tree_equals_whole(text, leaf, window):
    ids = bpe.encode_tree(text, CODER.encode_ordinary, leaf, window)
    assert ids == CODER.encode_ordinary(text)
    assert bpe.decode_tree(ids, CODER.decode_bytes, leaf) == text.encode()


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_join_is_associative(a, b, c):
    enc = CODER.encode_ordinary
    left = bpe.join(a + b, bpe.join(a, enc(a), b, enc(b), enc), c, enc(c), enc)
    right = bpe.join(a, enc(a), b + c, bpe.join(b, enc(b), c, enc(c), enc), enc)
    assert left == right == enc(a + b + c)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_borders_are_borders(text):
    """Each side of a border is encoded as it is within the whole."""
    enc = CODER.encode_ordinary
    for m in bpe.BORDER.finditer(text, 1):
        assert enc(text[: m.start()]) + enc(text[m.start() :]) == enc(text)
    assert bpe._last_border(text, 2) == max([m.start() for m in bpe.BORDER.finditer(text, 1)], default=0)


def test_text_without_spaces_is_cut_at_its_borders():
    """What a join encodes again stays short where the pattern has borders, and every length goes through the tree."""
    seen = []
    text = "日本語の文章、百二十字。" * 4000
    assert bpe.encode_tree(text, lambda t: seen.append(len(t)) or CODER.encode_ordinary(t)) == CODER.encode_ordinary(text)
    assert max(seen) <= bpe.LEAF and sum(seen) < 2 * len(text)


@pytest.mark.parametrize("text", ["ab" * 30_000, " " * 40_000 + "x", "it's " * 9_000, "<|endoftext|>", "a　 b"])
def test_long_texts(text):
    assert bpe.encode_tree(text, CODER.encode_ordinary, 1000) == CODER.encode_ordinary(text)


def test_operator(spark, odd, empty):
    got = bpe.decode(bpe.encode(odd.select("doc_id", "text", "source"), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(got) == 11
    for r in got:
        assert r["ids"] == CODER.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    both = {r["doc_id"]: r for r in bpe.round_trip(odd, PATH, P.PATTERN).collect()}
    assert both[9]["ids"] == CODER.encode_ordinary(both[9]["text"]) and bytes(both[9]["decoded"]).decode() == both[9]["text"]
    for r in bpe.digests(odd, PATH, P.PATTERN).collect():
        if r["doc_id"] == 10:
            ids = CODER.encode_ordinary("alone")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"alone").hexdigest())
        if r["doc_id"] == 1:
            assert (r["n_tokens"], r["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0
    clash = odd.where("doc_id = 9").withColumn("ids", odd["doc_id"]).withColumn("decoded", odd["lang"]).withColumn("_given", odd["lang"]).withColumn("x0", odd["lang"])
    (row,) = bpe.round_trip(clash, PATH, P.PATTERN).collect()
    assert row["ids"] == both[9]["ids"] and row["doc_id"] == 9 and set(row.asDict()) == set(clash.columns)
