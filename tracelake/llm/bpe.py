"""Byte-level BPE by monoid tree reduction.

A text is halved until spans are at most `leaf` characters, each span is encoded by itself, and neighbours are joined.
Concatenation of spans is the monoid; its product re-encodes only a window round the seam. BORDER names positions that
are always the border of two matches of the split pattern: after a letter that no letter follows, after a number that
no number follows, and before a space (U+0020) that follows other than white space, a letter or a number. No alternative
of the pattern lets these two characters stand in one match, and what ends there ended at that character whatever comes
after it. (Marks and apostrophes are left out, so this holds for the common patterns with contractions and marks, too.)
So the encoding of the text before the position and of the text after it are independent, and tokens outside the window
from the last such position on the left to the first on the right cannot change. The window grows until both ends are
such positions or the ends of the span. Decoding concatenates bytes up the same tree.

Null text counts as empty: no ids, no bytes. Other columns are carried along; those named as the new ones are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, restored, sliced, table

LEAF, WINDOW = 512, 64
BORDER = regex.compile(r"(?<=\p{L})(?=[^\p{L}\p{M}'’])|(?<=\p{N})(?=[^\p{N}\p{M}])|(?<=[^\s\p{L}\p{N}])(?= )")


@lru_cache(maxsize=4)
def load(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def _last_border(text: str, window: int) -> int:
    """The last certain border in `text`, looked for in a growing window; 0 if there is none."""
    size, high = window, len(text)
    while True:
        low = max(0, len(text) - size)
        at = 0
        for m in BORDER.finditer(text, max(low, 1), high):
            at = m.start()
        if at or low == 0:
            return at
        size, high = 2 * size, low + 1


def _first_border(text: str, window: int) -> int:
    """The first certain border in `text`; its length if there is none."""
    m = BORDER.search(text, 1)
    return m.start() if m else len(text)


def encode_tree(text: str, encode, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of `text`; `encode` encodes a span on its own."""
    if len(text) <= leaf:
        return encode(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return join(left, encode_tree(left, encode, leaf, window), right, encode_tree(right, encode, leaf, window), encode, window)


def join(left: str, left_ids: list[int], right: str, right_ids: list[int], encode, window: int = WINDOW) -> list[int]:
    """The monoid's product: ids of left + right from those of both sides."""
    a, b = _last_border(left, window), _first_border(right, window)
    keep = len(left_ids) - len(encode(left[a:]))
    skip = len(encode(right[:b]))
    return left_ids[:keep] + encode(left[a:] + right[:b]) + right_ids[skip:]


def decode_tree(ids, decode, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return decode(ids)
    middle = len(ids) // 2
    return decode_tree(ids[:middle], decode, leaf) + decode_tree(ids[middle:], decode, leaf)


def vocabulary(path: str) -> bytes:
    """The rank file's bytes, read on the driver: under a few MB whatever the corpus, so they may be broadcast."""
    with open(path, "rb") as f:
        ranks = f.read()
    if len(ranks) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not broadcast")
    return ranks


def _flat(rows: list) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else [], pa.int32()))


def _run(df: DataFrame, ranks: str, pattern: str, source: str, new: list[str], leaf: int) -> DataFrame:
    """Adds the columns `new` out of ids and decoded. Texts and ids of a few MB at a time are in Python."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(ranks))
    old = df.drop(*new)
    column = len(old.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(shared.value, pattern)
        for b in batches if source == "ids" else sliced(batches, column, 1 << 20):
            if source == "ids":
                ids = [np.empty(0, np.int32) if x.as_py() is None else x.values.to_numpy() for x in b.column(column)]
            else:
                ids = [encode_tree(x.as_py().decode(), coder.encode_ordinary, leaf) if x.is_valid else [] for x in b.column(column)]
            made = {"ids": lambda: _flat(ids), "decoded": lambda: pa.array([decode_tree(x if isinstance(x, list) else x.tolist(), coder.decode_bytes) for x in ids], pa.binary())}
            yield pa.RecordBatch.from_arrays([*b.columns[:column], *(made[k]() for k in new)], names=[*b.schema.names[:column], *new])

    given = df.select(*numbered(old), (F.col("text").cast("binary") if source == "text" else F.col("ids")).alias("_given"))
    fields = [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(old.schema.fields)]
    out = T.StructType([*fields, *(T.StructField(k, T.ArrayType(T.IntegerType(), False) if k == "ids" else T.BinaryType()) for k in new)])
    return given.mapInArrow(run, out).select(*restored(old), *new)


def encode(df: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Adds `ids`, the token ids of `text`."""
    return _run(df, ranks, pattern, "text", ["ids"], leaf)


def decode(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes that the token ids in `ids` stand for; null ids stand for none."""
    return _run(df, ranks, pattern, "ids", ["decoded"], LEAF)


def round_trip(df: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Adds `ids` and, decoded from these, `decoded`, in one pass."""
    return _run(df, ranks, pattern, "text", ["ids", "decoded"], leaf)


def digests(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, from the operators' own outputs."""
    return round_trip(df.select("doc_id", "text"), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
