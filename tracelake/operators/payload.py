"""Content-addressed payloads, envelope encryption, retention, checkpoints and rewind."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .coupling import checkpointed
from .tables import append_new

PARTS = 4096


def put(texts: DataFrame, content: str) -> DataFrame:
    """(ref, content, purged): one row for each distinct content."""
    return texts.select(S.content_ref(F.col(content)).alias("ref"), F.col(content).cast("binary").alias("content")).dropDuplicates(["ref"]).withColumn("purged", F.lit(False))


def integrity(refs: DataFrame, store: DataFrame) -> DataFrame:
    """One row: how many refs have their content, another content, or none."""
    found = refs.join(store.select("ref", "content", F.lit(True).alias("_there")), "ref", "left")
    ok = S.is_intact(F.col("ref"), F.col("content"))
    return found.agg(F.count_if(F.coalesce("_there", F.lit(False)) & F.coalesce(ok, F.lit(False))).alias("ok"), F.count_if(F.col("_there") & ~F.coalesce(ok, F.lit(False))).alias("corrupt"), F.count_if(F.col("_there").isNull()).alias("missing"))


def references(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct refs over several tables' columns."""
    out = None
    for df, column in tables:
        part = df.select(F.col(column).alias("ref")).where("ref IS NOT NULL")
        out = part if out is None else out.union(part)
    return out.distinct()


def due(versions: DataFrame, cutoff: Column) -> DataFrame:
    """Versions older than `cutoff` that still have a payload."""
    return versions.where((F.col("ts") < cutoff) & ~F.col("payload_purged") & F.col("ref").isNotNull())


def purge(versions: DataFrame, store: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions with tombstones, the store without payloads that only purged versions named, and one row of counts."""
    gone = due(versions, cutoff)
    old = gone.select("id").withColumn("_gone", F.lit(True))
    marked = versions.join(old, "id", "left").withColumn("payload_purged", F.col("payload_purged") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    live = marked.where(~F.col("payload_purged") & F.col("ref").isNotNull()).select("ref").distinct()
    shred = gone.select("ref").distinct().join(live, "ref", "left_anti")
    counts = gone.agg(F.count("*").alias("targets"), F.countDistinct("task_id").alias("tasks")).crossJoin(F.broadcast(shred.agg(F.count("*").alias("shredded"))))
    return marked, store.join(shred, "ref", "left_anti"), counts


def seal(store: DataFrame, key: str) -> DataFrame:
    """Each content encrypted by its own data key, which the main key wraps; refs stay those of the plain bytes. `key`: 32 bytes in hex.

    Data keys are drawn from the system's random source. They are stored wrapped, by ref, before anything is sealed, so
    that a retried task seals with the same one.
    """
    main, schema = F.unhex(F.lit(key)), store.select("ref").schema

    def draw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.urandom(32) for _ in range(b.num_rows)], pa.binary())], names=["ref", "dek"])

    keys = store.select("ref").distinct().mapInArrow(draw, f"ref {schema[0].dataType.simpleString()}, dek binary")
    keys = checkpointed(keys.select("ref", F.aes_encrypt("dek", main, F.lit("GCM")).alias("wrapped")))
    data_key = F.aes_decrypt("wrapped", main, F.lit("GCM"))
    return store.join(keys, "ref").select("ref", F.aes_encrypt("content", data_key, F.lit("GCM")).alias("sealed"), "wrapped")


def open_sealed(sealed: DataFrame, key: str) -> DataFrame:
    main = F.unhex(F.lit(key))
    return sealed.select("ref", F.aes_decrypt("sealed", F.aes_decrypt("wrapped", main, F.lit("GCM")), F.lit("GCM")).alias("content"))


def rewrap(sealed: DataFrame, old: str, new: str) -> DataFrame:
    """The data keys wrapped by another main key; contents aren't touched."""
    return sealed.withColumn("wrapped", F.aes_encrypt(F.aes_decrypt("wrapped", F.unhex(F.lit(old)), F.lit("GCM")), F.unhex(F.lit(new)), F.lit("GCM")))


def checkpoint(files: DataFrame, at: Column) -> DataFrame:
    """Manifest (checkpoint_id, rel_path, content_ref, at) of a tree (path, text)."""
    rows = files.select(F.col("path").alias("rel_path"), S.content_ref(F.col("text")).alias("content_ref"))
    # Digests of PARTS parts, so that no row holds the whole tree.
    part = rows.groupBy(F.pmod(F.xxhash64("rel_path"), F.lit(PARTS)).cast("string").alias("path"))
    parts = part.agg(S.files_digest(F.collect_list(F.struct(F.col("rel_path").alias("path"), F.col("content_ref").alias("hash")))).alias("hash"))
    whole = parts.agg(S.checkpoint_key(at, F.collect_list(F.struct("path", "hash"))).alias("checkpoint_id"))
    return rows.crossJoin(F.broadcast(whole)).select("checkpoint_id", "rel_path", "content_ref", at.alias("at"))


def checkpoints(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("checkpoint_id").agg(F.max("at").alias("at"), F.count("*").alias("files")).orderBy(F.desc("at"), "checkpoint_id")


def safe_path(path: str) -> bool:
    p = PurePosixPath(path)
    return bool(path) and not p.is_absolute() and ".." not in p.parts


def rewind(manifest: DataFrame, store: DataFrame, checkpoint_id: str, root: str) -> int:
    """Writes a checkpoint's files under `root` on the driver, one at a time; absolute paths and .. are refused before any is written, and nothing is deleted."""
    wanted = manifest.where(F.col("checkpoint_id") == checkpoint_id).select("rel_path", F.col("content_ref").alias("ref"))
    bad = wanted.where(F.col("rel_path").startswith("/") | F.col("rel_path").rlike(r"(^|/)\.\.(/|$)") | (F.col("rel_path") == "")).limit(1).collect()
    if bad:
        raise ValueError(f"unsafe path {bad[0]['rel_path']!r}")
    n = 0
    for row in wanted.join(store.select("ref", "content"), "ref").toLocalIterator():
        if not safe_path(row["rel_path"]):
            raise ValueError(f"unsafe path {row['rel_path']!r}")
        target = os.path.join(root, row["rel_path"])
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(bytes(row["content"]))
        n += 1
    return n


def remember(cache: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summaries (key, ...) to append to the cache: of keys that it doesn't have, the first by content."""
    return append_new(cache, summaries, ["key"], [c for c in summaries.columns if c != "key"])


def cached_summaries(turns: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns whose summary is cached, and those a summariser has yet to see."""
    return turns.join(cache, "key"), turns.join(cache.select("key"), "key", "left_anti")
