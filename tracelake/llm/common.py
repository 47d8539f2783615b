"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir. Only a session of one machine may make its own; a cluster without the setting is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not re.fullmatch(r"local(\[[^\]-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def materialise(df: DataFrame) -> DataFrame:
    """Computes `df` once, into the shared checkpoint folder; later reads survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that about `per_task` rows meet in each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def stored(df: DataFrame) -> DataFrame:
    """Writes `df` as a table in the shared checkpoint folder, packed by columns, and reads it back."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose binary `column` has about `most` bytes at most, or one row: a task holds no more of its output than that."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            yield b.slice(low, high - low)
            low = high


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns under names that no operator uses, x0, x1 ...; those in `but` keep theirs."""
    return [col(c) if c in but else col(c).alias(f"x{i}") for i, c in enumerate(df.columns)]


def restored(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """Selects what numbered() made back under the names of `df`."""
    return [col(c) if c in but else F.col(f"x{i}").alias(c) for i, c in enumerate(df.columns)]
