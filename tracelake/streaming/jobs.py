"""Incremental ingest and alerts as streaming queries. State and offsets live in each query's checkpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dlp, tables


def lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    from ..sources import jsonl

    jsonl.register(spark)
    return spark.readStream.format("growing_lines").option("path", path).option("suffix", suffix).load()


def append_once(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows of new keys only: a batch that is run again adds nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = spark.createDataFrame([], batch.schema)
        tables.append_new(old, batch, keys, order).write.mode("append").parquet(path)

    return sink


def alerts(reads: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Findings of a stream of reads (task_id, model, path, ts, remote, secret_kinds), each (task, path, rule, model) once within the watermark."""
    found = dlp.findings(reads.withWatermark("ts", watermark))
    return found.dropDuplicatesWithinWatermark(["task_id", "path", "rule", "model"])


def webhook(url: str, slack: bool = False, send: Callable[[str, bytes], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that posts each alert; alerts are few, and are read row by row."""

    def post(to: str, body: bytes) -> None:
        urllib.request.urlopen(urllib.request.Request(to, body, {"Content-Type": "application/json"}), timeout=10).close()

    def sink(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toLocalIterator():
            text = f"[{row['severity']}] {row['rule']}: {row['path']} ({row['detail']})"
            (send or post)(url, json.dumps({"text": text} if slack else {k: str(v) for k, v in row.asDict().items()}).encode())

    return sink


class CumulativeDeclared(StatefulProcessor):
    """Keeps each session's declared paths; every turn comes out with all paths so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "path string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values("ordinal")
        out = []
        for ordinal, declared in zip(turns["ordinal"], turns["declared"]):
            for p in declared if declared is not None else ():
                if not p.startswith("/") and not self.seen.containsKey((p,)):
                    self.seen.updateValue((p,), (1,))
            out.append((key[0], ordinal, sorted(k[0] for k in self.seen.keys())))
        yield pd.DataFrame(out, columns=["session_id", "ordinal", "declared_so_far"])

    def close(self) -> None:
        pass


def cumulative_declared(turns: DataFrame) -> DataFrame:
    """The streaming form of the running list of declared paths. Needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(CumulativeDeclared(), "session_id string, ordinal long, declared_so_far array<string>", "Append", "none")


def bursts(changes: DataFrame, quiet: str = "1500 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """File changes (repo, path, ts) gathered until their repository is quiet: one row a burst."""
    return changes.withWatermark("ts", watermark).groupBy("repo", F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("path")).alias("paths"))


def correlated(sessions: DataFrame, versions: DataFrame, slack: str = "30 minutes") -> DataFrame:
    """Turns (session, key, turn_ts) and file versions (key, version, ts) within `slack` of each other: a join of two streams, whose state the watermarks bound."""
    s, v = sessions.withWatermark("turn_ts", slack).alias("s"), versions.withWatermark("ts", slack).alias("v")
    near = F.expr(f"s.key = v.key AND v.ts BETWEEN s.turn_ts - INTERVAL {slack} AND s.turn_ts + INTERVAL {slack}")
    return s.join(v, near).select("s.session", "s.turn_ts", "v.version", "v.ts")
