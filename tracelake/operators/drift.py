"""Declared against done: turns, declared paths, correlation by time, drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

SLACK = "INTERVAL 30 MINUTES"
#: Of a key, about so many versions meet about so many sessions in one piece of work.
VERSIONS, SESSIONS = 16384, 512
#: Microseconds of the slots in which turns meet versions, by the length of their spans; longer spans are in one slot. So many paths are in a batch of the result.
SLOTS, PATHS = tuple(7_200_000_000 * 16**i for i in range(4)), 1 << 18


def drift(declared: Column, actual: Column) -> Column:
    """struct<undeclared, phantom, score>: done but not declared, declared but not done, and their share of all."""
    undeclared, phantom = F.array_sort(F.array_except(actual, declared)), F.array_sort(F.array_except(declared, actual))
    union = F.size(F.array_union(declared, actual))
    score = F.when(union > 0, (F.size(undeclared) + F.size(phantom)).cast("double") / union).otherwise(0.0)
    return F.struct(undeclared.alias("undeclared"), phantom.alias("phantom"), score.alias("score"))


def cumulative(turns: DataFrame, key: str, order: list[str], paths: str, to: str = "declared_so_far") -> DataFrame:
    """The distinct paths of each turn and all before it in its session, absolute ones left out.

    A session's paths so far are part of every row of the result, so a session is held whole; streaming.jobs has the
    form that keeps them as state.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.filter(F.coalesce(F.col(paths), F.array().cast("array<string>")), lambda p: ~p.startswith("/"))
    return turns.withColumn(to, F.array_sort(F.array_distinct(F.flatten(F.collect_list(own).over(w)))))


def segment(records: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Adds `ordinal` from 0: a record that `opens` starts a turn, later ones belong to it; records before the first go."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("ordinal", F.sum(F.when(opens, 1).otherwise(0)).over(w) - 1).where("ordinal >= 0")


def correlate(sessions: DataFrame, versions: DataFrame, slack: str = SLACK, levels: tuple[int, ...] = (3600, 86_400, 30 * 86_400), most_buckets: int = 24) -> DataFrame:
    """Versions within `slack` of a session: sessions (session, key, first, last), versions (key, ts, ...).

    Both meet by (key, time bucket), an equi-join, so neither side is compared whole. Each span takes the smallest bucket
    (an hour, a day, a month) of which it covers at most `most_buckets`; it is copied that often. Spans that cover more
    months than that meet by key with the range as a condition.
    """
    span = sessions.withColumn("_from", F.col("first") - F.expr(slack)).withColumn("_to", F.col("last") + F.expr(slack))
    within = (F.col("ts") >= F.col("_from")) & (F.col("ts") <= F.col("_to"))
    out, smaller = None, F.lit(False)
    for size in levels:
        slot = lambda c, size=size: F.floor(F.unix_seconds(c) / size)
        fits = slot(F.col("_to")) - slot(F.col("_from")) < most_buckets
        mine = span.where(fits & ~smaller).withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
        near = mine.join(versions.withColumn("_slot", slot(F.col("ts"))), ["key", "_slot"]).where(within).drop("_slot")
        out = near if out is None else out.unionByName(near)
        smaller = smaller | fits
    return out.unionByName(span.where(~smaller).join(versions, "key").where(within)).drop("_from", "_to")


def _met(sessions: DataFrame, versions: DataFrame, slack: str, body: Callable[..., pa.Table], schema: str) -> DataFrame:
    """body(versions, bounds, low, high, sessions) of each piece: its versions sorted by artifact and moment, where an artifact's begin and end, and for each artifact (row) and session (column) the places of the first version in the span and of the first one after it.

    Sessions: session, key, first, last; versions: artifact_id, key, ts, version, .... No pair of a session and a version
    is a row. A key's artifacts are dealt into pieces of about VERSIONS versions, its sessions into pieces of about
    SESSIONS; each piece of one meets each of the other. An artifact's versions are held whole.
    """
    v = versions.where("ts IS NOT NULL").withColumn("_t", F.unix_micros("ts")).drop("ts")
    s = sessions.select("session", "key", F.unix_micros(F.col("first") - F.expr(slack)).alias("_from"), F.unix_micros(F.col("last") + F.expr(slack)).alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL")
    pieces = lambda n, most: F.ceil(F.count("*") / most).cast("int").alias(n)
    sizes = v.groupBy("key").agg(pieces("_parts", VERSIONS)).join(s.groupBy("key").agg(pieces("_blocks", SESSIONS)), "key")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(sizes, "key").withColumn("_part", F.pmod(F.xxhash64("artifact_id"), F.col("_parts")).cast("int")).withColumn("_block", each("_blocks")).drop("_parts", "_blocks")
    s = s.join(sizes, "key").withColumn("_block", F.pmod(F.xxhash64("session"), F.col("_blocks")).cast("int")).withColumn("_part", each("_parts")).drop("_parts", "_blocks")

    def run(mine: pa.Table, spans: pa.Table) -> pa.Table:
        code = pa.chunked_array([mine.column("artifact_id").combine_chunks().dictionary_encode(null_encoding="encode").indices])
        mine = mine.append_column("_code", code)
        mine = mine.take(pc.sort_indices(mine, [("_code", "ascending"), ("_t", "ascending"), ("version", "ascending")], null_placement="at_start")).combine_chunks()
        t, code = mine.column("_t").to_numpy(), mine.column("_code").to_numpy()
        bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
        start, end = spans.column("_from").to_numpy(), spans.column("_to").to_numpy()
        order = np.argsort(start, kind="stable")
        spans, start, end = spans.take(pa.array(order)).combine_chunks(), start[order], end[order]
        n = max(len(bounds) - 1, 0)
        low, high = np.empty((n, len(start)), np.int64), np.empty((n, len(start)), np.int64)
        for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
            low[i], high[i] = x + np.searchsorted(t[x:y], start, "left"), x + np.searchsorted(t[x:y], end, "right")
        return body(mine, bounds, low, high, spans.column("session"))

    # Given a number, Spark doesn't pack the pieces, which are small but not their results, into few tasks.
    keys, width = ["key", "_part", "_block"], int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return v.repartition(width, *keys).groupBy(*keys).cogroup(s.repartition(width, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def gap_fill(sessions: DataFrame, versions: DataFrame, slack: str = SLACK) -> DataFrame:
    """Edges of each session (one row: session, key, first, last) to the artifacts of its key that changed within `slack` of its span; the first version (version, lines, ts) seen stays."""

    def body(mine: pa.Table, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, names: pa.ChunkedArray) -> pa.Table:
        at, who = np.nonzero(low < high)
        place = pa.array(low[at, who])
        return pa.table([names.take(pa.array(who)), *(mine.column(c).take(place) for c in ("artifact_id", "version", "lines"))], names=["src", "dst", "version", "lines"])

    schema = f"src {_type(sessions, 'session')}, dst {_type(versions, 'artifact_id')}, version {_type(versions, 'version')}, lines {_type(versions, 'lines')}"
    found = _met(sessions, versions.select("artifact_id", "key", "ts", "version", "lines"), slack, body, schema)
    return found.select(F.lit("task_modifies_artifact").alias("kind"), "src", "dst", "version", "lines")


def span_counts(sessions: DataFrame, versions: DataFrame, slack: str = SLACK) -> DataFrame:
    """How many versions and how many different artifacts of its key each session (one row) has within `slack` of its span, if any."""

    def body(mine: pa.Table, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, names: pa.ChunkedArray) -> pa.Table:
        count = np.maximum(high - low, 0)
        named = mine.column("artifact_id").is_valid().to_numpy()[bounds[: len(count)]]
        return pa.table([names, pa.array(count.sum(0)), pa.array((count[named] > 0).sum(0))], names=["session", "versions", "artifacts"])

    found = _met(sessions, versions.select("artifact_id", "key", "ts", "version"), slack, body, f"session {_type(sessions, 'session')}, versions long, artifacts long")
    return found.groupBy("session").agg(F.sum("versions").alias("versions"), F.sum("artifacts").alias("artifacts")).where("versions > 0")


def observed(turns: DataFrame, versions: DataFrame, slack: str = SLACK) -> DataFrame:
    """Adds done, the paths of its key that changed within `slack` of a turn's span, and drift against what it declared.

    Turns: key, first, last, declared_so_far (distinct, in order), ...; versions: key, ts, path. No pair of a turn and a
    version is a row, and no list of paths is shuffled: a turn goes to the slot where its span begins, which is as long as the span
    at least, and a version to its own slot and the one before. Slots have the lengths that some span needs. A slot's
    versions are held whole, its turns stream past them.
    """
    moment = lambda name, sign: F.unix_micros(F.col(name) + sign * F.expr(slack))
    begin, end = moment("first", -1), moment("last", 1)
    level, slot = F.lit(len(SLOTS)), F.lit(0).cast("long")
    for i, size in reversed([*enumerate(SLOTS)]):
        level, slot = F.when(end - begin <= size, i).otherwise(level), F.when(end - begin <= size, F.floor(begin / size)).otherwise(slot)
    met = F.col("key").isNotNull() & begin.isNotNull() & end.isNotNull()
    piece = lambda level, slot: F.concat_ws("/", level.cast("string"), slot.cast("string"), F.col("key").cast("string"))
    none = F.concat(F.lit("-1/"), F.pmod(F.xxhash64("first", "last", "key", "declared_so_far"), F.lit(1024)).cast("string"))  # these meet nothing
    used = sorted(r[0] for r in turns.where(met).select(level.alias("level")).distinct().collect())
    row = F.struct(*(F.col(f"`{c}`") for c in turns.columns))
    mine = turns.select(F.when(met, piece(level, slot)).otherwise(none).alias("piece"), F.lit(1).alias("kind"), begin.alias("a"), end.alias("b"), F.lit(None).cast("string").alias("path"), row.alias("row"))
    at = F.unix_micros("ts")
    places = [piece(F.lit(i), F.floor(at / SLOTS[i]) - back) for i in used if i < len(SLOTS) for back in (0, 1)] + [piece(F.lit(i), F.lit(0)) for i in used if i == len(SLOTS)]
    known = versions.where("key IS NOT NULL AND ts IS NOT NULL AND path IS NOT NULL")
    seen = known.select(F.explode(F.array(*places) if places else F.array().cast("array<string>")).alias("piece"), F.lit(0).alias("kind"), at.alias("a"), at.alias("b"), "path", F.lit(None).cast(turns.schema).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, paths, names = None, [], [], None
        for b in batches:
            code = b.column("piece").dictionary_encode().indices.to_numpy()
            bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            for low, high in zip(bounds[:-1], bounds[1:]):
                part = b.slice(low, high - low)
                if part.column("piece")[0].as_py() != now:
                    now, times, paths, names = part.column("piece")[0].as_py(), [], [], None
                n = int((part.column("kind").to_numpy() == 0).sum())
                if n:
                    times.append(part.column("a").slice(0, n).to_numpy())
                    paths.append(part.column("path").slice(0, n))
                if n == part.num_rows:
                    continue
                if names is None:
                    path = pa.chunked_array(paths, pa.string()).combine_chunks()
                    names = pc.unique(path)
                    names = names.take(pc.sort_indices(names))
                    t, code_of = np.concatenate([np.empty(0, np.int64), *times]), pc.index_in(path, value_set=names).to_numpy()
                    there, times, paths = np.zeros(len(names), bool), [], []
                part = part.slice(n)
                start, stop = (np.searchsorted(t, pc.fill_null(part.column(c), 0).to_numpy(), side) for c, side in (("a", "left"), ("b", "right")))
                rows = part.column("row")
                said = pc.struct_field(rows, "declared_so_far")
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(said), 0).to_pylist()])
                said = said.flatten()
                own = pc.fill_null(pc.index_in(said, value_set=names), -1).to_numpy()
                first, size, new, lost = 0, 0, [], []
                for i in range(part.num_rows):
                    done, mine = code_of[start[i] : stop[i]], own[ends[i] : ends[i + 1]]
                    there[done] = True
                    lost.append(ends[i] + np.flatnonzero(~there[mine] | (mine < 0)) if len(names) else np.arange(ends[i], ends[i + 1]))
                    there[mine[mine >= 0]] = False
                    new.append(np.flatnonzero(there))
                    there[done] = False
                    size += len(new[-1])
                    if i + 1 == part.num_rows or size > PATHS:
                        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), of.take(pa.array(np.concatenate(x)))) for x, of in ((new, names), (lost, said))]
                        yield pa.RecordBatch.from_arrays([rows.slice(first, i + 1 - first), *lists], names=["row", "undeclared", "phantom"])
                        first, size, new, lost = i + 1, 0, [], []

    schema = StructType().add("row", turns.schema).add("undeclared", ArrayType(StringType())).add("phantom", ArrayType(StringType()))
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = mine.union(seen).repartition(width, "piece").sortWithinPartitions("piece", "kind", "a").mapInArrow(run, schema)
    wrong = F.size("undeclared") + F.size("phantom")
    union = F.size("undeclared") + F.size("row.declared_so_far")
    score = F.when(union > 0, wrong.cast("double") / union).otherwise(0.0)
    done = F.array_sort(F.array_union(F.array_except("row.declared_so_far", "phantom"), "undeclared"))
    return found.select("row.*", done.alias("done"), F.struct("undeclared", "phantom", score.alias("score")).alias("drift"))


def verdict(versions: DataFrame, key: str, order: list[str], drift_col: str = "drift") -> DataFrame:
    """Each session's last drift that isn't null, kept only if it names something."""
    last = F.max_by(drift_col, F.struct(*order))
    found = versions.where(F.col(drift_col).isNotNull()).groupBy(key).agg(last.alias(drift_col))
    return found.where((F.size(f"{drift_col}.undeclared") > 0) | (F.size(f"{drift_col}.phantom") > 0))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of two trees (path, hash): added, deleted or modified."""
    both = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def line_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, lines_added, lines_removed) between two trees (path, text): lines are a multiset."""
    signed = lambda df, n: df.select("path", F.explode(F.split("text", "\n")).alias("line"), F.lit(n).alias("n"))
    net = signed(after, 1).union(signed(before, -1)).groupBy("path", "line").agg(F.sum("n").alias("d"))
    return net.groupBy("path").agg(F.sum(F.greatest("d", F.lit(0))).alias("lines_added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("lines_removed"))
