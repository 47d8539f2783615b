"""Coding-agent transcripts: JSON lines to turns, in DataFrame functions.

Input: lines (file, byte_offset, text). Lines that aren't JSON are skipped. Two dialects: `messages`, whose records are
user and assistant messages with parts, and `items`, whose records are response items. A file is one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

PART = "struct<type: string, text: string, id: string, name: string, tool_use_id: string, content: string, input: struct<file_path: string, notebook_path: string, command: string>>"
MESSAGE = "struct<type: string, timestamp: string, sessionId: string, cwd: string, message: struct<model: string, content: string>>"
ITEM = "struct<type: string, timestamp: string, payload: struct<id: string, cwd: string, type: string, role: string, name: string, arguments: string, content: string>>"
#: Tools that write and read files, and where their path is.
WRITES, NOTEBOOK_WRITE, READ, NOTEBOOK_READ, SHELL = ("Edit", "Write", "MultiEdit"), "NotebookEdit", "Read", "NotebookRead", "Bash"
SHELLS = ("exec_command", "shell", "bash", "local_shell")
EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
PEEK = 50


def _text(parts: Column, raw: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """A message's text: its string, or its text parts put together."""
    some = F.filter(parts, lambda p: p["type"].isin(*kinds) & p["text"].isNotNull())
    return F.when(parts.isNotNull(), F.array_join(F.transform(some, lambda p: p["text"]), "")).otherwise(F.coalesce(raw, F.lit("")))


def _first_path(name: Column, part: Column) -> Column:
    return F.when(name == READ, part["input"]["file_path"]).when(name == NOTEBOOK_READ, part["input"]["notebook_path"])


def sessions(lines: DataFrame, dialect: str = "messages") -> DataFrame:
    """(file, session_id, cwd) from the first records that name them."""
    w = Window.partitionBy("file").orderBy("byte_offset")
    head = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PEEK)
    if dialect == "messages":
        r = head.select("file", "_n", F.from_json("text", MESSAGE).alias("r")).select("file", "_n", F.col("r.sessionId").alias("id"), F.col("r.cwd").alias("cwd"))
    else:
        r = head.select("file", "_n", F.from_json("text", ITEM).alias("r")).where("r.type = 'session_meta'").select("file", "_n", F.col("r.payload.id").alias("id"), F.col("r.payload.cwd").alias("cwd"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_n")))
    return r.groupBy("file").agg(first("id").alias("session_id"), first("cwd").alias("cwd")).where("session_id IS NOT NULL")


def _gather(rows: DataFrame, opening: DataFrame, who: DataFrame) -> DataFrame:
    """Turns from per-record contributions: rows (file, ordinal, byte_offset, texts, model, calls)."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", c))), lambda x: x[c]))
    facts = rows.groupBy("file", "ordinal").agg(F.array_join(ordered("texts"), "\n").alias("assistant_text"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("byte_offset"))).alias("model"), ordered("calls").alias("tool_calls"))
    return opening.join(facts, ["file", "ordinal"], "left").join(who, "file")


CALL = "struct<name: string, declared_paths: array<string>, read_paths: array<string>, command: string>"


def turns(lines: DataFrame) -> DataFrame:
    """Turns of the `messages` dialect. A user record with text opens one; tool results in it belong to the turn before."""
    w = Window.partitionBy("file").orderBy("byte_offset")
    r = lines.select("file", "byte_offset", F.from_json("text", MESSAGE).alias("r")).where("r.type IN ('user', 'assistant')")
    raw = F.col("r.message.content")
    r = r.select("file", "byte_offset", F.col("r.type").alias("type"), F.try_to_timestamp("r.timestamp").alias("ts"), F.col("r.message.model").alias("model"), raw.alias("raw"), F.when(raw.startswith("["), F.from_json(raw, f"array<{PART}>")).alias("parts"))
    r = r.withColumn("body", _text(F.col("parts"), F.col("raw")))
    opens = (F.col("type") == "user") & (F.trim(F.regexp_replace("body", r"\s", "")) != "")
    r = r.withColumn("opens", opens).withColumn("ordinal", F.sum(F.col("opens").cast("long")).over(w) - 1)
    opening = r.where("opens").select("file", "ordinal", F.coalesce("ts", F.expr(EPOCH)).alias("timestamp"), F.col("body").alias("prompt"))
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    none = F.array().cast("array<string>")
    writes = lambda p: F.when(p["name"].isin(*WRITES), p["input"]["file_path"]).when(p["name"] == NOTEBOOK_WRITE, p["input"]["notebook_path"])
    listed = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    call = lambda p: F.struct(p["name"].alias("name"), listed(writes(p)).alias("declared_paths"), listed(_first_path(p["name"], p)).alias("read_paths"), F.when(p["name"] == SHELL, p["input"]["command"]).alias("command"))
    said = r.where("type = 'assistant' AND ordinal >= 0").select(
        "file", "ordinal", "byte_offset", "model",
        F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]).alias("texts"),
        F.transform(F.filter(parts, lambda p: (p["type"] == "tool_use") & p["name"].isNotNull()), call).alias("calls"),
    )
    asked = r.where("type = 'assistant' AND ordinal >= 0").select("file", "ordinal", F.explode(parts).alias("p")).where("p.type = 'tool_use' AND p.id IS NOT NULL").select("file", "ordinal", F.col("p.id").alias("tool"), _first_path(F.col("p.name"), F.col("p")).alias("path")).where("path IS NOT NULL")
    got = r.where("type = 'user'").select("file", (F.col("ordinal") - F.col("opens").cast("long")).alias("ordinal"), "byte_offset", F.posexplode(parts).alias("i", "p")).where("p.type = 'tool_result'")
    inner = F.when(F.col("p.content").startswith("["), F.from_json("p.content", f"array<{PART}>"))
    got = got.select("file", "ordinal", "byte_offset", "i", F.col("p.tool_use_id").alias("tool"), _text(inner, F.col("p.content")).alias("content")).where("content <> ''")
    pairs = got.join(asked, ["file", "ordinal", "tool"])
    contents = pairs.groupBy("file", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "i", "path", "content"))), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))).alias("read_contents"))
    out = _gather(said, opening, sessions(lines)).join(contents, ["file", "ordinal"], "left")
    return _columns(out)


def item_turns(lines: DataFrame) -> DataFrame:
    """Turns of the `items` dialect: each user message opens one; its moment is the last that any record gave. File reads go through a shell there and aren't known."""
    w = Window.partitionBy("file").orderBy("byte_offset")
    r = lines.select("file", "byte_offset", F.from_json("text", ITEM).alias("r")).withColumn("ts", F.last(F.try_to_timestamp("r.timestamp"), ignorenulls=True).over(w)).where("r.type = 'response_item'")
    p = F.col("r.payload")
    parts = F.when(p["content"].startswith("["), F.from_json(p["content"], f"array<{PART}>"))
    r = r.select("file", "byte_offset", "ts", p["type"].alias("type"), p["role"].alias("role"), p["name"].alias("name"), p["arguments"].alias("arguments"), _text(parts, p["content"], ("text", "input_text", "output_text")).alias("body"))
    r = r.withColumn("opens", F.coalesce((F.col("type") == "message") & (F.col("role") == "user"), F.lit(False)))
    r = r.withColumn("ordinal", F.sum(F.col("opens").cast("long")).over(w) - 1)
    opening = r.where("opens").select("file", "ordinal", F.coalesce("ts", F.expr(EPOCH)).alias("timestamp"), F.col("body").alias("prompt"))
    patch = F.coalesce(F.get_json_object("arguments", "$.input"), F.col("arguments"), F.lit(""))
    none = F.array().cast("array<string>")
    command = F.coalesce(F.get_json_object("arguments", "$.command"), F.get_json_object("arguments", "$.cmd"))
    call = F.struct(F.col("name"), F.when(F.col("name") == "apply_patch", S.patch_paths(patch)).otherwise(none).alias("declared_paths"), none.alias("read_paths"), F.when(F.col("name").isin(*SHELLS), command).alias("command"))
    calls = F.when((F.col("type") == "function_call") & F.col("name").isNotNull(), F.array(call)).otherwise(F.array().cast(f"array<{CALL}>"))
    texts = F.when((F.col("type") == "message") & (F.col("role") == "assistant"), F.array("body")).otherwise(none)
    said = r.where("ordinal >= 0 AND NOT opens").select("file", "ordinal", "byte_offset", F.lit(None).cast("string").alias("model"), texts.alias("texts"), calls.alias("calls"))
    out = _gather(said, opening, sessions(lines, "items")).withColumn("read_contents", F.lit(None).cast("array<struct<path: string, content: string>>"))
    return _columns(out)


def _columns(out: DataFrame) -> DataFrame:
    empty = F.array().cast(f"array<{CALL}>")
    return out.select(
        "session_id", "cwd", "timestamp", "ordinal", "prompt", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"), "model",
        F.coalesce(F.col("tool_calls").cast(f"array<{CALL}>"), empty).alias("tool_calls"), F.coalesce("read_contents", F.array().cast("array<struct<path: string, content: string>>")).alias("read_contents"),
    )


def paths(turn_rows: DataFrame) -> DataFrame:
    """Adds each turn's sorted distinct declared and read paths, relative to its directory where they lie under it."""
    flat = lambda c: F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("tool_calls", lambda t: t[c])), lambda p: S.normalize_declared(p, F.col("cwd")))))
    return turn_rows.withColumn("declared", flat("declared_paths")).withColumn("reads", flat("read_paths"))


def redacted(turn_rows: DataFrame) -> DataFrame:
    """Turns with secrets scrubbed from both texts and the kinds that were found."""
    kinds = F.array_sort(F.array_distinct(F.concat(*(S.secret_kinds(F.coalesce(c, F.lit(""))) for c in ("prompt", "assistant_text")))))
    return turn_rows.withColumn("redactions", kinds).withColumn("prompt", S.scrub_secrets(F.col("prompt"))).withColumn("assistant_text", S.scrub_secrets(F.col("assistant_text")))


def read_secrets(turn_rows: DataFrame) -> DataFrame:
    """(session_id, ordinal, path, kinds): secret kinds in what was read."""
    each = turn_rows.select("session_id", "ordinal", "cwd", F.explode("read_contents").alias("r"))
    found = each.select("session_id", "ordinal", S.normalize_declared(F.col("r.path"), F.col("cwd")).alias("path"), F.explode(S.secret_kinds(F.col("r.content"))).alias("kind"))
    return found.groupBy("session_id", "ordinal", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
