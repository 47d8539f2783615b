"""The engine as one object over a folder of tables: ingest, observe, and every question.

Tables are parquet under `root`. Appends keep the first row of a key; nodes keep the last. Results are DataFrames; only
render(), answer() and rewind() bring rows to the driver, and those are bounded reports or stated files.
"""

from __future__ import annotations

import hashlib
import hmac
import inspect
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers, code
from .functions import scalars as S
from .operators import coupling, dlp, drift, graph, history, payload, reports, search, tables
from .plans import lineage, pipeline
from .sources import jsonl, transcripts

DIM = 256


class Engine:
    def __init__(self, spark: SparkSession, root: str, remote: bool = True):
        self.spark, self.root, self.remote = spark, root.rstrip("/"), remote

    # --- tables -------------------------------------------------------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                self._switch(name)  # a driver may have been lost between two names
                return self._found(name)
            raise

    def _found(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return None

    def need(self, name: str) -> DataFrame:
        found = self.table(name)
        if found is None:
            raise LookupError(f"no table {name} under {self.root}")
        return found

    def append(self, name: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """First wins: rows of known keys are left out, so running a job again adds nothing."""
        old = self.table(name)
        new = tables.append_new(old if old is not None else self.spark.createDataFrame([], rows.schema), rows, keys, order)
        coupling.checkpointed(new).write.mode("append").parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes the new table beside the old one and then switches names, so a lost driver loses neither."""
        coupling.checkpointed(rows).write.mode("overwrite").parquet(self.path(f"{name}.next"))
        self._switch(name)

    def _switch(self, name: str) -> None:
        at = lambda path: self.spark._jvm.org.apache.hadoop.fs.Path(path)
        new, now, old = (at(self.path(n)) for n in (f"{name}.next", name, f"{name}.old"))
        fs = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at(f"{self.path(name)}.next/_SUCCESS")):
            if fs.exists(now):
                fs.delete(old, True)
                fs.rename(now, old)
            fs.rename(new, now)
            fs.delete(old, True)
            self.spark.catalog.refreshByPath(self.path(name))

    def log(self, event: str, detail: str) -> None:
        """Events are numbered by their moment in microseconds, so that two writers need not agree."""
        row = self.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("id"), F.current_timestamp().alias("timestamp"), F.lit(event).alias("event_type"), F.lit(detail).alias("detail"))
        row.coalesce(1).write.mode("append").parquet(self.path("audit_log"))

    # --- building -----------------------------------------------------------------------------------------------------

    def ingest(self, commit_files: DataFrame) -> None:
        """Facts from commits: artifacts over renames, versions, commit tasks, edges, payloads, symbols, risk."""
        files = coupling.checkpointed(commit_files)
        ids, moved = lineage.artifacts(files)
        rows = lineage.lives(files).withColumnRenamed("rel_path", "path").join(ids, ["repo", "path", "life"])
        rows = rows.join(moved.select("repo", "sha", "path", F.col("status").alias("_moved"), "from_path"), ["repo", "sha", "path"], "left")
        kind = F.coalesce("_moved", F.when(F.col("content").isNull(), "deleted").when(F.col("starts"), "added").otherwise("modified"))
        versions = rows.select(
            "repo", "artifact_id", S.content_id("ver", F.col("artifact_id"), F.col("sha"), F.col("timestamp"), S.author_key(F.col("author_email"), F.col("author_name"))).alias("id"), F.col("timestamp").alias("ts"), "path",
            F.lit("file").alias("level"), F.md5(F.coalesce("content", "before")).alias("fingerprint"), kind.alias("change_kind"), "from_path", "lines_added", "lines_removed", (F.col("lines_added") + F.col("lines_removed")).cast("long").alias("lines"),
            F.col("sha").alias("commit"), F.when(F.col("diff") != "", S.content_ref(F.col("diff"))).alias("diff_ref"), F.lit(False).alias("payload_purged"),
        )
        self.append("versions", versions, ["id"], ["ts"])
        self.append("tasks", pipeline.commit_tasks(files).select("id", "repo", F.col("sha").alias("ref"), "created_at", F.col("author_name").alias("author"), "message", "reviewers", "source_adapter", F.lit(None).cast("string").alias("model")), ["id"], ["created_at"])
        edges = versions.select(F.lit("task_modifies_artifact").alias("kind"), S.content_id("tsk", F.col("repo"), F.col("commit")).alias("src"), F.col("artifact_id").alias("dst"), F.col("id").alias("version"), "change_kind", "lines_added", "lines_removed")
        self.append("edges", edges, ["kind", "src", "dst"], ["version"])
        self.append("payload", payload.put(files.where("diff <> ''"), "diff"), ["ref"], ["ref"])
        latest = files.groupBy("repo", "rel_path").agg(F.max_by("content", F.struct("timestamp", "sha")).alias("text")).where("text IS NOT NULL")
        parsed = code.parse_files(latest.select(F.concat_ws(S.UNIT, "repo", "rel_path").alias("path"), "text")).where("symbol IS NOT NULL")
        self.replace("symbols", parsed.select(F.split("path", S.UNIT)[0].alias("repo"), F.split("path", S.UNIT)[1].alias("file"), F.split("symbol", S.UNIT)[1].alias("path"), "kind", "first", "last", "hash"))
        self.recompute()
        self.log("ingest", "commits")

    def observe(self, lines: DataFrame, dialect: str = "messages", exclude: Sequence[str] = (), roots: dict[str, str] | None = None) -> None:
        """Declarations from transcripts: sessions as tasks, turns with drift, reads and secrets, edges, embeddings, risk.

        A session meets the versions of its own repository: by `roots`, else by its directory (see session_repo).
        """
        turns = transcripts.turns(lines) if dialect == "messages" else transcripts.item_turns(lines)
        turns = dlp.excluded(turns.withColumn("cwd", F.coalesce("cwd", F.lit(""))), "cwd", exclude)
        turns = coupling.checkpointed(transcripts.paths(turns))
        secrets = transcripts.read_secrets(turns).groupBy("session_id", "ordinal").agg(F.collect_list(F.struct("path", "kinds")).alias("read_secrets"))
        versions = self.table("versions")
        seen = versions if versions is not None else self.spark.createDataFrame([], "repo string, path string, ts timestamp, artifact_id string, id string, lines_added int, lines_removed int, change_kind string")
        clean = coupling.checkpointed(transcripts.redacted(pipeline.session_repo(turns, seen, roots)))
        judged = pipeline.observe(clean, seen).join(secrets, ["session_id", "ordinal"], "left")
        task = S.content_id("tsk", F.lit(dialect), F.col("session_id"))
        held = judged.select(
            S.content_id("ver", task, F.col("ordinal")).alias("id"), task.alias("task_id"), "repo", F.col("timestamp").alias("ts"), "ordinal", S.content_ref(F.coalesce("prompt", F.lit(""))).alias("prompt_ref"), S.turn_summary(F.col("prompt"), F.col("declared")).alias("summary"),
            "declared", "drift", "reads", F.coalesce("read_secrets", F.array().cast("array<struct<path: string, kinds: array<string>>>")).alias("read_secrets"), F.lit(False).alias("payload_purged"), "model",
        )
        held = coupling.checkpointed(held)
        self.append("task_versions", held, ["id"], ["ts"])
        first = clean.groupBy(task.alias("id")).agg(F.min("session_id").alias("ref"), F.min("repo").alias("repo"), F.min("timestamp").alias("created_at"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("ordinal"))).alias("model"))
        none = F.array().cast("array<string>")
        self.append("tasks", first.select("id", "repo", "ref", "created_at", F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("message"), none.alias("reviewers"), F.lit(dialect).alias("source_adapter"), "model"), ["id"], ["created_at"])
        self.append("payload", payload.put(clean.select(F.coalesce("prompt", F.lit("")).alias("text")), "text"), ["ref"], ["ref"])
        spans = clean.groupBy(task.alias("session"), F.col("repo").alias("key")).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        near = drift.correlate(spans, seen.select(F.col("repo").alias("key"), "ts", "artifact_id", F.col("id").alias("version"), "change_kind", "lines_added", "lines_removed"))
        one = F.min_by(F.struct("version", "change_kind", "lines_added", "lines_removed"), F.struct("ts", "version"))
        self.append("edges", near.groupBy(F.col("session").alias("src"), F.col("artifact_id").alias("dst")).agg(one.alias("x")).select(F.lit("task_modifies_artifact").alias("kind"), "src", "dst", "x.*"), ["kind", "src", "dst"], ["version"])
        self.reembed()
        if versions is not None:
            self.recompute()
        self.log("observe", dialect)

    def recompute(self) -> None:
        """Risk of every artifact."""
        tv = self.table("task_versions")
        self.replace("risk", pipeline.recompute_risk(self.need("versions"), tv.select("repo", "drift") if tv is not None else None))

    def reembed(self, dim: int = DIM) -> None:
        """Embeddings of all tasks that have summaries, from scratch."""
        tv = self.need("task_versions").groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "summary"))), lambda x: x["summary"]).alias("s"))
        self.replace("task_embeddings", search.embed(tv.select("task_id", F.array_join("s", "\n").alias("text")), "task_id", "text", dim))

    def refresh(self, commit_files: DataFrame | None = None, lines: DataFrame | None = None) -> None:
        """Whatever is new, in order: commits, transcripts, embeddings and risk with them."""
        if commit_files is not None:
            self.ingest(commit_files)
        if lines is not None:
            self.observe(lines)

    def watch(self, folder: str, state: str, send: Callable[[DataFrame, int], None], floor: str = "warn", once: bool = True, every: str = "30 seconds", dialect: str = "messages"):
        """Follows transcripts that grow in `folder` and sends each new finding once, over restarts too.

        A batch's lines are appended to transcript_lines; the sessions they belong to are read again whole, as a turn may
        go on, and what is already in the alerts table is left out.
        """

        def step(batch: DataFrame, number: int) -> None:
            lines = coupling.checkpointed(batch)
            if lines.isEmpty():
                return
            self.append("transcript_lines", lines, ["file", "byte_offset"], ["byte_offset"])
            whole = self.need("transcript_lines").join(lines.select("file").distinct(), "file", "left_semi")
            turns = transcripts.paths(transcripts.turns(whole) if dialect == "messages" else transcripts.item_turns(whole))
            kinds = transcripts.read_secrets(turns)
            reads = turns.select(S.content_id("tsk", F.lit(dialect), F.col("session_id")).alias("task_id"), "session_id", "ordinal", F.col("timestamp").alias("ts"), F.col("ordinal").alias("version_id"), F.coalesce("model", F.lit("")).alias("model"), F.explode("reads").alias("path"))
            reads = reads.join(kinds, ["session_id", "ordinal", "path"], "left").withColumn("secret_kinds", F.coalesce("kinds", F.array().cast("array<string>"))).withColumn("remote", F.lit(self.remote))
            found = dlp.at_least(dlp.findings(dlp.first_reads(reads)), floor).select("task_id", "model", "path", "rule", "severity", "detail", "ts")
            old = self.table("alerts")
            fresh = found if old is None else found.join(old.select("task_id", "model", "path", "rule"), ["task_id", "model", "path", "rule"], "left_anti")
            fresh = coupling.checkpointed(fresh.dropDuplicates(["task_id", "model", "path", "rule"]))
            send(fresh, number)
            fresh.write.mode("append").parquet(self.path("alerts"))

        jsonl.register(self.spark)
        stream = self.spark.readStream.format("growing_lines").option("path", folder).load()
        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", state)
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
        if once:
            query.awaitTermination()
        return query

    # --- questions ----------------------------------------------------------------------------------------------------

    def agents(self) -> DataFrame:
        return self.need("tasks").where("source_adapter IS NOT NULL")

    def commits(self) -> DataFrame:
        return self.need("tasks").where("source_adapter IS NULL")

    def risks(self, repo: str | None = None) -> DataFrame:
        v = self.need("versions")
        known = (v.where(F.col("repo") == repo) if repo else v).groupBy("artifact_id").agg(F.max_by(F.struct("repo", "path"), F.struct("ts", "id")).alias("x")).select("artifact_id", "x.*")
        return self.need("risk").join(known, "artifact_id").withColumnRenamed("artifact_id", "id")

    def levels(self, repo: str | None = None, level: str | None = None) -> DataFrame:
        """Files, modules and repositories with the greatest risk below them, all or those of a repository and a level."""
        out = coupling.levels_of(self.risks(repo), ["apriori", "aposteriori", "fused"])
        return out.where(F.col("level") == level) if level else out

    def incidents(self) -> DataFrame:
        """Sessions with drift, the worst first."""
        return self.verdicts().orderBy(F.desc("drift.score"), "task_id")

    def debug(self, question: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
        vec = self.spark.range(1).select(S.local_embed(F.lit(question), DIM).alias("v")).first()["v"]
        vectors = self.need("task_embeddings").withColumnRenamed("task_id", "id")
        return pipeline.debug_query(vectors, self.need("tasks"), self.need("edges").where("kind = 'task_modifies_artifact'"), self.risks().select("id", "fused"), self.need("versions"), vec, k)

    def retrieve(self, question: str, k: int = 8) -> DataFrame:
        """Tasks for a question, without a model: up to half of k that touched a path it names, then the best by meaning."""
        hits, _ = self.debug(question, 2 * k)
        names = S.entity_tokens(question)
        tasks = self.need("tasks").select("id", "created_at")
        named = search.lexical(self.risks().select(F.col("id").alias("dst"), "path"), names) if names else None
        touched = tasks.join(self.need("edges").join(named, "dst").select(F.col("src").alias("id")).distinct(), "id") if named is not None else tasks.limit(0)
        return search.lexical_first(touched, hits.select("id", "score"), k)

    def evidence(self, chosen: DataFrame, chars: int = 480, reads: int = 8, artifacts: int = 6) -> DataFrame:
        """What a model is shown of each task (id): summary, reads, drift and the riskiest artifacts, each cut to size and scrubbed."""
        ids = chosen.select(F.col("id").alias("task_id")).distinct()
        last = F.max_by(F.col("drift"), F.struct("ts", "id"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "summary"))), lambda x: x["summary"])
        said = self.need("task_versions").join(F.broadcast(ids), "task_id").groupBy("task_id").agg(F.array_join(ordered, "\n").alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("r"), last.alias("d"))
        done = reports.touched_lines(self.need("edges").join(F.broadcast(ids.withColumnRenamed("task_id", "src")), "src").join(self.risks().select(F.col("id").alias("dst"), "fused", "path"), "dst").select(F.col("src").alias("task"), "fused", "path"), artifacts)
        cut = F.when(F.length("s") > chars, F.concat(F.left("s", F.lit(chars)), F.lit("… (truncated)"))).otherwise(F.col("s"))
        return said.join(done.withColumnRenamed("task", "task_id"), "task_id", "left").select(
            F.col("task_id").alias("id"), S.redact_free_text(cut).alias("summary"), S.redact_paths(S.short_list(F.col("r"), reads)).alias("reads"), F.size("d.undeclared").alias("undeclared"), F.size("d.phantom").alias("phantom"), "touched"
        )

    def ask(self, question: str, model: Callable[[str], str], k: int = 8) -> tuple[answers.Answer, list[str]]:
        """A model's answer over the retrieved evidence, and the tasks to show: those retrieved and those it adds."""
        chosen = [r["id"] for r in self.retrieve(question, k).collect()]
        rows = self.evidence(self.spark.createDataFrame([(i,) for i in chosen], "id string"))
        asked = self.spark.range(1).select(S.redact_free_text(F.lit(question)).alias("q"), S.intent(F.lit(question))["intent"].alias("i")).first()
        answer = answers.parse(model(f"{asked['q']}\n\n{reports.render(rows, 'json')}"), set(chosen), asked["i"])
        return answer, answers.merged(chosen, answer.ids("task"))

    def audit(self, repo: str | None = None) -> DataFrame:
        return reports.histogram(self.risks(repo))

    def top(self, k: int = 10, repo: str | None = None) -> DataFrame:
        return reports.top_risk(self.risks(repo), k).select("id", "path", "fused", "transition")

    def reads(self) -> DataFrame:
        """Every read of every agent task, the first of a path in a task deciding its secrets."""
        tv = self.need("task_versions").join(self.agents().select(F.col("id").alias("task_id"), F.col("model").alias("task_model")), "task_id")
        kinds = F.coalesce(F.try_element_at(F.map_from_entries(F.transform("read_secrets", lambda s: F.struct(s["path"], s["kinds"]))), F.col("path")), F.array().cast("array<string>"))
        each = tv.withColumn("path", F.explode("reads")).select("task_id", F.col("id").alias("version_id"), "ts", "path", kinds.alias("secret_kinds"), F.lit(self.remote).alias("remote"), F.coalesce("model", "task_model").alias("model"))
        return dlp.first_reads(each)

    def guard(self, floor: str = "info", globs: Sequence[str] = S.SENSITIVE_GLOBS) -> DataFrame:
        return dlp.at_least(dlp.findings(self.reads(), globs), floor)

    def preflight(self, files: DataFrame, globs: Sequence[str] = S.SENSITIVE_GLOBS) -> DataFrame:
        """Findings in files (path, text) before they are given to a model."""
        rows = files.select("path", S.secret_kinds(F.col("text")).alias("secret_kinds"), F.lit(True).alias("remote"))
        return dlp.findings(rows, globs)

    def verdicts(self) -> DataFrame:
        return drift.verdict(self.need("task_versions").join(self.agents().select(F.col("id").alias("task_id")), "task_id"), "task_id", ["ts", "id"])

    def report(self) -> DataFrame:
        footprint = self.need("edges").join(self.agents().select(F.col("id").alias("src")), "src", "left_semi")
        return reports.totals(self.agents(), self.commits(), self.reads(), self.verdicts(), footprint).crossJoin(F.broadcast(self.audit()))

    def today(self, now: Column, since: str = "24h") -> DataFrame:
        seconds = S.parse_since(since)
        if seconds is None:
            raise ValueError(f"no span of time: {since!r}")
        tv = self.need("task_versions")
        found = F.size("read_secrets")
        return reports.today(tv.select(F.col("task_id").alias("session"), "id", "ts", F.col("drift.score").alias("drift"), found.alias("secret_reads")), now - F.expr(f"INTERVAL {seconds} SECONDS"))

    def behind(self) -> DataFrame:
        return reports.shared_versions(self.need("edges"), self.need("tasks"))

    def provenance(self, sha: str) -> DataFrame:
        """What the sessions behind a commit read and how they drifted; the first commit with that prefix."""
        commit = self.commits().where(F.col("ref").startswith(sha)).orderBy("created_at", "id").limit(1).select(F.col("id").alias("commit"))
        tv = self.need("task_versions").select("task_id", "reads", "read_secrets", F.col("drift.undeclared").alias("undeclared"), F.col("drift.phantom").alias("phantom"))
        return reports.provenance(self.behind().join(commit, "commit"), tv)

    def attribution(self, sha: str | None = None) -> DataFrame:
        v = self.need("versions").where("diff_ref IS NOT NULL")
        v = v.where(F.col("commit").startswith(sha)) if sha else v
        return graph.attribution(v.join(self.need("payload").select(F.col("ref").alias("diff_ref"), F.col("content").cast("string").alias("diff")), "diff_ref").select("commit", "path", "diff"))

    def compliance(self) -> DataFrame:
        tv = self.need("task_versions").groupBy(F.col("task_id").alias("agent")).agg(F.sum(F.size("read_secrets")).alias("secret_reads"), F.max("drift.score").alias("drift"))
        agents = self.agents().select(F.col("id").alias("agent"), "model").join(tv, "agent")
        return reports.compliance(self.commits().select(F.col("id").alias("commit"), "reviewers"), self.behind(), agents)

    def context(self, path: str) -> DataFrame:
        """An artifact with the sessions that touched it."""
        worst = self.need("task_versions").groupBy("task_id").agg(F.max("drift.score").alias("drift"))
        return graph.artifact_context(self.risks().where(F.col("path") == path).select("id", "path", "fused", "transition"), self.need("edges"), self.need("tasks"), worst)

    def blame(self, path: str, line: int) -> DataFrame:
        """The narrowest symbol around a line, and the last versions of its file."""
        here = self.spark.createDataFrame([(path, line)], "file string, line int")
        symbol = graph.enclosing_symbol(self.need("symbols").where(F.col("file") == path), here)
        v = self.need("versions")
        ids = v.where(F.col("path") == path).select("artifact_id").distinct()
        return history.newest(v.join(ids, "artifact_id", "left_semi"), 5).select(F.lit(path).alias("file"), "commit", "ts", "change_kind", "rn").join(symbol, "file", "left")

    def commit_detail(self, sha: str) -> DataFrame:
        commit = self.commits().where(F.col("ref").startswith(sha)).select(F.col("id").alias("src"))
        return graph.commit_detail(self.need("edges").join(commit, "src", "left_semi"), self.risks().select("id", "path"), self.need("versions").select("artifact_id", "id", "ts")).orderBy("path")

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        risks = self.risks()
        top = coupling.levels_of(risks, ["fused"]).where("level <> 'file'")
        named = F.when(F.col("level") == "repo", S.content_id("art", F.col("repo"), F.col("level"))).otherwise(S.content_id("art", F.col("repo"), F.col("level"), F.col("path")))
        nodes = risks.select("id", F.lit("file").alias("level"), "fused").union(top.select(named, "level", "fused"))
        module = S.content_id("art", F.col("repo"), F.lit("module"), S.module_path(F.col("path")))
        repo = S.content_id("art", F.col("repo"), F.lit("repo"))
        kept = risks.select(repo.alias("r"), module.alias("m"), "id")
        contains = kept.select(F.col("r").alias("src"), F.col("m").alias("dst")).distinct().union(kept.select("m", "id"))
        return graph.snapshot(nodes, self.need("tasks"), contains, self.need("edges"))

    # --- maintenance --------------------------------------------------------------------------------------------------

    def verify(self) -> DataFrame:
        refs = payload.references((self.need("versions").where("NOT payload_purged"), "diff_ref"), *([(self.need("task_versions").where("NOT payload_purged"), "prompt_ref")] if self.table("task_versions") is not None else []))
        return payload.integrity(refs, self.need("payload"))

    def purge(self, cutoff: Column) -> DataFrame:
        v = self.need("versions").withColumn("ref", F.col("diff_ref")).withColumn("task_id", S.content_id("tsk", F.col("repo"), F.col("commit")))
        marked, _, counts = payload.purge(v, self.need("payload"), cutoff)
        counts, marked = coupling.checkpointed(counts), coupling.checkpointed(marked)
        prompts = self.table("task_versions")
        live = payload.references((marked.where("NOT payload_purged"), "diff_ref"), *([(prompts, "prompt_ref")] if prompts is not None else []))
        left = coupling.checkpointed(self.need("payload").join(live, "ref", "left_semi"))
        self.replace("versions", marked.drop("ref", "task_id"))
        self.replace("payload", left)
        self.log("purge", "payloads")
        return counts

    def checkpoint(self, files: DataFrame, at: Column) -> str:
        self.append("payload", payload.put(files, "text"), ["ref"], ["ref"])
        rows = coupling.checkpointed(payload.checkpoint(files, at))
        self.append("checkpoint_files", rows, ["checkpoint_id", "rel_path"], ["rel_path"])
        return rows.first()["checkpoint_id"]

    def rewind(self, checkpoint_id: str, to: str) -> int:
        return payload.rewind(self.need("checkpoint_files"), self.need("payload"), checkpoint_id, to)

    # --- protocols ----------------------------------------------------------------------------------------------------

    def tools(self) -> dict[str, tuple[str, Callable[..., DataFrame]]]:
        return {
            "debug": ("Tasks that best answer a question", lambda query, k=8: self.debug(query, k)[0].select("id", "score")),
            "audit": ("Risk figures of a repository", lambda repo=None: self.audit(repo)),
            "context": ("Who touched an artifact and how risky it is", lambda path: self.context(path)),
            "blame": ("The symbol and last versions around a line", lambda path, line: self.blame(path, int(line))),
        }

    def answer(self, request: dict, most: int = 200) -> dict | None:
        """One JSON-RPC request of a tool protocol: initialize, ping, tools/list, tools/call. Notifications have no answer."""
        method, number = request.get("method"), request.get("id")
        if number is None:
            return None
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tracelake", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": _schema(f)} for n, (d, f) in self.tools().items()]}
        elif method == "tools/call":
            p = request.get("params") or {}
            if p.get("name") not in self.tools():
                return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"no tool {p.get('name')!r}"}}
            try:
                text, bad = reports.render(self.tools()[p["name"]][1](**(p.get("arguments") or {})), "json", most), False
            except (LookupError, TypeError, ValueError) as e:
                text, bad = str(e), True
            result = {"content": [{"type": "text", "text": text}], "isError": bad}
        else:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method!r}"}}
        return {"jsonrpc": "2.0", "id": number, "result": result}

    def statement(self, sha: str) -> dict:
        """A commit's provenance as a statement about the commit."""
        rows = [r.asDict(recursive=True) for r in self.provenance(sha).collect()]
        return {"_type": "https://in-toto.io/Statement/v1", "subject": [{"name": "git", "digest": {"gitCommit": sha}}], "predicateType": "tracelake/provenance/v1", "predicate": {"sessions": rows}}


def _schema(tool: Callable) -> dict:
    """What a tool takes, from its signature."""
    given = inspect.signature(tool).parameters.values()
    kinds = {"k": "integer", "line": "integer"}
    return {"type": "object", "properties": {p.name: {"type": kinds.get(p.name, "string")} for p in given}, "required": [p.name for p in given if p.default is p.empty]}


def sign(statement: dict, key: bytes) -> dict:
    """The statement in an envelope with a keyed digest; there is no public-key signature without a library for it."""
    body = json.dumps(statement, sort_keys=True, default=str)
    return {"payload": body, "signatures": [{"sig": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}]}


def is_signed(envelope: dict, key: bytes) -> bool:
    want = hmac.new(key, envelope["payload"].encode(), hashlib.sha256).hexdigest()
    return any(hmac.compare_digest(want, s["sig"]) for s in envelope["signatures"])
