"""Command line: python -m tracelake ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .model import COMMIT_FILES
from .operators import reports
from .sources import files, git, jsonl


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    p.add_argument("root")
    p.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: _with(sub.add_parser(name), args)
    add("ingest", "repository", "name")
    add("observe", "folder", "dialect")
    for name in ("report", "audit", "incidents", "levels", "guard", "compliance", "verify", "log", "serve"):
        add(name)
    add("query", "question")
    add("today", "since")
    add("preflight", "repository")
    for name in ("provenance", "attribution", "detail"):
        add(name, "sha")
    add("context", "path")
    add("blame", "path", "line")
    add("purge", "before")
    add("checkpoint", "folder")
    add("rewind", "checkpoint", "folder")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e, out = Engine(spark, a.root), None
    if a.command == "ingest":
        git.export(spark, a.repository, a.name, e.path("commit_files"))
        e.ingest(spark.read.schema(COMMIT_FILES).parquet(e.path("commit_files")).where(F.col("repo") == a.name).dropDuplicates(["sha", "rel_path"]))
    elif a.command == "observe":
        jsonl.register(spark)
        e.observe(spark.read.format("growing_lines").option("path", a.folder).load(), a.dialect)
    elif a.command == "preflight":
        out = e.preflight(files.named(spark, a.repository, git.staged(a.repository))).select("path", "rule", "severity", "detail")
    elif a.command == "serve":
        for line in sys.stdin:
            if answer := e.answer(json.loads(line)):
                print(json.dumps(answer), flush=True)
    elif a.command == "checkpoint":
        print(e.checkpoint(files.tree(spark, a.folder), F.current_timestamp()))
    elif a.command == "rewind":
        print(e.rewind(a.checkpoint, a.folder))
    else:
        out = {
            "report": e.report, "audit": e.audit, "incidents": e.incidents, "levels": e.levels, "guard": e.guard, "compliance": e.compliance, "verify": e.verify, "log": lambda: e.need("audit_log").orderBy(F.desc("id")), "query": lambda: e.debug(a.question)[0], "today": lambda: e.today(F.current_timestamp(), a.since),
            "provenance": lambda: e.provenance(a.sha), "attribution": lambda: e.attribution(a.sha), "detail": lambda: e.commit_detail(a.sha), "context": lambda: e.context(a.path), "blame": lambda: e.blame(a.path, int(a.line)), "purge": lambda: e.purge(F.to_timestamp(F.lit(a.before))),
        }[a.command]()
    if out is not None:
        print(reports.render(out, a.format))
        return int(a.command in ("guard", "preflight") and not out.isEmpty())
    return 0


def _with(parser: argparse.ArgumentParser, names: tuple[str, ...]) -> argparse.ArgumentParser:
    for n in names:
        parser.add_argument(n)
    return parser


if __name__ == "__main__":
    sys.exit(main())
