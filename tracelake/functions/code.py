"""Structure of source files: symbols and fingerprints.

Python is read by its own parser. For TypeScript, JavaScript and Rust there is no grammar at hand: symbols come from
declarations and their braces, and the fingerprint from the kinds of tokens, so ids of these differ from those that a
full grammar would give. Files of other languages, and those that don't parse, are one symbol-less file whose
fingerprint is that of its lines.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .scalars import GRAMMARS

SCHEMA = "path string, symbol string, kind string, first int, last int, hash string, shingles array<bigint>"
GRAM = 3


def _digest(parts: list[str]) -> tuple[str, list[int]]:
    grams = {"\x1f".join(parts[i : i + GRAM]) for i in range(max(1, len(parts) - GRAM + 1))} if parts else set()
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32], sorted(xxh64_intdigest(g) - (1 << 63) for g in grams)


def _shape(node: ast.AST) -> list[str]:
    """Kinds of nodes with their depth; names and literals don't count."""
    out, todo = [], [(node, 0)]
    while todo:
        n, depth = todo.pop()
        out.append(f"{depth}:{type(n).__name__}")
        todo.extend((c, depth + 1) for c in reversed([*ast.iter_child_nodes(n)]))
    return out


def python_symbols(path: str, text: str) -> list[tuple]:
    tree = ast.parse(text)
    rows = [(path, None, "file", 1, max(1, len(text.splitlines())), *_digest(_shape(tree)))]
    todo = [(tree, "")]
    while todo:
        node, outer = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{outer}.{child.name}" if outer else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                rows.append((path, f"{path}::{name}", kind, child.lineno, child.end_lineno or child.lineno, *_digest(_shape(child))))
                todo.append((child, name))
            elif not isinstance(child, ast.expr):
                todo.append((child, outer))
    return rows


DECLARED = {
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)", re.M),
    "typescript": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|namespace)\s*\*?\s+([A-Za-z_$][\w$]*)", re.M),
}
TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]", re.S)
KEYWORDS = frozenset("if else for while match switch case return break continue fn function class struct enum trait impl interface let const var async await loop use import export pub new throw try catch finally".split())


def _tokens(text: str) -> list[str]:
    """Kinds of tokens: keywords and signs as they are, names and literals by kind; comments go."""
    out = []
    for t in TOKEN.findall(text):
        if t.startswith(("//", "/*")):
            continue
        out.append(t if t in KEYWORDS or not (t[0].isalnum() or t[0] in "_$\"'`") else "literal" if t[0].isdigit() or t[0] in "\"'`" else "name")
    return out


def _end(text: str, at: int) -> int:
    """Where the braces that open after `at` close; the end of the line without braces."""
    start, stop = text.find("{", at), text.find(";", at)
    if start < 0 or 0 <= stop < start:
        return stop if stop >= 0 else len(text)
    depth = 0
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start + m.end()
    return len(text)


def brace_symbols(path: str, text: str, grammar: str) -> list[tuple]:
    rows = [(path, None, "file", 1, max(1, text.count("\n") + 1), *_digest(_tokens(text)))]
    open_: list[tuple[int, str]] = []
    for m in DECLARED["rust" if grammar == "rust" else "typescript"].finditer(text):
        while open_ and open_[-1][0] <= m.start():
            open_.pop()
        end = _end(text, m.end())
        name = f"{open_[-1][1]}.{m[2]}" if open_ else m[2]
        rows.append((path, f"{path}::{name}", m[1], text.count("\n", 0, m.start(1)) + 1, text.count("\n", 0, end) + 1, *_digest(_tokens(text[m.start(1) : end]))))
        open_.append((end, name))
    return rows


def symbols(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA: the file and its symbols."""
    text = text or ""
    grammar = GRAMMARS.get(path.rsplit(".", 1)[-1] if "." in path else "")
    try:
        if grammar == "python":
            return python_symbols(path, text)
        if grammar:
            return brace_symbols(path, text, grammar)
    except (SyntaxError, ValueError, RecursionError):
        pass
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return [(path, None, "file", 1, max(1, text.count("\n") + 1), hashlib.sha256(text.encode()).hexdigest()[:32], sorted({xxh64_intdigest(x) - (1 << 63) for x in lines}))]


def parse_files(files: DataFrame) -> DataFrame:
    """The symbols of each file (path, text)."""
    kinds = pa.schema([("path", pa.string()), ("symbol", pa.string()), ("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("hash", pa.string()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 64):
                part = b.slice(low, 64)
                rows = [r for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in symbols(p, t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).where("path IS NOT NULL").mapInArrow(run, SCHEMA)
