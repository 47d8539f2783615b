"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("simhash", "lattice", "language", "lines", "decontaminate", "html", "transport", "bpe", "toxicity", "urls")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mods = [import_module(f"{__package__}.{m}") for m in MODULES]
    return {k: v for m in mods for k, v in vars(m).items() if k.startswith("op") and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    mods = [import_module(f"{__package__}.{m}") for m in MODULES]
    return {k: v for m in mods for k, v in getattr(m, "ORACLE", {}).items()}
