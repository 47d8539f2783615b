"""Write semantics on immutable tables: latest wins, first wins, updates and deletes as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows, of each key the last by `order`; a new row beats an old one of equal order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def append_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The new rows to append: of keys that the old table doesn't have, the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(old.select(*keys), keys, "left_anti")


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~F.coalesce(where, F.lit(False)))


def audit(spark, events: list[tuple], path: str) -> None:
    """Appends (id, timestamp, event_type, detail) rows to the audit table."""
    from ..model import AUDIT_LOG

    spark.createDataFrame(events, AUDIT_LOG).coalesce(1).write.mode("append").parquet(path)


def audit_tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def generation(*tables: tuple[DataFrame, str | None]) -> DataFrame:
    """One row that changes with the data: a count of each table and, where a column is named, its greatest value."""
    out = None
    for i, (df, column) in enumerate(tables):
        part = df.agg(F.count("*").alias(f"n{i}"), *([F.max(column).alias(f"last{i}")] if column else []))
        out = part if out is None else out.crossJoin(F.broadcast(part))
    return out
