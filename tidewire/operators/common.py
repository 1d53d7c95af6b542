"""Operators used all over: the latest row of a key, and rows ranked within one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is largest by order; an aggregate with partial results, not a sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, "_top.*").select(*rows.columns)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def few(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows, marked for a broadcast if counted to be few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
