"""Spans of bytes: merging, lines and columns, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", touch: int = 0, stripe: int | None = None) -> DataFrame:
    """Unions of overlapping spans per key, as gaps and islands: ``keys, start, end``.

    A span joins the one before if it starts at or before its end plus ``touch``. Spans with a null bound are dropped,
    repeated ones merge, an empty table gives no rows. For keys that very many spans have ``stripe`` merges those that start within the
    same so many bytes first, in tasks of their own: what then meets per key is no more than the key's length has room for.
    """
    s = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    if stripe:
        s = s.distinct().withColumn("_stripe", F.floor(F.col("start") / stripe))
        return _islands(_islands(s, [*keys, "_stripe"], touch).drop("_stripe"), keys, touch)
    return _islands(s, keys, touch)


def _islands(s: DataFrame, keys: list[str], touch: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + touch), 1).otherwise(0))
    s = s.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_isle")


def line_of(prefix: Column) -> Column:
    """1-based line of the position behind ``prefix``, the bytes before it as hex digits cut from the content."""
    return F.size(F.split(prefix, "\n")).cast("bigint")
