"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def heavy_of(counts: DataFrame, key: str | list[str], n: str, rows: int, limit: int = 100_000) -> DataFrame:
    """Keys with more rows than ``limit``; raised with ``rows`` (of all keys) so that there are at most 10,000 of them.

    ``counts`` is a table of ``cut`` that has the number ``n`` of rows of each key.
    """
    return counts.where(F.col(n) > max(limit, rows // 10_000)).select(*_keys(key))


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], heavy: DataFrame) -> DataFrame:
    """Inner join where ``left`` may hold many rows of one key and ``right`` has one row a key.

    Rows of a heavy key stay where they are and meet their one right row by broadcast (``heavy`` has at most 10,000
    keys, see ``heavy_of``); the rest is a plain equi-join, and so is all of it if no key is heavy. ``heavy`` is looked at while
    planning: it should come from a table of ``cut``.
    """
    k = _keys(key)
    if heavy.isEmpty():
        return left.join(right, k)
    hot = F.broadcast(heavy)
    a = left.join(F.broadcast(right.join(hot, k, "left_semi")), k)
    b = left.join(hot, k, "left_anti").join(right, k)
    return a.unionByName(b)


def block_copies(df: DataFrame, rows: Column, limit: int, by: Column) -> DataFrame:
    """Copies of ``df`` for joining large groups with themselves in blocks: adds ``_block``, and ``_at`` (which side it stands on).

    ``rows`` is the size of a row's group. The group falls into ``ceil(rows / limit)`` stripes by a hash of ``by``; a row of stripe
    i is copied to the blocks (i, j) and (j, i) for every j, so two rows of a group share exactly one block in which the first
    stands left and the second right. No block holds more than about ``limit`` rows a side.
    """
    n = F.greatest(F.ceil(rows / limit), F.lit(1)).cast("int")
    stripe = F.pmod(F.xxhash64(by), n).cast("int")
    left = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((stripe * n + j).alias("block"), F.lit("l").alias("at")))
    right = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((j * n + stripe).alias("block"), F.lit("r").alias("at")))
    one = df.withColumn("_c", F.explode(F.concat(left, right)))
    return one.withColumns({"_block": F.col("_c.block"), "_at": F.col("_c.at")}).drop("_c")
