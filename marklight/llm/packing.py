"""Filling fixed-capacity containers with items: along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklight.llm.tokens import TOKENIZER, sized
from marklight.session import cut, table

DIMS, BITS = 4, 8


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points``, integers below ``2 ** bits`` (the transpose form)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@F.pandas_udf(T.LongType())
def curve_key(vector: pd.Series) -> pd.Series:
    v = np.stack([np.asarray(x) for x in vector]) if len(vector) else np.zeros((0, DIMS))
    # coordinates of a projected unit vector are about standard normal: a logistic curve spreads them evenly
    u = 1 / (1 + np.exp(-1.702 * v))
    return pd.Series(hilbert_key(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))


class Bins:
    """Open containers of one capacity: best fit, the fullest that still holds the item.

    A container stays open for ``lag`` windows behind the one it was opened in: it holds neighbours along the curve, and no more
    containers are open than such a stretch can fill.
    """

    def __init__(self, capacity: int, name, lag: int):
        self.capacity, self.name, self.lag = capacity, name, lag
        self.open, self.out, self.born, self.window = [], [], {}, 0

    def put(self, item: tuple, size: int) -> None:
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, bin_ = self.open.pop(i)
        else:
            room, bin_ = self.capacity, self.name()
            self.born[bin_] = self.window
        self.out.append((*item, size, bin_))
        if room > size:
            insort(self.open, (room - size, bin_))

    def next_window(self) -> None:
        self.window += 1
        self.open = [x for x in self.open if self.born[x[1]] + self.lag >= self.window]
        self.born = {x[1]: self.born[x[1]] for x in self.open}


def _pack(window: int, lag: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        cols = ["pack_id", "id", "piece", "tokens", "container_id"]

        def name() -> int:
            nonlocal made
            made += 1
            return (part << 40) | made

        pack, bins, held = None, None, []

        def flush() -> pd.DataFrame:
            # longest first within a stretch of the curve; what stays open takes items of the next stretches too
            for size, item in sorted(held, key=lambda x: -x[0]):
                bins.put(item, size)
            held.clear()
            bins.next_window()
            out, bins.out = bins.out, []
            return pd.DataFrame(out, columns=cols)

        for pdf in batches:
            for p, cap, key, tokens in zip(pdf["pack_id"], pdf["capacity"], pdf["id"], pdf["tokens"]):
                if p != pack:
                    if held:
                        yield flush()
                    pack, bins = p, Bins(int(cap), name, lag)
                piece = 0
                while tokens > cap:  # only a text beyond the capacity is split
                    held.append((int(cap), (p, key, piece)))
                    tokens, piece = tokens - cap, piece + 1
                held.append((int(tokens), (p, key, piece)))
                if len(held) >= window:
                    yield flush()
        if held:
            yield flush()

    return rows


def packed(items: DataFrame, packs: DataFrame, window: int = 4096, lag: int = 2) -> DataFrame:
    """``pack_id, container_id, id, piece, tokens`` for every item and every capacity.

    ``items(id, tokens, vector)``, ``packs(pack_id, capacity)``, a small table of settings. Items are sorted by range along
    the Hilbert curve of their vectors (ties by id, so that equal items spread over tasks), and each task packs its
    stretch, ``window`` items at a time; containers opened more than ``lag`` windows ago are closed. An item is split only if it alone exceeds the capacity, into full pieces and a rest;
    ``piece`` counts from 0 and piece k begins at token ``k * capacity``. Items without tokens go along in any container.
    Null sizes and capacities below 1 are left out; an empty table gives no rows.
    """
    placed = items.where("tokens is not null").select("id", "tokens", curve_key("vector").alias("key"))
    # settings: a row a capacity, read while planning
    sizes = [F.struct(F.lit(r.pack_id).cast("int").alias("pack_id"), F.lit(r.capacity).cast("int").alias("capacity")) for r in packs.where("capacity >= 1").select("pack_id", "capacity").distinct().collect()]
    none = F.array().cast("array<struct<pack_id:int,capacity:int>>")
    each = placed.withColumn("p", F.explode(F.array(*sizes) if sizes else none)).select("id", "tokens", "key", "p.pack_id", "p.capacity")
    sorted_ = each.repartitionByRange("pack_id", "key", "id").sortWithinPartitions("pack_id", "key", "id")
    return sorted_.mapInPandas(_pack(window, lag), "pack_id int, id bigint, piece int, tokens bigint, container_id bigint").select("pack_id", "container_id", "id", "piece", "tokens")


def _items(spark: SparkSession, d: str, path: str = TOKENIZER) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return cut(sized(docs, path, DIMS))


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_sizes").select("pack_id", F.col("capacity_tokens").alias("capacity"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed(_items(spark, d), _packs(spark, d)).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fill of every container."""
    p = cut(packed(_items(spark, d), _packs(spark, d)))
    fill = p.groupBy("pack_id", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return fill.join(F.broadcast(_packs(spark, d)), "pack_id").select("pack_id", "container_id", "items", "tokens", "capacity", (F.col("tokens") / F.col("capacity")).alias("fill"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """For every capacity how many texts are in containers, how many containers are over it, and how many texts were split
    that would have fitted."""
    p = cut(packed(_items(spark, d), _packs(spark, d)))
    over = p.groupBy("pack_id", "container_id").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(_packs(spark, d)), "pack_id").groupBy("pack_id").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    own = p.groupBy("pack_id", "id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")).join(F.broadcast(_packs(spark, d)), "pack_id")
    texts = own.groupBy("pack_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split_in_vain"))
    return texts.join(over, "pack_id").select("pack_id", "texts", "overfull", "split_in_vain")


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_whole": p8_whole}
SQL = {"p8_whole": "select pack_id, count(*) as texts, 0::bigint as overfull, 0::bigint as split_in_vain from pack_sizes, documents where text is not null and capacity_tokens >= 1 group by pack_id"}
