"""Long exact spans shared between records: line-anchored digests, grouped globally."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.operators.skew import heavy_of, skew_join
from marklight.operators.spans import merge_spans
from marklight.session import cut, free, latest, table

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two rolling hashes


@lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=4)
def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


class Rolling:
    """Hashes of any stretch of a block of bytes, from prefix sums modulo 2 ** 64. Equal bytes have equal hashes in any block."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        ahead, back = _power_table(which, 1 << max(n, 1).bit_length())
        self.back = back
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_table(which)[data] * ahead[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.back[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (end - start).astype(np.uint64)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


#: Bytes that are hashed together: many small contents, or a piece of a long one with ``span`` bytes around it.
BLOCK = 1 << 19


class Block:
    """Pieces of contents, one behind the other in ``data``.

    Of each piece: ``row`` (which content), where it begins in the block (``lo``) and in its content (``base``), the length of
    the whole content (``total``), and which offsets of the content the block answers for (``own_from`` to ``own_to``).
    """

    def __init__(self, pieces: list[tuple]):
        self.data = np.frombuffer(b"".join(p[0] for p in pieces), dtype=np.uint8)
        self.row, self.base, self.total, self.own_from, self.own_to = (np.array([p[k] for p in pieces], dtype=np.int64) for k in range(1, 6))
        self.lo = np.concatenate([[0], np.cumsum([len(p[0]) for p in pieces])[:-1]]).astype(np.int64)
        # where lines begin: behind a newline, with the piece that newline is in
        nl = np.flatnonzero(self.data == 10).astype(np.int64)
        self.line, self.piece = nl + 1, self.piece_of(nl)

    def piece_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, at, side="right") - 1

    def offset(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Places in the block as offsets in their contents."""
        return self.base[piece] + at - self.lo[piece]


def _blocks(contents: list, span: int, size: int) -> Iterator[Block]:
    held, room = [], size
    for row, content in enumerate(contents):
        n = len(content)
        for at in range(0, n, size):
            begin, end = max(0, at - span), min(n, at + size + span)
            held.append((content[begin:end], row, begin, n, at, min(n, at + size)))
            room -= end - begin
            if room <= 0:
                yield Block(held)
                held, room = [], size
    if held:
        yield Block(held)


def _unit_rows(span: int, size: int):
    half = span // 2

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for b in _blocks(list(pdf["content"]), span, size):
                at, piece = b.line, b.piece
                before = np.concatenate([[0], at[:-1]]) if len(at) else at
                before = np.maximum(before, b.lo[piece])
                off = b.offset(at, piece)
                ok = (off + half <= b.total[piece]) & (off >= b.own_from[piece]) & (off < b.own_to[piece])
                at, piece, before, off = at[ok], piece[ok], before[ok], off[ok]
                if not len(at):
                    continue
                h = Rolling(b.data)
                # what any stretch that this unit stands for can hold: from the line before, half a span at most, to a whole span
                # behind it; null where the content ends earlier
                before = np.maximum(before, at - half)
                cut_off = off + span > b.total[piece]
                end = np.where(cut_off, at + (b.total[piece] - off), at + span)
                around = pd.array(h(before, end), dtype="Int64")
                around[cut_off] = pd.NA
                yield pd.DataFrame({"id": ids[b.row[piece]], "before": off - (at - before), "at": off, "unit": h(at, at + half), "around": around})

    return rows


def _window_rows(span: int, size: int):
    half = span // 2

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, marks = pdf["id"].to_numpy(), [None if m is None else np.asarray(m, dtype=np.int64) for m in pdf["marks"]]
            for b in _blocks(list(pdf["content"]), span, size):
                s = np.arange(len(b.data), dtype=np.int64)
                piece = np.repeat(np.arange(len(b.lo)), np.diff(np.append(b.lo, len(b.data))))
                off = b.offset(s, piece)
                ok = (off + span <= b.total[piece]) & (off >= b.own_from[piece]) & (off < b.own_to[piece])
                s, piece = s[ok], piece[ok]
                # the first line start behind s; a stretch without one in its first half is tested in any case
                i = np.searchsorted(b.line, s, side="right")
                known = i < len(b.line)
                j = np.minimum(i, max(len(b.line) - 1, 0))
                near = np.zeros(len(s), dtype=bool)
                if len(b.line):
                    near = known & (b.piece[j] == piece) & (b.line[j] - s <= half)
                marked = np.zeros(len(b.line) + 1, dtype=bool)
                for k in range(len(b.lo)):
                    m = marks[b.row[k]]
                    if m is not None and len(m):
                        m = m[(m > b.base[k]) & (m <= b.base[k] + (b.lo[k + 1] if k + 1 < len(b.lo) else len(b.data)) - b.lo[k])]
                        marked[np.searchsorted(b.line, m - b.base[k] + b.lo[k])] = True
                test = ~near | marked[j]
                s, piece = s[test], piece[test]
                if len(s):
                    one, two = Rolling(b.data), Rolling(b.data, 1)
                    yield pd.DataFrame({"id": ids[b.row[piece]], "start": b.offset(s, piece), "h": one(s, s + span), "k": two(s, s + span).astype(np.int32)})

    return rows


def shared_runs(texts: DataFrame, span: int = 200, later_only: bool = False, block: int = BLOCK) -> DataFrame:
    """Longest runs of bytes each of which lies in ``span`` equal bytes of another record: ``id, start, end`` (end exclusive).

    ``texts(id bigint, content binary)``. The units are the half spans that begin at a line: their digests are grouped
    over the whole collection, and the earliest holder of each is kept with it. A stretch of ``span`` bytes either
    contains the unit of the first line that begins in its first half, so that this unit's digest stands in another record too, or
    has no line start there (a long line). So only stretches at shared units or in long lines are tested, by a digest of
    the whole stretch. Where all holders of a unit agree on the half span before it (back to the line before) and the span
    behind it there is nothing to test: that whole stretch is shared. Shared stretches are merged per record. No pair of records
    is ever formed; a group's size only meets ``min`` and ``max``, which combine map-side, and a digest that very many
    records hold meets its group by broadcast. Contents are hashed in blocks of ``block`` bytes, so that a long one needs no more memory.

    ``later_only`` leaves out what a record holds first (smallest id): what remains may be removed, offsets as in the original.
    Null and empty contents have no runs; rows of one id count as one record; a stretch repeated only inside its own
    record is not shared; an empty table gives no rows. Digests have 64 + 32 bits (units 64).
    """
    t = texts.where("id is not null and content is not null and length(content) > 0").select("id", "content")
    units = cut(t.mapInPandas(_unit_rows(span, block), "id bigint, before bigint, at bigint, unit bigint, around bigint"))
    classes = cut(units.groupBy("unit").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"), (F.bool_or(F.col("around").isNull()) | (F.min("around") != F.max("around"))).alias("differ")
    ).where("lo < hi").select("unit", "lo", "n", "differ"))
    held = cut(skew_join(units, classes, "unit", heavy_of(classes, "unit", "n", units.count())).select("id", "before", "at", "differ", "lo"))
    free(units, classes)
    whole = held.where("not differ" + (" and id <> lo" if later_only else "")).select("id", F.col("before").alias("start"), (F.col("at") + span).alias("end"))
    marks = held.where("differ").groupBy("id").agg(F.collect_set("at").alias("marks"))
    windows = cut(t.join(marks, "id", "left").mapInPandas(_window_rows(span, block), "id bigint, start bigint, h bigint, k int"))
    keys = cut(windows.groupBy("h", "k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "k", "lo", "n"))
    hits = skew_join(windows, keys, ["h", "k"], heavy_of(keys, ["h", "k"], "n", windows.count()))
    hits = hits.where(F.col("id") != F.col("lo")) if later_only else hits
    runs = cut(merge_spans(whole.unionByName(hits.select("id", "start", (F.col("start") + span).alias("end"))), ["id"]))
    free(held, windows, keys)
    return runs


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "source_files").select("file_id", "content", "received_at"), "file_id").select(F.col("file_id").alias("id"), "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    r = shared_runs(_contents(spark, d))
    return r.select(F.col("id").alias("file_id"), F.col("start").alias("first_byte"), (F.col("end") - 1).alias("last_byte"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each file stands elsewhere too."""
    c = _contents(spark, d)
    r = shared_runs(c).groupBy("id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("end") - F.col("start")).alias("shared_bytes"))
    size = c.select("id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("bytes"))
    return size.join(r, "id", "left").select(F.col("id").alias("file_id"), "bytes", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"), F.coalesce(F.try_divide("shared_bytes", "bytes"), F.lit(0.0)).alias("share"))


def p1_removable(spark: SparkSession, d: str) -> DataFrame:
    """Runs that an earlier file holds already, by their offsets in the original."""
    r = shared_runs(_contents(spark, d), later_only=True)
    return r.select(F.col("id").alias("file_id"), F.col("start").alias("first_byte"), (F.col("end") - 1).alias("last_byte"))


QUERIES = {"p1_found": p1_found, "p1_shares": p1_shares, "p1_removable": p1_removable}
# every stretch of 200 bytes by its digits, then gaps and islands
_RUNS = """with l as (select file_id, arg_max(content, received_at) as c from source_files where file_id is not null group by file_id),
x as (select file_id, hex(c) as x, octet_length(c) as n from l where octet_length(c) >= 200),
w as (select file_id, s, md5(x[2 * s + 1:2 * s + 400]) as h from (select file_id, x, unnest(range(0, n - 199)) as s from x)),
k as (select h from w group by h having min(file_id) <> max(file_id)), m as (select file_id, s from w where h in (select h from k)),
b as (select *, case when s > lag(s) over (partition by file_id order by s) + 200 then 1 else 0 end as g from m),
i as (select *, sum(g) over (partition by file_id order by s rows unbounded preceding) as i from b),
r as (select file_id, min(s) as first_byte, max(s) + 199 as last_byte from i group by file_id, i) """
SQL = {
    "p1_found": _RUNS + "select * from r",
    "p1_shares": _RUNS + """, t as (select file_id, count(*) as runs, sum(last_byte - first_byte + 1)::bigint as shared_bytes from r group by file_id)
select file_id, coalesce(octet_length(c), 0) as bytes, coalesce(runs, 0) as runs, coalesce(shared_bytes, 0) as shared_bytes, case when octet_length(c) > 0 then coalesce(shared_bytes, 0) / octet_length(c) else 0.0 end as share from l left join t using (file_id)""",
}
