"""Pair rows of crowded records, block against block: pairs are scored where they are made and never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklight.operators.fingerprint import WINDOW
from marklight.session import cut

EPS = 1e-9
#: Windows of a block: at least and at most so many; elements of a unit matrix, and result rows that are sent at once.
LEAST, MOST, CELLS, SENT = 100_000, 1_000_000, 2_000_000, 100_000
KINDS = ("tinyint", "smallint", "int", "bigint")
_PARTS = {"ids": np.int64, "n": np.int32, "query": np.bool_, "counts": np.int32, "units": np.int32, "hashes": np.int64, "sizes": np.int32, "names": np.int64, "codes": np.int32}
_BLOCK = "block int, " + ", ".join(f"{c} binary" for c in _PARTS)
_ROW = "a bigint, b bigint, function_count_a bigint, function_count_b bigint, exact_matches bigint, window_matches bigint, window_union bigint, similarity_percent double, flagged boolean"


def _rows_of(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of every range, one range behind the other."""
    ends = np.cumsum(lens, dtype=np.int64)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])


def _frozen(x: bytes | np.ndarray) -> bytes:
    x = x if isinstance(x, bytes) else x.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _thawed(x: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd"), kind)


def _distinct(rec: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a record and one of ``n`` codes, in order."""
    key = np.unique(rec.astype(np.int64) * max(n, 1) + codes)
    return key // max(n, 1), key % max(n, 1)


def _pack(t: pa.Table) -> dict[str, np.ndarray]:
    """A block of unit rows: its records as numbers of units, and each distinct unit with its windows once, as places in ``names``."""
    t = t.sort_by("id").combine_chunks()
    ids, first_row, counts = np.unique(t["id"].to_numpy(), return_index=True, return_counts=True)
    hashes, first, at = np.unique(t["hash"].to_numpy(), return_index=True, return_inverse=True)
    cuts = t["windows"].chunk(0).take(pa.array(first))
    sizes = pc.list_value_length(cuts).to_numpy(zero_copy_only=False)
    names, codes = np.unique(pc.list_flatten(cuts).to_numpy(zero_copy_only=False), return_inverse=True)
    lens, rec = sizes[at], np.repeat(np.arange(len(ids)), counts)
    own, _ = _distinct(np.repeat(rec, lens), codes[_rows_of(_starts(sizes)[at], lens)], len(names))
    n = np.bincount(own, minlength=len(ids))
    some = n > 0  # records without windows meet nothing
    query = t["query"].to_numpy(zero_copy_only=False)[first_row]
    return {"ids": ids[some], "n": n[some], "query": query[some], "counts": counts[some], "units": at[some[rec]], "hashes": hashes, "sizes": sizes, "names": names, "codes": codes}


def _packing(pack, kinds: dict):
    """Unit rows to one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for x in np.unique(blocks):
                held.setdefault(int(x), []).append(batch.filter(pa.array(blocks == x)))
        for x in [*held]:
            one = pack(pa.Table.from_batches(held.pop(x)))
            yield pa.record_batch([pa.array([x], pa.int32()), *[pa.array([_frozen(np.asarray(one[c]).astype(kind))], pa.binary()) for c, kind in kinds.items()]], names=["block", *kinds])

    return run


def dealt(rows: DataFrame, n: int, column: str = "block") -> DataFrame:
    """Rows of a block in one task, of ``n`` tasks."""
    by = F.pmod(F.col(column), F.lit(n)).cast("int")
    return rows.repartitionById(n, by) if hasattr(rows, "repartitionById") else rows.repartition(n, by)


def meeting(left: DataFrame, m: int, right: DataFrame, n: int, parts: list[str]) -> DataFrame:
    """Every one of ``m`` blocks with every one of ``n``, ``parts`` with ``_l`` and ``_r`` behind their names. A task reads its blocks
    where they lie: what is shuffled grows with the blocks, not with the pairs of them."""
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in ("block", *parts)])
    few = min(m, 44)
    return side(dealt(left, few), "l").crossJoin(side(dealt(right, min(n, 2000 // few)), "r").hint("shuffle_replicate_nl"))


class _Side:
    def __init__(self, row: dict, x: str) -> None:
        for c, kind in _PARTS.items():
            setattr(self, c, _thawed(row[f"{c}_{x}"], kind))
        self.at = _starts(self.counts)

    def coded(self, names: np.ndarray) -> None:
        """Windows as places in ``names``, those not in it left out, by unit (``unit_codes``) and, distinct, by record (``codes``)."""
        place = np.minimum(np.searchsorted(names, self.names), max(len(names) - 1, 0))
        known = (names[place] == self.names if len(names) else np.zeros(len(place), bool))[self.codes]
        unit = np.repeat(np.arange(len(self.sizes)), self.sizes)[known]
        self.unit_codes, self.code_at = place[self.codes][known], _starts(np.bincount(unit, minlength=len(self.sizes)))
        lens = np.diff(self.code_at)[self.units]
        rec = np.repeat(np.repeat(np.arange(len(self.ids)), self.counts), lens)
        self.rec, self.codes = _distinct(rec, self.unit_codes[_rows_of(self.code_at[self.units], lens)], len(names))
        self.rec_at = _starts(np.bincount(self.rec, minlength=len(self.ids)))


def _posted(codes: np.ndarray, holders: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of ``n`` codes those that have it."""
    return np.split(holders[np.argsort(codes, kind="stable")].astype(np.int64), np.cumsum(np.bincount(codes, minlength=n))[:-1])


def _scored(left: _Side, right: _Side, limit: float, low: float | None, mode: str, weights: tuple[float, float]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of the pair rows of each record of ``right`` with those of ``left``. ``mode``: ``apart`` (two blocks), ``same`` (one
    block with itself) or ``query`` (``left`` holds queries, ``right`` any records)."""
    names = left.names
    left.coded(names)
    right.coded(names)
    holders = _posted(left.codes, left.rec, len(names))
    unit_holders = _posted(left.unit_codes, np.repeat(np.arange(len(left.sizes)), np.diff(left.code_at)), len(names))
    total, n_units = len(left.ids), len(left.sizes)
    if not total:
        return
    left_n, left_sizes = left.n.astype(np.int64), left.sizes.astype(np.int64)
    # distinct units of each record on the left
    key = np.unique(np.repeat(np.arange(total), left.counts) * np.int64(n_units) + left.units)
    own, own_at = key % n_units, _starts(np.bincount(key // n_units, minlength=total))
    twin = np.minimum(np.searchsorted(left.hashes, right.hashes), n_units - 1)
    twin = np.where(left.hashes[twin] == right.hashes, twin, -1)
    kept: dict[int, np.ndarray] = {}

    def likeness(u: int) -> np.ndarray:
        """Window Jaccard of one unit on the right with every unit on the left."""
        if (j := kept.get(u)) is None:
            codes = right.unit_codes[right.code_at[u] : right.code_at[u + 1]]
            j = np.zeros(n_units)
            if len(codes):
                k = np.bincount(np.concatenate([unit_holders[c] for c in codes]), minlength=n_units)
                some = np.flatnonzero(k)
                j[some] = k[some] / (right.sizes[u] + left_sizes[some] - k[some])
            if len(kept) * n_units < 4 * CELLS:
                kept[u] = j
        return j

    same = np.zeros(n_units, np.int64)
    for r in range(len(right.ids)):
        codes = right.codes[right.rec_at[r] : right.rec_at[r + 1]]
        if not len(codes):
            continue
        k = np.bincount(np.concatenate([holders[c] for c in codes]), minlength=total)
        of = np.flatnonzero(k) if low is None else np.flatnonzero(k * (1 + low - EPS) >= (low - EPS) * (left_n + right.n[r]))
        me = right.ids[r]
        if mode == "same" or mode == "query" and right.query[r]:
            of = of[left.ids[of] < me]
        if not len(of):
            continue
        shared = k[of]
        union = left_n[of] + right.n[r] - shared
        mine = right.units[right.at[r] : right.at[r + 1]]
        counts = left.counts[of].astype(np.int64)
        cols, seg = left.units[_rows_of(left.at[of], counts)], _starts(counts)[:-1]
        best, ahead = np.zeros(len(cols)), np.zeros(len(of))
        step = max(1, CELLS // max(n_units, len(cols)))
        for i in range(0, len(mine), step):
            j = np.stack([likeness(u)[cols] for u in mine[i : i + step]])
            np.maximum(best, j.max(0), out=best)
            ahead += np.maximum.reduceat(j, seg, axis=1).sum(0)
        unit_score = (np.add.reduceat(best, seg) / counts + ahead / len(mine)) / 2
        percent = 100 * np.clip(weights[0] * (shared / union) + weights[1] * unit_score, 0.0, 1.0)
        flagged = percent >= limit * 100 - EPS
        twins = twin[mine]
        twins = twins[twins >= 0]
        same[twins] = 1
        lens = own_at[of + 1] - own_at[of]
        exact = np.add.reduceat(same[own[_rows_of(own_at[of], lens)]], _starts(lens)[:-1])
        same[twins] = 0
        first = left.ids[of] < me
        here = np.full(len(of), len(mine))
        row = (np.minimum(left.ids[of], me), np.maximum(left.ids[of], me), np.where(first, counts, here), np.where(first, here, counts), exact, shared, union, percent, flagged)
        yield row if low is None else tuple(c[flagged] for c in row)


def _kernel(limit: float, low: float | None, query: bool, weights: tuple[float, float]):
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                mode = "query" if query else "same" if row["block_l"] == row["block_r"] else "apart"
                held, size = [], 0
                for cols in _scored(_Side(row, "l"), _Side(row, "r"), limit, low, mode, weights):
                    held.append(cols)
                    size += len(cols[0])
                    if size >= SENT:
                        yield pa.record_batch([np.concatenate(c) for c in zip(*held)], names=names)
                        held, size = [], 0
                if size:
                    yield pa.record_batch([np.concatenate(c) for c in zip(*held)], names=names)

    return run


def _windows(tokens: Column) -> Column:
    cuts = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    return F.when(F.size(tokens) >= WINDOW, F.array_distinct(cuts)).otherwise(F.array().cast("array<bigint>"))


def _blocks(units: DataFrame, total: int, query: Column, fewest: bool) -> tuple[DataFrame, int]:
    """Blocks of bounded size of ``units(id, hash, windows)`` or ``units(id, text)`` with about ``total`` windows, and their number. A
    ``text`` holds the tokens of a unit, which are smaller than its windows and so cut only behind the shuffle."""
    n = max(1, -(-total // (MOST if fewest else min(MOST, max(LEAST, total // 16)))))
    rows = dealt(units.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), "query": F.coalesce(query, F.lit(False)), "id": F.col("id").cast("bigint")}), n)
    if "text" in units.columns:
        rows = rows.withColumn("tokens", F.split("text", " ")).withColumns({"hash": F.xxhash64("tokens"), "windows": _windows(F.col("tokens"))})
    return cut(rows.select("block", "id", "query", "hash", "windows").mapInArrow(_packing(_pack, _PARTS), _BLOCK)), n


def crowded(recs: DataFrame) -> bool:
    """Whether two of ``records`` share four windows or more on average: then cells of rare windows thin out nothing."""
    df = recs.select(F.explode("windows").alias("w")).groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("k"))
    met, n = df.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0, recs.count()
    return met >= 4 * n * (n - 1) / 2 > 0


def block_pairs(units: DataFrame, limit: float, weights: tuple[float, float], low: float | None = None, queries: Column | None = None) -> DataFrame:
    """The pair row (see ``scored_pairs``) of ``records`` with integer ids, exact, or of records given by their ``units(id, text)``, the
    tokens with blanks between them.

    Without ``queries`` all pairs whose combined score reaches ``limit``, ``low`` being the window Jaccard that they need at
    least; with ``queries`` every pair of a query and another record that share a window, flagged or not. Every record meets every other in one pair of blocks;
    within it an index of windows counts what they share, and units are compared once for all records that have them.
    """
    kind = units.schema["id"].dataType.simpleString()
    if "text" in units.columns:
        cost = F.greatest(F.size(F.split("text", " ")) - (WINDOW - 1), F.lit(0))
    else:
        units = units.select("id", F.explode("units").alias("u")).select("id", "u.hash", "u.windows")
        cost = F.size("windows")
    asked = F.lit(False) if queries is None else F.coalesce(queries, F.lit(False))
    both = units.agg(F.sum(cost), F.sum(F.when(asked, cost))).first()
    right, n = _blocks(units, both[0] or 0, asked, False)
    left, m = (right, n) if queries is None else _blocks(units.where(queries), both[1] or 0, F.lit(True), True)
    met = meeting(left, m, right, n, [*_PARTS])
    met = met if queries is not None else met.where("block_l <= block_r")
    out = met.mapInArrow(_kernel(limit, low, queries is not None, weights), _ROW)
    return out.withColumns({c: F.col(c).cast(kind) for c in "ab"})
