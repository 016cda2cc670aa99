"""Shared windows of many pairs, block against block: spans are looked up where pairs meet, and rows of windows are never shuffled.
Crowded records (``block_evidence``) are scored there too, so that their pairs are nowhere written."""

from __future__ import annotations

import hashlib
from binascii import hexlify
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from marklight.operators import blocks
from marklight.operators.blocks import _distinct, _packing, _rows_of, _scored, _Side, _starts, _thawed, dealt, meeting
from marklight.operators.fingerprint import WINDOW
from marklight.session import cut

#: Windows of a block: at least and at most so many; result rows that are sent at once.
LEAST, MOST, SENT = 50_000, 500_000, 10_000
#: The same for blocks of files, and pairs that are held at once.
MOST_OF_FILES, PAIRS = 300_000, 2_000_000
#: Hex digits of a window's hash.
DIGITS = "S64"
_PARTS = {"ids": np.int64, "counts": np.int32, "codes": np.int32, "names": DIGITS}
_BLOCK = "block int, " + ", ".join(f"{c} binary" for c in (*_PARTS, "spans"))
COLUMNS = ("a", "b", "match_no", "hash", "hash8", "n_spans_a", "n_spans_b", "spans_a", "spans_b")


#: Fixed value: bytes of a snippet.
SNIPPET = 80
_PLACES = ("start", "end", "start_line", "start_col", "end_line", "end_col")


def _merged(at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch."""
    if len(at) < 2:
        return at
    out: list[tuple[int, int]] = []
    for s, e in sorted(at):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _snippet(content: bytes, start: int, end: int) -> bytes:
    """The same as ``byte_snippet``."""
    text = content[start:end].replace(b"\n", b" ").strip(b" \t\r\f\x0b")
    return text if len(text) <= SNIPPET else text[: SNIPPET - 3] + b"..."


def _window_spans(placed: bool, hexed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                rows, hashes, lens, places, snippets = [], [], [], [[] for _ in _PLACES], []
                for i, row in enumerate(batch.to_pylist()):
                    content, found = row.get("content") or b"", {}
                    begins = [0]
                    while placed and (n := content.find(b"\n", begins[-1])) >= 0:
                        begins.append(n + 1)
                    for u in row["units"]:
                        t, starts, ends = u["tokens"], u["starts"], u["ends"]
                        for k in range(len(t) - WINDOW + 1):
                            found.setdefault(" ".join(t[k : k + WINDOW]), []).append((starts[k], ends[k + WINDOW - 1]))
                    for text, at in found.items():
                        if (h := known.get(text)) is None:
                            h = known[text] = hashlib.sha256(text.encode()).hexdigest()
                        at = _merged(at)
                        rows.append(i)
                        hashes.append(h)
                        lens.append(len(at))
                        for s, e in at:
                            if placed:
                                x, y = bisect_right(begins, s), bisect_right(begins, e)
                                where = s, e, x, s - begins[x - 1] + 1, y, e - begins[y - 1] + 1
                                cutout = _snippet(content, s, e)
                                snippets.append(cutout.hex().upper() if hexed else cutout)
                            else:
                                where = s, e
                            for column, value in zip(places, where):
                                column.append(value)
                if len(known) > 200_000:
                    known.clear()
                names = _PLACES if placed else _PLACES[:2]
                fields = [pa.array(c, pa.int64()) for c in places[: len(names)]] + ([pa.array(snippets, pa.string() if hexed else pa.binary())] if placed else [])
                one = pa.StructArray.from_arrays(fields, names=[*names, *(["snippet"] if placed else [])])
                spans = pa.ListArray.from_arrays(pa.array(_starts(np.array(lens, np.int64)), pa.int32()), one)
                yield pa.record_batch([batch["id"].take(pa.array(rows, pa.int64())), pa.array(hashes, pa.string()), spans], names=["id", "hash", "spans"])

    return run


def window_spans(units: DataFrame, files: DataFrame | None = None, hexed: bool = False) -> DataFrame:
    """``id, hash, spans`` of every distinct window of a record's ``units`` with spans: its merged spans, in order. With ``files(id,
    content)`` they have lines, columns and a snippet, ``hexed`` or binary; records without content then have none."""
    one = units.groupBy("id").agg(F.collect_list(F.struct("tokens", "starts", "ends")).alias("units"))
    if files is not None:
        one = one.join(files.where("content is not null").select("id", "content"), "id")
    fields = [StructField(c, LongType()) for c in (_PLACES if files is not None else _PLACES[:2])]
    fields += [StructField("snippet", StringType() if hexed else BinaryType())] if files is not None else []
    return one.mapInArrow(_window_spans(files is not None, hexed), StructType([one.schema["id"], StructField("hash", StringType()), StructField("spans", ArrayType(StructType(fields)))]))


def _frozen(spans: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.record_batch([spans], names=["spans"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack(t: pa.Table) -> pa.Table:
    """One row of a block: its records, their windows in order of the hash as places in ``names``, and each window's spans."""
    t = t.combine_chunks().sort_by([("id", "ascending"), ("hash", "ascending")]).combine_chunks()
    ids, counts = np.unique(t["id"].to_numpy(), return_counts=True)
    names, codes = np.unique(t["hash"].to_numpy().astype(DIGITS), return_inverse=True)
    one = {"ids": ids, "counts": counts, "codes": codes, "names": names}
    cols = {c: pa.array([one[c].astype(kind).tobytes()], pa.binary()) for c, kind in _PARTS.items()}
    return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32())} | cols | {"spans": pa.array([_frozen(t["spans"].chunk(0))], pa.binary())})


def _pack_pairs(t: pa.Table) -> pa.Table:
    one = {c: pa.array([t[c].to_numpy().tobytes()], pa.binary()) for c in "ab"}
    return pa.table({c: pa.array([t[c][0].as_py()], pa.int32()) for c in "lr"} | one)


def _taken(spans: pa.ListArray, lens: np.ndarray, at: np.ndarray) -> pa.ListArray:
    rows = _rows_of(spans.offsets.to_numpy()[at].astype(np.int64), lens)
    return pa.ListArray.from_arrays(pa.array(_starts(lens), pa.int32()), spans.values.take(pa.array(rows)))


def _shared(a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``a, b, match_no`` of shared windows and their places on either side. ``codes`` below ``n``, those of a record in order."""
    order, starts = np.argsort(ids), _starts(counts)
    known = np.isin(a, ids) & np.isin(b, ids)
    a, b = a[known], b[known]
    by = np.lexsort((b, a))
    a, b = order[np.searchsorted(ids, a[by], sorter=order)], order[np.searchsorted(ids, b[by], sorter=order)]
    place = np.full(n, -1)
    # the pairs of one record, a bounded number of windows at a time
    ends = np.flatnonzero((np.diff(a) != 0) | (np.diff(np.cumsum(counts[b]) // SENT) != 0)) + 1
    for i, j in zip([0, *ends], [*ends, len(a)]):
        if i == j:
            continue
        mine, others = np.arange(starts[a[i]], starts[a[i] + 1]), b[i:j]
        theirs = _rows_of(starts[others], counts[others])
        place[codes[mine]] = mine
        met = place[codes[theirs]]
        place[codes[mine]] = -1
        ok = met >= 0
        k = np.add.reduceat(ok, _starts(counts[others])[:-1], dtype=np.int64)
        yield np.full(k.sum(), ids[a[i]]), np.repeat(ids[others], k), _rows_of(np.ones(len(k), np.int64), k), met[ok], theirs[ok]


def _matches(rows: list[dict], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of all pairs between the blocks (one or two) of ``rows``."""
    pairs = next(r for r in rows if r["a"] is not None)
    sides = [{c: np.frombuffer(r[c], kind) for c, kind in _PARTS.items()} | {"spans": pa.ipc.open_stream(r["spans"]).read_all()["spans"].combine_chunks()} for r in rows if r["a"] is None]
    names = np.unique(np.concatenate([x["names"] for x in sides]))
    codes = np.concatenate([np.searchsorted(names, x["names"])[x["codes"]] for x in sides])
    spans = pa.concat_arrays([y for x in sides for y in (x["spans"].chunks if isinstance(x["spans"], pa.ChunkedArray) else [x["spans"]])])
    ids, counts = (np.concatenate([x[c] for x in sides]).astype(np.int64) for c in ("ids", "counts"))
    del sides  # spans are held once
    yield from _sent(_shared(np.frombuffer(pairs["a"], np.int64), np.frombuffer(pairs["b"], np.int64), ids, counts, codes, len(names)), codes, names, spans, columns)


def _sent(shared: Iterator[tuple[np.ndarray, ...]], codes: np.ndarray, names: np.ndarray, spans: pa.ListArray, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Result rows of ``shared`` windows."""
    size = np.diff(spans.offsets.to_numpy()).astype(np.int64)
    text = pa.array(names.astype(str), pa.string())
    short = pc.utf8_slice_codeunits(text, 0, 8)

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole = [np.concatenate(c) for c in zip(*held)]
        for i in range(0, len(whole[0]), 2 * SENT):
            a, b, no, left, right = (c[i : i + 2 * SENT] for c in whole)
            of = {"a": lambda: a, "b": lambda: b, "match_no": lambda: no, "hash": lambda: text.take(pa.array(codes[left])), "hash8": lambda: short.take(pa.array(codes[left]))}
            of |= {"n_spans_a": lambda: size[left], "n_spans_b": lambda: size[right], "spans_a": lambda: _taken(spans, size[left], left), "spans_b": lambda: _taken(spans, size[right], right)}
            yield pa.record_batch([of[c]() for c in columns], names=columns)

    held, n = [], 0
    for cols in shared:
        held.append(cols)
        n += len(cols[0])
        if n >= SENT:
            yield from sent(held)
            held, n = [], 0
    if n:
        yield from sent(held)


def _kernel(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[dict]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cell = row["l"], row["r"]
                waiting.setdefault(cell, []).append(row)
                # its pairs and one block or two; without one of them nothing is shared
                if len(waiting[cell]) == 3 - (row["l"] == row["r"]):
                    yield from _matches(waiting.pop(cell), columns)

    return run


def block_matches(pairs: DataFrame, spans: DataFrame, total: int, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``columns`` of the windows that both records of ``pairs(a, b)`` have, numbered in the order of their hashes, from ``spans(id, hash,
    spans)``, one row a window of a record and about ``total`` rows. Integer ids.

    Records are dealt to blocks, and the pairs of two blocks to one task, which gets both blocks. What is shuffled grows with the
    records times the blocks, not with the windows that pairs share.
    """
    kinds = {"a": pairs.schema["a"].dataType, "b": pairs.schema["b"].dataType}
    n = max(1, -(-total // min(MOST, max(LEAST, total // 12))))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int")
    packed = cut(spans.select(block("id").alias("block"), F.col("id").cast("bigint").alias("id"), "hash", "spans").groupBy("block").applyInArrow(_pack, _BLOCK))
    met = pairs.select(F.least(block("a"), block("b")).alias("l"), F.greatest(block("a"), block("b")).alias("r"), *[F.col(c).cast("bigint").alias(c) for c in "ab"])
    met = cut(met.groupBy("l", "r").applyInArrow(_pack_pairs, "l int, r int, a binary, b binary"))
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sides = other.withColumns({"l": F.least("block", "other"), "r": F.greatest("block", "other")}).join(F.broadcast(met.select("l", "r")), ["l", "r"], "left_semi")
    parts = [*_PARTS, "spans"]
    rows = sides.select("l", "r", *parts, *[F.lit(None).cast("binary").alias(c) for c in "ab"]).unionByName(met.select("l", "r", *[F.lit(None).cast("binary").alias(c) for c in parts], "a", "b"))
    cells = min(n * (n + 1) // 2, 2000)
    cell = F.pmod(F.expr("l * {n} - l * (l - 1) div 2 + r - l".format(n=n)), F.lit(cells)).cast("int")
    dealt = rows.repartitionById(cells, cell) if hasattr(rows, "repartitionById") else rows.repartition(cells, "l", "r")
    kind = {c: LongType() for c in COLUMNS} | {c: StringType() for c in ("hash", "hash8")} | {c: spans.schema["spans"].dataType for c in ("spans_a", "spans_b")}
    out = dealt.mapInArrow(_kernel(list(columns)), StructType([StructField(c, kind[c]) for c in columns]))
    return out.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if t != LongType()})


#: Of a block of files besides ``blocks._PARTS``: windows of each distinct unit as they follow one another, its tokens, the places of each token
#: of a unit (bytes behind the start of the one before, bytes long), and contents.
_FILES = {"digests": DIGITS, "order": np.int32, "widths": np.int32, "gaps": np.int32, "lens": np.int32, "sized": np.int64, "contents": np.uint8}


def placed_units(units: DataFrame) -> list[Column]:
    """``gaps, lens`` of ``units`` with spans: the bytes between the starts of two tokens, from 0 for the first, and those of a token."""
    gaps = F.transform("starts", lambda x, i: (x - F.when(i > 0, F.col("starts")[i - 1]).otherwise(F.lit(0))).cast("int"))
    return [gaps.alias("gaps"), F.zip_with("starts", "ends", lambda s, e: (e - s).cast("int")).alias("lens")]


def _pack_files(t: pa.Table) -> dict[str, np.ndarray]:
    t = t.sort_by("id").combine_chunks()
    files, t = t.filter(pc.is_valid(t["content"])), t.filter(pc.is_valid(t["text"])).combine_chunks()
    ids, counts = np.unique(t["id"].to_numpy(), return_counts=True)
    texts = t["text"].combine_chunks().dictionary_encode()
    at = texts.indices.to_numpy(zero_copy_only=False)
    known: dict[str, int] = {}
    order, widths, hashes = [], [], []
    for text in texts.dictionary.to_pylist():
        tokens = text.split(" ")
        order.append([known.setdefault(" ".join(tokens[k : k + WINDOW]), len(known)) for k in range(len(tokens) - WINDOW + 1)])
        widths.append(len(tokens))
        hashes.append(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little", signed=True))
    digests, place = np.unique(np.array([hashlib.sha256(x.encode()).hexdigest() for x in known], DIGITS), return_inverse=True)
    many = np.array([len(x) for x in order], np.int64)
    order = place[np.array([c for x in order for c in x], np.int64)]
    unit, codes = _distinct(np.repeat(np.arange(len(many)), many), order, len(digests))
    own, _ = _distinct(np.repeat(np.repeat(np.arange(len(ids)), counts), many[at]), order[_rows_of(_starts(many)[at], many[at])], len(digests))
    content = dict(zip(files["id"].to_pylist(), files["content"].to_pylist()))
    contents = [content.get(i, b"") for i in ids.tolist()]
    return {
        "ids": ids, "n": np.bincount(own, minlength=len(ids)), "query": np.zeros(len(ids), bool), "counts": counts, "units": at, "hashes": hashes, "sizes": np.bincount(unit, minlength=len(many)), "names": np.arange(len(digests)), "codes": codes,
        "digests": digests, "order": order, "widths": widths, "gaps": pc.list_flatten(t["gaps"]).to_numpy(), "lens": pc.list_flatten(t["lens"]).to_numpy(), "sized": [len(x) for x in contents], "contents": np.frombuffer(b"".join(contents), np.uint8),
    }


def _placed(side: _Side, places: np.ndarray, n: int, hexed: bool) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Of the windows of each file, in the order of their codes (``places`` of its digests, below ``n``): how many, codes, and merged spans."""
    widths = side.widths[side.units].astype(np.int64)
    at, ends = _starts(widths), np.cumsum(side.gaps, dtype=np.int64)
    starts = ends - np.repeat(np.concatenate([[0], ends])[at[:-1]], widths)
    ends = starts + side.lens
    many = np.maximum(widths - (WINDOW - 1), 0)
    own = np.maximum(side.widths.astype(np.int64) - (WINDOW - 1), 0)
    first = _rows_of(at[:-1], many)
    codes = places[side.order[_rows_of(_starts(own)[side.units], many)]]
    key = np.repeat(np.repeat(np.arange(len(side.ids)), side.counts), many) * np.int64(max(n, 1)) + codes
    s, e = starts[first], ends[first + (WINDOW - 1)]
    by = np.lexsort((s, key))
    key, s, e = key[by], s[by], e[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    # the farthest end so far, of the same window: groups are moved apart
    far = np.cumsum(new) * (np.int64(e.max(initial=0)) + 1)
    reach = np.maximum.accumulate(e + far)
    begins = new.copy()
    begins[1:] |= s[1:] + far[1:] > reach[:-1]
    i = np.flatnonzero(begins)
    rec, s, e = key[i] // max(n, 1), s[i], np.maximum.reduceat(e, i) if len(i) else e
    keys = key[new]
    lens = np.diff(np.append(np.flatnonzero(new[i]), len(i)))
    # lines and columns
    base = _starts(side.sized)[rec]
    breaks = np.flatnonzero(side.contents == 10)
    behind = np.concatenate([[0], breaks + 1])
    columns = [s, e]
    for p in (s + base, e + base):
        line = np.searchsorted(breaks, p)
        columns += [line - np.searchsorted(breaks, base) + 1, p - np.maximum(behind[line], base) + 1]
    # snippets, the same as _snippet
    clean = np.where(side.contents == 10, np.uint8(32), side.contents)
    full = np.append(np.flatnonzero(~np.isin(clean, np.frombuffer(b" \t\r\f\x0b", np.uint8))), len(clean))
    x = np.minimum(full[np.searchsorted(full[:-1], s + base)], e + base)
    y = np.maximum(np.concatenate([[0], full[:-1] + 1])[np.searchsorted(full[:-1], e + base)], x)
    taken = np.where(y - x <= SNIPPET, y - x, SNIPPET - 3)
    offsets = _starts(np.minimum(y - x, SNIPPET))
    out = np.full(offsets[-1], ord("."), np.uint8)
    out[_rows_of(offsets[:-1], taken)] = clean[_rows_of(x, taken)]
    data, step = (hexlify(out).upper(), 2) if hexed else (out.tobytes(), 1)
    snippets = pa.Array.from_buffers(pa.string() if hexed else pa.binary(), len(s), [None, pa.py_buffer((offsets * step).astype(np.int32)), pa.py_buffer(data)])
    one = pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in columns], snippets], names=[*_PLACES, "snippet"])
    return np.bincount(keys // max(n, 1), minlength=len(side.ids)), keys % max(n, 1), pa.ListArray.from_arrays(pa.array(_starts(lens), pa.int32()), one)


def _files(row: dict, x: str) -> _Side:
    side = _Side(row, x)
    for c, kind in _FILES.items():
        setattr(side, c, _thawed(row[f"{c}_{x}"], kind))
    return side


def _cell(row: dict, limit: float, low: float, weights: tuple[float, float], hexed: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of all pairs of two blocks, or of one, whose score reaches ``limit``."""
    same = row["block_l"] == row["block_r"]
    names = np.unique(np.concatenate([_thawed(row[f"digests_{x}"], DIGITS) for x in ("l" if same else "lr")]))
    scored = []
    for x in "lr":
        side = _Side(row, x)
        side.names = np.searchsorted(names, _thawed(row[f"digests_{x}"], DIGITS))
        scored.append(side)
    whole: list = []

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not whole:
            sides = [_files(row, x) for x in ("l" if same else "lr")]
            found = [_placed(x, np.searchsorted(names, x.digests), len(names), hexed) for x in sides]
            whole.extend([np.concatenate([x.ids for x in sides]), *[np.concatenate([f[i] for f in found]) for i in (0, 1)], pa.concat_arrays([f[2] for f in found])])
        ids, counts, codes, spans = whole
        a, b = (np.concatenate(c) for c in zip(*held))
        yield from _sent(_shared(a, b, ids, counts, codes, len(names)), codes, names, spans, columns)

    pairs, held, n = _scored(*scored, limit, low, "same" if same else "apart", weights), [], 0
    for cols in pairs:
        held.append(cols[:2])
        n += len(cols[0])
        if n >= PAIRS:
            yield from rows(held)
            held, n = [], 0
    del pairs, scored  # what only scores need
    if n:
        yield from rows(held)


def file_blocks(units: DataFrame, files: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Blocks of files by their ``units(id, text, gaps, lens)`` with about ``total`` windows and ``files(id, content)``, and their number."""
    n = max(1, -(-total // min(MOST_OF_FILES, max(LEAST, total // 12))))
    rows = units.select("id", "text", "gaps", "lens", F.lit(None).cast("binary").alias("content")).unionByName(files.where("content is not null").select("id", "content"), allowMissingColumns=True)
    rows = dealt(rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), F.col("id").cast("bigint").alias("id"), "text", "gaps", "lens", "content"), n)
    kinds = blocks._PARTS | _FILES
    return cut(rows.mapInArrow(_packing(_pack_files, kinds), "block int, " + ", ".join(f"{c} binary" for c in kinds))), n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many files have each window, and, without a hash, how many there are."""
    for batch in batches:
        for i in range(batch.num_rows):
            digests, codes, sizes, units, counts = (_thawed(batch[c][i].as_py(), kind) for c, kind in (("digests", DIGITS), ("codes", np.int32), ("sizes", np.int32), ("units", np.int32), ("counts", np.int32)))
            lens = sizes[units].astype(np.int64)
            _, own = _distinct(np.repeat(np.repeat(np.arange(len(counts)), counts), lens), codes[_rows_of(_starts(sizes)[units], lens)], len(digests))
            yield pa.record_batch([pa.array([*digests.astype(str), None], pa.string()), pa.array(np.append(np.bincount(own, minlength=len(digests)), len(counts)), pa.int64())], names=["w", "k"])


def crowded_blocks(packed: DataFrame) -> bool:
    """The same as ``blocks.crowded``, of blocks of files."""
    k = packed.select("digests", "codes", "sizes", "units", "counts").mapInArrow(_counted, "w string, k bigint").groupBy("w").agg(F.sum("k").cast("double").alias("k"))
    r = k.agg(F.sum(F.when(F.col("w").isNotNull(), F.col("k") * (F.col("k") - 1) / 2)).alias("met"), F.max(F.when(F.col("w").isNull(), F.col("k"))).alias("n")).first()
    return (r.met or 0) >= 4 * (r.n or 0) * ((r.n or 0) - 1) / 2 > 0


def block_evidence(packed: DataFrame, n: int, kind: str, limit: float, low: float, weights: tuple[float, float], hexed: bool, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` (see ``block_matches``) of all pairs of files in ``n`` blocks whose score reaches ``limit``, ``low`` being the window Jaccard
    that they need at least. Pairs are scored where their rows are made; besides the blocks, which are no larger than the files, nothing is
    written or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _cell(batch.slice(i, 1).to_pylist()[0], limit, low, weights, hexed, list(columns))

    spans = ArrayType(StructType([*[StructField(c, LongType()) for c in _PLACES], StructField("snippet", StringType() if hexed else BinaryType())]))
    kinds = {c: LongType() for c in COLUMNS} | {c: StringType() for c in ("hash", "hash8")} | {c: spans for c in ("spans_a", "spans_b")}
    met = meeting(packed, n, packed, n, [*blocks._PARTS, *_FILES]).where("block_l <= block_r")
    out = met.mapInArrow(run, StructType([StructField(c, kinds[c]) for c in columns]))
    return out.withColumns({c: F.col(c).cast(kind) for c in "ab" if c in columns and kind != "bigint"})
