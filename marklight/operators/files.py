"""Folders, file manifests, overlays and banned-call scans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklight.functions import ctok


def leaf_folders(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``folder, c_files`` of every folder with C files and no visible folder inside.

    ``files(path)`` are paths relative to the root. A file listing doesn't show empty folders; give them as
    ``folders(path)`` if they matter. Folders whose own or parents' name begins with a dot are skipped, hidden files are not; C files in
    folders that have folders inside are left out; the root is ``.``; file names come sorted.
    """
    f = files.where("path is not null").select(F.regexp_replace("path", r"^\./", "").alias("path"))
    parts = f.select("path", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    seen = parts.select("folder")
    if folders is not None:
        seen = seen.unionByName(folders.select(F.regexp_replace("path", r"^\./|/$", "").alias("folder")))
    seen = seen.where(~F.col("folder").rlike(r"(^|/)\.[^/]+")).where("folder <> '.'").distinct()
    # every visible folder makes its parent, and all above, no leaf
    steps = F.split("folder", "/")
    above = seen.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(steps, F.lit(1), i), "/")))).alias("folder")).distinct()
    c = parts.where(F.lower("name").endswith(".c") & ~F.col("folder").rlike(r"(^|/)\.[^/]+"))
    return c.join(above, "folder", "left_anti").groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("c_files"))


def manifest(files: DataFrame) -> DataFrame:
    """``key, path, start_line, end_line`` of sources that are joined into one text per key, in path order.

    ``files(key, path, content)``: each source follows a marker line and is closed by a newline. Null contents count as empty.
    """
    breaks = (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).cast("bigint")
    f = files.select("key", "path", F.coalesce("content", F.lit("")).alias("content")).withColumn("breaks", breaks)
    w = Window.partitionBy("key").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("breaks") + 2).over(w), F.lit(0)) + 2
    used = F.col("breaks") + F.when(F.col("content").endswith("\n") & (F.col("content") != ""), 0).otherwise(1)
    return f.withColumns({"start_line": start, "used": used}).select("key", "path", "start_line", (F.col("start_line") + F.col("used") - 1).alias("end_line"))


def concatenated(files: DataFrame) -> DataFrame:
    """``key, text, files array<struct<path, start_line, end_line>>``: the C sources and headers of each key as one text.

    ``files(key, path, content string)``, in path order, each behind a marker line and closed by a newline; only paths that end in ``.c``
    or ``.h`` (any case) count. A key's sources are gathered in one row, as is the point of it; null contents are empty.
    """
    c = files.where(F.lower("path").rlike(r"\.[ch]$") & F.col("key").isNotNull()).select("key", "path", F.coalesce("content", F.lit("")).alias("content"))
    one = c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat(F.lit("/* ==== "), x["path"], F.lit(" ==== */\n"), x["content"], F.lit("\n"))), "")
    breaks = lambda x: F.length(x["content"]) - F.length(F.replace(x["content"], F.lit("\n"), F.lit("")))
    used = lambda x: breaks(x) + F.when(x["content"].endswith("\n"), 0).otherwise(1)
    # a marker and the closing newline besides its own
    starts = F.aggregate("f", F.array(F.lit(2)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + breaks(x) + 2))
    spans = F.transform("f", lambda x, i: F.struct(x["path"].alias("path"), F.get(starts, i).cast("bigint").alias("start_line"), (F.get(starts, i) + used(x) - 1).cast("bigint").alias("end_line")))
    return one.select("key", text.alias("text"), spans.alias("files"))


def included_headers(files: DataFrame) -> DataFrame:
    """``id, header``: what the sources ``files(id, content string)`` include, each once; line comments before it don't count, a block
    comment isn't seen."""
    found = F.regexp_extract_all("content", F.lit(r'(?md)^\s*#\s*include\s*["<]([^">\n]*)[">]'), F.lit(1))
    return files.where("content is not null").select("id", F.explode(F.array_distinct(found)).alias("header"))


def library_files(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``name, length, linked, warning`` of library files ``wanted(name)``, looked up in ``found(path, length)`` by name.

    A file that isn't there is not linked, nor is an empty object file; an object file under 50 bytes is linked with a warning.
    """
    j = wanted.join(found.select(F.col("path").alias("name"), "length"), "name", "left")
    obj = F.col("name").endswith(".o")
    warning = (
        F.when(F.col("length").isNull(), F.concat(F.lit("Warning: Library file not found: "), "name"))
        .when(obj & (F.col("length") == 0), F.concat(F.lit("Warning: Object file is empty: "), "name"))
        .when(obj & (F.col("length") < 50), F.concat(F.lit("Warning: Object file seems corrupted: "), "name"))
    )
    linked = F.col("length").isNotNull() & ~(obj & (F.col("length") == 0))
    return j.select("name", "length", linked.alias("linked"), warning.alias("warning"))


def library_use(sources: DataFrame, libraries: DataFrame) -> DataFrame:
    """``id, library`` for every source that has to be linked with a library: it includes one of the library's headers.

    ``sources(id, content string)``, ``libraries(library, header)``; a library whose only header is null goes with every
    source. An equi-join on the header, so any number of libraries will do.
    """
    heads = libraries.where("header is not null").select("library", "header").distinct()
    always = libraries.groupBy("library").agg(F.max("header").alias("h")).where("h is null").agg(F.collect_list("library").alias("l"))
    by_header = included_headers(sources).join(heads, "header").select("id", "library").distinct()
    return by_header.unionByName(sources.select("id").distinct().select("id", F.explode(always.select("l").scalar()).alias("library")))


def numbered_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``unique_id``: the nth repeat of a key gets ``-n`` from the second on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") > 1, F.concat_ws("-", F.col(key), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of ``top``, and those of ``base`` whose key it doesn't have; swap the two so that the earlier wins."""
    return top.unionByName(base.join(top.select(key), key, "left_anti").select(*top.columns))


def rewrite_paths(args: Column, names: Column, folder: Column) -> Column:
    """Arguments that name a declared file get the folder in front."""
    return F.transform(args, lambda a: F.when(F.array_contains(names, a), F.concat(folder, F.lit("/"), a)).otherwise(a))


#: The default list of banned functions.
BANNED = ["gets", "strcpy", "strcat", "sprintf", "system", "scanf"]


def _calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["id", "function", "line", "col", "snippet"]
    for pdf in batches:
        out = []
        for key, content in zip(pdf["id"], pdf["content"]):
            if not content:
                continue
            starts = [0, *(m.end() for m in re.finditer(b"\n", content))]
            for name, at in ctok.calls(content):
                no = bisect_right(starts, at)
                begin = starts[no - 1]
                end = starts[no] - 1 if no < len(starts) else len(content)
                line = content[begin:end].decode("latin-1").strip(" \t\r\f\v").encode("latin-1")
                out.append((key, name, no, at - begin + 1, line if len(line) <= 80 else line[:77] + b"..."))
        yield pd.DataFrame(out, columns=cols)


def call_hits(files: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """``id, function, line, col, snippet`` of calls of banned functions in ``files(id, content binary)``.

    Lines and columns are 1-based, columns in bytes, of the start of the callee; the snippet is the line, as bytes.
    """
    kind = files.schema["id"].dataType.simpleString()
    c = files.select("id", "content").mapInPandas(_calls, f"id {kind}, function string, line bigint, col bigint, snippet binary")
    return c.where(F.col("function").isin(list(BANNED if banned is None else banned)))


def _call_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(key, *s[1:]) for key, content in zip(pdf["id"], pdf["content"]) for s in ctok.call_spans(content)], columns=["id", "start", "end"])


def call_spans(files: DataFrame) -> DataFrame:
    """``id, start, end``: bytes of every call in ``files(id, content binary)``, from the callee to the closing parenthesis."""
    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "content").mapInPandas(_call_spans, f"id {kind}, start bigint, end bigint")


def line_starts(texts: DataFrame) -> DataFrame:
    """``id, line, start``: 1-based lines of ``texts(id, text)`` with the byte each begins at."""
    t = texts.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("id", (F.col("pos") + 1).cast("bigint").alias("line"), F.coalesce(F.sum(F.octet_length("l") + 1).over(w), F.lit(0)).cast("bigint").alias("start"))


def line_cols(points: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, pos, line, col`` for ``points(id, pos)``: the last line that begins at or before the byte, both from 1."""
    j = points.join(starts, "id").where(F.col("start") <= F.col("pos")).groupBy("id", "pos").agg(F.max(F.struct("start", "line")).alias("m"))
    return j.select("id", "pos", "m.line", (F.col("pos") - F.col("m.start") + 1).alias("col"))
