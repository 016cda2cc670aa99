"""Files, archives, policies, dictionaries and run states in; reports and states out."""

from __future__ import annotations

import io
import json
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_BYTES = 10_000, 1 << 30


def read_tree(spark: SparkSession, root: str, glob: str | None = None, prefix: str = "") -> DataFrame:
    """``path`` relative to ``root``, ``length``, ``modified`` and ``content`` of every file under it whose path begins with ``prefix``.

    As in an object store a prefix is a beginning of the path, not a folder: ``run1`` also begins ``run12/a``. ``root`` may be on
    any file system the session knows.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    base = "^(?:file:/*)?/?" + re.escape(re.sub(r"^file:/*", "", root).strip("/")) + "/"
    tree = r.load(root).select(F.regexp_replace("path", base, "").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    return tree.where(F.col("path").startswith(prefix)) if prefix else tree


def submission_sources(tree: DataFrame, folders: DataFrame) -> DataFrame:
    """``submission_id, path, name, content``: the C files of each submission of ``leaf_folders``, from the files of a tree.

    A submission's id is the name of its folder, numbered apart if several have it; files of other folders are left out.
    """
    from marklight.operators.files import numbered_ids

    ids = folders.select("folder", F.explode("c_files").alias("name")).withColumn("base", F.element_at(F.split("folder", "/"), -1))
    own = numbered_ids(ids.select("folder", "base").distinct(), "base", ["folder"]).select("folder", F.col("unique_id").alias("submission_id"))
    path = F.when(F.col("folder") == ".", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    wanted = ids.join(own, "folder").select("submission_id", "name", path.alias("path"))
    return tree.select("path", "content").join(wanted, "path").select("submission_id", "path", "name", "content")


def safe_name(name: str) -> str | None:
    """An entry's path inside its archive, null if it would leave the target folder."""
    n = posixpath.normpath(name.replace("\\", "/"))
    return None if n.startswith(("/", "..")) or n == "." or re.match(r"[A-Za-z]:", n) else n


def entries(name: str, content: bytes, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> list[tuple[str, bytes]]:
    """Regular files of a zip, tar or gzipped tar, by the ending of ``name``.

    Raises ``ValueError`` for an unknown ending, a broken archive, too many entries, a path that leaves the target, or more than
    ``max_bytes`` unpacked in all. Links and devices are left out.
    """
    low, out, left = name.lower(), [], max_bytes

    def take(entry: str, stream) -> None:
        nonlocal left
        safe = safe_name(entry)
        if safe is None:
            raise ValueError(f"entry leaves the target folder: {entry}")
        data = stream.read(left + 1)
        left -= len(data)
        if left < 0:
            raise ValueError("archive is too large unpacked")
        out.append((safe, data))

    try:
        if low.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = z.infolist()
                if len(infos) > max_entries:
                    raise ValueError("archive has too many entries")
                for i in infos:
                    if not i.is_dir():
                        with z.open(i) as f:
                            take(i.filename, f)
        elif low.endswith((".tar", ".tgz", ".tar.gz")):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:" if low.endswith(".tar") else "r:gz") as t:
                for k, m in enumerate(t):
                    if k >= max_entries:
                        raise ValueError("archive has too many entries")
                    if m.isfile():
                        take(m.name, t.extractfile(m))
                    elif m.isdir() and safe_name(m.name) is None and posixpath.normpath(m.name) != ".":
                        raise ValueError(f"entry leaves the target folder: {m.name}")
        else:
            raise ValueError("not an archive")
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
        raise ValueError(f"broken archive: {e}") from e
    return out


def unpack(archives: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``archive, entry, content, error`` for ``archives(path, content)``; an archive that is refused gives one row with its error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = [(path, e, c, None) for e, c in entries(path, content or b"", max_entries, max_bytes)]
                except ValueError as e:
                    got = [(path, None, None, str(e))]
                yield pd.DataFrame(got, columns=["archive", "entry", "content", "error"])

    return archives.select("path", "content").mapInPandas(rows, "archive string, entry string, content binary, error string")


def submission_archives(archives: DataFrame) -> DataFrame:
    """Adds ``submission_id`` to archives by path: the folder, or the stem at the root; repeats in path order get ``-2``, ``-3``."""
    from marklight.functions.scalars import archive_stem, is_archive
    from marklight.operators.files import numbered_ids

    a = archives.where(is_archive(F.col("path")))
    key = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(archive_stem(F.col("path")))
    return numbered_ids(a.withColumn("_key", key), "_key", ["path"]).drop("_key").withColumnRenamed("unique_id", "submission_id")


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def policies(files: DataFrame) -> DataFrame:
    """``path, name, compile_gcc, flags, libraries, source_file, test_cases, scenarios, error`` of YAML policies ``files(path, content)``.

    The compiler is ``gcc`` unless given; unknown keys are ignored; a file that can't be read gives a row with an error.
    """

    def one(path: str, content: bytes) -> tuple:
        try:
            p = _yaml((content or b"").decode("utf-8")) or {}
            c, r = p.get("compile") or {}, p.get("run") or {}
            multi = r.get("multi_process") or {}
            return (path, p.get("name"), c.get("gcc") or "gcc", c.get("flags") or [], p.get("library_files") or c.get("libraries") or [], c.get("source_file"), json.dumps(r.get("test_cases") or []), json.dumps(multi.get("test_scenarios") or []), None)
        except Exception as e:  # noqa: BLE001  any fault of a policy is its own row
            return (path, None, None, None, None, None, None, None, type(e).__name__)

    cols = ["path", "name", "compile_gcc", "flags", "libraries", "source_file", "test_cases", "scenarios", "error"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(pdf["path"], pdf["content"])], columns=cols)

    return files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "content").mapInPandas(rows, "path string, name string, compile_gcc string, flags array<string>, libraries array<string>, source_file string, test_cases string, scenarios string, error string")


def banned_functions(text: str | None) -> list[str]:
    """The distinct names under ``banned``; none for a missing file."""
    return list(dict.fromkeys((_yaml(text) or {}).get("banned") or [])) if text else []


def dictionary_rows(spark: SparkSession, text: str) -> DataFrame:
    """``row, id, title, code`` of a YAML dictionary, a small table of settings."""
    got = [(k, e.get("id"), e.get("title"), e.get("code")) for k, e in enumerate((_yaml(text) or {}).get("entries") or [], 1)]
    return spark.createDataFrame(got, "row bigint, id string, title string, code string")


def with_banned(policies_: DataFrame, text: str | None) -> DataFrame:
    """Policies with ``banned array<string>``, the global list of ``banned_functions``; empty without one."""
    return policies_.withColumn("banned", F.array(*map(F.lit, banned_functions(text))).cast("array<string>"))


def discover_policies(spark: SparkSession, folder: str, banned: str | None = None) -> DataFrame:
    """Policies of the files directly in ``folder`` that end in ``.yaml`` or ``.yml`` (small letters), with the banned list.

    Files that can't be read are left out; a folder that isn't there has none.
    """
    if not _exists(spark, folder):
        empty = spark.createDataFrame([], "path string, content binary")
        return with_banned(policies(empty), banned).drop("error")
    one = read_tree(spark, folder).where(~F.col("path").contains("/") & F.col("path").rlike(r"\.ya?ml$"))
    return with_banned(policies(one).where("error is null"), banned).drop("error")


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def expected_outputs(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """``name, expected`` for the distinct ``names(name)``: the files' texts, null for one that isn't there. Each is read once."""
    wanted = names.where("name is not null and name <> ''").select("name").distinct()
    if not _exists(spark, folder):
        return wanted.withColumn("expected", F.lit(None).cast("string"))
    have = read_tree(spark, folder).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("expected"))
    return wanted.join(have, "name", "left")


def save_run(run: DataFrame, at: str) -> None:
    """Run states by ``run_id``, one folder each: a run saved again replaces its state, other runs stay."""
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(at)


def load_run(spark: SparkSession, at: str, run_id: str, schema: str | None = None) -> DataFrame:
    """One run's state with its ``run_id``; only its folder is read, with ``schema`` (of the other columns) in one pass. Empty if there is none."""
    folder = f"{at.rstrip('/')}/run_id={run_id}"
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id) or not _exists(spark, folder):
        return spark.createDataFrame([], (f"{schema}, " if schema else "") + "run_id string")
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(folder).withColumn("run_id", F.lit(run_id))


def export_entries(files: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """``entry, content`` of an export of ``files(path, content)``: the first folder of each path cleaned of its upload suffix,
    logs of the memory checker left out, and a copy of every file of ``tests(name, content)``, a small table, in every first folder."""
    from marklight.functions.scalars import clean_folder, skips_export

    f = files.where("path is not null").select("path", "content")
    parts = F.split("path", "/")
    if tests is not None:
        all_ = tests.agg(F.collect_list(F.struct("name", "content")).alias("t")).select("t").scalar()
        first = f.where(F.instr("path", "/") > 0).select(F.get(parts, 0).alias("folder")).distinct()
        copies = first.select("folder", F.explode(all_).alias("t")).select(F.concat_ws("/", "folder", "t.name").alias("path"), "t.content")
        # a test file takes the place of one of the same name
        f = f.join(copies.select("path"), "path", "left_anti").unionByName(copies)
    name = F.element_at(F.split("path", "/"), -1)
    entry = F.when(F.instr("path", "/") > 0, F.concat_ws("/", clean_folder(F.get(parts, 0)), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"))).otherwise(clean_folder(F.col("path")))
    return f.where(~skips_export(name)).select(entry.alias("entry"), "content")


def export_archives(entries_: DataFrame) -> DataFrame:
    """``folder, archive binary``: a zip of each first folder of ``export_entries``, deflated, entries in order. Folders are packed apart, each within one
    task, so that an export of any size is written by all; their entries don't clash and the archives concatenate to the whole."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, content in sorted(zip(pdf["entry"], pdf["content"]), key=lambda x: x[0]):
                z.writestr(zipfile.ZipInfo(entry), content or b"", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"folder": [pdf["folder"].iloc[0]], "archive": [b.getvalue()]})

    folder = F.when(F.instr("entry", "/") > 0, F.get(F.split("entry", "/"), 0)).otherwise("")
    return entries_.withColumn("folder", folder).groupBy("folder").applyInPandas(pack, "folder string, archive binary")


def expired(files: DataFrame, days: int = 7) -> DataFrame:
    """Files of ``read_tree`` older than ``days``."""
    return files.where(F.col("modified") < F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def write_report(df: DataFrame, at: str) -> None:
    """JSON lines; null fields are dropped."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(at)
