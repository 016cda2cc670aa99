import io
import tarfile
import zipfile

import pytest

from marklight.operators import files
from marklight.operators.spans import merge_spans
from marklight.sources import readers
from marklight.streaming import state


def test_leaf_folders(spark):
    paths = ["a/x.c", "a/sub/y.C", "b/main.c", "b/.hid/z.c", "b/.a.c", "c/t.txt", "d/m.c", ".git/q.c", "e/m.c", None]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.folder: r.c_files for r in files.leaf_folders(f, spark.createDataFrame([("e/empty",)], "path string")).collect()}
    assert got == {"a/sub": ["y.C"], "b": [".a.c", "main.c"], "d": ["m.c"]}
    assert files.leaf_folders(spark.createDataFrame([("r.c",)], "path string")).first().folder == "."


def test_manifest(spark):
    src = {"a.c": "x\ny\n", "b.c": "", "c.c": "q", "d.h": None}
    df = spark.createDataFrame([("k", p, c, 5) for p, c in src.items()], "key string, path string, content string, breaks int")
    text, want = "", {}
    for p in sorted(src):
        text += f"/* ==== {p} ==== */\n"
        c = src[p] or ""
        n = c.count("\n") + (not c.endswith("\n"))
        start = text.count("\n") + 1
        want[p] = (start, start + n - 1)
        text += c + "\n"
    assert {r.path: (r.start_line, r.end_line) for r in files.manifest(df).collect()} == want


def test_ids_and_overlay(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    assert sorted(r.unique_id for r in files.numbered_ids(df, "k", ["o"]).collect()) == ["a", "a-2", "b"]
    top = spark.createDataFrame([("a", 9)], "k string, o int")
    assert sorted(tuple(r) for r in files.overlay(df.where("o = 1"), top, "k").collect()) == [("a", 9), ("b", 1)]


def test_line_cols(spark):
    text = "ä\nbc\n\nd"
    t = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    b = text.encode()
    p = spark.createDataFrame([(1, i) for i in range(len(b))], "id int, pos bigint")
    got = {r.pos: (r.line, r.col) for r in files.line_cols(p, files.line_starts(t)).collect()}
    assert got == {i: (b[:i].count(b"\n") + 1, i - (b.rfind(b"\n", 0, i) + 1) + 1) for i in range(len(b))}


def test_merge_spans(spark):
    s = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("a", None, 3), ("b", 1, 1), ("b", 1, 1)], "k string, start bigint, end bigint")
    assert sorted(tuple(r) for r in merge_spans(s, ["k"]).collect()) == [("a", 0, 7), ("a", 9, 10), ("b", 1, 1)]


def test_call_hits(spark):
    src = b'int f(void) {\n\tx = o.gets(1); puts("gets(1)");\n}\n'
    df = spark.createDataFrame([(1, bytearray(src)), (2, None)], "id int, content binary")
    assert [(r.function, r.line, r.col, bytes(r.snippet)) for r in files.call_hits(df).collect()] == [("gets", 2, 6, b'x = o.gets(1); puts("gets(1)");')]


def _zip(items):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in items:
            z.writestr(n, c)
    return b.getvalue()


def test_archives(spark):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name, kind in (("d/a.c", tarfile.REGTYPE), ("l", tarfile.SYMTYPE)):
            i = tarfile.TarInfo(name)
            i.type, i.size = kind, 3 if kind == tarfile.REGTYPE else 0
            t.addfile(i, io.BytesIO(b"abc") if i.size else None)
    assert readers.entries("x.TGZ", b.getvalue()) == [("d/a.c", b"abc")]
    assert readers.entries("x.zip", _zip([("a/./b.c", "q")])) == [("a/b.c", b"q")]
    for name, content, kw in (("x.zip", _zip([("../e", "q")]), {}), ("x.zip", b"no", {}), ("x.gz", b"", {}), ("x.zip", _zip([("a", "12345")]), {"max_bytes": 4}), ("x.zip", _zip([("a", ""), ("b", "")]), {"max_entries": 1})):
        with pytest.raises(ValueError):
            readers.entries(name, content, **kw)
    df = spark.createDataFrame([("s1/x.zip", bytearray(_zip([("m.c", "q")]))), ("s1/y.zip", bytearray(b"bad")), ("top.tar.gz", None), ("n.txt", None)], "path string, content binary")
    assert {r.path: r.submission_id for r in readers.submission_archives(df).collect()} == {"s1/x.zip": "s1", "s1/y.zip": "s1-2", "top.tar.gz": "top"}
    got = readers.unpack(df).collect()
    assert [(r.entry, bytes(r.content)) for r in got if not r.error] == [("m.c", b"q")] and sum(bool(r.error) for r in got) == 3


def test_tree_policies_runs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.yaml").write_text("name: lab\nother: 1\ncompile: {flags: [-Wall]}\nrun: {multi_process: {test_scenarios: [{name: s}]}}\n")
    (tmp_path / "p" / "b.yml").write_text("a: [")
    tree = readers.read_tree(spark, str(tmp_path / "p"))
    got = {r.path: r for r in readers.policies(tree).collect()}
    assert got["a.yaml"].compile_gcc == "gcc" and got["a.yaml"].flags == ["-Wall"] and '"s"' in got["a.yaml"].scenarios and got["b.yml"].error
    assert readers.banned_functions("banned: [gets, gets, f]") == ["gets", "f"] and readers.banned_functions(None) == []
    assert readers.dictionary_rows(spark, "entries: [{id: a, title: t, code: c}]").first().row == 1
    assert readers.expired(tree).count() == 0
    at = str(tmp_path / "runs")
    for r in ("r1", "r2"):
        readers.save_run(spark.createDataFrame([(r, 1)], "run_id string, n int"), at)
    assert readers.load_run(spark, at, "r2").count() == 1 and readers.load_run(spark, at, "zz").count() == 0


def test_rate_limit(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2031, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(seconds=10 * i)) for i in range(10)] + [("b", 99, t0), (None, 1, t0), ("b", 98, None)]
    df = spark.createDataFrame(rows, "key string, id int, ts timestamp")
    got = {(r.key, r.id): r.allowed for r in state.rate_limit(df, 30.0, 2.0).collect()}
    b, want = state.Bucket(30.0, 2.0), {("b", 99): True}
    for k, i, t in rows[:10]:
        want[k, i] = b.allow(t.timestamp())
    assert got == want and not all(want.values())
    df.write.parquet(str(tmp_path / "e.parquet"))
    s = state.drained(state.rate_limit_stream(state.read_stream(spark, str(tmp_path), "e"), 30.0, 2.0), str(tmp_path / "q"))
    assert {(r.key, r.id): r.allowed for r in s.collect()} == want
