"""Operators that split hot keys, against plain versions."""

import datetime as dt
import io
import random
import zipfile

from pyspark.sql import functions as F

from marklight.operators import files, runs
from marklight.operators.spans import merge_spans
from marklight.sources import readers
from marklight.streaming import state


def test_sessions_across_stretches(spark):
    r = random.Random(2)
    t, times = 0, []
    for _ in range(300):
        t += r.choice([1, 30, 599, 600, 601, 4000, 9000])
        times.append(t)
    want, last = [], None
    for t in times:
        if last is None or t - last >= 600:
            want.append(0)
        want[-1] += 1
        last = t
    base = dt.datetime(2031, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(seconds=t),) for t in times] + [(None,)], "ts timestamp")
    for stretch in (60, 700, 3600, 10**6):
        assert sorted(x.events for x in state.table_sessions(df, 600, stretch).collect()) == sorted(want)
    assert state.table_sessions(df.limit(0)).count() == 0


def test_spans_by_stripes(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), s, s + r.randint(0, 9)) for s in (r.randint(0, 300) for _ in range(80))] + [("a", None, 3)]
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint")
    assert sorted(map(tuple, merge_spans(df, ["k"]).collect())) == sorted(map(tuple, merge_spans(df, ["k"], stripe=16).collect()))


def test_running_by_stripes(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), r.randint(0, 50), i, r.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    got = {x.i: (x.place, x.total, x.best) for x in runs.running(df, "k", ["t", "i"], F.col("v"), F.floor(F.col("t") / 10)).collect()}
    for k in "ab":
        mine, best = sorted((t, i, v) for key, t, i, v in rows if key == k), 0
        for n, (_, i, v) in enumerate(mine, 1):
            best = max(best, v)
            assert got[i] == (n, len(mine), best)


def test_cases_of_every_submission(spark):
    compiled = spark.createDataFrame([("a", True, False), ("b", False, None), ("c", True, True), (None, True, False)], "submission_id string, ok boolean, timed_out boolean")
    cases = spark.createDataFrame([(0,), (1,), (1,), (None,)], "case_index bigint")
    v = spark.createDataFrame([("a", 0, "crashed", "aborted", "fail", None), ("b", 1, "pass", "", "pass", None)], "submission_id string, case_index bigint, status string, crash_reason string, output_match string, log string").withColumn("memory", runs.memory_log(F.col("log")))
    got = {(r.submission_id, r.case_index): (r.status, r.message) for r in runs.case_results(compiled, cases, v).collect()}
    failed = ("compile_failed", runs.MESSAGES["compile_failed"])
    assert got == {("a", 0): ("crashed", "Program crashed: aborted"), ("a", 1): ("not_run", ""), ("b", 0): failed, ("b", 1): failed, ("c", 0): failed, ("c", 1): failed}
    s = {r.submission_id: (r.cases, r.compile_failed, r.failed) for r in runs.test_summary(runs.case_results(compiled, cases, v), ["submission_id"]).collect()}
    assert s == {"a": (2, 0, 1), "b": (2, 2, 0), "c": (2, 2, 0)}
    assert runs.case_results(compiled, cases.limit(0), v).count() == 0
    m = spark.range(1).select(runs.memory_missing(F.lit("no report")).alias("m")).first().m
    assert (m.status, m.message, m.fails) == ("missing", "no report", False)


def test_scenarios_by_executables(spark):
    subs = spark.createDataFrame([("a",), (None,)], "submission_id string")
    got = [(r.scenario, r.process, r.args, r.delay_ms) for r in runs.scenario_processes(subs, [{"name": "s", "process_args": {"x": ["1"]}, "process_delays": {"y": 5}}], ["d/x.c", "y.c"]).collect()]
    assert got == [("s", "x", ["1"], 0), ("s", "y", [], 5)] and runs.scenario_processes(subs, [], ["x.c"]).count() == 0


def test_concatenated_sources(spark):
    src = {"b.C": "x\ny\n", "a.h": "", "c.c": "q", "d.txt": "no", "e.c": None}
    df = spark.createDataFrame([("k", p, c) for p, c in src.items()] + [(None, "z.c", "x")], "key string, path string, content string")
    r = files.concatenated(df).collect()
    assert len(r) == 1 and r[0].text == "".join(f"/* ==== {p} ==== */\n{src[p] or ''}\n" for p in ("a.h", "b.C", "c.c", "e.c"))
    lines = r[0].text.split("\n")
    assert [(f.path, lines[f.start_line - 1 : f.end_line]) for f in r[0].files] == [("a.h", [""]), ("b.C", ["x", "y"]), ("c.c", ["q"]), ("e.c", [""])]


def test_libraries(spark):
    wanted = spark.createDataFrame([(n,) for n in ("lib.o", "empty.o", "small.o", "gone.o", "lib.h")], "name string")
    found = spark.createDataFrame([("lib.o", 900), ("empty.o", 0), ("small.o", 49), ("lib.h", 0)], "path string, length bigint")
    got = {r.name: (r.linked, (r.warning or "").split(":")[-2:-1]) for r in files.library_files(wanted, found).collect()}
    assert {k: v[0] for k, v in got.items()} == {"lib.o": True, "empty.o": False, "small.o": True, "gone.o": False, "lib.h": True}
    src = spark.createDataFrame([(1, '#include "lib.h"\nint x;'), (2, '// #include "lib.h"'), (3, " # include <lib.h>"), (4, None), (5, 'int a;\r#include "lib.h"')], "id int, content string")
    libs = spark.createDataFrame([("one", "lib.h"), ("all", None)], "library string, header string")
    use = {(r.id, r.library) for r in files.library_use(src, libs).collect()}
    assert use == {(1, "one"), (3, "one")} | {(i, "all") for i in range(1, 6)}


def test_run_states_replace(spark, tmp_path):
    at = str(tmp_path / "runs")
    for r, n in (("r1", 1), ("r2", 2), ("r1", 3)):
        readers.save_run(spark.createDataFrame([(r, n)], "run_id string, n int"), at)
    assert [tuple(x) for x in readers.load_run(spark, at, "r1", "n int").select("run_id", "n").collect()] == [("r1", 3)]
    assert readers.load_run(spark, at, "r2").count() == 1 and readers.load_run(spark, at, "zz", "n int").count() == 0 and readers.load_run(spark, at, "../r1").count() == 0


def test_policies_and_outputs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.yaml", "name: one"), ("b.yml", "a: ["), ("c.YAML", "name: no"), ("sub/d.yaml", "name: no")):
        (tmp_path / name).write_text(text)
    got = readers.discover_policies(spark, str(tmp_path), "banned: [gets]").collect()
    assert [(r.path, r.name, r.banned) for r in got] == [("a.yaml", "one", ["gets"])]
    assert readers.discover_policies(spark, str(tmp_path / "none")).count() == 0
    names = spark.createDataFrame([("a.yaml",), ("a.yaml",), ("x",), (None,), ("",)], "name string")
    assert {r.name: r.expected for r in readers.expected_outputs(spark, str(tmp_path), names).collect()} == {"a.yaml": "name: one", "x": None}


def test_export(spark):
    rows = [("Ann_12_assignsubmission_file_/bin/main", b"m"), ("Ann_12_assignsubmission_file_/valgrind-1.log", b"l"), ("Bo/in.txt", b"old"), ("top", b"t"), (None, b"x")]
    f = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    tests = spark.createDataFrame([("in.txt", bytearray(b"new"))], "name string, content binary")
    e = readers.export_entries(f, tests)
    assert {(r.entry, bytes(r.content)) for r in e.collect()} == {("Ann/bin/main", b"m"), ("Ann/in.txt", b"new"), ("Bo/in.txt", b"new"), ("top", b"t")}
    z = {r.folder: zipfile.ZipFile(io.BytesIO(bytes(r.archive))) for r in readers.export_archives(e).collect()}
    assert z["Ann"].namelist() == ["Ann/bin/main", "Ann/in.txt"] and z["Bo"].read("Bo/in.txt") == b"new" and z[""].namelist() == ["top"]


def test_prefixes_and_submissions(spark, tmp_path):
    for name in ("run1/s/a.c", "run1/t/s/b.C", "run12/s/c.c", "run1/t/s/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r.path for r in readers.read_tree(spark, str(tmp_path), prefix="run1").collect()} == {"run1/s/a.c", "run1/t/s/b.C", "run12/s/c.c", "run1/t/s/n.txt"}
    tree = readers.read_tree(spark, str(tmp_path), prefix="run1/")
    got = {(r.submission_id, r.path, bytes(r.content).decode()) for r in readers.submission_sources(tree, files.leaf_folders(tree)).collect()}
    assert got == {("s", "run1/s/a.c", "run1/s/a.c"), ("s-2", "run1/t/s/b.C", "run1/t/s/b.C")}


def test_callbacks_of_streams(spark, tmp_path):
    import time

    spark.range(5).write.parquet(f"{tmp_path}/e.parquet")
    seen = []
    listener = state.notify(spark, lambda n: seen.append("start"), lambda n, b, rows: seen.append(rows), lambda n, e: seen.append("end"))
    try:
        assert state.drained(state.read_stream(spark, str(tmp_path), "e"), str(tmp_path / "q")).count() == 5
        for _ in range(100):
            if "end" in seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen[0] == "start" and 5 in seen and seen[-1] == "end"
