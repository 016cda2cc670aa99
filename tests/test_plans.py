"""Queries over small tables made for one case each."""

import datetime as dt

from marklight.plans import runs, similarity, streams

HEAD = "int total(int *v, int n) { int s = 0; for (int i = 0; i < n; i++) { s += v[i]; if (s > 100) { s = s / 2; } }"
TAIL = " while (s % 3 != 0) { s++; } return s; }\n"
OTHER = " if (n == 0) { return 0; } do { s -= 7; } while (s > 50 && n != 4);"


def sources(spark, tmp_path, contents):
    rows = [(i, "s", "main.c", None if c is None else bytearray(c.encode()), None) for i, c in enumerate(contents)]
    spark.createDataFrame(rows, "file_id bigint, submission_id string, name string, content binary, received_at timestamp").write.parquet(f"{tmp_path}/source_files.parquet")
    return str(tmp_path)


def test_c_pairs_between_070_and_095(spark, tmp_path):
    whole = HEAD + " if (n > 9) { s = s * n - 1; }" + TAIL
    d = sources(spark, tmp_path, [whole, whole.replace("s * n - 1", "s + 4"), HEAD + OTHER, None])
    got = {(r.a, r.b): r.similarity_percent for r in similarity.c_similar(spark, d).collect()}
    assert got.keys() == {(0, 1)} and 70 <= got[0, 1] < 95
    e = similarity.c_evidence(spark, d).collect()
    assert e and {(r.a, r.b) for r in e} == {(0, 1)}


def test_c_classes_hold_renamed_copies(spark, tmp_path):
    whole = HEAD + TAIL
    d = sources(spark, tmp_path, [whole, whole.replace("total", "sum_up").replace("v", "values"), HEAD + OTHER + TAIL, "int x;", None])
    assert {r.file_id: r.class_id for r in similarity.c_classes(spark, d).collect()} == {0: 0, 1: 0, 2: 2}


def test_snippets_show_the_first_calls(spark, tmp_path):
    late = "/* " + "x" * 400 + " f(0) */ int main(void) { return a.put(get(1,\n 2), \")\") + g(3); }"
    d = sources(spark, tmp_path, [late, "int f() { g(1); }", "int x;", "int f() { h(2; }", "", None])
    got = {r.file_id: None if r.snippet is None else bytes.fromhex(r.snippet).decode() for r in runs.snippets(spark, d).collect()}
    assert got == {0: 'a.put(get(1,  2), ")")', 1: "g(1)", 2: None, 3: "h(2; }", 4: None}


def test_progress_of_open_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2031, 7, 1, 5, m)
    rows = [(1, at(1), "u", "x", 0.2), (2, at(2), "u", "x", 0.6), (3, at(50), "u", "x", 0.7), (4, at(51), "v", "x", 0.1), (5, at(52), "v", "x", None)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id string, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.key, r.since.minute): r.fraction for r in streams.stream_progress(spark, str(tmp_path)).collect()}
    assert got == {("u", 0): 0.6, ("u", 45): 0.7, ("v", 45): 0.1}
