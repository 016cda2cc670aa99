"""Slots read off leaf templates."""

import datetime as dt

from pyspark.sql import functions as F

from marklight.operators import logs
from marklight.operators.logs import log_entries, slots

LINES = """[INFO] [2031/05/28 11:11:43] (packer) packed 3
[warn] [2031/05/28 11:11:44] (linker) dropped 4
at 2031/05/28 11:11:44 nothing INFO begins
2031/05/28 11:11:45 ERROR quota: exceeded
{E} 2031.05.28T11:11:46Z x
ERROR 2031.05.28T11:11:46Z quota: exceeded
(packer) <debug> 11:11:47 - done"""


def test_layouts_without_a_rule(spark):
    df = spark.createDataFrame([("compile", 1, LINES, dt.datetime(2031, 7, 1, 5))], "log_kind string, record_id bigint, text string, started_at timestamp")
    got = {r.line_from: (r.entry_time, r.log_level, r.component, r.message) for r in log_entries(df).collect()}
    assert got == {
        1: ("2031-05-28 11:11:43", "INFO", "packer", "packed 3"),
        2: ("2031-05-28 11:11:44", "WARN", "linker", "dropped 4\nat 2031/05/28 11:11:44 nothing INFO begins"),
        4: ("2031-05-28 11:11:45", "ERROR", "quota", "exceeded\n{E} 2031.05.28T11:11:46Z x"),
        6: ("2031-05-28 11:11:46", "ERROR", "quota", "exceeded"),
        7: ("2031-07-01 11:11:47", "DEBUG", "packer", "done"),
    }


def test_prose_has_no_slots():
    for line in ("error at <CLOCK> in x", "<LEVEL> at <CLOCK> : x", "<LEVEL> : lost <TS>", "x <TS> <LEVEL>", "( see ) <NUM>", ""):
        assert slots(line.split())[0] is None


def test_only_templates_decide(spark, monkeypatch):
    df = spark.createDataFrame([("compile", 1, LINES, dt.datetime(2031, 7, 1, 5))], "log_kind string, record_id bigint, text string, started_at timestamp")
    real = logs.templates
    monkeypatch.setattr(logs, "templates", lambda parts: real(parts).withColumn("template", F.transform("template", lambda t: F.lit("junk"))))
    assert logs.log_entries(df, messages=False).count() == 0


def test_mixed_leaves_are_split(spark):
    lines = ["2031-05-28 11:11:43 ERROR packer: lost x", "2031-05-28 11:11:43 ERROR packer - lost x", "2031-05-28 11:11:43 packer ERROR: lost x", "2031-05-28 11:11:43 linker ERROR: kept y", "see ERROR packer: lost x y"]
    df = spark.createDataFrame([("compile", 1, "\n".join(lines), None)], "log_kind string, record_id bigint, text string, started_at timestamp")
    got = logs.opening_lines(df)
    parts = logs.partition(got.groupBy("shape").agg(F.first("log_kind").alias("kind"), F.first("masked").alias("masked"), F.count(F.lit(1)).alias("weight")))
    found = {" ".join(r.template) for r in logs.templates(parts).collect()}
    # words may vary within a leaf, layouts may not
    assert all(t.count("*") <= 3 for t in found) and "<TS> * <LEVEL> : * *" in found and "<TS> <LEVEL> packer : lost x" in found
    assert {r.line_from: r.component for r in logs.log_entries(df, messages=False).collect()} == {1: "packer", 2: "packer", 3: "packer", 4: "linker"}
