import pytest
from pyspark.sql import functions as F

from marklight.functions import scalars as sc
from marklight.operators import runs


def one(spark, col, **kw):
    names = {k: v for k, v in kw.items()}
    df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in names.items()])
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "e,a,want",
    [
        ("a\n", "a", []),
        ("a\r\nb", "a\nb\n", []),
        ("a\n\n", "a\n", [("same", "a", 1), ("same", "", 2)]),  # a trailing blank line fails without any changed line
        ("a\nb", "a\nc\nd", [("same", "a", 1), ("removed", "b", 2), ("added", "c", 2), ("added", "d", 3)]),
        ("", None, []),
        ("x", None, [("removed", "x", 1), ("added", "", 1)]),
        ("a\rb", "a\nb", [("removed", "a\rb", 1), ("added", "a", 1), ("added", "b", 2)]),
    ],
)
def test_diff(spark, e, a, want):
    got = one(spark, runs.output_diff(F.col("e"), F.col("a")), e=e, a=a)
    assert [tuple(x) for x in got] == want


LOG = """==1== definitely lost: 1,234 bytes in 1 blocks
==1== definitely lost: 5 bytes
==1== FILE DESCRIPTORS: 5 open at exit.
==1== Open file descriptor 4: /tmp/own.log
==1== ERROR SUMMARY: 2 errors from 2
==1== ERROR SUMMARY: 9 errors"""


def test_memory_log(spark):
    m = one(spark, runs.memory_log(F.col("l"), F.lit("/tmp/own.log")), l=LOG)
    assert (m.status, m.errors, m.definitely_lost, m.open_fds, m.std_fds, m.extra_fds, m.fails) == ("fail", 2, 5, 4, 3, 1, True)
    m = one(spark, runs.memory_log(F.col("l")), l="FILE DESCRIPTORS: 3 open (3 std) at exit.\nERROR SUMMARY: 0 errors")
    assert (m.status, m.fails, m.extra_fds) == ("pass", False, 0)
    for blank in ("", " \n", "nothing known"):
        m = one(spark, runs.memory_log(F.col("l")), l=blank)
        assert m.status == "fail" and not m.fails and m.message
    m = one(spark, runs.memory_log(F.col("l")), l="still reachable: 8 bytes")
    assert m.fails and m.still_reachable == 8
    assert one(spark, runs.memory_log(F.col("l")), l=None) is None


def test_verdicts(spark):
    rows = [(1, True, False, 0, "pass", None), (2, True, True, 137, "pass", None), (3, True, False, 139, "pass", None), (4, True, False, 0, "fail", None), (5, True, False, 0, "missing", "unknown"), (6, None, None, None, "none", None), (7, True, False, 0, "pass", "possibly lost: 1 bytes"), (8, True, False, 137, "none", None)]
    df = spark.createDataFrame(rows, "id int, ok boolean, timed_out boolean, exit_code int, output_match string, log string").withColumn("memory", runs.memory_log(F.col("log")))
    v = runs.run_verdicts(df)
    got = {r.id: (r.status, r.crash_reason) for r in v.collect()}
    assert got == {1: ("pass", ""), 2: ("timeout", ""), 3: ("crashed", "segmentation fault"), 4: ("fail", ""), 5: ("pass", ""), 6: ("fail", ""), 7: ("fail", ""), 8: ("crashed", "out of memory")}
    s = runs.test_summary(v.withColumn("k", F.lit(1)), ["k"]).first()
    assert (s.cases, s.passed, s.failed, s.missing_expected) == (8, 2, 6, 1)


def test_scalars(spark):
    assert one(spark, sc.clean_folder(F.col("n")), n="Ann Lee_12_assignsubmission_file_") == "Ann Lee"
    assert one(spark, sc.clean_folder(F.col("n")), n="_12_assignsubmission_file") == "_12_assignsubmission_file"
    assert one(spark, sc.unescape_input(F.col("n")), n=r"a\nb\tc\\r") == "a\nb\tc\\\r"
    assert one(spark, sc.process_name(F.col("n")), n="x/y/client.c") == "client"
    assert one(spark, sc.prompt_label(F.col("n")), n="É!!") == "submission"
    assert one(spark, sc.parse_bool(F.col("n")), n=" YES\n") is True and one(spark, sc.parse_bool(F.col("n")), n="maybe") is None
    assert one(spark, sc.archive_stem(F.col("n")), n="a.b.TAR.GZ") == "a.b"
    assert one(spark, sc.trim_space(F.col("n")), n=" \t x  ") == "x"
    assert one(spark, sc.capped(F.col("n"), 3), n="abcdef") == "abc\n... [output truncated]"
    assert one(spark, sc.includes_header(F.col("n"), "lib.h"), n='  # include <lib.h>') and not one(spark, sc.includes_header(F.col("n"), "lib.h"), n='// #include "lib.h"')
    content = ("  é" + "x" * 100 + "\n y").encode()
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    snip = lambda a, b: bytes(df.select(sc.byte_snippet(F.col("c"), F.lit(a), F.lit(b)).alias("s")).first().s)
    assert snip(0, 10) == content[2:10] and snip(0, 999) == content.replace(b"\n", b" ").strip()[:77] + b"..." and snip(50, 20) == b"" and snip(3, 5) == content[3:5]
