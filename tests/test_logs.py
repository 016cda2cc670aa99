import datetime as dt

from marklight.operators.logs import log_entries, roles

COMPILE = """2031-05-28 11:11:43,239 WARNING  linkstep - limit 2596 reached
  > 2031-03-08 00:42:22,208 ERROR packer - quoted
Traceback (most recent call last):
KeyProblem: state a -> b (error code 3)
=== client ===
list.C:379:33: fatal error: implicit declaration
collect2: warning: skipping x.o\r
Aug  2 02:33:40 node2 headers[10017]: <err> using cursor[5]
I0706 02:50:04.855392 25875 linkstep.cc:571] state
1935411394|D|report.sink|cannot count
[22:22:33.167] (quota) notice: pack
level=warn ts=2031-04-20T18:11:05-05:00 msg="using module=gauge [4]" comp=gradebox.copy
{"logger":"quota","message":"time: 5","severity":"critical","time":1937342315598}
2031-07-29T00:09:26.893Z [trace] gradebox.copy: unlock"""
RUN = "==77== HEAP SUMMARY:\n==77==     in use\n==77== \n--77-- WARNING: ioctl\n==77==  Address 0x1"


def test_layouts(spark):
    t = dt.datetime(2031, 7, 1, 5)
    rows = [("compile", 1, COMPILE, t), ("run", 2, RUN, t), ("compile", 3, None, t), ("compile", 4, "", None), ("compile", 5, "Aug  2 02:33:40 n p[1]: <err> x", None)]
    df = spark.createDataFrame(rows, "log_kind string, record_id bigint, text string, started_at timestamp").selectExpr("*", "1 as masked", "2 as line")
    got = {(r.record_id, r.line_from): (r.entry_time, r.log_level, r.component) for r in log_entries(df).collect()}
    assert got == {
        (1, 1): ("2031-05-28 11:11:43", "WARN", "linkstep"),
        (1, 6): ("", "FATAL", "list.C"),
        (1, 7): ("", "WARN", "collect2"),
        (1, 8): ("2031-08-02 02:33:40", "ERROR", "headers"),
        (1, 9): ("2031-07-06 02:50:04", "INFO", "linkstep.cc"),
        (1, 10): ("2031-05-01 14:16:34", "DEBUG", "report.sink"),
        (1, 11): ("2031-07-01 22:22:33", "INFO", "quota"),
        (1, 12): ("2031-04-20 23:11:05", "WARN", "gradebox.copy"),
        (1, 13): ("2031-05-23 22:38:35", "FATAL", "quota"),
        (1, 14): ("2031-07-29 00:09:26", "DEBUG", "gradebox.copy"),
        (2, 1): ("", "", "77"),
        (2, 4): ("", "WARN", "77"),
        (5, 1): ("", "ERROR", "p"),
    }


def test_empty_table(spark):
    assert log_entries(spark.createDataFrame([], "log_kind string, record_id bigint, text string, started_at timestamp")).count() == 0


def test_prose_opens_nothing():
    for line in (["score", "mutex", "and", "then"], ["ValueProblem", ":", "x", "<LEVEL>"], ["["], [], ["<NUM>"]):
        assert roles(line)[0] is None


def test_messages_hold_all_lines(spark):
    text = "above\n2031-05-28 11:11:43 ERROR packer: lost\n  at one\nTrace:\n\n    two  \n=== client ===\nmain.c:3:5: error: main.c: bad\n   3 | x\n\n"
    log = "==77== HEAP SUMMARY:\n==77==     in use\n==77== \n--77-- WARNING: ioctl\n==77==  Address 0x1"
    rows = [("compile", 1, text, None), ("compile", 1, text, None), ("run", 2, log, None), ("run", None, log, None)]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame(rows, "log_kind string, record_id bigint, text string, started_at timestamp")
            got = {(r.record_id, r.line_from): (r.entry_time, r.message) for r in log_entries(df).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {
            (1, 2): ("2031-05-28 11:11:43", "lost\n  at one\nTrace:\n\n    two"),
            (1, 8): ("", "main.c: bad\n   3 | x"),
            (2, 1): ("", "HEAP SUMMARY:\n    in use"),
            (2, 4): ("", "ioctl\n Address 0x1"),
        }
    assert log_entries(df).count() == 4 and log_entries(df, messages=False).count() == 4
