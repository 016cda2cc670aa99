"""Outputs, memory logs and roll-ups of compilations and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklight.functions.scalars import crash_reason, trim_space


def output_lines(c: Column) -> Column:
    """Lines of an output, CRLF as LF, without one newline at the end."""
    return F.split(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n")


def output_diff(expected: Column, actual: Column) -> Column:
    """Positional diff as ``array<struct<type, content, line_num>>``, empty if the outputs match.

    A line past the shorter side meets an empty line: if it is empty too it is ``same``. A null output counts as empty.
    """
    e, a = (output_lines(F.coalesce(c, F.lit(""))) for c in (expected, actual))

    def line(i: Column, e: Column, a: Column) -> Column:
        x, y = F.coalesce(F.get(e, i), F.lit("")), F.coalesce(F.get(a, i), F.lit(""))
        one = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"), (i + 1).cast("bigint").alias("line_num"))
        gone = F.when(i < F.size(e), F.array(one("removed", x))).otherwise(F.array().cast("array<struct<type:string,content:string,line_num:bigint>>"))
        new = F.when(i < F.size(a), F.array(one("added", y))).otherwise(F.array().cast("array<struct<type:string,content:string,line_num:bigint>>"))
        return F.when(x == y, F.array(one("same", y))).otherwise(F.concat(gone, new))

    none = F.array().cast("array<struct<type:string,content:string,line_num:bigint>>")
    # both arrays are bound once, else they would be split again for every line
    bound = F.transform(F.array(F.struct(e.alias("e"), a.alias("a"))), lambda s: F.when(s["e"] == s["a"], none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["e"]), F.size(s["a"])) - 1), lambda i: line(i, s["e"], s["a"])))))
    return bound[0]


def output_match(expected: Column, actual: Column, wanted: Column) -> Column:
    """``none`` if nothing is expected, ``missing`` if what is expected isn't there, else ``pass`` or ``fail``."""
    same = output_lines(F.coalesce(expected, F.lit(""))) == output_lines(F.coalesce(actual, F.lit("")))
    return F.when(~wanted, "none").when(expected.isNull(), "missing").when(same, "pass").otherwise("fail")


def _number(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


#: How the memory checker names its kinds of leaks.
LEAKS = {"definitely_lost": "definitely lost", "indirectly_lost": "indirectly lost", "possibly_lost": "possibly lost", "still_reachable": "still reachable"}


def memory_log(log: Column, own_path: Column | None = None) -> Column:
    """A memory checker's log as a struct, null for a null log.

    The first error summary and first descriptor line count, of each kind of leak the last. Three descriptors are standard
    unless the line says otherwise; one is left out if an entry names the log itself (``own_path``). A blank log or one
    without any known line has status ``fail`` with all numbers 0.
    """
    got = lambda p, g=1: F.regexp_extract(log, p, g)
    # fixed values: the lines as the memory checker writes them
    errors = got(r"ERROR SUMMARY:\s+([0-9,]+)\s+errors?")
    leaks = {k: F.regexp_extract_all(log, F.lit(rf"{t}:\s+([0-9,]+)\s+bytes"), F.lit(1)) for k, t in LEAKS.items()}
    fds = r"FILE DESCRIPTORS:\s+([0-9,]+)\s+open(?:\s+\(([0-9,]+)\s+std\))?"
    has_fd = log.rlike(fds)
    std = F.when(has_fd, F.when(got(fds, 2) != "", _number(got(fds, 2))).otherwise(3)).otherwise(0).cast("bigint")
    names = F.regexp_extract_all(log, F.lit(r"(?m)Open file descriptor \d+:\s+(.+?)\s*$"), F.lit(1))
    own = F.coalesce(F.array_contains(names, own_path), F.lit(False)) if own_path is not None else F.lit(False)
    said = _number(got(fds))
    opened = F.when(has_fd, said - F.when(own & (said > 0), 1).otherwise(0)).otherwise(0).cast("bigint")
    extra = F.greatest(opened - std, F.lit(0).cast("bigint"))
    lost = {k: F.coalesce(_number(F.try_element_at(v, F.lit(-1))), F.lit(0).cast("bigint")) for k, v in leaks.items()}
    blank = trim_space(log) == ""
    parsed = (errors != "") | has_fd
    for v in leaks.values():
        parsed = parsed | (F.size(v) > 0)
    bad = (_number(errors) > 0) | (extra > 0)
    for v in lost.values():
        bad = bad | (v > 0)
    message = F.when(blank, "no report").when(~parsed, "report could not be parsed").otherwise("")
    status = F.when(blank | ~parsed | bad, "fail").otherwise("pass")
    return F.when(log.isNotNull(), F.struct(status.alias("status"), message.alias("message"), _number(errors).alias("errors"), *[v.alias(k) for k, v in lost.items()], opened.alias("open_fds"), std.alias("std_fds"), extra.alias("extra_fds"), bad.alias("fails")))


def run_verdicts(runs: DataFrame) -> DataFrame:
    """Adds ``crash_reason, passed, status`` to runs with ``ok, timed_out, exit_code, output_match, memory`` (see ``memory_log``).

    A missing expectation fails nothing, nor does a log without numbers; a leak of any kind does.
    """
    f = lambda c: F.coalesce(c, F.lit(False))
    crash = crash_reason(F.col("exit_code"), F.col("timed_out"))
    passed = f(F.col("ok")) & ~f(F.col("timed_out")) & ~f(F.col("memory.fails")) & (crash == "")
    status = F.when(f(F.col("timed_out")), "timeout").when(crash != "", "crashed").when(~passed | (F.col("output_match") == "fail"), "fail").otherwise("pass")
    return runs.withColumns({"crash_reason": crash, "passed": passed, "status": status})


def test_summary(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key; what is missing counts on its own, whatever the status."""
    s = F.col("status")
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if(s == "pass").alias("passed"), F.count_if(s == "compile_failed").alias("compile_failed"), F.count_if(~s.isin("pass", "compile_failed", "not_run")).alias("failed"), F.count_if(F.col("output_match") == "missing").alias("missing_expected"))


#: What a row of a test says besides its status.
MESSAGES = {
    "compile_failed": "Compilation failed; test was not executed.",
    "missing": "Expected output file was not found.",
    "memory": "Valgrind reported memory or file descriptor issues.",
}


def memory_missing(message: Column) -> Column:
    """What stands for the report of a memory checker that left none: status ``missing`` and all numbers 0."""
    return _no_report("missing", message)


def memory_failure(message: Column) -> Column:
    """What stands for a report that can't be used: status ``fail`` and all numbers 0."""
    return _no_report("fail", message)


def _no_report(status: str, message: Column) -> Column:
    none = F.lit(0).cast("bigint")
    numbers = ["errors", *LEAKS, "open_fds", "std_fds", "extra_fds"]
    return F.struct(F.lit(status).alias("status"), message.alias("message"), *[none.alias(n) for n in numbers], F.lit(False).alias("fails"))


def case_results(compiled: DataFrame, cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``submission_id, case_index, status, message, output_match``: one row for every submission and test case.

    ``compiled(submission_id, ok, timed_out)``, one row a submission; ``cases(case_index)``, the test cases, a small table of settings;
    ``verdicts`` of ``run_verdicts`` with ``submission_id, case_index, memory``, at most one row for each of both. Where compiling failed every
    case is ``compile_failed``, run or not; a case that wasn't run is ``not_run``. Null keys are left out.
    """
    all_ = cases.where("case_index is not null").agg(F.sort_array(F.collect_set("case_index")).alias("cases"))
    each = compiled.where("submission_id is not null").withColumn("failed", F.coalesce("timed_out", F.lit(False)) | ~F.coalesce("ok", F.lit(False)))
    # every case of every submission: the few cases go to the submissions as one value
    each = each.select("submission_id", "failed", F.explode(all_.select("cases").scalar()).alias("case_index"))
    ran = verdicts.select("submission_id", "case_index", F.col("status").alias("ran"), "crash_reason", "output_match", F.coalesce("memory.fails", F.lit(False)).alias("leaks"), F.coalesce(F.col("memory.status") == "missing", F.lit(False)).alias("unreported"), F.col("memory.message").alias("report"))
    j = each.join(ran, ["submission_id", "case_index"], "left")
    status = F.when(F.col("failed"), "compile_failed").otherwise(F.coalesce("ran", F.lit("not_run")))
    message = (
        F.when(F.col("failed"), MESSAGES["compile_failed"])
        .when(F.col("crash_reason") != "", F.concat(F.lit("Program crashed: "), F.col("crash_reason")))
        .when(F.col("output_match") == "missing", MESSAGES["missing"])
        .when(F.col("unreported"), F.col("report"))
        .when(F.col("leaks"), MESSAGES["memory"])
        .otherwise("")
    )
    return j.select("submission_id", "case_index", status.alias("status"), message.alias("message"), F.when(~F.col("failed"), F.col("output_match")).alias("output_match"))


def scenario_processes(submissions: DataFrame, scenarios: list[dict], executables: list[str]) -> DataFrame:
    """``submission_id, scenario, process, args, input, delay_ms``: what each submission has to run.

    Every executable (named by its source's stem) runs once in every scenario, whether the scenario names it or not; ``scenarios`` are
    a policy's settings with ``name``, ``process_args``, ``process_inputs`` and ``process_delays`` by executable.
    """
    rows = []
    for s in scenarios:
        for source in executables:
            name = source.rsplit("/", 1)[-1].removesuffix(".c")
            args = (s.get("process_args") or {}).get(name) or []
            rows.append(F.struct(
                F.lit(s.get("name")).cast("string").alias("scenario"), F.lit(name).alias("process"), F.array(*map(F.lit, args)).cast("array<string>").alias("args"),
                F.lit((s.get("process_inputs") or {}).get(name, "")).alias("input"), F.lit(int((s.get("process_delays") or {}).get(name, 0))).alias("delay_ms"),
            ))
    if not rows:
        return submissions.select("submission_id", F.lit("").alias("scenario"), F.lit("").alias("process"), F.array().cast("array<string>").alias("args"), F.lit("").alias("input"), F.lit(0).alias("delay_ms")).limit(0)
    return submissions.where("submission_id is not null").select("submission_id", F.explode(F.array(*rows)).alias("p")).select("submission_id", "p.*")


def running(rows: DataFrame, key: str, order: list[str], value: Column, stripe: Column) -> DataFrame:
    """Adds ``place``, ``total`` and ``best`` to rows: their number in the ``order`` of their key, how many the key has, and the highest
    ``value`` so far.

    ``stripe`` cuts the order into stretches (it must grow with the first of ``order``), which are numbered apart and put together by their sums:
    a key that holds a large part of all rows is not sorted in one task.
    """
    r = rows.withColumns({"_stripe": stripe, "_value": value})
    sums = r.groupBy(key, "_stripe").agg(F.count(F.lit(1)).alias("n"), F.max("_value").alias("m"))
    w = Window.partitionBy(key).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "_stripe", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"), F.max("m").over(w).alias("_best"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    own = Window.partitionBy(key, "_stripe").orderBy(*order)
    j = r.join(before, [key, "_stripe"])
    best = F.greatest(F.max("_value").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_best"))
    return j.withColumns({"place": F.row_number().over(own) + F.col("_before"), "best": best}).drop("_stripe", "_value", "_before", "_best")


def submission_status(ok: Column, timed_out: Column, hits: Column) -> Column:
    return F.when(F.coalesce(timed_out, F.lit(False)), "timed_out").when(~F.coalesce(ok, F.lit(False)), "failed").when(hits > 0, "banned").otherwise("clean")
