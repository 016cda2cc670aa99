"""Queries over submissions, scans, compilations, runs and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marklight.functions import scalars as sc
from marklight.operators import files, runs
from marklight.operators.detection import bounded
from marklight.operators.spans import merge_spans
from marklight.session import cut, latest, table


def _latest(spark, d, name, key, cols):
    # only what is asked for is read, shuffled and kept
    return latest(table(spark, d, name).select(key, *[c for c in cols if c != key], "received_at"), key).drop("received_at")


def _source(spark, d, *cols):
    return _latest(spark, d, "source_files", "file_id", cols)


def _runs(spark, d, *cols):
    return _latest(spark, d, "execute_results", "result_id", cols)


def _compiles(spark, d, *cols):
    return _latest(spark, d, "compile_results", "compile_id", cols)


def _hits(spark, d, *cols):
    return _latest(spark, d, "scan_hits", "hit_id", cols)


def _submissions(spark, d, *cols):
    return _latest(spark, d, "submissions", "submission_id", cols)


def call_scan(spark, d):
    """Calls of banned functions in all C files, with line, column and snippet."""
    return files.call_hits(_source(spark, d, "content").select(F.col("file_id").alias("id"), "content"), files.BANNED + ["fork", "execl", "malloc", "atoi"]).withColumnRenamed("id", "file_id").withColumn("snippet", F.hex("snippet"))


def token_scan(spark, d):
    """Words of documents that are on a list, per line."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = t.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word")).where(F.col("word").isin(files.BANNED + ["malloc", "printf"]))
    return w.groupBy("doc_id", "line_no", "word").agg(F.count(F.lit(1)).alias("hits"))


def scan_hits_by_fn(spark, d):
    return _hits(spark, d, "function_name", "submission_id").where("function_name is not null").groupBy(sc.trim_space(F.col("function_name")).alias("function_name")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("submission_id").alias("submissions"))


def scan_summary(spark, d):
    h = _hits(spark, d, "submission_id", "file")
    return h.agg(F.count(F.lit(1)).alias("total_hits"), F.count_distinct("submission_id").alias("submissions"), F.count_distinct("file").alias("files"))


def span_merge(spark, d):
    """Merged spans per submission over all its pairs."""
    p = _latest(spark, d, "similarity_pairs", "pair_id", ["a", "spans_a"]).where("a is not null")
    s = p.select("a", F.explode("spans_a").alias("s")).select("a", F.col("s.start_byte").alias("start"), F.col("s.end_byte").alias("end"))
    return merge_spans(s, ["a"], stripe=4096).select("a", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def line_starts(spark, d):
    s = files.line_starts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.sum("start").alias("sum_starts")).withColumnRenamed("id", "doc_id")


def line_cols(spark, d):
    """Line and byte column of the middle byte of every document."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    p = t.select("id", F.floor(F.octet_length("text") / 2).alias("pos"))
    return files.line_cols(p, files.line_starts(t)).withColumnRenamed("id", "doc_id")


def snippets(spark, d):
    """The first merged span of each file's calls as a snippet, in hex digits; null for a file without calls."""
    f = cut(_source(spark, d, "content").where("content is not null").select("file_id", "content"))
    spans = merge_spans(files.call_spans(f.select(F.col("file_id").alias("id"), "content")), ["id"])
    first = spans.groupBy(F.col("id").alias("file_id")).agg(F.min(F.struct("start", "end")).alias("s"))
    a, b = (F.col(f"s.{x}").cast("int") for x in ("start", "end"))
    return f.join(first, "file_id", "left").select("file_id", F.when(F.col("s").isNotNull(), F.hex(sc.byte_snippet(F.col("content"), a, b))).alias("snippet"))


def _expected(spark, d):
    # one row a case: the output of the case's first run stands for what is expected
    return _runs(spark, d, "case_index", "stdout").where("case_index is not null").groupBy("case_index").agg(F.min_by("stdout", "result_id").alias("expected"))


def output_verdict(spark, d):
    e = bounded(_expected(spark, d))
    j = _runs(spark, d, "case_index", "stdout").join(e, "case_index", "left")
    return j.select("result_id", runs.output_match(F.col("expected"), F.col("stdout"), F.col("case_index").isNotNull()).alias("output_match"))


def output_diff(spark, d):
    e = bounded(_expected(spark, d))
    j = _runs(spark, d, "case_index", "stdout").join(e, "case_index").withColumn("diff", runs.output_diff(F.col("expected"), F.col("stdout")))
    n = lambda k: F.size(F.filter("diff", lambda x: x["type"] == k)).cast("bigint").alias(k)
    return j.select("result_id", n("same"), n("removed"), n("added"))


def memlog_parse(spark, d):
    m = _runs(spark, d, "memlog").where("memlog is not null").select("result_id", runs.memory_log(F.col("memlog"), F.lit("/tmp/queue_key.log")).alias("m"))
    return m.select("result_id", "m.*")


def memlog_status(spark, d):
    return memlog_parse(spark, d).groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"), F.sum("extra_fds").alias("extra_fds"), F.sum("definitely_lost").alias("definitely_lost"))


def _verdicts(spark, d):
    e = bounded(_expected(spark, d))
    r = _runs(spark, d, "submission_id", "case_index", "ok", "exit_code", "timed_out", "stdout", "memlog").join(e, "case_index", "left")
    r = r.withColumns({"output_match": runs.output_match(F.col("expected"), F.col("stdout"), F.col("case_index").isNotNull()), "memory": runs.memory_log(F.col("memlog"))})
    return runs.run_verdicts(r)


def run_status(spark, d):
    return _verdicts(spark, d).groupBy("status", "crash_reason").agg(F.count(F.lit(1)).alias("n"))


def test_summary(spark, d):
    return runs.test_summary(_verdicts(spark, d).withColumn("submission_id", F.coalesce("submission_id", F.lit("?"))), ["submission_id"])


def status_rollup(spark, d):
    """Status of every submission by its latest compilation and its hits."""
    c = _compiles(spark, d, "submission_id", "ok", "timed_out").where("submission_id is not null").groupBy("submission_id").agg(F.max_by(F.struct("ok", "timed_out"), "compile_id").alias("c"))
    h = _hits(spark, d, "submission_id").where("submission_id is not null").groupBy("submission_id").agg(F.count(F.lit(1)).alias("hits"))
    j = c.join(h, "submission_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("submission_id", "hits", runs.submission_status(F.col("c.ok"), F.col("c.timed_out"), F.col("hits")).alias("status"))


def run_summary(spark, d):
    s = F.col("status")
    return status_rollup(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "timed_out").alias("timed_out"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "clean").alias("clean"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.sum("hits").alias("hits"))


def discover_leaf(spark, d):
    """Leaf folders with C files of the intake, from the files that submissions list."""
    s = _submissions(spark, d, "path", "c_files").where("path is not null and c_files is not null")
    f = s.select("path", F.explode("c_files").alias("f")).select(F.concat_ws("/", F.regexp_replace("path", "^/", ""), "f").alias("path"))
    return files.leaf_folders(f).select("folder", F.array_join("c_files", ",").alias("c_files"))


def clean_names(spark, d):
    """Student names out of folder names, with a prompt label."""
    s = _submissions(spark, d, "path").where("path is not null")
    name = F.regexp_extract("path", "/([^/]+_assignsubmission_file[^/]*)", 1)
    s = s.select("submission_id", F.when(name != "", name).otherwise(F.element_at(F.split("path", "/"), -1)).alias("name"))
    c = sc.clean_folder(F.col("name"))
    return s.select("submission_id", c.alias("student"), sc.prompt_label(c).alias("label"))


def token_valid(spark, d):
    s = _submissions(spark, d, "assignment")
    return s.select("submission_id", sc.valid_token(F.col("assignment")).alias("token_ok"), sc.normal_run_id(F.col("submission_id")).isNotNull().alias("run_ok"))


def source_manifest(spark, d):
    f = _source(spark, d, "submission_id", "name", "content").where("submission_id is not null and name is not null").select(F.col("submission_id").alias("key"), F.concat_ws("/", "name", F.col("file_id").cast("string")).alias("path"), F.decode("content", "ISO-8859-1").alias("content"))
    return files.manifest(f).withColumnRenamed("key", "submission_id")


def dup_ids(spark, d):
    """Files numbered apart where a submission has a name twice."""
    f = _source(spark, d, "submission_id", "name").where("name is not null and submission_id is not null").select("file_id", F.concat_ws("/", "submission_id", "name").alias("key"))
    return files.numbered_ids(f, "key", ["file_id"]).select("file_id", "unique_id")


def contact_overlay(spark, d):
    """A contact for every nation: its customer of the highest balance, overlaid by its supplier of the highest balance where it has one."""
    best = lambda t, x: table(spark, d, t).where(f"{x}_nationkey is not null").groupBy(F.col(f"{x}_nationkey").alias("nation")).agg(F.max_by(f"{x}_name", F.struct(f"{x}_acctbal", f"{x}_name")).alias("contact"))
    return files.overlay(best("customer", "c"), best("supplier", "s"), "nation")


def gcc_args(spark, d):
    """Compiler commands taken apart and put together again: flags, sources, libraries."""
    c = _compiles(spark, d, "command").where("command is not null")
    has = lambda p: F.filter("command", lambda x: x.rlike(p))
    a = sc.gcc_args(F.filter("command", lambda x: x.startswith("-") & ~x.startswith("-l") & (x != "-o")), has(r"\.[cC]$"), F.filter("command", lambda x: x.rlike(r"\.o$") | x.startswith("-l")), F.lit("main"))
    return c.select("compile_id", F.array_join(a, " ").alias("args"))


def arg_paths(spark, d):
    c = _compiles(spark, d, "command").where("command is not null")
    return c.select("compile_id", F.array_join(files.rewrite_paths(F.col("command"), F.array(F.lit("main.c"), F.lit("lib.c")), F.lit("/cfg")), " ").alias("args"))


def header_use(spark, d):
    """Sources that include a header, for every header there is."""
    s = _source(spark, d, "content").select(F.col("file_id").alias("id"), F.decode("content", "ISO-8859-1").alias("content"))
    return files.included_headers(s).groupBy("header").agg(F.count(F.lit(1)).alias("files"))


def library_use(spark, d):
    """Sources to be linked with a library, for each object file that compilations name and the header of its name; those that
    include no such header are linked with none."""
    c = _compiles(spark, d, "command").where("command is not null")
    lib = F.regexp_replace(F.element_at(F.split("l", "/"), -1), r"\.o$", "")
    libs = c.select(F.explode(F.filter("command", lambda x: x.endswith(".o"))).alias("l")).select(lib.alias("library")).distinct()
    s = _source(spark, d, "content").select(F.col("file_id").alias("id"), F.decode("content", "ISO-8859-1").alias("content"))
    return files.library_use(s, libs.withColumn("header", F.concat("library", F.lit(".h")))).groupBy("library").agg(F.count(F.lit(1)).alias("files"))


def concatenated(spark, d):
    """The C sources of each submission as one text: its length, its hash and how many files it has."""
    f = _source(spark, d, "submission_id", "name", "content").where("submission_id is not null and name is not null")
    c = files.concatenated(f.select(F.col("submission_id").alias("key"), F.concat_ws("/", F.col("file_id").cast("string"), "name").alias("path"), F.decode("content", "ISO-8859-1").alias("content")))
    ends = F.element_at("files", -1)
    return c.select(F.col("key").alias("submission_id"), F.length("text").cast("bigint").alias("characters"), F.size("files").cast("bigint").alias("files"), ends["start_line"].alias("last_start"), ends["end_line"].alias("last_end"))


#: The last run of a case stands for it.
def case_results(spark, d):
    """Every compiled submission with every test case: failed compilations, runs and cases not run."""
    c = _compiles(spark, d, "submission_id", "ok", "timed_out").where("submission_id is not null").groupBy("submission_id").agg(F.max_by(F.struct("ok", "timed_out"), "compile_id").alias("c"))
    v = _verdicts(spark, d).where("submission_id is not null and case_index is not null").groupBy("submission_id", "case_index").agg(F.max_by(F.struct("status", "crash_reason", "output_match", "memory"), "result_id").alias("v"))
    cases = table(spark, d, "execute_results").select("case_index")
    return runs.case_results(c.select("submission_id", "c.ok", "c.timed_out"), cases, v.select("submission_id", "case_index", "v.*"))


def grade_summary(spark, d):
    """Counts of ``case_results`` by submission, failed compilations and cases not run included."""
    r = case_results(spark, d)
    n = F.count_if(F.col("status") == "not_run").alias("not_run")
    return runs.test_summary(r, ["submission_id"]).join(r.groupBy("submission_id").agg(n), "submission_id")


def scenario_plan(spark, d):
    """What every submission has to run in two scenarios of three processes."""
    scenarios = [
        {"name": "small", "process_args": {"server": ["8080"], "client": ["-n", "1"]}, "process_inputs": {"client": "ping\n"}, "process_delays": {"client": 200}},
        {"name": "idle", "process_args": {"server": ["8081", "-v"]}},
    ]
    p = runs.scenario_processes(_submissions(spark, d).select("submission_id"), scenarios, ["server.c", "client.c", "tools/log.c"])
    return p.withColumn("args", F.array_join("args", " "))


def scenario_matrix(spark, d):
    """Runner by submission: the processes a scenario expects, from a map looked up by key."""
    p = _runs(spark, d, "submission_id", "runner", "ok", "timed_out").where("submission_id is not null and runner is not null")
    m = p.groupBy("submission_id", "runner").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ok", F.lit(False)) & ~F.coalesce("timed_out", F.lit(False))).alias("passed"))
    m = m.groupBy("submission_id").agg(F.map_from_entries(F.collect_list(F.struct("runner", F.struct("n", "passed")))).alias("m"))
    at = lambda r: F.try_element_at("m", F.lit(r))
    return m.select("submission_id", F.size("m").cast("bigint").alias("processes"), F.coalesce(at("r-atlas")["n"], F.lit(0)).alias("atlas_runs"), F.coalesce(at("r-birch")["passed"], F.lit(False)).alias("birch_passed"), F.forall(F.map_values("m"), lambda x: x["passed"]).alias("all_passed"))


def progress_monotone(spark, d):
    """Running share of a submission's runs, in order, that never falls."""
    r = _runs(spark, d, "submission_id", "executed_at", "case_index").where("submission_id is not null and executed_at is not null")
    # one submission may hold a tenth of all runs: a day of it at a time
    p = runs.running(r, "submission_id", ["executed_at", "result_id"], F.coalesce("case_index", F.lit(0).cast("bigint")), F.floor(F.unix_seconds("executed_at") / 86400))
    return p.select("result_id", F.col("best").alias("best_case"), (F.lit(0.1) + 0.9 * (F.col("place") / F.col("total"))).alias("fraction"))


def session_idle(spark, d):
    """Sessions per user: a gap of more than six hours begins a new one."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) <= 6 * 3600 * 1000000, 0).otherwise(1)
    s = e.select("user_id", "event_id", "ts", new.alias("n")).withColumn("s", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("events"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us")).select("user_id", F.col("s").cast("bigint").alias("session"), "events", "span_us")


def retention(spark, d):
    """Runs older than seven days before the latest one."""
    newest = table(spark, d, "execute_results").agg(F.max("executed_at").alias("m")).scalar()
    return _runs(spark, d, "runner", "executed_at").where(F.col("executed_at") < newest - F.expr("interval 7 days")).groupBy("runner").agg(F.count(F.lit(1)).alias("old"))


def top_hits(spark, d):
    """The twenty functions hit most: a top-k report."""
    return scan_hits_by_fn(spark, d).orderBy(F.desc("hits"), "function_name").limit(20)


def report_json(spark, d):
    """The status roll-up as JSON; zero counts are dropped as the sink's empty values."""
    return status_rollup(spark, d).select("submission_id", F.to_json(F.struct("status", F.nullif("hits", F.lit(0)).alias("hits"))).alias("json"))


_L = {t: f"(select * from (select *, row_number() over (partition by {k} order by received_at desc) as rn_ from {t} where {k} is not null) where rn_ = 1)" for t, k in (("source_files", "file_id"), ("execute_results", "result_id"), ("compile_results", "compile_id"), ("scan_hits", "hit_id"), ("submissions", "submission_id"), ("similarity_pairs", "pair_id"))}
_EXP = f"x as (select * from {_L['execute_results']}), e as (select case_index, arg_min(coalesce(stdout, chr(0)), result_id) as ex from x where case_index is not null group by case_index), "
_NORM = "string_split(regexp_replace(replace(coalesce({}, ''), chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10))"
_J = _EXP + f"j as (select x.*, nullif(ex, chr(0)) as expected, {_NORM.format('nullif(ex, chr(0))')} as el, {_NORM.format('stdout')} as al from x left join e using (case_index)), "
_NUM = "coalesce(try_cast(replace({}, ',', '') as bigint), 0)"
_MEM = ", ".join(
    [f"{_NUM.format(chr(39).join(['regexp_extract(memlog, ', 'ERROR SUMMARY:\\s+([0-9,]+)\\s+errors?', ', 1)']))} as errors"]
    + [f"{_NUM.format(f'list_extract(regexp_extract_all(memlog, {chr(39)}{t}:\\s+([0-9,]+)\\s+bytes{chr(39)}, 1), -1)')} as {k}" for k, t in runs.LEAKS.items()]
)
_FD = "'FILE DESCRIPTORS:\\s+([0-9,]+)\\s+open(?:\\s+\\(([0-9,]+)\\s+std\\))?'"
_ML = f"""g as (select result_id, memlog, {_MEM}, regexp_matches(memlog, {_FD}) as fd, {_NUM.format(f'regexp_extract(memlog, {_FD}, 1)')} as said, regexp_extract(memlog, {_FD}, 2) as st,
  list_contains(regexp_extract_all(memlog, '(?m)Open file descriptor \\d+:\\s+(.+?)\\s*$', 1), '{{own}}') as own, regexp_matches(memlog, 'ERROR SUMMARY:\\s+([0-9,]+)\\s+errors?|(definitely lost|indirectly lost|possibly lost|still reachable):\\s+([0-9,]+)\\s+bytes') as pa from {_L['execute_results']} where memlog is not null),
o as (select *, case when fd then said - case when own and said > 0 then 1 else 0 end else 0 end as open_fds, case when fd then case when st <> '' then {_NUM.format('st')} else 3 end else 0 end as std_fds from g),
f as (select *, greatest(open_fds - std_fds, 0) as extra_fds, regexp_matches(memlog, '^\\s*$') as blank from o),
m as (select result_id, case when blank then 'no report' when not (pa or fd) then 'report could not be parsed' else '' end as message, errors, definitely_lost, indirectly_lost, possibly_lost, still_reachable, open_fds, std_fds, extra_fds,
  errors > 0 or definitely_lost > 0 or indirectly_lost > 0 or possibly_lost > 0 or still_reachable > 0 or extra_fds > 0 as fails, case when blank or not (pa or fd) or errors > 0 or definitely_lost > 0 or indirectly_lost > 0 or possibly_lost > 0 or still_reachable > 0 or extra_fds > 0 then 'fail' else 'pass' end as status from f) """
_ST = f"""with c as (select submission_id, arg_max(coalesce(ok, false), compile_id) as ok, arg_max(coalesce(timed_out, false), compile_id) as t from {_L['compile_results']} where submission_id is not null group by 1), h as (select submission_id, count(*) as hits from {_L['scan_hits']} where submission_id is not null group by 1),
s as (select submission_id, coalesce(hits, 0) as hits, case when t then 'timed_out' when not ok then 'failed' when coalesce(hits, 0) > 0 then 'banned' else 'clean' end as status from c left join h using (submission_id)) """
_CRASH = "case when exit_code = 137 and not coalesce(timed_out, false) then 'out of memory' when exit_code = 139 then 'segmentation fault' when exit_code = 134 then 'aborted' when exit_code = 136 then 'arithmetic exception' when exit_code = 135 then 'bus error' when exit_code = 132 then 'illegal instruction' else '' end"
_V = f"""with {_J} {_ML.format(own='')}, v0 as (select j.*, {_CRASH} as crash_reason, case when case_index is null then 'none' when expected is null then 'missing' when el = al then 'pass' else 'fail' end as output_match, coalesce(m.fails, false) as bad from j left join m using (result_id)),
v as (select *, case when coalesce(timed_out, false) then 'timeout' when crash_reason <> '' then 'crashed' when not coalesce(ok, false) or bad or output_match = 'fail' then 'fail' else 'pass' end as status from v0) """
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null), b as (select doc_id, line, coalesce(sum(octet_length(encode(s)) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as start from l) "
QUERIES = {f.__name__: f for f in (call_scan, token_scan, scan_hits_by_fn, scan_summary, span_merge, line_starts, line_cols, snippets, output_verdict, output_diff, memlog_parse, memlog_status, run_status, test_summary, status_rollup, run_summary, discover_leaf, clean_names, token_valid, source_manifest, dup_ids, contact_overlay, gcc_args, arg_paths, header_use, library_use, concatenated, case_results, grade_summary, scenario_plan, scenario_matrix, progress_monotone, session_idle, retention, top_hits, report_json)}
# the text form of a binary shows some bytes as \\xNN
_TXT = "regexp_replace(regexp_replace(regexp_replace(content::varchar, '\\\\x0A', chr(10), 'g'), '\\\\x22', chr(34), 'g'), '\\\\x(09|0D|0C)', ' ', 'g')"
_INC = f"f as (select file_id, list_distinct(regexp_extract_all({_TXT}, '(?m)^\\s*#\\s*include\\s*[\"<]([^\">\\n]*)[\">]', 1)) as hs from {_L['source_files']} where content is not null), i as (select file_id, unnest(hs) as header from f) "
_CASES = _V + """, c as (select submission_id, arg_max(coalesce(ok, false) and not coalesce(timed_out, false), compile_id) as fine from """ + _L["compile_results"] + """ where submission_id is not null group by 1), k as (select distinct case_index from execute_results where case_index is not null),
w as (select * from (select *, row_number() over (partition by submission_id, case_index order by result_id desc) as last_ from v where submission_id is not null and case_index is not null) where last_ = 1),
r as (select c.submission_id, k.case_index, case when not fine then 'compile_failed' else coalesce(w.status, 'not_run') end as status,
  case when not fine then 'Compilation failed; test was not executed.' when crash_reason <> '' then 'Program crashed: ' || crash_reason when w.output_match = 'missing' then 'Expected output file was not found.' when bad then 'Valgrind reported memory or file descriptor issues.' else '' end as message,
  case when fine then w.output_match end as output_match from c cross join k left join w on w.submission_id = c.submission_id and w.case_index = k.case_index) """
_WS = "'^[\\s\\x{85}\\x{A0}]+|[\\s\\x{85}\\x{A0}]+$'"
_BYFN = f"select regexp_replace(function_name, {_WS}, '', 'g') as function_name, count(*) as hits, count(distinct submission_id) as submissions from {_L['scan_hits']} where function_name is not null group by 1"
SQL = {
    "token_scan": "with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null), w as (select doc_id, line_no, unnest(regexp_extract_all(s, '[A-Za-z0-9_]+')) as word from l) select doc_id, line_no, word, count(*) as hits from w where word in (" + ", ".join(repr(x) for x in files.BANNED + ["malloc", "printf"]) + ") group by all",
    "scan_hits_by_fn": _BYFN,
    "scan_summary": f"select count(*) as total_hits, count(distinct submission_id) as submissions, count(distinct file) as files from {_L['scan_hits']}",
    "span_merge": f"""with s as (select a, x.s.start_byte as st, x.s.end_byte as en from (select a, unnest(spans_a) as s from {_L['similarity_pairs']} where a is not null) x), o as (select *, case when st > max(en) over (partition by a order by st, en rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from s where st is not null and en is not null), i as (select *, sum(n) over (partition by a order by st, en rows unbounded preceding) as g from o) select a, min(st) as start_byte, max(en) as end_byte from i group by a, g""",
    "line_starts": "with " + _LINES + "select doc_id, count(*) as lines, sum(start)::bigint as sum_starts from b group by doc_id",
    "line_cols": "with " + _LINES + ", p as (select doc_id, octet_length(encode(text)) // 2 as pos from documents where text is not null) select doc_id, pos, max(line) as line, pos - max(start) + 1 as col from p join b using (doc_id) where start <= pos group by doc_id, pos",
    "output_verdict": "with " + _J[:-2] + " select result_id, case when case_index is null then 'none' when expected is null then 'missing' when el = al then 'pass' else 'fail' end as output_match from j",
    "output_diff": "with " + _J + "k as (select result_id, el, al, unnest(range(1, greatest(len(el), len(al)) + 1)) as i from j where case_index is not null and el <> al), c as (select result_id, i <= len(el) as ie, i <= len(al) as ia, coalesce(el[i], '') = coalesce(al[i], '') as eq from k), n as (select result_id, count(*) filter (eq) as same, count(*) filter (not eq and ie) as removed, count(*) filter (not eq and ia) as added from c group by 1) select j.result_id, coalesce(same, 0) as same, coalesce(removed, 0) as removed, coalesce(added, 0) as added from j left join n using (result_id) where case_index is not null",
    "memlog_parse": "with " + _ML.format(own="/tmp/queue_key.log") + "select * from m",
    "memlog_status": "with " + _ML.format(own="/tmp/queue_key.log") + "select status, message, count(*) as n, sum(extra_fds)::bigint as extra_fds, sum(definitely_lost)::bigint as definitely_lost from m group by all",
    "run_status": _V + "select status, crash_reason, count(*) as n from v group by all",
    "test_summary": _V + "select coalesce(submission_id, '?') as submission_id, count(*) as cases, count(*) filter (status = 'pass') as passed, 0 as compile_failed, count(*) filter (status <> 'pass') as failed, count(*) filter (output_match = 'missing') as missing_expected from v group by 1",
    "status_rollup": _ST + "select submission_id, hits, status from s",
    "run_summary": _ST + "select count(*) as total, count(*) filter (status = 'timed_out') as timed_out, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'clean') as clean, count(*) filter (hits > 0) as with_hits, sum(hits)::bigint as hits from s",
    "discover_leaf": f"with s as (select regexp_replace(path, '^/', '') as folder, unnest(c_files) as f from {_L['submissions']} where path is not null and c_files is not null), a as (select distinct folder from s), l as (select folder from a where not exists (select 1 from a b where starts_with(b.folder, a.folder || '/'))) select folder, string_agg(f, ',' order by f) as c_files from s join l using (folder) where lower(f) like '%.c' group by folder",
    "clean_names": f"with s as (select submission_id, coalesce(nullif(regexp_extract(path, '/([^/]+_assignsubmission_file[^/]*)', 1), ''), string_split(path, '/')[-1]) as n from {_L['submissions']} where path is not null), c as (select submission_id, coalesce(nullif(regexp_replace(n, '_\\d+_assignsubmission_file.*$', ''), ''), n) as student from s) select submission_id, student, coalesce(nullif(left(regexp_replace(replace(lower(trim(student)), ' ', '-'), '[^a-z0-9._-]', '', 'g'), 32), ''), 'submission') as label from c",
    "token_valid": f"select submission_id, coalesce(regexp_full_match(assignment, '[A-Za-z0-9-]{{1,64}}'), false) as token_ok, regexp_full_match(trim(submission_id), '[A-Za-z0-9_-]+') as run_ok from {_L['submissions']}",
    "dup_ids": f"with f as (select file_id, submission_id || '/' || name as k, row_number() over (partition by submission_id || '/' || name order by file_id) as n from {_L['source_files']} where name is not null and submission_id is not null) select file_id, case when n > 1 then k || '-' || n else k end as unique_id from f",
    "contact_overlay": "with c as (select c_nationkey as nation, max(struct_pack(b := c_acctbal, n := c_name)).n as contact from customer where c_nationkey is not null group by 1), s as (select s_nationkey as nation, max(struct_pack(b := s_acctbal, n := s_name)).n as contact from supplier where s_nationkey is not null group by 1) select * from s union all select * from c where nation not in (select nation from s)",
    "gcc_args": f"select compile_id, array_to_string(list_concat(list_concat(list_filter(command, lambda x: starts_with(x, '-') and not starts_with(x, '-l') and x <> '-o'), list_filter(command, lambda x: regexp_matches(x, '\\.[cC]$'))), list_concat(list_concat(list_filter(command, lambda x: regexp_matches(x, '\\.o$')), list_filter(command, lambda x: starts_with(x, '-l'))), ['-o', 'main'])), ' ') as args from {_L['compile_results']} where command is not null",
    "arg_paths": f"select compile_id, array_to_string(list_transform(command, lambda x: case when x in ('main.c', 'lib.c') then '/cfg/' || x else x end), ' ') as args from {_L['compile_results']} where command is not null",
    "header_use": "with " + _INC + "select header, count(*) as files from i group by header",
    "library_use": "with " + _INC + f", l as (select distinct regexp_replace(string_split(x, '/')[-1], '\\.o$', '') as library from (select unnest(command) as x from {_L['compile_results']} where command is not null) where ends_with(x, '.o')) select library, count(distinct file_id) as files from l join i on i.header = library || '.h' group by library",
    "source_manifest": f"with s as (select submission_id, name || '/' || file_id as path, coalesce(content, ''::blob) as c from {_L['source_files']} where submission_id is not null and name is not null), b as (select *, len(hex(c)) // 2 as n, (len(hex(c)) - len(regexp_replace(regexp_replace(hex(c), '(..)', '\\1,', 'g'), '0A,', '', 'g')) + len(hex(c)) // 2) // 3 as breaks, right(hex(c), 2) = '0A' as closed from s), m as (select *, (coalesce(sum(breaks + 2) over (partition by submission_id order by path rows between unbounded preceding and 1 preceding), 0) + 2)::bigint as start_line from b) select submission_id, path, start_line, start_line + breaks + case when closed then 0 else 1 end - 1 as end_line from m",
    "concatenated": f"with s as (select submission_id, file_id || '/' || name as path, coalesce(content, ''::blob) as c from {_L['source_files']} where submission_id is not null and name is not null), b as (select *, len(hex(c)) // 2 as n, (len(hex(c)) - len(regexp_replace(regexp_replace(hex(c), '(..)', '\\1,', 'g'), '0A,', '', 'g')) + len(hex(c)) // 2) // 3 as breaks, right(hex(c), 2) = '0A' as closed from s where regexp_matches(lower(path), '\\.[ch]$')), m as (select *, (coalesce(sum(breaks + 2) over (partition by submission_id order by path rows between unbounded preceding and 1 preceding), 0) + 2)::bigint as start_line, row_number() over (partition by submission_id order by path desc) as back from b), z as (select submission_id, start_line as last_start, start_line + breaks + case when closed then 0 else 1 end - 1 as last_end from m where back = 1) select submission_id, sum(length(path) + n + length('/* ====  ==== */') + 2)::bigint as characters, count(*) as files, any_value(last_start) as last_start, any_value(last_end) as last_end from m join z using (submission_id) group by submission_id",
    "case_results": _CASES + "select * from r",
    "grade_summary": _CASES + "select submission_id, count(*) as cases, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'compile_failed') as compile_failed, count(*) filter (status not in ('pass', 'compile_failed', 'not_run')) as failed, count(*) filter (output_match = 'missing') as missing_expected, count(*) filter (status = 'not_run') as not_run from r group by 1",
    "scenario_plan": f"select submission_id, scenario, process, args, input, delay_ms from (select distinct submission_id from {_L['submissions']}) cross join (values ('small', 'server', '8080', '', 0), ('small', 'client', '-n 1', 'ping' || chr(10), 200), ('small', 'log', '', '', 0), ('idle', 'server', '8081 -v', '', 0), ('idle', 'client', '', '', 0), ('idle', 'log', '', '', 0)) as p(scenario, process, args, input, delay_ms)",
    "scenario_matrix": f"with p as (select submission_id, runner, count(*) as n, bool_and(coalesce(ok, false) and not coalesce(timed_out, false)) as passed from {_L['execute_results']} where submission_id is not null and runner is not null group by all) select submission_id, count(*) as processes, coalesce(max(n) filter (runner = 'r-atlas'), 0) as atlas_runs, coalesce(bool_and(passed) filter (runner = 'r-birch'), false) as birch_passed, bool_and(passed) as all_passed from p group by 1",
    "progress_monotone": f"select result_id, max(coalesce(case_index, 0)) over (partition by submission_id order by executed_at, result_id rows unbounded preceding) as best_case, 0.1::double + 0.9::double * (row_number() over (partition by submission_id order by executed_at, result_id) / count(*) over (partition by submission_id)) as fraction from {_L['execute_results']} where submission_id is not null and executed_at is not null",
    "session_idle": "with n as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 21600000000 then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from n) select user_id, session, count(*) as events, epoch_us(max(ts)) - epoch_us(min(ts)) as span_us from s group by all",
    "retention": f"select runner, count(*) as old from {_L['execute_results']} where executed_at < (select max(executed_at) from execute_results) - interval 7 days group by runner",
    "top_hits": _BYFN + " order by hits desc, function_name limit 20",
    "report_json": _ST + "select submission_id, case when hits = 0 then '{\"status\":\"' || status || '\"}' else '{\"status\":\"' || status || '\",\"hits\":' || hits || '}' end as json from s",
}
