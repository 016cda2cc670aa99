"""Frequency of every distinct value or term: suffix-sorted n-gram counting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.operators.skew import heavy_of, skew_join
from marklight.session import cut, table


def _stacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix counts of suffixes that come sorted, each prefix's suffixes next to each other.

    The stack holds the open prefixes, shortest below: their hits and their records. When a prefix ends it is emitted
    and what it holds goes to the prefix below it.
    """
    route, stack = None, []  # stack of [term, hits, records]
    out: list[tuple[list[str], int, int]] = []

    def pop(down_to: int) -> None:
        while len(stack) > down_to:
            terms = [x[0] for x in stack]
            _, hits, records = stack.pop()
            out.append((terms, hits, len(records)))
            if stack:
                stack[-1][1] += hits
                if len(stack[-1][2]) < len(records):
                    stack[-1][2], records = records, stack[-1][2]
                stack[-1][2] |= records

    for pdf in batches:
        for first, salt, suffix, record, hits in zip(pdf["first"], pdf["salt"], pdf["suffix"], pdf["record"], pdf["hits"]):
            if (first, salt) != route:
                pop(0)
                route = (first, salt)
            same = 0
            for term, open_ in zip(suffix, stack):
                if term != open_[0]:
                    break
                same += 1
            pop(same)
            for term in suffix[same:]:
                stack.append([term, 0, set()])
            stack[-1][1] += hits
            stack[-1][2].add(record)
        yield pd.DataFrame(out, columns=["terms", "hits", "records"])
        out = []
    pop(0)
    yield pd.DataFrame(out, columns=["terms", "hits", "records"])


def term_counts(sequences: DataFrame, max_terms: int = 1, hot_rows: int = 200_000) -> DataFrame:
    """Hits and records of every sequence of up to ``max_terms`` consecutive terms.

    ``sequences(record, terms array<string>)`` may hold several rows a record. Each position gives one suffix of at most
    ``max_terms`` terms, equal ones of a record are added up before the shuffle, and suffixes are routed by their first
    term and sorted in reverse order; one pass with a stack then counts all prefixes at once. A first term is split by
    record into parts of about ``hot_rows`` suffixes, at any size of the input, so that no task gets all of a frequent term and no
    set of records outgrows a part; the parts have no record in common and add up exactly.

    Null terms, null records and null or empty sequences count nowhere; repeated rows count as often as they stand.
    """
    s = sequences.where("record is not null").select(F.col("record").cast("string").alias("record"), F.filter("terms", lambda x: x.isNotNull()).alias("terms")).where("size(terms) > 0")
    at = s.select("record", F.posexplode("terms").alias("pos", "first"), "terms")
    suffix = at.select("record", "first", F.slice("terms", F.col("pos") + 1, max_terms).alias("suffix"))
    suffix = cut(suffix.groupBy("record", "first", "suffix").agg(F.count(F.lit(1)).alias("hits")))
    counts = suffix.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    parts = cut(counts).select("first", "n", F.ceil(F.col("n") / hot_rows).alias("parts"))
    salted = skew_join(suffix, parts, "first", heavy_of(parts, "first", "n", suffix.count())).withColumn("salt", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int"))
    routed = salted.select("first", "salt", "suffix", "record", "hits").repartition("first", "salt").sortWithinPartitions("first", "salt", F.desc("suffix"))
    part = routed.mapInPandas(_stacks, "terms array<string>, hits bigint, records bigint")
    return part.groupBy("terms").agg(F.sum("hits").alias("hits"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """``counts`` with ``mark``: ``rare``, ``common`` or null. ``total`` is one row with the number of records."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total.select("total").scalar(), "common"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, d, "scan_hits").where("submission_id is not null")
    total = hits.agg(F.count_distinct("submission_id").alias("total"))
    named = hits.where("function_name is not null").select("hit_id", F.col("submission_id").alias("record"), "file", "line_no", "col_no", F.regexp_replace("function_name", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("name"))
    return named.dropDuplicates(["hit_id"]), total


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    named, total = _names(spark, d)
    m = marked(term_counts(named.select("record", F.array("name").alias("terms"))), total)
    return m.where("mark is not null").select(F.col("terms")[0].alias("function_name"), "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits and submissions of every function name."""
    named, _ = _names(spark, d)
    return term_counts(named.select("record", F.array("name").alias("terms"))).select(F.col("terms")[0].alias("function_name"), "hits", F.col("records").alias("submissions"))


def p2_call_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of up to three calls that follow each other in a file, in at least two submissions."""
    named, _ = _names(spark, d)
    runs = named.groupBy("record", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "col_no", "hit_id", "name"))), lambda x: x["name"]).alias("terms"))
    c = term_counts(runs, 3).where("size(terms) > 1 and records > 1")
    return c.select(F.array_join("terms", " ").alias("calls"), F.size("terms").cast("bigint").alias("length"), "hits", F.col("records").alias("submissions"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_call_runs": p2_call_runs}
_H = """with h as (select distinct hit_id, submission_id, file, line_no, col_no, regexp_replace(function_name, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as name
  from scan_hits where submission_id is not null and function_name is not null) """
SQL = {
    "p2_found": _H + """, c as (select name, count(distinct submission_id) as n from h group by name),
t as (select count(distinct submission_id) as total from scan_hits)
select name as function_name, case when n < 3 then 'rare' else 'common' end as mark from c, t where n < 3 or n > 0.25 * total""",
    "p2_counts": _H + "select name as function_name, count(*) as hits, count(distinct submission_id) as submissions from h group by name",
    "p2_call_runs": _H + """, s as (select submission_id, file, list(name order by line_no nulls first, col_no nulls first, hit_id) as t from h group by submission_id, file),
g as (select submission_id, t[i:i + n - 1] as g from (select *, unnest(range(1, len(t) - n + 2)) as i from (select *, unnest([2, 3]) as n from s)))
select array_to_string(g, ' ') as calls, len(g)::bigint as length, count(*) as hits, count(distinct submission_id) as submissions from g group by g having count(distinct submission_id) > 1""",
}
