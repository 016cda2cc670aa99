"""Queries over the logs of compilations and runs (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.operators.logs import log_entries, template_report
from marklight.session import latest, table


def log_texts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "compile_results").select(F.col("compile_id").alias("record_id"), F.col("stderr").alias("text"), "started_at", "received_at")
    b = table(spark, d, "execute_results").where("memlog is not null").select(F.col("result_id").alias("record_id"), F.col("memlog").alias("text"), F.col("executed_at").alias("started_at"), "received_at")
    one = lambda df, kind: latest(df, "record_id").select(F.lit(kind).alias("log_kind"), "record_id", "text", "started_at")
    return one(a, "compile").unionByName(one(b, "run"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(log_texts(spark, d), messages=False)


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(log_texts(spark, d))


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    return template_report(log_texts(spark, d))


QUERIES = {"p4_found": p4_found, "p4_entries": p4_entries, "p4_templates": p4_templates}
SQL: dict[str, str] = {}
