"""Consolidating pairwise matches into groups: hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.operators.skew import heavy_of, skew_join
from marklight.session import cut, free, table


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", heavy_rows: int = 100_000) -> DataFrame:
    """``node, group``: the smallest node linked with it directly or indirectly (byte order for strings).

    Hash-to-min over rows ``(v, u)``, "u is in the cluster of v": in each round every v sends its cluster to its
    smallest member and that member to all others, until nothing changes; rounds grow with the logarithm of the longest
    chain. A cluster is many rows, never one value, so a component of any size spreads over all tasks; the minimum
    combines map-side, and a node with very many rows meets its minimum by broadcast (``skew_join``).

    Null ends and pairs of a node with itself link nothing and give no node; repeated pairs, either way round, count
    once; an empty table gives no rows.
    """
    p = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u").distinct()
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("v", "u"), ("u", "v"), ("v", "v"), ("u", "u"))]))
    c = cut(p.select(ends.alias("e")).select("e.v", "e.u").distinct())
    state = None
    while True:
        now = c.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(v, u))").alias("x")).first()
        if (now.n, now.x) == state:
            break
        state = (now.n, now.x)
        least = cut(c.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("rows")))
        j = skew_join(c, least, "v", heavy_of(least, "v", "rows", now.n, heavy_rows))
        send = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        before, c = c, cut(j.select(send.alias("e")).select("e.v", "e.u").distinct())
        free(before, least)
    return c.groupBy("v").agg(F.min("u").alias("group")).withColumnRenamed("v", "node")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "similarity_pairs").where("flagged").select("a", "b")
    return connected_groups(flagged).select(F.col("node").alias("submission_id"), F.col("group").alias("group_id"))


def p6_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p6_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))


QUERIES = {"p6_found": p6_found, "p6_group_sizes": p6_group_sizes}
_CLOSURE = """with recursive e as (
  select distinct a as v, b as u from similarity_pairs where flagged and a is not null and b is not null and a <> b
  union select distinct b, a from similarity_pairs where flagged and a is not null and b is not null and a <> b),
r(v, u) as (select v, u from e union select r.v, e.u from r join e on r.u = e.v),
g as (select v as submission_id, least(v, min(u)) as group_id from r group by v) """
SQL = {
    "p6_found": _CLOSURE + "select submission_id, group_id from g",
    "p6_group_sizes": _CLOSURE + "select members, count(*) as n_groups from (select group_id, count(*) as members from g group by group_id) group by members",
}
