"""All similar pairs between set-valued records: cells of rare elements, split further by the next shared ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.operators.cells import candidate_pairs, ranked_sets, set_classes, verified
from marklight.operators.skew import block_copies
from marklight.session import cut, free, latest, table


def similar_classes(sets: DataFrame, threshold: float, across: bool = False, cell_rows: int = 24) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, similarity`` between classes of equal sets, and ``side, id, cls`` of every record.

    ``sets(side, id, items array<bigint>)``, one row per record; ``side`` is ``l`` or ``r`` (any one value within one table). A class
    is named by its smallest id. With ``across`` pairs go from side ``l`` to ``r`` and classes of one side that equal one of the other
    are a pair too.
    """
    reps, member = set_classes(sets)
    ranked = ranked_sets(reps)
    cand = candidate_pairs(ranked, threshold, across, cell_rows)
    pairs = cut(verified(cand, ranked, threshold).select("a", "b", "similarity"))
    free(reps, ranked, cand)
    return pairs, member


def expanded(pairs: DataFrame, member: DataFrame, across: bool, limit: int = 1000) -> DataFrame:
    """``a, b`` between records, from pairs between their classes; within one table also the pairs inside each class.

    A class may hold a third of all records: the pairs inside it are made in blocks (``block_copies``).
    """
    side = (lambda s: member.where(F.col("side") == s)) if across else (lambda s: member)
    ma, mb = side("l").select(F.col("cls").alias("a"), F.col("id").alias("x")), side("r").select(F.col("cls").alias("b"), F.col("id").alias("y"))
    between = pairs.join(ma, "a").join(mb, "b").select("x", "y")
    if across:
        return between.select(F.col("x").alias("a"), F.col("y").alias("b"))
    sizes = member.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = block_copies(member.join(sizes, "cls").select("cls", "id", "k"), F.col("k"), limit, F.col("id"))
    left, right = (own.where(F.col("_at") == at).select("cls", "_block", F.col("id").alias(n)) for at, n in (("l", "x"), ("r", "y")))
    within = left.join(right, ["cls", "_block"]).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_records(sets: DataFrame, threshold: float, across: bool = False, cell_rows: int = 24) -> DataFrame:
    """All pairs of records ``a, b`` whose sets reach ``threshold``, equal sets included.

    Takes what ``similar_classes`` takes. Equal sets are joined once, as a class, and expanded at the end. Null and empty
    sets and null elements form no pair, repeated elements count once; an empty table gives no rows.
    """
    pairs, member = similar_classes(sets, threshold, across, cell_rows)
    return expanded(pairs, member, across)


def class_rows(sets: DataFrame, threshold: float, cell_rows: int = 24) -> DataFrame:
    """One row per record with a set: ``id, class_id, copies, links``: its class of equal sets, how many records that class
    has, and with how many other classes it is linked at ``threshold``."""
    pairs, member = similar_classes(sets, threshold, False, cell_rows)
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    copies = member.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    per = copies.join(links, "cls", "left")
    return member.join(per, "cls").select("id", F.col("cls").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _numbers(column: str):
    """Hex digits, case-insensitive, as 64-bit hashes."""
    return F.transform(column, lambda h: F.when(h.isNotNull(), F.xxhash64(F.lower(h))))


def _prints(spark: SparkSession, d: str, column: str) -> DataFrame:
    f = latest(table(spark, d, "fingerprints").select("fp_id", column, "received_at"), "fp_id")
    return f.select(F.lit("r").alias("side"), F.col("fp_id").alias("id"), _numbers(column).alias("items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    windows, functions = cut(_prints(spark, d, "window_hashes")), _prints(spark, d, "function_hashes")
    entries = table(spark, d, "dictionary").select(F.lit("l").alias("side"), F.col("entry_no").alias("id"), _numbers("window_hashes").alias("items"))
    kinds = [("window", similar_records(windows, 0.7)), ("function", similar_records(functions, 0.6)), ("entry", similar_records(windows.unionByName(entries), 0.5, across=True))]
    free(windows)
    one = [p.select(F.lit(k).alias("pair_kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b")) for k, p in kinds]
    return one[0].unionByName(one[1]).unionByName(one[2])


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same within ``fingerprints`` without expanding copies: one row a fingerprint and kind, with its class and links."""
    kinds = [("window", "window_hashes", 0.7), ("function", "function_hashes", 0.6)]
    one = [class_rows(_prints(spark, d, c), t).select(F.lit(k).alias("pair_kind"), F.col("id").alias("fp_id"), "class_id", "copies", "links") for k, c, t in kinds]
    return one[0].unionByName(one[1])


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
_SETS = """with f as (select distinct fp_id, lower(h) as h from fingerprints, unnest({c}) as u(h) where h is not null), n as (select fp_id, count(*) as n from f group by fp_id),
o as (select a.fp_id as a, b.fp_id as b, count(*) as k from f a join f b on a.h = b.h and a.fp_id < b.fp_id group by all)
select '{k}' as pair_kind, a as key_a, b as key_b from o join n x on x.fp_id = a join n y on y.fp_id = b where k / (x.n + y.n - k) >= {t}"""
SQL = {
    "p5_found": "select * from (" + _SETS.format(c="window_hashes", k="window", t="0.7::double") + ") union all select * from (" + _SETS.format(c="function_hashes", k="function", t="0.6::double") + """)
union all select * from (with f as (select distinct fp_id, lower(h) as h from fingerprints, unnest(window_hashes) as u(h) where h is not null), n as (select fp_id, count(*) as n from f group by fp_id),
e as (select distinct entry_no, lower(h) as h from dictionary, unnest(window_hashes) as u(h) where h is not null), m as (select entry_no, count(*) as n from e group by entry_no),
o as (select entry_no as a, fp_id as b, count(*) as k from e join f using (h) group by all)
select 'entry' as pair_kind, a as key_a, b as key_b from o join m on m.entry_no = a join n on n.fp_id = b where k / (m.n + n.n - k) >= 0.5::double)""",
}
_CLASSES = """with f as (select distinct fp_id, lower(h) as h from fingerprints, unnest({c}) as u(h) where h is not null), g as (select fp_id, string_agg(h, ' ' order by h) as bag, count(*) as n from f group by fp_id),
m as (select fp_id, n, min(fp_id) over (partition by bag) as cls, count(*) over (partition by bag) as copies from g), r as (select * from f where fp_id in (select cls from m)),
o as (select a.fp_id as a, b.fp_id as b, count(*) as k from r a join r b on a.h = b.h and a.fp_id <> b.fp_id group by all),
l as (select a as cls, count(*) as links from o join g x on x.fp_id = a join g y on y.fp_id = b where k / (x.n + y.n - k) >= {t} group by a)
select '{k}' as pair_kind, fp_id, cls as class_id, copies, coalesce(links, 0) as links from m left join l using (cls)"""
SQL["p5_classes"] = "select * from (" + _CLASSES.format(c="window_hashes", k="window", t="0.7::double") + ") union all select * from (" + _CLASSES.format(c="function_hashes", k="function", t="0.6::double") + ")"
