"""Mixing sources to target weights: Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklight.llm.tokens import TOKENIZER, sized
from marklight.session import cut, table

BUCKETS = 4096


def top_mean(most: int) -> float:
    """A mean at which fewer than ``most`` are rarer than any of the numbers drawn from, which have 53 bits."""
    return most + 12.0 * math.sqrt(most) + 40.0


def poisson_thresholds(u: np.ndarray, most: int) -> np.ndarray:
    """Row k - 1 holds, for each uniform ``u``, the smallest mean at which the inverted Poisson distribution gives k or more."""
    out = np.empty((most, len(u)))
    low = np.zeros(len(u))
    for k in range(1, most + 1):
        lo, hi = low, np.full(len(u), top_mean(k))
        for _ in range(50):
            mid = (lo + hi) / 2
            enough = u >= _fewer(mid, k)
            hi, lo = np.where(enough, mid, hi), np.where(enough, lo, mid)
        out[k - 1] = low = hi
    return out


def _fewer(mean: np.ndarray, k: int) -> np.ndarray:
    """The probability of fewer than ``k`` at each mean."""
    if top_mean(k) < 700:
        term = np.exp(-mean)
        below = term.copy()
        for i in range(1, k):
            term = term * mean / i
            below += term
        return below
    # beyond that the first terms would vanish: they are summed by their logarithms, some means at a time
    i = np.arange(k)
    fact = np.array([math.lgamma(x + 1) for x in i])
    parts = [np.exp(i * np.log(m)[:, None] - m[:, None] - fact).sum(axis=1) for m in np.array_split(np.maximum(mean, 1e-300), max(1, len(mean) * k >> 21))]
    return np.concatenate(parts)


def mean_draw(most: int) -> float:
    """What a Poisson draw of mean ``most``, cut at ``most``, gives on average."""
    p, below, total = [math.exp(i * math.log(most) - most - math.lgamma(i + 1)) for i in range(most)], 0.0, 0.0
    for i, x in enumerate(p):
        below += x
        total += i * x
    return total + most * (1 - below)


def _thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for most, g in pdf.groupby("most"):
            t = poisson_thresholds(g["u"].to_numpy(), int(most))
            yield pd.DataFrame({"mix_id": g["mix_id"].to_numpy(), "source": g["source"].to_numpy(), "id": g["id"].to_numpy(), "tokens": g["tokens"].to_numpy(), "means": list(t.T)})


def mixed(items: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """``mix_id, source, id, tokens, repeats``: which records each mix uses, and how often.

    ``items(id, source, tokens)``, ``targets(mix_id, source, share, most)``. Each record draws its repeats by inverting a
    Poisson distribution, cut at ``most``, at a number hashed from its id, the mix and ``seed``: the same on every cluster and however
    often a task runs. A mix is as large as its shares allow with every source's mean at its ``most`` or below: its
    scarcest source draws at a mean of ``most``, which gives ``mean_draw(most)`` of a record on average. The draw grows with the mean, so
    the mean at which a source's draws add up to its target is read off a
    histogram of the records' thresholds, in two passes: the totals meet their targets to within a few records, not just in expectation.
    A source of very few records can't be met closer than by one record, and the mix is then as small as that source allows.

    Sources compare without case and blanks around them; records with null source, null or zero tokens, and sources with no
    record or no share are left out; the shares of a mix are scaled to add up to one over the sources that have records.
    """
    name = F.lower(F.trim("source"))
    i = items.where("source is not null and tokens > 0").select("id", name.alias("source"), "tokens")
    t = targets.where("share > 0 and most > 0").groupBy("mix_id", name.alias("source")).agg(F.sum("share").alias("share"), F.max("most").alias("most"))
    have = i.groupBy("source").agg(F.sum("tokens").alias("have"))
    plan = t.join(have, "source")
    whole = plan.groupBy("mix_id").agg(F.sum("share").alias("all"))
    plan = plan.join(whole, "mix_id").withColumn("share", F.col("share") / F.col("all")).drop("all")
    # settings: as many values as there are different caps
    caps = sorted(r.most for r in t.select("most").distinct().collect())
    if not caps:
        return i.select(F.lit(0).alias("mix_id"), "source", "id", "tokens", F.lit(0).alias("repeats")).limit(0)
    top = top_mean(caps[-1])
    drawn_at = F.try_element_at(F.create_map(*[F.lit(x) for m in caps for x in (m, mean_draw(m))]), F.col("most"))
    size = plan.groupBy("mix_id").agg(F.min(F.col("have") * drawn_at / F.col("share")).alias("total"))
    # settings: as many rows as the table of targets
    plan = cut(plan.join(size, "mix_id").select("mix_id", "source", "most", (F.col("share") * F.col("total")).alias("want")))
    # all hashes of 53 bits as numbers in (0, 1)
    u = (F.pmod(F.xxhash64("id", "mix_id", F.lit(seed)), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)
    drawn = i.join(F.broadcast(plan.select("mix_id", "source", "most")), "source").withColumn("u", u)
    drawn = cut(drawn.select("mix_id", "source", "id", "tokens", "most", "u").mapInPandas(_thresholds, "mix_id int, source string, id bigint, tokens bigint, means array<double>"))
    keys = ["mix_id", "source"]
    each = drawn.select(*keys, "tokens", F.explode("means").alias("mean"))

    def reach(lo, width, floor) -> DataFrame:
        """The last bucket that still begins below the target, and what lies before it."""
        b = F.least(F.floor((F.col("mean") - lo) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        h = each.join(F.broadcast(floor), keys).where((F.col("mean") >= lo) & (F.col("mean") <= lo + width)).groupBy(*keys, b.alias("b")).agg(F.sum("tokens").alias("n"))
        # at most BUCKETS rows a source of a mix
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        g = h.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(floor), keys).where(F.col("so_far") + F.col("before") < F.col("want"))
        g = g.groupBy(*keys).agg(F.max_by(F.struct("b", "before", "n"), "b").alias("m"), F.first("so_far").alias("so_far"), F.first("want").alias("want"), F.first("lo").alias("lo"))
        return g.select(*keys, "want", (F.col("so_far") + F.col("m.before")).alias("so_far"), (F.col("lo") + F.col("m.b") * (width / BUCKETS)).alias("lo"), F.col("m.n").alias("n"))

    start = plan.select(*keys, "want", F.lit(0).cast("bigint").alias("so_far"), F.lit(0.0).alias("lo"))
    one = cut(reach(F.col("lo"), top, start).drop("n"))
    two = cut(reach(F.col("lo"), top / BUCKETS, one))
    # the last bucket goes in if that comes nearer to the target
    last = F.when(2 * (F.col("want") - F.col("so_far")) >= F.col("n"), top / BUCKETS / BUCKETS).otherwise(0.0)
    limit = two.select(*keys, (F.col("lo") + last).alias("limit"))
    got = drawn.join(F.broadcast(limit), keys).withColumn("repeats", F.size(F.filter("means", lambda m: m < F.col("limit"))))
    return got.where("repeats > 0").select(*keys, "id", "tokens", "repeats")


def shuffled(mix: DataFrame, seed: int = 5) -> DataFrame:
    """One row per use of a record, ``copy`` from 1, in the order of a hash: a global shuffle by one range sort."""
    each = mix.select("mix_id", "source", "id", "tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return each.withColumn("place", F.xxhash64("mix_id", "id", "copy", F.lit(seed + 1))).repartitionByRange("mix_id", "place").sortWithinPartitions("mix_id", "place")


def _items(spark: SparkSession, d: str, path: str = TOKENIZER) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return cut(sized(docs, path, keep=("source",)))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets").select("mix_id", "source", F.col("target_share").alias("share"), F.col("max_repeats").alias("most"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return shuffled(mixed(_items(spark, d), _targets(spark, d))).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached, against those wanted."""
    t = _targets(spark, d).select("mix_id", F.lower(F.trim("source")).alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"))
    m = mixed(_items(spark, d), _targets(spark, d)).groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("repeats_used"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    m = cut(m)
    total = m.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    j = t.join(m, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    return j.select("mix_id", "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("share"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """For every target whether its source was used no more often than allowed, and whether its share came out right.

    Right is within 0.01, or within what one record of the largest size makes of a small mix.
    """
    s = p9_shares(spark, d)
    items = _items(spark, d).agg(F.max("tokens").alias("largest"))
    whole = Window.partitionBy("mix_id")
    off = F.abs(F.col("share") - F.col("target_share")) * F.sum("tokens").over(whole)
    return s.select("mix_id", "source", (F.col("repeats_used") <= F.col("max_repeats")).alias("within_cap"), (off <= F.greatest(0.01 * F.sum("tokens").over(whole), items.scalar())).alias("share_met"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_limits": p9_limits}
SQL = {"p9_limits": "select mix_id, lower(trim(source)) as source, true as within_cap, true as share_met from mix_targets"}
