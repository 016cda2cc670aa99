"""Records against a dictionary of known passages: window Jaccard with every entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklight.session import cut


def bounded(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``df``, computed once and marked for broadcast if it takes at most ``most`` bytes in memory; else the join shuffles it.

    Texts and binaries count by their length, arrays by that of their JSON, all else as 16 bytes; the rows stay the same either way.
    """
    df = cut(df)
    size = F.lit(16 * len(df.columns) + 16).cast("bigint")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.length(F.to_json(f.name)), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def dictionary_matches(sets: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """``id, entry, shared, jaccard, flagged`` for ``sets(id, hash)`` and ``entries(entry, hash)``, both distinct.

    Matches without a shared window don't exist. The dictionary is small and broadcast after its size is checked; records
    are never shuffled for the join, and the counts combine map-side.
    """
    size = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("m"))
    k = sets.join(bounded(entries.join(known, "entry")), "hash").groupBy("id", "entry", "m").agg(F.count(F.lit(1)).alias("shared"))
    j = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return k.join(size, "id").select("id", "entry", "shared", j.alias("jaccard"), (j >= threshold).alias("flagged"))


def detection_results(ids: DataFrame, matches: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per record: ``id, best_score, match_count, flagged, parse_error, matches``; records without windows stay as errors.

    ``matches`` are ordered flagged first, then by score, then by entry.
    """
    order = F.struct((~F.col("flagged")).alias("x"), (-F.col("jaccard")).alias("y"), "entry", "jaccard", "flagged", "shared")
    m = matches.groupBy("id").agg(F.max("jaccard").alias("best_score"), F.count(F.lit(1)).alias("match_count"), F.bool_or("flagged").alias("flagged"), F.transform(F.array_sort(F.collect_list(order)), lambda s: F.struct(s["entry"].alias("entry"), s["jaccard"].alias("jaccard"), s["flagged"].alias("flagged"), s["shared"].alias("shared"))).alias("matches"))
    e = errors.select("id", F.lit(True).alias("parse_error"))
    j = ids.select("id").join(m, "id", "left").join(e, "id", "left")
    return j.select("id", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("parse_error", F.lit(False)).alias("parse_error"), "matches")


def validate_dictionary(entries: DataFrame) -> DataFrame:
    """``problem``: what is wrong with ``entries(row, id, title, code)``, row counting from 1: blank fields, ids repeated
    after trimming; one row says so if the dictionary is empty."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"\S")
    fields = entries.select("row", F.explode(F.array(*[F.when(blank(c), F.lit(c)) for c in ("id", "title", "code")])).alias("field")).where("field is not null")
    one = fields.select(F.format_string("entry %d: %s is blank", "row", "field").alias("problem"))
    trimmed = F.regexp_replace("id", r"^\s+|\s+$", "")
    two = entries.where(~blank("id")).groupBy(trimmed.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.format_string("id %s is repeated", "id").alias("problem"))
    empty = entries.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("the dictionary is empty").alias("problem"))
    return one.unionByName(two).unionByName(empty)
