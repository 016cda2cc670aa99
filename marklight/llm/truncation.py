"""Text cut off by field limits: spikes in length histograms, and incomplete last words.

Everything that looks at the end of a text looks at the beginning of its reverse: patterns anchored there are linear in
the text, however long its words or its runs of blanks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklight.operators.detection import bounded
from marklight.operators.skew import heavy_of, skew_join
from marklight.session import cut, free, latest, table

WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Words of the notes that runners and terminals put in brackets behind a cut text.
NOTES = ["truncated", "trunc", "cut", "cut off", "omitted", "snipped", "clipped", "shortened", "abgeschnitten", "lost", "more"]
#: What stands behind a cut text, in reverse: dots, or a note in brackets.
MARK = r"(?i)^\s*((\.\.\.|…|[\])>}][^\[\](){}<>\n]*\b(" + "|".join(n[::-1] for n in NOTES) + r")\b[^\[\](){}<>\n]*[\[(<{])\s*)+"
#: Terminal punctuation, closing brackets and quotes.
STOP = r"[.!?:;,)\]}\"']+"


def ends(texts: DataFrame) -> DataFrame:
    """How texts end: ``chars, bytes`` and ``bare_chars, bare_bytes`` (without cut marks), ``last``: the last word if nothing but
    a cut mark and blanks stand behind it, ``stopped``: the word before a final sign, ``damaged``: a final replacement character.

    Words are in lower case; no word is an empty text.
    """
    t = texts.withColumn("rev", F.reverse("text"))
    t = t.withColumn("bare", F.regexp_replace("rev", MARK, ""))
    t = t.withColumn("tail", F.regexp_replace("bare", r"^[\s\u200b\ufeff]+", ""))
    word = lambda p: F.lower(F.reverse(F.regexp_extract("tail", p, 1)))
    return t.withColumns({
        "chars": F.length("text"), "bytes": F.octet_length("text"), "bare_chars": F.length("bare"), "bare_bytes": F.octet_length("bare"),
        "last": word(f"^({WORD})"), "stopped": word(f"^{STOP}({WORD})"), "damaged": F.col("tail").startswith("\ufffd"),
    }).drop("rev", "bare", "tail")


UNITS = ["chars", "bytes", "bare_chars", "bare_bytes"]


def length_spikes(measured: DataFrame, least: int = 5, factor: float = 6.0, tail: float = 0.02) -> DataFrame:
    """Lengths at which texts of a source and column pile up at the maximum: ``source, field_name, unit, length``.

    ``measured(source, field_name, chars, bytes, bare_chars, bare_bytes)`` of ``ends``. One histogram for each unit. A length
    is a spike if at least ``least`` texts have it, ``factor`` times as many as the mean of the ten
    lengths around it, and at most the share ``tail`` of the source's texts is longer. Histograms combine map-side: a
    source with most of the rows costs one row per length.
    """
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])
    h = measured.select("source", "field_name", F.explode(units).alias("u")).groupBy("source", "field_name", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    h = cut(h)
    near = h.select("source", "field_name", "unit", F.explode(F.sequence(F.col("length") - 5, F.col("length") + 5)).alias("length"), F.col("n").alias("m"), F.col("length").alias("at"))
    around = near.where("at <> length").groupBy("source", "field_name", "unit", "length").agg((F.sum("m") / 10).alias("around"))
    # how many are longer: totals per block of 64 lengths, one row a block however many texts, then the rest of the own block
    block = F.floor(F.col("length") / 64)
    blocks = h.groupBy("source", "field_name", "unit", block.alias("block")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source", "field_name", "unit")
    later = blocks.select("source", "field_name", "unit", "block", F.coalesce(F.sum("n").over(w.orderBy("block").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("later"), F.sum("n").over(w).alias("total"))
    big = h.where(F.col("n") >= least).join(around, ["source", "field_name", "unit", "length"], "left").where(F.col("n") >= factor * F.greatest(F.coalesce("around", F.lit(0)), F.lit(0.5)))
    same = h.select("source", "field_name", "unit", F.col("length").alias("other"), F.col("n").alias("k"))
    keys = ["source", "field_name", "unit"]
    longer = big.join(same, keys).where("floor(other / 64) = floor(length / 64) and other > length").groupBy(*keys, "length").agg(F.sum("k").alias("within"))
    out = big.withColumn("block", block).join(later, [*keys, "block"]).join(longer, [*keys, "length"], "left")
    return out.where(F.col("later") + F.coalesce("within", F.lit(0)) <= tail * F.col("total")).select(*keys, "length", "n")


def word_evidence(texts: DataFrame) -> DataFrame:
    """``word, whole, ending, at_limit``: how often each word stands whole (inside a text or before a final sign), and how often it
    ends a text unstopped, away from any limit and at one. ``texts(text, last, stopped, at_limit)``; counts combine map-side."""
    none = F.lit(0).cast("bigint")
    inner = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(F.lower("text")), MARK, ""), r"^[^\p{L}\p{M}\p{N}_]*" + WORD, ""))
    inside = texts.select(F.explode(F.regexp_extract_all(inner, F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("whole"))
    one = inside.select("word", "whole", none.alias("ending"), none.alias("limit"))
    two = texts.where("stopped <> ''").groupBy(F.col("stopped").alias("word")).agg(F.count(F.lit(1)).alias("whole")).select("word", "whole", none.alias("ending"), none.alias("limit"))
    three = texts.where("last <> ''").groupBy(F.col("last").alias("word")).agg(none.alias("whole"), F.count_if(~F.col("at_limit")).alias("ending"), F.count_if("at_limit").alias("limit"))
    words = one.unionByName(two).unionByName(three).where(~F.col("word").rlike(r"^\d+$"))
    return words.groupBy("word").agg(F.sum("whole").alias("whole"), F.sum("ending").alias("ending"), F.sum("limit").alias("limit"))


def judged_ends(words: DataFrame, rare: float = 1e-4, habit: float = 0.1) -> DataFrame:
    """``last, half, known`` for every word of ``word_evidence`` that ends a text, and ``rows``: how many it ends.

    ``half``: longer words begin with it that stand whole or end texts, and it stands whole less than ``rare`` times as often as
    they, and isn't in the habit of ending texts (``habit``, its own text aside). ``known``: it stands whole, more than ``rare`` as often as
    longer words, or is in that habit. Shares, not counts: the judgement of a word doesn't change as the collection grows.
    Only beginnings as long as some last word are made of a word, as hashes, so a very long word costs no more than its length.
    """
    last = words.where("ending + limit > 0")
    sizes = last.select(F.length("word").alias("size")).distinct().agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    sized = words.withColumn("size", F.length("word")).withColumn("sizes", sizes.select("sizes").scalar())
    begun = sized.select(F.explode(F.filter("sizes", lambda n: n < F.col("size"))).alias("n"), "word", (F.col("whole") + F.col("ending")).alias("k"))
    begun = begun.select("n", F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("n"))).alias("h"), "k").groupBy("n", "h").agg(F.sum("k").alias("longer"))
    j = last.withColumns({"n": F.length("word"), "h": F.xxhash64("word")}).join(begun, ["n", "h"], "left").withColumn("longer", F.coalesce("longer", F.lit(0)))
    whole = (F.col("whole") > 0) & (F.col("whole") >= rare * F.col("longer"))
    half = (F.col("longer") > 0) & ~whole & (F.col("ending") - 1 <= habit * F.col("longer"))
    known = whole | ((F.col("ending") > 0) & (F.col("ending") > habit * F.col("longer")))
    return j.select(F.col("word").alias("last"), half.alias("half"), known.alias("known"), (F.col("ending") + F.col("limit")).alias("rows"))


def truncated(texts: DataFrame, spikes: DataFrame | None = None) -> DataFrame:
    """Texts whose end is missing: ``record_id, source, field_name, at_limit, why`` of ``texts(record_id, source, field_name, text)``.

    At a spike of its source's lengths (``length_spikes``, unless ``spikes`` are given) a text without terminal punctuation is cut, unless its
    last word is known to be whole: ``why`` is ``cut at limit``, or ``number at limit`` if it ends in a number. Such a word needs to
    begin nothing: ids, paths and rare names count. Texts that broke off in transfer have any length, so they have to show it: their last
    word is no word but the beginning of one (``broken off``). A final replacement character is ``damaged`` anywhere. Cut marks are seen through.

    Null and empty texts are no cases; a null source is a source of its own; repeated rows are judged alike.
    """
    t = texts.where("text is not null and text <> ''").select("record_id", F.coalesce("source", F.lit("\u0000")).alias("source"), "field_name", "text")
    t = cut(ends(t))
    spikes = length_spikes(t) if spikes is None else spikes.withColumn("source", F.coalesce("source", F.lit("\u0000")))
    # as many rows as there are sources with limits
    at_unit = [F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"at_{u}") for u in UNITS]
    per = cut(spikes.select("source", "field_name", "unit", "length").distinct().groupBy("source", "field_name").agg(*at_unit))
    at = F.lit(False)
    for u in UNITS:
        at = at | F.coalesce(F.array_contains(f"at_{u}", F.col(u)), F.lit(False))
    m = cut(t.join(bounded(per), ["source", "field_name"], "left").withColumn("at_limit", at).select("record_id", "source", "field_name", "last", "stopped", "damaged", "at_limit", "text"))
    free(t, per)
    words = cut(word_evidence(m))
    verdicts = cut(judged_ends(words).where("half or not known"))
    out = m.drop("text", "stopped")
    number = F.col("last").rlike(r"^\d+$")
    worded = out.where((F.col("last") != "") & ~number & ~F.col("damaged"))
    j = skew_join(worded, verdicts, "last", heavy_of(verdicts, "last", "rows", worded.count()))
    j = j.withColumn("why", F.when(F.col("at_limit"), F.when(~F.col("known"), "cut at limit")).when(F.col("half"), "broken off"))
    plain = out.withColumn("why", F.when(F.col("damaged"), "damaged").when(F.col("at_limit") & F.col("last").rlike(r"\d$") & number, "number at limit"))
    cols = ["record_id", "source", "field_name", "at_limit", "why"]
    got = j.select(*cols).unionByName(plain.select(*cols)).where("why is not null")
    got = cut(got.withColumn("source", F.nullif("source", F.lit("\u0000"))))
    free(m, words, verdicts)
    return got


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    e = latest(table(spark, d, "execute_results").select("result_id", "runner", "stdout", "stderr", "received_at"), "result_id")
    return e.select(F.col("result_id").alias("record_id"), F.col("runner").alias("source"), F.explode(F.create_map(F.lit("stdout"), F.col("stdout"), F.lit("stderr"), F.col("stderr"))).alias("field_name", "text")).where("text is not null")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_outputs(spark, d)).select(F.col("record_id").alias("result_id"), "field_name")


def p7_by_runner(spark: SparkSession, d: str) -> DataFrame:
    """How often each runner and column truncates."""
    o = _outputs(spark, d)
    n = o.groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("texts"))
    k = truncated(o).groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("cut"))
    k = k.select(F.col("source").alias("s"), F.col("field_name").alias("f"), "cut")
    return n.join(k, n["source"].eqNullSafe(k["s"]) & (n["field_name"] == k["f"]), "left").select(F.col("source").alias("runner"), "field_name", "texts", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))


QUERIES = {"p7_found": p7_found, "p7_by_runner": p7_by_runner}
SQL: dict[str, str] = {}
