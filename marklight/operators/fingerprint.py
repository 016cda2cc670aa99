"""Units, windows and their hashes, for text (a line is a unit) and for C (a function is a unit)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklight.functions import ctok

WINDOW, MIN_TOKENS = 5, 20


def token_hash(tokens: Column) -> Column:
    """SHA-256 in hex digits of the tokens with single blanks between them."""
    return F.sha2(F.array_join(tokens, " "), 256)


def text_units(texts: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``id, unit, tokens``: the lines of ``texts(id, text)`` with at least ``min_tokens`` words.

    Null and empty texts have no units; rows of an id that stand twice give their units twice.
    """
    lines = texts.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    # the array is made once in a projection of its own; inlined into the filter it would be extracted twice
    units = lines.select("id", "unit", F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0)).alias("tokens"))
    return units.where(F.size("tokens") >= min_tokens)


def _c_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["id", "unit", "start", "end", "tokens", "starts", "ends"]
    for pdf in batches:
        yield pd.DataFrame([(key, *f) for key, content in zip(pdf["id"], pdf["content"]) for f in ctok.function_tokens(content)], columns=cols)


def c_units(files: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``id, unit, start, end, tokens, starts, ends``: normalised functions of ``files(id, content binary)``, with byte spans.

    Identifiers are numbered by first occurrence in their function, literals and operators stand for their class. Tokens
    outside functions count nowhere. Null, empty and broken contents give what can be read of them.
    """
    kind = files.schema["id"].dataType.simpleString()
    units = files.select("id", "content").mapInPandas(_c_units, f"id {kind}, unit int, start bigint, end bigint, tokens array<string>, starts array<bigint>, ends array<bigint>")
    return units.where(F.size("tokens") >= min_tokens)


def windows(units: DataFrame, width: int = WINDOW, spans: bool = False) -> DataFrame:
    """``id, unit, pos, hash`` of every ``width`` consecutive tokens; with ``spans`` also ``start, end`` in bytes."""
    keep = ["id", "unit"] + (["starts", "ends"] if spans else [])
    ok = units.where((F.size("tokens") >= width) & F.lit(width > 0)) if width > 0 else units.limit(0)
    at = ok.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - (width - 1)), lambda i: token_hash(F.slice("tokens", i, width)))).alias("pos", "hash"))
    if not spans:
        return at
    return at.select("id", "unit", "pos", "hash", F.col("starts")[F.col("pos")].alias("start"), F.col("ends")[F.col("pos") + (width - 1)].alias("end"))


def unit_hashes(units: DataFrame) -> DataFrame:
    """``id, unit, n, hash``: one row per unit with its size and the hash of all its tokens."""
    return units.select("id", "unit", F.size("tokens").alias("n"), token_hash(F.col("tokens")).alias("hash"))


def ordinals(units: DataFrame) -> DataFrame:
    """``id, unit, tokens`` with words numbered by first occurrence in the unit (``@1``, ``@2`` ...) and numbers as ``@NUM``."""
    word = lambda t: ~t.rlike("^[0-9]")
    named = F.transform(F.array(F.array_distinct(F.filter("tokens", word))), lambda ids: F.transform(F.col("tokens"), lambda t: F.when(word(t), F.concat(F.lit("@"), F.array_position(ids, t).cast("string"))).otherwise("@NUM")))[0]
    return units.select("id", "unit", named.alias("tokens"))
