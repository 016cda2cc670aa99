"""Scalar column functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_space(c: Column) -> Column:
    """Without any Unicode white space around it (``trim`` only knows blanks)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unescape_input(c: Column) -> Column:
    """Literal ``\\n``, ``\\t``, ``\\r`` as control characters, in that order; a backslash has no escape of its own."""
    for lit, ctl in ((r"\n", "\n"), (r"\t", "\t"), (r"\r", "\r")):
        c = F.replace(c, F.lit(lit), F.lit(ctl))
    return c


def crash_reason(exit_code: Column, timed_out: Column) -> Column:
    """What killed a process, by an exit code above 128; empty for other codes, and for a kill by timeout."""
    # Signal numbers.
    signals = {11: "segmentation fault", 6: "aborted", 8: "arithmetic exception", 7: "bus error", 4: "illegal instruction"}
    out = F.when((exit_code == 137) & ~F.coalesce(timed_out, F.lit(False)), "out of memory")
    for n, text in signals.items():
        out = out.when(exit_code == 128 + n, text)
    return out.otherwise("")


def capped(c: Column, limit: int = 1 << 20) -> Column:
    """The first ``limit`` bytes with a note behind them; shorter values as they are. A cut may split a character."""
    head = F.substring(F.encode(c, "utf-8"), 1, limit)
    return F.when(F.octet_length(c) > limit, F.concat(head.cast("string"), F.lit("\n... [output truncated]"))).otherwise(c)


def process_name(c: Column) -> Column:
    """Base name of a path without a trailing ``.c``."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.c$", "")


def gcc_args(flags: Column, sources: Column, libs: Column, out: Column) -> Column:
    """Flags, sources, library files, library flags, output, in the order the compiler takes them."""
    files = F.filter(libs, lambda x: x.rlike(r"\.(c|o)$"))
    links = F.filter(libs, lambda x: x.startswith("-l"))
    return F.concat(flags, sources, files, links, F.array(F.lit("-o"), out))


def clean_folder(c: Column) -> Column:
    """A folder name without its upload suffix; the name itself if nothing else is left."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"_\d+_assignsubmission_file.*$", F.lit("")), F.lit("")), c)


def prompt_label(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.translate(F.lower(F.trim(c)), " ", "-"), "[^a-z0-9._-]", ""), 1, 32)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("submission"))


def valid_token(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9-]{1,64}\z"), F.lit(False))


def normal_run_id(c: Column) -> Column:
    """The trimmed id, null unless it only has letters, digits, ``_`` and ``-``."""
    t = trim_space(c)
    return F.when(t.rlike(r"\A[A-Za-z0-9_-]+\z"), t)


def parse_bool(c: Column) -> Column:
    """Null where the text says neither."""
    t = F.lower(trim_space(c))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def archive_stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip)$", "")


def is_archive(c: Column) -> Column:
    return c.rlike(r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip)$")


def skips_export(c: Column) -> Column:
    return c.startswith("valgrind-") & c.endswith(".log")


def includes_header(content: Column, header: str) -> Column:
    """Whether a source includes ``header``; a line comment before it doesn't count, a block comment isn't seen."""
    import re

    return content.rlike(r'(?md)^\s*#\s*include\s*["<]' + re.escape(header) + r'[">]')


def byte_snippet(content: Column, start: Column, end: Column, most: int = 80) -> Column:
    """Bytes ``[start, end)`` of a binary on one line without white space around, cut to ``most`` bytes with dots: binary.

    Bounds outside the content are clamped; a cut may split a character, as offsets are bytes.
    """
    a = F.greatest(F.lit(0), F.least(start, F.length(content)))
    b = F.greatest(a, F.least(end, F.length(content)))
    # ISO-8859-1 maps bytes to characters one to one
    text = F.regexp_replace(F.translate(F.decode(F.substring(content, a + 1, b - a), "ISO-8859-1"), "\n", " "), r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    return F.encode(F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text), "ISO-8859-1")
