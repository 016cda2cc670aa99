"""Semi-structured log lines into fields, by iterative partitioning.

``log_entries`` cuts texts into lines, tokenises and type-masks every line that may open an entry, partitions the
masked lines iteratively (token count, then the least variable position, then bijections between two positions, then the
positions at which a leaf's headers still mix layouts) into leaf templates, reads off each template which slots hold time,
level and component, and applies those slots to the lines of the leaf. All row-wise work runs in the JVM; Python only sees
leaf templates. A line's fields come from its leaf's template alone.

Defined results: a null or empty text has no entries; an indented or blank line or a ``=== banner ===`` never opens
one; a line whose template has no header slots belongs to the entry above; lines above the first entry belong to none;
repeated rows of one key count once; an empty table gives no rows; other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklight.operators.skew import heavy_of, skew_join
from marklight.session import cut

TOKEN = (
    r"\d{4}([-/.])\d\d\1\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?(?!\w)"
    r"|\d{4}([-/.])\d\d\2\d\d(?!\w)|\d\d:\d\d:\d\d(?:[.,]\d+)?(?!\w)|==\d+==|--\d+--|\w[\w./+\-]*\w|\w|[^\s\w]"
)
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: Spellings of the five levels.
LEVELS = {
    "DEBUG": ["debug", "dbg", "trace", "trc", "verbose", "fine", "d", "t"],
    "INFO": ["info", "inf", "information", "notice", "note", "i", "n"],
    "WARN": ["warn", "warning", "wrn", "w"],
    "ERROR": ["error", "err", "e"],
    "FATAL": ["fatal", "critical", "crit", "ftl", "f", "c"],
}
KEYS = {"logger", "comp", "component", "module", "program", "source", "unit", "service", "name", "app"}
TIME_KEYS = {"ts", "time", "timestamp", "t", "at"}
LEVEL_KEYS = {"level", "lvl", "severity", "sev"}
WORDS = "|".join(w for words in LEVELS.values() for w in words if len(w) > 1)

SHAPE = "masked array<string>"
ROLES = "time_kind string, time_pos int, level_pos int, comp_pos int, head_pos int"


def mask(tok: Column) -> Column:
    """The class of one token; plain words stay as they are."""
    return (
        F.when(tok.rlike(r"^\d{4}([-/.])\d\d\1\d\d[T ]\d\d:"), "<TS>")
        .when(tok.rlike(r"^\d{4}([-/.])\d\d\1\d\d$"), "<DATE>")
        .when(tok.rlike(r"^\d\d:\d\d:\d\d"), "<CLOCK>")
        .when(tok.rlike(r"^(==|--)\d+(==|--)$"), "<PID>")
        .when(tok.rlike(r"^[12]\d{9}$"), "<EPOCH>")
        .when(tok.rlike(r"^[12]\d{12}$"), "<EPOCHMS>")
        .when(tok.rlike(r"^\d+$"), "<NUM>")
        .when(tok.rlike(r"^[DIWEFCTN]\d{4}$"), "<LETTERDATE>")
        .when(tok.rlike(f"^({'|'.join(MONTHS)})$"), "<MON>")
        .when(tok.rlike(f"(?i)^({WORDS})$"), "<LEVEL>")
        .when(tok.rlike(r"^[DIWEFCTN]$"), "<LETTER>")
        .when(tok.rlike(r"^[\w+\-]+\.(c|h|C|H|cc|hh|cpp|hpp|cxx|py|go|rs|java|js|o|S|s)$"), "<FILE>")
        .when(tok.rlike(r"^\w.*[\d_./\-]"), "<ID>")
        .otherwise(tok)
    )


def _word(tok: str) -> bool:
    return tok in ("<ID>", "<FILE>", "<LEVEL>", "*") or bool(re.match(r"\w", tok))


def roles(tokens: list[str]) -> tuple[str | None, int, int, int, int]:
    """Where a template has its time, level and component, as 1-based positions (0: nowhere), and where its header ends.

    The kind of time is null if the template opens no entry.
    """
    n = len(tokens)
    at = lambda i: tokens[i] if 0 <= i < n else ""
    if at(0) == "<PID>":
        level = 2 if at(1) == "<LEVEL>" and at(2) == ":" else 0
        return ("none", 0, level, 1, 3 if level else 1) if n > 1 else (None, 0, 0, 0, 0)
    keyed: dict[str, int] = {}
    quoted = False
    for i in range(n - 2):
        quoted ^= at(i) == '"'
        if at(i + 1) == "=" and _word(at(i)) and not quoted:
            keyed.setdefault(at(i).lower(), i + 2 + (at(i + 2) in "\"'"))
        elif at(i) == '"' and at(i + 2) == '"' and at(i + 3) == ":":
            keyed.setdefault(at(i + 1).lower(), i + 4 + (at(i + 4) in "\"'"))
    if at(0) == "{" or (at(1) == "=" and at(0).lower() in TIME_KEYS | LEVEL_KEYS | KEYS):
        pos = [next((keyed[k] for k in keyed if k in names and keyed[k] < n), -1) for names in (TIME_KEYS, LEVEL_KEYS, KEYS)]
        kind = {"<TS>": "ts", "<EPOCH>": "epoch", "<EPOCHMS>": "epochms"}.get(at(pos[0]) if pos[0] >= 0 else "", "none")
        if kind == "none" and pos[1] < 0:
            return None, 0, 0, 0, 0
        return kind, pos[0] + 1 if kind != "none" else 0, pos[1] + 1, pos[2] + 1, max(pos) + 1
    i = 1 if at(0) in ("[", "(", "<") else 0
    kind, time, rest, level = {
        "<TS>": ("ts", i, i + 1, -1), "<EPOCH>": ("epoch", i, i + 1, -1), "<EPOCHMS>": ("epochms", i, i + 1, -1), "<CLOCK>": ("clock", i, i + 1, -1),
        "<DATE>": ("date", i, i + 2, -1) if at(i + 1) == "<CLOCK>" else ("none", -1, i, -1),
        "<MON>": ("month", i, i + 3, -1) if at(i + 1) == "<NUM>" and at(i + 2) == "<CLOCK>" else ("none", -1, i, -1),
        "<LETTERDATE>": ("letterdate", i, i + 2, i) if at(i + 1) == "<CLOCK>" else ("none", -1, i, -1),
    }.get(at(i), ("none", -1, i, -1))
    comp = -1
    if kind == "none":
        if i:
            return None, 0, 0, 0, 0
        # file:line:column: level: or program: level:
        j = 1
        while at(j) == ":" and at(j + 1) == "<NUM>":
            j += 2
        if _word(at(0)) and at(j) == ":" and at(j + 1) == "<LEVEL>":
            end = j + 2 + (at(j + 2) == "<LEVEL>" or at(j + 2) == "error")
            if at(end) == ":" and (j > 1 or at(0) != "<LEVEL>"):
                return "none", 0, j + 2, 1, end + 1
        return None, 0, 0, 0, 0
    if level < 0:
        for j in range(rest, min(rest + 9, n)):
            if at(j) == "<LEVEL>" or (at(j) == "<LETTER>" and at(j - 1) in "|[(<" and at(j + 1) in "|])>"):
                level = j
                break
    for j in range(rest, rest + 3):  # name[process]:
        if _word(at(j)) and [at(j + k) for k in (1, 2, 3, 4)] == ["[", "<NUM>", "]", ":"]:
            comp = j
            break
    if comp < 0:
        for j in range(rest, rest + 3):  # file:line]
            if at(j) == "<FILE>" and at(j + 1) == ":" and at(j + 2) == "<NUM>":
                comp = j
                break
    if comp < 0 and level >= 0:
        before = level - 1
        while before >= rest and not _word(at(before)):
            before -= 1
        after = level + 1
        while after < n and at(after) in ("]", ")", ">", "|", "-", "[", "("):
            after += 1
        if at(level + 1) == ":" and before >= rest:
            comp = before
        elif after < n and _word(at(after)):
            comp = after
        elif before >= rest:
            comp = before
    if comp < 0 and level < 0:
        j = rest
        while j < n and at(j) in ("]", ")", "(", "[", "|", "-"):
            j += 1
        if _word(at(j)) and at(j + 1) in (":", ")", "]", "|"):
            comp = j
    return kind, time + 1, level + 1, comp + 1, max(time + (kind in ("date", "letterdate")) + 2 * (kind == "month"), level, comp) + 1


def slots(tokens: list[str]) -> tuple[str | None, int, int, int, int]:
    """The same for a template whose layout ``roles`` has no rule for: time and level are told by the class of their slot.

    Both must stand at the front, in any order and brackets, with nothing between but numbers and one component, which is
    in brackets or followed by a separator; a template that has words there is prose and opens no entry.
    """
    n = len(tokens)
    at = lambda i: tokens[i] if 0 <= i < n else ""
    kind, time, level, comp, end, i = None, -1, -1, -1, -1, 0
    while i < n:
        found, size = {"<TS>": ("ts", 1), "<EPOCH>": ("epoch", 1), "<EPOCHMS>": ("epochms", 1), "<CLOCK>": ("clock", 1)}.get(at(i), (None, 1))
        if at(i) == "<DATE>" and at(i + 1) == "<CLOCK>":
            found, size = "date", 2
        elif [at(i), at(i + 1), at(i + 2)] == ["<MON>", "<NUM>", "<CLOCK>"]:
            found, size = "month", 3
        framed = at(i - 1) in ("[", "(", "<", "|") and at(i + 1) in ("]", ")", ">", "|")
        if found and kind is None:
            kind, time = found, i
        elif level < 0 and (at(i) == "<LEVEL>" or (at(i) == "<LETTER>" and framed)):
            level = i
        elif comp < 0 and _word(at(i)) and (framed or at(i + 1) in (":", "|", "-") or [at(i + 1), at(i + 2), at(i + 3)] == ["[", "<NUM>", "]"]):
            comp = i
        elif at(i) in ("[", "]", "(", ")", "<", ">", "|", "-", ":", ",") or (at(i) == "<NUM>" and (framed or at(i - 1) == ":")):
            i += 1
            continue
        else:
            break
        i, end = i + size, i + size
        if kind and level >= 0 and comp >= 0:
            break
    if kind is None or level < 0:
        return None, 0, 0, 0, 0
    return kind, time + 1, level + 1, comp + 1, end


def read(tokens: list[str]) -> tuple[str | None, int, int, int, int]:
    """The slots of a template, by the rules for known headers, else by the classes at its front."""
    r = roles(tokens)
    return r if r[0] else slots(tokens)


#: How many tokens of a line its header may have, with those behind it that the rules look at.
HEADER = 24


def layout(masked: Column) -> Column:
    """What each token of a header means to its layout: a word is any word, all else is itself.

    Keys (``key=`` and ``"key":``) are layout too. Lines of keys and values are header up to their end, others for ``HEADER`` tokens.
    """
    word = lambda t: t.rlike(PLAIN)
    at = lambda i: F.coalesce(F.get(masked, i), F.lit(""))
    keyed = (at(F.lit(0)) == "{") | (at(F.lit(1)) == "=")
    key = lambda i: keyed & ((at(i + 1) == "=") | ((at(i - 1) == '"') & (at(i + 1) == '"') & (at(i + 2) == ":")))
    kinds = F.transform(masked, lambda t, i: F.when(word(t) & ~key(i), "w").otherwise(t))
    return F.when(keyed, kinds).otherwise(F.slice(kinds, 1, HEADER))


def partition(shapes: DataFrame) -> DataFrame:
    """Iterative partitioning of distinct masked lines.

    ``shapes(kind, shape, masked array<string>, weight bigint)`` gets ``n``, ``v2``, ``v3`` and ``v4``: the token count, the value at
    the least variable position among lines of that count, the value that a bijection between two positions of that
    partition gives it, and what stands at those header positions at which lines of that partition still differ in layout.
    Everything is counted by aggregation; no partition is ever gathered.
    """
    s = shapes.withColumn("n", F.size("masked"))

    def variety(parts: list[str], df: DataFrame) -> DataFrame:
        return df.select(*parts, F.posexplode("masked").alias("pos", "tok")).distinct().groupBy(*parts, "pos").agg(F.count(F.lit(1)).alias("kinds"))

    least = variety(["n"], s).groupBy("n").agg(F.min(F.struct("kinds", "pos")).alias("m")).select("n", F.col("m.pos").alias("p2"))
    s2 = s.join(least, "n").withColumn("v2", F.get("masked", F.col("p2"))).drop("p2")
    # the two first positions that share the commonest number of kinds above one
    kinds = variety(["n", "v2"], s2).where("kinds > 1")
    per = kinds.groupBy("n", "v2", "kinds").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("a"), F.sort_array(F.collect_set("pos")).alias("all"))
    pick = per.where("k > 1").groupBy("n", "v2").agg(F.max_by(F.struct(F.col("a"), F.get("all", F.lit(1)).alias("b")), F.struct("k", (-F.col("kinds")).alias("x"))).alias("p")).select("n", "v2", "p.a", "p.b")
    s3 = s2.join(pick, ["n", "v2"], "left").withColumns({"ta": F.get("masked", F.col("a")), "tb": F.get("masked", F.col("b"))})
    pairs = s3.where("ta is not null and tb is not null").select("n", "v2", "ta", "tb").distinct()
    one_a = pairs.groupBy("n", "v2", "ta").agg(F.count(F.lit(1)).alias("na"))
    one_b = pairs.groupBy("n", "v2", "tb").agg(F.count(F.lit(1)).alias("nb"))
    both = pairs.join(one_a, ["n", "v2", "ta"]).join(one_b, ["n", "v2", "tb"])
    # one to one: split by the value; one to many: by the side that stands alone; many to many: no split
    ways = both.select("n", "v2", "ta", "tb", F.when(F.col("nb") == 1, F.col("ta")).when(F.col("na") == 1, F.col("tb")).otherwise(F.lit("")).alias("v3"))
    s4 = cut(s3.join(ways, ["n", "v2", "ta", "tb"], "left").select("kind", "shape", "masked", "weight", "n", "v2", F.coalesce("v3", F.lit("")).alias("v3"), layout(F.col("masked")).alias("front")))
    # a leaf whose headers mix layouts is split once more, at just those positions
    leaf = ["n", "v2", "v3"]
    front = s4.select(*leaf, F.posexplode("front").alias("pos", "tok"))
    mixed = front.groupBy(*leaf, "pos").agg((F.min("tok") != F.max("tok")).alias("mixed"), F.count(F.lit(1)).alias("k"))
    # shorter fronts too: a position that only some lines count as header
    total = s4.groupBy(*leaf).agg(F.count(F.lit(1)).alias("all"))
    mixed = mixed.join(total, leaf).where(F.col("mixed") | (F.col("k") < F.col("all"))).groupBy(*leaf).agg(F.sort_array(F.collect_list("pos")).alias("at"))
    v4 = F.coalesce(F.transform("at", lambda p: F.coalesce(F.get("front", p), F.lit(""))), F.array().cast("array<string>"))
    return s4.join(mixed, leaf, "left").select("kind", "shape", "masked", "weight", *leaf, v4.alias("v4"))


LEAF = ["n", "v2", "v3", "v4"]


def templates(parts: DataFrame) -> DataFrame:
    """One row per leaf: its template, a star where the lines differ, and how many lines it stands for."""
    at = parts.select(*LEAF, "weight", F.posexplode("masked").alias("pos", "tok"))
    slot = at.groupBy(*LEAF, "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"), F.sum("weight").alias("lines"))
    star = F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("*").alias("tok"))
    return slot.groupBy(*LEAF).agg(F.transform(F.array_sort(F.collect_list(star)), lambda x: x["tok"]).alias("template"), F.max("lines").alias("lines"))


#: A token that counts as a word in a layout: no sign and no class other than that of a name.
PLAIN = r"^(<ID>|\w.*)$"


def _leaf_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [read(list(t)) for t in pdf["template"]]
        yield pd.concat([pdf[LEAF].reset_index(drop=True), pd.DataFrame(out, columns=["time_kind", "time_pos", "level_pos", "comp_pos", "head_pos"])], axis=1)


def leaf_slots(leaves: DataFrame) -> DataFrame:
    """Where each leaf of ``templates`` has its time, level and component; leaves that open no entry are left out."""
    return leaves.select(*LEAF, "template").mapInPandas(_leaf_rows, "n int, v2 string, v3 string, v4 array<string>, " + ROLES).where("time_kind is not null")


def opening_lines(texts: DataFrame) -> DataFrame:
    """Lines that may open an entry: ``log_kind, record_id, started_at, line_from, line, tokens, masked, shape``."""
    lines = (
        texts.where("record_id is not null and text is not null and text <> ''")
        .select("log_kind", "record_id", "started_at", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .withColumn("line", F.regexp_replace("raw", r"(?<!\s)\s+$", ""))
        .withColumn("body", F.regexp_replace("line", r"^(==|--)\d+(==|--) ?", ""))
        .where(F.col("body").rlike(r"^\S") & ~F.col("line").rlike(r"^=== .*===$"))
        .withColumn("tokens", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)))
        .withColumn("masked", F.transform("tokens", mask))
    )
    shape = F.md5(F.concat_ws("\u0001", "log_kind", "masked"))
    return lines.select("log_kind", "record_id", "started_at", (F.col("pos") + 1).cast("bigint").alias("line_from"), "line", "tokens", "masked", shape.alias("shape"))


def log_entries(texts: DataFrame, messages: bool = True) -> DataFrame:
    """Entries of ``texts(log_kind string, record_id bigint, text string, started_at timestamp)``, one row per record and kind.

    Gives ``log_kind, record_id, line_from, entry_time, log_level, component`` and, with ``messages``, the ``message`` over all
    lines of the entry. Times are UTC, whatever the time zone of the session.
    """
    lines = cut(opening_lines(texts))
    shapes = lines.groupBy("shape").agg(F.first("log_kind").alias("kind"), F.first("masked").alias("masked"), F.count(F.lit(1)).alias("weight"))
    parts = cut(partition(shapes))
    known = cut(parts.join(leaf_slots(templates(parts)), LEAF).select("shape", "time_kind", "time_pos", "level_pos", "comp_pos", "head_pos"))
    # one shape may be a third of all lines: such shapes meet their slots by broadcast
    got = skew_join(lines.drop("masked"), known, "shape", heavy_of(parts, "shape", "weight", lines.count()))
    t = lambda c, k=0: F.get("tokens", F.col(c) - 1 + k)
    utc = lambda x: F.timestamp_add("SECOND", F.unix_seconds(x), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
    day, clock = F.substring(utc(F.col("started_at")), 1, 10), F.regexp_replace(t("time_pos", 1), ",", ".")
    year = F.substring(day, 1, 4)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), t("time_pos")).cast("string"), 2, "0")
    dashed = F.regexp_replace(t("time_pos"), r"^(\d{4})[/.](\d\d)[/.]", "$1-$2-")
    # a time without a zone is UTC
    as_time = lambda c: F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$") & c.rlike(":"), c).otherwise(F.concat(c, F.lit("Z"))).try_cast("timestamp")
    kind = F.col("time_kind")
    when = (
        F.when(kind == "ts", as_time(F.regexp_replace(dashed, ",", ".")))
        .when(kind == "date", as_time(F.concat(dashed, F.lit(" "), clock)))
        .when(kind == "epoch", F.timestamp_seconds(t("time_pos").try_cast("bigint")))
        .when(kind == "epochms", F.timestamp_millis(t("time_pos").try_cast("bigint")))
        .when(kind == "clock", as_time(F.concat(day, F.lit(" "), F.regexp_replace(t("time_pos"), ",", "."))))
        .when(kind == "month", as_time(F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(t("time_pos", 1), 2, "0"), F.lit(" "), F.regexp_replace(t("time_pos", 2), ",", "."))))
        .when(kind == "letterdate", as_time(F.concat(year, F.lit("-"), F.substring(t("time_pos"), 2, 2), F.lit("-"), F.substring(t("time_pos"), 4, 2), F.lit(" "), clock)))
    )
    said = F.lower(F.when(kind == "letterdate", F.substring(t("level_pos"), 1, 1)).otherwise(t("level_pos")))
    level = F.coalesce(*[F.when(said.isin(words), name) for name, words in LEVELS.items()], F.lit(""))
    # tokens lose white space, which is all that stands between them: each is the first of its text behind the one before
    behind = F.expr("substring(line, aggregate(slice(tokens, 1, head_pos), 1, (at, t) -> locate(t, line, at) + length(t)))")
    out = got.select(
        "log_kind", "record_id", "line_from",
        F.coalesce(utc(when), F.lit("")).alias("entry_time"),
        level.alias("log_level"),
        F.regexp_replace(F.coalesce(t("comp_pos"), F.lit("")), r"^(==|--)(\d+)(==|--)$", "$2").alias("component"),
        *([F.regexp_replace(behind, r"^[\]|>):\s\-]+", "").alias("first")] if messages else []),
    )
    return with_messages(out, texts) if messages else out.dropDuplicates(["log_kind", "record_id", "line_from"])


def with_messages(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries with ``message``: ``first``, what their first line has behind its header, and all lines up to the next entry.

    Process numbers before the lines of a memory log and white space behind lines are left out, as are banners, which name
    what comes next. A record's entries are put together with its text, so nothing is gathered that is larger than the text.
    """
    rest = [c for c in entries.columns if c not in ("log_kind", "record_id", "first")]
    own = entries.groupBy("log_kind", "record_id").agg(F.array_sort(F.collect_set(F.struct(*rest, "first"))).alias("own"))
    j = own.join(texts.where("record_id is not null").select("log_kind", "record_id", "text").dropDuplicates(["log_kind", "record_id"]), ["log_kind", "record_id"])
    # lines are bound once, else the text would be split again for every entry
    lines = F.transform(F.array(F.split("text", "\n")), lambda all: F.transform("own", lambda e, i: F.struct(*[e[c].alias(c) for c in [*rest, "first"]], F.slice(all, e["line_from"].cast("int") + 1, (F.coalesce(F.get("own", i + 1)["line_from"], F.size(all) + 1) - e["line_from"] - 1).cast("int")).alias("more"))))[0]
    e = j.select("log_kind", "record_id", F.explode(lines).alias("e")).select("log_kind", "record_id", "e.*")
    bare = F.transform("more", lambda x: F.regexp_replace(F.regexp_replace(x, r"^(==|--)\d+(==|--) ?", ""), r"(?<!\s)\s+$", ""))
    more = F.filter(F.zip_with("more", bare, lambda x, y: F.when(~x.rlike(r"^=== .*===\s*$"), y)), lambda x: x.isNotNull())
    text = F.rtrim(F.array_join(F.concat(F.array("first"), more), "\n"), F.lit("\n"))
    return e.select("log_kind", "record_id", *rest, text.alias("message"))


def template_report(texts: DataFrame) -> DataFrame:
    """Leaf templates with the lines they cover, whether they open entries, and where they have which slot (0: nowhere)."""
    lines = cut(opening_lines(texts).select("log_kind", "masked", "shape"))
    parts = cut(partition(lines.groupBy("shape").agg(F.first("log_kind").alias("kind"), F.first("masked").alias("masked"), F.count(F.lit(1)).alias("weight"))))
    leaves = cut(templates(parts))
    slots_ = leaf_slots(leaves).select(*LEAF, "time_kind", "time_pos", "level_pos", "comp_pos")
    j = leaves.join(slots_, LEAF, "left")
    at = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.array_join("template", " ").alias("template"), F.col("n").cast("bigint").alias("tokens"), "lines", F.col("time_kind").isNotNull().alias("opens"), at("time_pos"), at("level_pos"), at("comp_pos"))
