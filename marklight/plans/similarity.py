"""Fingerprint, similarity and dictionary queries. Text profile over documents, C profile over source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklight.functions.ctok import CLASSES
from marklight.operators import detection, fingerprint as fp, similarity as sim
from marklight.session import cut, latest, table

#: Fixed value: the score from which a pair of C files is flagged.
THRESHOLD = 0.7


def doc_units(spark: SparkSession, d: str) -> DataFrame:
    return fp.text_units(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "source_files").select("file_id", "content", "received_at"), "file_id").select(F.col("file_id").alias("id"), "content")


def file_units(spark: SparkSession, d: str) -> DataFrame:
    return fp.c_units(_contents(spark, d))


def entry_units(spark: SparkSession, d: str) -> DataFrame:
    return fp.c_units(table(spark, d, "dictionary").select(F.col("entry_no").alias("id"), F.encode("code", "utf-8").alias("content")))


def fp_windows(spark, d):
    """Windows and distinct windows of every document with units; a document's windows are counted within one row."""
    u = doc_units(spark, d).where(F.size("tokens") >= fp.WINDOW)
    cuts = F.transform(F.sequence(F.lit(1), F.size("tokens") - (fp.WINDOW - 1)), lambda i: F.xxhash64(F.slice("tokens", i, fp.WINDOW)))
    w = u.select("id", cuts.alias("w")).groupBy("id").agg(F.flatten(F.collect_list("w")).alias("w"))
    return w.select(F.col("id").alias("doc_id"), F.size("w").cast("bigint").alias("windows"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_windows"))


def fp_functions(spark, d):
    h = fp.unit_hashes(doc_units(spark, d))
    return h.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.sum("k").alias("function_count"), F.count(F.lit(1)).alias("distinct_hashes")).withColumnRenamed("id", "doc_id")


def fp_ident_ordinals(spark, d):
    o = fp.ordinals(doc_units(spark, d))
    return o.select(F.col("id").alias("doc_id"), F.col("unit").cast("bigint").alias("unit"), fp.token_hash(F.col("tokens")).alias("hash"))


def fp_operator_classes(spark, d):
    pairs = [F.lit(x) for c, ops in CLASSES.items() for op in ops for x in (op, c)]
    found = F.regexp_extract_all("code", F.lit(OPERATORS), F.lit(0))
    ops = table(spark, d, "dictionary").where("code is not null").select("entry_no", F.explode(found).alias("op"))
    cls = F.try_element_at(F.create_map(*pairs), F.col("op"))
    return ops.groupBy("entry_no", F.coalesce(cls, F.col("op")).alias("operator_class")).agg(F.count(F.lit(1)).alias("n"))


OPERATORS = r"\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&^|]=|[-+*/%&^|~!<>=?:]"


def sim_pairs(spark, d):
    reps, _ = sim.representatives(doc_units(spark, d))
    return sim.window_pairs(reps, 0.7).orderBy(F.desc("score"), "a", "b")


def sim_classes(spark, d):
    _, member = sim.representatives(doc_units(spark, d))
    return member.select(F.col("id").alias("doc_id"), "class_id")


def sim_combined(spark, d):
    reps, _ = sim.representatives(doc_units(spark, d))
    return sim.similar_records(reps, 0.7)


def sim_all_pairs(spark, d):
    """Every document whose id is divisible by 20 with all documents it shares a window with, flagged from a score of 0.7; one
    representative of each class. Pairs that aren't listed score 0."""
    reps, _ = sim.unit_texts(doc_units(spark, d))
    return sim.query_pairs(reps, F.col("id") % 20 == 0, THRESHOLD)


def sim_evidence(spark, d):
    """For pairs of ``sim_pairs`` the windows both have, in order, and how often each document has them."""
    reps, _ = sim.classes(cut(doc_units(spark, d)))
    reps = cut(reps)
    p = sim.window_pairs(cut(sim.records(reps)), 0.7).select("a", "b")
    n = cut(fp.windows(reps).groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")))
    e = p.join(n.select(F.col("id").alias("a"), "hash", F.col("n").alias("n_a")), "a").join(n.select(F.col("id").alias("b"), "hash", F.col("n").alias("n_b")), ["b", "hash"])
    no = F.row_number().over(Window.partitionBy("a", "b").orderBy("hash")).cast("bigint")
    return e.select("a", "b", no.alias("match_no"), F.substring("hash", 1, 8).alias("hash8"), "n_a", "n_b")


def sim_best_match(spark, d):
    reps, _ = sim.representatives(doc_units(spark, d))
    w = sim.window_pairs(reps, 0.5)
    return sim.best_matches(w, reps).select("a", "b", "unit_score")


def sim_trimmed(spark, d):
    """Pairs above a minimum score, counted after trimming."""
    p = sim_combined(spark, d).where("similarity_percent >= 85.0")
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if("flagged").alias("flagged"))


def sim_exact_functions(spark, d):
    """Unit hashes that stand in more than one document."""
    h = fp.unit_hashes(doc_units(spark, d)).select("id", "hash").distinct()
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first_doc")).where("documents > 1")


_U = """with lines as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as unit from documents where text is not null),
u as (select id, unit, regexp_extract_all(line, '[A-Za-z0-9_]+') as t from lines where len(regexp_extract_all(line, '[A-Za-z0-9_]+')) >= 20),
h as (select id, unit, sha256(array_to_string(t, ' ')) as hash from u),
w as (select id, unit, sha256(array_to_string(list_slice(t, i, i + 4), ' ')) as hash from (select id, unit, t, unnest(range(1, len(t) - 3)) as i from u)),
bags as (select id, string_agg(hash, ' ' order by hash) as bag from h group by id),
m as (select id, min(id) over (partition by bag) as class_id from bags),
r as (select distinct id, hash from w where id in (select class_id from m)), n as (select id, count(*) as n from r group by id),
p as (select a.id as a, b.id as b, count(*) as k from r a join r b on a.hash = b.hash and a.id < b.id group by all),
pairs as (select a, b, k as window_matches, x.n + y.n - k as window_union, k / (x.n + y.n - k) as score from p join n x on x.id = a join n y on y.id = b),
ru as (select distinct id, unit, hash from w where id in (select class_id from m)), nu as (select id, unit, count(*) as n from ru group by all), cu as (select id, count(*) as c from u group by id),
i as (select a.id as a, b.id as b, a.unit as ua, b.unit as ub, count(*) as k from ru a join ru b on a.hash = b.hash and a.id < b.id group by all),
j as (select a, b, ua, ub, k / (x.n + y.n - k) as j from i join nu x on x.id = a and x.unit = ua join nu y on y.id = b and y.unit = ub),
ja as (select a, b, sum(m) / any_value(c) as s from (select a, b, ua, max(j) as m from j group by all) join cu on cu.id = a group by a, b),
jb as (select a, b, sum(m) / any_value(c) as s from (select a, b, ub, max(j) as m from j group by all) join cu on cu.id = b group by a, b),
best as (select a, b, (ja.s + jb.s) / 2 as unit_score from ja join jb using (a, b)),
ex as (select a.id as a, b.id as b, count(*) as e from (select distinct id, hash from h) a join (select distinct id, hash from h) b on a.hash = b.hash and a.id < b.id group by all),
comb as (select a, b, x.c as function_count_a, y.c as function_count_b, coalesce(e, 0) as exact_matches, window_matches, window_union,
  100 * least(1, 0.65::double * score + 0.35::double * unit_score) as similarity_percent from pairs join best using (a, b) left join ex using (a, b) join cu x on x.id = a join cu y on y.id = b)
"""


def c_functions(spark, d):
    """Functions and windows of every C file."""
    u = cut(file_units(spark, d))
    return u.groupBy("id").agg(F.count(F.lit(1)).alias("function_count"), F.sum(F.size("tokens")).alias("tokens")).withColumnRenamed("id", "file_id")


def c_similar(spark, d):
    """Pairs of files (one per class of equal ones) whose normalised functions reach a combined score of 0.7."""
    reps, _ = sim.representatives(file_units(spark, d))
    return sim.similar_records(reps, THRESHOLD).select("a", "b", "exact_matches", "window_matches", "window_union", F.round("similarity_percent", 6).alias("similarity_percent"))


def c_classes(spark, d):
    """Class of every file with functions: files with equal bags of normalised functions share one, named by the smallest id."""
    _, member = sim.representatives(file_units(spark, d))
    return member.select(F.col("id").alias("file_id"), "class_id")


def c_evidence(spark, d):
    """For pairs of ``c_similar`` the shared windows in order, with merged spans on both sides: bytes, lines, columns and snippet."""
    files = cut(_contents(spark, d))
    return sim.similar_evidence(files, fp.c_units(files), THRESHOLD, hexed=True, columns=("a", "b", "match_no", "hash8", "n_spans_a", "n_spans_b", "spans_a", "spans_b"))


def _dict(spark, d):
    entries = sim.window_sets(entry_units(spark, d)).select(F.col("id").alias("entry"), "hash")
    return cut(sim.window_sets(file_units(spark, d))), cut(entries)


def c_dict_matches(spark, d):
    """Files against the dictionary's code: best entry, matches and flags per file; files without functions stay as errors."""
    sets, entries = _dict(spark, d)
    ids = table(spark, d, "source_files").select(F.col("file_id").alias("id")).distinct()
    m = cut(detection.dictionary_matches(sets, entries, 0.7))
    errors = ids.join(sets.select("id").distinct(), "id", "left_anti")
    return detection.detection_results(ids, m, errors).select(F.col("id").alias("file_id"), "best_score", "match_count", "flagged", "parse_error")


def c_dict_evidence(spark, d):
    """For flagged matches of ``c_dict_matches`` the shared windows in order, with merged spans in the file and in the entry's code."""
    sets, entries = _dict(spark, d)
    m = cut(detection.dictionary_matches(sets, entries, 0.7)).where("flagged")
    # entries under negative numbers beside the files; 0 is no entry
    code = table(spark, d, "dictionary").where("code is not null").select((-F.col("entry_no") - 1).alias("id"), F.encode("code", "utf-8").alias("content"))
    both = cut(_contents(spark, d).unionByName(code))
    e = sim.evidence(m.select(F.col("id").alias("a"), (-F.col("entry") - 1).alias("b")), cut(fp.c_units(both)), both, hexed=True, columns=("a", "b", "match_no", "hash8", "spans_a", "spans_b"))
    return e.select(F.col("a").alias("file_id"), (-F.col("b") - 1).alias("entry_no"), "match_no", "hash8", F.col("spans_a").alias("spans"), F.col("spans_b").alias("entry_spans"))


def _prints(spark, d):
    f = latest(table(spark, d, "fingerprints").select("fp_id", "window_hashes", "received_at"), "fp_id")
    return f, f.select(F.col("fp_id").alias("id"), F.explode(F.transform("window_hashes", F.lower)).alias("hash")).where("hash is not null").distinct()


def _entry_sets(spark, d):
    return table(spark, d, "dictionary").select(F.col("entry_no").alias("entry"), F.explode(F.transform("window_hashes", F.lower)).alias("hash")).where("hash is not null").distinct()


def dict_matches(spark, d):
    _, sets = _prints(spark, d)
    m = detection.dictionary_matches(sets, _entry_sets(spark, d), 0.2)
    return m.select(F.col("id").alias("fp_id"), F.col("entry").alias("entry_no"), "shared", "jaccard", "flagged")


def dict_results(spark, d):
    f, sets = _prints(spark, d)
    m = detection.dictionary_matches(sets, _entry_sets(spark, d), 0.2)
    ids = f.select(F.col("fp_id").alias("id"))
    r = detection.detection_results(ids, m, ids.join(sets.select("id").distinct(), "id", "left_anti"))
    return r.select(F.col("id").alias("fp_id"), "best_score", "match_count", "flagged", "parse_error").orderBy(F.desc("flagged"), F.desc("best_score"), "fp_id")


def dict_errors(spark, d):
    """Entries that have no windows and can match nothing."""
    return table(spark, d, "dictionary").join(_entry_sets(spark, d).select(F.col("entry").alias("entry_no")).distinct(), "entry_no", "left_anti").select("entry_no", "entry_id")


def dict_summary(spark, d):
    usable = _entry_sets(spark, d).select("entry").distinct().agg(F.count(F.lit(1)).alias("usable")).scalar()
    r = dict_results(spark, d)
    n = table(spark, d, "dictionary").agg(F.count(F.lit(1)).alias("n")).scalar()
    return r.agg(F.count(F.lit(1)).alias("submissions"), F.count_if("flagged").alias("flagged"), F.count_if("parse_error").alias("errors")).select("*", n.alias("entries"), usable.alias("usable_entries"))


def dict_validate(spark, d):
    return detection.validate_dictionary(table(spark, d, "dictionary").select(F.col("entry_no").alias("row"), F.col("entry_id").alias("id"), "title", "code"))


def best_entry_trimmed(spark, d):
    """Fingerprints whose best entry reaches a minimum score."""
    return dict_results(spark, d).where("best_score * 100 >= 50").select("fp_id", "best_score")


QUERIES = {
    "fp_windows": fp_windows, "fp_functions": fp_functions, "fp_ident_ordinals": fp_ident_ordinals, "fp_operator_classes": fp_operator_classes, "sim_pairs": sim_pairs, "sim_classes": sim_classes,
    "sim_combined": sim_combined, "sim_all_pairs": sim_all_pairs, "sim_evidence": sim_evidence, "sim_best_match": sim_best_match, "sim_trimmed": sim_trimmed, "sim_exact_functions": sim_exact_functions,
    "c_functions": c_functions, "c_similar": c_similar, "c_classes": c_classes, "c_evidence": c_evidence, "c_dict_matches": c_dict_matches, "c_dict_evidence": c_dict_evidence,
    "dict_matches": dict_matches, "dict_results": dict_results, "dict_errors": dict_errors, "dict_summary": dict_summary, "dict_validate": dict_validate, "best_entry_trimmed": best_entry_trimmed,
}
_OPS = "case " + " ".join(f"when op in ({', '.join(repr(o) for o in ops)}) then '{c}'" for c, ops in CLASSES.items()) + " else op end"
_D = """with s as (select distinct fp_id as id, lower(h) as hash from fingerprints, unnest(window_hashes) as x(h) where h is not null), e as (select distinct entry_no as entry, lower(h) as hash from dictionary, unnest(window_hashes) as x(h) where h is not null),
n as (select id, count(*) as n from s group by id), k as (select entry, count(*) as m from e group by entry),
m as (select id, entry, count(*) as shared, count(*) / (any_value(n) + any_value(m) - count(*)) as jaccard from s join e using (hash) join n using (id) join k using (entry) group by id, entry),
g as (select id, max(jaccard) as best, count(*) as c, bool_or(jaccard >= 0.2::double) as f from m group by id),
r as (select i.fp_id, coalesce(best, 0) as best_score, coalesce(c, 0) as match_count, coalesce(f, false) as flagged, i.fp_id not in (select id from s) as parse_error from (select distinct fp_id from fingerprints where fp_id is not null) i left join g on g.id = i.fp_id) """
SQL = {
    "fp_windows": _U + "select id as doc_id, count(*) as windows, count(distinct hash) as distinct_windows from w group by id",
    "fp_functions": _U + "select id as doc_id, count(*) as function_count, count(distinct hash) as distinct_hashes from h group by id",
    "fp_operator_classes": "with o as (select entry_no, unnest(regexp_extract_all(code, '" + OPERATORS + "')) as op from dictionary where code is not null) select entry_no, " + _OPS + " as operator_class, count(*) as n from o group by all",
    "sim_pairs": _U + "select * from pairs where score >= 0.7::double",
    "sim_classes": _U + "select id as doc_id, class_id from m",
    "sim_combined": _U + "select *, true as flagged from comb where similarity_percent >= 70 - 1e-9",
    "sim_all_pairs": _U + "select *, similarity_percent >= 70 - 1e-9 as flagged from comb where a % 20 = 0 or b % 20 = 0",
    "sim_evidence": _U + ", o as (select id, hash, count(*) as n from w group by all) select a, b, row_number() over (partition by a, b order by x.hash) as match_no, x.hash[1:8] as hash8, x.n as n_a, y.n as n_b from pairs join o x on x.id = a join o y on y.id = b and y.hash = x.hash where score >= 0.7::double",
    "sim_best_match": _U + "select best.* from best join pairs using (a, b) where score >= 0.5::double",
    "sim_trimmed": _U + "select count(*) as total, count(*) as flagged from comb where similarity_percent >= 85",
    "sim_exact_functions": _U + "select hash, count(distinct id) as documents, min(id) as first_doc from h group by hash having count(distinct id) > 1",
    "dict_matches": _D + "select id as fp_id, entry as entry_no, shared, jaccard, jaccard >= 0.2::double as flagged from m",
    "dict_results": _D + "select * from r",
    "dict_errors": _D + "select entry_no, entry_id from dictionary where entry_no not in (select entry from e)",
    "dict_summary": _D + "select count(*) as submissions, count(*) filter (flagged) as flagged, count(*) filter (parse_error) as errors, (select count(*) from dictionary) as entries, (select count(distinct entry) from e) as usable_entries from r",
    "dict_validate": "with b as (select entry_no, unnest(['id', 'title', 'code']) as f, unnest([entry_id, title, code]) as v from dictionary) select 'entry ' || entry_no || ': ' || f || ' is blank' as problem from b where v is null or not regexp_matches(v, '\\S') "
    "union all select 'id ' || regexp_replace(entry_id, '^\\s+|\\s+$', '', 'g') || ' is repeated' from dictionary where entry_id is not null and regexp_matches(entry_id, '\\S') group by regexp_replace(entry_id, '^\\s+|\\s+$', '', 'g') having count(*) > 1",
    "best_entry_trimmed": _D + "select fp_id, best_score from r where best_score * 100 >= 50",
}
SQL["fp_ident_ordinals"] = _U + ", o as (select id, unit, t, list_filter(t, lambda x: not regexp_matches(x, '^[0-9]')) as ids from u) select id as doc_id, unit, sha256(array_to_string(list_transform(t, lambda x: case when regexp_matches(x, '^[0-9]') then '@NUM' else '@' || len(list_distinct(list_slice(ids, 1, list_position(ids, x)))) end), ' ')) as hash from o"
