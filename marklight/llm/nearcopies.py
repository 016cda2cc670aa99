"""Near-duplicate records with small edits: Golay-code fuzzy hashing, and the exact pairs at lower limits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.llm.groups import connected_groups
from marklight.llm.setjoin import similar_records
from marklight.operators.cells import candidate_pairs, ranked_sets, set_classes, verified
from marklight.session import cut, free, latest, table

GENERATOR = 0b101011100011  # of the binary Golay code with 23 bits: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENT = 23


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """The error of at most three bits that each of the 2048 syndromes stands for; the code is perfect."""
    out = np.zeros(2048, dtype=np.int64)
    bits = [1 << i for i in range(SEGMENT)]
    words = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]
    w = np.array(words, dtype=np.int64)
    out[_syndrome(w)] = w
    return out


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(SEGMENT - 1, 10, -1):
        v ^= np.where((v >> i) & 1, GENERATOR << (i - 11), 0)
    return v


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit vector."""
    return (v ^ _errors()[_syndrome(v)]) >> 11


def nearby_indices(v: np.ndarray) -> np.ndarray:
    """Indices of the codewords near each vector, as a row of 24: its own and those of all vectors one bit away (six
    different ones at most). Two vectors at most two bits apart always have one in common."""
    return np.stack([codeword_index(v), *(codeword_index(v ^ (1 << i)) for i in range(SEGMENT))], axis=1)


def word_shingles(text: Column, words: int = 5) -> Column:
    """Distinct hashes of every ``words`` consecutive words (ASCII letters, digits, underscores); empty if there are fewer."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))

    def shingles(w: Column) -> Column:
        return F.when(F.size(w) >= words, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words))))).otherwise(F.array().cast("array<bigint>"))

    # bound by a one-element transform: inside the inner lambda the extraction would run again for every shingle
    return F.transform(F.array(found), shingles)[0]


def _fingerprints(segments: int, seed: int):
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 63, segments * SEGMENT, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, segments * SEGMENT, dtype=np.uint64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = (1 << np.arange(SEGMENT)).astype(np.int64)
        for pdf in batches:
            ids, codes, keys = [], [], []
            for key, items in zip(pdf["id"], pdf["items"]):
                x = np.asarray(items, dtype=np.int64).view(np.uint64)
                least = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(x), 4096):  # whole texts, in blocks
                    part = x[at : at + 4096, None] * mul + add
                    part ^= part >> np.uint64(32)
                    np.minimum(least, (part * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=least)
                # one bit of each minimum: two sets agree on it with probability (1 + similarity) / 2
                least ^= least >> np.uint64(29)
                bits = ((least * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64).reshape(segments, SEGMENT)
                code = bits @ weight
                near = [np.unique(k) for k in nearby_indices(code)]
                own = []
                for s in range(segments):  # neighbouring segments join to one key of 24 bits
                    t = (s + 1) % segments
                    own.append(((s << 24) | (near[s][:, None] << 12) | near[t][None, :]).ravel())
                ids.append(key)
                codes.append(code.tolist())
                keys.append(np.concatenate(own).tolist())
            yield pd.DataFrame({"id": ids, "code": codes, "keys": keys})

    return rows


def golay_pairs(sets: DataFrame, threshold: float = 0.8, segments: int = 16, seed: int = 7, bucket_rows: int = 200) -> DataFrame:
    """Pairs ``a < b`` of records with ``similarity`` of at least ``threshold``: ``sets(id, items array<bigint>)``, each set once.

    The fingerprint has ``segments`` times 23 bits, each from one minimum over the set. A segment decodes to the indices of
    nearby Golay codewords; segments that differ in two bits at most share one. Two neighbouring segments make one key, so
    that unrelated records meet in about one of 12,000 cases a key; by the pigeonhole principle a pair with fewer than
    1.5 errors a segment always has such neighbours, others nearly always (README gives the measured recall).
    Candidates are checked by fingerprint distance, then on the whole sets. A bucket of more than ``bucket_rows`` records isn't
    joined with itself: the records of all such buckets are joined exactly by their rare elements (``candidate_pairs``), which
    finds every pair the buckets would have given.
    """
    some = sets.where("size(items) > 0").select("id", "items")
    prints = cut(some.mapInPandas(_fingerprints(segments, seed), "id bigint, code array<bigint>, keys array<bigint>"))
    keys = cut(prints.select("id", F.explode("keys").alias("key")))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # keys that one record has are most of them: they go before anything is joined
    live = cut(keys.join(shared, "key"))
    n_bits = segments * SEGMENT
    wrong = (1 - threshold) / 2
    limit = n_bits * wrong + 4 * (n_bits * wrong * (1 - wrong)) ** 0.5
    small = live.where(F.col("k") <= bucket_rows)
    a, b = small.select("key", F.col("id").alias("a")), small.select("key", F.col("id").alias("b"))
    cand = cut(a.join(b, "key").where("a < b").select("a", "b").distinct())
    codes = prints.select("id", "code")
    far = cand.join(codes.select(F.col("id").alias("a"), F.col("code").alias("ca")), "a").join(codes.select(F.col("id").alias("b"), F.col("code").alias("cb")), "b")
    bits = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = far.where(bits <= limit).select("a", "b")
    full = close.join(some.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(some.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    inter = F.size(F.array_intersect("ia", "ib"))
    found = full.select("a", "b", (inter / (F.size("ia") + F.size("ib") - inter)).alias("similarity")).where(F.col("similarity") >= threshold)
    crowd = cut(live.where(F.col("k") > bucket_rows).select("id").distinct())
    made = [prints, keys, live, cand, crowd]
    if not crowd.isEmpty():
        ranked = ranked_sets(some.join(crowd, "id", "left_semi").select(F.lit("r").alias("side"), "id", "items"))
        more = candidate_pairs(ranked, threshold)
        found = found.unionByName(verified(more, ranked, threshold).select("a", "b", "similarity")).dropDuplicates(["a", "b"])
        made += [ranked, more]
    found = cut(found)
    free(*made)
    return found


def near_copy_groups(sets: DataFrame, threshold: float = 0.8, bucket_rows: int = 200) -> DataFrame:
    """One row per record with a partner: ``id, class_id, group_id``; equal sets share a class, linked classes a group.

    ``sets(id, items)``, one row a record. Null and empty sets (texts with fewer words than a shingle) are in no group.
    """
    reps, member = set_classes(sets.select(F.lit("r").alias("side"), "id", "items"))
    pairs = golay_pairs(reps.select("id", "items"), threshold, bucket_rows=bucket_rows)
    linked = connected_groups(pairs)
    several = member.groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
    j = member.join(several, "cls").join(linked.withColumnRenamed("node", "cls"), "cls", "left").where("k > 1 or group is not null")
    return j.select("id", F.col("cls").alias("class_id"), F.coalesce("group", "cls").alias("group_id"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    c = latest(table(spark, d, "source_files").select("file_id", "content", "received_at"), "file_id")
    return c.select(F.lit("r").alias("side"), F.col("file_id").alias("id"), word_shingles(F.decode("content", "ISO-8859-1")).alias("items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """At a limit of 0.6 Golay keys can't both be complete and selective (README): the exact join gives the pairs."""
    return similar_records(_files(spark, d), 0.6).select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p3_golay_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copy_groups(_files(spark, d)).withColumnRenamed("id", "file_id")


QUERIES = {"p3_found": p3_found, "p3_golay_groups": p3_golay_groups}
# the text form of a binary shows all but plain ASCII as \\xNN: none of these bytes is part of a word
_WORDS = """with l as (select file_id, arg_max(content, received_at) as c from source_files where file_id is not null group by file_id),
w as (select file_id, regexp_extract_all(regexp_replace(c::varchar, '\\\\x[0-9A-F]{2}', ' ', 'g'), '[A-Za-z0-9_]+') as w from l where c is not null),
s as (select distinct file_id, array_to_string(w[i:i + 4], ' ') as s from (select file_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
n as (select file_id, count(*) as n from s group by file_id),
o as (select a.file_id as a, b.file_id as b, count(*) as k from s a join s b on a.s = b.s and a.file_id < b.file_id group by all) """
SQL = {"p3_found": _WORDS + "select a as file_id_a, b as file_id_b from o join n x on x.file_id = a join n y on y.file_id = b where k / (x.n + y.n - k) >= 0.6::double"}
