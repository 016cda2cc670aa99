import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklight.llm import groups, nearcopies, setjoin, spans, terms
from marklight.operators import cells


def brute_runs(rows, span):
    own = {}
    for i, b in rows:
        for p in range(len(b or b"") - span + 1):
            own.setdefault(b[p : p + span], set()).add(i)
    out = set()
    for i, b in {(i, b) for i, b in rows if b}:
        cover = [False] * len(b)
        for p in range(len(b) - span + 1):
            if len(own[b[p : p + span]]) > 1:
                cover[p : p + span] = [True] * span
        p = 0
        while p < len(b):
            q = p
            while q < len(b) and cover[q]:
                q += 1
            if q > p:
                out.add((i, p, q))
            p = q + 1
    return out


def texts(seed, width, n=40):
    r = random.Random(seed)
    lines = [bytes(r.choice(b"abc ;") for _ in range(r.choice([0, 1, 3, width, 3 * width]))) + r.choice([b"\n", b"\r\n", b"\n"]) for _ in range(12)]
    out = []
    for i in range(n):
        b = b"".join(r.choice(lines) for _ in range(r.randint(0, 12)))
        if r.random() < 0.5 and out:
            o = r.choice(out)[1]
            a = r.randint(0, len(o))
            b = b[: r.randint(0, len(b))] + o[a : a + r.randint(0, 60)] + b[-5:]
        out.append((i, b))
    return out + [(n, out[3][1]), (n + 1, b"")]


@pytest.mark.parametrize("seed,width", [(1, 6), (2, 15), (3, 40)])
def test_shared_runs_are_brute_force(spark, seed, width):
    rows = texts(seed, width)
    df = spark.createDataFrame([(i, bytearray(b), 1, 2) for i, b in rows] + [(rows[0][0], bytearray(rows[0][1]), 1, 2), (999, None, None, None)], "id bigint, content binary, start int, unit int")
    want = brute_runs(rows, 20)
    assert {(r.id, r.start, r.end) for r in spans.shared_runs(df, 20).collect()} == want and want
    # contents in pieces: what a block can't see of a long content is nothing it needs
    assert {(r.id, r.start, r.end) for r in spans.shared_runs(df, 20, block=37).collect()} == want


def test_removable_keeps_first(spark):
    a = b"".join(b"line %d of a text\n" % i for i in range(30))
    df = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b"own start\n" + a)), (3, bytearray(b"something else\n" * 3))], "id bigint, content binary")
    assert [tuple(r) for r in spans.shared_runs(df, 60, later_only=True).select("id", "start", "end").collect()] == [(2, 10, 10 + len(a))]


def test_spans_of_nothing(spark):
    assert spans.shared_runs(spark.createDataFrame([], "id bigint, content binary")).count() == 0


@pytest.mark.parametrize("hot", [200_000, 3])
def test_ngrams_are_brute_force(spark, hot):
    r = random.Random(5)
    seqs = [(f"r{r.randint(0, 6)}" if r.random() < 0.9 else None, [r.choice(["a", "a", "b", "c", None]) for _ in range(r.randint(0, 6))] if r.random() < 0.9 else None) for _ in range(60)]
    want = {}
    for rec, terms_ in seqs:
        t = [x for x in terms_ or [] if x is not None]
        for i in range(len(t)):
            for n in range(1, 4):
                if rec is not None and i + n <= len(t):
                    c = want.setdefault(tuple(t[i : i + n]), [0, set()])
                    c[0] += 1
                    c[1].add(rec)
    df = spark.createDataFrame(seqs, "record string, terms array<string>").withColumn("hits", F.lit(1))
    got = {tuple(x.terms): (x.hits, x.records) for x in terms.term_counts(df, 3, hot).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert terms.term_counts(df.limit(0)).count() == 0


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.5, 0.7])
@pytest.mark.parametrize("cell_rows", [200, 3])
def test_similar_sets_are_brute_force(spark, threshold, cell_rows):
    r = random.Random(9)
    base = [[r.randint(0, 30) for _ in range(r.randint(1, 9))] for _ in range(12)]
    rows = []
    for i in range(70):
        s = list(r.choice(base))
        if r.random() < 0.6:
            s[r.randrange(len(s))] = r.randint(0, 30)
        rows.append((r.choice("lr"), i, s + s[:1]))
    rows += [("l", 200, None), ("r", 201, []), ("r", 202, [None]), ("l", None, [1, 2])]
    df = spark.createDataFrame(rows, "side string, id bigint, items array<bigint>").withColumns({"cell": F.lit(1), "k": F.lit(2)})
    sets = {(s, i): {x for x in v or [] if x is not None} for s, i, v in rows if i is not None}
    got = [tuple(x) for x in setjoin.similar_records(df, threshold, True, cell_rows).select("a", "b").collect()]
    want = {(a[1], b[1]) for a in sets for b in sets if a[0] == "l" and b[0] == "r" and sets[a] and sets[b] and jac(sets[a], sets[b]) >= threshold}
    assert set(got) == want and len(got) == len(want)
    one = df.withColumn("side", F.lit("r"))
    got = [tuple(x) for x in setjoin.similar_records(one, threshold, cell_rows=cell_rows).select("a", "b").collect()]
    flat = {i: s for (_, i), s in sets.items()}
    want = {(a, b) for a in flat for b in flat if a < b and flat[a] and flat[b] and jac(flat[a], flat[b]) >= threshold}
    assert set(got) == want and len(got) == len(want)


def test_crowded_cells(spark):
    """A third of the sets alike, the rest over few values: cells are split or joined in blocks, and no pair is lost."""
    r = random.Random(4)
    rows = [(i, r.sample(range(30), 8)) for i in range(300)] + [(1000 + i, [*range(100, 120), 200 + i]) for i in range(150)] + [(2000 + i, [*range(100, 119), 150 + i % 5, 400 + i]) for i in range(20)]
    df = spark.createDataFrame([("r", i, s) for i, s in rows], "side string, id bigint, items array<bigint>")
    got = {tuple(x) for x in setjoin.similar_records(df, 0.7, cell_rows=6).select("a", "b").collect()}
    sets = {i: set(s) for i, s in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and jac(sets[a], sets[b]) >= 0.7} and len(got) > 11_000


def test_few_candidates_without_pairs(spark):
    r = random.Random(8)
    rows = [("r", i, r.sample(range(60), 12)) for i in range(3000)]
    reps, _ = cells.set_classes(spark.createDataFrame(rows, "side string, id bigint, items array<bigint>"))
    assert cells.candidate_pairs(cells.ranked_sets(reps), 0.7).count() < 100_000


def test_class_rows(spark):
    rows = [("r", 1, [1, 2, 3, 4]), ("r", 2, [4, 3, 2, 1, 1]), ("r", 3, [1, 2, 3, 4, 5]), ("r", 4, [9]), ("r", 5, None)]
    df = spark.createDataFrame(rows, "side string, id bigint, items array<bigint>")
    assert sorted(tuple(x) for x in setjoin.class_rows(df, 0.7).collect()) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]


def test_golay_code():
    r = np.random.default_rng(1)
    v = r.integers(0, 1 << 23, 2000)
    word = v ^ nearcopies._errors()[nearcopies._syndrome(v)]
    assert (nearcopies._syndrome(word) == 0).all() and max(bin(int(a ^ b)).count("1") for a, b in zip(v, word)) <= 3
    for flips in (1, 2):
        w = v.copy()
        for k in range(len(v)):
            for b in r.choice(23, flips, replace=False):
                w[k] ^= 1 << int(b)
        assert all(set(a) & set(b) for a, b in zip(nearcopies.nearby_indices(v), nearcopies.nearby_indices(w)))
    assert max(len(set(a)) for a in nearcopies.nearby_indices(v)) <= 6


def test_golay_recall(spark):
    r = random.Random(4)
    rows, want = [], set()
    for g in range(60):
        words = [f"w{r.randint(0, 3000)}" for _ in range(200)]
        edited = list(words)
        for _ in range(r.randint(0, 4)):
            edited[r.randrange(200)] = "edit"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(edited))]
    sh = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    want = {(2 * g, 2 * g + 1) for g in range(60) if jac(sh[2 * g], sh[2 * g + 1]) >= 0.8}
    rows += [(900, None), (901, ""), (902, "too few words")]
    sets = spark.createDataFrame(rows, "id bigint, text string").select("id", nearcopies.word_shingles(F.col("text")).alias("items"))
    got = {r_.id: r_.group_id for r_ in nearcopies.near_copy_groups(sets).collect()}
    found = {(a, b) for a, b in want if a in got and got[a] == got.get(b)}
    assert len(found) >= 0.97 * len(want) > 30 and set(got) <= {x for p in want for x in p}
    # every bucket counts as crowded: the exact join takes over
    got = {r_.id: r_.group_id for r_ in nearcopies.near_copy_groups(sets, bucket_rows=1).collect()}
    assert len({(a, b) for a, b in want if a in got and got[a] == got.get(b)}) >= len(found)


def test_shingles(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a, b; c--d e f"), (3, "a b c d"), (4, None), (5, "a b c d e a b c d e")], "id int, t string").select("id", nearcopies.word_shingles(F.col("t")).alias("s"))
    got = {r.id: r.s for r in df.collect()}
    assert got[1] == got[2] and len(got[1]) == 2 and got[3] == [] and not got[4] and len(got[5]) == 5


def test_groups(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(200)]
    rows = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(chain + star)] + [("x", "x"), (None, "y"), ("z", None), ("n000", "n001"), ("Zé", "zz")]
    r = random.Random(2)
    r.shuffle(rows)
    for heavy in (100_000, 10):
        df = spark.createDataFrame([(a, b, "c", "d") for a, b in rows], "a string, b string, u string, v string")
        got = {x.node: x.group for x in groups.connected_groups(df, heavy_rows=heavy).collect()}
        assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, **{f"leaf{i}": "hub" for i in range(200)}, "hub": "hub", "Zé": "Zé", "zz": "Zé"}
    assert groups.connected_groups(df.limit(0)).count() == 0
