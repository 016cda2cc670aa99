import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklight.functions import ctok
from marklight.operators import detection, fingerprint as fp, matches, similarity as sim


def units_of(spark, docs):
    return fp.text_units(spark.createDataFrame(docs, "id bigint, text string, hash string, n int"), 6)


def docs():
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 15))) for _ in range(12)]
    out = [(i, "\n".join(r.sample(lines, 4)), "x", 1) for i in range(24)]
    return out + [(100, out[0][1], None, None), (101, None, None, None), (102, "", None, None), (103, "a b", None, None), (0, out[0][1], "x", 1)][:4]


def brute(rows, threshold):
    recs = {}
    for i, text, *_ in rows:
        units = [u.split() for u in (text or "").split("\n") if len(u.split()) >= 6]
        if units:
            recs[i] = [{tuple(u[k : k + 5]) for k in range(len(u) - 4)} for u in units]
    bag = {}
    for i in sorted(recs):
        bag.setdefault(tuple(sorted(map(str, map(sorted, recs[i])))), i)
    reps = sorted(bag.values())
    j = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    out = {}
    for x in reps:
        for y in reps:
            if x < y:
                wa, wb = set().union(*recs[x]), set().union(*recs[y])
                best = lambda p, q: sum(max(j(a, b) for b in q) for a in p) / len(p)
                s = 0.65 * j(wa, wb) + 0.35 * (best(recs[x], recs[y]) + best(recs[y], recs[x])) / 2
                if s >= threshold:
                    out[x, y] = s
    return out


@pytest.mark.parametrize("threshold", [0.45, 0.7])
def test_combined_score_is_brute_force(spark, threshold):
    rows = docs()
    reps, member = sim.representatives(units_of(spark, rows))
    got = {(r.a, r.b): r.similarity_percent / 100 for r in sim.similar_records(reps, threshold).collect()}
    want = brute(rows, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and got
    assert {r.id: r.class_id for r in member.collect()}[100] == 0


def test_empty(spark):
    reps, _ = sim.representatives(units_of(spark, [(1, None, None, None)]))
    assert sim.window_pairs(reps, 0.7).count() == 0


def test_window_wider_than_unit(spark):
    u = units_of(spark, [(1, "a b c d e f", None, None)])
    assert fp.windows(u, 7).count() == 0 and fp.windows(u, 0).count() == 0 and fp.windows(u, 5).count() == 2


def test_evidence_spans(spark):
    code = b"int f(int a) { a = a + 1; a = a + 1; a = a + 1;\n return a; }\n"
    f = spark.createDataFrame([(1, bytearray(code)), (2, bytearray(b"/* x\n */ " + code)), (3, None)], "id int, content binary")
    u = fp.c_units(f, 10)
    p = spark.createDataFrame([(1, 2)], "a int, b int")
    e = sim.evidence(p, u).collect()
    assert e and all(len(r.spans_a) == len(r.spans_b) and r.spans_b[0].start == r.spans_a[0].start + 9 and len(r.hash8) == 8 for r in e)
    assert [r.match_no for r in sorted(e, key=lambda r: r.hash)] == list(range(1, len(e) + 1))
    data = {1: code, 2: b"/* x\n */ " + code}
    for r in sim.evidence(p, u, f).collect():
        for key, s in [(1, s) for s in r.spans_a] + [(2, s) for s in r.spans_b]:
            for pos, line, col in ((s.start, s.start_line, s.start_col), (s.end, s.end_line, s.end_col)):
                before = data[key][:pos]
                assert (line, col) == (before.count(b"\n") + 1, pos - (before.rfind(b"\n") + 1) + 1)
            assert bytes(s.snippet) == data[key][s.start : s.end].replace(b"\n", b" ").strip()


def test_evidence_is_looked_up_in_blocks(spark, monkeypatch):
    for name, value in (("LEAST", 60), ("MOST", 90)):  # several blocks
        monkeypatch.setattr(f"marklight.operators.matches.{name}", value)
    r = random.Random(8)
    parts = [b"x = y + 1;", b"if (x > 2) { y--; }\n", b"z(x, \"s\");", b"while (y) y = x & 4;\n", b"y += x * y - 3;", b"x = !z(y);\n\n", b"do { x++; } while (x != 'c');"]
    codes = {i: b"/* \n */" * (i % 3) + b"".join(b"int f%d(int x, int y)\n { " % k + b" ".join(r.choices(parts, k=r.randint(3, 9))) + b" }\n" for k in range(r.randint(1, 3))) for i in range(-4, 14)} | {20: b"int x;", 21: None}
    spans = {}
    for i, code in codes.items():
        for *_, t, starts, ends in ctok.function_tokens(code):
            for k in range(len(t) - 4 if len(t) >= 20 else 0):
                spans.setdefault(i, {}).setdefault(hashlib.sha256(" ".join(t[k : k + 5]).encode()).hexdigest(), []).append((starts[k], ends[k + 4]))

    def places(i, h):
        out, code = [], codes[i]
        for s, e in sorted(spans[i][h]):
            out[-1:] = [(out[-1][0], max(out[-1][1], e))] if out and s <= out[-1][1] else [*out[-1:], (s, e)]
        at = lambda p: (code.count(b"\n", 0, p) + 1, p - code.rfind(b"\n", 0, p))
        text = lambda s, e: code[s:e].replace(b"\n", b" ").strip()
        return [(s, e, *at(s), *at(e), text(s, e) if len(text(s, e)) <= 80 else text(s, e)[:77] + b"...") for s, e in out]

    pairs = [(i, j) for i in codes for j in codes if i < j and r.random() < 0.5 or i == j + 7]
    want = {(a, b, no): (h, places(a, h), places(b, h)) for a, b in pairs for no, h in enumerate(sorted(spans.get(a, {}).keys() & spans.get(b, {}).keys()), 1)}
    assert len(want) > 500 and max(len(x[1]) for x in want.values()) > 1
    row = lambda x: (x.hash, *([(*s[:6], bytes(s.snippet)) for s in side] for side in (x.spans_a, x.spans_b)))
    for kind, name in (("int", int), ("bigint", int), ("string", str)):
        f = spark.createDataFrame([(name(i), c and bytearray(c)) for i, c in codes.items()], f"id {kind}, content binary")
        p = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}")
        df = sim.evidence(p, fp.c_units(f), f)
        assert kind == "string" or "hashpartitioning(a" not in df._jdf.queryExecution().toString()  # rows of windows are not shuffled
        rows = df.collect()
        assert len(rows) == len(want) and {(int(x.a), int(x.b), x.match_no): row(x) for x in rows} == want and all(x.hash8 == x.hash[:8] for x in rows)
        assert df.schema["a"].dataType == f.schema["id"].dataType and sim.evidence(p.limit(0), fp.c_units(f), f).count() == 0


def test_evidence_of_crowded_files_needs_no_table_of_pairs(spark, monkeypatch):
    for name, value in (("LEAST", 300), ("MOST_OF_FILES", 900), ("PAIRS", 40)):  # several blocks
        monkeypatch.setattr(f"marklight.operators.matches.{name}", value)
    r = random.Random(9)
    parts = [b"x = y + 1;", b"if (x > 2) { y--; }\n", b"z(x, \"s\");", b"while (y) y = x & 4;\n", b"x = y + 1; x = y + 1;\t\x0b", b"/* \n" + b"long " * 30 + b"*/ y += x;"]
    funcs = [b"int f%d(int x, int y)\n { " % k + b" ".join(r.choices(parts, k=r.randint(4, 9))) + b" }\n" for k in range(9)]
    codes = {i: b"/* \n */" * (i % 3) + b"".join(r.choices(funcs, k=r.randint(2, 6))) for i in range(-3, 40)} | {50: b"int x;", 51: None, 52: b""}
    codes[60] = codes[5]
    for kind in ("int", "bigint"):
        f = spark.createDataFrame([(i, c and bytearray(c)) for i, c in codes.items()], f"id {kind}, content binary")
        reps, _ = sim.classes(fp.c_units(f))
        pairs = sim.similar_records(sim.records(reps), 0.7).select("a", "b")
        columns = (*sim.EVIDENCE, "n_spans_a", "n_spans_b")
        for hexed in (False, True):
            df = sim.similar_evidence(f, fp.c_units(f), 0.7, hexed, columns)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
            want, rows = sim.evidence(pairs, reps, f, hexed=hexed, columns=columns), df.collect()
            assert len(rows) > 2000 and max(len(x.spans_a) for x in rows) > 1 and df.schema.simpleString() == want.schema.simpleString()
            assert sorted(rows, key=lambda x: x[:3]) == sorted(want.collect(), key=lambda x: x[:3])
        assert sim.similar_evidence(f.where("id > 49"), fp.c_units(f.where("id > 49")), 0.7).count() == 0


def test_shared_windows_a_few_at_a_time(monkeypatch):
    r = random.Random(2)
    have = {i: sorted(r.sample(range(30), r.randint(1, 12))) for i in (5, 3, 9, -2, 7)}
    a, b = np.array([(i, j) for i in (*have, 4) for j in (*have, 4) if i != j]).T
    parts = [np.array([*have]), np.array([len(x) for x in have.values()]), np.array(sum(have.values(), []))]
    want = sorted((i, j, no, c, c) for i in have for j in have if i != j for no, c in enumerate(sorted({*have[i]} & {*have[j]}), 1))
    for some in (3, 20, 10_000):
        monkeypatch.setattr("marklight.operators.matches.SENT", some)
        got = [x for a_, b_, no, left, right in matches._shared(a, b, *parts, 30) for x in zip(a_, b_, no, parts[2][left], parts[2][right])]
        assert sorted(got) == want


def test_queries_with_all_records(spark):
    reps, _ = sim.representatives(units_of(spark, docs()))
    want = brute(docs(), 1e-12)
    for pick in (lambda i: i % 5 == 0, lambda i: i >= 0):
        got = {(r.a, r.b): (r.similarity_percent / 100, r.flagged) for r in sim.query_pairs(reps, F.col("id") % 5 == 0 if pick(1) is False else F.lit(True), 0.7).collect()}
        some = {k: v for k, v in want.items() if pick(k[0]) or pick(k[1])}
        assert got.keys() == some.keys() and all(abs(got[k][0] - v) < 1e-9 and got[k][1] == (v >= 0.7 - 1e-9) for k, v in some.items())


def crowd(n=60):
    """Texts of a few lines out of twelve: nearly all share windows."""
    r = random.Random(5)
    lines = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(6, 15))) for _ in range(12)]
    return [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12))), "x", 1) for i in range(n)]


def test_crowded_records_meet_in_blocks(spark, monkeypatch):
    for name, value in (("LEAST", 700), ("MOST", 900)):  # several blocks
        monkeypatch.setattr(f"marklight.operators.blocks.{name}", value)
    reps, _ = sim.representatives(units_of(spark, crowd()))
    df = sim.similar_records(reps, 0.7)
    assert "hashpartitioning(a" not in df._jdf.queryExecution().toString()  # pairs are not shuffled
    want = brute(crowd(), 0.7)
    got = {(r.a, r.b): r for r in df.collect()}
    assert got.keys() == want.keys() and len(got) > 20 and all(abs(got[k].similarity_percent / 100 - want[k]) < 1e-9 and got[k].flagged for k in got)
    sets = {r.id: ([u["hash"] for u in r.units], set(r.windows)) for r in reps.collect()}
    for (a, b), r in got.items():
        (ua, wa), (ub, wb) = sets[a], sets[b]
        assert (r.function_count_a, r.function_count_b, r.exact_matches, r.window_matches, r.window_union) == (len(ua), len(ub), len(set(ua) & set(ub)), len(wa & wb), len(wa | wb))


def test_query_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr("marklight.operators.blocks.LEAST", 700)
    monkeypatch.setattr("marklight.operators.blocks.MOST", 900)
    reps, _ = sim.representatives(units_of(spark, crowd()))
    want = brute(crowd(), 1e-12)
    for query in (F.col("id") % 3 == 0, F.col("id") < 0, F.when(F.col("id") > 9, True)):
        df = sim.query_pairs(reps, query, 0.7)
        assert "hashpartitioning(a" not in df._jdf.queryExecution().toString()
        picked = {r.id for r in reps.where(query).collect()}
        rows = df.collect()
        got = {(r.a, r.b): (r.similarity_percent / 100, r.flagged) for r in rows}
        some = {k: v for k, v in want.items() if picked & {*k}}
        assert len(rows) == len(got) and got.keys() == some.keys() and all(abs(got[k][0] - v) < 1e-9 and got[k][1] == (v >= 0.7 - 1e-9) for k, v in some.items())


def test_blocks_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr("marklight.operators.blocks.LEAST", 700)
    monkeypatch.setattr("marklight.operators.blocks.MOST", 900)
    rows = crowd() + [(60, crowd()[7][1], None, None), (61, None, None, None), (62, "a b", None, None), (-4, crowd()[3][1] + "\n" + crowd()[3][1], None, None)]
    reps, member = sim.unit_texts(units_of(spark, rows))
    assert {r.id: r.class_id for r in member.collect()}[60] == 7
    df = sim.query_pairs(reps, F.col("id") % 3 == 0, 0.7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # not a copy of a block for every block it meets: pairs of blocks are made behind the last shuffle
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")] and "NestedLoop" not in plan
    want = {k: v for k, v in brute(rows, 1e-12).items() if k[0] % 3 == 0 or k[1] % 3 == 0}
    got = {(r.a, r.b): (r.similarity_percent / 100, r.flagged) for r in df.collect()}
    assert df.count() == len(got) > 100 and got.keys() == want.keys() and all(abs(got[k][0] - v) < 1e-9 and got[k][1] == (v >= 0.7 - 1e-9) for k, v in want.items())
    old = sim.query_pairs(sim.representatives(units_of(spark, rows))[0], F.col("id") % 3 == 0, 0.7)
    key = lambda df: sorted((*r[:7], round(r[7], 9), r[8]) for r in df.collect())
    assert key(old) == key(df)


def test_dictionary(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, "a")], "id int, hash string")
    entries = spark.createDataFrame([(7, "a"), (7, "b"), (8, "a")], "entry int, hash string")
    m = detection.dictionary_matches(sets, entries, 0.7)
    assert {(r.id, r.entry): (r.shared, r.jaccard, r.flagged) for r in m.collect()} == {(1, 7): (2, 1.0, True), (1, 8): (1, 0.5, False), (3, 7): (1, 0.5, False), (3, 8): (1, 1.0, True)}
    ids = spark.createDataFrame([(1,), (2,), (4,)], "id int")
    r = {x.id: x for x in detection.detection_results(ids, m, spark.createDataFrame([(4,)], "id int")).collect()}
    assert [x.entry for x in r[1].matches] == [7, 8] and r[2].best_score == 0 and not r[2].parse_error and r[4].parse_error


def test_dictionary_problems(spark):
    d = spark.createDataFrame([(1, "a", "t", "c"), (2, " a ", None, "c"), (3, " ", "t", "")], "row bigint, id string, title string, code string")
    assert sorted(r.problem for r in detection.validate_dictionary(d).collect()) == ["entry 2: title is blank", "entry 3: code is blank", "entry 3: id is blank", "id a is repeated"]
    assert [r.problem for r in detection.validate_dictionary(d.limit(0)).collect()] == ["the dictionary is empty"]
