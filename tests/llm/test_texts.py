import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklight.llm import mixing, packing, pii, tokens, truncation


def test_truncation(spark):
    r = random.Random(1)
    words = ["quantity", "measured", "reservation", "directory", "counting", "balance", "naïve"]
    rows, want = [], set()
    for i in range(600):
        text = " ".join(r.choice(words) for _ in range(r.randint(3, 30))) + r.choice([".", "\n", "", ".\nbye"])
        if len(text) > 150 and i % 2:
            text = text[:150]
        last = text.rstrip().split()[-1]
        if len(text) == 150 and last.strip(".") not in [*words, "bye"]:
            want.add(i)
        rows.append((i, "s" if i % 3 else None, "f", text))
    extra = [(1000, "u", "f", "all measured counting quan"), (1001, "u", "f", "all measured quan... [output truncated]"), (1002, "u", "f", "waiting for measured..."), (1003, "u", "f", "measured dam�"), (1004, "u", "f", None), (1005, "u", "f", ""), (1006, "u", "f", "measured unheardof"), (1007, "u", "f", "measured count (cut off)")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + extra + extra[:1]], "record_id bigint, source string, field_name string, text string, length int, last int")
    got = truncation.truncated(df).collect()
    assert {x.record_id for x in got} - {1007} == want | {1000, 1001, 1003} and len([x for x in got if x.record_id == 1000]) == 2
    assert 1007 in {x.record_id for x in got}
    assert truncation.truncated(df.limit(0)).count() == 0


def _limit_rows():
    text = lambda i: "some words " * (2 + i % 9) + "ready."
    rows = [(i, "s", "f", text(i)) for i in range(400)] + [(1000 + i, "s", "f", ("more words " * 17 + f"zq{chr(97 + i)}xv" * 20)[:200]) for i in range(6)]
    return rows + [(2000 + i, "s", "f", "words more " * 17 + "ready".rjust(13)) for i in range(2)] + [(3000, "t", "f", "some qqv")]


def test_unknown_word_at_a_limit(spark):
    df = spark.createDataFrame(_limit_rows(), "record_id bigint, source string, field_name string, text string")
    assert {r.record_id: r.why for r in truncation.truncated(df).collect()} == {1000 + i: "cut at limit" for i in range(6)}
    # the spikes are what tells
    none = truncation.length_spikes(truncation.ends(df)).limit(0)
    assert truncation.truncated(df, none).count() == 0


def test_ends_of_very_long_words(spark):
    texts = ["x" * 1_000_000 + "!", "begin " + " " * 500_000 + "end" + " " * 500_000, "f" * 400_000, "", None, "a (" * 50_000, "kept whole [output truncated]"]
    df = spark.createDataFrame([(i, None, "f", t) for i, t in enumerate(texts)], "record_id bigint, source string, field_name string, text string")
    got = {r.record_id: r for r in truncation.ends(df).collect()}
    assert got[0].last == "" and len(got[0].stopped) == 1_000_000 and got[1].last == "end" and len(got[2].last) == 400_000 and got[6].last == "whole"
    assert truncation.truncated(df).count() == 0


def test_judgement_of_a_word_does_not_depend_on_size(spark):
    for times in (1, 50):
        rows = [(w, k * times, e * times, 0) for w, k, e in (("quantity", 4000, 0), ("quan", 0, 3), ("quant", 1, 0), ("bye", 0, 90), ("byes", 2, 0), ("rest", 0, 0), ("restore", 70, 0))]
        rows += [("rest", 60 * times, 5, 0)]
        w = spark.createDataFrame(rows, "word string, whole bigint, ending bigint, limit bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("whole", "ending", "limit")])
        got = {r.last: (r.half, r.known) for r in truncation.judged_ends(w).collect()}
        assert got == {"quan": (True, False), "bye": (False, True), "rest": (False, True)}


def test_hilbert_curve_is_continuous():
    n = 8
    pts = np.array([(x, y) for x in range(n) for y in range(n)])
    order = pts[np.argsort(packing.hilbert_key(pts, 3))]
    assert len(set(packing.hilbert_key(pts, 3).tolist())) == n * n and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert_key(grid, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 30, 64, 65, 200, r.randint(1, 64)]), [r.gauss(0, 1) for _ in range(4)]) for i in range(800)] + [(9000, None, [0.0] * 4)]
    rows += [(1000 + i, 20, [0.5] * 4) for i in range(400)]  # a third of all rows in one place
    items = spark.createDataFrame(rows, "id bigint, tokens bigint, vector array<double>")
    packs = spark.createDataFrame([(1, 64), (2, 256), (3, 0), (4, None)], "pack_id int, capacity int")
    got = packing.packed(items, packs).collect()
    sizes = {i: n for i, n, _ in rows if n is not None}
    for pack, cap in ((1, 64), (2, 256)):
        mine = [x for x in got if x.pack_id == pack]
        total, fill = {}, {}
        for x in mine:
            total[x.id] = total.get(x.id, 0) + x.tokens
            fill[x.container_id] = fill.get(x.container_id, 0) + x.tokens
        assert total == sizes and max(fill.values()) <= cap
        for i, n in sizes.items():
            assert sum(x.id == i for x in mine) == max(1, -(-n // cap))  # split only beyond the capacity
        assert len(fill) <= 1.1 * sum(sizes.values()) / cap + 8
    assert {x.pack_id for x in got} == {1, 2} and packing.packed(items.limit(0), packs).count() == 0 and packing.packed(items, packs.limit(0)).count() == 0


def test_poisson_thresholds():
    u = np.array([0.1, 0.5, 0.9, 0.999])
    t = mixing.poisson_thresholds(u, 3)
    assert np.allclose(t[0], -np.log(u)[...], atol=1e-6) or (np.diff(t, axis=0) > 0).all()
    # the count at a mean is the inverse of the Poisson distribution
    many = mixing.poisson_thresholds(np.array([1e-16, 0.5, 1 - 1e-16]), 500)
    assert (np.diff(many, axis=0) >= 0).all() and abs(many[79, 1] - 79.67) < 0.1 and abs(many[499, 1] - 499.67) < 0.1 and (many[499] < mixing.top_mean(500)).all()
    assert abs(mixing.mean_draw(1) - (1 - np.exp(-1))) < 1e-9
    for lam in (0.3, 1.0, 2.5):
        cdf = [np.exp(-lam), np.exp(-lam) * (1 + lam), np.exp(-lam) * (1 + lam + lam**2 / 2)]
        assert ((t < lam).sum(axis=0) == sum((u > c).astype(int) for c in cdf)).all()


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["A", " a", "a "]) if i % 5 else "small", r.randint(1, 60)) for i in range(3000)] + [(5000, None, 5), (5001, "a", None), (5002, "a", 0), (5003, "other", 9)]
    items = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "small", 0.5, 3), (2, "a", 0.9, 2), (2, "small", 0.1, 1), (3, "none", 1.0, 2)], "mix_id int, source string, share double, most int")
    got = mixing.mixed(items, targets).collect()
    most = {(1, "a"): 1, (1, "small"): 3, (2, "a"): 2, (2, "small"): 1}
    assert all(1 <= x.repeats <= most[x.mix_id, x.source] for x in got) and len({(x.mix_id, x.id) for x in got}) == len(got)
    for mix, share in ((1, 0.5), (2, 0.9)):
        total = sum(x.tokens * x.repeats for x in got if x.mix_id == mix)
        a = sum(x.tokens * x.repeats for x in got if x.mix_id == mix and x.source == "a")
        assert abs(a / total - share) < 0.005
    each = mixing.shuffled(mixing.mixed(items, targets)).collect()
    assert len(each) == sum(x.repeats for x in got) and [tuple(x) for x in mixing.mixed(items, targets).sort("mix_id", "id").collect()] == sorted((tuple(x) for x in got), key=lambda x: (x[0], x[2]))
    assert mixing.mixed(items.limit(0), targets).count() == 0 and mixing.mixed(items, targets.limit(0)).count() == 0


def test_mixing_reaches_any_cap(spark):
    items = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(200)], "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.5, 80), (1, "b", 0.5, 80), (2, "a", 0.8, 3), (2, "b", 0.2, 200)], "mix_id int, source string, share double, most int")
    got = mixing.mixed(items, targets).collect()
    total = {m: sum(x.tokens * x.repeats for x in got if x.mix_id == m) for m in (1, 2)}
    a = {m: sum(x.tokens * x.repeats for x in got if x.mix_id == m and x.source == "a") for m in (1, 2)}
    assert abs(total[1] - 2 * 1000 * mixing.mean_draw(80)) < 300 and abs(a[1] / total[1] - 0.5) < 0.005 and abs(a[2] / total[2] - 0.8) < 0.01
    repeats = [x.repeats for x in got if x.mix_id == 2 and x.source == "a"]
    assert max(repeats) == 3 and min(repeats) < 3  # drawn, not all at the cap


def test_containers_hold_neighbours():
    bins = packing.Bins(10, iter(range(1000)).__next__, 2)
    for window in range(6):
        bins.put((window,), 6)
        bins.next_window()
        assert len(bins.open) <= 3
    bins.put(("last",), 4)
    assert {x[0]: x[2] for x in bins.out}["last"] >= 3  # an earlier container would have had room


def test_tokens(spark):
    t = tokens.tokenizer(tokens.TOKENIZER)
    texts = ["hello world", "", "x" * 50_000, "<|endoftext|>", "日本 größe"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "id bigint, text string").withColumn("tokens", F.lit(1))
    got = {r.id: r for r in tokens.sized(df, dims=4).collect()}
    assert {i: r.tokens for i, r in got.items()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert got[1].vector == [0.0] * 4


TEXT = """Thanks to Hedda Mistral and Quillon, Yara for the hint. Thanks Ivo!
Write to a.b+c@mail.example.org or jo (at) posthorn dot example, or ann AT example DOT net.
the prompt reads student@labbox:~$ and printf("%d@%d") ring the Ring Buffer, see a buffer
call +44 20 7946 0114, 020 7946 0227, (555) 555-0124, 030/23125476 or 555-555-0164
checksum 909-7799-0011, ticket #3781-9507, version 2.31.0-4172, server at 192.0.2.1, sizes 128-256-5120
tax number 959 27 4377, passport X55226322, student id MAT-4247-1134 and QQ 54 45 18 D, m2911720
I live at Flat 8, 50 Cinder Street, Ravenstoke 45873 and at Tannerweg 94, 20661 Tarnfield.
Regards,
Prof. K. Dunmarrow-Tane
The Operating Systems chapter, by MARIT ELVERSON; Operating Systems again"""


def test_personal_spans(spark):
    long = "x" * 300_000 + " call +1 555 555 0184"
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, long), (5, "größe 日本 mail me at ü@x y z@host.test")], "id bigint, text string").selectExpr("*", "1 as run", "'q' as parts")
    got = pii.personal_spans(df).collect()
    first = {(r.pii_type, TEXT[r.start_char : r.end_char]) for r in got if r.id == 1}
    assert first == {
        ("person_name", "Hedda Mistral"), ("person_name", "Quillon, Yara"), ("person_name", "K. Dunmarrow-Tane"), ("person_name", "MARIT ELVERSON"),
        ("email", "a.b+c@mail.example.org"), ("email", "jo (at) posthorn dot example"), ("email", "ann AT example DOT net"),
        ("phone", "+44 20 7946 0114"), ("phone", "020 7946 0227"), ("phone", "(555) 555-0124"), ("phone", "030/23125476"), ("phone", "555-555-0164"),
        ("id_number", "959 27 4377"), ("id_number", "X55226322"), ("id_number", "MAT-4247-1134"), ("id_number", "QQ 54 45 18 D"), ("id_number", "m2911720"),
        ("street_address", "Flat 8, 50 Cinder Street, Ravenstoke 45873"), ("street_address", "Tannerweg 94, 20661 Tarnfield"),
    }
    assert [(r.pii_type, r.start_char) for r in got if r.id == 4] == [("phone", 300_006)]
    assert [(r.pii_type, r.start_char) for r in got if r.id == 5] == [("email", 26)]
    red = {r.id: r.text for r in pii.redacted(df).collect()}
    assert red[2] is None and red[3] == "" and red[4].endswith("call <PHONE>") and "a.b+c" not in red[1] and "checksum 909-7799-0011" in red[1]
    assert pii.personal_spans(df.limit(0)).count() == 0


def test_names_by_shares(spark):
    """One hit decides nothing, however large the collection; words that are given names too may be names within a sentence."""
    people = [f"ask {g} {f} now" for g in ("Maria", "Ivo", "Hedda", "Marit") for f in ("Lopez", "Keller", "Tane", "Roth", "Elverson")]
    plain = ["the mark is low", "a mark of ten", "mark it"] + ["a rose"] * 3
    for times, more in ((1, []), (1, ["the Maria Lopez from Porto"]), (10, ["the Maria Lopez from Porto"]), (1, ["maria sings"])):
        texts = people * times + plain * times + [x.replace("low", "high") for x in more] + ["I asked Mark Dunmore and Rose Elverson today"]
        df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
        got = [texts[r.id][r.start_char : r.end_char] for r in pii.personal_spans(df).collect()]
        want = 20 * times + sum("Maria Lopez" in x for x in more)
        assert len([x for x in got if x not in ("Mark Dunmore", "Rose Elverson")]) == want and {"Mark Dunmore", "Rose Elverson"} <= set(got)


def test_many_spans_in_one_text():
    text = "mail a@b.example or call +44 20 7946 0114 and " * 20_000
    assert len(pii.find_spans(text)) == 40_000


def test_validators():
    assert pii.mod23("12345678Z") and pii.mod23("X1234567L") and not pii.mod23("12345678A") and pii.mod11_10("86095742719") and not pii.mod11_10("86095742710") and pii.key97("255081416802538") and not pii.key97("255081416802539")
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = [s[0] for s in pii.find_spans("card 4539 5787 6362 1486, not 4539 5787 6362 1487, account GB82 WEST 1234 5698 7654 32")]
    assert kinds.count("id_number") == 2


@pytest.mark.parametrize("name", ["p2_found", "p2_counts", "p5_found", "p6_found", "p6_group_sizes"])
def test_queries_with_sql(spark, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    from marklight.llm import catalog

    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.queries()[name](spark, d)
    r = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(map(str, (tuple(x[n] for n in names) for x in df.collect()))) == sorted(map(str, r.fetchall()))


def test_one_article_is_no_veto(spark):
    texts = ["I heard that Maria Keller left", "die Anna Schmidt kam", "ask Anna Schmidt now", "call Anna Schmidt now", "use the Ring Puffer now", "fill the Ring Puffer or Ring Puffer"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = [(r.id, texts[r.id][r.start_char : r.end_char]) for r in pii.personal_spans(df).collect()]
    assert sorted(got) == [(0, "Maria Keller"), (1, "Anna Schmidt"), (2, "Anna Schmidt"), (3, "Anna Schmidt")]


def _planted(size: int, seed: int = 6) -> tuple[list, set]:
    """Texts of ordinary sentences with invented persons, by id, and where what was planted begins."""
    r = random.Random(seed)
    given = ["Maria", "Ivo", "Hedda", "Marit", "Rose", "Mark", "Ana", "Jonas", "Lucía", "Zoé"]
    family = [f"{a}{b}" for a in ("Dun", "Kel", "Lop", "Quill", "Tarn", "Vis", "Hart", "Mor") for b in ("more", "ler", "ez", "on", "field", "by")]
    plain = ["the mark on the wall is low", "a rose is red", "every process waits for the queue", "read the manual before the lab", "The Ring Buffer holds ten items", "the port is 8080 and version 2.31.0-4172 works", "ticket #3781-9507 is open"]
    rows, want = [], set()
    for i in range(size):
        text = ". ".join(r.choice(plain) for _ in range(r.randint(1, 6))) + ". "
        name = f"{r.choice(given)} {r.choice(family)}"
        said = {
            "person_name": ("yesterday I asked ", name, " about it"),
            "email": ("write to ", f"{r.choice('abc')}.{r.choice(family).lower()}@{r.choice(['mail', 'lab'])}.example.org", " today"),
            "phone": ("call ", f"+44 20 7946 0{r.randint(100, 999)}", " now"),
            "id_number": ("my passport number is ", f"{r.choice('XKL')}{r.randint(10**7, 10**8 - 1)}", " here"),
            "street_address": ("I live at ", f"{r.randint(1, 99)} {r.choice(family)} Street", " now"),
        }
        for kind in r.sample(sorted(said), 2):
            before, value, after = said[kind]
            want.add((i, kind, len(text) + len(before)))
            text += before + value + after + ". "
        rows.append((i, text))
    return rows, want


def test_recall_does_not_fall_with_size(spark):
    for size in (80, 800):
        rows, want = _planted(size)
        got = {(x.id, x.pii_type, x.start_char) for x in pii.personal_spans(spark.createDataFrame(rows, "id bigint, text string")).collect()}
        assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want), (size, sorted(want - got)[:5], sorted(got - want)[:5])


def test_recall_of_cut_texts(spark):
    """Texts cut inside a word at random: most are found, and hardly any whole one."""
    r = random.Random(11)
    words = ["quantity", "measured", "reservation", "directory", "counting", "balance", "temperature", "scheduling", "the", "of", "record", "after"]
    rows, want = [], set()
    for i in range(2000):
        text = " ".join(r.choice(words) for _ in range(r.randint(10, 40))) + r.choice([".", "", "\n"])
        if r.random() < 0.1:
            at = r.randrange(20, len(text))
            while not (text[at - 1 : at + 1].isalpha() and text[at - 2].isalpha()):
                at = r.randrange(20, len(text))
            text = text[:at]
            if text.split()[-1] not in words:
                want.add(i)
        rows.append((i, "s", "f", text))
    got = {x.record_id for x in truncation.truncated(spark.createDataFrame(rows, "record_id bigint, source string, field_name string, text string")).collect()}
    assert len(got & want) >= 0.98 * len(want) > 150 and len(got - want) <= 5
