"""Candidate pairs of similar sets, by the exact prefix bound over one or more rare elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklight.operators.skew import block_copies, heavy_of, skew_join
from marklight.session import cut, free

EPS = 1e-9


def ranked_sets(sets: DataFrame) -> DataFrame:
    """``side, id, n, alone, items`` of ``sets(side, id, items array<bigint>)``, elements distinct, no nulls, one row a set.

    ``items`` holds the elements that more than one set has, rarest first over both sides (ties by value); ``alone`` counts the
    others, which come before them in the order and can't be shared. Sets of nothing but such elements are left out. An
    element that most sets have costs one row a task in the count and meets its count by broadcast.
    """
    long = sets.select("side", "id", F.size("items").alias("n"), F.explode("items").alias("item"))
    df = cut(long.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    total = df.agg(F.sum("df")).first()[0] or 0
    hot = df.where(F.col("df") > max(100_000, total // 10_000)).select("item")
    r = skew_join(long, df, "item", hot).groupBy("side", "id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "item"))).alias("r"))
    out = cut(r.select("side", "id", "n", (F.col("n") - F.size("r")).alias("alone"), F.col("r.item").alias("items")))
    free(df)
    return out


def candidate_pairs(sets: DataFrame, threshold: float, across: bool = False, cell_rows: int = 24, levels: int = 6) -> DataFrame:
    """``side_a, a, side_b, b``, distinct: all pairs of ``ranked_sets`` that may reach a Jaccard similarity of ``threshold``.

    With ``across`` pairs go from side ``l`` to ``r``, else within one side with ``a < b``. Two sets that similar share ``d``
    elements among the first ``n - need + d`` of either, ``need`` being the overlap they must have at least, for any
    ``d`` up to that overlap. Sets meet in cells: at first of one such element; a cell of more than ``cell_rows`` sets is split
    by the next shared element, and so on, as long as that leaves fewer pairs to look at. Pairs that need no further shared
    element are then similar already. A cell that a further element doesn't thin out is full of similar sets, and is
    joined with itself in blocks of bounded size, each pair in the cell of its first shared elements only. Cells of
    any size so cost about what they hold, and no pair is lost.
    """
    least = lambda n: F.ceil(n * threshold - EPS)  # noqa: E731  with any partner
    smaller = lambda n: F.ceil(n * (2 * threshold / (1 + threshold)) - EPS)  # noqa: E731  with a partner at least as large
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - EPS)
    sided = (F.col("side_a") == "l") & (F.col("side_b") == "r") if across else (F.col("id_a") < F.col("id_b"))
    cols = ["side", "id", "n", "pos", "small"]
    out = ["side_a", "a", "side_b", "b"]

    def meet(rows: DataFrame, depth: int, keys: list[str], more: list[str] = [], extra: Column | None = None) -> DataFrame:  # noqa: B006
        left = rows.where("_at = 'l'") if "_at" in keys + more else rows
        right = rows.where("_at = 'r'") if "_at" in keys + more else rows
        keys = [k for k in keys if k != "_at"]
        a, b = (df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in [*cols, *[m for m in more if m != "_at"]]]) for df, x in ((left, "a"), (right, "b")))
        # the smaller of two sets meets its partner in its shorter prefix
        roles = ((F.col("n_a") > F.col("n_b")) | F.col("small_a")) & ((F.col("n_b") > F.col("n_a")) | F.col("small_b"))
        enough = depth + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need
        fits = (F.col("n_a") >= F.col("n_b") * threshold - EPS) & (F.col("n_b") >= F.col("n_a") * threshold - EPS)
        j = a.join(b, keys).where(sided & roles & enough & fits)
        j = j if extra is None else j.where(extra)
        return j.select("side_a", F.col("id_a").alias("a"), "side_b", F.col("id_b").alias("b"))

    def step(depth: int, from_: Column, cell) -> tuple[Column, ...]:
        """Positions behind ``from_`` within the prefix of ``depth`` elements, with their cells."""
        upto = F.least(F.col("n"), F.col("n") - least(F.col("n")) + depth) - F.col("alone")
        at = F.when(upto > from_, F.sequence(from_ + 1, upto)).otherwise(F.array().cast("array<bigint>"))
        return F.explode(F.transform(at, lambda i: F.struct(cell(F.get("items", (i - 1).cast("int"))).alias("cell"), (i + F.col("alone")).cast("int").alias("pos"))))

    short = F.col("pos") <= F.col("n") - smaller(F.col("n")) + 1
    first = sets.select("side", "id", "n", step(1, F.lit(0).cast("bigint"), lambda item: F.xxhash64(item)).alias("c"))
    rows = cut(first.select("side", "id", "n", F.col("c.cell").alias("cell"), F.col("c.pos").alias("pos")).withColumn("small", short))
    found, made = [], []
    for depth in range(1, levels + 1):
        sizes = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.min("side").alias("s"), F.max("side").alias("t"), F.count_if("small").alias("ks")).where("k > 1 and ks > 0" + (" and s <> t" if across else "")).select("cell", "k", "ks"))
        live = cut(skew_join(rows, sizes, "cell", heavy_of(sizes, "cell", "k", rows.count())))
        free(rows, sizes)
        made.append(live)
        found.append(meet(live.where(F.col("k") <= cell_rows), depth, ["cell"]))
        hot = live.where(F.col("k") > cell_rows)
        if hot.isEmpty():
            break
        whole = hot.join(sets.select("side", "id", "alone", "items"), ["side", "id"])
        sub = whole.withColumnRenamed("cell", "parent").withColumnRenamed("small", "was").select("side", "id", "n", "parent", "k", "ks", "was", step(depth + 1, (F.col("pos") - F.col("alone")).cast("bigint"), lambda item: F.xxhash64("parent", item)).alias("c"))
        sub = cut(sub.select("side", "id", "n", "parent", "k", "ks", F.col("c.cell").alias("cell"), F.col("c.pos").alias("pos"), (F.col("was") & (F.col("c.pos") <= F.col("n") - smaller(F.col("n")) + depth + 1)).alias("small")))
        # pairs whose overlap may end with the elements of this cell: they reach it already
        found.append(meet(block_copies(hot.where(least(F.col("n")) <= depth), F.col("k"), cell_rows, F.struct("side", "id")), depth, ["cell", "_block", "_at"], extra=need <= depth))
        # pairs are looked at by roles: a short prefix with any other
        cost = sub.groupBy("parent", "k", "ks", "cell").agg(F.count(F.lit(1)).alias("m"), F.count_if("small").alias("ms")).groupBy("parent", "k", "ks").agg(F.sum(F.col("m") * F.col("ms")).alias("cost"))
        dense = cost.where(F.col("cost") > 0.9 * F.col("k") * F.col("ks")) if depth < levels else cost
        dense = cut(dense.select(F.col("parent").alias("cell")))
        made += [sub, dense]
        if not dense.isEmpty():
            kept = whole.join(dense, "cell", "left_semi").withColumn("front", F.slice("items", F.lit(1), (F.col("pos") - F.col("alone")).cast("int")))
            kept = block_copies(kept, F.col("k"), 20 * cell_rows, F.struct("side", "id"))
            once = F.size(F.array_intersect("front_a", "front_b")) == depth
            found.append(meet(kept, depth, ["cell", "_block", "_at"], ["front"], once))
        if depth == levels:
            break
        rows = cut(sub.join(dense.withColumnRenamed("cell", "parent"), "parent", "left_anti").select("side", "id", "n", "cell", "pos", "small"))
    pairs = found[0]
    for p in found[1:]:
        pairs = pairs.unionByName(p)
    pairs = cut(pairs.select(*out).distinct())
    free(*made)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, shared, n_a, n_b, similarity`` of the pairs of ``candidate_pairs`` that reach ``threshold``."""
    left, right = (sets.select(F.col("side").alias(f"side_{x}"), F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab")
    full = pairs.join(left, ["side_a", "a"]).join(right, ["side_b", "b"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    got = full.select("a", "b", shared.cast("bigint").alias("shared"), "n_a", "n_b")
    return got.withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("similarity") >= threshold)


def set_classes(sets: DataFrame, heavy_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: ``side, id, items`` of one representative each (smallest id), and ``side, id, cls`` of every record.

    ``sets(side, id, items array<bigint>)``, one row per record. Nulls, empty sets and null elements are dropped and repeated elements
    count once. Sets are compared by their size and two 64-bit hashes.
    """
    items = F.sort_array(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    one = cut(sets.where("id is not null and items is not null").select("side", "id", items.alias("items")).where("size(items) > 0"))
    key = one.select("side", "id", F.concat_ws("-", "side", F.size("items").cast("string"), F.xxhash64("items").cast("string"), F.xxhash64(F.lit(1), "items").cast("string")).alias("key"))
    least = cut(key.groupBy("key").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("rows")))
    member = cut(skew_join(key, least, "key", heavy_of(least, "key", "rows", one.count(), heavy_rows)).select("side", "id", "cls"))
    reps = cut(one.join(member.where("id = cls").select("side", "id"), ["side", "id"], "left_semi"))
    free(one, least)
    return reps, member
