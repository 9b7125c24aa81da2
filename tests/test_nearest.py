"""Cosine searches, sparse assignment and lanes against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import cluster, nearest
from folioframe.plans.scratch import Scratch


def vectors(seed: int, n: int, dim: int = 6, groups: int = 9) -> list:
    """Groups of near vectors, exact copies, and ones that can't be compared."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, dim)) * rng.integers(0, 2, (n, 1))
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [1.0] * (dim - 1)), (n + 4, [float("nan")] * dim)]


def unit(v):
    v = np.array(v)
    return v / np.sqrt((v * v).sum())


@pytest.mark.parametrize("block, pivots", [(16, 8), (7, 1), (512, 64)])
def test_top_cosine_is_that_of_all_pairs(spark, block, pivots):
    items, queries = vectors(1, 300), vectors(2, 90)
    items += [(1000 + k, v) for k, v in items[:150]] + [(2000 + k, items[0][1]) for k in range(40)]
    df = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    got = nearest.top_cosine(Scratch(spark, "t"), df(queries), df(items), 3, pivots=pivots, block=block).collect()
    good = [(k, unit(v)) for k, v in items if v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    want = {}
    for q, v in queries:
        if v and len(v) == 6 and np.isfinite(v).all() and any(v):
            u = unit(v)
            near = sorted(((-round(float((u * x).sum()), 12), k) for k, x in good))[:3]
            want |= {(q, r + 1): (k, -c) for r, (c, k) in enumerate(near)}
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["cos"], 12)) for r in got} == want
    none = df(items).where("false")
    assert nearest.top_cosine(Scratch(spark, "t"), df(queries), none, 3).collect() == []
    assert nearest.top_cosine(Scratch(spark, "t"), none, df(items), 3).collect() == []


def test_blocks_far_apart_never_meet(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(12)
    rows = [(k, [float(a) for a in centres[k % 12] + 0.01 * rng.standard_normal(12)]) for k in range(2400)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    scratch = Scratch(spark, "t")
    blocks = nearest._blocks(scratch, df, "id", "vec", nearest._pivots(df, "id", "vec", 64), 50)
    n, met = blocks.count(), nearest._meetings(blocks, blocks, F.lit(float(np.arccos(0.9)))).count()
    assert n >= 48 and met < n * n / 6


def test_stars_connect_what_strong_pairs_connect(spark):
    rows = [(str(k), v) for k, v in vectors(3, 400, groups=40)]
    df = spark.createDataFrame(rows, "record_id string, vec array<double>")
    got = nearest.near_stars(Scratch(spark, "t"), df, 0.9, "record_id", "vec", 8, 32).collect()

    def parts(edges) -> dict:
        of = {k: k for k, _ in rows}

        def top(k):
            while of[k] != k:
                k = of[k]
            return k

        for a, b in edges:
            of[max(top(a), top(b))] = min(top(a), top(b))
        return {k: top(k) for k in of}

    good = [(k, unit(v)) for k, v in rows if v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    assert parts([(r["a"], r["b"]) for r in got]) == parts([(a, b) for a, x in good for b, y in good if (x * y).sum() >= 0.9])


def test_override_hints_choose_before_they_test(spark):
    base = [(1, [1.0, 0.0], 5, ["e"]), (2, [0.9, 0.1], 3, ["e"]), (3, [0.8, 0.3], 9, ["e"]), (4, [0.7, 0.7], 1, ["e"]), (5, [0.95, 0.05], 2, ["f"])]
    r = spark.createDataFrame(base, "record_id long, vec array<double>, decision_date long, entities array<string>")
    h = r.where("record_id = 1").withColumnRenamed("vec", "hint_vec")
    # the three nearest are 1 itself, 5 (no shared entity) and 2; 4 would pass the tests but isn't among them
    assert [tuple(x) for x in cluster.override_hints(Scratch(spark, "t"), h, r).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_auction_weighs_as_much_as_augmenting_paths(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 60, 2)
    w = np.round(rng.random((n, m)) * (rng.random((n, m)) < (0.1, 0.3, 1.0)[seed % 3]) * (1 if seed < 4 else 50), 4)
    if seed == 5:
        w = np.round(w)  # many equal weights
    row, col = np.nonzero(w >= 0)
    weight = w[row, col]
    mix = rng.permutation(row.size)
    row, col, weight = row[mix], col[mix], weight[mix]
    got = cluster.auction(row, col, weight)
    assert len(set(row[got])) == len(set(col[got])) == len(got) and (weight[got] > 0).all()
    assert weight[got].sum() == pytest.approx(sum(w[p] for p in cluster.assign(w)), abs=1e-9)


def test_auction_of_many_rows_keeps_to_its_candidates():
    # a dense table of these rows would hold 1.6e9 cells
    rng = np.random.default_rng(1)
    n = 40_000
    row, col = np.repeat(np.arange(n), 3), rng.integers(0, n, 3 * n)
    key = np.unique(row * n + col)
    row, col = key // n, key % n
    weight = np.round(rng.random(key.size), 2)
    got = cluster.auction(row, col, weight, 0.01)
    assert len(set(row[got])) == len(set(col[got])) == len(got)
    left = np.ones(n, bool)
    left[row[got]] = False
    free = np.ones(n, bool)
    free[col[got]] = False
    assert not (left[row] & free[col] & (weight > 0)).any()  # nothing could be added


def test_match_by_parts(spark, monkeypatch):
    monkeypatch.setattr(cluster, "DENSE", 40)
    rng = np.random.default_rng(8)
    rows = [(f"b{b}", int(i), f"c{j}", float(np.round(rng.random(), 4))) for b in range(3) for i in range(25) for j in rng.integers(0, 25, 3)]
    df = spark.createDataFrame(rows + [("b0", 1, "c1", 0.0), ("b9", 7, "c7", -1.0)], "block string, l long, r string, w double")
    got = cluster.match(df, "l", "r", "w", "block").collect()
    # rows of blocks share numbers, so blocks are told apart by weights alone; totals tell
    total = 0.0
    for b in range(3):
        w = np.zeros((25, 25))
        for blk, i, c, x in rows:
            if blk == f"b{b}":
                w[i, int(c[1:])] = max(w[i, int(c[1:])], x)
        total += sum(w[p] for p in cluster.assign(w))
    assert sum(r["w"] for r in got) == pytest.approx(total)


def test_lanes_are_those_of_the_first_free_row(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.6 else f"l{rng.integers(0, 9)}", k, int(a := rng.integers(0, 900)), int(a + rng.integers(0, 40) * (1 + 5 * (rng.random() < 0.1)))) for k in range(1500)]
    df = spark.createDataFrame([*rows, ("hot", 9000, None, 4), (None, 9001, 1, 2)], "lane string, k long, a long, b long").withColumn("text", F.lit("x")).repartition(5)
    got = {r["k"]: r["row"] for r in cluster.pack_lanes(df, "lane", "a", "b", "k").collect()}
    want, ends = {9000: None, 9001: 0}, {}
    for lane, k, a, b in sorted(rows, key=lambda r: (r[2], r[1])):
        of = ends.setdefault(lane, [])
        row = next((i for i, e in enumerate(of) if e <= a), len(of))
        of[row : row + 1] = [b]
        want[k] = row
    assert got == want


@pytest.mark.parametrize("busy, block", [(3, 4), (10, 7), (500, 500)])
def test_related_threads_with_busy_people(spark, busy, block):
    import datetime as dt

    from folioframe.operators import threads as TH

    rng = np.random.default_rng(busy)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=int(n), hours=int(rng.integers(0, 24)))
    rows = []
    for k in range(150):
        a = int(rng.integers(0, 300))
        people = ["everyone"] * bool(rng.random() < 0.9) + ["second"] * bool(rng.random() < 0.5) + [f"p{x}" for x in rng.integers(0, 40, rng.integers(0, 4))]
        rows.append((f"t{k:03}", day(a), day(a + int(rng.integers(1, 200 if rng.random() < 0.05 else 9))), people or None))
    df = spark.createDataFrame(rows, "thread_id string, first_at timestamp, last_at timestamp, participants array<string>").repartition(3)
    got = {(r["thread_id"], r["rank"]): r["other_id"] for r in TH.related_threads(df, busy=busy, block=block).collect()}
    want, wide = {}, dt.timedelta(days=14)
    for t, a, b, p in rows:
        near = sorted((c, o) for o, c, d, q in rows if o != t and len(set(p or ()) & set(q or ())) >= 2 and d >= a - wide and c <= b + wide)[:10]
        want |= {(t, n + 1): o for n, (_, o) in enumerate(near)}
    assert got == want


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_containment_is_that_of_plain_search(spark, monkeypatch, block):
    from folioframe.operators import verify

    monkeypatch.setattr(verify, "BLOCK", block)
    rng = np.random.default_rng(3)
    word = ["ab", "aa", "é", "日本", "b ", "a", "\n", "😀"]
    text = lambda n: "".join(rng.choice(word) for _ in range(n))
    docs = [(k, text(rng.integers(0, 200))) for k in range(60)] + [(7, "twice"), (None, "abab"), (61, None), (62, "")]
    items = [(f"i{k}", d[a : a + n]) for k in range(300) if (d := docs[rng.integers(0, 60)][1] + text(3)) and (a := rng.integers(0, len(d))) >= 0 and (n := rng.integers(0, 2 ** rng.integers(1, 8))) >= 0]
    items += [("none", None), ("empty", ""), ("far", "zzz"), ("i0", "aa")]
    got = verify.contained(spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(items, "i string, q string"), "d", "t", "i", "q").collect()
    assert {(r["i"], r["d"]) for r in got} == {(i, d) for i, q in items for d, t in docs if q and t and q in t} and len({tuple(r) for r in got}) == len(got)


def test_fuzzy_windows_are_those_of_all_windows():
    from folioframe.functions import matching

    rng = np.random.default_rng(6)
    for _ in range(600):
        n = int(rng.integers(3, 60))
        needle = "".join(rng.choice(list("abcde "), n))
        inner = list(needle)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(inner) + 1))
            inner[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcde "), int(rng.integers(0, 2)))
        text = "".join(rng.choice(list("abcde "), int(rng.integers(0, 90)))) + "".join(inner) + "".join(rng.choice(list("abcde "), int(rng.integers(0, 90))))
        least = float(rng.choice([80, 90, 95]))
        best = matching.best_window(needle, text)
        got = matching.best_window(needle, text, least)
        assert got == best if best[0] >= least else got[0] < least


@pytest.mark.parametrize("threshold", [0.4, 0.62, 0.9])
def test_clusters_over_near_pairs_alone(threshold):
    rng = np.random.default_rng(int(threshold * 100))
    for dim, spread in ((6, 0.5), (16, 0.35), (16, 1.0)):
        middle = rng.normal(size=(12, dim))
        vectors = [middle[k % 12] + spread * rng.normal(size=dim) for k in range(150)] + [None, np.zeros(dim)]
        people = [None if k % 17 == 0 else [f"p{k % 9}", None] if k % 5 else [f"p{k % 9}", f"p{k % 7}"] for k in range(152)]
        entities = [None if k % 13 == 0 else [f"e{x}" for x in rng.integers(0, 20, k % 3)] for k in range(152)]
        sim, link = cluster.similarities(vectors, people, entities)
        want = cluster.agglomerate(sim, link, threshold)
        assert cluster.agglomerate_near(vectors, people, entities, threshold) == want and 1 < len(want) < 152


def test_vectors_travel_once_a_share(spark, monkeypatch):
    rows = [(k, v) for k, v in vectors(5, 400, 12, 30) if v and len(v) == 12 and np.isfinite(v).all() and any(v)]
    items = spark.createDataFrame([(f"i{k}", v) for k, v in rows], "id string, vec array<double>")
    asked = spark.createDataFrame(rows, "id long, vec array<double>")
    seen, write = [], Scratch.write

    def told(self, df, *a, **k):
        out = write(self, df, *a, **k)
        if k.get("small"):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(Scratch, "write", told)
    got = nearest.top_cosine(Scratch(spark, "shares"), asked, items, 3, pivots=4, block=8).collect()
    u = np.array([unit(v) for _, v in rows])
    best = {rows[n][0]: sorted(-c)[:3] for n, c in enumerate(u @ u.T)}
    assert len(seen) == 1 and "share" in seen[0] and len(got) == 3 * len(rows)
    assert all(abs(r["cos"] + best[r["query_id"]][r["rank"] - 1]) < 1e-9 for r in got)


def test_classes_are_matched_as_their_rows(spark):
    rng = np.random.default_rng(3)
    lefts = [(k, "xy"[k % 2], float(rng.integers(0, 8))) for k in range(70)]
    rights = [(k, "xy"[k % 2], float(rng.integers(0, 8))) for k in range(60)]
    weight = lambda a, b: round(max(0.0, 1 - abs(a - b) / 5), 4)
    p, q = spark.createDataFrame(lefts, "l long, block string, lp double"), spark.createDataFrame(rights, "r long, block string, rp double")
    sizes = lambda df, c: df.groupBy("block", c).agg(F.count("*").alias(f"n_{c}"))
    w = F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("lp") - F.col("rp")) / 5), 4)
    cand = sizes(p, "lp").join(sizes(q, "rp"), "block").withColumn("w", w)
    best = 0.0
    for b in "xy":
        best += sum(m[i, j] for m in [np.array([[weight(x, y) for _, c, y in rights if c == b] for _, a, x in lefts if a == b])] for i, j in cluster.assign(m))
    for most in (cluster.CLASSES, 1):
        found = cluster.match_classes(cand, "lp", "rp", "w", "block", "n_lp", "n_rp", most=most)
        got = cluster.pairs_of_classes(found, p, q, "lp", "rp", "block", "l", "r").collect()
        assert len({r["l"] for r in got}) == len({r["r"] for r in got}) == len(got)
        at, to = {k: (b, x) for k, b, x in lefts}, {k: (b, x) for k, b, x in rights}
        assert all(at[r["l"]] == (r["block"], r["lp"]) and to[r["r"]] == (r["block"], r["rp"]) and r["w"] == weight(r["lp"], r["rp"]) > 0 for r in got)
        assert abs(sum(r["w"] for r in got) - best) < 1e-6


def test_related_threads_leave_pairs_of_late_bands_unmade(spark):
    from folioframe.operators import threads as TH

    rng = np.random.default_rng(8)
    rows = [(k, 1000 * int(rng.integers(0, 9)), 1000 * int(rng.integers(9, 20)), int(p)) for k in range(120) for p in rng.choice(15, 7, replace=False)]
    first = {k: rows[7 * k][1] for k in range(120)}
    rows = [(k, first[k], n, p) for k, _, n, p in rows]
    light = spark.createDataFrame(rows, "thread_id long, f long, l long, person long").withColumn("heavy", F.array().cast("array<bigint>"))
    people = {k: {r[3] for r in rows if r[0] == k} for k in range(120)}
    pairs = {k: sorted((first[o], o) for o in people if o != k and len(people[k] & people[o]) >= 2) for k in people}
    got = [tuple(r) for r in TH._light_pairs(Scratch(spark, "bands"), light, 10**9, 2, 4, 16).collect()]
    assert len(set(got)) == len(got) < sum(map(len, pairs.values())) // 4
    for k in people:
        assert sorted((f, o) for t, o, f in got if t == k)[:4] == pairs[k][:4]
