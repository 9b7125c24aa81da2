"""Operators over the whole of their input, against brute force on small tables."""

import datetime as dt
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import cluster as C
from folioframe.plans import queries as Q
from folioframe.plans.scratch import Scratch


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "whole")


def merged(sim, link, threshold):
    """Average linkage, written as plainly as can be."""
    groups = [[i] for i in range(len(sim))]
    s = lambda g, h: np.mean([sim[a, b] for a in g for b in h])
    while True:
        found = [(s(g, h), -x, -y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y and any(link[a, b] for a in g for b in h)]
        if not found or max(found)[0] < threshold:
            return sorted(map(sorted, groups))
        _, x, y = max(found)
        groups[-x] += groups.pop(-y)


def clouds(n=60, dim=8):
    """Records of several people, whose vectors lie about a few centres; strong pairs join the people."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, dim))
    vec = centres[np.arange(n) % 6] + 0.45 * rng.standard_normal((n, dim))
    return [(f"r{i:02}", [float(x) for x in vec[i]], [f"p{i % 9}"], [f"e{i % 11}"]) for i in range(n)]


@pytest.mark.parametrize("threshold, most", [(0.4, 2000), (0.4, 5), (0.62, 5)])
def test_clusters_across_people(spark, scratch, threshold, most):
    rows = clouds()
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    same = lambda k: np.array([[bool(set(a[k]) & set(b[k])) for b in rows] for a in rows])
    want = merged(cos + 0.25 * same(3), same(2) | (cos >= 0.85), threshold)
    got = C.cluster_records(scratch, spark.createDataFrame(rows, "record_id string, vec array<double>, people array<string>, entities array<string>"), threshold, most=most)
    told: dict = {}
    for r in got.collect():
        told.setdefault(r["root"], []).append(int(r["record_id"][1:]))
    assert sorted(map(sorted, told.values())) == want


def test_strong_edges_connect_all(spark, scratch):
    rows = [(r[0], r[1]) for r in clouds(50, 4)] + [("zero", [0.0] * 4), ("none", None)]
    got = C.strong_edges(scratch, spark.createDataFrame(rows, "record_id string, vec array<double>"), block=7).collect()
    u = np.array([r[1] for r in rows[:50]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)

    def parts(edges):
        of = list(range(50))
        for a, b in edges:
            of = [of[a] if x == of[b] else x for x in of]
        return sorted(sorted(i for i in range(50) if of[i] == k) for k in set(of))

    assert parts([(int(r["a"][1:]), int(r["b"][1:])) for r in got]) == parts(zip(*np.nonzero(u @ u.T >= 0.85)))


# ---------------------------------------------------------------- queries over whole tables

@pytest.fixture()
def tables(spark, tmp_path):
    """Writes small tables in place of the driver's and gives their folder."""

    def write(**frames):
        for name, (rows, ddl) in frames.items():
            spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_citations_of_whole_texts(spark, tables):
    d = tables(documents=([(1, " ".join(f"Sentence number {i} stands here." for i in range(30))), (2, "One only.")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in Q.QUERIES["q_citations_enforced"](spark, d).collect()}
    kept = " ".join(f"Sentence number {i} stands here. [^1]." for i in range(0, 30, 3))
    assert got[1]["digest"] == hashlib.md5(kept.encode()).hexdigest() and got[2]["dropped"] == 0


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double"


def orders(n=120):
    rng = np.random.default_rng(2)
    day = lambda k: dt.datetime(1995, 1, 1) + dt.timedelta(days=int(k))
    return [(i, int(c), day(t), f"{i % 5 + 1}-P", float(p)) for i, (c, t, p) in enumerate(zip(rng.integers(1, 8, n), rng.integers(0, 300, n), rng.integers(1000, 500000, n)))]


def test_lanes_of_all_customers(spark, tables):
    rows, want = orders(), {}
    for c in {r[1] for r in rows}:
        ends: list = []
        for k, _, s, *_ in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0])):
            free = [i for i, e in enumerate(ends) if e <= s]
            row = free[0] if free else len(ends)
            ends[row : row + 1] = [s + dt.timedelta(days=60)]
            want[k] = (c, row)
    got = Q.QUERIES["q_lane_packing"](spark, tables(orders=(rows, ORDERS))).collect()
    assert {r["k"]: (r["lane"], r["row"]) for r in got} == want and len(got) == len(rows)


def test_assignment_of_all_parts(spark, tables):
    rng = np.random.default_rng(3)
    rows = [(i, f"Brand#{i % 2}", int(5 + 40 * (i % 4 > 1) + i // 4), float(900 + rng.integers(0, 400))) for i in range(16)]
    got = Q.QUERIES["q_assignment"](spark, tables(part=(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double"))).collect()
    best = 0.0
    for brand in ("Brand#0", "Brand#1"):
        l, r = ([x for x in rows if x[1] == brand and (x[2] > 25) == big] for big in (False, True))
        best += max(sum(max(0.0, round(1 - abs(a[3] - b[3]) / 300, 4)) for a, b in zip(l, p)) for p in itertools.permutations(r))
    assert abs(sum(x["w"] for x in got) - best) < 1e-6 and len({x["l"] for x in got}) == len(got) == len({x["r"] for x in got})


def test_chain_of_all_lines(spark, tables):
    edges = [(1, 7, 3, 9.0), (600, 7, 1, 1.0), (600, 8, 2, 4.0), (900, 8, 5, 2.0), (901, 9, 1, 1.0)]
    d = tables(lineitem=(edges, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"))
    got = {r["node"] for r in Q.QUERIES["q_chain_expansion_whole"](spark, d).collect()}
    assert got == {1, 600, 900, -8, -9}


def test_hybrid_finds_documents_without_vectors(spark, tables):
    docs = [(i, "some plain words") for i in range(20)] + [(50, "thand of reanthe erwh estion"), (3, "a reanthe")]
    vecs = [(i, [float((i * k) % 5 - 2) for k in range(64)]) for i in range(30, 42)]
    got = Q.QUERIES["q_hybrid_retrieve"](spark, tables(documents=(docs, "doc_id long, text string"), embeddings=(vecs, "vec_id long, embedding array<float>"))).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == 8 and 50 in ids and 3 in ids and any(30 <= i < 42 for i in ids)


def test_theta_joins_of_all_orders(spark, tables):
    rows = orders()
    d = tables(orders=(rows, ORDERS))
    pairs = [(a[0], b[0], abs((a[2] - b[2]).days)) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1]]
    got = Q.QUERIES["q_near_dates_whole"](spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, b, n in pairs if n <= 5)
    got = Q.QUERIES["q_interval_overlap_whole"](spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, b, n in pairs if n <= 5)  # three days long, widened by two


def test_threads_and_components_of_all_lines(spark, tables):
    day = lambda k: dt.datetime(1995, 1, 1) + dt.timedelta(days=k)
    rng = np.random.default_rng(5)
    lines = [(int(rng.integers(0, 60)), int(rng.integers(0, 9)), int(s), day(int(20 * s + rng.integers(0, 20))), int(i % 7 + 1)) for i, s in enumerate(rng.integers(0, 8, 50))]
    d = tables(lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate timestamp, l_linenumber int"))
    of = {s: [x for x in lines if x[2] == s] for s in {x[2] for x in lines}}
    near = {}
    for a, x in of.items():
        lo, hi = min(r[3] for r in x) - dt.timedelta(days=14), max(r[3] for r in x) + dt.timedelta(days=14)
        found = sorted((min(r[3] for r in y), b) for b, y in of.items() if a != b and len({r[1] for r in x} & {r[1] for r in y}) >= 2 and max(r[3] for r in y) >= lo and min(r[3] for r in y) <= hi)
        near |= {(a, b): k + 1 for k, (_, b) in enumerate(found[:10])}
    assert {(r["thread_id"], r["other_id"]): r["rank"] for r in Q.QUERIES["q_related_threads_whole"](spark, d).collect()} == near and near
    least = {n: n for x in lines for n in (x[0], -1 - x[1])}
    for _ in lines:
        for x in lines:
            m = min(least[x[0]], least[-1 - x[1]])
            least = {n: m if c in (least[x[0]], least[-1 - x[1]]) else c for n, c in least.items()}
    assert {r["node"]: r["component"] for r in Q.QUERIES["q_graph_components_whole"](spark, d).collect()} == least
