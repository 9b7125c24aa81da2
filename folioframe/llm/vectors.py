"""Vector operators: near-duplicate links by a random-projection forest, and exact top-k by norm buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, partitions

# ---------------------------------------------------------------- near-duplicates

COSINE, TREES, LEAF, CHUNK, SAMPLE, SEED = 0.98, 6, 512, 2048, 50_000, 20


def _finite(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _directions(dim: int, tree: int, depth: int) -> np.ndarray:
    out = np.random.default_rng([SEED, dim, tree]).standard_normal((max(depth, 1), dim))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_forest(sample: dict, depths: dict, spill: dict, trees: int = TREES) -> dict:
    """Split points by (group, tree): {node: threshold}. A node splits its sample at a point drawn between the 40th
    and 60th percentile of the level's random direction; nodes whose sample has run out use the group's median."""
    out = {}
    for group, x in sample.items():
        for t in range(trees):
            rng, dirs, cut = np.random.default_rng([SEED, t, 1]), _directions(x.shape[1], t, depths[group]), {}
            nodes = {1: np.arange(len(x))}
            for level in range(depths[group]):
                at, below = x @ dirs[level], {}
                cut[-level] = float(np.median(at)) if len(at) else 0.0
                for node, rows in nodes.items():
                    if len(rows) < 8:
                        continue
                    cut[node] = c = float(np.quantile(at[rows], rng.uniform(0.4, 0.6)))
                    below[2 * node] = rows[at[rows] <= c + spill[group]]
                    below[2 * node + 1] = rows[at[rows] > c - spill[group]]
                nodes = below
            out[group, t] = cut
    return out


def leaves(x: np.ndarray, cut: dict, tree: int, depth: int, spill: float) -> list[list[int]]:
    """The leaves of one tree that each row falls into; rows within the spill of a split go both ways."""
    rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
    for level, d in enumerate(_directions(x.shape[1], tree, depth)[:depth]):
        ids, inv = np.unique(node, return_inverse=True)
        gap = (x @ d)[rows] - np.array([cut.get(int(i), cut[-level]) for i in ids])[inv]
        low, high = gap <= spill, gap > -spill
        rows, node = np.concatenate((rows[low], rows[high])), np.concatenate((2 * node[low], 2 * node[high] + 1))
    out = [[] for _ in range(len(x))]
    for r, n in zip(rows.tolist(), node.tolist()):
        out[r].append(n)
    return out


def _links(a: pa.Table, b: pa.Table | None, own: int, cosine: float) -> tuple:
    """(i, j, links of a, links of b) of the links within chunk a, or between chunks a and b of a leaf. A link counts
    only in the first leaf of the first tree that both its rows share; i and j hold all of them."""
    other = a if b is None else b
    ok = _matrix(a["x"]) @ _matrix(other["x"]).T >= cosine
    if b is None:
        np.fill_diagonal(ok, False)
    i, j = np.nonzero(ok)

    def coded(t):  # equal lists of leaves are compared once, however many rows have them
        lists = [tuple(v) for v in t["leaves"].to_pylist()]
        known = {v: k for k, v in enumerate(dict.fromkeys(lists))}
        return np.array([known[v] for v in lists], np.int64), [set(v) for v in known]

    ca, la = coded(a)
    cb, lb = (ca, la) if b is None else coded(b)
    pairs, inv = np.unique(ca[i] * len(lb) + cb[j], return_inverse=True)
    first = np.array([min(la[p // len(lb)] & lb[p % len(lb)]) == own for p in pairs.tolist()], bool)
    mine = first[inv] if i.size else np.zeros(0, bool)
    wa, wb = a["n"].to_numpy(), other["n"].to_numpy()
    of_a = np.bincount(i[mine], wb[j[mine]], len(a)).astype(np.int64)
    return i, j, of_a, np.zeros(0, np.int64) if b is None else np.bincount(j[mine], wa[i[mine]], len(b)).astype(np.int64)


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (i, j)."""
    at = np.arange(n)
    while True:
        new = at.copy()
        np.minimum.at(new, i, at[j])
        np.minimum.at(new, j, at[i])
        new = new[new]
        if (new == at).all():
            return at
        at = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF, sample_rows: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row whose id isn't null.

    Compares rows of one label (not null) and one width by cosine in double precision. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Recursive random splits over several trees, with
    overlap about each split; rows are compared within leaves only, so a link is never wrong but may be missed.
    Split points come from a sample of ``sample_rows`` rows at most (the rows of least hash); every row is indexed.
    A leaf of many rows is compared chunk by chunk; links are counted where they are found and each leaf passes on
    one edge a row, so a group of n near copies makes n rows and not n * n. Of rows that share an id the
    least vector and label stand for it. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "rptree")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null")
    src = src.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    usable = src.where(F.col("label").isNotNull() & _finite(F.col("v"))).withColumn("norm", norm).where("norm > 0 and norm < double('inf')")
    # equal vectors of a label are one row with a count
    rows = usable.groupBy(F.struct("label", F.size("v").alias("dim")).alias("g"), F.transform("v", lambda x: x / F.col("norm")).alias("x")).agg(F.min("vec_id").alias("rid"), F.count("*").alias("n"))
    rows = scratch.write(rows.withColumn("grp", F.concat_ws("/", F.col("g.label").cast("string"), F.col("g.dim").cast("string"))).select("grp", "x", "rid", "n"))
    ids = scratch.write(src.select("vec_id"))
    member = scratch.write(usable.select("vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("grp"), F.transform("v", lambda x: x / F.col("norm")).alias("x")))
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * 0.98 * (1 << 30)) if share < 1 else F.lit(True)).select("grp", "x")
    sample: dict[str, list] = {}
    for r in picked.limit(sample_rows).toLocalIterator():
        sample.setdefault(r["grp"], []).append(r["x"])
    sample = {g: np.array(v) for g, v in sample.items()}
    depths = {g: max(0, int(np.ceil(np.log2(len(x) / share / leaf_rows)))) for g, x in sample.items()}
    spill = {g: 0.8 * np.sqrt(max(0.0, 2 - 2 * cosine) / x.shape[1]) for g, x in sample.items()}
    forest = spark.sparkContext.broadcast((fit_forest(sample, depths, spill, trees), depths, spill))

    def route(batches):
        cuts, depths, spill = forest.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            grp = np.array(t["grp"].to_pylist(), dtype=object)
            for g in dict.fromkeys(grp.tolist()):
                part = t.take(np.flatnonzero(grp == g))
                x = _matrix(part["x"])
                # a group too small for the sample to know is one leaf
                lists = [[] for _ in range(len(x))]
                for k in range(trees if g in depths and depths[g] else 1):
                    for all_of, found in zip(lists, leaves(x, cuts[g, k], k, depths[g], spill[g]) if g in depths else [[1]] * len(x)):
                        all_of.extend((k << 48) | n for n in found)
                yield from part.append_column("leaves", pa.array(lists, pa.list_(pa.int64()))).to_batches()

    routed = scratch.write(rows.mapInArrow(route, "grp string, x array<double>, rid bigint, n bigint, leaves array<bigint>"))
    placed = routed.withColumn("leaf", F.explode("leaves"))
    # leaves of many rows are dealt to chunks, and each pair of chunks is a task of bounded size
    chunks = placed.groupBy("grp", "leaf").count().selectExpr("grp as g2", "leaf as l2", f"cast(ceil(count / {CHUNK}) as int) as c").where("c > 1")
    placed = placed.join(chunks, (placed.grp == chunks.g2) & (placed.leaf == chunks.l2), "left").withColumn("c", F.coalesce("c", F.lit(1))).drop("g2", "l2")
    placed = placed.withColumn("k", F.pmod(F.xxhash64("rid"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    paired = placed.withColumn("o", other).withColumn("lo", F.least("k", "o")).withColumn("hi", F.greatest("k", "o"))

    def compare(key, table):
        own, lo, hi = (key[n].as_py() for n in (1, 2, 3))
        k = table["k"].to_numpy()
        a, b = table.take(np.flatnonzero(k == lo)), table.take(np.flatnonzero(k == hi)) if lo != hi else None
        if not len(a) or b is not None and not len(b):
            return out_schema.empty_table()
        i, j, of_a, of_b = _links(a, b, own, cosine)
        rid = np.concatenate((a["rid"].to_numpy(), b["rid"].to_numpy() if b is not None else np.zeros(0, np.int64)))
        order = np.argsort(rid, kind="stable")  # so that the least index is the least id
        rank = np.empty_like(order)
        rank[order] = np.arange(len(rid))
        root = rid[order][_least(len(rid), rank[i], rank[j + (len(a) if b is not None else 0)])][rank]
        links = np.concatenate((of_a, of_b))
        some = (links > 0) | (root != rid)
        return pa.table([rid[some], links[some], root[some]], schema=out_schema)

    out_schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = scratch.write(paired.select("grp", "leaf", "lo", "hi", "k", "rid", "n", "x", "leaves").groupBy("grp", "leaf", "lo", "hi").applyInArrow(compare, "rid bigint, links bigint, root bigint"))
    least = components(scratch, found.selectExpr("rid a", "root b")).withColumnsRenamed({"node": "cn", "component": "cc"})
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    per = rows.select("grp", "x", "rid", "n").join(counts, "rid", "left").join(least, F.col("rid") == F.col("cn"), "left")
    per = per.select("grp", "x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("cc", "rid").alias("cc"))
    of = member.join(per.withColumnsRenamed({"grp": "g2", "x": "x2"}), (member.grp == F.col("g2")) & (member.x == F.col("x2"))).selectExpr("vec_id mid", "links", "cc")
    out = ids.join(of, ids.vec_id == of.mid, "left")
    component = F.coalesce("cc", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exact where every leaf holds a whole label, as on small tables; beyond, the forest may miss links.
ORACLE_LINKS = """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and embedding is not null),
pairs as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, p.b from reach r join pairs p on p.a = r.other),
least as (select vec_id, min(other) m from reach group by 1),
n as (select a, count(*) n from pairs group by 1)
select e.vec_id, coalesce(n.n, 0) n_links, coalesce(l.m, e.vec_id) component_id, coalesce(l.m, e.vec_id) = e.vec_id kept
from embeddings e left join least l using (vec_id) left join n on n.a = e.vec_id
"""

# ---------------------------------------------------------------- exact top-k

K, SCALE, EVERY, BUCKET, QUERIES = 5, 256, 50, 4096, 1024
#: From this local cosine threshold on, one coordinate is tried before the product; below it, length alone prunes.
COORDINATE = 0.35


def _pack(size: int):
    """Packs rows that arrive by falling norm into blocks of at most ``size`` rows."""

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while len(rest) >= size:
                yield from blocks(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and len(rest):
            yield from blocks(rest)

    def blocks(t):
        dims = np.array(t["dim"].to_pylist())
        for d in np.unique(dims):
            whole, step = t.take(np.flatnonzero(dims == d)).combine_chunks(), max(16, min(size, size * 64 // int(d)))
            for at in range(0, len(whole), step):
                yield block(whole.slice(at, step).combine_chunks(), d)

    def block(part, d):
        m = part["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        kind = next(k for k in _WIDTHS if not m.size or np.iinfo(_WIDTHS[k]).min <= m.min() and m.max() <= np.iinfo(_WIDTHS[k]).max)
        return pa.RecordBatch.from_pydict({"dim": pa.array([int(d)], pa.int32()), "top": pa.array([float(part["norm"][0].as_py())]), "ids": [part["vec_id"].to_numpy().tobytes()], "norms": [part["norm"].to_numpy().tobytes()], "w": pa.array([kind], pa.int32()), "m": [m.astype(_WIDTHS[kind]).tobytes()]}, schema=_BLOCK)

    return run


#: Components travel in the narrowest of these that holds a block's, by bytes.
_WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}
_BLOCK = pa.schema([("dim", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("norms", pa.binary()), ("w", pa.int32()), ("m", pa.binary())])
_BLOCK_SQL = "dim int, top double, ids binary, norms binary, w int, m binary"


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    # doubles hold every partial sum exactly below 2 ** 53
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # an error where a product doesn't fit


def _search(qid, q, qn, theta, cid, c, cn, k):
    """(query row, candidate row, score) of each query's k best of one bucket, of those that reach its bound theta."""
    out = []
    for at in range(len(qid)):
        top = qn[at] * cn[0]
        if top < theta[at] - 1e-6 * abs(theta[at]) - 1e-6:
            continue  # by length, the whole bucket
        local = theta[at] / top if top > 0 else -1.0
        n = len(cn) if theta[at] <= 0 or qn[at] == 0 else int(np.searchsorted(-cn, -(theta[at] / qn[at]) * (1 - 1e-9) + 1e-6, "right"))
        rows = np.arange(n)
        if local >= COORDINATE:
            # a unit vector within arccos(local) of the query's has its largest coordinate in this range
            unit = q[at] / qn[at]
            f = int(np.abs(unit).argmax())
            wide = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit[f] ** 2))
            low = unit[f] * local - wide if -unit[f] < local else -1.0
            high = unit[f] * local + wide if unit[f] < local else 1.0
            if unit[f] >= local:
                high = 1.0
            if -unit[f] >= local:
                low = -1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                at_f = np.where(cn[:n] > 0, c[:n, f] / cn[:n], 0.0)
            rows = np.flatnonzero((at_f >= low - 1e-9) & (at_f <= high + 1e-9))
        if not rows.size:
            continue
        score = _products(q[at : at + 1], c[rows], top)[0]
        good = (score >= theta[at]) & (cid[rows] != qid[at])
        rows, score = rows[good], score[good]
        if rows.size > k:
            order = np.lexsort((cid[rows], -score))[:k]
            rows, score = rows[order], score[order]
        out.append((np.full(rows.size, at), rows, score))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products among all other rows.

    Components become floor(scale * x). Ties go to the smaller id. A product beyond 64 bits is an error, never a wrong score. Vectors that are null, empty or hold null or
    non-finite components, and rows of null id, take no part; only vectors of one width meet. Of rows that share an
    id the least vector stands for it. An empty table gives an empty result. ``is_query`` is an expression over
    vec_id. Candidates are dealt by length to buckets of falling norm. The longest bucket gives each query a bound;
    then buckets, and rows of a bucket, go by length, or by one coordinate where the local cosine threshold is high.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _finite(F.col("v")))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"), F.size("v").alias("dim"))
    v = scratch.write(v.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))))
    n = v.count()
    by = [F.col("dim"), F.col("norm").desc(), F.col("vec_id")]

    def packed(df, size, rows):
        parts = max(1, min(-(-rows // size), 4 * partitions(spark)))
        blocks = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pack(size), _BLOCK_SQL)
        return scratch.write(scratch.write(blocks).repartitionByRange(parts, F.col("dim"), F.col("top").desc()).sortWithinPartitions("dim", F.col("top").desc()).withColumn("b", F.monotonically_increasing_id()))

    buckets, queries = packed(v, BUCKET, n), packed(v.where(is_query), QUERIES, n)
    schema = "query_id bigint, vec_id bigint, score bigint, b bigint"

    def unpack(row):
        ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"])
        return ids, norms, np.frombuffer(row["m"], _WIDTHS[row["w"]]).reshape(len(ids), -1)

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cid, cn, c = unpack(r["c"])
                qid, qn, q = unpack(r["q"])
                bound = np.frombuffer(r["theta"]) if r["theta"] is not None else np.full(len(qid), -np.inf)
                i, j, score = _search(qid, q, qn, bound, cid, c, cn, k)
                yield pa.RecordBatch.from_pydict({"query_id": qid[i], "vec_id": cid[j], "score": score, "b": np.full(len(i), r["qb"])}, schema=pa.schema([(x, pa.int64()) for x in ("query_id", "vec_id", "score", "b")]))

    salts = partitions(spark)

    def meet(qs, cs):
        # blocks are paired by their numbers and bounds alone; salts part the pairs of one width
        left = qs.select("b", "dim", "top", "least").toDF("qb", "qd", "qtop", "least").withColumn("qs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = cs.select("b", "dim", "top", (F.col("b") % salts).cast("int").alias("s"))
        near = F.col("least").isNull() | (F.col("qtop") * F.col("top") >= F.col("least"))
        pairs = left.join(right, (F.col("qd") == F.col("dim")) & (F.col("qs") == F.col("s")) & near).select("qb", "b")
        queries_of = qs.select(F.col("b").alias("qb"), "theta", F.struct("ids", "norms", "w", "m").alias("q"))
        met = pairs.join(queries_of, "qb").join(cs.select("b", F.struct("ids", "norms", "w", "m").alias("c")), "b")
        return met.select("qb", "theta", "q", "c").mapInArrow(search, schema)

    # the longest bucket of each width seeds the bounds
    seeds = buckets.groupBy("dim").agg(F.min("b").alias("b"))
    blank = queries.withColumn("theta", F.lit(None).cast("binary")).withColumn("least", F.lit(None).cast("double"))
    first = scratch.write(meet(blank, buckets.join(F.broadcast(seeds.select("b")), "b", "left_semi")))

    def bounds(key, left, right):
        r = left.to_pylist()[0]
        qid = np.frombuffer(r["ids"], np.int64)
        best = np.full(len(qid), -np.inf)
        ids, score = right["query_id"].to_numpy(), right["score"].to_numpy()
        order = np.lexsort((-score, ids))
        ids, score = ids[order], score[order]
        start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0)) if len(ids) else np.zeros(0, int)
        full = [s for s in start if s + k - 1 < len(ids) and ids[s + k - 1] == ids[s]]
        at = {int(i): p for p, i in enumerate(qid)}
        for s in full:
            best[at[int(ids[s])]] = score[s + k - 1]
        return pa.table({"b": [r["b"]], "theta": [best.tobytes()], "least": [float(best.min())]}, schema=pa.schema([("b", pa.int64()), ("theta", pa.binary()), ("least", pa.float64())]))

    theta = scratch.write(queries.select("b", "ids").groupBy("b").cogroup(first.groupBy("b")).applyInArrow(bounds, "b bigint, theta binary, least double"))
    # norms are rounded, so the bucket test leaves a margin
    held = queries.join(theta, "b").withColumn("least", F.when(F.col("least") > -1e300, F.col("least") - 1e-6 * F.abs("least") - 1))
    rest = meet(held, buckets.join(F.broadcast(seeds.select("b")), "b", "left_anti"))
    all_of = first.select("query_id", "vec_id", "score").unionAll(scratch.write(rest).select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return all_of.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


ORACLE_TOP = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q from embeddings where embedding is not null),
s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score from s
qualify rank <= 5
"""
