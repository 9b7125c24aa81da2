"""Exact cosine searches without all pairs: vectors lie in cells about pivots, sorted by their angle to the pivot, and blocks of
them meet only where the triangle inequality of angles lets a pair be near enough."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, partitions
from .running import running

#: Pivots (rows of least hash), rows of a block, and what rounding may add to an angle or take from a cosine.
PIVOTS, BLOCK, SLACK = 64, 512, 1e-6
#: Blocks that a task holds while others pass by.
HELD = 64


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the usable rows, their vectors at length one): not null, of the width, finite, not all zero."""
    vectors = column.to_pylist()
    some = [k for k, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    x = np.array([vectors[k] for k in some], float).reshape(len(some), dim)
    n = np.sqrt((x * x).sum(1))
    good = np.isfinite(n) & (n > 0)
    return np.array(some, int)[good], x[good] / n[good][:, None]


def _blocks(scratch: Scratch, vectors: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray, size: int, group: str | None = None) -> DataFrame:
    """(b, grp, cell, lo, hi, near_lo, near_hi, ids, u): blocks of at most ``size`` vectors of one cell (of one group, a long), in a
    range of angles to its pivot, with the ranges of their angles to all pivots."""
    kind, dim = dict(vectors.dtypes)[id_col], pivots.shape[1]

    def place(batches):
        for batch in batches:
            rows, u = _units(batch.column("v"), dim)
            if rows.size:
                cos = u @ pivots.T
                cell = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(u)), cell], -1, 1))
                yield pa.RecordBatch.from_pydict({"grp": batch.column("grp").take(pa.array(rows)), "id": batch.column("id").take(pa.array(rows)), "u": pa.array([r.tobytes() for r in u], pa.binary()), "cell": pa.array(cell.astype(np.int32)), "angle": angle})

    def pack(batches):
        rest, n = None, 0

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal n
            u = np.frombuffer(b"".join(t["u"].to_pylist())).reshape(len(t), dim)
            angles, own = np.arccos(np.clip(u @ pivots.T, -1, 1)), t["angle"].to_numpy()
            n += 1
            head = {"b": [(t["part"][0].as_py() << 32) + n], "grp": [t["grp"][0].as_py()], "cell": pa.array([t["cell"][0].as_py()], pa.int32()), "lo": [own.min()], "hi": [own.max()]}
            return pa.RecordBatch.from_pydict(head | {"near_lo": [angles.min(0)], "near_hi": [angles.max(0)], "ids": [t["id"].to_pylist()], "u": [u.tobytes()]})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while len(rest):
                cell, grp = rest["cell"].to_numpy(), rest["grp"].to_numpy()
                other = np.flatnonzero((cell != cell[0]) | (grp != grp[0]))
                same = int(other[0]) if other.size else len(rest)
                if same == len(rest) and same < size:
                    break
                yield block(rest.slice(0, min(same, size)).combine_chunks())
                rest = rest.slice(min(same, size))
        if rest is not None and len(rest):
            yield block(rest.combine_chunks())

    placed = vectors.select((F.col(group) if group else F.lit(0).cast("long")).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(place, f"grp bigint, id {kind}, u binary, cell int, angle double")
    dealt = placed.repartitionByRange(partitions(scratch.spark), "grp", "cell", "angle", "id").sortWithinPartitions("grp", "cell", "angle", "id").withColumn("part", F.spark_partition_id().cast("long"))
    return scratch.write(dealt.mapInArrow(pack, f"b bigint, grp bigint, cell int, lo double, hi double, near_lo array<double>, near_hi array<double>, ids array<{kind}>, u binary"))


def _pivots(vectors: DataFrame, id_col: str, vec_col: str, n: int) -> np.ndarray | None:
    some = vectors.where(F.size(vec_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(n).select(F.col(vec_col).cast("array<double>").alias("v"))
    rows = [r["v"] for r in some.collect()]
    widths = [len(v) for v in rows]
    if not rows:
        return None
    dim = max(set(widths), key=lambda w: (widths.count(w), w))
    _, u = _units(pa.array([v for v in rows if len(v) == dim], pa.list_(pa.float64())), dim)
    return u if len(u) else None


def _meetings(left: DataFrame, right: DataFrame, reach: Column) -> DataFrame:
    """(q, b, own, gap): blocks of left and right that may hold a pair within the angle ``reach`` (of left's columns). Each block on
    the right has a cell, and meets blocks on the left by it alone."""
    ranges = left.select(F.col("b").alias("q"), F.col("grp").alias("q_grp"), F.col("cell").alias("home"), reach.alias("reach"), F.posexplode(F.arrays_zip("near_lo", "near_hi")).alias("p", "near"))
    gap = F.greatest(F.col("near.near_lo") - F.col("hi"), F.col("lo") - F.col("near.near_hi"), F.lit(0.0))
    met = ranges.join(right.select("b", "grp", "cell", "lo", "hi"), (F.col("p") == F.col("cell")) & (F.col("q_grp") == F.col("grp"))).withColumn("gap", gap).where(F.col("gap") <= F.col("reach") + SLACK)
    return met.select("q", "b", (F.col("home") == F.col("cell")).alias("own"), "gap")


def _shares(scratch: Scratch, pairs: DataFrame, left: DataFrame, right: DataFrame, meet, schema: str) -> DataFrame:
    """Blocks that ``pairs`` (q, b) name meet, written. A share of left's blocks, neighbours in order, is held by a task, and those
    of right that any of them meets pass by, so a vector travels once a share and not once a pair of blocks. ``meet(share, rows)``
    has the held blocks by number and yields batches; rows are (numbers to meet, ids, vectors)."""
    pairs = scratch.write(pairs)
    order = running(scratch, left.join(pairs.select("q").distinct(), F.col("b") == F.col("q"), "left_semi").select("grp", "cell", "lo", "b", F.lit(1).alias("one")), "grp", ["cell", "lo", "b"], no=("one", "sum before"))
    order = scratch.write(order.select("grp", F.col("b").alias("q"), F.floor(F.col("no") / HELD).alias("share")))
    shares = order.select("grp", "share").distinct().count()
    splits = max(1, min(16, -(-2 * partitions(scratch.spark) // max(shares, 1))))
    split = F.pmod(F.xxhash64("b"), F.lit(splits)).cast("int")
    asked = pairs.join(order, "q").groupBy("grp", "share", "b").agg(F.collect_list("q").alias("qs"))
    moving = asked.join(right.select("b", "ids", "u"), "b").select("grp", "share", split.alias("split"), F.lit(1).alias("side"), "b", "qs", F.lit(None).cast(dict(left.dtypes)["ids"]).alias("q_ids"), "ids", "u")
    held = left.select(F.col("b").alias("q"), "ids", "u").join(order, "q").select("grp", "share", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("side"), F.col("q").alias("b"), F.array("q").alias("qs"), F.col("ids").alias("q_ids"), F.lit(None).cast(dict(right.dtypes)["ids"]).alias("ids"), "u")

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        for _, mine in itertools.groupby(rows(), lambda r: (r["grp"], r["share"], r["split"])):
            held: dict = {}
            for first in mine:
                if first["side"]:
                    yield from meet(held, ((r["qs"], r["ids"], r["u"]) for r in itertools.chain([first], mine)))
                else:
                    held[first["b"]] = first["q_ids"], first["u"]

    key = ["grp", "share", "split"]
    dealt = held.unionByName(moving).repartition(max(partitions(scratch.spark), min(shares * splits, 2000)), *key).sortWithinPartitions(*key, "side", "b")
    return scratch.write(dealt.mapInArrow(run, schema), small=True)


def _together(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return pairs.join(left.selectExpr("b q", "ids q_ids", "u q_u"), "q").join(right.select("b", "ids", "u"), "b").select("q", "b", "q_ids", "q_u", "ids", "u")


def top_cosine(scratch: Scratch, queries: DataFrame, items: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, cos, rank): for each query its k items of greatest cosine, of equals those of smaller id.

    Exact. A query's block first meets the nearest block of its own cell, which gives its queries a k-th best; then all
    blocks that can hold better ones. Vectors that are null, zero, or of another width than most pivots take no part."""
    found = _pivots(items, id_col, vec_col, pivots)
    kinds = dict(queries.dtypes)[id_col], dict(items.dtypes)[id_col]
    if found is None:
        return scratch.spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, cos double, rank int")
    left, right = (_blocks(scratch, df, id_col, vec_col, found, block) for df in (queries, items))
    dim = found.shape[1]

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[c]).reshape(-1, dim) for c in ("q_u", "u"))
                near = a @ b.T
                n = min(k, len(b))
                kth = np.partition(near, len(b) - n, axis=1)[:, len(b) - n] - 1e-9
                i, j = np.nonzero(near >= kth[:, None])
                cos = (a[i] * b[j]).sum(1)  # alike for equal vectors, wherever they stand
                ids = np.array(r["ids"], dtype=object)
                order = sorted(range(len(i)), key=lambda x: (i[x], -cos[x], ids[j[x]]))
                seen = np.zeros(len(a), int)
                kept = []
                for x in order:
                    seen[i[x]] += 1
                    if seen[i[x]] <= k:
                        kept.append(x)
                yield pa.RecordBatch.from_pydict({"q": pa.array([r["q"]] * len(kept), pa.int64()), "query_id": [r["q_ids"][i[x]] for x in kept], "id": [ids[j[x]] for x in kept], "cos": cos[kept]})

    schema = f"q bigint, query_id {kinds[0]}, id {kinds[1]}, cos double"
    home = _meetings(left, right, F.lit(np.pi)).where("own").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("gap", "b"))).where("n = 1").select("q", "b")
    home = scratch.write(home)
    first = scratch.write(_together(home, left, right).mapInArrow(search, schema))
    per = first.groupBy("q", "query_id").agg(F.count("*").alias("n"), F.min("cos").alias("kth")).where(F.col("n") >= k)
    least = per.groupBy("q").agg(F.count("*").alias("full"), F.min("kth").alias("least")).withColumnRenamed("q", "lq")
    bounded = left.join(least, F.col("b") == F.col("lq"), "left")
    reach = F.when(F.col("full") == F.size("ids"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))).otherwise(F.lit(float(np.pi)))
    rest = _meetings(bounded, right, reach).select("q", "b").join(home, ["q", "b"], "left_anti")

    def best(held, rows):
        """The k best of each held query among all that pass by."""
        asked = {q: (ids, u := np.frombuffer(raw).reshape(-1, dim), u.astype(np.float32)) for q, (ids, raw) in held.items()}
        bound = {q: np.full(len(ids), -np.inf) for q, (ids, _, _) in asked.items()}
        top: dict = {q: [[] for _ in ids] for q, (ids, _, _) in asked.items()}  # of each query (-cos, id) in order
        slack = 4e-7 * max(dim, 25)
        for qs, ids, raw in rows:
            b = np.frombuffer(raw).reshape(-1, dim)
            small = b.astype(np.float32).T
            for q in qs:
                _, a, rough = asked[q]
                near, least, found = rough @ small, bound[q], top[q]
                if np.isneginf(least).any() and len(b) >= k:
                    least = np.maximum(least, np.partition(near, len(b) - k, axis=1)[:, len(b) - k] - slack)
                i, j = np.nonzero(near >= (least - slack).astype(np.float32)[:, None])
                cos = np.concatenate([np.zeros(0), *((a[i[x : x + 65536]] * b[j[x : x + 65536]]).sum(1) for x in range(0, i.size, 65536))])
                for x, y, c in zip(i.tolist(), j.tolist(), cos.tolist()):
                    if c >= bound[q][x]:
                        bisect.insort(found[x], (-c, ids[y]))
                        if len(found[x]) > k:
                            found[x].pop()
                        if len(found[x]) == k:
                            bound[q][x] = -found[x][-1][0]
        for q, found in top.items():
            some = [(asked[q][0][x], one, -c) for x, row in enumerate(found) for c, one in row]
            if some:
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(some), pa.int64())} | dict(zip(("query_id", "id", "cos"), zip(*some))))

    every = first.unionByName(_shares(scratch, rest, left, right, best, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "cos", "rank")


def near_stars(scratch: Scratch, items: DataFrame, least: float, id_col: str = "id", vec_col: str = "vec", pivots: int = PIVOTS, block: int = BLOCK, group_col: str | None = None) -> DataFrame:
    """(a, b): edges that connect whatever the pairs of cosine >= least connect, within equal values of ``group_col`` if there is
    one (null ones are no group). Two blocks give a star for each group of the graph between them, not all pairs of the group. Exact;
    vectors as of ``top_cosine``.

    With groups, those of up to ``block`` rows meet as a whole; larger ones have cells and blocks of their own."""
    found = _pivots(items, id_col, vec_col, pivots)
    kind = dict(items.dtypes)[id_col]
    if found is None:
        return scratch.spark.createDataFrame([], f"a {kind}, b {kind}")
    dim, schema = found.shape[1], f"a {kind}, b {kind}"

    def between(ia: list, a: np.ndarray, ib: list, b: np.ndarray) -> list:
        near, out = a @ b.T >= least, []
        rest = near.any(1)
        while rest.any():
            rows, cols = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
            first = rest.argmax()
            fresh = np.arange(len(ia)) == first
            while fresh.any():
                rows |= fresh
                more = near[fresh].any(0) & ~cols
                cols |= more
                fresh = near[:, more].any(1) & ~rows
            rest &= ~rows
            out += [(ia[first], x) for x in {*(ia[n] for n in np.flatnonzero(rows)), *(ib[n] for n in np.flatnonzero(cols))} - {ia[first]}]
        return out

    def stars(held, rows):
        for qs, ids, raw in rows:
            out, b = [], np.frombuffer(raw).reshape(-1, dim)
            for q in qs:
                out += between(held[q][0], np.frombuffer(held[q][1]).reshape(-1, dim), ids, b)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip("ab", zip(*out))))

    def small(table: pa.Table) -> pa.Table:
        rows, u = _units(table["v"].combine_chunks(), dim)
        ids = table["id"].take(pa.array(rows)).to_pylist()
        out = between(ids, u, ids, u) if ids else []
        return pa.table([pa.array([e[n] for e in out], table["id"].type) for n in (0, 1)], names=["a", "b"])

    reach = F.lit(float(np.arccos(np.clip(least, -1, 1))))

    def large(rows: DataFrame, group: str | None) -> DataFrame:
        blocks = _blocks(scratch, rows, id_col, vec_col, found, block, group)
        pairs = _meetings(blocks, blocks, reach).where("q <= b").select("q", "b")
        return _shares(scratch, pairs, blocks, blocks, stars, schema)

    if group_col is None:
        return large(items, None)
    rows = scratch.write(items.where(F.col(group_col).isNotNull()).select(F.xxhash64(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).distinct())
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    few = rows.join(sizes.where(F.col("n") <= block), "grp", "left_semi").groupBy("grp").applyInArrow(small, schema)
    id_col, vec_col = "id", "v"
    many = rows.join(sizes.where(F.col("n") > block), "grp", "left_semi")
    return few.unionByName(large(many, "grp"))
