"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, partitions

WEIGHTS = (5, 2, 1)
MOST = 3.0
#: Rows that one rounding task pairs at a time.
GROUP = 8192
_NEAR = 1e-9


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources stand in code-point order, null last, and weigh the given weights in turn. They share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared anew until none is above.
    Ranks come from a range-partitioned sort, so any number of sources will do; only sums reach the driver.
    """
    spark = scratch.spark
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    part = scratch.write(
        total.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
    )
    counts = part.groupBy(F.shiftright("at", 33).alias("p")).count().collect()  # one row a partition
    first, seen = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        first[p], seen = seen, seen + n
    starts = spark.createDataFrame(list(first.items()) or [(0, 0)], "p long, first long")
    ranked = part.join(F.broadcast(starts), F.shiftright("at", 33) == starts.p).selectExpr("source", "source_size", "first + (at & 8589934591) as place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = scratch.write(ranked.withColumn("weight", weight).withColumn("level", F.lit(most) * F.col("source_size") / F.col("weight")))
    # a source is capped as soon as the common level passes its own
    level, capped = None, -1
    while True:
        is_capped = F.lit(False) if level is None else F.col("level") < level
        n, held, free, everything = ranked.agg(
            F.count(F.when(is_capped, 1)), F.sum(F.when(is_capped, F.lit(most) * F.col("source_size"))),
            F.sum(F.when(~is_capped, F.col("weight"))), F.sum("source_size"),
        ).first()
        if n == capped or not free:
            break
        capped, level = n, ((everything or 0) - (held or 0.0)) / free
    target = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(level or 0.0))
    return ranked.select("source", "source_size", target.alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds copy probabilities pair by pair, in the given order: words move at random within a pair until one of
    the two probabilities is 0 or 1. Each expected value stays, and so does the sum of p * size, but for the one
    probability that may be left between.

    A row much longer than all that follow is drawn at once, and those that follow take up the words it is off by, in
    equal shares of probability; so what is left in the end is short.
    """
    open_row = (p > _NEAR) & (p < 1 - _NEAR)
    behind = lambda x, f, none: f.accumulate(np.where(open_row, x, none)[::-1])[::-1].tolist() + [none]
    words, least, most = behind(size, np.add, 0.0), behind(p, np.minimum, 1.0), behind(p, np.maximum, 0.0)
    p, s, draws = p.tolist(), size.tolist(), rng.random((2, p.size)).tolist()
    left, shift = -1, 0.0
    for i in range(len(p)):
        if not open_row[i]:
            p[i] = float(round(p[i]))
            continue
        if left >= 0 and s[left] >= 4 * s[i] and s[left] / words[i] < min(least[i] + shift, 1 - most[i] - shift):
            drawn = float(draws[1][i] < p[left])
            shift += (p[left] - drawn) * s[left] / words[i]
            p[left], left = drawn, -1
        p[i] += shift
        if left < 0:
            left = i
            continue
        a, b, r = p[left], p[i], s[i] / s[left]
        up, down = min(1 - a, b * r), min(a, (1 - b) * r)
        move = up if draws[0][i] * (up + down) < down else -down
        p[left], p[i] = a + move, b - move / r
        held, left = left, -1
        for j in (held, i):
            if _NEAR < p[j] < 1 - _NEAR:
                left = j
            else:
                p[j] = float(round(p[j]))
    return np.array(p)


def _rounded(table: pa.Table) -> pa.Table:
    size, h, p = (table.column(c).to_numpy() for c in ("size", "h", "p"))
    order = np.lexsort((h, -size))  # the smallest is what may be left
    out = np.empty(p.size)
    out[order] = pivotal(p[order], size[order], np.random.Generator(np.random.Philox(int(np.bitwise_xor.reduce(h.view(np.uint64)) >> np.uint64(1)))))
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))


def dependent_round(scratch: Scratch, rows: DataFrame, by: str, group: int = GROUP) -> DataFrame:
    """Rounds column p (0 to 1) of rows (by, h, size, p, ...) to 0 or 1 within each value of ``by``.

    A reduction tree: rows are dealt to groups of about ``group`` by their hash, each group leaves one residual at
    most, and residuals meet again in groups until one a source is left; that one is drawn by its probability.
    A source of any share of the rows is many groups.
    """
    n = rows.groupBy(by).count().selectExpr(f"{by} as _by", f"cast(ceil(count / {group}) as long) as _groups")
    rows = rows.join(n, rows[by].eqNullSafe(n["_by"])).drop("_by").withColumn("_block", F.expr("pmod(h, _groups)"))
    rows = scratch.write(rows)
    settled, open_rows = None, rows
    while True:
        # a group of one block is the last of its source: what it leaves is drawn
        done = scratch.write(open_rows.groupBy(by, "_block").applyInArrow(_rounded, open_rows.schema))
        whole = (F.col("p") <= _NEAR) | (F.col("p") >= 1 - _NEAR)
        last = F.col("_groups") <= 1
        u = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 52)) / float(1 << 52)
        part = done.where(whole | last).withColumn("p", F.when(whole, F.round("p")).otherwise((u < F.col("p")).cast("double")))
        settled = part if settled is None else settled.unionByName(part)
        open_rows = done.where(~whole & ~last).withColumn("_groups", F.expr(f"cast(ceil(_groups / {group}) as long)")).withColumn("_block", F.expr(f"pmod(xxhash64(_block, {group}), _groups)"))
        if open_rows.isEmpty():
            return settled.drop("_block", "_groups")


def row_hash(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7):
    """Of a row's id, text and source, so that rows without an id, or of one id, are rows of their own."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(source_col), F.lit("")), F.lit(seed))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken, h) of every row; h tells rows apart but for exact repeats.

    size: words of the whole text, parted by ASCII white space (null or empty: 0). A source's rows all get
    target / source_size copies in expectation, at most ``most``; whole copies are sure and the rest is rounded by
    dependent_round. Sources without words have target 0, and their rows 0 copies. Repeated rows are rows of their
    own; an empty table gives an empty result. Columns of other names are ignored; ids may be null.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows = scratch.write(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.col(source_col).alias("source"), row_hash(id_col, text_col, source_col, seed).alias("h")))
    targets = source_targets(scratch, rows, weights, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rated = (
        rows.join(targets, rows.source.eqNullSafe(targets["_source"])).drop("_source").withColumn("rate", rate)
        .withColumn("base", F.floor("rate")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(0.0))
    )
    picked = dependent_round(scratch, rated, "source")
    copies = (F.col("base") + F.col("p")).cast("long")
    return picked.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; those of 0 copies go. Rows of one id, or of none, are taken each for itself;
    exact repeats of a row share the copies of all of them as evenly as can be. An empty table gives an empty one, null
    texts have no words and go, columns of any names stay."""
    key, n, c, k, at = (fresh(docs, x) for x in ("_h", "_copies", "_all", "_rows", "_at"))
    taken = mix(docs).groupBy(F.col("h").alias(key + "m")).agg(F.sum("copies").alias(c), F.count("*").alias(k)).where(F.col(c) > 0)
    rows = docs.withColumn(key, row_hash()).join(taken, F.col(key) == F.col(key + "m"))
    # the join has dealt and sorted the rows by their hash, as the window wants them
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    share = F.floor(F.col(c) / F.col(k)) + F.when(F.col(at) <= F.col(c) % F.col(k), 1).otherwise(0)
    out = rows.withColumn(at, nth).withColumn(n, share).where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
