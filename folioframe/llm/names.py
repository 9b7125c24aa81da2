"""A join of names within two edits, swaps of neighbours included, by partitioned neighbourhoods: names of one side are cut in
three pieces, and one piece, or that piece without one code point, stands in the other name at a place that few shifts tell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_sql, lean

#: Edits of a pair at most. The cuts, shifts and filters below hold for two.
EDITS = 2
#: Code points of names that are compared at once.
CELLS = 1 << 21


def _places(n: Column, delta: int) -> list[tuple[Column, Column, Column]]:
    """(from, length, place) of what a name of n code points shares with one of n + delta that is within two edits of it:
    its code points from ``from`` on, ``length`` of them, stand at ``place`` of the other.

    The pieces are [0, a), [a, b) and [b, n). Two edits leave one piece untouched, unless one of them swaps the neighbours
    at a cut: then either piece beside it may be touched. An inserted code point before the name touches the first piece,
    behind it the last one, at a cut the middle one. So an untouched first piece stands at 0 and an untouched last one at the
    end; the middle one is shifted by what was inserted before it, less what was deleted, and the rest of delta falls
    behind it. If no piece is untouched, a swap at a cut is one of the edits, and the outer piece at that cut, or the other
    outer one with a swap of its own, has no other: it is within one plain edit, a substitution at the cut, and so its
    one-deletion variant without that code point stands at its place. That variant also finds the untouched piece, where
    the lengths differ by one at most; by two, nothing can be swapped."""
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    one = 1 if abs(delta) < EDITS else 0
    first = (F.lit(0), F.greatest(a - one, F.lit(0)), F.lit(0))
    last = (F.least(b + one, n), F.greatest(n - b - one, F.lit(0)), F.least(b + one, n) + delta)
    middle = [(a, b - a, a + s) for s in range(-EDITS, EDITS + 1) if abs(s) + abs(delta - s) <= EDITS]
    return [first, last, *middle]


def _keyed(names: DataFrame, name: str, cut: bool) -> DataFrame:
    """A row (key, name, bag) for each place at which a piece of the name (``cut``), or of a name that is within two edits of
    it, can stand. The key hashes the length of the name that isn't cut, the place, and what stands there."""
    n, entries = F.length(name), []
    for delta in range(-EDITS, EDITS + 1):
        of, other = (n, n + delta) if cut else (n - delta, n)
        for start, length, place in _places(of, delta):
            ok = (of > 0) & (other > 0) & (place >= 0) & (place + length <= other)
            if cut:
                told = F.struct(other.alias("m"), place.cast("int").alias("place"), start.cast("int").alias("at"), length.cast("int").alias("length"))
            else:  # place and length in one long, as the same ones come for names of several lengths
                told = place.cast("long") * (1 << 31) + length
            entries.append(F.when(ok, told))
    every = F.array_compact(F.array(*entries))
    rows = names.select(name, _bag(F.col(name)).alias("bag"), F.explode(every if cut else F.array_distinct(every)).alias("e"))
    if not cut:
        rows = rows.select(name, "bag", F.struct(n.alias("m"), F.shiftright("e", 31).cast("int").alias("place"), F.shiftright("e", 31).cast("int").alias("at"), (F.col("e") % (1 << 31)).cast("int").alias("length")).alias("e"))
    piece = F.substring(F.col(name), F.col("e.at") + 1, F.col("e.length"))
    return rows.select(F.xxhash64("e.m", "e.place", "e.length", piece).alias("key"), name, "bag")


def _bag(name: Column) -> Column:
    """Which of 32 kinds of code points a name holds, and which of them twice, as 64 bits: an insertion or a deletion changes
    one of them at most, a substitution two, a swap none."""
    def put(s, c):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(32)))
        again = F.call_function("shiftleft", bit, F.lit(32))
        return F.when(s.bitwiseAND(bit) == 0, s.bitwiseOR(bit)).otherwise(s.bitwiseOR(again))

    return F.aggregate(F.split(name, ""), F.lit(0).cast("long"), put)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edits of each pair by optimal string alignment; 3 stands for more than two. Only alignments that never stray by more
    than two code points count, which are all that there are within two edits."""
    size = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.full(len(a), EDITS + 1, np.int8)
    order = np.argsort(np.maximum(*size), kind="stable")
    at = 0
    while at < len(order):
        # pairs of like length, as many as their code points allow
        widths = np.maximum(*(s[order[at:]] for s in size)) + 1
        count = max(1, int(np.searchsorted(widths * np.arange(1, widths.size + 1), CELLS, "right")))
        rows = order[at : at + count]
        out[rows] = _banded([a[k] for k in rows], [b[k] for k in rows], size[0][rows], size[1][rows])
        at += count
    return out


def _banded(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    width, big = int(max(n.max(), m.max())) + 1, np.int8(EDITS + 1)

    def codes(names: list[str], margin: int) -> np.ndarray:
        out = np.zeros((len(names), width + 2 * margin), np.uint32)
        for row, x in zip(out, names):
            row[margin : margin + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    # columns of b are reached with a margin, so that the band may leave it; 0 stands where nothing is
    x, y, pad = codes(a, 0), codes(b, EDITS + 2), EDITS + 2
    shifts = range(-EDITS, EDITS + 1)
    start = np.full((len(shifts), len(a)), big)
    for k, s in enumerate(shifts):
        if s >= 0:
            start[k] = s  # the first s code points of b are inserted
    result = np.where(n == 0, start[np.clip(m - n + EDITS, 0, 2 * EDITS), np.arange(len(a))], big)
    before, row = None, start
    for i in range(1, int(n.max()) + 1):
        now = np.full_like(row, big)
        for k, s in enumerate(shifts):
            j = i + s
            if j < 0:
                continue
            best = row[k + 1] + 1 if k + 1 < len(shifts) else np.full(len(a), big)
            if j > 0:
                best = np.minimum(best, row[k] + (x[:, i - 1] != y[:, pad + j - 1]))
                if k:
                    best = np.minimum(best, now[k - 1] + 1)
                if i > 1 and j > 1:
                    swapped = (x[:, i - 1] == y[:, pad + j - 2]) & (x[:, i - 2] == y[:, pad + j - 1])
                    best = np.where(swapped, np.minimum(best, before[k] + 1), best)
            now[k] = np.minimum(best, big)
        ended = n == i
        if ended.any():
            at = np.clip(m - n + EDITS, 0, 2 * EDITS)
            result[ended] = now[at, np.arange(len(a))][ended]
        before, row = row, now
    return np.where(np.abs(m - n) > EDITS, big, result)


def near_names(cut: DataFrame, whole: DataFrame, cut_col: str = "name", whole_col: str = "name") -> DataFrame:
    """(cut_name, whole_name, distance) of each pair of different texts' classes: distinct names of the one and the other
    side that optimal string alignment takes at most two edits to turn into each other, equal names at 0.

    Names of any length are compared as stored, by code points; null and empty ones take no part; extra columns are
    ignored; empty tables give no pair. Cut the side of fewer names: it makes some twenty rows a name, the other one a
    dozen. A join condition lets only pairs through whose sets of code points and plain edits allow two: plain edits are
    at most two and one more for each swap, and a swap leaves the code points alone. What it lets through is verified by
    whole names. Joins are plain equi-joins, so that a piece of very many names is split over tasks; nothing is gathered
    or broadcast."""
    left, right = (df.select(F.col(c).alias(to)).where(F.length(to) > 0).distinct() for df, c, to in ((cut, cut_col, "cut_name"), (whole, whole_col, "whole_name")))
    left, right = _keyed(left, "cut_name", True).withColumnRenamed("bag", "cut_bag"), _keyed(right, "whole_name", False).withColumnsRenamed({"key": "whole_key", "bag": "whole_bag"})
    apart = F.bit_count(F.col("cut_bag").bitwiseXOR(F.col("whole_bag")))
    plain = F.levenshtein("cut_name", "whole_name", 2 * EDITS)
    within = (apart <= 2 * EDITS) & plain.between(0, 2 * EDITS - F.ceil(apart / 2))
    # a merge join: the keys of either side grow with the input, so none is broadcast, however few they look
    met = left.join(right.hint("merge"), (F.col("key") == F.col("whole_key")) & within).select("cut_name", "whole_name")

    def verify(batches):
        for batch in batches:
            d = distances(batch.column("cut_name").to_pylist(), batch.column("whole_name").to_pylist())
            near = pa.array(d <= EDITS)
            yield pa.RecordBatch.from_arrays([*(c.filter(near) for c in batch.columns), pa.array(d.astype(np.int32)).filter(near)], ["cut_name", "whole_name", "distance"])

    return met.mapInArrow(lean(verify), "cut_name string, whole_name string, distance int").groupBy("cut_name", "whole_name").agg(F.min("distance").alias("distance"))


def misspelt(id_: Column, name: Column) -> Column:
    """A name with two neighbours swapped, by the checksum of its id: an even one h swaps the code points at h % (length - 1),
    from 0, and behind it. Names of one code point, or without id, stay."""
    h, n = F.crc32(id_.cast("string")), F.length(name)
    at = (h % (n - 1)).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((n >= 2) & (h % 2 == 0), swapped).otherwise(name)


def op12(spark, sf_dir: str) -> DataFrame:
    """Equal rows (vendor_id, name) of a vendor count once; each row of a client counts."""
    clients, vendors = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clients", "vendors"))
    forms = vendors.where(F.length("name") > 0).select("vendor_id", misspelt(F.col("vendor_id"), F.col("name")).alias("form")).distinct()
    pairs = near_names(forms, clients, "form", "name")
    crc = F.crc32(F.col("client_id").cast("string"))
    held = clients.where(F.length("name") > 0).groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(crc).alias("crc"))
    by_form = pairs.join(held.hint("merge"), F.col("whole_name") == F.col("name")).groupBy("cut_name", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    out = forms.join(by_form.hint("merge"), F.col("form") == F.col("cut_name")).groupBy("vendor_id", "distance")
    return out.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))


#: A swap costs one where neither of its two code points takes another edit: the rest before and behind it is compared plainly.
ORACLE = f"""
with h as (select vendor_id, name, length(name) l, {crc_sql("cast(vendor_id as varchar)")} h from vendors where length(name) > 0),
v as (select distinct vendor_id, case when h % 2 = 0 and l >= 2 then substring(name, 1, cast(h % (l - 1) as bigint)) || substring(name, cast(h % (l - 1) as bigint) + 2, 1) || substring(name, cast(h % (l - 1) as bigint) + 1, 1) || substring(name, cast(h % (l - 1) as bigint) + 3, l) else name end a from h),
p as (select a, name b, levenshtein(a, name) d from (select distinct a from v) join (select distinct name from clients where length(name) > 0) on abs(length(a) - length(name)) <= 2 and levenshtein(a, name) <= 4),
i as (select a, b, d, unnest(range(1, length(a))) i from p),
s as (select a, b, i, j from (select a, b, i, unnest([i - 1, i, i + 1]) j from i where d > 1) where j >= 1 and j < length(b) and substring(a, i, 1) = substring(b, j + 1, 1) and substring(a, i + 1, 1) = substring(b, j, 1)),
one as (select a, b, min(1 + levenshtein(substring(a, 1, i - 1), substring(b, 1, j - 1)) + levenshtein(substring(a, i + 2, length(a)), substring(b, j + 2, length(b)))) d from s group by a, b),
two as (select x.a, x.b, 2 d from s x join s y on x.a = y.a and x.b = y.b and x.i = x.j and y.i = y.j and y.i >= x.i + 2
  where substring(x.a, 1, x.i - 1) || substring(x.b, x.i, 2) || substring(x.a, x.i + 2, y.i - x.i - 2) || substring(x.b, y.i, 2) || substring(x.a, y.i + 2, length(x.a)) = x.b),
near as (select a, b, min(d) d from (select a, b, d from p union all select * from one union all select * from two) group by a, b having min(d) <= 2),
c as (select name, client_id, {crc_sql("cast(client_id as varchar)")} crc from clients where length(name) > 0)
select v.vendor_id, cast(near.d as int) distance, count(*) n_clients, min(c.client_id) first_client_id, cast(sum(c.crc) as bigint) clients_crc
from v join near on near.a = v.a join c on c.name = near.b group by 1, 2
"""
