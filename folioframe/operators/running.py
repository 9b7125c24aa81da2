"""Running sums over the rows of a key in order, a key's rows dealt over as many tasks as the input asks for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, partitions


def _within(through, off):
    """What accumulates whole columns, taken back at each start."""

    def f(v: np.ndarray, start: np.ndarray) -> np.ndarray:
        total = through(v)
        return off(total, np.repeat(np.concatenate((np.zeros(1, np.int64), total))[start], np.diff(np.append(start, v.size))))

    return f


def _greatest(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.accumulate(part) for part in np.split(v, start[1:])])


#: Long columns accumulated from each start on, two results put together, the same of whole columns, and what changes nothing.
_KINDS = {
    "sum": (_within(np.cumsum, np.subtract), np.add, F.sum, lambda a, b: a + b, 0),
    "xor": (_within(np.bitwise_xor.accumulate, np.bitwise_xor), np.bitwise_xor, F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "max": (_greatest, np.maximum, F.max, F.greatest, -(1 << 63)),
}


def _accumulated(key: np.ndarray, values: list, kinds: list, carry: tuple | None) -> list:
    """Each column accumulated within equal neighbours of key; carry: the key and the totals that rows before ended with."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    first = slice(0, start[1] if start.size > 1 else key.size)
    out = []
    for k, (v, kind) in enumerate(zip(values, kinds)):
        got = _KINDS[kind][0](v, start)
        if carry and carry[0] == key[0]:
            got[first] = _KINDS[kind][1](got[first], carry[1][k])
        out.append(got)
    return out


def _before(key: np.ndarray, got: np.ndarray, none: int, carry: tuple | None, k: int) -> np.ndarray:
    """The same without each row itself."""
    out = np.concatenate((got[:1], got[:-1]))
    out[np.concatenate(([True], key[1:] != key[:-1]))] = none
    if carry and carry[0] == key[0]:
        out[0] = carry[1][k]
    return out


def running(scratch: Scratch, df: DataFrame, key: str, order: list, **columns: tuple[str, str]) -> DataFrame:
    """df with more columns: name=(column, "sum", "xor" or "max") accumulates a long column over the rows of a key (long,
    not null) in order, the row itself included, or left out with "sum before" and so on (the first row then has 0, or for
    max the least long).

    Rows are dealt by ranges of key and order, so the rows of one key may lie in many tasks; each adds up its own, in one
    pass over sorted rows, and passes on what its chunk of a key sums up to. Only keys at the edges of ranges need that,
    twice as many as there are ranges at most: this small table alone is broadcast. The rows are written once."""
    kinds, names = [k.split(" ")[0] for _, k in columns.values()], list(columns)
    apart = [k.endswith(" before") for _, k in columns.values()]
    parts = partitions(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _chunk int" + "".join(f", `{n}` bigint" for n in names)

    def local(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(key).to_numpy(zero_copy_only=False)
            got = _accumulated(at, [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c, _ in columns.values()], kinds, carry)
            shown = [_before(at, g, _KINDS[kind][4], carry, k) if out else g for k, (g, kind, out) in enumerate(zip(got, kinds, apart))]
            carry = at[-1], [g[-1] for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, shown)], [*batch.schema.names, *names])

    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_chunk", F.spark_partition_id())
    rows = scratch.write(dealt.mapInArrow(local, schema))
    edges = rows.groupBy("_chunk").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sums = rows.join(F.broadcast(edges), key, "left_semi").groupBy(key, "_chunk").agg(*[_KINDS[k][2](c).alias(n) for (n, (c, _)), k in zip(columns.items(), kinds)])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), *[_KINDS[k][2](n).over(before).alias(f"_{n}") for n, k in zip(names, kinds)])
    out = rows.join(F.broadcast(carried), (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    for n, k in zip(names, kinds):
        out = out.withColumn(n, _KINDS[k][3](F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(_KINDS[k][4]).cast("long"))))
    return out.drop("_k", "_c", "_chunk", *[f"_{n}" for n in names])
