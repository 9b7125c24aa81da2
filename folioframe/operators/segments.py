"""A BM25 index in segments: each refresh writes the postings of new and changed rows alone, in blocks that a question can pass
over by their best possible score, and segments are merged when there are many."""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

K1, B = 1.2, 0.75
#: Rows of a block, about; postings of a file, about; segments that a question reads at most.
BLOCK, FILE, SEGMENTS = 4096, 1 << 20, 8
#: Blocks' numbers that are told to the reader, at most; beyond, blocks are joined.
TOLD = 1000
#: Scores are rounded to six places.
ROUND = 1e-6


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _packed(batches, key: str, tfs: list[str]):
    """Blocks of words (term, bucket, key, dl, counts by column) that come by term, bucket and key: equal keys are one posting of
    a block, their counts summed. A block holds the keys of one bucket, which stay about as many as BLOCK."""

    def blocks(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        term, bucket, keys, dl, *counts = (t[c].combine_chunks() for c in ("term", "bucket", key, "dl", *tfs))
        at = _changes(term, bucket, keys)
        counts = [np.add.reduceat(c.to_numpy(), at).astype(np.int32) for c in counts]
        term, bucket, keys, dl = (c.take(pa.array(at)) for c in (term, bucket, keys, dl))
        at = _changes(term, bucket)
        ends = pa.array(np.append(at, len(term)).astype(np.int32))
        listed = lambda values: pa.ListArray.from_arrays(ends, values)
        out = {"term": term.take(pa.array(at)), "bucket": bucket.take(pa.array(at)), "n": np.diff(ends.to_numpy()), "least": np.minimum.reduceat(dl.to_numpy(), at)}
        out |= {f"top_{c}": np.maximum.reduceat(v, at) for c, v in zip(tfs, counts)}
        out |= {key: listed(keys), "dl": listed(dl)} | {c: listed(pa.array(v)) for c, v in zip(tfs, counts)}
        return pa.RecordBatch.from_pydict(out)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_changes(batch["term"], batch["bucket"])[-1])
        # the last block may go on in the next batch, as may the one held with this batch's first rows
        same = held and (batch["term"][0], batch["bucket"][0]) == (held[-1]["term"][0], held[-1]["bucket"][0])
        if held and (last or not same):
            yield blocks(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield blocks(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield blocks(pa.Table.from_batches(held))


class Segments:
    """The index ``name`` under ``root`` of a table's text columns.

    On disk: segments (rows, stale, postings) and a manifest, to which a version is added when all else is written, so a reader sees
    a whole version or the one before, and a lost executor costs nothing but its tasks. rows: key, stamp and words of each row that the
    segment holds; stale: keys whose postings in an older segment count no more. postings: for a term and a bucket of keys one
    block, its keys, lengths and counts by column, with the greatest counts and the least length. Files are ranges of terms
    and buckets, as many as there are postings for, so a common term is many files and a rare one part of one."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, f"{root}/{name}_index"

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def manifest(self) -> dict | None:
        """The latest version: its number, columns, segments, whether any posting is stale, rows, words, and buckets of keys."""
        if not self._exists():
            return None
        return self.spark.read.parquet(f"{self.root}/manifest").orderBy(F.col("version").desc()).first().asDict()

    def _commit(self, version: int, fields: list[str], segments: list[int], stale: bool, n: int, words: int, buckets: int) -> None:
        row = [(version, fields, segments, stale, n, words, buckets)]
        self.spark.createDataFrame(row, "version int, fields array<string>, segments array<int>, stale boolean, n bigint, words bigint, buckets int").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _read(self, kind: str, segments: list[int]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{kind}-{s}").withColumn("seg", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def live(self, now: dict, key: str) -> DataFrame:
        """(key, stamp, dl, seg) of the rows that the index holds."""
        rows = self._read("rows", now["segments"])
        return rows.join(self._read("stale", now["segments"]).select(key, F.col("old").alias("seg")), [key, "seg"], "left_anti") if now["stale"] else rows

    def refresh(self, rows: DataFrame, key: str, fields: list[str]) -> dict[str, int]:
        """Brings the index up to the rows (each key once, not null): numbers of new, changed and gone ones. Only new and changed rows are
        read for words; rows are told to be unchanged by 128 bits of their columns."""
        scratch, now = Scratch(self.spark, "segments"), self.manifest()
        texts = [F.coalesce(F.col(c), F.lit("")) for c in fields]
        stamp = F.struct(F.xxhash64(*texts).alias("a"), F.xxhash64(F.lit(7), *texts).alias("b"))
        rows = rows.select(key, *fields)
        stamped = rows.select(F.col(key).alias("_k"), stamp.alias("_new"))
        if now:
            diff = stamped.join(self.live(now, key).select(key, "stamp", "dl", "seg"), F.col("_k") == F.col(key), "full_outer").where(~F.col("_new").eqNullSafe(F.col("stamp")))
            diff = scratch.write(diff)
            gone = F.col("_new").isNull()
            counts = diff.agg(F.count_if(F.col("stamp").isNull()).alias("new"), F.count_if(F.col("stamp").isNotNull() & ~gone).alias("changed"), F.count_if(gone).alias("gone"), F.coalesce(F.sum("dl"), F.lit(0)).alias("less")).first().asDict()
            if not counts["new"] + counts["changed"] + counts["gone"]:
                return {c: counts[c] for c in ("new", "changed", "gone")}
            fresh = rows.join(diff.where(~gone).select(F.col("_k").alias(key), F.col("_new").alias("stamp")), key)
            stale_keys = diff.where("stamp is not null").select(key, F.col("seg").alias("old"))
        else:  # all rows are new, and none has to be looked for
            counts = {"changed": 0, "gone": 0, "less": 0}
            fresh = rows.where(F.col(key).isNotNull()).withColumn("stamp", stamp)
            stale_keys = rows.limit(0).select(key, F.lit(0).alias("old"))
        version = now["version"] + 1 if now else 0
        fresh = fresh.select(key, "stamp", *[words_of(F.col(c)).alias(f"_w{i}") for i, c in enumerate(fields)])
        fresh = scratch.write(fresh.withColumn("dl", sum((F.size(f"_w{i}") for i in range(len(fields))), F.lit(0))))
        fresh.select(key, "stamp", "dl").write.mode("overwrite").parquet(f"{self.root}/rows-{version}")
        stale_keys.write.mode("overwrite").parquet(f"{self.root}/stale-{version}")
        sums = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        counts.setdefault("new", sums["n"])
        told = {c: counts[c] for c in ("new", "changed", "gone")}
        n = (now["n"] if now else 0) + told["new"] - told["gone"]
        words = (now["words"] if now else 0) + sums["words"] - counts["less"]
        buckets = now["buckets"] if now else max(1, n // BLOCK)
        told_by = lambda i: F.transform(f"_w{i}", lambda w: F.struct(w.alias("term"), F.lit(i).alias("f")))
        each = F.flatten(F.array(*map(told_by, range(len(fields)))))
        posts = fresh.select(key, "dl", F.explode(each).alias("p")).select("p.term", key, "dl", *[(F.col("p.f") == i).cast("int").alias(f"tf{i}") for i in range(len(fields))])
        self._write(posts, key, len(fields), buckets, version, sums["words"])
        stale = bool(now and (now["stale"] or told["changed"] or told["gone"]))
        self._commit(version, fields, [*(now["segments"] if now else []), version], stale, n, words, buckets)
        if now and len(now["segments"]) + 1 > SEGMENTS:
            self.merge(key)
        return told

    def _write(self, posts: DataFrame, key: str, fields: int, buckets: int, version: int, size: int) -> None:
        tfs = [f"tf{i}" for i in range(fields)]
        files = max(1, -(-size // FILE))
        # dealt by words, not by blocks: those of a term and bucket stay together, and are counted and packed where they are
        keyed = posts.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).select("term", "bucket", key, "dl", *tfs)
        keyed = keyed.repartitionByRange(files, "term", "bucket").sortWithinPartitions("term", "bucket", key)
        kind = dict(posts.dtypes)[key]
        schema = ", ".join(["term string, bucket int, n int, least int", *[f"top_{c} int" for c in tfs], f"`{key}` array<{kind}>, dl array<int>", *[f"{c} array<int>" for c in tfs]])
        keyed.mapInArrow(partial(_packed, key=key, tfs=tfs), schema).write.mode("overwrite").parquet(f"{self.root}/postings-{version}")

    def merge(self, key: str) -> None:
        """All segments become one, without what is stale."""
        now = self.manifest()
        version, fields = now["version"] + 1, len(now["fields"])
        tfs = [f"tf{i}" for i in range(fields)]
        live = Scratch(self.spark, "segments").write(self.live(now, key))
        live.select(key, "stamp", "dl").write.mode("overwrite").parquet(f"{self.root}/rows-{version}")
        live.limit(0).select(key, F.col("seg").alias("old")).write.mode("overwrite").parquet(f"{self.root}/stale-{version}")
        posts = self._unpacked(self._read("postings", now["segments"]), key, tfs).join(live.select(key, "seg"), [key, "seg"], "left_semi")
        buckets = max(1, now["n"] // BLOCK)
        self._write(posts.drop("seg", "bucket"), key, fields, buckets, version, now["words"])
        self._commit(version, now["fields"], [version], False, now["n"], now["words"], buckets)

    @staticmethod
    def _unpacked(blocks: DataFrame, key: str, tfs: list[str]) -> DataFrame:
        return blocks.select("term", "seg", "bucket", F.explode(F.arrays_zip(key, "dl", *tfs)).alias("p")).select("term", "seg", "bucket", *[F.col(f"p.{c}").alias(c) for c in (key, "dl", *tfs)])

    def search(self, key: str, terms: list[str], k: int, weights: dict | None = None) -> DataFrame:
        """(key, score): the k rows of highest BM25, of equals those of smaller key. A term's count in a row is the weighted sum over
        its columns.

        The terms' best possible scores are known from their blocks' heads. The k-th best score over the rare terms is a bound; the common
        terms that together can't reach it add to rows that hold a rarer one, but find none of their own, so of their blocks only
        those of such rows are read. The driver sees the heads' sums for each term, a bound, and up to TOLD numbers of buckets."""
        now, terms = self.manifest(), sorted(set(terms))
        kind = dict(self.spark.read.parquet(f"{self.root}/rows-{now['segments'][0]}").dtypes)[key] if now else "string"
        none = self.spark.createDataFrame([], f"{key} {kind}, score double")
        if not now or not terms or not now["n"]:
            return none
        mean, tfs, weight = now["words"] / now["n"], [f"tf{i}" for i in range(len(now["fields"]))], [float((weights or {}).get(c, 1.0)) for c in now["fields"]]
        blocks = self._read("postings", now["segments"])
        counted = lambda tf: sum((F.col(c) * w for c, w in zip(tf, weight)), F.lit(0.0))
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        stale = self._read("stale", now["segments"]).select(key, F.col("old").alias("seg")) if now["stale"] else None

        def postings(of: DataFrame) -> DataFrame:
            flat = self._unpacked(of, key, tfs)
            return flat.join(stale, [key, "seg"], "left_anti") if stale is not None else flat

        heads = blocks.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df"), F.max(part(counted([f"top_{c}" for c in tfs]), F.col("least"))).alias("top"))
        if stale is not None:
            df = postings(blocks.where(F.col("term").isin(terms))).groupBy("term").agg(F.count("*").alias("df"))
            heads = heads.drop("df").join(df, "term")
        known = {r["term"]: (r["df"], r["top"]) for r in heads.collect()}
        if not known:
            return none
        idf = {t: math.log(1 + (now["n"] - n + 0.5) / (n + 0.5)) for t, (n, _) in known.items()}
        best = {t: idf[t] * top for t, (_, top) in known.items()}

        def scored(of: DataFrame) -> DataFrame:
            value = F.lit(0.0)
            for t in known:
                value = F.when(F.col("term") == t, F.lit(idf[t])).otherwise(value)
            return of.select(key, "bucket", (value * part(counted(tfs), F.col("dl"))).alias("s"))

        rare = sorted(known, key=lambda t: known[t][0])
        first, held = [], 0
        while rare and held < k:
            first.append(rare.pop(0))
            held += known[first[-1]][0]
        common: list[str] = []
        if rare:
            at = scored(postings(blocks.where(F.col("term").isin(first)))).groupBy(key).agg(F.sum("s").alias("s")).orderBy(F.col("s").desc()).limit(k).agg(F.min("s"), F.count("*")).first()
            bound = at[0] - ROUND if at[1] >= k else 0.0
            for t in sorted(rare, key=best.__getitem__):
                if sum(best[c] for c in common) + best[t] >= bound:
                    break
                common.append(t)
        found = scored(postings(blocks.where(F.col("term").isin([t for t in known if t not in common]))))
        if common:
            most = sum(best[t] for t in common)
            may = Scratch(self.spark, "search").write(found.groupBy(key, "bucket").agg(F.sum("s").alias("s")).where(F.col("s") + most >= bound))
            numbers = [r[0] for r in may.select("bucket").distinct().limit(TOLD + 1).collect()]
            of = blocks.where(F.col("term").isin(common))
            of = of.where(F.col("bucket").isin(numbers)) if len(numbers) <= TOLD else of.join(may.select("bucket").distinct(), "bucket", "left_semi")
            more = scored(postings(of)).join(may.select(key), key, "left_semi")
            found = may.select(key, "s").unionByName(more.select(key, "s"))
        return found.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)
