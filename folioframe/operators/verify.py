"""Quotes held against their sources, cheap tests first and the costly one only for what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import exact_span, fuzzy_span, normalized
from ..plans.scratch import Scratch


#: Bytes of a text that are looked at together; a position in them takes so many bits.
BLOCK, BITS = 1 << 19, 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _anchors(raw: bytes, classes: list[int], size: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each class c the anchors (hash, place) of a text in UTF-8: of every 2 ** c bytes the gram of half as many whose hash is
    least, of equals the first. Grams of twice the length are hashed from the ones before."""
    out: dict = {c: [] for c in classes}
    size = size or BLOCK
    for block in range(0, max(len(raw), 1), size):
        b = np.frombuffer(raw[block : block + size + (1 << max(classes)) - 1], np.uint8)
        h = _mixed(b.astype(np.uint64) + np.uint64(1))
        for c in range(max(classes) + 1):
            if c > 1:  # from grams of 2 ** (c - 2) bytes to those of 2 ** (c - 1)
                step = 1 << (c - 2)
                h = _mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if h.size > step else h[:0]
            if c not in out or not h.size:
                continue
            v = (h >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(h.size, dtype=np.uint64)
            width = 1 if c == 0 else (1 << (c - 1)) + 1  # grams of a window
            done = 1
            while done < width and v.size:  # the least of twice as many each time
                step = min(done, width - done)
                v = np.minimum(v[:-step], v[step:]) if v.size > step else v[:0]
                done += step
            # windows that begin in the block; those behind belong to the next one
            at = np.unique(v[:size] & np.uint64((1 << BITS) - 1)).astype(np.int64)
            out[c].append((h[at].view(np.int64), at + block))
    return {c: tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*parts)) or ((), ()))) for c, parts in out.items()}


def contained(docs: DataFrame, items: DataFrame, doc_key: str, text: str, item_key: str, quote: str, block: int | None = None) -> DataFrame:
    """(item_key, doc_key): items whose quote stands in a document's text as it is. Empty and null ones stand nowhere.

    An equi-join on anchors: a quote of 2 ** c bytes or more, and less than twice that, has one in its first 2 ** c bytes, and
    wherever it stands the text has the same. So the texts are scanned once, whatever the number of quotes, equal ones once for all; what meets is
    verified byte by byte. A text is looked at in blocks of so many bytes. Nothing but the classes c that occur, a few numbers, reaches the driver."""
    scratch = Scratch(docs.sparkSession, "quotes")
    held = items.where(F.length(quote) > 0).select(F.col(item_key).alias("k"), F.encode(quote, "utf-8").alias("q")).distinct()
    held = scratch.write(held.withColumn("c", F.floor(F.log2(F.octet_length("q").cast("double"))).cast("int")))
    classes = sorted(r[0] for r in held.select("c").distinct().collect())
    if not classes:
        return items.select(item_key).limit(0).join(docs.select(doc_key).limit(0))
    texts = docs.where(F.length(text) > 0).select(F.col(doc_key).alias("d"), F.encode(text, "utf-8").alias("t")).withColumn("h", F.xxhash64("t"))

    def scan(batches):
        for batch in batches:
            for t, h in zip(batch.column("t").to_pylist(), batch.column("h").to_pylist()):
                for c, (g, at) in _anchors(t, classes, block).items():
                    yield pa.RecordBatch.from_pydict({"h": np.full(g.size, h), "c": np.full(g.size, c, np.int32), "g": g, "at": at})

    def anchor(batches):
        for batch in batches:
            first = [[int(x[0]) for x in _anchors(q[: 1 << c], [c])[c]] for q, c in zip(batch.column("q").to_pylist(), batch.column("c").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in first], pa.int64()), pa.array([x[1] for x in first], pa.int64())], [*batch.schema.names, "g", "off"])

    kind = dict(items.dtypes)[item_key]
    quotes = scratch.write(held.mapInArrow(anchor, f"k {kind}, q binary, c int, g bigint, off bigint"))
    places = texts.select("t", "h").dropDuplicates(["h", "t"]).mapInArrow(scan, "h bigint, c int, g bigint, at bigint")
    met = scratch.write(places.join(quotes.withColumnsRenamed({"c": "qc", "g": "qg"}), (F.col("c") == F.col("qc")) & (F.col("g") == F.col("qg"))).select("k", "q", "h", (F.col("at") - F.col("off")).cast("int").alias("start")).where("start >= 0"))
    stands = F.substring(F.col("t"), F.col("start") + 1, F.octet_length("q")) == F.col("q")
    return met.join(texts.withColumnRenamed("h", "th"), F.col("h") == F.col("th")).where(stands).select(F.col("k").alias(item_key), F.col("d").alias(doc_key)).distinct()


def verify_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (quote_id, thread_id, message_id, quote, role) with source_id, span, how and verified.

    texts: (thread_id, message_id, pos, new_text, fwd_text). How: exact in the cited message, reanchored to the first
    other message of the thread that holds it, snapped to the most similar words of the cited one, or dropped."""
    t = texts.select("thread_id", F.col("message_id").alias("mid"), "pos", "new_text", "fwd_text")
    own = quotes.join(t.select("thread_id", F.col("mid").alias("message_id"), "new_text", "fwd_text"), ["thread_id", "message_id"], "left")
    own = own.withColumn("span", F.coalesce(exact_span("quote", "new_text"), exact_span("quote", "fwd_text")))
    exact = own.where("span is not null").select("quote_id", F.col("message_id").alias("source_id"), "span", F.lit("exact").alias("how"))
    left = own.where("span is null").drop("span")
    folded = left.select("quote_id", "thread_id", "message_id", "quote", normalized("quote").alias("nq"))
    other = folded.join(t.withColumn("nt", F.concat_ws("\n", normalized("new_text"), normalized("fwd_text"))), "thread_id").where("mid <> message_id")
    # the folded quote, trimmed, must stand in the folded text before spans are looked for
    other = other.where(F.col("nt").contains(F.regexp_replace("nq", r"^[ .,;:!?\"'-]+|[ .,;:!?\"'-]+$", "")))
    other = other.withColumn("span", F.coalesce(exact_span("quote", "new_text"), exact_span("quote", "fwd_text"))).where("span is not null")
    w = Window.partitionBy("quote_id").orderBy("pos", "mid")
    moved = other.withColumn("n", F.row_number().over(w)).where("n = 1").select("quote_id", F.col("mid").alias("source_id"), "span", F.lit("reanchored").alias("how"))
    rest = left.join(moved, "quote_id", "left_anti").withColumn("span", F.coalesce(fuzzy_span("quote", "new_text"), fuzzy_span("quote", "fwd_text")))
    last = rest.select("quote_id", F.col("message_id").alias("source_id"), F.coalesce("span", "quote").alias("span"), F.when(F.col("span").isNotNull(), "snapped").otherwise("dropped").alias("how"))
    return quotes.join(exact.unionByName(moved).unionByName(last), "quote_id").withColumn("verified", F.col("how") != "dropped")


def quote_stats(verified: DataFrame, examples: int = 20) -> DataFrame:
    """Counters of a run; re-anchored quotes count among the snapped ones. Examples: the first dropped quotes, as a top-k
    finds them."""
    n = lambda *how: F.count_if(F.col("how").isin(*how))
    counts = verified.agg(F.count("*").alias("quotes_total"), n("exact").alias("quotes_exact"), n("snapped", "reanchored").alias("quotes_snapped"), n("reanchored").alias("quotes_reanchored"), n("dropped").alias("quotes_dropped"))
    some = verified.where("how = 'dropped'").select(F.substring("quote", 1, 120).alias("x")).orderBy("x").limit(examples).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return counts.join(F.broadcast(some))
