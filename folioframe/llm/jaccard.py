"""N-gram Jaccard join with set-relation skipping.

Index lists hold the rarest quarter of each distinct set, sorted by size and position, and are skipped block by block.
A list isn't expanded into its pairs: every member meets the list's pivots first; what a pivot joins needs no further
comparison, and the answers of a set near its pivot are derived from the pivot's by the few shingles that differ. Links
are then counted component by component: where all sets are that near to one pivot, any two of them link and the count
is derived; elsewhere blocks of sets meet as packed rows and pass on counts, never pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean, mixed, partitions, shingle_hashes

WORDS = 5
#: Postings of an index task; postings that a task holds before it passes them on, and shingles that it counts at a time.
LIST_TASK, BUFFER, COUNTED = 200_000, 500_000, 1_000_000
#: A list of more sets than this is dealt to chunks of about so many.
LIST_MOST = 100_000
#: Sets and shingles of a block when links are counted, about, and shingles of small components counted in one task.
COUNT_SETS, COUNT_SHINGLES, COUNT_TASK = 512, 300_000, 1_000_000
#: Pairs that are held against their sketches at a time, and so many times as many that are remembered as judged.
PIECE, JUDGED = 250_000, 16
#: A shingle is frequent from so many sets on that one task saw; frequent shingles go last in the common order. The
#: broadcast table of them holds this many at most (16 bytes each), the most frequent first. Any order is right.
FREQUENT, FREQUENT_MOST = 24, 1_000_000
BLOCK = 64
#: Answers are derived from a pivot whose set differs in this share of shingles at most.
NEAR = 0.1


def _texts(batch: pa.RecordBatch, name: str):
    for v in batch.column(name):
        yield v.as_buffer().to_pybytes() if v.is_valid else b""


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles that hash to i, over about as many bits as shingles. Two sketches differ in
    no more bits than their sets differ in shingles; a longer one folds to the length of a shorter."""
    bits = max(64, 1 << max(0, int(shingles.size) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while x.size > y.size:
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] ^ y[y.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    at = np.minimum(np.searchsorted(b, a), b.size - 1)
    return int((b[at] == a).sum())


def derived_overlap(pivot_overlap: int, other: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> int:
    """|X & Z| from |P & Z|, where X is P with ``plus`` and without ``minus``."""
    return pivot_overlap + overlap(plus, other) - overlap(minus, other)


def alike(inter, na, nb, num: int, den: int):
    """inter / union >= num / den, in integers."""
    return den * inter >= num * (na + nb - inter)


def describe(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, sid, sketch) of each document, and rows (tokens, counts) of what each task found frequent."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def frequent(held):
        if not held:
            return None
        t, c = np.unique(np.concatenate(held), return_counts=True)
        some = c >= FREQUENT
        none = [None]
        return pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "sid": none, "sketch": none, "tokens": [t[some].tobytes()], "counts": [c[some].tobytes()]}, schema=schema)

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            n, sid, sketch = [], [], []
            for raw in _texts(batch, "text"):
                s = shingle_hashes(raw, words)
                n.append(s.size)
                sid.append(set_id(s) if s.size else None)
                sketch.append(odd_sketch(s) if s.size else None)
                if s.size and sid[-1] not in seen:
                    seen.add(sid[-1])
                    held.append(s)
                    size += s.size
                if size >= COUNTED:
                    yield frequent(held)
                    held, size, seen = [], 0, set()
            blank = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sketch, pa.binary()), blank, blank], schema=schema)
        if (last := frequent(held)) is not None:
            yield last

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, n bigint, sid bigint, sketch binary, tokens binary, counts binary")


def frequent_table(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, with their counts; the most frequent FREQUENT_MOST at most."""

    def split(batches):
        for b in batches:
            for t, c in zip(b.column("tokens").to_pylist(), b.column("counts").to_pylist()):
                yield pa.RecordBatch.from_pydict({"t": np.frombuffer(t, np.int64), "c": np.frombuffer(c, np.int64)})

    top = described.where("tokens is not null").select("tokens", "counts").mapInArrow(split, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c"))
    got = top.orderBy(F.col("c").desc(), "t").limit(FREQUENT_MOST).toArrow()
    t, c = got["t"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


_POSTING = np.dtype([("token", np.uint64), ("sid", np.int64), ("n", np.uint32), ("pos", np.uint32)])


def hot_chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many chunks the list of each frequent shingle is dealt to, and the number of its first chunk among all those
    of dealt lists; one chunk is no chunk."""
    chunks = np.maximum(1, -(-counts // LIST_MOST))
    dealt = np.where(chunks > 1, chunks, 0)
    return chunks, np.cumsum(dealt) - dealt


def postings(docs: DataFrame, words: int, frequent, buckets: int, num: int, den: int) -> DataFrame:
    """(bucket, postings) of each distinct set's prefix: so many of its shingles, the rarest first, that two sets alike
    share one. Equal sets of a task are indexed once. Buckets from ``buckets`` on are chunks of one list each."""

    def run(batches):
        tokens, counts = frequent.value
        chunks, first = hot_chunks(counts)
        held, size, seen = [], 0, set()

        def flush():
            p = np.concatenate(held)
            b = ((p["token"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            if (chunks > 1).any():
                at = np.minimum(np.searchsorted(tokens, p["token"]), tokens.size - 1)
                hot = (tokens[at] == p["token"]) & (chunks[at] > 1)
                b[hot] = buckets + first[at[hot]] + (mixed(p["sid"][hot].view(np.uint64)) % chunks[at[hot]].astype(np.uint64)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            at = np.flatnonzero(np.diff(b, prepend=-1))
            return pa.RecordBatch.from_pydict({"bucket": b[at], "p": [x.tobytes() for x in np.split(p, at[1:])]})

        for batch in batches:
            for raw in _texts(batch, "text"):
                s = shingle_hashes(raw, words)
                if not s.size or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                k = s.size - (num * s.size + den - 1) // den + 1
                if tokens.size:
                    at = np.minimum(np.searchsorted(tokens, s), tokens.size - 1)
                    s = s[np.lexsort((s, np.where(tokens[at] == s, counts[at], 0)))]
                p = np.empty(k, _POSTING)
                p["token"], p["sid"], p["n"], p["pos"] = s[:k], sid, s.size, np.arange(k)
                held.append(p)
                size += k
                if size >= BUFFER:
                    yield flush()
                    held, size, seen = [], 0, set()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(lean(run), "bucket bigint, p binary")


def _lists(buckets: int, num: int = 75, den: int = 100):
    """The bucket's lists of two sets or more, each sorted by size and position; of a chunk, whatever it holds. They go on by
    their least set: near copies share many lists, and most of these have one least set, so that a pair of them meets in
    few buckets, not in one for each shingle it shares. Where lists as long would fill more than a task with one least set,
    they are dealt to pieces."""

    def run(key, table):
        bucket = key[0].as_py()
        p = np.unique(np.concatenate([np.frombuffer(x, _POSTING) for x in table["p"].to_pylist()]))
        p = p[np.lexsort((p["sid"], p["pos"], p["n"], p["token"]))]
        if bucket >= buckets:
            return pa.table({"bucket": pa.array([bucket], pa.int64()), "p": pa.array([p.tobytes()], pa.binary())})
        same = p["token"][1:] == p["token"][:-1]
        p = p[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        at = _bounds(p)
        size = np.diff(at)
        if not size.size:
            return pa.table({"bucket": pa.array([], pa.int64()), "p": pa.array([], pa.binary())})
        least = np.minimum.reduceat(p["sid"], at[:-1])
        n = p["n"][p["sid"] == np.repeat(least, size)].astype(np.int64)
        prefix = n - (num * n + den - 1) // den + 1
        pieces = np.uint64(1) << np.ceil(np.log2(np.maximum(1, size * prefix / LIST_TASK))).astype(np.uint64)
        b = (mixed(least.view(np.uint64) + mixed(p["token"][at[:-1]]) % pieces) % np.uint64(buckets)).astype(np.int64)
        b = np.repeat(b, size)
        order = np.argsort(b, kind="stable")
        p, b = p[order], b[order]
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        return pa.table({"bucket": pa.array(b[cut], pa.int64()), "p": pa.array([x.tobytes() for x in np.split(p, cut[1:])], pa.binary())})

    return run


def _together(key, table):
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "p": pa.array([b"".join(table["p"].to_pylist())], pa.binary())})


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort(pairs)]
    new = (pairs[:, 1:] != pairs[:, :-1]).any(0)
    return pairs[:, np.concatenate(([True], new))] if pairs.size else pairs


def _bounds(p: np.ndarray) -> np.ndarray:
    return np.concatenate((np.flatnonzero(np.diff(p["token"], prepend=p["token"][:1] + np.uint64(1))), [p.size])) if p.size else np.zeros(1, np.int64)


#: Pivots of a list; each is the least set of it in another order.
PIVOTS = 3


def _stars(batches):
    """Each member of a list with the list's pivots."""
    for batch in batches:
        out = [np.zeros((2, 0), np.int64)]
        for raw in batch.column("p").to_pylist():
            p = np.frombuffer(raw, _POSTING)
            if not p.size:
                continue
            at = _bounds(p)
            size = np.diff(at)
            for k in range(PIVOTS):
                order = mixed(p["sid"].view(np.uint64) + np.uint64(k)) if k else p["sid"].view(np.uint64)
                least = np.repeat(np.minimum.reduceat(order, at[:-1]), size)
                place = np.flatnonzero(order == least)
                _, first = np.unique(np.repeat(np.arange(size.size), size)[place], return_index=True)
                pivot = np.repeat(p["sid"][place[first]], size)
                far = p["sid"] != pivot
                out.append(np.stack((np.maximum(p["sid"], pivot)[far], np.minimum(p["sid"], pivot)[far])))
        pairs = _distinct(np.concatenate(out, axis=1))
        yield pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})


def _heads(buckets: int):
    """(token, sid) of each chunk: its least set."""

    def run(batches):
        for batch in batches:
            found = [(int(p["token"][0].view(np.int64)), int(p["sid"].min())) for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("p").to_pylist()) if b >= buckets for p in [np.frombuffer(raw, _POSTING)]]
            yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in found], pa.int64()), "sid": pa.array([s for _, s in found], pa.int64())})

    return run


def _folded(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the sketches of pairs (i, j), all pairs of two lengths at once."""
    size = np.array([x.size for x in sketches], np.int64)
    out = np.zeros(i.size, np.int64)
    for si, sj in np.unique(np.stack((size[i], size[j])), axis=1).T if i.size else ():
        for rows in np.array_split(f := np.flatnonzero((size[i] == si) & (size[j] == sj)), f.size * max(si, sj) // (1 << 24) + 1):
            x, y = (np.stack([sketches[k] for k in side[rows]]) for side in (i, j))
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[rows] = np.bitwise_count(x ^ y).sum(1)
    return out


_INFO = np.dtype([("sid", np.int64), ("component", np.int64), ("n", np.uint32), ("bits", np.uint32)])


def _sid_task(sid: np.ndarray, tasks: int) -> np.ndarray:
    return (mixed(sid.view(np.uint64) + np.uint64(0x5DEECE66D)) % np.uint64(tasks)).astype(np.int64)


def _packed(sid, component, n, sketch) -> bytes:
    info = np.empty(len(sid), _INFO)
    info["sid"], info["component"], info["n"], info["bits"] = sid, component, n, [len(x) for x in sketch]
    return len(sid).to_bytes(8, "little") + info.tobytes() + b"".join(sketch)


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int.from_bytes(blob[:8], "little")
    info = np.frombuffer(blob, _INFO, n, 8)
    rest = np.frombuffer(blob, np.uint8, offset=8 + n * _INFO.itemsize)
    return info, np.split(rest, np.cumsum(info["bits"].astype(np.int64))[:-1]) if n else []


def open_pairs(p: np.ndarray, component: np.ndarray, num: int, den: int, side: np.ndarray | None = None):
    """Pairs of a list's members of different components that size and position allow, block by block of the list, in
    pieces; with ``side``, only pairs of members of different sides."""
    out, held = [], 0
    n, pos, sid = p["n"].astype(np.int64), p["pos"].astype(np.int64), p["sid"]
    cuts = range(0, p.size, BLOCK)
    least_pos = [pos[c : c + BLOCK].min() for c in cuts]
    only = [component[c] if (component[c : c + BLOCK] == component[c]).all() else None for c in cuts]
    for x, i in enumerate(cuts):
        ni, pi = n[i : i + BLOCK], pos[i : i + BLOCK]
        for y in range(x, len(only)):
            j = cuts[y]
            nj, pj = n[j : j + BLOCK], pos[j : j + BLOCK]
            if den * ni[-1] < num * nj[0]:
                break  # sizes only grow from here
            if only[x] is not None and only[x] == only[y]:
                continue
            # the most that two sets of these blocks can share, were this their first common shingle
            most = min(ni[-1] - least_pos[x], nj[-1] - least_pos[y])
            if (num + den) * most < num * (ni[0] + nj[0]):
                continue
            share = np.minimum((ni - pi)[:, None], (nj - pj)[None])
            ok = (component[i : i + BLOCK][:, None] != component[j : j + BLOCK][None]) & ((num + den) * share >= num * (ni[:, None] + nj[None]))
            ok &= (den * ni[:, None] >= num * nj[None]) & (den * nj[None] >= num * ni[:, None])
            if side is not None:
                ok &= side[i : i + BLOCK][:, None] != side[j : j + BLOCK][None]
            if x == y:
                ok = np.triu(ok, 1)
            a, b = np.nonzero(ok)
            out.append(np.stack((sid[i + a], sid[j + b])))
            held += a.size
            if held >= PIECE:
                yield np.concatenate(out, axis=1)
                out, held = [], 0
    if held:
        yield np.concatenate(out, axis=1)


def _rows_of_bits(sets: list[np.ndarray]):
    """Packed rows of the sets over the shingles that several of them hold, some columns at a time."""
    size = np.array([s.size for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(at) > 1
    column = np.cumsum(several) - 1
    row, keep = np.repeat(np.arange(len(sets)), size), several[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    wide = 1 << 14
    for lo in range(0, int(several.sum()), wide):
        i, j = np.searchsorted(at, (lo, lo + wide))
        bits = np.zeros((len(sets), min(wide, -(-(int(several.sum()) - lo) // 64) * 64)), bool)
        bits[row[i:j], at[i:j] - lo] = True
        yield np.packbits(bits, axis=1).view(np.uint64)


def degrees(a: list[np.ndarray], wa: np.ndarray, b: list[np.ndarray] | None, wb: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a the weight of the sets of b that it links with, and the other way; within a if b is None."""
    other, w = (a, wa) if b is None else (b, wb)
    shared = np.zeros((len(a), len(other)), np.int64)
    for bits in _rows_of_bits(a if b is None else a + b):
        right = bits if b is None else bits[len(a) :]
        for i in range(len(a)):
            shared[i] += np.bitwise_count(bits[i] & right).sum(1, dtype=np.int64)
    size = lambda sets: np.array([s.size for s in sets], np.int64)
    ok = alike(shared, size(a)[:, None], size(other)[None], num, den)
    if b is None:
        np.fill_diagonal(ok, False)
    return ok @ w, np.zeros(0, np.int64) if b is None else wa @ ok


def count_links(scratch: Scratch, nodes: DataFrame, linked: DataFrame, shingles_of, num: int, den: int) -> DataFrame:
    """(sid, links): documents of other sets that each set links with; nodes: (sid, n, n_equal, component), linked:
    (a, b, d) with the shingles in which two linked sets differ.

    Two sets that differ from a pivot in at most (den - num) / (den + num) of their own shingles differ from one another
    in too few not to link. So in a component that is all so near to one pivot, the counts follow from the sizes."""
    near = lambda x, pivot: linked.selectExpr(f"{x} x", f"{pivot} pivot", "d")
    both = near("a", "b").unionAll(near("b", "a")).distinct()
    of = nodes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("n_equal").alias("weight"))
    close = both.join(nodes.selectExpr("sid x", "n", "component"), "x").where(f"{num + den} * d <= {den - num} * n")
    whole = close.groupBy("component", "pivot").agg(F.count("*").alias("k")).join(of, "component").where("k = m - 1").select("component").distinct()
    of = scratch.write(of.join(whole.withColumn("derived", F.lit(True)), "component", "left").withColumn("derived", F.coalesce("derived", F.lit(False))))
    sized = scratch.write(nodes.join(of, "component"))
    derived = sized.where("derived").selectExpr("sid", "weight - n_equal links")
    chunks = F.greatest(F.ceil(F.col("m") / COUNT_SETS), F.ceil(F.col("total") / COUNT_SHINGLES)).cast("int")
    rest = scratch.write(sized.where("not derived").select("sid", "n_equal", "component", "n", chunks.alias("c")))
    tasks = int(-(-(rest.where("c = 1").agg(F.sum("n")).first()[0] or 0) // COUNT_TASK)) or 1
    rest = rest.withColumn("k", F.pmod(F.xxhash64("sid"), F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    task = F.when(F.col("c") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component"))
    rest = rest.select("sid", "n_equal", "component", "k", task.alias("task"), F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), (F.col("c") > 1).alias("big"))
    schema = pa.schema([("sid", pa.int64()), ("links", pa.int64())])

    def run(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        component = table["component"].to_numpy()
        table = table.take(np.argsort(component, kind="stable"))
        component = table["component"].to_numpy()
        sid, w, k = (table[c].to_numpy() for c in ("sid", "n_equal", "k"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["s"].combine_chunks()]
        out: list[tuple] = []
        cuts = np.concatenate((np.flatnonzero(np.diff(component, prepend=component[:1] - 1)), [component.size]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            rows = np.arange(i, j)
            left, right = (rows[k[rows] == side] for side in (lo, hi)) if lo != hi else (rows, None)
            if not left.size or right is not None and not right.size:
                continue
            da, db = degrees([sets[r] for r in left], w[left], None if right is None else [sets[r] for r in right], None if right is None else w[right], num, den)
            out += [(sid[left], da)] + ([] if right is None else [(sid[right], db)])
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate([s for s, _ in out]), np.concatenate([d for _, d in out])], schema=schema)

    held = rest.join(shingles_of(rest.select("sid").distinct()), "sid").select("task", "lo", "hi", "component", "sid", "n_equal", "k", "s")
    counted = scratch.write(held.groupBy("task", "lo", "hi").applyInArrow(run, "sid bigint, links bigint")).groupBy("sid").agg(F.sum("links").alias("links"))
    return scratch.write(derived.unionByName(counted))


def join(docs: DataFrame, words: int = WORDS, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_equal, n_links) of every row.

    A text's set: its distinct shingles of ``words`` words, A-Z as a-z, words parted by ASCII white space; fewer words
    make one shingle; a null text, or one without words, has an empty set that links with nothing. Two documents link
    when their sets' intersection is at least num / den of their union. component_id: the least id reachable by links.
    n_equal: rows of the same set, the row's own included (0 for an empty set); n_links: other rows that the row links
    with, those of the same set included. Rows of one id are one document of several sets; rows of null id come back
    with a null component and take no part. Extra columns are ignored.

    Shingles and sets are told apart by 64-bit hashes. Every comparison that decides is exact on these.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    real = docs.where("doc_id is not null and text is not null")
    told = scratch.write(describe(docs, words))
    of_doc = told.where("tokens is null")
    member = of_doc.where("doc_id is not null and n > 0").select("doc_id", "sid", "n")
    sets = scratch.write(of_doc.where("doc_id is not null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_equal"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(frequent_table(told))
    buckets = max(1, -(-total * (den - num) // den // LIST_TASK))
    chunks, first_chunk = hot_chunks(frequent.value[1])
    spread = max(partitions(spark), buckets // 4)
    lists = postings(real, words, frequent, buckets, num, den).repartition(spread, "bucket").groupBy("bucket").applyInArrow(_lists(buckets, num, den), "bucket bigint, p binary")
    lists = scratch.write(lists.repartition(spread, "bucket").groupBy("bucket").applyInArrow(_together, "bucket bigint, p binary"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches don't rule them out."""
        side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")

        def run(batches):
            for t in batches:
                n = t.column("na").to_numpy() + t.column("nb").to_numpy()
                d = np.array([sketch_distance(x.as_py(), y.as_py()) for x, y in zip(t.column("sa"), t.column("sb"))], np.int64)
                # d shingles differ: the union is (n + d) / 2 at least
                yield t.filter(pa.array(den * (n - d) >= num * (n + d), pa.bool_())).select(["a", "b", "na", "nb"])

        return scratch.write(both.mapInArrow(lean(run), "a bigint, b bigint, na bigint, nb bigint"))

    def shingles_of(asked: DataFrame) -> DataFrame:
        """(sid, s) of the sets asked for (sid, each once), from their texts."""
        wanted = asked.join(sets.select("sid", "rep"), "sid").selectExpr("rep as doc_id", "sid as want")
        # a document's other rows may have other sets
        schema = "sid bigint, s binary"

        def run(batches):
            for batch in batches:
                out = {}
                for raw, want in zip(_texts(batch, "text"), batch.column("want").to_pylist()):
                    s = shingle_hashes(raw, words)
                    if s.size and set_id(s) == want:
                        out[want] = s.tobytes()
                yield pa.RecordBatch.from_pydict({"sid": pa.array(list(out), pa.int64()), "s": pa.array(list(out.values()), pa.binary())})

        return scratch.write(real.join(wanted, "doc_id").select("text", "want").mapInArrow(lean(run), schema).dropDuplicates(["sid"]))

    ends = lambda pairs: pairs.selectExpr("explode(array(a, b)) sid").distinct()

    # first, every member of a list against the list's pivots, and the least sets of a dealt list's chunks with the least
    stars = lists.select("p").mapInArrow(lean(_stars), "a bigint, b bigint")
    if (chunks > 1).any():
        heads = lists.where(F.col("bucket") >= buckets).mapInArrow(_heads(buckets), "token bigint, sid bigint")
        least = heads.groupBy("token").agg(F.min("sid").alias("b"))
        stars = stars.unionByName(heads.join(least, "token").where("sid <> b").selectExpr("sid a", "b"))
    first = near(stars)
    known = shingles_of(ends(first))
    side = lambda t, s: t.withColumnsRenamed({"sid": s, "s": f"s{s}"})

    def against_pivot(batches):
        for t in batches:
            a, b, d, plus, minus = [], [], [], [], []
            for r in t.to_pylist():
                x, p = np.frombuffer(r["sa"], np.uint64), np.frombuffer(r["sb"], np.uint64)
                o = overlap(x, p)
                if alike(o, x.size, p.size, num, den):
                    d.append(x.size + p.size - 2 * o)
                    close = d[-1] <= NEAR * p.size
                    a.append(r["a"])
                    b.append(r["b"])
                    plus.append(np.setdiff1d(x, p, True).tobytes() if close else None)
                    minus.append(np.setdiff1d(p, x, True).tobytes() if close else None)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": pa.array(d, pa.int64()), "plus": pa.array(plus, pa.binary()), "minus": pa.array(minus, pa.binary())})

    linked = scratch.write(first.join(side(known, "a"), "a").join(side(known, "b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(against_pivot), "a bigint, b bigint, d bigint, plus binary, minus binary"))
    comp = scratch.write(components(scratch, linked.select("a", "b")))

    # then pairs that are still in different components; buckets and what they need of their sets go as packed rows
    tasks = max(1, -(-sets.count() // 20_000))

    def keyed(batches):
        for batch in batches:
            yield batch.append_column("k", pa.array(_sid_task(batch.column("sid").to_numpy(), tasks)))

    info = sets.select("sid", "n", "sketch").join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"), "n", "sketch")
    info = info.mapInArrow(keyed, "sid bigint, component bigint, n bigint, sketch binary, k bigint")

    def ask(batches):
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("p").to_pylist()):
                sid = np.unique(np.frombuffer(raw, _POSTING)["sid"])
                k = _sid_task(sid, tasks)
                order = np.argsort(k, kind="stable")
                at = np.flatnonzero(np.diff(k[order], prepend=-1))
                yield pa.RecordBatch.from_pydict({"k": k[order][at], "bucket": np.full(at.size, bucket), "sids": [x.tobytes() for x in np.split(sid[order], at[1:])]})

    def answer(left, right):
        sid = left["sid"].to_numpy()
        order = np.argsort(sid)
        held = left.take(order)
        sid, component, n, sketch = sid[order], held["component"].to_numpy(), held["n"].to_numpy(), held["sketch"].to_pylist()
        out = []
        for blob in right["sids"].to_pylist():
            at = np.searchsorted(sid, np.frombuffer(blob, np.int64))
            out.append(_packed(sid[at], component[at], n[at], [sketch[i] for i in at]))
        return pa.table({"bucket": right["bucket"], "info": pa.array(out, pa.binary())})

    of_bucket = info.groupBy("k").cogroup(lists.mapInArrow(ask, "k bigint, bucket bigint, sids binary").groupBy("k")).applyInArrow(answer, "bucket bigint, info binary")

    def works() -> DataFrame:
        """(x, y): a work is one bucket of lists, or two chunks of one list that don't lie within the same component."""

        def spans(batches):
            for batch in batches:
                got = [(b, int(i["component"].min()), int(i["component"].max())) for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("info").to_pylist()) for i, _ in [_unpacked(blob)] if i.size]
                yield pa.RecordBatch.from_pydict({name: pa.array([g[n] for g in got], pa.int64()) for n, name in enumerate(("bucket", "lo", "hi"))})

        span = of_bucket.where(F.col("bucket") >= buckets).mapInArrow(spans, "bucket bigint, lo bigint, hi bigint").groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hot = chunks > 1
        of_list = spark.createDataFrame([(buckets + int(f) + i, int(f)) for f, c in zip(first_chunk[hot], chunks[hot]) for i in range(int(c))], "bucket bigint, list bigint")
        span = span.join(of_list, "bucket")
        other = span.toDF("y", "lo2", "hi2", "list")
        own = lists.select("bucket").selectExpr("bucket x", "bucket y")
        return own.unionByName(span.withColumnRenamed("bucket", "x").join(other, "list").where("x < y and not (lo = hi and lo2 = hi2 and lo = lo2)").select("x", "y"))

    def crossing(left, right):
        parts = [_unpacked(x) for x in right["info"].to_pylist()]
        sketches = [x for _, found in parts for x in found]
        known = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, _INFO)
        sid, order = np.unique(known["sid"], return_index=True)
        n = known["n"].astype(np.int64)
        out = [np.zeros((2, 0), np.int64)]
        held = [np.frombuffer(x, _POSTING) for x in left["p"].to_pylist()]
        lists_of = [(p, None) for p in held]
        if len(held) > 1:  # two chunks of one list
            both = np.concatenate(held)
            by = np.lexsort((both["sid"], both["pos"], both["n"]))
            lists_of = [(both[by], np.repeat(np.arange(2), [p.size for p in held])[by])]
        waiting, size, judged = [], 0, np.zeros(0, np.int64)

        def sift():
            """What sketches don't rule out of the pairs that wait, those of many lists together; near copies share many
            lists, and a pair that one list has brought isn't judged again."""
            nonlocal waiting, size, judged
            i, j = (np.searchsorted(sid, side) for side in np.sort(np.concatenate(waiting, axis=1), axis=0))
            code = np.unique(i * sid.size + j)
            at = np.searchsorted(judged, code)
            new = judged[np.minimum(at, judged.size - 1)] != code if judged.size else np.ones(code.size, bool)
            judged = np.insert(judged, at[new], code[new]) if judged.size < JUDGED * PIECE else code  # speed alone depends on it
            i, j = np.divmod(code[new], sid.size)
            x, y = order[i], order[j]
            d = _folded(sketches, x, y)
            out.append(np.stack((sid[i], sid[j]))[:, den * (n[x] + n[y] - d) >= num * (n[x] + n[y] + d)])
            waiting, size = [], 0

        for p, sides in lists_of:
            component = known["component"][order[np.searchsorted(sid, p["sid"])]]
            at = _bounds(p)
            several = np.minimum.reduceat(component, at[:-1]) != np.maximum.reduceat(component, at[:-1]) if p.size else []
            for k in np.flatnonzero(several):
                rows = slice(at[k], at[k + 1])
                for pairs in open_pairs(p[rows], component[rows], num, den, None if sides is None else sides[rows]):
                    waiting.append(pairs)
                    size += pairs.shape[1]
                    if size >= PIECE:
                        sift()
        if waiting:
            sift()
        pairs = _distinct(np.concatenate(out, axis=1))
        return pa.table({"a": pairs[0], "b": pairs[1]})

    if (chunks > 1).any():
        of_bucket = scratch.write(of_bucket)
        placed = scratch.write(works()).selectExpr("x", "y", "explode(array_distinct(array(x, y))) bucket")
        of_work = lambda df, *names: placed.join(df, "bucket").toDF("bucket", *names, df.columns[-1]).repartition(spread, *names).groupBy(*names)
        met = of_work(lists, "x", "y").cogroup(of_work(of_bucket, "x2", "y2"))
    else:
        met = lists.repartition(spread, "bucket").groupBy("bucket").cogroup(of_bucket.repartition(spread, "bucket").groupBy("bucket"))
    rest = near(met.applyInArrow(lambda left, right: crossing(left, right), "a bigint, b bigint"))
    rest = scratch.write(rest.join(first.select("a", "b"), ["a", "b"], "left_anti").join(first.selectExpr("a as b", "b as a"), ["a", "b"], "left_anti"))
    # a set near its pivot is compared through the pivot
    via = linked.where("plus is not null").groupBy("a").agg(F.min_by(F.struct("b", "plus", "minus"), F.length("plus") + F.length("minus")).alias("v"))
    rest = scratch.write(rest.join(via, "a", "left").select("a", "b", "na", "nb", F.coalesce("v.b", "a").alias("pivot"), "v.plus", "v.minus"))
    sets_of = shingles_of(ends(rest.selectExpr("pivot as a", "b")))

    def through_pivot(batches):
        last, base = None, 0
        for t in batches:
            a, b = [], []
            for r in t.to_pylist():
                z = np.frombuffer(r["sb"], np.uint64)
                if last != (r["pivot"], r["b"]):
                    last, base = (r["pivot"], r["b"]), overlap(np.frombuffer(r["sp"], np.uint64), z)
                o = base if r["plus"] is None else derived_overlap(base, z, np.frombuffer(r["plus"], np.uint64), np.frombuffer(r["minus"], np.uint64))
                if alike(o, r["na"], r["nb"], num, den):
                    a.append(r["a"])
                    b.append(r["b"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = rest.join(sets_of.withColumnsRenamed({"sid": "pivot", "s": "sp"}), "pivot").join(side(sets_of, "b"), "b")
    more = scratch.write(joined.sortWithinPartitions("pivot", "b").select("a", "b", "na", "nb", "pivot", "plus", "minus", "sp", "sb").mapInArrow(lean(through_pivot), "a bigint, b bigint"))
    if not more.isEmpty():
        comp = scratch.write(components(scratch, linked.select("a", "b").unionAll(more)))

    links = count_links(scratch, comp.withColumnRenamed("node", "sid").join(sets.select("sid", "n", "n_equal"), "sid"), linked, shingles_of, num, den)

    # sets of one document belong together, whatever their components
    node = sets.select("sid", "n_equal").join(comp.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left")
    node = node.select("sid", "n_equal", F.coalesce("component", "sid").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n_equal") - 1).alias("n_links"))
    of_member = scratch.write(member.select("doc_id", "sid").join(node, "sid"))
    least = scratch.write(of_member.groupBy("c").agg(F.min("doc_id").alias("least")))
    twice = of_member.groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    if not twice.isEmpty():
        merged = scratch.write(components(scratch, of_member.join(twice.select("doc_id", "lo"), "doc_id").selectExpr("c a", "lo b")))
        of_c = least.join(merged, least.c == merged.node, "left").select("c", "least", F.coalesce("component", "c").alias("top"))
        tops = of_c.groupBy("top").agg(F.min("least").alias("m"))
        least = scratch.write(of_c.join(tops, "top").selectExpr("c", "m as least"))
    answer = of_member.join(least, "c").groupBy("doc_id", "sid").agg(F.min("least").alias("component_id"), F.max("n_equal").alias("n_equal"), F.max("n_links").alias("n_links")).withColumnsRenamed({"doc_id": "d", "sid": "s"})
    out = of_doc.select("doc_id", "n", "sid").join(answer, (F.col("doc_id") == F.col("d")) & (F.col("sid") == F.col("s")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_equal", "n_links")])


def op1(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id, with all rows of that id; documents
    without words, of null text among them, and rows without an id stay. An empty table gives an empty one, and columns of
    any names stay."""
    kept = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


#: For small tables: it makes every pair of sets that share a shingle.
ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, list_distinct(case when length(ws) = 0 then [] when length(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, length(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) sh from w),
classes as (select sh, min(doc_id) rep, count(*) n_equal, length(sh) n from s where length(sh) > 0 group by sh),
e as (select rep, n, hash(t) t from (select rep, n, unnest(sh) t from classes)),
common as (select a.rep a, b.rep b, a.n na, b.n nb, count(*) k from e a join e b on a.t = b.t and a.rep < b.rep and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) group by all),
links as (select a, b from common where 100 * k >= 75 * (na + nb - k)),
edges as (select a, b from links union all select b, a from links),
reach(rep, other) as (select rep, rep from classes union select r.rep, g.b from reach r join edges g on g.a = r.other),
least as (select rep, min(other) m from reach group by 1),
deg as (select e.a rep, sum(c.n_equal) k from edges e join classes c on c.rep = e.b group by 1)
select s.doc_id, cast(length(s.sh) as bigint) n_shingles, coalesce(l.m, s.doc_id) component_id, coalesce(c.n_equal, 0) n_equal, cast(coalesce(c.n_equal - 1, 0) + coalesce(d.k, 0) as bigint) n_links
from s left join classes c on c.sh = s.sh left join least l on l.rep = c.rep left join deg d on d.rep = c.rep
"""
