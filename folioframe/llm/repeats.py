"""Repeated passages by a depth-limited radix sort of suffixes.

Only windows of ``depth`` bytes are ordered, never whole suffixes, and by digits, the most significant first: the gram at
a window's anchor, then the span of all windows of that anchor, then the bytes of single windows. Each pass drops what
has become alone in its group; the groups left equal at full depth are the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, mixed, partitions

DEPTH, GRAM = 50, 18
#: Postings of a sorting task, postings held before they are passed on, and bytes of text that one task joins.
SORT_TASK, BUFFER, TEXT_TASK = 500_000, 1_500_000, 6_000_000
_CODES = mixed(np.arange(3, 259, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE, _STEP = 0xE7037ED1A0B428DB, 1 << 15
_MARGIN = 512


def _chain(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.cumprod(np.full(n, base, np.uint64))
    return out


_POW, _INV = _chain(_BASE, _STEP + _MARGIN), _chain(pow(_BASE, -1, 1 << 64), _STEP + _MARGIN)
#: tag: of the text, which tells rows of one id apart.
_POSTING = np.dtype([("gram", np.uint64), ("span", np.uint64), ("doc", np.int64), ("tag", np.uint32), ("at", np.uint32), ("first", np.uint16), ("last", np.uint16)])
_RANGE = np.dtype([("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("stop", np.uint32)])
_REQUEST = np.dtype([("gram", np.uint64), ("doc", np.int64), ("tag", np.uint32), ("at", np.uint32), ("first", np.uint16), ("last", np.uint16)])


def anchors(raw: bytes, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, span hash, place, first, last) of each anchor of a text.

    A window's anchor is the gram of least hash in it, of equal ones the first, so equal windows have equal anchors at
    equal places. The windows of an anchor at p start from p - first to p - last; its span is what they cover.
    """
    b = np.frombuffer(raw, np.uint8)
    wide = depth - gram + 1
    if b.size < depth:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    out = []
    for lo in range(0, b.size - depth + 1, _STEP):
        starts = min(_STEP, b.size - depth + 1 - lo)  # windows that start in this block
        part = b[lo : lo + starts + depth - 1]
        total = np.zeros(part.size + 1, np.uint64)
        np.cumsum(_CODES[part] * _POW[: part.size], out=total[1:])
        n = part.size - gram + 1
        g = mixed((total[gram:] - total[:-gram]) * _INV[:n])
        key = (g & ~np.uint64(0xFFFF)) | np.arange(n, dtype=np.uint64)
        least, have = key, 1
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[: least.size - step], least[step:])
            have += step
        at = (least & np.uint64(0xFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor's windows stand in a row
        p, s0, s1 = at[new], new, np.concatenate((new[1:], [at.size])) - 1
        span = mixed((total[s1 + depth] - total[s0]) * _INV[s0] + (p - s0).astype(np.uint64) * np.uint64(1 << 20) + (p - s1).astype(np.uint64))
        out.append((g[p], span, p + lo, p - s0, p - s1))
    return tuple(np.concatenate(x) for x in zip(*out))


def _dealt(rows: np.ndarray, key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return list(zip(key[at].tolist(), np.split(rows, at[1:]))) if rows.size else []


def _doc_task(doc: np.ndarray, tasks: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64) + np.uint64(0x9E37)) % np.uint64(tasks)).astype(np.int64)


def _tag(raw: bytes) -> int:
    return int.from_bytes(hashlib.md5(raw).digest()[:4], "little")


def _windows(p: np.ndarray, depth: int) -> np.ndarray:
    out, at = np.empty(p.size, _RANGE), p["at"].astype(np.int64)
    out["doc"], out["tag"], out["start"], out["stop"] = p["doc"], p["tag"], at - p["first"], at - p["last"] + depth
    return out


def _gather(docs: DataFrame, depth: int, gram: int, sorts: int, tasks: int) -> DataFrame:
    """First pass, (key, p, r): postings p by the leading digit of their gram (key below ``sorts``), and ranges r that a
    task knows to be repeated, by document (key from ``sorts`` on). Of equal spans a task passes on only the one of
    the least document."""
    schema = pa.schema([("key", pa.int64()), ("p", pa.binary()), ("r", pa.binary())])

    def rows(kind, parts, add=0):
        none = [None] * len(parts)
        blobs = [x.tobytes() for _, x in parts]
        return pa.RecordBatch.from_pydict({"key": [k + add for k, _ in parts], "p": blobs if kind == "p" else none, "r": blobs if kind == "r" else none}, schema=schema)

    def flush(held):
        p = np.concatenate(held)
        p = p[np.lexsort((p["at"], p["doc"], p["span"], p["gram"]))]
        start = np.concatenate(([True], (p["gram"][1:] != p["gram"][:-1]) | (p["span"][1:] != p["span"][:-1])))
        least = p["doc"][np.flatnonzero(start)][np.cumsum(start) - 1]
        seen = p[p["doc"] > least]
        p = p[p["doc"] == least]
        yield rows("p", _dealt(p, (p["gram"] % np.uint64(sorts)).astype(np.int64)))
        if seen.size:
            r = _windows(seen, depth)
            yield rows("r", _dealt(r, _doc_task(r["doc"], tasks)), sorts)

    def run(batches):
        size, texts = 0, {}

        def take():
            for raw, doc in texts.items():
                g, s, at, a, b = anchors(raw, depth, gram)
                p = np.empty(g.size, _POSTING)
                p["gram"], p["span"], p["doc"], p["tag"], p["at"], p["first"], p["last"] = g, s, doc, _tag(raw), at, a, b
                yield p

        def empty():
            nonlocal size, texts
            got = [p for p in take() if p.size]
            texts, size = {}, 0
            if got:
                yield from flush(got)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer().to_pybytes()
                if len(raw) < depth:
                    continue
                # copies of one text that a task sees together stand under the least document
                if raw in texts:
                    texts[raw] = min(texts[raw], doc)
                else:
                    texts[raw] = doc
                    size += len(raw)
                if size >= 12 * BUFFER:
                    yield from empty()
        yield from empty()

    return docs.mapInArrow(lean(run), "key bigint, p binary, r binary")


def _sorted_pass(depth: int, sorts: int, tasks: int):
    """Second pass over one bucket of grams: spans seen in a lesser document are repeated as a whole; where one gram has
    several spans, their windows must be looked at (requests q)."""
    schema = pa.schema([("key", pa.int64()), ("r", pa.binary()), ("q", pa.binary())])

    def run(key, table):
        k = key[0].as_py()
        if k >= sorts:
            blobs = [x for x in table["r"].to_pylist() if x]
            return pa.table([pa.array([k - sorts]), pa.array([b"".join(blobs)], pa.binary()), pa.nulls(1, pa.binary())], schema=schema)
        p = np.concatenate([np.frombuffer(x, _POSTING) for x in table["p"].to_pylist() if x])
        p = p[np.argsort(p["gram"], kind="stable")]
        # most significant digit: what has its gram to itself is out
        new = np.concatenate(([True], p["gram"][1:] != p["gram"][:-1]))
        alone = np.bincount(np.cumsum(new) - 1) == 1
        p = p[~alone[np.cumsum(new) - 1]]
        if not p.size:
            return schema.empty_table()
        p = p[np.lexsort((p["doc"], p["span"], p["gram"]))]
        g = np.concatenate(([True], p["gram"][1:] != p["gram"][:-1]))
        s = g | np.concatenate(([True], p["span"][1:] != p["span"][:-1]))
        of_g, of_s = np.cumsum(g) - 1, np.cumsum(s) - 1
        seen = p["doc"] > p["doc"][np.flatnonzero(s)][of_s]
        docs = np.minimum.reduceat(p["doc"], np.flatnonzero(g))[of_g] != np.maximum.reduceat(p["doc"], np.flatnonzero(g))[of_g]
        ask = ~seen & docs & (np.bincount(of_g[s])[of_g] > 1)
        full = _windows(p[seen], depth)
        q = np.empty(int(ask.sum()), _REQUEST)
        for name in _REQUEST.names:
            q[name] = p[name][ask]
        out = [(k, x, None) for k, x in _dealt(full, _doc_task(full["doc"], tasks))] + [(k, None, x) for k, x in _dealt(q, _doc_task(q["doc"], tasks))]
        return pa.table([pa.array([k for k, _, _ in out], pa.int64()), pa.array([None if r is None else r.tobytes() for _, r, _ in out], pa.binary()), pa.array([None if q is None else q.tobytes() for _, _, q in out], pa.binary())], schema=schema)

    return run


def _texts_of(table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for doc, text in zip(table["doc_id"].to_pylist(), table["text"]):
        out.setdefault(doc, []).append(text.as_buffer().to_pybytes() if text.is_valid else b"")
    return out


def _spans(depth: int, gram: int, sorts: int):
    """The bytes of the requested spans, by gram; a row holds requests and, joined, their bytes."""
    schema = pa.schema([("key", pa.int64()), ("q", pa.binary()), ("b", pa.binary())])

    def run(left, right):
        asked = [np.frombuffer(x, _REQUEST) for x in right["q"].to_pylist() if x]
        if not asked:
            return schema.empty_table()
        q = np.concatenate(asked)
        q = q[np.argsort(q["doc"], kind="stable")]
        texts, found, cut = _texts_of(left), [], []
        for doc, asked_of in _dealt(q, q["doc"]):
            for raw in {_tag(raw): raw for raw in texts.get(doc, ())}.values():
                b = np.frombuffer(raw, np.uint8)
                rows = asked_of[asked_of["tag"] == _tag(raw)]
                lo = rows["at"].astype(np.int64) - rows["first"]
                size = depth + rows["first"].astype(np.int64) - rows["last"]
                take = np.minimum(lo[:, None] + np.arange(2 * depth - gram), b.size - 1) if rows.size else np.zeros((0, 2 * depth - gram), np.int64)
                found.append(rows)
                cut.append(np.where(np.arange(2 * depth - gram) < size[:, None], b[take] if b.size else 0, 0).astype(np.uint8))
        if not found:
            return schema.empty_table()
        q, b = np.concatenate(found), np.concatenate(cut)
        task = (q["gram"] % np.uint64(sorts)).astype(np.int64)
        order = np.argsort(task, kind="stable")
        q, b, task = q[order], b[order], task[order]
        at = np.flatnonzero(np.diff(task, prepend=-1))
        return pa.table([pa.array(task[at]), pa.array([x.tobytes() for x in np.split(q, at[1:])], pa.binary()), pa.array([x.tobytes() for x in np.split(b, at[1:])], pa.binary())], schema=schema)

    return run


def _last_passes(depth: int, gram: int, tasks: int):
    """Third pass: single windows, digit by digit of eight bytes; what a digit leaves alone is out, and groups equal at
    full depth are repeated in every document but their least."""
    schema = pa.schema([("key", pa.int64()), ("r", pa.binary()), ("q", pa.binary())])

    def run(key, table):
        q = np.concatenate([np.frombuffer(x, _REQUEST) for x in table["q"].to_pylist()])
        b = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2 * depth - gram) for x in table["b"].to_pylist()])
        n = q["first"].astype(np.int64) - q["last"] + 1
        row = np.repeat(np.arange(q.size), n)
        off = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
        # the gram, and where it stands in the window, are the first digit
        group = np.unique(np.stack((q["gram"][row], (q["first"][row] - off).astype(np.uint64)), 1), axis=0, return_inverse=True)[1].ravel()
        for at in range(0, depth, 8):
            keep = np.bincount(group)[group] > 1
            row, off, group = row[keep], off[keep], group[keep]
            if not row.size:
                break
            digit = np.zeros(row.size, np.uint64)
            for j in range(at, min(at + 8, depth)):
                digit = (digit << np.uint64(8)) | b[row, off + j].astype(np.uint64)
            order = np.lexsort((digit, group))
            new = np.concatenate(([True], (digit[order][1:] != digit[order][:-1]) | (group[order][1:] != group[order][:-1])))
            fresh = np.empty_like(group)
            fresh[order] = np.cumsum(new) - 1
            group = fresh
        if not row.size:
            return schema.empty_table()
        doc = q["doc"][row]
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc)
        seen = doc > least[group]
        out = np.empty(int(seen.sum()), _RANGE)
        out["doc"], out["tag"], out["start"] = doc[seen], q["tag"][row[seen]], (q["at"].astype(np.int64) - q["first"])[row[seen]] + off[seen]
        out["stop"] = out["start"] + depth
        dealt = _dealt(out, _doc_task(out["doc"], tasks))
        return pa.table([pa.array([k for k, _ in dealt], pa.int64()), pa.array([x.tobytes() for _, x in dealt], pa.binary()), pa.nulls(len(dealt), pa.binary())], schema=schema)

    return run


def _removed(raw: bytes, ranges: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    if not ranges.size:
        return raw, []
    steps = np.bincount(ranges["start"], minlength=len(raw) + 1) - np.bincount(ranges["stop"], minlength=len(raw) + 1)
    gone = np.cumsum(steps)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def dedup(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` kept binary, spans) of every row.

    Removes each byte covered by a string of ``depth`` bytes that also starts in a document of a smaller id, matched
    within texts on the input as it stands. kept: the bytes that stay, joined; they may be no valid UTF-8. spans: the
    maximal removed runs, (start, stop) in bytes. A null text counts as empty. Rows that share an id don't remove from
    each other; rows of null id take no part and keep their text. Extra columns are ignored.

    Grams and spans are told apart by 64-bit hashes of their bytes, single windows by the bytes themselves.
    """
    if not 8 < depth <= _MARGIN or not 1 < gram <= depth:
        raise ValueError(f"a depth of 9 to {_MARGIN} and a gram within it, please")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    real = docs.where("doc_id is not null and text is not null")
    copies = scratch.write(docs.where("doc_id is not null").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("m")).agg(F.min("doc_id").alias("least")))
    total = real.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sorts = max(1, int(total * 2 / (depth - gram + 2) // SORT_TASK) + 1)
    tasks = max(1, total // TEXT_TASK + 1)
    key = lambda df: df.mapInArrow(_of_doc(tasks), "doc_id bigint, text string, key bigint")
    keyed = "key bigint, r binary, q binary"
    # tasks follow the input, so that none grows with it
    dealt = lambda df, n: df.repartition(max(partitions(spark), int(n)), "key").groupBy("key")
    second = scratch.write(dealt(_gather(real, depth, gram, sorts, tasks), sorts + tasks).applyInArrow(_sorted_pass(depth, sorts, tasks), keyed))
    asked = second.where("q is not null").select("key", "q")
    spans = dealt(key(real), tasks).cogroup(dealt(asked, tasks)).applyInArrow(_spans(depth, gram, sorts), "key bigint, q binary, b binary")
    third = scratch.write(dealt(spans, sorts).applyInArrow(_last_passes(depth, gram, tasks), keyed))
    ranges = second.where("r is not null").select("key", "r").unionAll(third.select("key", "r"))
    extra = ", kept binary, spans array<struct<start:bigint,stop:bigint>>" * texts

    def cut(left, right):
        r = [np.frombuffer(x, _RANGE) for x in right["r"].to_pylist()]
        r = np.concatenate(r) if r else np.zeros(0, _RANGE)
        by_doc = dict(_dealt(r, r["doc"])) if r.size else {}
        out: dict[str, list] = {k: [] for k in ("doc_id", "m", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for doc, text in zip(left["doc_id"].to_pylist(), left["text"]):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            mine = by_doc.get(doc, np.zeros(0, _RANGE)) if doc is not None else np.zeros(0, _RANGE)
            kept, runs = _removed(raw, mine[mine["tag"] == _tag(raw)] if mine.size else mine)
            for k, v in zip(out, (doc, hashlib.md5(raw).hexdigest(), len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in runs])):
                out[k].append(v)
        names = list(out) if texts else list(out)[:-2]
        types = {"doc_id": pa.int64(), "m": pa.string(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
        return pa.table({k: pa.array(out[k], types[k]) for k in names})

    done = dealt(key(docs), tasks).cogroup(dealt(ranges, tasks)).applyInArrow(cut, "doc_id bigint, m string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + extra)
    done = done.join(copies.withColumnRenamed("m", "m2"), F.col("m") == F.col("m2"), "left")
    # all windows of a copy start in the least document of its text
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= depth)
    empty = hashlib.sha256(b"").hexdigest()
    cols = ["doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if texts:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
        cols += [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(copy, whole).otherwise(F.col("spans")).alias("spans")]
    return done.select(*cols)


#: For small tables: it makes a row of each byte and a string of each window.
ORACLE = """
with d as (select doc_id, row_number() over () r, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, r, i, substr(h, 2 * i + 1, 2) b, case when 2 * i + 100 <= length(h) then substr(h, 2 * i + 1, 100) end s from (select doc_id, r, h, unnest(range(0, length(h) // 2)) i from d)),
f as (select s, min(doc_id) m from p where s is not null group by 1 having min(doc_id) < max(doc_id)),
hit as (select r, i from p join f using (s) where doc_id > m),
g as (select p.r, p.i, p.b, max(case when hit.i is null then 0 else 1 end) over (partition by p.r order by p.i rows between 49 preceding and current row) gone from (select r, i, b from p) p left join hit on hit.r = p.r and hit.i = p.i),
e as (select *, lag(gone, 1, 0) over (partition by r order by i) before from g),
k as (select r, count(*) filter (gone = 1) n_removed, count(*) filter (gone = 1 and before = 0) n_spans, string_agg(b, '' order by i) filter (gone = 0) kept from e group by r)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join k using (r)
"""


def _of_doc(tasks: int):
    def of(batches):
        for batch in batches:
            doc = batch.column("doc_id")
            yield batch.append_column("key", pa.array(_doc_task(doc.fill_null(0).to_numpy(), tasks)))

    return of


def op4(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
