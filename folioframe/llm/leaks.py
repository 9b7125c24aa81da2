"""Benchmark decontamination: an Aho-Corasick automaton over the windows of normalised test items scans each text once, word
by word; what it hits is told in places of the original text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, lean, partitions

#: Words of a window; words of items for each automaton, at most about so many (some ten states a word); words in which long
#: items are cut.
WINDOW, AUTOMATON, PIECE = 10, 100_000, 5_000
#: Words are digits, letters a to z and whatever lies beyond ASCII, once A to Z are in lower case; the same over UTF-8.
WORD, BYTES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A text is taken in blocks of about so many bytes, each ending with a word.
BLOCK = 1 << 20


class Automaton:
    """Aho-Corasick over words. It travels as the items' words; a worker builds the states when it first scans."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int = WINDOW):
        """pieces: (item id, words), each item whole or in pieces that share window - 1 words with the next."""
        self.pieces, self.window, self.go = pieces, window, None

    def _build(self) -> None:
        code: dict[bytes, int] = {}
        self.items: list[set] = [set()]  # of the window that ends at a state
        self.depth, self.ends = [0], [0]
        go: dict[tuple[int, int], int] = {}
        levels: list[list[tuple[int, int, int]]] = [[] for _ in range(self.window)]
        for item, words in self.pieces:
            ids = [code.setdefault(w.encode(), len(code)) for w in words]
            for at in range(max(1, len(ids) - self.window + 1) if ids else 0):
                state = 0
                for level, w in enumerate(ids[at : at + self.window]):
                    below = go.get((state, w))
                    if below is None:
                        below = go[state, w] = len(self.depth)
                        self.depth.append(level + 1)
                        self.items.append(None)
                        levels[level].append((state, w, below))
                    state = below
                if self.items[state] is None:
                    self.items[state] = set()
                self.items[state].add(item)
        # where a state fails to, and the longest window that ends at it
        fail, ends = [0] * len(self.depth), [0] * len(self.depth)
        for level in levels:
            for above, w, state in level:
                if above:
                    f = fail[above]
                    while f and (f, w) not in go:
                        f = fail[f]
                    fail[state] = go.get((f, w), 0)
                ends[state] = state if self.items[state] is not None else ends[fail[state]]
        self.code, self.fail, self.ends, self.go = code, fail, ends, go

    def scan(self, raw: bytes) -> tuple[int, list[list[int]], set]:
        """(number of words, runs [first, end) of words that windows cover, item ids) of a text in UTF-8."""
        if self.go is None:
            self._build()
        go, fail, ends, depth, step = self.go, self.fail, self.ends, self.depth, self.go.get
        runs: list[list[int]] = []
        found: set[int] = set()
        at = state = 0
        for block in _blocks(raw):
            for w in map(self.code.get, BYTES.findall(block)):
                at += 1
                if w is None:
                    state = 0
                    continue
                below = step((state, w))
                while below is None and state:
                    state = fail[state]
                    below = step((state, w))
                state = below or 0
                if state and ends[state]:
                    end = ends[state]
                    found.add(end)
                    first = at - depth[end]
                    while runs and runs[-1][0] >= first:  # a longer window may reach further back
                        runs.pop()
                    if runs and runs[-1][1] >= first:
                        runs[-1][1] = at
                    else:
                        runs.append([first, at])
        every: set = set()
        for end in found:
            while end:
                every |= self.items[end]
                end = ends[fail[end]]
        return at, runs, every


def _blocks(raw: bytes):
    """The text in lower case, in pieces that part no word."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):
            edge = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(raw, end)
            end = edge.start() if edge else len(raw)
        yield raw[at:end].translate(_FOLD)
        at = end


def _places(raw: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code points at which runs of words begin and end in the text as it was."""
    out, at, word, behind, chars = [], 0, 0, 0, 0
    edges = [x for a, b in runs for x in (a, b - 1)]
    bytes_at: list[int] = []
    for block in _blocks(raw):
        for m in BYTES.finditer(block):
            while len(bytes_at) < len(edges) and edges[len(bytes_at)] == word:  # a run of one word has both its ends here
                bytes_at.append(at + (m.end() if len(bytes_at) % 2 else m.start()))
            word += 1
        at += len(block)
        if len(bytes_at) == len(edges):
            break
    for b in bytes_at:
        chars, behind = chars + len(raw[behind:b].decode()), b
        out.append(chars)
    return list(zip(out[::2], out[1::2]))


def _merged(runs: list) -> list:
    out: list = []
    for r in sorted(runs, key=lambda r: (r["first"], r["end"])):
        if out and r["first"] <= out[-1]["end"]:
            out[-1] |= {k: max(out[-1][k], r[k]) for k in ("end", "to_char")}
        else:
            out.append(dict(r))
    return out


_RUN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("from_char", pa.int64()), ("to_char", pa.int64())])
_HITS = "n_words bigint, runs array<struct<first:bigint,end:bigint,from_char:bigint,to_char:bigint>>, items array<string>"


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, words: int = AUTOMATON) -> list[DataFrame]:
    """The items' words, (item, words), dealt to as many automata as their number asks for: one up to ``words`` of them.
    An item is cut into pieces first, so that the parts are alike whatever its length. The driver learns a number here."""
    w = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0).distinct()
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE)))
    pieces = Scratch(benchmark.sparkSession, "leaks").write(items.select("item", "w", starts.alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(PIECE + window - 1)).alias("words")))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-total // words))
    return [pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k) if parts > 1 else pieces for k in range(parts)]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, words: int = AUTOMATON, keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns ``keep``, with n_words, n_hit, items, spans and contaminated: the words of each text, those that stand inside any
    occurrence of a window of an item, the ids of such items (sorted strings), and the places (from, to) of maximal hit
    runs in code points of the text as it is, end exclusive.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. Texts are read whole, in one scan; a
    text of any length is taken in blocks. A benchmark of at most ``words`` words is one automaton, which alone is
    broadcast; a larger one is dealt to several of that size, each of which scans once, and what they hit is put together
    by row. A null or empty text has no word and hits nothing; null or wordless items take no part; an item without id
    hits, but isn't listed; items of one id are one. Repeated rows, and rows without id, come back each for itself.
    Columns that the result names are replaced. Empty tables give empty results, or none hit."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_hit", "runs", "items", "spans", "contaminated")]
    parts = automata(benchmark, item_col, item_text_col, window, words)
    row, text = fresh(docs, "_row"), fresh(docs, "_text")
    docs = docs.select(*keep, F.col(text_col).alias(text))
    if len(parts) > 1:
        docs = Scratch(spark, "leaks").write(docs.withColumn(row, F.monotonically_increasing_id()))

    def hits(part: DataFrame, keep: list[str], every: bool) -> DataFrame:
        # the one thing that comes to the driver: a part of at most about so many words
        known = spark.sparkContext.broadcast(Automaton([(r["item"], r["words"]) for r in part.collect()], window))
        source = docs.select(*keep, text)
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name in keep) + _HITS

        def run(batches):
            automaton = known.value
            for batch in batches:
                texts, n, runs, items, at = batch.column(text), [], [], [], []
                for k, t in enumerate(texts):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    count, covered, found = automaton.scan(raw)
                    if covered or every:
                        at.append(k)
                        n.append(count)
                        runs.append([{"first": a, "end": b, "from_char": x, "to_char": y} for (a, b), (x, y) in zip(covered, _places(raw, covered) if covered else [])])
                        items.append(sorted(i for i in found if i is not None))
                kept = batch.select(keep) if every else batch.select(keep).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "runs", "items"])

        return source.mapInArrow(lean(run), schema)

    if len(parts) == 1:
        out = hits(parts[0], keep, True)
    else:
        found = hits(parts[0], [row], True)
        for part in parts[1:]:
            found = found.unionAll(hits(part, [row], False))
        n = partitions(spark)

        def put_together(key, table):
            rows = table.to_pylist()
            merged = _merged([r for x in rows for r in x["runs"]])
            items = sorted({i for x in rows for i in x["items"]})
            return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([rows[0]["n_words"]]), pa.array([merged], pa.list_(_RUN)), pa.array([items], pa.list_(pa.string()))], [row, "n_words", "runs", "items"])

        put = found.repartition(n, row).groupBy(row).applyInArrow(put_together, f"{row} bigint, {_HITS}")
        out = docs.join(put.withColumnRenamed(row, f"{row}r"), F.col(row) == F.col(f"{row}r")).drop(row, f"{row}r", text)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["from_char"].alias("from"), r["to_char"].alias("to")))
    return out.withColumns({"n_hit": hit, "spans": spans, "contaminated": F.size("runs") > 0}).drop("runs")


def op13(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs, bench, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
i as (select item_id, {_WORDS} w from benchmark where text is not null),
win as (select distinct item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') g from
  (select item_id, w, least(length(w), 10) k, unnest(range(1, length(w) - least(length(w), 10) + 2)) s from i where length(w) > 0)),
sizes as (select distinct k from win),
grams as (select r, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') g from (select r, w, k, unnest(range(1, length(w) - k + 2)) s from d join sizes on length(w) >= k)),
met as (select distinct r, s, k, item_id from grams join win using (k, g)),
hit as (select r, count(distinct p) n from (select r, unnest(range(s, s + k)) p from met) group by r),
its as (select r, count(*) n, sha256(string_agg(x, ',' order by x)) sha from (select distinct r, cast(item_id as varchar) x from met) group by r)
select d.doc_id, cast(length(d.w) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items, coalesce(its.sha, sha256('')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit on hit.r = d.r left join its on its.r = d.r
"""
