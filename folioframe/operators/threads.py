"""Threads of mail: reply components, subject fallback, thread rows, and how threads relate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import Scratch, partitions
from .graph import components
from .running import running

WINDOW_DAYS, OVERLAP = 14, 0.5
#: People of more threads are busy; as many threads make a block.
BUSY = 512
#: The first band of others holds one of so many threads.
BANDS = 64


def participants(df: DataFrame) -> DataFrame:
    who = F.concat(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>")), F.coalesce("cc_addrs", F.array().cast("array<string>")))
    return df.withColumn("people", F.array_distinct(F.filter(who, lambda x: x.isNotNull() & (x != ""))))


def reply_components(scratch: Scratch, emails: DataFrame) -> DataFrame:
    """(message_id, component): messages joined by replies and references, through parents that aren't there too."""
    parents = F.explode(F.concat(F.array("in_reply_to"), F.coalesce("refs", F.array().cast("array<string>"))))
    edges = emails.select(F.col("message_id").alias("a"), parents.alias("b")).where("b is not null and b <> ''")
    found = components(scratch, edges)
    out = emails.select("message_id").join(found, F.col("message_id") == F.col("node"), "left")
    return out.select("message_id", F.coalesce("component", "message_id").alias("component"))


#: Stretches of subjects that share a group, about so many, as each alone is a few rows.
TOGETHER = 256


def _follow(key, table):
    """Of each subject's stretch: joins a component without a known parent to the latest open one, within the window and with
    enough of its first message's people; what joins widens the open one."""
    window = WINDOW_DAYS * 86_400_000_000
    table = table.sort_by([(c, "ascending") for c in ("subject_norm", "stretch", "first_at", "component")])
    first_at, last_at = (table[c].cast(pa.int64()).to_pylist() for c in ("first_at", "last_at"))
    columns = [table[c].to_pylist() for c in ("subject_norm", "stretch", "component", "has_parent", "first_people", "people")]
    open_ones: list[dict] = []
    roots, before = [], None
    for start, end, subject, stretch, component, has_parent, few, people in zip(first_at, last_at, *columns):
        if before != (subject, stretch):
            open_ones, before = [], (subject, stretch)
        target = None
        first = set(few)
        if not has_parent and first and start is not None:
            for one in reversed(open_ones):
                if one["last"] is not None and 0 <= start - one["last"] <= window and len(first & one["people"]) >= OVERLAP * len(first):
                    target = one
                    break
        if target is None:
            target = {"component": component, "last": end, "people": set(people)}
            open_ones.append(target)
        else:
            target["last"] = max(target["last"], end)
            target["people"] |= set(people)
        roots.append(target["component"])
    return pa.table({"component": table["component"], "thread_root": pa.array(roots, pa.string())})


def build_threads(scratch: Scratch, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message_id, thread_id) of each message, and table threads.

    The subject fallback runs for each subject alone, and there for each stretch that no gap of more than the window
    divides, so that a common subject isn't one group."""
    e = participants(emails).withColumn("subject_norm", T.normalize_subject(F.col("subject")))
    comp = reply_components(scratch, e)
    known = e.select(F.col("message_id").alias("known_id"))
    told = scratch.write(e.join(comp, "message_id"))
    first = F.struct("sent_at", "message_id")
    rows = told.groupBy("component").agg(
        F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"),
        F.min_by("subject_norm", first).alias("subject_norm"), F.min_by("people", first).alias("first_people"),
        F.array_distinct(F.flatten(F.collect_list("people"))).alias("people"),
        F.min_by(F.concat(F.array("in_reply_to"), F.coalesce("refs", F.array().cast("array<string>"))), first).alias("parents"),
    )
    rows = scratch.write(rows)
    have = rows.select("component", F.explode("parents").alias("p")).join(known, F.col("p") == F.col("known_id")).select("component").distinct().withColumn("has_parent", F.lit(True))
    rows = scratch.write(rows.join(have, "component", "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False))).drop("parents"))
    by = Window.partitionBy("subject_norm").orderBy("first_at", "component")
    before = F.max("last_at").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(before.isNull() | (F.col("first_at") > before + F.expr(f"interval {WINDOW_DAYS} days")), 1).otherwise(0)
    some = rows.where("subject_norm <> ''").withColumn("new", apart).withColumn("stretch", F.sum("new").over(by)).drop("new")
    groups = max(1, rows.count() // TOGETHER)
    some = some.select("component", "subject_norm", "stretch", "first_at", "last_at", "has_parent", "first_people", "people", F.pmod(F.xxhash64("subject_norm", "stretch"), F.lit(groups)).alias("deal"))
    joined = some.groupBy("deal").applyInArrow(_follow, "component string, thread_root string")
    root = scratch.write(joined.unionByName(rows.where("subject_norm = ''").selectExpr("component", "component thread_root")))
    told = told.join(root, "component")
    threads = told.groupBy("thread_root").agg(
        F.min_by("message_id", first).alias("first_id"), F.min_by("subject_norm", first).alias("subject_norm"), F.min("sent_at").alias("first_at"),
        F.max("sent_at").alias("last_at"), F.count("*").alias("n_msgs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("participants"),
    ).withColumn("thread_id", T.thread_id(F.col("first_id")))
    threads = scratch.write(threads)
    mapping = told.join(threads.select("thread_root", "thread_id"), "thread_root").select("message_id", "thread_id")
    return mapping, threads.select("thread_id", "subject_norm", "first_at", "last_at", "n_msgs", "participants")


def positions(messages: DataFrame, thread: str = "thread_id", order: tuple = ("sent_at", "message_id"), parent: str = "in_reply_to", key: str = "message_id") -> DataFrame:
    """Adds pos, alias (m1, m2, ...) and parent_in_thread."""
    w = Window.partitionBy(thread).orderBy(*order)
    out = messages.withColumn("pos", F.row_number().over(w)).withColumn("alias", F.concat(F.lit("m"), F.col("pos").cast("string")))
    ids = messages.select(F.col(thread).alias("_thread"), F.col(key).alias("_key")).distinct().withColumn("parent_in_thread", F.lit(True))
    out = out.join(ids, (F.col(thread) == F.col("_thread")) & (F.col(parent) == F.col("_key")), "left").drop("_thread", "_key")
    return out.withColumn("parent_in_thread", F.coalesce("parent_in_thread", F.lit(False)))


def overlapping(rows: DataFrame, key: str, start: str, stop: str, days: int, bucket_days: int | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of rows whose time ranges, widened by ``days``, meet: an equi-join on day buckets in place of a
    cross join. A pair is made in the first bucket that both fill."""
    size = bucket_days or max(1, days)
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400 / size)
    wide = F.expr(f"interval {days} days")
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]).withColumn("_lo", day(F.col(f"a_{start}") - wide)).withColumn("_hi", day(F.col(f"a_{stop}") + wide))
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns]).withColumn("_from", day(F.col(f"b_{start}"))).withColumn("_to", day(F.col(f"b_{stop}")))
    left = left.withColumn("_b", F.explode(F.sequence("_lo", "_hi")))
    right = right.withColumn("_b", F.explode(F.sequence("_from", "_to")))
    meet = left.join(right, "_b").where(f"_b = greatest(_lo, _from) and a_{key} <> b_{key} and b_{stop} >= a_{start} - interval {days} days and b_{start} <= a_{stop} + interval {days} days")
    return meet.drop("_b", "_lo", "_hi", "_from", "_to")


def _time_blocks(scratch: Scratch, threads: DataFrame, size: int) -> DataFrame:
    """(no, top, lo, until, ids, firsts, lasts, people, sizes): blocks of threads (id, f, l, people) in the order of their first
    times and ids, numbered from 0; lo is the earliest first time, until the latest last time, top that of all blocks so far."""
    kind = dict(threads.dtypes)["id"]

    def pack(batches):
        rest, n = None, 0

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal n
            n += 1
            f, last = t["f"].to_numpy(), t["l"].to_numpy()
            people = t["people"].to_pylist()
            return pa.RecordBatch.from_pydict({
                "at": [(t["part"][0].as_py() << 32) + n], "lo": [f[0]], "until": [last.max()], "ids": [t["id"].to_pylist()], "firsts": [f.tobytes()], "lasts": [last.tobytes()],
                "people": [np.array([p for x in people for p in x], np.int64).tobytes()], "sizes": [np.array([len(x) for x in people], np.int64).tobytes()]})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while len(rest) >= size:
                yield block(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and len(rest):
            yield block(rest)

    dealt = threads.repartitionByRange(partitions(scratch.spark), "f", "id").sortWithinPartitions("f", "id").withColumn("part", F.spark_partition_id().cast("long"))
    packed = scratch.write(dealt.mapInArrow(pack, f"at bigint, lo bigint, until bigint, ids array<{kind}>, firsts binary, lasts binary, people binary, sizes binary"))
    numbered = running(scratch, packed.select(F.lit(0).cast("long").alias("k"), "at", "until", F.lit(1).alias("one")), "k", ["at"], no=("one", "sum before"), top=("until", "max"))
    return scratch.write(packed.join(numbered.select("at", "no", "top"), "at").drop("at"))


def _busy_pairs(scratch: Scratch, threads: DataFrame, ticks: int, shared: int, most: int, size: int) -> DataFrame:
    """(id, other, other_f): for each of the threads (id, f, l, people) the first ``most`` others, by first time and id, that are at most
    so many ticks away and share so many people.

    Blocks of threads stand in order of time. Each block meets the others from the first one that isn't over yet, one, then two,
    then four a round, and is done when all its threads have found enough or the rest begins too late."""
    blocks = _time_blocks(scratch, threads, size)
    kind = dict(threads.dtypes)["id"]
    schema = f"no bigint, id {kind}, other {kind}, other_f bigint"

    def meet(batches):
        for batch in batches:
            out: list = []
            for r in batch.to_pylist():
                sides = []
                for s in ("a_", "b_"):
                    sides.append((r[s + "ids"], *(np.frombuffer(r[s + c], np.int64) for c in ("firsts", "lasts", "people", "sizes"))))
                (ia, fa, la, pa_, na), (ib, fb, lb, pb, nb) = sides
                codes = np.unique(pa_)
                a = np.zeros((len(ia), codes.size), np.float32)
                a[np.repeat(np.arange(len(ia)), na), np.searchsorted(codes, pa_)] = 1
                at = np.minimum(np.searchsorted(codes, pb), max(codes.size - 1, 0))
                known = codes[at] == pb
                b = np.zeros((len(ib), codes.size), np.float32)
                b[np.repeat(np.arange(len(ib)), nb)[known], at[known]] = 1
                ok = (a @ b.T >= shared) & (lb[None, :] >= fa[:, None] - ticks) & (fb[None, :] <= la[:, None] + ticks)
                if r["no"] == r["b_no"]:
                    np.fill_diagonal(ok, False)
                ok &= np.cumsum(ok, axis=1) <= most  # a block is in order
                out += [(r["no"], ia[x], ib[y], int(fb[y])) for x, y in zip(*np.nonzero(ok))]
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in zip(("no", "id", "other", "other_f"), zip(*out))})

    # the first block whose end, or an earlier one's, isn't before a block's beginning: blocks of earlier ends, counted in order
    asked = blocks.select(F.lit(0).cast("long").alias("k"), (F.col("lo") - ticks).alias("v"), F.lit(0).alias("kind"), "no").unionByName(blocks.select(F.lit(0).cast("long").alias("k"), F.col("top").alias("v"), F.lit(1).alias("kind"), "no"))
    start = running(scratch, asked, "k", ["v", "kind", "no"], next=("kind", "sum")).where("kind = 0").select("no", "next")
    still = scratch.write(blocks.select("no", "until", F.size("ids").alias("n")).join(start, "no"))
    found, width = [], 1
    while not still.isEmpty():
        head = blocks.select(F.col("no").alias("b_no"), F.col("lo").alias("b_lo"), F.col("until").alias("b_until"))
        steps = still.select("no", "until", F.explode(F.sequence("next", F.col("next") + width - 1)).alias("b_no")).join(head, "b_no").where(F.col("b_lo") <= F.col("until") + ticks)
        payload = lambda s: blocks.select(F.col("no").alias("no" if s == "a_" else "b_no"), *[F.col(c).alias(s + c) for c in ("ids", "firsts", "lasts", "people", "sizes")])
        met = steps.select("no", "b_no").join(payload("a_"), "no").join(payload("b_"), "b_no")
        found.append(scratch.write(met.mapInArrow(meet, schema)))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        full = every.groupBy("no", "id").agg(F.count("*").alias("found")).where(F.col("found") >= most).groupBy("no").agg(F.count("*").alias("full"))
        ahead = still.withColumn("next", F.col("next") + width).join(full, "no", "left").where(F.coalesce("full", F.lit(0)) < F.col("n")).drop("full")
        # of what is ahead, the next block tells whether any can still begin in time
        still = scratch.write(ahead.join(head.select("b_no", "b_lo"), F.col("next") == F.col("b_no")).where(F.col("b_lo") <= F.col("until") + ticks).drop("b_no", "b_lo"))
        width = min(2 * width, 64)
    out = scratch.spark.createDataFrame([], schema)
    for f in found:
        out = out.unionByName(f)
    return out.drop("no")


def _light_pairs(scratch: Scratch, light: DataFrame, ticks: int, shared: int, most: int, bands: int) -> DataFrame:
    """(thread_id, other_id, other_f): of the pairs that people (thread_id, f, l, person, heavy) make, at least each thread's first
    ``most``, by the others' first times and ids.

    The threads are parted by their order into bands of 1 / bands, as much again, twice as much, and so on. Each thread meets the bands
    in turn, until it has found enough or none is left, so most of the pairs are never made."""
    light = scratch.write(light)
    order = running(scratch, light.select("thread_id", "f").distinct().select(F.lit(0).cast("long").alias("k"), "thread_id", "f", F.lit(1).alias("one")), "k", ["f", "thread_id"], no=("one", "sum before"))
    order = scratch.write(order.select("thread_id", "no"))
    n = order.count()
    numbered = scratch.write(light.join(order, "thread_id"))
    asked, found, lo, width = numbered, [], 0, max(most, -(-n // bands))
    near = (F.col("other_l") >= F.col("f") - ticks) & (F.col("other_f") <= F.col("l") + ticks) & (F.col("thread_id") != F.col("other_id"))
    while lo < n:
        band = numbered.where((F.col("no") >= lo) & (F.col("no") < lo + width)).select(F.col("thread_id").alias("other_id"), F.col("f").alias("other_f"), F.col("l").alias("other_l"), "person", F.col("heavy").alias("other_heavy"))
        met = asked.join(band, "person").where(near).groupBy("thread_id", "other_id", "other_f").agg(F.count("*").alias("n"), F.max(F.size(F.array_intersect("heavy", "other_heavy"))).alias("m"))
        found.append(scratch.write(met.where(F.col("n") + F.col("m") >= shared).select("thread_id", "other_id", "other_f"), wide=True))
        lo, width = lo + width, lo + width
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        if lo < n:
            full = every.groupBy("thread_id").agg(F.count("*").alias("got")).where(F.col("got") >= most).select("thread_id")
            asked = scratch.write(numbered.join(full, "thread_id", "left_anti"))
            if asked.isEmpty():
                break
    return every if n else light.selectExpr("thread_id", "thread_id other_id", "f other_f")


def related_threads(threads: DataFrame, days: int = WINDOW_DAYS, shared: int = 2, most: int = 10, busy: int = BUSY, block: int = BUSY, bands: int = BANDS) -> DataFrame:
    """(thread_id, other_id, rank): threads near in time with at least ``shared`` people in common, the earliest first.

    People of at most ``busy`` threads make pairs by their threads, band by band of the others' time (``_light_pairs``). The
    others would make the square of them; threads that share only such people meet in blocks by time, until each has ``most``
    (``_busy_pairs``). Pairs of the first kind count what busy people they share as well. Threads without times or people have none."""
    scratch = Scratch(threads.sparkSession, "related")
    people = F.array_distinct(F.array_compact("participants"))
    rows = scratch.write(threads.where("first_at is not null and last_at is not null").select("thread_id", F.unix_micros(F.col("first_at").cast("timestamp")).alias("f"), F.unix_micros(F.col("last_at").cast("timestamp")).alias("l"), F.transform(people, lambda p: F.xxhash64(p)).alias("people")))
    person = rows.select("thread_id", "f", "l", F.explode("people").alias("person"))
    sizes = person.groupBy("person").agg(F.count("*").alias("n")).where("n > 1")
    told = scratch.write(person.join(sizes, "person").select("thread_id", "f", "l", "person", (F.col("n") > busy).alias("is_busy")))
    heavy = told.where("is_busy").groupBy("thread_id").agg(F.array_sort(F.collect_list("person")).alias("heavy"))
    light = told.where("not is_busy").join(heavy, "thread_id", "left").select("thread_id", "f", "l", "person", F.coalesce("heavy", F.array().cast("array<bigint>")).alias("heavy"))
    ticks = days * 86_400_000_000
    pairs = _light_pairs(scratch, light, ticks, shared, most, bands)
    crowd = heavy.where(F.size("heavy") >= shared).join(rows.select("thread_id", "f", "l"), "thread_id").select(F.col("thread_id").alias("id"), "f", "l", F.col("heavy").alias("people"))
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_busy_pairs(scratch, crowd, ticks, shared, most, block).toDF("thread_id", "other_id", "other_f")).distinct()
    w = Window.partitionBy("thread_id").orderBy("other_f", "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("thread_id", "other_id", "rank")


def render(messages: DataFrame, quoted_most: int = 800, fwd_most: int = 600) -> DataFrame:
    """(thread_id, text): the thread as one text in order; quoted history only where the parent isn't in the thread."""
    part = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("alias"), F.lit("] "), F.coalesce("from_name", "from_addr"), F.lit(" "), F.date_format("sent_at", "yyyy-MM-dd HH:mm")), F.col("new_text"),
        F.when(F.coalesce("fwd_text", F.lit("")) != "", F.concat(F.lit("[forwarded] "), F.substring("fwd_text", 1, fwd_most))),
        F.when(~F.col("parent_in_thread") & (F.coalesce("quoted_text", F.lit("")) != ""), F.concat(F.lit("[quoted] "), F.substring("quoted_text", 1, quoted_most))),
    )
    return positions(messages).withColumn("part", part).groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def extract_prompt(messages: DataFrame, related: DataFrame, directory: str = "") -> DataFrame:
    """(thread_id, text): what an extraction is asked of a thread: the people, the subjects of related threads (thread_id,
    subject), and the thread itself."""
    others = related.groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "subject"))), "\n").alias("others"))
    told = render(messages).join(others, "thread_id", "left")
    head = [F.concat(F.lit("PEOPLE\n"), F.lit(directory))] if directory else []
    return told.select("thread_id", F.concat_ws("\n\n", *head, F.concat(F.lit("RELATED THREADS\n"), F.col("others")), F.concat(F.lit("THREAD\n"), F.col("text"))).alias("text"))
