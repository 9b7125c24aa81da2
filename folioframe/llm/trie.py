"""The prefix trie of conversations by heavy-path decomposition: nodes are distinct prefixes, each with its largest child on
its path; sums over subtrees are suffix sums along paths, to which the totals of lighter paths were attached before."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import Scratch, crc_sql, partitions

#: The query's rebuilding: conversations by fives take up to this many turns, less one, of the first of their five.
FAMILY, HEADS = 5, 9
#: Characters of ids that are joined before they meet.
PACK = 1 << 14


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, h1, h2, bytes) of each turn: its place in its conversation from 1, 128 bits that tell role and text apart,
    the size of the text in UTF-8. A null turn stands first; null roles and texts are empty. Rows of one turn stand by
    role, then by hash; repeated rows are turns of their own. Rows without a conversation id take no part."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(11), text, F.lit(12), role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).alias("one"),
    )
    return running(Scratch(conversations.sparkSession, "trie"), rows, "c", ["turn", "role", "h1", "h2"], pos=("one", "sum")).select("c", "pos", "h1", "h2", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``trie`` takes, of turns as turns_of gives them."""
    n = turns.groupBy("c").agg(F.max("pos").alias("length"))
    return turns.join(n, "c").selectExpr("c", "pos d", "h1", "h2", "bytes", "pos = length last"), n


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with each conversation c begun by the first h turns of conversation c - c % 5, in place of its own first h;
    h is crc32(decimal c) % 9. The head is cut short where that conversation is shorter, and missing where there is none."""
    n = turns.groupBy("c").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("c").cast("string")) % HEADS
    heads = turns.where(F.col("pos") < HEADS).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "bytes"))).alias("head")).withColumnRenamed("c", "b")
    convs = n.withColumn("b", F.col("c") - F.col("c") % FAMILY).join(heads, "b", "left").withColumn("h", h.cast("int"))
    head = F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1))))
    convs = convs.select("c", "n", "h", F.coalesce(head, F.expr("cast(array() as array<struct<pos:bigint,h1:bigint,h2:bigint,bytes:bigint>>)")).alias("head"))
    convs = Scratch(turns.sparkSession, "trie").write(convs.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    taken = convs.select("c", "length", F.explode("head").alias("t")).selectExpr("c", "t.pos d", "t.h1 h1", "t.h2 h2", "t.bytes bytes", "t.pos = length last")
    own = turns.join(convs.select("c", "h", "k", "length"), "c").where("pos > h").selectExpr("c", "pos - h + k d", "h1", "h2", "bytes", "pos - h + k = length last")
    return taken.unionAll(own), convs.select("c", "length")


def _digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of ids c by node. The hash is sequential, so a node's ids pass one task, which holds nothing but
    the hash's state; they come joined in long strings, made where a node's ids are still dealt over many tasks."""
    parts = partitions(ends.sparkSession)

    def pack(batches):
        node, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and ((a, b) != node or size >= PACK):
                    out.append(row())
                    ids, size = [], 0
                node = a, b
                ids.append(c)
                size += len(str(c)) + 1
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("p1", "p2", "ends_sha256"), zip(*out))))
        if node:
            yield pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "ends_sha256": [state.hexdigest()]})

    packed = ends.select("p1", "p2", "c").repartitionByRange(parts, "p1", "p2", "c").sortWithinPartitions("p1", "p2", "c").mapInArrow(pack, "p1 bigint, p2 bigint, first bigint, ids string")
    return packed.repartition(parts, "p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(digest, "p1 bigint, p2 bigint, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations given as rows (c, d, h1, h2, bytes, last), d from 1, and convs
    (c, length), those without turns among them: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No conversation at all gives no node, not even the root.

    A node is told by 128 bits, the xor of its turns' hashes, each with its place. Largest child: of most conversations,
    then of the smallest id, so at most the logarithm of their number of light steps lead to any node, and as many rounds
    attach the totals of light paths to the nodes that they hang from. A path is named by the conversation of its leaf.
    Paths and conversations may be of any length and nodes of any number of children or members: their rows are summed up
    before they meet or dealt by ranges, and none is gathered."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "trie")
    own = [F.xxhash64(F.lit(s), "d", "h1", "h2") for s in (1, 2)]
    at = running(scratch, rows.select("c", "d", "bytes", "last", own[0].alias("t1"), own[1].alias("t2")), "c", ["d"], p1=("t1", "xor"), p2=("t2", "xor"))
    at = at.select("c", "d", "bytes", "last", "p1", "p2", F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"))

    nodes = at.groupBy("p1", "p2", "d").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = scratch.write(nodes.unionByName(root.selectExpr("0L p1", "0L p2", "0L d", "conv_id", "n_convs", "0L bytes", "cast(null as bigint) q1", "cast(null as bigint) q2")))
    # what each node has of its children, the largest among them
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"), "p1", "p2")).alias("heavy")
    kids = nodes.where("d > 0").groupBy("q1", "q2").agg(F.count("*").alias("n_children"), largest).selectExpr("q1 k1", "q2 k2", "n_children", "heavy.p1 h1", "heavy.p2 h2")
    ends = at.where("last").select("p1", "p2", "c").unionAll(convs.where("length = 0").selectExpr("0L p1", "0L p2", "c"))
    digests = _digests(ends).selectExpr("p1 e1", "p2 e2", "ends_sha256")
    nodes = nodes.join(kids, (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left").join(digests, (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left")
    nodes = scratch.write(nodes.select("p1", "p2", "d", "conv_id", "n_convs", "bytes", "q1", "q2", "h1", "h2", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    above = nodes.where("n_children > 0").selectExpr("p1 k1", "p2 k2", "conv_id parent_conv_id", "h1 g1", "h2 g2")
    nodes = nodes.join(above, (F.col("q1") == F.col("k1")) & (F.col("q2") == F.col("k2")), "left")
    light = ~F.coalesce((F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2")), F.lit(False))
    nodes = scratch.write(nodes.select("p1", "p2", "d", "conv_id", "n_convs", "parent_conv_id", "n_children", "ends_sha256", light.alias("light"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))

    # a leaf's path goes up along its conversation, to the last light node
    leaves = nodes.where("n_children = 0").selectExpr("conv_id path", "d = 0 alone")
    told = nodes.selectExpr("p1 k1", "p2 k2", "light", "cast(n_children = 0 as bigint) leaves", "saved")
    steps = at.join(leaves.where("not alone"), F.col("c") == F.col("path")).select("path", "d", "p1", "p2", "q1", "q2")
    steps = scratch.write(steps.join(told, (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))).drop("k1", "k2"))
    tops = steps.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("d"))), F.lit(0)).alias("top"), F.sum(F.col("light").cast("long")).alias("level"))
    tops = scratch.write(tops.unionAll(leaves.where("alone").selectExpr("path", "0L top", "0L level")))
    first = tops.where("top = 0").selectExpr("path", "0L o1", "0L o2").join(told, (F.col("o1") == F.col("k1")) & (F.col("o2") == F.col("k2")))
    first = first.selectExpr("path", "0L d", "0L p1", "0L p2", "cast(null as bigint) q1", "cast(null as bigint) q2", "leaves", "saved", "0L top", "0L level")
    on = steps.join(tops, "path").where("d >= top").select("path", "d", "p1", "p2", "q1", "q2", "leaves", "saved", "top", "level")
    on = scratch.write(on.unionAll(first))

    # paths hang from nodes of paths one level up; level by level, their totals go there
    hung = on.where("d = top and top > 0").selectExpr("path", "q1 k1", "q2 k2").join(on.selectExpr("path up", "d up_d", "p1", "p2"), (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))).select("path", "up", "up_d")
    paths = scratch.write(on.groupBy("path", "level").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("level > 0").join(hung, "path"))
    attached = None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        now = paths.where(F.col("level") == level)
        if attached:
            got = attached[-1].groupBy("up").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "to")
            now = now.join(got, F.col("path") == F.col("to"), "left").withColumn("leaves", F.col("leaves") + F.coalesce("more", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        attached = [*(attached or []), scratch.write(now.groupBy("up", "up_d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))]
    # attached rows stand beside the nodes' own, and are summed up with them from the path's end
    values = on.groupBy("path", "d").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if attached:
        every = attached[0]
        for more in attached[1:]:
            every = every.unionAll(more)
        values = values.join(every.toDF("up", "up_d", "more", "more_saved"), (F.col("path") == F.col("up")) & (F.col("d") == F.col("up_d")), "left")
        values = values.select("path", "d", "p1", "p2", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    sums = running(scratch, values.withColumn("up", -F.col("d")), "path", ["up"], n_leaves=("leaves", "sum"), saved_tokens=("saved", "sum"))
    out = nodes.join(sums.selectExpr("p1 k1", "p2 k2", "n_leaves", "saved_tokens"), (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")))
    return out.selectExpr("conv_id", "d depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of whole conversations as they stand; columns as of ``trie``, rows, nulls and ties as of ``turns_of``.
    Texts of any length are read once and go on as hashes; extra columns are ignored; an empty table gives no node."""
    return trie(*as_they_are(turns_of(conversations, id_col, turn_col, role_col, text_col)))


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = f"""
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, role) pos, coalesce(role, '') || chr(1) || coalesce(text, '') turn, coalesce(text, '') txt from conversations where conv_id is not null),
ids as (select c, count(*) n, {crc_sql("cast(c as varchar)")} % 9 h from t group by c),
seq as (select i.c, t.pos d, t.turn, t.txt from ids i join t on t.c = i.c - i.c % 5 and t.pos <= i.h
  union all select i.c, t.pos - i.h + least(i.h, coalesce(b.n, 0)) d, t.turn, t.txt from ids i join t on t.c = i.c and t.pos > i.h left join ids b on b.c = i.c - i.c % 5),
pre as (select a.c, a.d, sha256(string_agg(b.turn, chr(2) order by b.d)) k, any_value(a.txt) txt from seq a join seq b on b.c = a.c and b.d <= a.d group by a.c, a.d),
full_ as (select c, d, k, txt from pre union all select c, 0, '', '' from ids),
ends as (select k, sha256(string_agg(cast(c as varchar), ',' order by c)) sha from (select c, arg_max(k, d) k from full_ group by c) group by k),
node as (select f.k, f.d, min(f.c) c, count(*) n, any_value(f.txt) txt, any_value(p.k) pk from full_ f left join full_ p on p.c = f.c and p.d = f.d - 1 group by f.k, f.d),
kid as (select pk, count(*) n from node where d > 0 group by pk),
each_ as (select n.*, coalesce(kid.n, 0) n_kids, (n.n - 1) * octet_length(encode(n.txt)) saved from node n left join kid on kid.pk = n.k),
sums as (select f.k, sum(cast(e.n_kids = 0 as bigint)) leaves, sum(e.saved) saved from each_ e join full_ f on f.c = e.c and f.d <= e.d group by f.k)
select e.c conv_id, cast(e.d as bigint) depth, p.c parent_conv_id, cast(e.n as bigint) n_convs, cast(e.n_kids as bigint) n_children, cast(s.leaves as bigint) n_leaves, cast(s.saved as bigint) saved_tokens, coalesce(x.sha, sha256('')) ends_sha256
from each_ e join sums s on s.k = e.k left join ends x on x.k = e.k left join node p on p.k = e.pk and e.d > 0
"""
