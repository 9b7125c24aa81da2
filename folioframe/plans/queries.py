"""The operators over the driver's tables: one query each, with its DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mailbody
from ..functions import text as T
from ..operators import cluster as C
from ..operators import identity as I
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import threads as TH
from ..operators.graph import components, reachable
from ..operators.verify import contained, verify_quotes
from ..sources.mailbox import first_seen
from .scratch import Scratch, partitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- retrieval

QUESTION = "Did we ever decide on the thand of reanthe erwh estion?"
_TERMS = ["thand", "reanthe", "erwh", "estion"]
_BM25 = """
with tok as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents),
st as (select count(*) n, avg(length(w)) avgdl from tok),
tf as (select doc_id, length(w) dl, term, count(*) tf from (select doc_id, w, unnest(w) term from tok) where term in ('thand', 'reanthe', 'erwh', 'estion') group by all),
df as (select term, count(*) df from tf group by 1),
s as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score from tf join df using (term), st group by 1)
"""


@query(_BM25 + "select doc_id, score from s order by score desc, doc_id limit 30")
def bm25_topk(spark, d):
    return V.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), _TERMS, 30)


def _probe(dim: int = 64) -> list[float]:
    return [round(((i * 37) % 19 - 9) / 10, 1) for i in range(dim)]


@query(f"select vec_id, round(list_cosine_similarity(cast(embedding as double[]), {_probe()}::double[]), 6) score from embeddings order by score desc, vec_id limit 30")
def cosine_topk(spark, d):
    return V.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _probe(), 30)


@query(_BM25 + f""", a as (select doc_id id, row_number() over (order by score desc, doc_id) rank from (select * from s order by score desc, doc_id limit 30)),
c as (select vec_id id, round(list_cosine_similarity(cast(embedding as double[]), {_probe()}::double[]), 6) score from embeddings),
b as (select id, row_number() over (order by score desc, id) rank from (select * from c order by score desc, id limit 30)),
u as (select * from a union all select * from b)
select id, round(sum(1.0 / (60 + rank)), 8) score from u group by id order by sum(1.0 / (60 + rank)) desc, min(rank), id limit 8""")
def rrf_fusion(spark, d):
    lexical = V.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), _TERMS, 30).withColumnRenamed("doc_id", "id")
    near = V.nearest(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding", _probe(), 30)
    return V.rrf([V.ranked(lexical, "id"), V.ranked(near, "id")], "id", 8)


@query(_BM25 + f""", a as (select doc_id, row_number() over (order by score desc, doc_id) rank from (select * from s order by score desc, doc_id limit 30)),
c as (select vec_id doc_id, round(list_cosine_similarity(cast(embedding as double[]), {_probe()}::double[]), 6) score from embeddings),
b as (select doc_id, row_number() over (order by score desc, doc_id) rank from (select * from c order by score desc, doc_id limit 30)),
u as (select * from a union all select * from b)
select doc_id, round(sum(1.0 / (60 + rank)), 8) score from u group by doc_id order by sum(1.0 / (60 + rank)) desc, min(rank), doc_id limit 8""")
def hybrid_retrieve(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return V.retrieve(table(spark, d, "documents"), vectors, "doc_id", "text", "embedding", QUESTION, _probe())


@query()
def passages(spark, d):
    rows = V.passage_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.size(F.split("passage", r"\s+")).alias("words"), F.md5("passage").alias("digest"))
    return Scratch(spark, "passages").write(rows, small=True)


@query()
def hash_embedding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(partitions(spark), "doc_id")  # a file may be one split
    v = docs.select("doc_id", V.hash_embedding("text").alias("v"))
    return v.select("doc_id", F.array_max("v").cast("double").alias("top"), F.size(F.filter("v", lambda x: x != 0)).alias("filled"))


@query("select conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_€%]+'), lambda w: length(w) >= 3 and w not in (" + ", ".join(f"'{w}'" for w in T.QUERY_STOP) + "))) is not null ok, length(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_€%]+'), lambda w: length(w) >= 3 and w not in (" + ", ".join(f"'{w}'" for w in T.QUERY_STOP) + ")))) n_terms from conversations")
def query_terms(spark, d):
    c = table(spark, d, "conversations")
    terms = T.query_terms(F.col("text"))
    return c.select("conv_id", "turn", terms.isNotNull().alias("ok"), F.size(terms).cast("long").alias("n_terms"))


# ---------------------------------------------------------------- dedupe, filters, lookups

@query("select doc_id, md5(coalesce(text, '')) digest from documents qualify row_number() over (partition by md5(coalesce(text, '')) order by doc_id) = 1")
def first_wins(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return first_seen(docs, "digest", ("doc_id",))


@query("select o_orderkey, o_orderstatus, o_orderdate, o_orderpriority from orders where o_orderstatus in ('F', 'O') and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31' and o_orderpriority ilike '%urgent%' order by o_orderdate, o_orderkey")
def ledger_filter(spark, d):
    df = R.ledger_filter(table(spark, d, "orders"), among={"o_orderstatus": ["F", "O"]}, since=("o_orderdate", pd.Timestamp("1995-01-01")), until=("o_orderdate", pd.Timestamp("1996-12-31")), like=("urgent", "o_orderpriority"))
    return df.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")


@query("select c_custkey, coalesce(n_name, c_name) shown from customer left join nation on c_nationkey = n_nationkey and n_regionkey <> 2")
def left_lookup(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup(table(spark, d, "customer"), nation, "c_nationkey", "n_name", F.col("c_name"), "shown").select("c_custkey", "shown")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def anti_join(spark, d):
    return R.anti(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("select distinct c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def semi_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return R.semi(table(spark, d, "customer"), urgent, "c_custkey").select("c_custkey")


@query("select user_id, bool_or(event_type in ('purchase', 'click', 'signup')) strong from events group by 1")
def strong_signal(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type").isin("purchase", "click", "signup")).alias("strong"))


@query("select o_orderkey, o_orderdate > timestamp '1996-01-01' after_as_of from orders")
def as_of_label(spark, d):
    return R.as_of_label(table(spark, d, "orders"), "o_orderdate", pd.Timestamp("1996-01-01")).select("o_orderkey", "after_as_of")


# ---------------------------------------------------------------- theta joins

@query("""with t as (select l_suppkey k, min(l_shipdate) f, max(l_shipdate) l from lineitem group by 1), p as (select distinct l_suppkey k, l_partkey part from lineitem),
pairs as (select a.k thread_id, b.k other_id, b.f, count(*) n from (select * from t join p using (k)) a join (select * from t join p using (k)) b on a.part = b.part and a.k <> b.k and b.l >= a.f - interval 14 days and b.f <= a.l + interval 14 days group by all having count(*) >= 2)
select thread_id, other_id, cast(row_number() over (partition by thread_id order by f, other_id) as int) rank from pairs qualify rank <= 10""")
def related_threads_whole(spark, d):
    """The same over every line item, the people being the parts themselves."""
    threads = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("thread_id")).agg(F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"), F.collect_set("l_partkey").alias("participants"))
    return TH.related_threads(threads)


@query("select x.o_orderkey a, y.o_orderkey b from orders x join orders y on x.o_custkey = y.o_custkey and x.o_orderkey <> y.o_orderkey and y.o_orderdate + interval 3 days >= x.o_orderdate - interval 2 days and y.o_orderdate <= x.o_orderdate + interval 5 days")
def interval_overlap_whole(spark, d):
    """Every order against the same customer's others."""
    every = table(spark, d, "orders").selectExpr("o_orderkey k", "o_custkey c", "o_orderdate s", "o_orderdate + interval 3 days e")
    return TH.overlapping(every, "k", "s", "e", 2).where("a_c = b_c").selectExpr("a_k a", "b_k b")


@query("select a.o_orderkey ok, b.o_orderkey pk from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey and abs(date_diff('day', cast(a.o_orderdate as date), cast(b.o_orderdate as date))) <= 5")
def near_dates_whole(spark, d):
    """Every order against the same customer's others."""
    orders = table(spark, d, "orders")
    a = orders.selectExpr("o_orderkey ok", "o_orderdate od", "o_custkey ac")
    b = orders.selectExpr("o_orderkey pk", "o_orderdate pd", "o_custkey bc")
    return R.near_dates(a, b, "od", "pd", 5).where("ac = bc and ok <> pk").select("ok", "pk")


@query("""with a as (select distinct l_orderkey lk, cast(l_shipdate as date) ld, l_partkey item from lineitem where l_returnflag = 'R'),
b as (select distinct l_orderkey rk, cast(l_shipdate as date) rd, l_partkey item from lineitem where l_returnflag = 'A')
select lk, rk, count(*) shared from a join b using (item) where abs(date_diff('day', ld, rd)) <= 5 group by 1, 2
qualify row_number() over (partition by lk order by count(*) desc, rk) = 1""")
def best_overlap(spark, d):
    line = table(spark, d, "lineitem")
    a = line.where("l_returnflag = 'R'").selectExpr("l_orderkey lk", "cast(l_shipdate as date) ld", "l_partkey item")
    b = line.where("l_returnflag = 'A'").selectExpr("l_orderkey rk", "cast(l_shipdate as date) rd", "l_partkey item")
    return R.best_overlap(a, b, "item", "lk", "rk", "ld", "rd", 5)


# ---------------------------------------------------------------- aggregates

@query("select conv_id, min(turn) first_at, max(turn) last_at, count(*) n_msgs, list_sort(list_distinct(list(role))) participants, min(turn) first_key from conversations group by 1")
def thread_summary(spark, d):
    return R.thread_summary(table(spark, d, "conversations"), "conv_id", "turn", "turn", "role")


@query("select o_orderstatus, count(*) n from orders group by 1")
def status_histogram(spark, d):
    return R.histogram(table(spark, d, "orders"), "o_orderstatus")


@query("select event_type stage, count(*) calls, cast(sum(user_id) as bigint) tokens_in, cast(sum(event_id) as bigint) tokens_out, round(cast(sum(cast(round(value * 100) as bigint)) as bigint) / 100.0, 4) cost_usd from events group by 1")
def usage_by_group(spark, d):
    e = table(spark, d, "events").selectExpr("event_type stage", "user_id tokens_in", "event_id tokens_out", "cast(round(value * 100) as bigint) cents")
    u = R.usage(e.withColumn("cost_usd", F.col("cents")), "stage")
    return u.withColumn("cost_usd", F.round(F.col("cost_usd") / 100.0, 4))


@query("select event_type, round(count(*) filter (value > 50) / count(*), 3) high_share from events group by 1")
def derived_ratio(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(R.guarded_ratio(F.count_if(F.col("value") > 50), F.count("*")).alias("high_share"))


@query("select user_id, arg_max(props, struct_pack(ts := ts, event_id := event_id)) props from events group by 1")
def latest_payload(spark, d):
    return R.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], "props")


@query("""select l_suppkey, l_shipmode_like m from (select l_suppkey, l_returnflag || l_linestatus l_shipmode_like, count(*) n, min(l_orderkey) f from lineitem group by 1, 2)
qualify row_number() over (partition by l_suppkey order by n desc, f, l_shipmode_like) = 1""")
def mode_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("m"), "l_orderkey")
    return I.mode_first(rows, ["l_suppkey"], "m", "l_orderkey").select("l_suppkey", "m")


@query("""with n as (select p_brand, p_name, count(*) n from part group by 1, 2)
select p_brand, p_name canonical from n qualify row_number() over (partition by p_brand order by (length(string_split(trim(p_name), ' ')) >= 2) desc, n desc, length(p_name) desc, p_name desc) = 1""")
def name_vote(spark, d):
    names = table(spark, d, "part").groupBy("p_brand", F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return I.name_vote(names, "p_brand")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) r, count(*) over (partition by event_type) n from events)
select event_type, cast(floor(median(value)) as bigint) p50, max(case when r = cast(floor(0.9 * (n - 1)) as bigint) + 1 then value end) p90 from r group by 1""")
def latency_percentiles(spark, d):
    return R.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("""with r as (select l_quantity v, row_number() over (order by l_quantity) r, count(*) over () n from lineitem)
select cast(floor(median(v)) as bigint) p50, max(case when r = cast(floor(0.9 * (n - 1)) as bigint) + 1 then v end) p90 from r""")
def global_percentiles(spark, d):
    return R.global_percentiles(table(spark, d, "lineitem"), "l_quantity")


@query("""with m as (select case when d.doc_id is null then 'no' when length(d.text) > 200 then 'yes' else 'partial' end verdict from labels l left join documents d using (doc_id) where quality = 1)
select round(sum(case verdict when 'yes' then 1.0 when 'partial' then 0.5 else 0.0 end) / greatest(1, count(*)), 3)::double score, count(*) n from m""")
def weighted_recall(spark, d):
    m = table(spark, d, "labels").where("quality = 1").join(table(spark, d, "documents").selectExpr("doc_id", "length(text) n"), "doc_id", "left")
    return R.weighted_scores(m.withColumn("verdict", F.when(F.col("n").isNull(), "no").when(F.col("n") > 200, "yes").otherwise("partial")))


@query("""with c as (select label, (vec_id % 7) g, count(*) n from embeddings group by 1, 2),
x as (select sum(n * (n - 1) / 2) tp from c), t as (select sum(n * (n - 1) / 2) tt from (select label, sum(n) n from c group by 1)), f as (select sum(n * (n - 1) / 2) ff from (select g, sum(n) n from c group by 1)),
s as (select tp / greatest(ff, 1e-9) p, tp / greatest(tt, 1e-9) r from x, t, f)
select round(cast(p as double), 6) "precision", round(cast(r as double), 6) recall, round(cast(2 * p * r / greatest(p + r, 1e-9) as double), 6) f1 from s""")
def pairwise_f1(spark, d):
    return R.pairwise_f1(table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("g")), "label", "g")


@query("""select lang, count(*) filter (quality = 0) "0", count(*) filter (quality = 1) "1" from labels join documents using (doc_id) group by 1""")
def crosstab(spark, d):
    return R.crosstab(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", "quality", [0, 1])


@query("select count_star() docs, min(n_chars) least, max(n_chars) most, coalesce(cast(sum(n_chars) as bigint), 0) total from documents")
def scalar_aggregates(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("docs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total"))


@query("select p_brand, round(avg(p_retailprice), 4) price, cast(round(sum(p_size) * 0.1, 2) as double) size from part group by 1")
def rounded(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.sum("p_size") * 0.1, 2).alias("size"))


# ---------------------------------------------------------------- windows and sequences

@query("""select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as int) pos, 'm' || row_number() over (partition by conv_id order by turn) alias,
exists (select 1 from conversations b where b.conv_id = a.conv_id and b.turn = a.turn - 1) parent_in_thread from conversations a""")
def thread_positions(spark, d):
    c = table(spark, d, "conversations").withColumn("parent", F.col("turn") - 1)
    return TH.positions(c, "conv_id", ("turn",), "parent", "turn").select("conv_id", "turn", "pos", "alias", "parent_in_thread")


@query("select o_orderkey, printf('ORD-%06d', row_number() over (order by o_orderdate, o_orderkey)) order_id from orders")
def sequential_ids(spark, d):
    return R.sequential_ids(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "ORD-%06d", "order_id").select("o_orderkey", "order_id")


@query("""select event_id, event_type = 'view' and coalesce(max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following), 0) = 1 followed from events""")
def x_then_y(spark, d):
    e = table(spark, d, "events")
    return R.followed_by(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase").select("event_id", "followed")


@query("""with n as (select o_orderkey k, case when o_orderkey % 5 = 0 then 'contested' else 'active' end status from orders),
e as (select o_orderkey - o_orderkey % 4 dst, case when o_orderkey % 4 = 1 then 'amends' else 'supersedes' end kind from orders where o_orderkey % 4 in (1, 2) and o_orderkey % 3 = 0),
t as (select dst, bool_or(kind = 'supersedes') s, bool_or(kind = 'amends') a from e group by 1)
select k, case when status = 'contested' then status when s then 'superseded' when a then 'amended' else status end status from n left join t on k = dst""")
def status_propagation(spark, d):
    o = table(spark, d, "orders")
    nodes = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "contested").otherwise("active").alias("status"))
    edges = o.where("o_orderkey % 4 in (1, 2) and o_orderkey % 3 = 0").selectExpr("o_orderkey - o_orderkey % 4 dst", "case when o_orderkey % 4 = 1 then 'amends' else 'supersedes' end kind")
    return R.fix_statuses(nodes, edges, "k")


@query("select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month))::date as month from orders")
def month_ticks(spark, d):
    return R.month_ticks(table(spark, d, "orders"), "o_orderdate").select(F.col("month").cast("date").alias("month"))


# ---------------------------------------------------------------- graphs and clusters

_EDGES = "select distinct o_custkey a, o_custkey % 311 + 100000 b from orders where o_orderpriority like '1%'"


@query("""with recursive e as (select distinct l_orderkey x, -1 - l_partkey y from lineitem), b as (select x, y from e union all select y, x from e),
r(node) as (select min(x) from b union select b.y from r join b on b.x = r.node),
rest as (select * from b where x not in (select node from r)), q(n, m) as (select x, x from rest union select q.n, rest.y from q join rest on rest.x = q.m)
select node, (select min(node) from r) component from r union all select n, min(m) from q group by n""")
def graph_components_whole(spark, d):
    """Orders and the parts in them, over every line item; parts are numbered below 0."""
    return components(Scratch(spark, "components"), table(spark, d, "lineitem").selectExpr("l_orderkey a", "-1 - l_partkey b").distinct())


@query("""with recursive e as (select l_orderkey x, -1 - l_partkey y from lineitem union select -1 - l_partkey, l_orderkey from lineitem),
r(node) as (select x from e where x >= 0 and x < 500 union select e.y from r join e on e.x = r.node) select node from r""")
def chain_expansion_whole(spark, d):
    """The same over every line item; parts are numbered below 0, so that no order has their number."""
    g = table(spark, d, "lineitem").selectExpr("l_orderkey src", "-1 - l_partkey dst").distinct()
    return reachable(Scratch(spark, "chain"), g.where("src < 500").selectExpr("src node"), g)


@query("""with recursive v as (select cast(vec_id as varchar) id, vec_id % 40 p, label || '-' || vec_id % 30 e, embedding::double[] x from embeddings),
pr as (select a.id a, b.id b, list_cosine_similarity(a.x, b.x) + case when a.e = b.e then 0.25 else 0 end s, a.p = b.p or list_cosine_similarity(a.x, b.x) >= 0.85 l from v a join v b on a.id < b.id),
st(step, r, c) as (select 0, id, id from v union all
  select st.step + 1, st.r, case when st.c = best.cb then best.ca else st.c end from st, (select least(x.c, y.c) ca, greatest(x.c, y.c) cb, avg(s) m from pr join st x on x.r = a join st y on y.r = b where x.c <> y.c group by 1, 2 having bool_or(l) and avg(s) >= 0.4 order by m desc, ca, cb limit 1) best)
select r record_id, c root from st where step = (select max(step) from st)""")
def constrained_clusters(spark, d):
    e = table(spark, d, "embeddings")
    recs = e.select(F.col("vec_id").cast("string").alias("record_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.array(F.concat(F.lit("p"), (F.col("vec_id") % 40).cast("string"))).alias("people"), F.array(F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 30).cast("string"))).alias("entities"))
    return C.cluster_records(Scratch(spark, "clusters"), recs, 0.4)


@query()
def assignment(spark, d):
    """Within a brand, each part of the smaller sizes is given one of the larger that is near in price. Parts of one price are one class, as they have
    the same candidates."""
    p = table(spark, d, "part").where("p_size <= 25").selectExpr("p_partkey l", "p_brand block", "p_retailprice lp")
    q = table(spark, d, "part").where("p_size > 25").selectExpr("p_partkey r", "p_brand block", "p_retailprice rp")
    sizes = lambda df, price: df.groupBy("block", price).agg(F.count("*").alias(f"n_{price}"))
    cand = sizes(p, "lp").join(sizes(q, "rp"), "block").withColumn("w", F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("lp") - F.col("rp")) / 300), 4)).where("w > 0")
    found = C.match_classes(cand, "lp", "rp", "w", "block", "n_lp", "n_rp")
    return C.pairs_of_classes(found, p, q, "lp", "rp", "block", "l", "r").select("l", "r", "w")


@query("""with recursive o as (select o_custkey lane, o_orderkey k, o_orderdate s, o_orderdate + interval 60 days e, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) n from orders),
r as (select lane, k, n, cast(1 as bigint) p, [e] ends from o where n = 1 union all
  select lane, k, n, p, case when p > length(ends) then list_append(ends, e) else list_transform(ends, lambda x, i: case when i = p then e else x end) end ends
  from (select o.lane, o.k, o.n, o.e, r.ends, cast(coalesce(list_position(list_transform(r.ends, lambda x: x <= o.s), true), length(r.ends) + 1) as bigint) p from r join o on o.lane = r.lane and o.n = r.n + 1))
select lane, k, p - 1 as row from r""")
def lane_packing(spark, d):
    items = table(spark, d, "orders").selectExpr("o_custkey lane", "o_orderkey k", "o_orderdate s", "o_orderdate + interval 60 days e")
    return C.pack_lanes(items, "lane", "s", "e", "k").select("lane", "k", "row")


@query("select 'T-' || substr(sha1('<' || conv_id || '.' || min(turn) || '@x>'), 1, 10) thread_id, 'topic ' || conv_id subject_norm, count(*) n_msgs from conversations group by conv_id")
def reply_threads(spark, d):
    """Conversations as mail: turns reply to the one before, a third of them with the link lost."""
    c = table(spark, d, "conversations")
    mid = lambda turn: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), turn.cast("string"), F.lit("@x>"))
    lost = (F.col("conv_id") + F.col("turn")) % 3 == 0
    mails = c.select(mid(F.col("turn")).alias("message_id"), F.when((F.col("turn") > 0) & ~lost, mid(F.col("turn") - 1)).alias("in_reply_to"), F.array().cast("array<string>").alias("refs"), F.concat(F.col("role"), F.lit("@x")).alias("from_addr"), F.array(F.lit("user@x"), F.lit("assistant@x")).alias("to_addrs"), F.array().cast("array<string>").alias("cc_addrs"), (F.timestamp_seconds(F.lit(1767225600)) + F.make_dt_interval(F.col("conv_id").cast("int") % 20, F.col("turn").cast("int"))).alias("sent_at"), F.concat(F.lit("Re: topic "), F.col("conv_id").cast("string")).alias("subject"))
    return TH.build_threads(Scratch(spark, "threads"), mails)[1].select("thread_id", "subject_norm", "n_msgs")


# ---------------------------------------------------------------- text

@query("""select conv_id, turn, lower(trim(regexp_replace(regexp_replace(regexp_replace(split_part('Re: AW: ' || text, chr(10), 1), '^\\s*(?:(?:re|fwd?|fw|aw|wg|sv|vs|tr|rv|antw)\\s*(?:\\[[0-9]+\\])?\\s*:\\s*)+', '', 'i'), '\\s*\\((?:fwd|fw|forwarded)\\)\\s*$', '', 'i'), '\\s+', ' ', 'g'))) subject from conversations""")
def subjects(spark, d):
    line = F.split_part(F.concat(F.lit("Re: AW: "), "text"), F.lit("\n"), F.lit(1))
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_subject(line).alias("subject"))


@query("select distinct item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def verbatim(spark, d):
    """Benchmark items that stand in a document as they are."""
    return contained(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""select distinct item_id, doc_id from (select item_id, regexp_replace(lower(text), '\\s+', ' ', 'g') q from benchmark) b join (select doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') t from documents) d on contains(t, q)""")
def normalized_containment(spark, d):
    fold = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    items = table(spark, d, "benchmark").select("item_id", fold("text").alias("q")).where("length(q) > 0")
    docs = table(spark, d, "documents").select("doc_id", fold("text").alias("t"))
    return contained(docs, items, "doc_id", "t", "item_id", "q")


_FOLD = "replace(lower(regexp_replace({}, '\\s+', ' ', 'g')), 'ß', 'ss')"


_SENTENCES = """select conv_id, turn, i, s from (select conv_id, turn, unnest(range(1, length(p) + 1)) i, p from (select conv_id, turn, string_split(replace(text, chr(10), ' '), '. ') p from conversations)), lateral (select trim(p[i], ' .,') s) where length(s) between 24 and 400"""


@query(f"""select conv_id || '#' || turn || '#' || i quote_id, conv_id || '.' || turn source_id, s span, 'snapped' how from ({_SENTENCES})""")
def snapped_quotes(spark, d):
    """Every sentence of every turn, cited with one letter wrong: the first plain one from its middle on, as others (ß, for one) fold
    to several letters, and so would be several wrong."""
    c = table(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    texts = c.select(F.col("conv_id").cast("string").alias("thread_id"), F.concat_ws(".", "conv_id", "turn").alias("message_id"), F.col("turn").alias("pos"), F.col("text").alias("new_text"), F.lit("").alias("fwd_text"))
    q = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("i", "s")).withColumn("s", F.btrim("s", F.lit(" .,"))).where("length(s) between 24 and 400")
    wrong = F.expr(r"overlay(s placing '#' from cast(length(s) / 2 as int) + length(regexp_extract(substr(s, cast(length(s) / 2 as int)), r'^[^\x00-\x7F]*', 0)))")
    q = q.select(F.concat_ws("#", "conv_id", "turn", F.col("i") + 1).alias("quote_id"), F.col("conv_id").cast("string").alias("thread_id"), F.concat_ws(".", "conv_id", "turn").alias("message_id"), wrong.alias("quote"), F.lit("decision").alias("role"))
    return verify_quotes(q, texts).select("quote_id", "source_id", "span", "how")


@query(f"""with c as (select conv_id, turn, {_FOLD.format('text')} t from conversations), q as (select conv_id, turn, trim({_FOLD.format('upper(substr(text, 1, 40))')}, ' .,;:!?"''-') q from conversations where turn = 1),
h as (select q.conv_id, min(c.turn) place from q join c on c.conv_id = q.conv_id and length(q) >= 3 and contains(c.t, q.q) group by 1)
select q.conv_id || '#' || q.turn quote_id, case when h.place is null then q.conv_id || '.0' else q.conv_id || '.' || h.place end source_id, case when h.place is null then 'dropped' when h.place = 0 then 'exact' else 'reanchored' end how, h.place is not null verified from q left join h using (conv_id)""")
def verified_quotes(spark, d):
    """Each conversation's first words, cited from the wrong turn, with their case and spaces changed."""
    c = table(spark, d, "conversations")
    texts = c.select(F.col("conv_id").cast("string").alias("thread_id"), F.concat_ws(".", "conv_id", "turn").alias("message_id"), F.col("turn").alias("pos"), F.col("text").alias("new_text"), F.lit("").alias("fwd_text"))
    q = c.where("turn = 1").select(F.concat_ws("#", "conv_id", "turn").alias("quote_id"), F.col("conv_id").cast("string").alias("thread_id"), F.concat_ws(".", F.col("conv_id"), F.lit(0)).alias("message_id"), F.upper(F.substring("text", 1, 40)).alias("quote"), F.lit("decision").alias("role"))
    return verify_quotes(q, texts).select("quote_id", "source_id", "how", "verified")


@query("""select doc_id, length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '', 'g')) < length(text) has_email from documents""")
def email_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("has_email"))


@query()
def redacted(spark, d):
    text = T.redact_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), F.regexp_count(text, F.lit(r"\[(email|phone|IBAN)\]")).alias("tags"))


@query()
def page_text(spark, d):
    return Scratch(spark, "pages").write(table(spark, d, "pages").select("page_id", F.md5(mailbody.text_of_html("html")).alias("digest")), small=True)


@query()
def citations_enforced(spark, d):
    md = F.array_join(F.transform(F.split("text", r"(?<=\.)\s+"), lambda s, i: F.concat(s, F.when(i % 3 == 0, F.lit(" [^1].")).when(i % 3 == 1, F.lit(" [^9].")).otherwise(F.lit("")))), " ")
    out = T.enforce_citations(md, F.array(F.lit(1)), F.lit("found"))
    return table(spark, d, "documents").select("doc_id", out.alias("o")).select("doc_id", "o.dropped", F.md5("o.text").alias("digest"))


@query()
def entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.entities(F.col("text"), F.array().cast("array<string>"))).alias("n_entities"))


# earlier names of queries that once read a part of their tables
for _name in ("related_threads", "interval_overlap", "near_dates", "graph_components", "chain_expansion"):
    QUERIES[f"q_{_name}"], SQL[f"q_{_name}"] = QUERIES[f"q_{_name}_whole"], SQL[f"q_{_name}_whole"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import ledger_queries  # noqa: E402, F401  (it adds its queries to these)
