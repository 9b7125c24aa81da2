"""Ledger, mail, metric and serving operators over tables derived from the driver's: one query each, with its SQL.

The derived tables are SELECTs that Spark and DuckDB read alike, so a query and its SQL start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mailbody, matching
from ..functions import text as T
from ..operators import cluster as C
from ..operators import identity as I
from ..operators import ledger as L
from ..operators import metrics as X
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import serving as S
from ..operators import threads as TH
from ..schemas import ANSWERS
from ..sources import mailbox, tables
from ..streaming import ingest
from .queries import query, table
from .scratch import Scratch

DERIVED = {
    "decisions": """select concat('DEC-', o_orderkey) decision_id, concat('C-', o_custkey % 300) cluster_id, concat('Take order ', o_orderkey, ' as ', o_orderpriority) canonical_text,
      cast(cast(o_orderdate as date) as string) decided_at, case when o_orderkey % 3 = 0 then null else concat('clerk ', o_custkey % 17) end rationale,
      case when o_orderpriority like '1%' then 'implicit' else 'explicit' end decision_type, case o_orderstatus when 'F' then 'superseded' when 'P' then 'contested' else 'active' end status,
      o_orderkey % 11 = 0 authority_flag from {orders}""",
    "edges": """select concat('DEC-', o_orderkey) src, concat('DEC-', case when o_orderkey % 9 = 0 then o_orderkey when o_orderkey % 7 = 0 then o_orderkey + 100000000 else o_orderkey - o_orderkey % 4 end) dst,
      case when o_orderkey % 4 = 1 then 'amends' when o_orderkey % 4 = 2 then 'supersedes' else 'refines' end kind from {orders} where o_orderkey % 4 > 0""",
    "evidence": """select l_orderkey * 10 + l_linenumber id, case when l_linenumber <= 4 then 'decision' when l_linenumber <= 6 then 'record' else 'conflict_side' end owner_kind,
      case when l_linenumber <= 4 then concat('DEC-', l_orderkey) when l_linenumber <= 6 then concat('R-', l_orderkey) else concat('CON-', l_orderkey % 50, ':', case when l_suppkey % 2 = 0 then 'A' else 'B' end) end owner_id,
      concat('<', l_partkey, '@x>') message_id, case when l_quantity < 40 then concat('of Brand#', l_suppkey % 25) else concat('fwd of Brand#', l_suppkey % 25) end quote,
      case l_returnflag when 'R' then 'approval' when 'A' then 'recap' else 'confirmation' end role, l_linestatus = 'F' verified from {lineitem}""",
    "emails": """select concat('<', p_partkey, '@x>') message_id, concat('T-', p_brand) thread_id, p_name subject, concat('p', p_size, '@', case when p_size % 3 = 0 then 'in' else 'out' end, '.example') from_addr,
      case when p_size % 4 = 0 then null else concat('Person ', p_size) end from_name, concat(p_name, ' of ', p_brand, ' is ', p_type) new_text, case when p_partkey % 5 = 0 then concat('fwd of ', p_brand) else '' end fwd_text,
      case when p_partkey % 3 = 0 then concat('> older ', p_name) else '' end quoted_text, cast(concat('2026-0', 1 + p_partkey % 9, '-1', p_partkey % 10, ' 0', p_size % 10, ':00:00') as timestamp) sent_at from {part}""",
    "people": """select s_suppkey id, s_name canonical_name, case when s_suppkey % 3 = 0 then null else concat('Role ', s_nationkey) end role_guess, case when s_suppkey % 5 = 0 then '' else concat('Org ', s_nationkey) end org, s_acctbal > 4000 is_internal from {supplier}""",
    "identities": """select s_suppkey person_id, 'email' kind, concat('s', s_suppkey, '@x.example') "value" from {supplier} union all select s_suppkey, 'email', concat('t', s_suppkey, '@y.example') from {supplier} where s_nationkey % 2 = 0
      union all select s_suppkey, 'display_name', s_name from {supplier}""",
    "messages": """select concat('<', conv_id, '.', turn, '@x>') message_id, concat('T-', conv_id) thread_id, turn pos, concat(role, '@', case when conv_id % 3 = 0 then 'in' else 'out' end, '.example') from_addr, role from_name, "text" new_text,
      case when turn % 4 = 3 then concat('fyi ', role) else '' end fwd_text, case when turn = 0 then null else concat('<', conv_id, '.', turn - 1, '@x>') end in_reply_to,
      cast(concat('2026-0', 1 + conv_id % 9, '-1', conv_id % 10, ' ', lpad(cast(turn as string), 2, '0'), ':30:00') as timestamp) sent_at, conv_id, turn, role from {conversations}""",
    "records": """select concat('R-', o_orderkey) record_id, concat('T-', o_custkey % 500) thread_id, concat('C-', o_custkey % 300) cluster_id, concat('topic ', o_orderpriority) topic_label, case o_orderstatus when 'F' then 'final' when 'P' then 'proposed' else 'final' end stance,
      cast(cast(o_orderdate as date) as string) decision_date, o_orderkey from {orders}""",
    "conflicts": """select distinct concat('CON-', o_orderkey % 50) conflict_id, concat('C-', o_orderkey % 50) cluster_id, concat('topic ', o_orderkey % 50 % 7) topic, concat('summary ', o_orderkey % 50) summary from {orders} where o_orderkey % 50 % 7 <> 0 or o_orderkey % 50 = 0""",
    "sides": """select distinct concat('CON-', l_orderkey % 50) conflict_id, case l_returnflag when 'R' then 'A' when 'A' then 'B' else 'C' end side, concat('claimant ', l_returnflag) claimant, concat('claim ', l_orderkey % 50, l_returnflag) claim from {lineitem} where l_quantity > 49""",
    "runs": """select concat('run-', user_id) run_id, event_type stage, ts started_at, ts + interval 90 seconds finished_at, event_id n_in, props notes, event_id, user_id, "value" from {events}""",
    "calls": """select concat('run-', user_id) run_id, event_type stage, event_id % 3 = 0 cached, event_id % 500 tokens_in, user_id tokens_out, event_id from {events}""",
}
#: What Spark reads otherwise; a time that isn't one (the hours of long conversations) is null, also where casts are strict.
_SPARK = {'"value"': "value", '"text"': "text", "cast(concat('2026-0'": "try_cast(concat('2026-0'"}


def frame(spark, d: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in DERIVED:
        return table(spark, d, name)
    sql = DERIVED[name]
    for a, b in _SPARK.items():
        sql = sql.replace(a, b)
    return spark.sql(sql, **{n: table(spark, d, n) for n in set(re.findall(r"{(\w+)}", sql))})


def over(*names: str) -> str:
    """The derived tables as the head of a DuckDB query."""
    return "with " + ", ".join(f"{n} as ({re.sub(r'{(\w+)}', r'\1', DERIVED[n])})" for n in names) + "\n"


def frames(spark, d: str, *names: str) -> list[DataFrame]:
    return [frame(spark, d, n) for n in names]


# ---------------------------------------------------------------- projections and predicates

@query(over("messages") + "select message_id, thread_id, [from_addr] to_addrs, sent_at, length(new_text) n from messages")
def row_projection(spark, d):
    return frame(spark, d, "messages").select("message_id", "thread_id", F.array("from_addr").alias("to_addrs"), "sent_at", F.length("new_text").cast("long").alias("n"))


_SIGNAL = "case event_type when 'purchase' then 'decision' when 'signup' then 'proposal' when 'view' then 'question' when 'click' then 'chatter' else 'recap' end"


@query(f"""with s as (select event_id - event_id % 3 thread_id, {_SIGNAL} signal, value from events)
select thread_id, bool_or(signal in ('proposal', 'approval', 'decision', 'reversal', 'commitment')) or bool_or(value > 90) candidate from s group by 1""")
def candidate_threads(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") - F.col("event_id") % 3).alias("thread_id"), F.expr(_SIGNAL).alias("signal"), "value")
    t = e.groupBy("thread_id").agg(F.collect_set("signal").alias("signals"), F.bool_or(F.col("value") > 90).alias("flag"))
    return t.select("thread_id", R.has_candidate(F.col("signals"), F.col("flag")).alias("candidate"))


_FORMS = """case o_orderkey % 7 when 0 then cast(cast(o_orderdate as date) as string) when 1 then replace(cast(cast(o_orderdate as date) as string), '-', '') when 2 then concat(1995 + o_orderkey % 9, '-W', lpad(cast(1 + o_custkey % 55 as string), 2, '0'), '-', o_custkey % 9)
  when 3 then concat(1995 + o_orderkey % 9, '-', lpad(cast(o_custkey % 14 as string), 2, '0'), '-', lpad(cast(o_orderkey % 33 as string), 2, '0')) when 4 then 'soon' when 5 then concat(1995 + o_orderkey % 9, 'W', lpad(cast(1 + o_custkey % 55 as string), 2, '0')) else null end"""
_WEEKS = "cast(week(make_date(try_cast(substr({x}, 1, 4) as int), 12, 28)) as int)"
_VALID = """coalesce(case when regexp_full_match(g, '\\d{4}-\\d{2}-\\d{2}') then try_cast(g as date) is not null when regexp_full_match(g, '\\d{8}') then try_cast(substr(g, 1, 4) || '-' || substr(g, 5, 2) || '-' || substr(g, 7, 2) as date) is not null
  when regexp_full_match(g, '\\d{4}-W\\d{2}-\\d|\\d{4}W\\d{2}') then try_cast(substr(replace(replace(g, '-', ''), 'W', ''), 5, 2) as int) between 1 and """ + _WEEKS.format(x="g") + """ and (length(g) < 8 or try_cast(substr(g, 10, 1) as int) between 1 and 7) else false end, false)"""


@query(f"select o_orderkey, g given, {_VALID} valid from (select o_orderkey, {_FORMS} g from orders)")
def valid_dates(spark, d):
    given = table(spark, d, "orders").select("o_orderkey", F.expr(_FORMS).alias("given"))
    return given.select("o_orderkey", "given", T.valid_date(F.col("given")).alias("valid"))


@query(f"""with g as (select o_orderkey, {_FORMS} g from orders), e as (select l_orderkey, max(l_shipdate) filter (l_returnflag in ('R', 'N')) firm, max(l_shipdate) every from lineitem where l_linestatus = 'F' group by 1)
select o_orderkey, case when {_VALID} then g else cast(cast(coalesce(firm, every) as date) as varchar) end as day from g join e on l_orderkey = o_orderkey""")
def default_dates(spark, d):
    given = table(spark, d, "orders").select("o_orderkey", F.expr(_FORMS).alias("g"))
    role = F.when(F.col("l_returnflag") == "R", "approval").when(F.col("l_returnflag") == "N", "confirmation").otherwise("recap")
    days = L.deciding_days(table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), role.alias("role"), F.to_date("l_shipdate").alias("day")), "o_orderkey")
    return given.join(days, "o_orderkey").select("o_orderkey", L.dated_by(F.col("g"), F.col("day")).alias("day"))


_CITES = "select l_orderkey k, count(*) n_cites, count(distinct l_partkey) n_messages, cast(sum(case when l_discount > 0.09 then 1 else 0 end) as bigint) n_errors, cast(sum(case when l_tax < 0.01 then 1 else 0 end) as bigint) n_closest, min(case when l_returnflag = 'R' then 0 else 1 end) = 1 all_explicit from {lineitem} group by l_orderkey"
_ANSWERS = "select o_orderkey k, case o_orderstatus when 'F' then 'found' when 'P' then 'contested' else case when o_custkey % 2 = 0 then 'no_decision' else 'partial' end end status from {orders}"


@query(f"""with a as ({_ANSWERS.format(orders='orders')}), c as ({_CITES.format(lineitem='lineitem')})
select k, case when n_errors > 0 or status = 'partial' then 'low' when status = 'no_decision' then case when n_closest > 0 or n_cites > 0 then 'medium' else 'low' end
  when all_explicit and n_cites >= 2 and n_messages >= 2 and status in ('found', 'contested') then 'high' else 'medium' end confidence from a join c using (k)""")
def answer_confidences(spark, d):
    a, c = spark.sql(_ANSWERS, orders=table(spark, d, "orders")), spark.sql(_CITES, lineitem=table(spark, d, "lineitem"))
    level = R.answer_confidence(*[F.col(x) for x in ("status", "n_errors", "n_cites", "n_messages", "n_closest", "all_explicit")])
    return a.join(c, "k").select("k", level.alias("confidence"))


@query(over("decisions", "edges") + "select src, dst, kind from edges where src <> dst and src in (select decision_id from decisions) and dst in (select decision_id from decisions)")
def sane_edges(spark, d):
    decisions, edges = frames(spark, d, "decisions", "edges")
    return R.sane_edges(edges, decisions).select("src", "dst", "kind")


_SIDED = over("conflicts", "sides", "evidence") + """, good as (select s.* from sides s join conflicts using (conflict_id) where exists (select 1 from evidence e where e.owner_kind = 'conflict_side' and e.verified and e.owner_id = s.conflict_id || ':' || s.side)),
enough as (select conflict_id from good group by 1 having count(*) >= 2)"""


def _kept_conflicts(spark, d):
    conflicts, sides, evidence = frames(spark, d, "conflicts", "sides", "evidence")
    proof = evidence.where("owner_kind = 'conflict_side'").select(F.split_part("owner_id", F.lit(":"), F.lit(1)).alias("conflict_id"), F.split_part("owner_id", F.lit(":"), F.lit(2)).alias("side"), "verified")
    return L.keep_conflicts(conflicts, sides.join(conflicts.select("conflict_id"), "conflict_id", "left_semi"), proof)


@query(_SIDED + "select conflict_id, side, claimant, topic from good join enough using (conflict_id) join conflicts using (conflict_id)")
def kept_conflicts(spark, d):
    conflicts, sides = _kept_conflicts(spark, d)
    return sides.join(conflicts, "conflict_id").select("conflict_id", "side", "claimant", "topic")


_DAYS = "select concat('CON-', l_orderkey % 50) conflict_id, cast(cast(l_shipdate as date) as string) \"day\" from {lineitem} where l_linenumber = 7"


@query(over("conflicts", "decisions") + f""", days as (select conflict_id, max("day") decided_at from ({_DAYS.format(lineitem='lineitem')}) group by 1), few as (select cluster_id from decisions where status = 'contested' and authority_flag)
select cluster_id, 'c-' || conflict_id temp_id, summary canonical_text, decided_at, 'contested' status, 0.5::double confidence from conflicts left join days using (conflict_id) where cluster_id not in (select cluster_id from few)""")
def contested_rows(spark, d):
    conflicts, decisions = frames(spark, d, "conflicts", "decisions")
    days = spark.sql(_DAYS.replace('"day"', "day"), lineitem=table(spark, d, "lineitem"))
    return L.contested_rows(decisions.where("authority_flag"), conflicts, days).select("cluster_id", "temp_id", "canonical_text", "decided_at", "status", "confidence")


_GRADED = "select l_orderkey * 10 + l_linenumber id, case l_returnflag when 'R' then 'found' when 'A' then 'contested' else 'no_decision' end expected, case when l_suppkey % 3 = 0 then 'found' when l_suppkey % 3 = 1 then 'partial' else 'no_decision' end got, l_quantity > 10 facts, l_discount < 0.08 decision, l_tax < 0.06 citations, l_linenumber < 7 no_extra from {lineitem}"
_STATUS_OK = "(expected = got or (expected = 'found' and got = 'partial' and facts))"


@query(f"select id, case when {_STATUS_OK} and facts and decision and citations and no_extra then 1.0 when {_STATUS_OK} and facts then 0.5 else 0.0 end::double score from ({_GRADED.format(lineitem='lineitem')})")
def answer_scores(spark, d):
    return X.answer_scores(spark.sql(_GRADED, lineitem=table(spark, d, "lineitem"))).select("id", "score")


@query(over("decisions", "edges") + """, n as (select * from decisions where status in ('active', 'contested') and decision_type = 'explicit')
select src, dst, kind, true edge from edges where src <> dst and src in (select decision_id from n) and dst in (select decision_id from n) union all select decision_id, null, status, false from n""")
def visible_graph(spark, d):
    nodes, edges = S.visible_graph(*frames(spark, d, "decisions", "edges"), ["active", "contested"], ["explicit"])
    return edges.select("src", "dst", "kind", F.lit(True).alias("edge")).unionByName(nodes.select(F.col("decision_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("status").alias("kind"), F.lit(False).alias("edge")))


@query("""with m as (select event_type, round(avg(value), 4) mean, max(event_id) filter (value > 1e9) never from events group by 1)
select event_type, mean >= 50 reached, mean <= 50 below, case when never is null then 'none' else 'some' end missing from m""")
def metrics_met(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.max(F.when(F.col("value") > 1e9, F.col("event_id"))).alias("never"))
    return m.select("event_type", R.meets(F.col("mean"), F.lit(50)).alias("reached"), R.meets(F.col("mean"), F.lit(50), False).alias("below"), F.when(R.meets(F.col("never"), F.lit(1)).isNull(), "none").otherwise("some").alias("missing"))


# ---------------------------------------------------------------- joins

@query(over("identities", "people") + "select i.value addr, person_id, canonical_name from identities i join people p on p.id = person_id where kind = 'email'")
def people_by_address(spark, d):
    return I.people_by_address(*frames(spark, d, "identities", "people"))


@query(over("identities", "people") + "select id, canonical_name, is_internal, string_agg(value, ', ' order by value) emails from people join identities on person_id = id and kind = 'email' group by all")
def people_values(spark, d):
    return I.people_values(*frames(spark, d, "identities", "people")).select("id", "canonical_name", "is_internal", "emails")


@query(over("identities", "people") + """select id, '- ' || canonical_name || ': ' || coalesce(role_guess, 'role unknown') || ' (' || case when is_internal then 'internal' else 'external, ' || case when org = '' then 'unknown org' else org end end || ')' line
from people where is_internal or id in (select person_id from identities where kind = 'email' and value in ('s1@x.example', 't4@y.example', 's10@x.example'))""")
def people_directory(spark, d):
    return I.people_directory(*frames(spark, d, "identities", "people"), ["s1@x.example", "t4@y.example", "s10@x.example"]).select("id", "line")


@query(over("records") + ", threads as (select distinct 'T-' || (c_custkey % 400) thread_id, 'subject ' || (c_custkey % 400) subject_norm from customer) select record_id, subject_norm, decision_date from records join threads using (thread_id)")
def records_of_threads(spark, d):
    threads = table(spark, d, "customer").selectExpr("concat('T-', c_custkey % 400) thread_id", "concat('subject ', c_custkey % 400) subject_norm").distinct()
    return L.records_of_threads(frame(spark, d, "records"), threads).select("record_id", "subject_norm", "decision_date")


@query(over("evidence", "emails") + """select count(*) quotes, case when count(*) > 0 then round(count(*) filter (coalesce(contains(new_text, quote), false) or coalesce(contains(fwd_text, quote), false)) / count(*), 3) else 1.0 end validity
from evidence left join emails using (message_id) where verified""")
def quote_validity(spark, d):
    return X.quote_validity(*frames(spark, d, "evidence", "emails"))


@query(over("decisions", "evidence") + "select decision_id, status from decisions where not exists (select 1 from evidence where owner_kind = 'decision' and owner_id = decision_id and verified)")
def unsupported_decisions(spark, d):
    decisions, evidence = frames(spark, d, "decisions", "evidence")
    return R.anti(decisions, evidence.where("owner_kind = 'decision' and verified").select(F.col("owner_id").alias("decision_id")), "decision_id").select("decision_id", "status")


@query(over("evidence") + ", wrong as (select '<' || p_partkey || '@x>' message_id from part where p_size = 1) select distinct owner_id decision_id from evidence where owner_kind = 'decision' and message_id in (select message_id from wrong)")
def near_decision_hits(spark, d):
    wrong = table(spark, d, "part").where("p_size = 1").selectExpr("concat('<', p_partkey, '@x>') message_id")
    return X.near_decision_hits(frame(spark, d, "evidence").where("owner_kind = 'decision'").select(F.col("owner_id").alias("decision_id"), "message_id"), wrong)


_SUMMED = """, e as (select owner_id decision_id, message_id, thread_id from evidence left join emails using (message_id) where owner_kind = 'decision'),
n as (select decision_id, count(*) n_quotes, count(distinct message_id) n_messages, count(distinct thread_id) > 1 cross_thread from e group by 1)"""


@query(over("decisions", "evidence", "emails") + _SUMMED + """select decision_id, coalesce(n_quotes, 0) n_quotes, coalesce(n_messages, 0) n_messages, coalesce(cross_thread, false) cross_thread,
case when decision_type = 'explicit' and coalesce(n_quotes, 0) >= 2 and coalesce(n_messages, 0) >= 2 then 'high' else 'medium' end "level", case when decision_type <> 'explicit' then 'implicit' when coalesce(n_quotes, 0) >= 2 and coalesce(n_messages, 0) >= 2 then 'explicit, several quotes' else 'single source' end reason
from decisions left join n using (decision_id)""")
def decision_summaries(spark, d):
    return S.decision_summaries(*frames(spark, d, "decisions", "evidence", "emails")).select("decision_id", "n_quotes", "n_messages", "cross_thread", "card.level", "card.reason")


@query(over("evidence", "emails") + """select id, owner_id, subject, coalesce(contains(fwd_text, quote), false) forwarded, case when coalesce(contains(fwd_text, quote), false) then 'First Author' else coalesce(from_name, from_addr) end author, thread_id
from evidence left join emails using (message_id) where verified""")
def evidence_cards(spark, d):
    evidence, emails = frames(spark, d, "evidence", "emails")
    meta = F.struct(F.lit("First Author").alias("from_name"), F.lit("first@x").alias("from_addr"), F.lit("2025-01-01").alias("date"))
    return S.evidence_cards(evidence, emails.withColumn("fwd_meta", meta)).select("id", "owner_id", "subject", "forwarded", "author", "thread_id")


_ALIASED = "select conv_id, concat('[m', 1 + turn * 2, ' ]') cited, turn from {conversations}"


@query(f"""with a as ({_ALIASED.format(conversations='conversations')}), p as (select conv_id, turn, 'm' || row_number() over (partition by conv_id order by turn) alias from conversations)
select a.conv_id, a.turn, coalesce(cast(p.turn as varchar), a.cited) found from a left join p on a.conv_id = p.conv_id and regexp_replace(a.cited, '[\\[\\]\\s]', '', 'g') = p.alias""")
def alias_join(spark, d):
    c = table(spark, d, "conversations")
    held = TH.positions(c.withColumn("parent", F.col("turn") - 1), "conv_id", ("turn",), "parent", "turn").select("conv_id", "alias", F.col("turn").cast("string").alias("found"))
    return R.alias_join(spark.sql(_ALIASED, conversations=c), held, ["conv_id"], "cited", "found").select("conv_id", "turn", "found")


@query(over("decisions", "edges") + "select distinct src, dst, kind from edges where src in (select decision_id from decisions where authority_flag) or dst in (select decision_id from decisions where authority_flag)")
def touching_edges(spark, d):
    decisions, edges = frames(spark, d, "decisions", "edges")
    return R.touching(edges, decisions.where("authority_flag").select(F.col("decision_id").alias("node")))


_TRUTH = "select distinct concat('g', o_orderkey) src, concat('g', o_orderkey - o_orderkey % 4) dst, case when o_orderkey % 4 = 2 then 'supersedes' else 'amends' end kind from {orders} where o_orderkey % 4 > 0"
_MATCH = "select concat('g', o_orderkey) truth_id, concat('DEC-', o_orderkey) decision_id from {orders} where o_custkey % 5 > 0"
_HITS = over("edges") + f""", truth as ({_TRUTH.format(orders='orders')}), m as ({_MATCH.format(orders='orders')}),
w as (select t.*, a.decision_id ps, b.decision_id pd from truth t left join m a on a.truth_id = t.src left join m b on b.truth_id = t.dst),
g as (select src, dst, list(kind) kinds from edges group by 1, 2),
hits as (select w.src, w.dst, w.kind, g.kinds is not null hit, coalesce(list_contains(g.kinds, w.kind), false) kind_ok from w left join g on g.src = ps and g.dst = pd)"""


@query(_HITS + "select * from hits")
def match_edges(spark, d):
    o = table(spark, d, "orders")
    return R.match_edges(spark.sql(_TRUTH, orders=o), frame(spark, d, "edges"), spark.sql(_MATCH, orders=o))


@query(_HITS + "select round(count(*) filter (hit) / count(*), 3) links, round(count(*) filter (kind_ok) / count(*), 3) kinds from hits")
def edge_scores(spark, d):
    o = table(spark, d, "orders")
    return X.edge_scores(spark.sql(_TRUTH, orders=o), frame(spark, d, "edges"), spark.sql(_MATCH, orders=o))


_GOLD = "select concat('g', p_size) truth_id, concat('<', p_partkey, '@x>') message_id from {part}"
_SIDE_MAIL = "select concat('CON-', l_orderkey % 50) conflict_id, l_returnflag side, concat('<', l_partkey, '@x>') message_id from {lineitem} where l_quantity > 49"


@query(f"""with gold as ({_GOLD.format(part='part')}), s as ({_SIDE_MAIL.format(lineitem='lineitem')}), met as (select truth_id, conflict_id, count(distinct side) n from s join gold using (message_id) group by all),
best as (select truth_id, max(n) n from met group by 1) select t.truth_id, coalesce(n, 0) >= 2 surfaced from (select distinct truth_id from gold) t left join best using (truth_id)""")
def conflicts_surfaced(spark, d):
    return X.conflicts_surfaced(spark.sql(_SIDE_MAIL, lineitem=table(spark, d, "lineitem")), spark.sql(_GOLD, part=table(spark, d, "part")))


@query("""with v as (select vec_id, label, embedding::double[] e, 1900 + (vec_id * 7) % 90 y, vec_id % 3 topic from embeddings),
t as (select a.vec_id a, b.vec_id b, a.y ya, b.y yb, a.topic ta, b.topic tb, list_cosine_similarity(a.e, b.e) s from (select * exclude (e), list_transform(e, lambda x, i: case when i > 1 then e[i - 1] else e[length(e)] end) e from v) a, v b),
top as (select *, row_number() over (partition by a order by s desc, b) r from t) select a, b from top where a <> b and r <= 3 and yb <= ya and s >= 0.02 and ta = tb""")
def override_hints(spark, d):
    """Each vector, turned by one place, hints at the three nearest of all."""
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    hint = F.concat(F.slice(v, F.size(v), 1), F.slice(v, 1, F.size(v) - 1))
    base = e.select(F.col("vec_id").alias("record_id"), v.alias("vec"), hint.alias("hint_vec"), (1900 + (F.col("vec_id") * 7) % 90).alias("decision_date"), F.array(F.col("vec_id") % 3).alias("entities"))
    return C.override_hints(Scratch(spark, "hints"), base.drop("vec"), base.drop("hint_vec"), least=0.02)


@query(over("messages") + """, mail as (select row_number() over (order by from_addr) id, from_addr addr, case when from_addr like 'user%' then 'Th Person' when from_addr like 'assistant%' then 'La Person' else 'Other Person' end canonical_name from (select distinct from_addr from messages)),
sent as (select id person_id, message_id, sent_at from messages join mail on addr = from_addr where new_text <> ''),
active as (select person_id from sent group by 1 having count(*) >= 3),
got as (select distinct id person_id, message_id, sent_at from (select *, replace(replace(from_addr, 'user', 'x'), 'assistant', 'user') y from messages) m join mail on addr = replace(y, 'x@', 'assistant@') where contains(lower(new_text), lower(split_part(canonical_name, ' ', 1)))),
both_ as (select 'sent' kind, * from sent union all select 'received', * from got)
select person_id, kind, message_id from both_ where person_id in (select person_id from active) qualify row_number() over (partition by person_id, kind order by sent_at, message_id) <= 8""")
def received_sample(spark, d):
    m = frame(spark, d, "messages")
    to = F.regexp_replace(F.regexp_replace(F.regexp_replace("from_addr", "user", "x"), "assistant", "user"), "x@", "assistant@")
    emails = m.withColumn("to_addrs", F.array(to)).withColumn("cc_addrs", F.array().cast("array<string>"))
    mail = R.sequential_ids(m.select("from_addr").distinct(), ["from_addr"], "%d", "id")
    name = F.when(F.col("from_addr").like("user%"), "Th Person").when(F.col("from_addr").like("assistant%"), "La Person").otherwise("Other Person")
    people = mail.select(F.col("id").cast("long").alias("id"), name.alias("canonical_name"))
    idents = mail.select(F.col("id").cast("long").alias("person_id"), F.lit("email").alias("kind"), F.col("from_addr").alias("value"))
    return I.received_sample(emails, people, idents)


_CLUSTERS = "select distinct concat('C-', o_custkey % 320) cluster_id, concat('topic ', o_custkey % 320) topic from {orders}"
_OWNED = over("decisions") + f""", clusters as ({_CLUSTERS.format(orders='orders')}),
own as (select cluster_id, count(*) n_decisions, min(decided_at) first_date, max(decided_at) last_date, list_sort(list_distinct(list(status))) statuses from decisions group by 1)"""


@query(_OWNED + "select cluster_id, topic, n_decisions, first_date, last_date, statuses, cast(row_number() over (order by list_has_any(statuses, ['superseded', 'contested', 'amended']) desc, first_date, cluster_id) as bigint) lane from clusters join own using (cluster_id)")
def lanes(spark, d):
    clusters = spark.sql(_CLUSTERS, orders=table(spark, d, "orders"))
    told = S.cluster_list(clusters, frame(spark, d, "decisions"))
    order = S.lanes(clusters, frame(spark, d, "decisions")).select("cluster_id").withColumn("at", F.monotonically_increasing_id())
    lane = R.sequential_ids(order, ["at"], "%d", "lane").select("cluster_id", F.col("lane").cast("long").alias("lane"))
    return told.join(lane, "cluster_id").select("cluster_id", "topic", "n_decisions", "first_date", "last_date", "statuses", "lane")


# ---------------------------------------------------------------- aggregates

@query(over("emails", "people") + """, t as (select thread_id, count(*) n from emails group by 1)
select count(*) emails, count(*) filter (quoted_text <> '') with_quotes, count(*) filter (fwd_text <> '') with_forwards, (select count(*) from t) threads, (select count(*) from t where n > 1) multi, (select count(*) from people) people,
(select cast(sum(is_internal::int) as bigint) from people) internal, 3 duplicates from emails""")
def ingest_stats(spark, d):
    emails, people = frames(spark, d, "emails", "people")
    return S.ingest_stats(emails, emails.groupBy("thread_id").agg(F.count("*").alias("n_msgs")), people, 3)


@query(over("calls") + "select coalesce(cast(sum(tokens_in) as bigint), 0) tokens_in, coalesce(cast(sum(tokens_out) as bigint), 0) tokens_out, round(coalesce(sum(tokens_in), 0) / 4, 4)::double cost_usd from calls where run_id = 'run-1' and stage = 'click'")
def stage_totals(spark, d):
    return R.stage_totals(frame(spark, d, "calls").withColumn("cost_usd", F.col("tokens_in") / 4.0), "run-1", "click")


_ROOTED = "select o_orderkey, o_custkey % 200 root, concat('o', o_orderkey) record_id, o_orderpriority topic_label, cast(cast(o_orderdate as date) as string) decision_date from {orders}"


@query(f"""with r as ({_ROOTED.format(orders='orders')}), ids as (select root, 'C-' || substr(sha1(array_to_string(list_sort(list(record_id)), '|')), 1, 8) cluster_id, count(*) n_records from r group by 1),
v as (select root, topic_label, count(*) n, min(struct_pack(d := decision_date, r := record_id)) f from r group by all),
t as (select root, topic_label topic from v qualify row_number() over (partition by root order by n desc, f) = 1)
select cluster_id, topic, n_records from ids join t using (root)""")
def named_clusters(spark, d):
    r = spark.sql(_ROOTED, orders=table(spark, d, "orders"))
    return C.name_clusters(r.select("record_id", "root"), r.drop("root"))[1].select("cluster_id", "topic", "n_records")


@query("""with h as (select l_orderkey, case when l_linenumber <= 3 then 'exact' when l_linenumber = 4 then 'snapped' when l_linenumber = 5 then 'reanchored' else 'dropped' end how, 'quote ' || lpad(cast(l_orderkey as varchar), 9, '0') quote from lineitem)
select count(*) quotes_total, count(*) filter (how = 'exact') quotes_exact, count(*) filter (how in ('snapped', 'reanchored')) quotes_snapped, count(*) filter (how = 'reanchored') quotes_reanchored, count(*) filter (how = 'dropped') quotes_dropped,
(select list(quote order by quote) from (select quote from h where how = 'dropped' order by quote limit 20)) examples from h""")
def quote_counters(spark, d):
    from ..operators.verify import quote_stats

    how = F.when(F.col("l_linenumber") <= 3, "exact").when(F.col("l_linenumber") == 4, "snapped").when(F.col("l_linenumber") == 5, "reanchored").otherwise("dropped")
    return quote_stats(table(spark, d, "lineitem").select(how.alias("how"), F.format_string("quote %09d", "l_orderkey").alias("quote")))


@query(over("evidence") + """, m as (select '<' || p_partkey || '@x>' message_id, case when p_size % 2 = 0 then 'dev' else 'holdout' end split from part), v as (select owner_id decision_id, split, count(*) n from evidence join m using (message_id) where owner_kind = 'decision' group by all)
select decision_id, split from v qualify row_number() over (partition by decision_id order by n desc, split) = 1""")
def majority_split(spark, d):
    manifest = table(spark, d, "part").selectExpr("concat('<', p_partkey, '@x>') message_id", "case when p_size % 2 = 0 then 'dev' else 'holdout' end split")
    return X.majority_split(frame(spark, d, "evidence").where("owner_kind = 'decision'").select(F.col("owner_id").alias("decision_id"), "message_id"), manifest)


_VERDICTS = "select c_custkey truth_id, concat('DEC-', c_custkey * 3) decision_id, case c_nationkey % 3 when 0 then 'yes' when 1 then 'partial' else 'no' end verdict from {customer} where c_acctbal > 0"


@query(over("decisions") + f""", v as ({_VERDICTS.format(customer='customer')}), r as (select case verdict when 'yes' then 1.0 when 'partial' then 0.5 else 0.0 end w from (select c_custkey truth_id from customer) left join v using (truth_id)),
p as (select case verdict when 'yes' then 1.0 when 'partial' then 0.5 else 0.0 end w from decisions left join v using (decision_id))
select 'recall' metric, round(sum(w) / greatest(1, count(*)), 3)::double score, count(*) n from r union all select 'precision', round(sum(w) / greatest(1, count(*)), 3)::double, count(*) from p""")
def recall_precision(spark, d):
    customer = table(spark, d, "customer")
    return X.recall_precision(customer.select(F.col("c_custkey").alias("truth_id")), frame(spark, d, "decisions"), spark.sql(_VERDICTS, customer=customer))


@query(over("decisions") + "select round(count(*) filter (status = case when authority_flag then 'active' else 'superseded' end) / count(*), 3) score, count(*) n from decisions")
def status_accuracy(spark, d):
    return X.status_accuracy(frame(spark, d, "decisions").withColumn("truth_status", F.when(F.col("authority_flag"), "active").otherwise("superseded")))


@query("with g as (select distinct o_custkey t from orders where o_orderpriority like '1%'), k as (select distinct o_custkey t from orders where o_orderstatus = 'F' and o_totalprice > 300000) select round(avg(case when k.t is null then 0 else 1 end), 3) recall, count(*) n from g left join k using (t)")
def triage_recall(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "thread_id")
    return X.triage_recall(o.where("o_orderpriority like '1%'"), o.where("o_orderstatus = 'F' and o_totalprice > 300000"))


_JUDGED = "select distinct owner_id decision_id, message_id from evidence where owner_kind = 'decision'"


@query(over("evidence") + f""", c as ({_JUDGED}), g as (select distinct 'DEC-' || l_orderkey decision_id, '<' || l_partkey || '@x>' message_id from lineitem where l_returnflag = 'R')
select round(count(*) filter (g.message_id is not null) / count(*), 3) "strict", round(count(*) filter (g.message_id is not null or length(c.message_id) % 2 = 0) / count(*), 3) judged from c left join g using (decision_id, message_id)""")
def evidence_support(spark, d):
    cited = frame(spark, d, "evidence").where("owner_kind = 'decision'").select(F.col("owner_id").alias("decision_id"), "message_id").distinct()
    gold = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("concat('DEC-', l_orderkey) decision_id", "concat('<', l_partkey, '@x>') message_id")
    return X.evidence_support(cited, gold, cited.withColumn("supports", F.length("message_id") % 2 == 0))


@query(over("runs") + """, s as (select stage, date_diff('second', arg_max(started_at, finished_at), max(finished_at)) as seconds from runs group by 1)
select stage, s.seconds as seconds, round((select sum(s.seconds) from s where stage <> 'view') / 60, 1) pipeline_minutes from s""")
def stage_seconds(spark, d):
    return X.stage_seconds(frame(spark, d, "runs").withColumn("stage", F.when(F.col("stage") == "view", "parse").otherwise(F.col("stage")))).withColumn("stage", F.when(F.col("stage") == "parse", "view").otherwise(F.col("stage")))


@query("""with t as (select l_orderkey thread_id, l_linestatus stance, min(case when l_returnflag = 'R' then 0 when l_returnflag = 'A' then 1 else 2 end) b from lineitem group by 1, 2)
select case b when 0 then 'decision' when 1 then 'non_decision' else 'filler' end bucket, count(*) filter (stance = 'F') "F", count(*) filter (stance = 'O') "O" from t group by 1""")
def bucket_crosstab(spark, d):
    bucket = F.when(F.col("l_returnflag") == "R", "decision").when(F.col("l_returnflag") == "A", "non_decision").otherwise("filler")
    return X.bucket_crosstab(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.col("l_linestatus").alias("stance"), bucket.alias("bucket")))


_PAIRS = "select l_orderkey, l_discount * 10 cos, l_linenumber % 2 = 0 shared, l_quantity > 25 same from {lineitem}"


@query(f"""with p as ({_PAIRS.format(lineitem='lineitem')}), g as (select unnest([0.3, 0.5, 0.7]) threshold), b as (select unnest([0.0, 0.25]) bonus),
n as (select threshold, bonus, count(*) filter (cos + case when shared then bonus else 0 end >= threshold and same) tp, count(*) filter (cos + case when shared then bonus else 0 end >= threshold) found, count(*) filter (same) t from p, g, b group by 1, 2)
select threshold::double threshold, bonus::double bonus, tp, found, t "true", round(2 * (tp / greatest(found, 1e-9)) * (tp / greatest(t, 1e-9)) / greatest(tp / greatest(found, 1e-9) + tp / greatest(t, 1e-9), 1e-9), 6) f1 from n order by f1 desc, threshold, bonus limit 4""")
def threshold_grid(spark, d):
    return C.threshold_grid(spark.sql(_PAIRS, lineitem=table(spark, d, "lineitem")), [0.3, 0.5, 0.7], [0.0, 0.25], 4)


@query("select source, lang, count(*) n from documents group by all")
def source_counters(spark, d):
    return R.histogram(table(spark, d, "documents"), "source", "lang")


# ---------------------------------------------------------------- numbering, sets

@query(_SIDED + """, con as (select conflict_id, printf('CON-%03d', row_number() over (order by cluster_id, topic, conflict_id)) con_id from conflicts where conflict_id in (select conflict_id from enough))
select con_id conflict_id, chr(cast(64 + row_number() over (partition by con_id order by side) as int)) side, claimant from good join con using (conflict_id)""")
def numbered_conflicts(spark, d):
    conflicts, sides = _kept_conflicts(spark, d)
    drafts = frame(spark, d, "decisions").withColumnRenamed("decision_id", "temp_id")
    edges = frame(spark, d, "edges").join(drafts.select(F.col("temp_id").alias("src"), "cluster_id"), "src").withColumn("scope", F.lit("")).withColumn("aspect", F.lit("")).withColumn("rationale", F.lit(""))
    return L.number_ledger(drafts, edges, conflicts, sides)[3].select("conflict_id", "side", "claimant")


_NUMBERED = over("decisions", "edges") + """, n as (select printf('DEC-%04d', row_number() over (order by decided_at, cluster_id, decision_id)) id, cluster_id, decision_id temp_id, status from decisions),
e as (select a.id src, b.id dst, kind from edges join n a on a.temp_id = src join n b on b.temp_id = dst and a.cluster_id = b.cluster_id where a.id <> b.id),
t as (select dst, bool_or(kind = 'supersedes') s, bool_or(kind = 'amends') a from e group by 1)"""


@query(_NUMBERED + "select id decision_id, cluster_id, case when status = 'contested' then status when s then 'superseded' when a and status = 'active' then 'amended' else status end status from n left join t on dst = id")
def numbered_decisions(spark, d):
    """Numbers, and statuses that follow the edges within a cluster."""
    drafts = frame(spark, d, "decisions").withColumnRenamed("decision_id", "temp_id")
    edges = frame(spark, d, "edges").join(drafts.select(F.col("temp_id").alias("src"), "cluster_id"), "src").withColumn("scope", F.lit("")).withColumn("aspect", F.lit("")).withColumn("rationale", F.lit(""))
    none = frame(spark, d, "conflicts").limit(0)
    return L.number_ledger(drafts, edges, none, frame(spark, d, "sides").limit(0))[0].select("decision_id", "cluster_id", "status")


@query("select 'T-' || conv_id thread_id, printf('R-%s-%02d', conv_id::varchar, row_number() over (partition by conv_id order by turn)) record_id, role topic from conversations")
def record_ids(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    answers = table(spark, d, "conversations").groupBy(F.concat(F.lit("T-"), "conv_id").alias("thread_id")).agg(rows.alias("records"))
    return L.record_ids(answers, "records").select("thread_id", "record_id", F.col("r").alias("topic"))


@query(over("messages") + "select message_id, list_distinct(list_filter([from_addr, 'user@x', from_name, ''], lambda x: x is not null and x <> '')) is not null ok, length(list_distinct(list_filter([from_addr, 'user@x', from_name, ''], lambda x: x <> ''))) people from messages")
def participants(spark, d):
    m = frame(spark, d, "messages").withColumn("to_addrs", F.array(F.lit("user@x"), F.col("from_name"))).withColumn("cc_addrs", F.array(F.lit("")))
    return TH.participants(m).select("message_id", F.col("people").isNotNull().alias("ok"), F.size("people").cast("long").alias("people"))


_GROUPS = "select o_custkey pos, concat('topic ', o_custkey) topic, o_orderkey % 4000 r from {orders}"


@query(f"""with g as ({_GROUPS.format(orders='orders')}), f as (select r, min(pos) p from g group by 1)
select 'R' || c.o_orderkey record_id, case when f.p is null then 's:R' || c.o_orderkey else 'g' || f.p end grp from orders c left join f on f.r = c.o_orderkey""")
def first_groups(spark, d):
    o = table(spark, d, "orders")
    g = spark.sql(_GROUPS, orders=o).groupBy("pos", "topic").agg(F.collect_list(F.concat(F.lit("R"), "r")).alias("record_ids"))
    return C.first_groups(g, o.select(F.concat(F.lit("R"), "o_orderkey").alias("record_id")))


# ---------------------------------------------------------------- text

@query("select doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss'), '[^a-z0-9_]+', ' ', 'g'))) name from documents")
def norm_names(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(matching.normalized_name(F.coalesce("text", F.lit("")))).alias("name"))


@query(over("emails") + "select message_id, lower(split_part(from_addr, '@', 2)) domain, array_to_string(list_transform(list_filter(regexp_split_to_array(split_part(from_addr, '@', 1) || '_of-' || replace(subject, ' ', '.'), '[._-]+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') name from emails")
def address_parts(spark, d):
    e = frame(spark, d, "emails")
    address = F.concat(F.split_part("from_addr", F.lit("@"), F.lit(1)), F.lit("_of-"), F.regexp_replace("subject", " ", "."), F.lit("@"), F.split_part("from_addr", F.lit("@"), F.lit(2)))
    return e.select("message_id", T.domain_of(address).alias("domain"), T.name_from_address(address).alias("name"))


_HEADER = "concat('see ', message_id, ' and ', coalesce(in_reply_to, 'none'), ' x')"


@query(over("messages") + f"select message_id, nullif(regexp_extract({_HEADER}, '<[^<>\\s]+>'), '') own, regexp_extract_all({_HEADER}, '<[^<>\\s]+>') refs, 'T-' || substr(sha1(message_id), 1, 10) thread, '<generated-' || substr(sha1(from_addr || '|' || pos || '|' || from_name || '|' || substr(new_text, 1, 200)), 1, 20) || '@local>' made from messages")
def mail_ids(spark, d):
    m = frame(spark, d, "messages").withColumn("h", F.expr(_HEADER))
    made = T.generated_message_id(F.col("from_addr"), F.col("pos").cast("string"), F.col("from_name"), F.col("new_text"))
    return m.select("message_id", T.clean_id(F.col("h")).alias("own"), T.reference_ids(F.col("h")).alias("refs"), T.thread_id(F.col("message_id")).alias("thread"), made.alias("made"))


@query(over("messages") + """select message_id, md5(trim(new_text, chr(10))) new, 'On Monday Ann Lee wrote:' || chr(10) || '> ' || from_name quoted, '' fwd from messages""")
def body_reply(spark, d):
    m = frame(spark, d, "messages")
    body = F.concat("new_text", F.lit("\n\nBest regards\nQuentin Zed\n\nOn Monday Ann Lee wrote:\n> "), "from_name")
    return m.select("message_id", mailbody.body_parts(body, F.lit("Quentin Zed"), F.lit("quentin@x.example")).alias("b")).select("message_id", F.md5("b.new").alias("new"), "b.quoted", "b.fwd")


@query(over("messages") + """select message_id, 'see below' new, md5(trim(new_text, chr(10))) fwd, from_addr, 'Sun, 3 May 2026 20:15:00 +0200' date_raw, '2026-05-03T18:15:00+00:00' "date" from messages""")
def body_forward(spark, d):
    m = frame(spark, d, "messages")
    body = F.concat(F.lit("see below\n\nBegin forwarded message:\n\nFrom: Zoe <"), "from_addr", F.lit(">\nDate: Sun, 3 May 2026 20:15:00 +0200\nSubject: paint\n\n"), "new_text")
    return m.select("message_id", mailbody.body_parts(body, F.lit("Kim Oord"), F.lit("kim@y.example")).alias("b")).select("message_id", "b.new", F.md5("b.fwd").alias("fwd"), "b.meta.from_addr", "b.meta.date_raw", "b.meta.date")


@query("select conv_id, turn, '\"' || array_to_string(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_€%]+'), lambda w: length(w) >= 40)), '\" OR \"') || '\"' is not null ok, length(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_€%]+')) words from conversations")
def word_counts(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.fts_query(F.col("text")).isNotNull().alias("ok"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([\w€%]+)"), F.lit(1))).cast("long").alias("words"))


_STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP)


@query(f"""with w as (select conv_id, turn, i, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_€%]+')[i] w from (select conv_id, turn, text, unnest(range(1, length(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_€%]+')) + 1)) i from conversations)),
f as (select conv_id, turn, w, min(i) i from w where length(w) >= 3 and w not in ({_STOP}) group by all),
q as (select conv_id, turn, string_agg('"' || w || '"', ' OR ' order by i) q from f group by all)
select c.conv_id, c.turn, md5(coalesce(q, '')) digest from conversations c left join q using (conv_id, turn)""")
def fts_queries(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.fts_query(F.col("text"))).alias("digest"))


_CITED = "concat('First ', role, ' [^', turn, ']. Then [^', conv_id, '][^2] ', 'more')"


@query(f"select conv_id, turn, regexp_split_to_array({_CITED}, '\\[\\^\\d+\\]') texts, list_transform(regexp_extract_all({_CITED}, '\\[\\^(\\d+)\\]', 1), lambda x: x::int) numbers from conversations")
def citation_parts(spark, d):
    parts = T.cited_parts(F.expr(_CITED))
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(parts, lambda p: p["text"]).alias("texts"), F.filter(F.transform(parts, lambda p: p["n"]), lambda n: n.isNotNull()).alias("numbers"))


@query("""with h as (select conv_id, turn, text, 'THE ' quote, instr(lower(text), 'the ') p from conversations)
select conv_id, turn, md5(case when p > 0 then left(text, p - 1) else text end) before, case when p > 0 then substr(text, p, 4) end hit, md5(case when p > 0 then substr(text, p + 4) end) "after" from h""")
def highlights(spark, d):
    h = T.highlighted(F.col("text"), F.lit("THE "))
    return table(spark, d, "conversations").select("conv_id", "turn", h.alias("h")).select("conv_id", "turn", F.md5("h.before").alias("before"), "h.hit", F.md5("h.after").alias("after"))


@query("select conv_id, turn, md5(trim(text)) fence, trim(substr(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), 1, 40), '-') slug from conversations")
def fences_and_slugs(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_fence(fenced)).alias("fence"), T.slug(F.col("text")).alias("slug"))


@query(over("emails") + """select message_id, sent_at - interval 2 hours utc, strftime(sent_at, '%Y-%m-%d %H:%M') shown, sent_at + interval 330 minutes here, sent_at plain from emails""")
def mail_times(spark, d):
    e = frame(spark, d, "emails")
    header = F.concat(F.lit("Mon, "), F.date_format("sent_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    local = lambda offset: T.local_time(F.col("sent_at"), F.lit(offset)).cast("timestamp")
    return e.select("message_id", T.rfc2822_time(header).alias("utc"), F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("shown"), local("+0530").alias("here"), local("CET").alias("plain"))


@query("with n as (select vec_id, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings) select vec_id, list_transform(e, lambda x: round(x / n, 6)) unit from n")
def unit_vectors(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    unit = F.when(F.exists(v, lambda x: x != 0), V.l2_normalized(v)).otherwise(F.transform(v, lambda x: F.lit(float("nan"))))  # a length of 0 gives 0 / 0
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda x: R.rounded_binary(x, 6)).alias("unit"))


@query(over("calls") + "select event_id, round(((tokens_in - tokens_in % 7) * 3.0 + (tokens_in % 7) * 3.0 * 0.1 + tokens_out * 15.0) / 1e6, 9)::double cost from calls")
def call_costs(spark, d):
    c = frame(spark, d, "calls")
    return c.select("event_id", F.round(R.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("tokens_in") % 7, F.lit(3.0), F.lit(15.0)), 9).alias("cost"))


@query("select event_id, case when event_id % 4 = 0 then -1 else coalesce(cast(json_extract(props, '$.k') as int), -1) end k from events")
def json_defaults(spark, d):
    e = table(spark, d, "events").withColumn("p", F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("props")))
    return e.select("event_id", F.coalesce(T.json_or(F.col("p"), "k int", F.struct(F.lit(-1).alias("k")))["k"], F.lit(-1)).alias("k"))


@query("select doc_id, i - 1 pos, w from (select doc_id, unnest(range(1, length(regexp_split_to_array(lang || ';' || source, ';')) + 1)) i, regexp_split_to_array(lang || ';' || source, ';') a from documents) t, lateral (select a[i] w)")
def exploded_lists(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.concat_ws(";", "lang", "source"), ";")).alias("pos", "w")).withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- retrieval

_FIELD_SQL = over("decisions") + """, tok as (select decision_id, regexp_extract_all(lower(canonical_text), '[\\p{L}\\p{N}]+') a, regexp_extract_all(lower(coalesce(rationale, '')), '[\\p{L}\\p{N}]+') b from decisions),
st as (select count(*) n, avg(length(a) + length(b)) avgdl from tok),
tf as (select decision_id, length(a) + length(b) dl, term, 2.0 * length(list_filter(a, lambda w: w = term)) + length(list_filter(b, lambda w: w = term)) tf from tok, (select unnest(['urgent', 'clerk', '7', '16']) term)),
f as (select * from tf where tf > 0), df as (select term, count(*) df from f group by 1)
select decision_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score from f join df using (term), st group by 1 order by score desc, decision_id limit 30"""


@query(_FIELD_SQL)
def bm25_two_columns(spark, d):
    return V.bm25_fields(frame(spark, d, "decisions"), "decision_id", ["canonical_text", "rationale"], ["urgent", "clerk", "7", "16"], 30, {"canonical_text": 2.0})


@query(_FIELD_SQL)
def written_index(spark, d):
    """The same from an index that is written first."""
    root = Scratch(spark, "index").root
    V.build_index(frame(spark, d, "decisions"), "decision_id", ["canonical_text", "rationale"], root, "decisions")
    return V.search(spark, root, "decisions", "decision_id", ["urgent", "clerk", "7", "16"], 30, {"canonical_text": 2.0})


@query("select count(*) n_docs, round(avg(length(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))), 6) avgdl, cast(sum(length(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))) as bigint) postings from documents")
def index_sizes(spark, d):
    posts, stats = V.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).join(posts.agg(F.count("*").alias("postings")))


@query("with t as (select 'hash:' || text k from documents where text is not null) select count(*) texts, count(distinct k) keys from t")
def embedding_cache(spark, d):
    """Texts of the cache, here those of one language, aren't embedded again; all come back with a vector."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text")
    scratch = Scratch(spark, "cache")
    _, first = V.embed(docs.where("lang = 'en'").select("doc_id", "text"), spark.createDataFrame([], "key string, vec array<float>"))
    rows, fresh = V.embed(docs, scratch.write(first))
    keys = scratch.write(rows.select("key").unionByName(fresh.select("key").limit(0)))
    return keys.agg(F.count("*").alias("texts"), F.count_distinct("key").alias("keys"))


@query()
def index_stamps(spark, d):
    return V.index_stamp((table(spark, d, "documents"), "text"), (table(spark, d, "benchmark"), "text")).withColumn("checksum", F.col("checksum").cast("string"))


@query(over("messages") + """, c as (select 'a' || conv_id answer_id, cast(turn + 1 as int) n, message_id, case when turn % 3 = 1 then 'never said' else substr(new_text, 1, 11) end quote, new_text from messages where length(trim(substr(new_text, 1, 11), ' .,;:!?"''-')) >= 3),
e as (select answer_id, 'citation [^' || n || '] quote is not verbatim in ' || message_id error from c where quote = 'never said' union all select distinct answer_id, 'marker [^99] has no citation' from c union all select distinct answer_id, 'unknown decision id DEC-0' from c)
select answer_id, list(error order by error) errors from e group by 1""")
def checked_answers(spark, d):
    m = frame(spark, d, "messages").where(F.length(F.regexp_replace(F.substring("new_text", 1, 11), r"^[ .,;:!?\"'-]+|[ .,;:!?\"'-]+$", "")) >= 3)
    quote = F.when(F.col("turn") % 3 == 1, "never said").otherwise(F.substring("new_text", 1, 11))
    cite = F.struct((F.col("turn") + 1).cast("int").alias("n"), "message_id", quote.alias("quote"))
    answers = m.groupBy(F.concat(F.lit("a"), "conv_id").alias("answer_id")).agg(F.collect_list(cite).alias("citations")).withColumn("answer_md", F.lit("So it is [^99].")).withColumn("decision_ids", F.array(F.lit("DEC-0"), F.lit("DEC-1")))
    return V.check_answer(answers, m.select("message_id", "new_text", "fwd_text"), spark.createDataFrame([("DEC-1",)], "decision_id string")).select("answer_id", "errors")


_SAID = "trim(split_part({x}, '. ', 1), ' .,')"


@query(over("messages") + f"""select 'R-' || conv_id || '-' || case turn when 0 then '01' else '03' end record_id, 'topic ' || turn topic_label, case turn when 0 then strftime(sent_at, '%Y-%m-%d') else '2026-01-05' end decision_date, {_SAID.format(x='new_text')} quote, message_id
from messages where turn in (0, 1) and length({_SAID.format(x='new_text')}) >= 3""")
def extracted_records(spark, d):
    """Answers of three records for each conversation: one dated by its quote, one whose quote was never said, one that cites the second
    turn and keeps its date. Turns are cited by the aliases they have: in a long conversation turns without a time come before them."""
    m = TH.positions(frame(spark, d, "messages")).withColumn("sent_tz", F.lit("+0000"))
    said = F.btrim(F.split_part("new_text", F.lit(". "), F.lit(1)), F.lit(" .,"))
    first = m.groupBy("thread_id").agg(F.max(F.when(F.col("turn") == 0, said)).alias("q0"), F.max(F.when(F.col("turn") == 1, said)).alias("q1"), F.max(F.when(F.col("turn") == 0, F.col("alias"))).alias("m0"), F.max(F.when(F.col("turn") == 1, F.col("alias"))).alias("m1"))
    rec = "named_struct('topic_label', '{}', 'decision_text', 'x', 'stance', 'final', 'decision_type', 'explicit', 'decided_by', array('a'), 'decision_date', '{}', 'rationale', '', 'alternatives', array(''), 'conditions', '', 'overrides_hint', '', 'authority_note', '', 'confidence', 0.5D, 'evidence', array({}))"
    cite = "named_struct('message_id', {}, 'quote', {}, 'role', 'confirmation')"
    three = [rec.format("topic 0", "2026-02-30", cite.format("m0", "upper(q0)")), rec.format("never", "2026-01-05", cite.format("m0", "'words that nobody ever said here'")), rec.format("topic 1", "2026-01-05", cite.format("m1", "q1"))]
    answers = first.select("thread_id", F.expr(f"named_struct('records', array({', '.join(three)}))").alias("answer"))
    recs, evidence = L.records(answers, m)
    return recs.join(evidence.selectExpr("owner_id record_id", "message_id", "quote"), "record_id").select("record_id", "topic_label", "decision_date", "quote", "message_id")


# ---------------------------------------------------------------- mail, sources and sinks

_MAILED = "concat('body ', conv_id, ' ', turn, ' of ', role)"


def _rendered(spark, d):
    m = frame(spark, d, "messages")
    refs = F.when(F.col("in_reply_to").isNull(), F.array().cast("array<string>")).otherwise(F.array("in_reply_to"))
    return mailbox.render(m.withColumn("refs", refs).withColumn("to_addrs", F.array(F.lit("all@x.example"))).withColumn("cc_addrs", F.array().cast("array<string>")).withColumn("subject", F.concat(F.lit("Über topic "), "conv_id")).withColumn("body", F.expr(_MAILED)))


@query(over("messages") + f"""select message_id, printf('%04d_', row_number() over (order by sent_at, message_id)) || 'ber-topic-' || conv_id || '.eml' file, md5(concat_ws(chr(10), 'From: ' || from_name || ' <' || from_addr || '>', 'To: all@x.example', 'Subject: Über topic ' || conv_id, 'Date: ' || strftime(sent_at, '%a, %d %b %Y %H:%M:%S') || ' +0000', 'Message-ID: ' || message_id,
  'In-Reply-To: ' || in_reply_to, 'References: ' || in_reply_to, 'MIME-Version: 1.0', 'Content-Type: text/plain; charset="UTF-8"', 'Content-Transfer-Encoding: 8bit') || chr(10) || chr(10) || {_MAILED} || chr(10)) digest from messages""")
def rendered_mail(spark, d):
    return _rendered(spark, d).select("message_id", "file", F.md5("eml").alias("digest"))


@query(over("messages") + f"select message_id, in_reply_to, from_addr, from_name, ['all@x.example'] to_addrs, sent_at, '+0000' sent_tz, 'Über topic ' || conv_id subject, {_MAILED} new_text from messages")
def parsed_mail(spark, d):
    """Mails made of the conversations and read again: every second one as a file, the others zipped and in a mailbox."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for pdf in batches:
            one, rest = pdf.iloc[::2], pdf.iloc[1::2]
            files = [(f"a/{f}", e.encode()) for f, e in zip(one["file"], one["eml"])]
            zipped, box = rest.iloc[::2], rest.iloc[1::2]
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for f, e in zip(zipped["file"], zipped["eml"]):
                    z.writestr(f, e)
            files.append(("b.zip", held.getvalue()))
            files.append(("c.mbox", b"\n".join(b"From x Mon Jan  5 10:00:00 2026\n" + e.encode() for e in box["eml"])))
            yield pd.DataFrame(files, columns=["path", "content"])

    files = _rendered(spark, d).select("file", "eml").mapInPandas(pack, "path string, content binary")
    return mailbox.messages_of(files).select("message_id", "in_reply_to", "from_addr", "from_name", "to_addrs", "sent_at", "sent_tz", "subject", "new_text")


_FOLDER_KIND = "(conv_id + turn) % 4"
_OLD = "concat(chr(10), chr(10), 'From: Eva <e@x.example>', chr(10), 'Sent: Monday', chr(10), 'To: Ana <a@x.example>', chr(10), 'Subject: before', chr(10), chr(10), 'it was said ', turn, ' times')"


@query(over("messages") + f"""select message_id, from_addr, sent_at, 'Topic ' || conv_id subject, rtrim(text, chr(10)) || case {_FOLDER_KIND} when 3 then {_OLD} else '' end body,
  case {_FOLDER_KIND} when 3 then trim({_OLD}, chr(10)) else '' end quoted_text, case {_FOLDER_KIND} when 2 then ['f' || turn || '.bin'] else [] end attachment_names
from messages join (select conv_id c2, turn t2, text from conversations) on c2 = conv_id and t2 = turn""")
def mail_folder(spark, d):
    """Whole turns as plain, HTML, multipart and forwarded mail, written as mailboxes to the shared folder and read again in byte
    ranges."""
    m = frame(spark, d, "messages").join(table(spark, d, "conversations").selectExpr("conv_id c2", "turn t2", "text"), F.expr("c2 = conv_id and t2 = turn"))
    coded = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    kind = lambda subtype: F.lit(f'Content-Type: text/{subtype}; charset="UTF-8"\nContent-Transfer-Encoding: 8bit\n\n')
    plain, html = F.concat(kind("plain"), "text"), F.concat(kind("html"), F.lit("<html><head><title>no</title></head><body><div>"), coded, F.lit("</div></body></html>"))
    part = F.concat(F.lit('\n--cut\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="f'), F.col("turn").cast("string"), F.lit('.bin"\nContent-Transfer-Encoding: base64\n\nAAAA\n--cut--\n'))
    mixed = F.concat(F.lit('Content-Type: multipart/mixed; boundary="cut"\n\n--cut\nContent-Type: multipart/alternative; boundary="alt"\n\n--alt\n'), html, F.lit("\n--alt\n"), plain, F.lit("\n--alt--\n"), part)
    body = F.when(F.expr(f"{_FOLDER_KIND} = 0"), plain).when(F.expr(f"{_FOLDER_KIND} = 1"), html).when(F.expr(f"{_FOLDER_KIND} = 2"), mixed).otherwise(F.concat(plain, F.expr(_OLD.replace("chr(", "char("))))
    head = F.concat(F.lit("From a@x.example Mon Jan  5 10:00:00 2026\nFrom: Ana Lo <"), "from_addr", F.lit(">\nSubject: Topic "), F.col("conv_id").cast("string"), F.lit("\nDate: "), F.date_format("sent_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000\nMessage-ID: "), "message_id", F.lit("\nMIME-Version: 1.0\n"))
    scratch = Scratch(spark, "folder")
    m.select(F.concat(head, body, F.lit("\n")).alias("value")).write.text(f"{scratch.root}/box")
    mails = mailbox.scan(spark, f"{scratch.root}/box", kind="mbox", split=1 << 20)
    return mails.select("message_id", "from_addr", "sent_at", "subject", F.rtrim(F.col("body_raw"), F.lit("\n")).alias("body"), "quoted_text", "attachment_names")


@query("select o_orderkey, (row_number() over (order by o_orderdate, o_orderkey) - 1) % 6 chunk, (row_number() over (order by o_orderdate, o_orderkey) - 1) // 6 place from orders")
def strided_chunks(spark, d):
    return mailbox.strided(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "chunk", "place")


@query("""with c as (select conv_id, turn, case when turn = 0 then null when role = 'user' then 0 when role = 'assistant' and turn % 3 = 0 then 1 end rank, count(*) over (partition by conv_id) n from conversations),
g as (select *, rank is not null and row_number() over (partition by conv_id order by rank nulls last, turn) <= n - 3 gone from c)
select conv_id, turn, coalesce((select max(p.turn) from g p where p.conv_id = g.conv_id and p.turn < g.turn and not p.gone), -1) parent from g where not gone""")
def trimmed_threads(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn"), F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "late").otherwise(F.col("role")).alias("role"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return mailbox.trim(c, 3, {"user": 0, "late": 1}, "conv_id", "turn").select("conv_id", "turn", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


@query(over("edges") + "select src, dst, kind, '' scope, '' aspect, '' rationale from edges")
def table_round_trip(spark, d):
    """Replaced, appended to, copied to a snapshot and read from there."""
    root, copy = (Scratch(spark, n).root for n in ("tables", "snapshot"))
    rows = frame(spark, d, "edges").selectExpr("src", "dst", "kind", "'' scope", "'' aspect", "'' rationale")
    tables.replace(rows.limit(3), root, "decision_edges")
    tables.replace(rows.where("kind = 'amends'"), root, "decision_edges")
    tables.append(rows.where("kind <> 'amends'"), root, "decision_edges")
    tables.snapshot(spark, root, copy)
    return tables.read(spark, copy, "decision_edges")


@query("select 'message ' || p_partkey message_id, [ 'd' || p_size, p_brand ] decision_ids, p_type bucket from part")
def manifest_round_trip(spark, d):
    root = Scratch(spark, "csv").root
    p = table(spark, d, "part").selectExpr("concat('message ', p_partkey) message_id", "'f' file", "'dev' split", "p_type bucket", "concat('d', p_size, ';', p_brand) decision_ids", "'r' role", "'' traps")
    p.write.csv(f"{root}/m", header=True)
    return tables.manifest(spark, f"{root}/m").select("message_id", "decision_ids", "bucket")


@query("select r_regionkey id, r_name name, [n_name] nations from region join nation on n_regionkey = r_regionkey")
def json_round_trip(spark, d):
    root = Scratch(spark, "json").root
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array("n_name").alias("nations"))
    rows.write.json(f"{root}/t")
    return spark.read.schema("id int, name string, nations array<string>").json(f"{root}/t")


@query("""with k as (select conv_id, sha256('{"stage":"triage","thread":' || conv_id || '}') key from (select distinct conv_id from conversations)) select conv_id, key, conv_id % 4 > 0 found, case when conv_id % 4 = 0 then 'none' when conv_id % 4 = 1 then 'true' else 'false' end flag from k""")
def cached_answers(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("request", F.concat(F.lit('{"thread": '), "conv_id", F.lit(', "stage": "triage"}')))
    reply = F.concat(F.lit('```json\n{"has_candidate": '), (F.col("conv_id") % 4 == 1).cast("string"), F.lit(', "messages": []}\n```'))
    cache = c.where("conv_id % 4 > 0").select(tables.request_keys("request").alias("key"), reply.alias("response"))
    got, missing = tables.answers(c, cache, "triage")
    return got.select("conv_id", "key", F.lit(True).alias("found"), F.col("answer.has_candidate").cast("string").alias("flag")).unionByName(missing.select("conv_id", "key", F.lit(False).alias("found"), F.lit("none").alias("flag")))


@query(over("calls") + """select run_id, stage, cached, sum(case when cached then 0 else tokens_in end)::bigint tokens_in, count(*) n from (select 'run-9' run_id, 'extract' stage, event_id % 3 = 0 cached, tokens_in from calls) group by all""")
def call_log(spark, d):
    c = frame(spark, d, "calls").withColumn("key", F.concat(F.lit("k"), "event_id")).withColumn("cost_usd", F.lit(0.1))
    return tables.call_rows(c.select("key", "tokens_in", "tokens_out", "cost_usd"), c.where("cached").select("key"), "run-9", "extract", "m").groupBy("run_id", "stage", "cached").agg(F.sum("tokens_in").alias("tokens_in"), F.count("*").alias("n"))


@query("""select conv_id question_id, case when conv_id % 5 > 1 then 'why' end "type", case when conv_id % 5 = 2 then '2026-01-05' end as_of_date from (select distinct conv_id from conversations)""")
def classified_questions(spark, d):
    q = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id")).distinct().withColumn("request", F.concat(F.lit('{"q": '), "question_id", F.lit("}")))
    reply = F.when(F.col("question_id") % 5 == 1, "not json").when(F.col("question_id") % 5 == 2, '{"type": "why", "entities": [], "as_of_date": "2026-01-05"}').otherwise('{"type": "why", "entities": ["x"], "as_of_date": null}')
    cache = q.where("question_id % 5 > 0").select(tables.request_keys("request").alias("key"), reply.alias("response"))
    return tables.classified(q, cache)


_TRIAGED = "select concat('T-', conv_id) thread_id, concat('m', turn + 1) m_id, case when turn % 5 = 2 then 'approval' else 'chatter' end signal, turn from {conversations}"


@query("""with f as (select conv_id, bool_or(turn % 5 = 2) c from conversations where conv_id % 6 > 0 group by 1) select 'T-' || t.conv_id thread_id, coalesce(c, true) has_candidate from (select distinct conv_id from conversations) t left join f using (conv_id)""")
def triaged_threads(spark, d):
    c = table(spark, d, "conversations")
    told = spark.sql(_TRIAGED, conversations=c.where("conv_id % 6 > 0")).groupBy("thread_id").agg(F.collect_list(F.struct(F.col("m_id").alias("message_id"), "signal", F.lit("").alias("note"))).alias("messages"))
    answers = told.select("thread_id", F.struct(F.lit(False).alias("has_candidate"), "messages").alias("answer"))
    m = frame(spark, d, "messages")
    held = TH.positions(m).select("thread_id", "alias", "message_id")
    return L.triage(m.select("thread_id").distinct(), answers, held)[1]


# ---------------------------------------------------------------- progress and serving

@query("select 'run-' || user_id run_id, event_type stage, max(event_id) seq, arg_max(props, event_id) payload from events group by all")
def run_progress(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), F.lit("progress").alias("kind"), F.col("event_type").alias("stage"), F.col("props").alias("payload"))
    return ingest.progress(e).select("run_id", "stage", "seq", "payload")


@query("with e as (select event_id seq, case when event_type = 'error' then 'error' else 'progress' end kind from events where user_id = 5), t as (select min(seq) l from e where kind = 'error' and seq > 3) select seq, kind from e, t where seq > 3 and (l is null or seq <= l)")
def run_replay(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").otherwise("progress").alias("kind"), F.col("event_type").alias("stage"), F.col("props").alias("payload"))
    return ingest.replay(e, "run-5", 3).select("seq", "kind")


@query("select time_bucket(interval 5 seconds, ts) start, count(*) n, cast(sum(count(*)) over (order by time_bucket(interval 5 seconds, ts)) as bigint) so_far from events group by 1")
def polled_counters(spark, d):
    return ingest.polled(table(spark, d, "events"), "ts")


@query("select time_bucket(interval 1 day, ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def daily_counts(spark, d):
    return ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("select true ok, false demo_mode, 'none' provider, 'none' fast")
def health(spark, d):
    return S.health(spark, models={"FAST": "none"}).select("ok", "demo_mode", "provider", F.col("models")["FAST"].alias("fast"))


@query(over("emails", "people", "records", "decisions", "conflicts", "evidence") + """, f as (select user_id t, bool_or(event_type = 'purchase' and value > 97) c from events group by 1)
select (select count(*) from emails) emails, (select count(*) from f) threads, (select count(*) from people) people, (select count(*) from f where c) candidate_threads, (select count(*) from records) records, (select count(*) from decisions) decisions,
(select count(*) from decisions where authority_flag) authority_flags, (select count(*) from decisions where decision_type = 'implicit') implicit, (select count(*) from conflicts) conflicts,
(select round(count(*) filter (verified) / count(*), 3) from evidence where owner_kind = 'decision') evidence_verified_ratio, round(100 * (1 - (select count(*) from f where c) / (select count(*) from f)), 1) filtered_pct""")
def ledger_stats(spark, d):
    emails, people, records, decisions, conflicts, evidence = frames(spark, d, "emails", "people", "records", "decisions", "conflicts", "evidence")
    flags = table(spark, d, "events").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 97)).alias("has_candidate"))
    return S.stats(emails, flags, people, flags, records, decisions, conflicts, evidence)


@query(over("runs") + "select cast(sum(k) as bigint) k, cast(0 as bigint) missing from (select arg_max(cast(json_extract(notes, '$.k') as bigint), finished_at) k from runs where stage in ('click', 'view') group by stage)")
def stage_notes(spark, d):
    return S.stage_notes(frame(spark, d, "runs"), ("k", "missing"), ("click", "view"))


@query(over("decisions") + "select decision_id, status, decided_at from decisions where status in ('active', 'contested') and decision_type = 'explicit' and decided_at >= '1995-02-01' and decided_at <= '1999-12-31' and (canonical_text ilike '%LOW%' or rationale ilike '%LOW%')")
def listed_decisions(spark, d):
    return S.list_decisions(frame(spark, d, "decisions"), "active,contested", None, "LOW", "1995-02-01", "1999-12-31", "explicit").select("decision_id", "status", "decided_at")


@query((over("decisions", "edges") + ", g as (select src x, dst y from edges union all select dst, src from edges), r(node) as (select 'DEC-5' union select y from r join g on x = node) select decision_id, status from decisions where decision_id in (select node from r)").replace("with decisions", "with recursive decisions", 1))
def decision_chain(spark, d):
    decisions, edges, evidence, emails = frames(spark, d, "decisions", "edges", "evidence", "emails")
    page = S.decision_page(Scratch(spark, "page"), "DEC-5", decisions, edges, evidence, emails.withColumn("fwd_meta", F.lit(None).cast("struct<from_name:string,from_addr:string,date:string>")))
    return page["chain"].select("decision_id", "status")


@query(over("decisions", "evidence", "emails") + _SUMMED + "select decision_id, decided_at, coalesce(n_quotes, 0) n_quotes from decisions left join n using (decision_id) where cluster_id = 'C-7'")
def cluster_page(spark, d):
    decisions, edges, evidence, emails = frames(spark, d, "decisions", "edges", "evidence", "emails")
    clusters = spark.sql(_CLUSTERS, orders=table(spark, d, "orders"))
    return S.cluster_page("C-7", clusters, decisions, edges, evidence, emails)["decisions"].select("decision_id", "decided_at", "n_quotes")


@query(over("conflicts", "sides", "decisions") + ", f as (select cluster_id, min(decision_id) decision_id from decisions where status = 'contested' group by 1) select conflict_id, topic, decision_id, (select count(*) from sides s where s.conflict_id = c.conflict_id) n_sides from conflicts c left join f using (cluster_id)")
def conflict_page(spark, d):
    conflicts, sides, decisions, evidence = frames(spark, d, "conflicts", "sides", "decisions", "evidence")
    out = S.conflict_list(conflicts, sides, evidence, decisions)
    return out.select("conflict_id", "topic", "decision_id", F.coalesce(F.when(F.col("sides").isNotNull(), F.size("sides")), F.lit(0)).cast("long").alias("n_sides"))


@query(over("messages") + "select message_id, pos from messages where thread_id = (select thread_id from messages where message_id = '<3.0@x>')")
def email_page(spark, d):
    return S.email_page(frame(spark, d, "messages"), "3.0@x")[1].select("message_id", "pos")


@query("select max(o_orderkey) + 1 id, 'DEC-1' decision_id, 'dispute' kind, repeat('n', 2000) note from orders union all select o_orderkey, 'DEC-' || o_orderkey, 'dispute', 'x' from orders where o_orderkey <= 20 or o_orderkey = (select max(o_orderkey) from orders)")
def dispute(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_orderkey").alias("m"))
    held = o.join(F.broadcast(top)).where("o_orderkey <= 20 or o_orderkey = m").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("DEC-"), "o_orderkey").alias("decision_id"), F.lit("dispute").alias("kind"), F.lit("x").alias("note"))
    return S.dispute(held, "DEC-1", "n" * 3000)


@query("select 'f' || page_id || case page_id % 4 when 0 then '.EML' when 1 then '.zip' when 2 then '.txt' else '' end name, page_id % 4 < 2 accepted, 200 code from pages")
def accepted_uploads(spark, d):
    ending = F.element_at(F.array(F.lit(".EML"), F.lit(".zip"), F.lit(".txt"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return S.accepted_uploads(table(spark, d, "pages").select(F.concat(F.lit("f"), "page_id", ending).alias("name")))


@query(over("messages") + "select thread_id, md5(string_agg('[m' || (pos + 1 - (select min(b.pos) from messages b where b.thread_id = messages.thread_id)) || '] ' || from_name || ' ' || strftime(sent_at, '%Y-%m-%d %H:%M') || chr(10) || new_text || case when fwd_text <> '' then chr(10) || '[forwarded] ' || fwd_text else '' end, chr(10) || chr(10) order by pos)) digest from messages group by thread_id")
def rendered_threads(spark, d):
    m = frame(spark, d, "messages").withColumn("quoted_text", F.lit(""))
    return TH.render(m).select("thread_id", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- people, questions and reconciled answers

_NAMED = """select c_custkey, concat('c', c_custkey, '@', case when c_custkey % 5 < 3 then 'in' else concat('d', c_nationkey) end, '.example') addr,
  concat(substr(md5(cast(c_custkey % 60 as string)), 1, 9), ' ', substr(md5(cast(c_custkey % 60 as string)), 10, 9)) "name" from {customer}"""


@query(f"""with p as ({_NAMED.format(customer='customer')}) select "name" canonical_name, count(*) addresses, bool_or(addr like '%@in.example') is_internal from p group by 1""")
def resolved_people(spark, d):
    """Addresses of a name are one person, within a domain and across."""
    p = spark.sql(_NAMED.replace('"name"', "name"), customer=table(spark, d, "customer"))
    emails = p.select(F.col("addr").alias("from_addr"), F.col("name").alias("from_name"), F.array().cast("array<struct<name:string,addr:string>>").alias("to_named"))
    people, idents = I.resolve(Scratch(spark, "people"), emails)
    n = idents.where("kind = 'email'").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("addresses"))
    return people.join(n, "id").select("canonical_name", "addresses", "is_internal")


@query(f"""with p as ({_NAMED.format(customer='customer')}) select a.addr a, b.addr b, true same_name from p a join p b on a."name" = b."name" and a.addr < b.addr and split_part(a.addr, '@', 2) <> split_part(b.addr, '@', 2)""")
def similar_people(spark, d):
    p = spark.sql(_NAMED.replace('"name"', "name"), customer=table(spark, d, "customer"))
    return I.similar_pairs(p, "addr", "name")


_MISTYPED = """select c_custkey, concat('c', c_custkey, '@d', c_nationkey, '.example') addr, c_custkey % 60 base, c_custkey % 4 = 1 wrong,
  concat(case when c_custkey % 4 = 1 then concat(substr(md5(cast(c_custkey % 60 as string)), 1, 4), 'z', substr(md5(cast(c_custkey % 60 as string)), 6, 4)) else substr(md5(cast(c_custkey % 60 as string)), 1, 9) end, ' ', substr(md5(cast(c_custkey % 60 as string)), 10, 9)) "name" from {customer}"""


@query(f"""with p as ({_MISTYPED.format(customer='customer')}) select a.addr a, b.addr b, a.wrong = b.wrong same_name from p a join p b on a.base = b.base and a.addr < b.addr and split_part(a.addr, '@', 2) <> split_part(b.addr, '@', 2)""")
def alike_people(spark, d):
    """Every fourth customer's name has a letter wrong; the pairs are those of equal and of mistyped names."""
    p = spark.sql(_MISTYPED.replace('"name"', "name"), customer=table(spark, d, "customer"))
    return I.similar_pairs(p, "addr", "name")


@query(f"""with p as ({_MISTYPED.format(customer='customer')}), top as (select split_part(addr, '@', 2) domain from p group by 1 order by count(*) desc, 1 limit 1)
select base % 60 base, count(*) addresses, bool_or(split_part(addr, '@', 2) = (select domain from top)) is_internal from p group by 1""")
def judged_people(spark, d):
    """The same people, after all pairs of alike names of different domains were judged to be one person."""
    p = spark.sql(_MISTYPED.replace('"name"', "name"), customer=table(spark, d, "customer"))
    emails = p.select(F.col("addr").alias("from_addr"), F.col("name").alias("from_name"), F.array().cast("array<struct<name:string,addr:string>>").alias("to_named"))
    scratch = Scratch(spark, "people")
    local = I.local_people(scratch, emails).select("person", "canonical").distinct()
    verdicts = I.similar_pairs(local).select("a", "b", F.lit(True).alias("same_person"))
    people, idents = I.resolve(scratch, emails, verdicts)
    of = idents.where("kind = 'email'").join(p.select(F.col("addr").alias("value"), "base"), "value").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("addresses"), F.min("base").alias("base"))
    return people.join(of, "id").select("base", "addresses", "is_internal")


@query(over("people") + """, m as (select id, canonical_name, 'Head of ' || (id % 7) role, 'Org ' || (id % 4) org from people) select id, role role_guess, org from m""")
def signed_roles(spark, d):
    people = frame(spark, d, "people").select("id", "canonical_name", F.lit(None).cast("string").alias("role_guess"), F.lit("x").alias("org"), "is_internal")
    idents = frame(spark, d, "identities").where("value like 's%@x.example'")
    often = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    mails = people.withColumn("k", often).select(
        F.concat(F.lit("s"), "id", F.lit("@x.example")).alias("from_addr"), F.concat(F.lit("<"), "id", F.lit("."), "k", F.lit(">")).alias("message_id"), F.timestamp_seconds(F.col("k")).alias("sent_at"),
        F.concat(F.lit("hello\n\n"), "canonical_name", F.lit("\nHead of "), F.when(F.col("k") == 1, F.lit("nothing")).otherwise((F.col("id") % 7).cast("string")), F.lit(", Org "), (F.col("id") % 4).cast("string")).alias("body_raw"),
    )
    return I.roles(mails, people, idents).select("id", "role_guess", "org")


_ROLE_MAIL = """select concat('<', l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey, '@x>') message_id, concat('s', l_suppkey, '@x.example') from_addr, concat('N', l_suppkey) from_name, concat('s', l_partkey % 40 + 1, '@x.example') to_addr, concat('order ', l_orderkey) subject,
  concat('Dear supplier#', lpad(cast(l_partkey % 40 + 1 as string), 9, '0'), ', take part ', l_partkey) new_text, l_shipdate sent_at, l_suppkey sender, l_partkey % 40 + 1 receiver from {lineitem}"""


@query(over("people") + f""", m as ({_ROLE_MAIL.format(lineitem='lineitem')}),
both_ as (select 'sent' kind, sender id, message_id, sent_at, '- ' || subject || ': ' || new_text line from m union all select distinct 'received', receiver, message_id, sent_at, '- from ' || from_name || ': ' || new_text from m join people on id = receiver where contains(lower(new_text), lower(split_part(canonical_name, ' ', 1)))),
few as (select * from both_ where id in (select sender from m group by 1 having count(*) >= 3) qualify row_number() over (partition by id, kind order by sent_at, message_id) <= 8),
told as (select id, coalesce(string_agg(line, chr(10) order by sent_at, message_id) filter (kind = 'sent'), '') sent, coalesce(string_agg(line, chr(10) order by sent_at, message_id) filter (kind = 'received'), '') got from few group by 1)
select p.id, case when told.id is not null and p.id % 2 = 0 and is_internal and role_guess is null then 'Head ' || p.id || ' (inferred from behaviour)' else role_guess end role_guess,
  case when is_internal and role_guess is null then 'PERSON: ' || canonical_name || chr(10) || chr(10) || 'SENT BY THEM:' || chr(10) || sent || chr(10) || chr(10) || 'SENT TO THEM BY OTHERS:' || chr(10) || got end prompt from people p left join told using (id)""")
def inferred_roles(spark, d):
    """Insiders without a role are asked about with their own and others' mails; answers for every second one name a role."""
    people = frame(spark, d, "people")
    idents = frame(spark, d, "identities").where("value like 's%@x.example'")
    mails = spark.sql(_ROLE_MAIL, lineitem=table(spark, d, "lineitem")).withColumn("to_addrs", F.array("to_addr")).withColumn("cc_addrs", F.array().cast("array<string>"))
    prompts = I.role_prompts(mails, people, idents)
    answers = people.select(F.col("id").alias("person_id"), F.struct(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Head "), "id")).alias("role"), F.lit(None).cast("string").alias("org")).alias("answer"))
    out = I.inferred_roles(people, prompts, answers).select("id", "role_guess")
    return out.join(prompts.withColumnRenamed("person_id", "id"), "id", "left").withColumnRenamed("text", "prompt")


_CHAIN = (over("decisions", "edges") + ", g as (select src x, dst y from edges union all select dst, src from edges), r(node) as (select decision_id from decisions where authority_flag and status = 'contested' union select y from r join g on x = node)").replace("with decisions", "with recursive decisions", 1)


@query(_CHAIN + " select decision_id, decided_at > '1998-01-01' after_as_of from decisions where decision_id in (select node from r)")
def answer_context(spark, d):
    decisions, edges, evidence, emails = frames(spark, d, "decisions", "edges", "evidence", "emails")
    seeds = decisions.where("authority_flag and status = 'contested'").select(F.col("decision_id").alias("node"))
    emails = emails.withColumn("fwd_meta", F.lit(None).cast("struct<from_name:string,from_addr:string,date:string>"))
    return S.context(Scratch(spark, "context"), seeds, decisions, edges, evidence, emails, "1998-01-01")["decisions"].select("decision_id", "after_as_of")


_LONG = "length(trim(substr(new_text, 1, 30), ' .,;:!?\"''-')) >= 3"


@query(over("messages") + f"""select message_id answer_id, 'Told by ' || from_name || ' [^1].' answer_md, 'found' status, case when pos % 2 = 0 then 'low' else 'medium' end confidence, 1 caveats from messages where {_LONG}""")
def answered_questions(spark, d):
    """One answer for each message: a cited sentence, one that nothing backs, and now and then a citation that doesn't hold."""
    m = frame(spark, d, "messages").where(F.length(F.regexp_replace(F.substring("new_text", 1, 30), r"^[ .,;:!?\"'-]+|[ .,;:!?\"'-]+$", "")) >= 3)
    cite = lambda n, q: F.struct(F.lit(n).alias("n"), F.col("message_id"), q.alias("quote"))
    good = F.array(cite(1, F.substring("new_text", 1, 30)))
    cites = F.when(F.col("pos") % 2 == 0, F.concat(good, F.array(cite(2, F.lit("zq zq"))))).otherwise(good)
    md = F.concat(F.lit("Told by "), "from_name", F.lit(" [^1]. Nobody knows why."))
    answer = F.struct(F.lit("found").alias("status"), md.alias("answer_md"), cites.alias("citations"), F.array(F.lit("DEC-1")).alias("decision_ids"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("caveats"), F.array().cast("array<struct<message_id:string,why:string>>").alias("closest"))
    known = spark.createDataFrame([("DEC-1", "explicit")], "decision_id string, decision_type string")
    out = V.answered(m.select(F.col("message_id").alias("answer_id"), answer.alias("answer")), None, m.select("message_id", "new_text", "fwd_text"), known)
    return out.select("answer_id", "answer_md", "status", "confidence", F.size("caveats").alias("caveats"))


@query("""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) a, count(*) over (partition by conv_id) n from conversations where length(trim(substr(text, 1, 30), ' .,;:!?"''-')) >= 3),
f as (select conv_id, a, row_number() over (partition by conv_id order by a) k from c where turn % 2 = 0 and a > 1 and n > 1)
select 'C-' || conv_id cluster_id, 'd1' temp_id, 'R-' || conv_id || '-' || turn source from c where a = 1 and (n > 1 or turn % 2 = 0) union all select 'C-' || f.conv_id, 'dr' || k, 'R-' || f.conv_id || '-' || c.turn from f join c using (conv_id, a)
union all select 'C-' || conv_id, 'd1', 'R-' || conv_id || '-' || turn from c where a = 1 and n = 1 and turn % 2 = 1""")
def reconciled(spark, d):
    """A record for each message, those of even turns final; the answers merge a conversation's first record and leave out
    the others."""
    m = frame(spark, d, "messages").where(F.length(F.regexp_replace(F.substring("new_text", 1, 30), r"^[ .,;:!?\"'-]+|[ .,;:!?\"'-]+$", "")) >= 3).withColumn("sent_tz", F.lit("+0000"))
    rid, none = F.concat_ws("-", F.lit("R"), "conv_id", "turn"), F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    recs = m.select(
        rid.alias("record_id"), "thread_id", F.lit("topic").alias("topic_label"), F.lit("do it").alias("decision_text"), F.when(F.col("turn") % 2 == 0, "final").otherwise("proposed").alias("stance"), F.lit("explicit").alias("decision_type"), empty.alias("decided_by"),
        F.format_string("2026-01-%02d", F.col("turn") + 1).alias("decision_date"), none.alias("rationale"), empty.alias("alternatives"), none.alias("conditions"), none.alias("overrides_hint"), none.alias("authority_note"), F.lit(0.5).alias("confidence"), F.concat(F.lit("C-"), "conv_id").alias("cluster_id"),
    )
    ev = m.select(F.lit(1).cast("long").alias("id"), F.lit("record").alias("owner_kind"), rid.alias("owner_id"), "message_id", F.substring("new_text", 1, 30).alias("quote"), F.lit("decision").alias("role"), F.lit(True).alias("verified"))
    said = '{"cluster_topic": "t", "decisions": [{"decision_id_temp": "d1", "canonical_text": "x", "decided_by": [], "decided_at": "2026-01-01", "alternatives": [], "decision_type": "explicit", "status": "active", "authority_flag": false, "merged_record_ids": ["r1"], "confidence": 0.9, "evidence": [{"message_id": "e1", "quote": "zq zq", "role": "decision"}]}], "edges": [], "conflicts": [], "current_state": "", "non_decisions": []}'
    answers = recs.select("cluster_id").distinct().withColumn("answer", F.from_json(F.lit(said), ANSWERS["reconcile"]))
    out = L.reconcile(recs, ev, m, answers)["decisions"]
    return out.select("cluster_id", "temp_id", F.col("sources")[0].alias("source"))


@query(over("messages") + "select message_id, 'ask [email] or [phone], pay [IBAN]' note, message_id inner_id, ['by [email]'] tags from messages")
def redacted_rows(spark, d):
    m = frame(spark, d, "messages").select("message_id", F.concat(F.lit("ask "), "from_addr", F.lit(" or +31 20 555 12 34, pay NL91ABNA0417164300")).alias("note"), F.struct(F.col("message_id"), F.array(F.concat(F.lit("by "), "from_addr")).alias("tags")).alias("x"))
    return T.redact(m).select("message_id", "note", F.col("x.message_id").alias("inner_id"), "x.tags")


@query("""with m as (select event_type, round(avg(value), 3) v, row_number() over (order by event_type) i from events group by 1)
select i line, '| ' || event_type || ' | ' || regexp_replace(printf('%.3f', v), '[.]?0+$', '') || ' | 50 | ' || case when v >= 50 then 'yes' else 'no' end || ' |' as "text" from m""")
def scorecard(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("v")).orderBy("event_type").collect()
    text = tables.scorecard([{"name": r["event_type"], "value": r["v"], "target": 50, "met": r["v"] >= 50} for r in m])
    rows = [(i, line) for i, line in enumerate(text.strip().split("\n")[2:], 1)]
    return spark.createDataFrame(rows, "line bigint, text string")
