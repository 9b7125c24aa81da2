"""From model answers to the decision ledger: triage, records with verified evidence, decisions, edges and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import Scratch
from .relational import DECISIVE, STRONG, alias_join, anti, fix_statuses, has_candidate, sane_edges, sequential_ids
from .verify import verify_quotes


def triage(threads: DataFrame, answers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables triage and thread_triage of answers (thread_id, answer); a thread whose answer is missing stays a candidate."""
    rows = answers.select("thread_id", F.explode("answer.messages").alias("m")).select("thread_id", F.col("m.message_id").alias("m_id"), F.col("m.signal").alias("signal"), F.col("m.note").alias("note"))
    rows = alias_join(rows, aliases, ["thread_id"], "m_id", "message_id").drop("m_id")
    flags = answers.select("thread_id", has_candidate(F.transform("answer.messages", lambda m: m["signal"]), F.col("answer.has_candidate")).alias("has_candidate"))
    return rows.select("thread_id", "message_id", "signal", "note"), threads.select("thread_id").join(flags, "thread_id", "left").select("thread_id", F.coalesce("has_candidate", F.lit(True)).alias("has_candidate"))


def strong_threads(triage_rows: DataFrame) -> DataFrame:
    """Threads whose empty extraction deserves a second look."""
    return triage_rows.where(F.col("signal").isin(*STRONG)).select("thread_id").distinct()


def deciding_days(evidence: DataFrame, key: str) -> DataFrame:
    """(key, day): of evidence (key, role, day) the last day of a deciding quote, else of any."""
    return evidence.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("role").isin(*DECISIVE), F.col("day"))), F.max("day")).alias("day"))


def dated_by(given, day):
    """The date given if it is valid, else that of the evidence."""
    return F.when(T.valid_date(given), given).otherwise(F.date_format(day, "yyyy-MM-dd"))


def record_ids(answers: DataFrame, each: str = "answer.records") -> DataFrame:
    """(thread_id, record_id, r): every record of an answer, numbered within its thread."""
    rows = answers.select("thread_id", F.posexplode(each).alias("i", "r"))
    return rows.select("thread_id", F.concat(F.lit("R-"), F.substring("thread_id", 3, 99), F.format_string("-%02d", F.col("i") + 1)).alias("record_id"), "r")


def records_of_threads(recs: DataFrame, threads: DataFrame) -> DataFrame:
    """Records with the subject of their thread, as a prompt lists them."""
    return recs.join(threads.select("thread_id", "subject_norm"), "thread_id")


def records(answers: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables records and evidence of answers (thread_id, answer). Quotes are verified in the thread's messages
    (thread_id, message_id, alias, pos, sent_at, sent_tz, new_text, fwd_text); a record without a verified quote goes,
    and its number with it. A date that isn't valid becomes that of the latest deciding quote, else of the latest."""
    raw = record_ids(answers)
    ev = raw.select("thread_id", "record_id", F.posexplode("r.evidence").alias("k", "e")).select("thread_id", "record_id", "k", F.col("e.message_id").alias("cited"), F.col("e.quote").alias("quote"), F.col("e.role").alias("role"))
    ev = alias_join(ev, messages, ["thread_id"], "cited", "message_id").withColumn("quote_id", F.concat_ws("#", "record_id", F.col("k").cast("string")))
    checked = verify_quotes(ev.select("quote_id", "thread_id", "message_id", "quote", "role", "record_id", "k"), messages)
    local = F.to_date(T.local_time(F.col("sent_at"), F.col("sent_tz")))
    dated = checked.where("verified").join(messages.select("thread_id", F.col("message_id").alias("source_id"), local.alias("day")), ["thread_id", "source_id"])
    days = deciding_days(dated, "record_id")
    kept = raw.join(days, "record_id")
    cols = ["topic_label", "decision_text", "stance", "decision_type", "decided_by"]
    date = dated_by(F.col("r.decision_date"), F.col("day"))
    out = kept.select("record_id", "thread_id", *[F.col(f"r.{c}").alias(c) for c in cols], date.alias("decision_date"), *[F.col(f"r.{c}").alias(c) for c in ("rationale", "alternatives", "conditions", "overrides_hint", "authority_note", "confidence")], F.lit(None).cast("string").alias("cluster_id"))
    evidence = checked.join(kept.select("record_id"), "record_id", "left_semi").select(F.lit("record").alias("owner_kind"), F.col("record_id").alias("owner_id"), F.col("source_id").alias("message_id"), F.col("span").alias("quote"), "role", "verified")
    return out, evidence


def direct_decisions(recs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Clusters of one final record without an authority note need no model: the record is the decision."""
    alone = recs.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n = 1").select("cluster_id")
    note = F.coalesce("authority_note", F.lit("")) == ""
    one = recs.join(alone, "cluster_id", "left_semi").where((F.col("stance") == "final") & note)
    return one.select("cluster_id", F.concat(F.lit("x-"), F.col("record_id")).alias("temp_id"), F.col("decision_text").alias("canonical_text"), "decided_by", F.col("decision_date").alias("decided_at"), "rationale", "alternatives", "decision_type", F.lit("active").alias("status"), F.lit(False).alias("authority_flag"), "authority_note", "confidence", F.array("record_id").alias("sources"))


def prompt_aliases(recs: DataFrame, evidence: DataFrame, emails: DataFrame, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, alias, record_id) and (cluster_id, alias, message_id): how a cluster's prompt names its records, r1 on by
    date, and its mails, e1 on by time: those that the records cite, and their whole threads where that is no more than
    ``most`` mails."""
    by = Window.partitionBy("cluster_id")
    r = recs.select("cluster_id", "record_id", F.concat(F.lit("r"), F.row_number().over(by.orderBy("decision_date", "record_id"))).alias("alias"))
    cited = evidence.where("verified and owner_kind = 'record'").select(F.col("owner_id").alias("record_id"), "message_id").join(recs.select("record_id", "cluster_id"), "record_id").select("cluster_id", "message_id").distinct()
    whole = recs.select("cluster_id", "thread_id").distinct().join(emails.select("thread_id", "message_id"), "thread_id").select("cluster_id", "message_id")
    every = cited.unionByName(whole).distinct()
    few = every.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("cluster_id")
    mails = cited.unionByName(every.join(few, "cluster_id", "left_semi")).distinct().join(emails.select("message_id", "sent_at"), "message_id")
    e = mails.select("cluster_id", "message_id", F.concat(F.lit("e"), F.row_number().over(by.orderBy("sent_at", "message_id"))).alias("alias"))
    return r.select("cluster_id", "alias", "record_id"), e.select("cluster_id", "alias", "message_id")


def uncovered(recs: DataFrame, answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(cluster_id, alias, record_id): final records that an answer (cluster_id, answer) neither merges into a decision nor
    names among what isn't one."""
    named = F.concat(F.flatten(F.transform("answer.decisions", lambda d: F.coalesce(d["merged_record_ids"], F.array().cast("array<string>")))), F.flatten(F.transform("answer.non_decisions", lambda n: n["record_ids"])))
    covered = answers.select("cluster_id", F.explode(named).alias("a")).select("cluster_id", F.trim("a").alias("alias")).distinct()
    finals = aliases.join(recs.where("stance = 'final'").select("record_id"), "record_id", "left_semi").join(answers.select("cluster_id"), "cluster_id", "left_semi")
    return finals.join(covered, ["cluster_id", "alias"], "left_anti").select("cluster_id", "alias", "record_id")


def better_answers(first: DataFrame, retry: DataFrame, recs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(cluster_id, answer): a second answer stands in for the first where it leaves fewer final records out."""
    left = lambda answers, name: uncovered(recs, answers, aliases).groupBy("cluster_id").agg(F.count("*").alias(name))
    both = first.join(retry.withColumnRenamed("answer", "again"), "cluster_id", "left").join(left(first, "n1"), "cluster_id", "left").join(left(retry, "n2"), "cluster_id", "left")
    better = F.col("again").isNotNull() & (F.coalesce("n2", F.lit(0)) < F.coalesce("n1", F.lit(0)))
    return both.select("cluster_id", F.when(better, F.col("again")).otherwise(F.col("answer")).alias("answer"))


_DRAFT = ("cluster_id", "temp_id", "canonical_text", "decided_by", "decided_at", "rationale", "alternatives", "decision_type", "status", "authority_flag", "authority_note", "confidence", "sources")


def _from_records(recs: DataFrame, temp) -> DataFrame:
    """Decisions that are records as they stand."""
    return recs.select(
        "cluster_id", temp.alias("temp_id"), F.col("decision_text").alias("canonical_text"), "decided_by", F.col("decision_date").alias("decided_at"), "rationale", "alternatives",
        "decision_type", F.lit("active").alias("status"), (F.coalesce("authority_note", F.lit("")) != "").alias("authority_flag"), "authority_note", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array("record_id").alias("sources"),
    )


def _checked(cited: DataFrame, keys: list[str], emails_of: DataFrame, texts: DataFrame) -> DataFrame:
    """(keys, message_id, quote, role): verified quotes, each once, of (cluster_id, keys, k, e)."""
    rows = cited.select("cluster_id", *keys, "k", F.col("e.message_id").alias("cited"), F.col("e.quote").alias("quote"), F.col("e.role").alias("role"))
    rows = alias_join(rows, emails_of, ["cluster_id"], "cited", "message_id").withColumn("quote_id", F.concat_ws("#", "cluster_id", *[F.col(c).cast("string") for c in keys], F.col("k").cast("string")))
    got = verify_quotes(rows.withColumn("thread_id", F.col("cluster_id")).select("quote_id", "thread_id", "message_id", "quote", "role", "cluster_id", *keys, "k"), texts).where("verified")
    once = got.groupBy("cluster_id", *keys, F.col("source_id").alias("message_id"), F.col("span").alias("quote")).agg(F.min_by("role", "k").alias("role"))
    return once


def reconcile(recs: DataFrame, evidence: DataFrame, emails: DataFrame, answers: DataFrame, retries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Drafts, their evidence, edges, conflicts, sides and the sides' evidence, of records and a model's answers.

    recs: table records with cluster_id; evidence: table evidence; emails: with thread_id; answers, retries: (cluster_id,
    answer) as ANSWERS["reconcile"]. A cluster of one final record without an authority note needs no answer. Quotes are
    verified in the mails that the cluster's prompt shows; a decision without a verified quote takes the evidence of the
    records that it merges, and goes without any. Final records left out become decisions of their own. Edges stay
    between decisions that stay, conflicts with two sides of verified evidence or more; a cluster whose conflicts left no
    decision contested gets one for each conflict."""
    write = Scratch(recs.sparkSession, "reconcile").write
    r_alias, e_alias = map(write, prompt_aliases(recs, evidence, emails))
    alone = recs.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n = 1").select("cluster_id")
    direct = recs.join(alone, "cluster_id", "left_semi").where((F.col("stance") == "final") & (F.coalesce("authority_note", F.lit("")) == ""))
    asked = answers.join(direct.select("cluster_id"), "cluster_id", "left_anti")
    told = better_answers(asked, retries, recs, r_alias) if retries is not None else asked.select("cluster_id", "answer")
    told = write(told)
    texts = e_alias.join(emails.select("message_id", "new_text", "fwd_text"), "message_id").select(F.col("cluster_id").alias("thread_id"), "message_id", F.substring("alias", 2, 9).cast("int").alias("pos"), "new_text", "fwd_text")
    own = evidence.where("owner_kind = 'record' and verified").select(F.col("owner_id").alias("record_id"), "message_id", "quote", "role")

    said = told.select("cluster_id", F.explode("answer.decisions").alias("d")).withColumn("temp_id", F.col("d.decision_id_temp"))
    merged = said.select("cluster_id", "temp_id", F.posexplode("d.merged_record_ids").alias("at", "a")).select("cluster_id", "temp_id", "at", F.trim("a").alias("alias")).join(r_alias, ["cluster_id", "alias"])
    sources = merged.join(recs.select("record_id", F.col("decision_type").alias("kind")), "record_id").groupBy("cluster_id", "temp_id").agg(F.array_sort(F.collect_list(F.struct("at", "record_id"))).alias("m"), F.min_by("kind", "at").alias("kind"))
    sources = sources.select("cluster_id", "temp_id", F.transform("m", lambda x: x["record_id"]).alias("sources"), "kind")
    quoted = write(_checked(said.select("cluster_id", "temp_id", F.posexplode("d.evidence").alias("k", "e")), ["temp_id"], e_alias, texts))
    lent = merged.join(own, "record_id").join(quoted.select("cluster_id", "temp_id").distinct(), ["cluster_id", "temp_id"], "left_anti").select("cluster_id", "temp_id", "message_id", "quote", "role")
    kind = F.when(F.col("d.decision_type").isin("explicit", "implicit"), F.col("d.decision_type")).otherwise(F.coalesce("kind", F.lit("explicit")))
    drafts = said.join(sources, ["cluster_id", "temp_id"], "left").select(
        "cluster_id", "temp_id", "d.canonical_text", "d.decided_by", "d.decided_at", "d.rationale", "d.alternatives", kind.alias("decision_type"), "d.status", "d.authority_flag", "d.authority_note", "d.confidence",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )
    # records that the answer leaves out, numbered in the order of their aliases
    left = uncovered(recs, told, r_alias).select("cluster_id", "record_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.substring("alias", 2, 9).cast("int"))).alias("k"))
    left = recs.join(left.drop("cluster_id"), "record_id")
    plain = _from_records(direct, F.lit("d1")).unionByName(_from_records(left, F.concat(F.lit("dr"), F.col("k"))))
    theirs = plain.select("cluster_id", "temp_id", F.col("sources")[0].alias("record_id")).join(own, "record_id").select("cluster_id", "temp_id", "message_id", "quote", "role")
    shown = write(quoted.unionByName(lent).unionByName(theirs))
    held = shown.select("cluster_id", "temp_id").distinct()
    # a lone final record stays even if its evidence is gone
    drafts = write(drafts.unionByName(plain.where("temp_id <> 'd1'")).join(held, ["cluster_id", "temp_id"], "left_semi").unionByName(plain.where("temp_id = 'd1'")))

    ends = lambda c: drafts.select("cluster_id", F.col("temp_id").alias(c))
    edges = told.select("cluster_id", F.explode("answer.edges").alias("e")).select("cluster_id", "e.*").where("src <> dst").join(ends("src"), ["cluster_id", "src"], "left_semi").join(ends("dst"), ["cluster_id", "dst"], "left_semi")

    disputes = told.select("cluster_id", F.posexplode("answer.conflicts").alias("c", "x")).withColumn("conflict_id", F.concat_ws("/", "cluster_id", F.col("c").cast("string")))
    claims = disputes.select("cluster_id", "conflict_id", F.posexplode("x.sides").alias("s", "y")).withColumn("side", F.format_string("%03d", F.col("s")))
    proof = write(_checked(claims.select("cluster_id", "conflict_id", "side", F.posexplode("y.evidence").alias("k", "e")), ["conflict_id", "side"], e_alias, texts))
    conflicts, sides = keep_conflicts(disputes.select("conflict_id", "cluster_id", "x.topic", "x.summary"), claims.select("conflict_id", "side", "y.claimant", "y.claim"), proof.withColumn("verified", F.lit(True)))
    conflicts, sides = write(conflicts), write(sides)
    proof = proof.join(sides.select("conflict_id", "side"), ["conflict_id", "side"], "left_semi")
    dates = proof.join(emails.select("message_id", "sent_at", "sent_tz"), "message_id").groupBy("conflict_id").agg(F.max(F.date_format(T.local_time(F.col("sent_at"), F.col("sent_tz")), "yyyy-MM-dd")).alias("day"))
    who = sides.groupBy("conflict_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "claimant"))), lambda x: x["claimant"]).alias("decided_by"))
    all_of = recs.groupBy("cluster_id").agg(F.array_sort(F.collect_list("record_id")).alias("sources"))
    bare = conflicts.join(drafts.where("status = 'contested'").select("cluster_id").distinct(), "cluster_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("conflict_id"))
    open_ones = bare.withColumn("temp_id", F.concat(F.lit("dc"), n)).join(dates, "conflict_id", "left").join(who, "conflict_id").join(all_of, "cluster_id")
    contested = open_ones.select(
        "cluster_id", "temp_id", F.col("summary").alias("canonical_text"), "decided_by", F.col("day").alias("decided_at"), F.lit(None).cast("string").alias("rationale"), F.array().cast("array<string>").alias("alternatives"),
        F.lit("explicit").alias("decision_type"), F.lit("contested").alias("status"), F.lit(False).alias("authority_flag"), F.lit(None).cast("string").alias("authority_note"), F.lit(0.5).alias("confidence"), "sources",
    )
    shown = shown.unionByName(open_ones.select("conflict_id", "temp_id").join(proof, "conflict_id").select("cluster_id", "temp_id", "message_id", "quote", "role"))
    return {"decisions": drafts.unionByName(contested).select(*_DRAFT), "evidence": shown, "edges": edges, "conflicts": conflicts, "sides": sides, "side_evidence": proof}


def keep_conflicts(conflicts: DataFrame, sides: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides without verified evidence go, then conflicts of fewer than two sides. evidence: (conflict_id, side, verified)."""
    good = sides.join(evidence.where("verified").select("conflict_id", "side").distinct(), ["conflict_id", "side"], "left_semi")
    enough = good.groupBy("conflict_id").agg(F.count("*").alias("n")).where("n >= 2").select("conflict_id")
    return conflicts.join(enough, "conflict_id", "left_semi"), good.join(enough, "conflict_id", "left_semi")


def contested_rows(decisions: DataFrame, conflicts: DataFrame, evidence_dates: DataFrame) -> DataFrame:
    """One contested decision for each conflict of a cluster that has none, dated by its latest evidence."""
    bare = conflicts.join(decisions.where("status = 'contested'").select("cluster_id").distinct(), "cluster_id", "left_anti")
    day = evidence_dates.groupBy("conflict_id").agg(F.max("day").alias("decided_at"))
    return bare.join(day, "conflict_id", "left").select("cluster_id", F.concat(F.lit("c-"), F.col("conflict_id")).alias("temp_id"), F.col("summary").alias("canonical_text"), "decided_at", F.lit("contested").alias("status"), F.lit("explicit").alias("decision_type"), F.lit(0.5).alias("confidence"))


def number_ledger(drafts: DataFrame, edges: DataFrame, conflicts: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Final ids: DEC by date, cluster and temporary id; CON by cluster and topic; letters for the sides. Edges whose ends
    both exist stay, and statuses follow them."""
    numbered = sequential_ids(drafts, ["decided_at", "cluster_id", "temp_id"], "DEC-%04d", "decision_id")
    ids = numbered.select("cluster_id", "temp_id", "decision_id")
    end = lambda c: ids.withColumnsRenamed({"temp_id": c, "decision_id": f"{c}_id"})
    linked = edges.join(end("src"), ["cluster_id", "src"]).join(end("dst"), ["cluster_id", "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "scope", "aspect", "rationale")
    linked = sane_edges(linked, numbered)
    con = sequential_ids(conflicts, ["cluster_id", "topic", "conflict_id"], "CON-%03d", "con_id")
    w = Window.partitionBy("con_id").orderBy("side")
    lettered = sides.join(con.select("conflict_id", "con_id"), "conflict_id").withColumn("side", F.char(F.lit(64) + F.row_number().over(w)))
    return fix_statuses(numbered, linked).drop("temp_id"), linked, con.drop("conflict_id").withColumnRenamed("con_id", "conflict_id"), lettered.drop("conflict_id").withColumnRenamed("con_id", "conflict_id")
