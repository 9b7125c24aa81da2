"""The read endpoints, as functions from tables to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from . import relational as R
from .graph import reachable


def evidence_cards(evidence: DataFrame, emails: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Verified quotes in order with their mail; a quote of forwarded text goes to its original author and date."""
    mail = emails.select("message_id", "subject", "from_addr", "from_name", "sent_at", "thread_id", "fwd_text", "fwd_meta")
    e = evidence.where("verified").join(mail, "message_id", "left")
    fwd = F.coalesce(F.col("fwd_text").contains(F.col("quote")), F.lit(False))
    return e.select("id", "owner_kind", "owner_id", "message_id", "quote", "role", "subject", "thread_id", fwd.alias("forwarded"), F.when(fwd, F.coalesce("fwd_meta.from_name", "fwd_meta.from_addr")).otherwise(F.coalesce("from_name", "from_addr")).alias("author"), F.when(fwd, F.coalesce(F.col("fwd_meta.date"), F.col("sent_at").cast("string"))).otherwise(F.col("sent_at").cast("string")).alias("said_at"))


def decision_summaries(decisions: DataFrame, evidence: DataFrame, emails: DataFrame) -> DataFrame:
    """Decisions with the count of quotes and of mails, and whether their evidence spans threads."""
    e = evidence.where("owner_kind = 'decision'").join(emails.select("message_id", "thread_id"), "message_id", "left")
    n = e.groupBy(F.col("owner_id").alias("decision_id")).agg(F.count("*").alias("n_quotes"), F.count_distinct("message_id").alias("n_messages"), (F.count_distinct("thread_id") > 1).alias("cross_thread"))
    out = decisions.join(n, "decision_id", "left").na.fill(0, ["n_quotes", "n_messages"]).na.fill(False, ["cross_thread"])
    return out.withColumn("card", R.card_confidence(F.col("decision_type"), F.col("n_quotes"), F.col("n_messages")))


def list_decisions(decisions: DataFrame, status: str | None = None, cluster: str | None = None, q: str | None = None, since: str | None = None, until: str | None = None, kind: str | None = None) -> DataFrame:
    equal = {c: v for c, v in (("cluster_id", cluster), ("decision_type", kind)) if v}
    among = {"status": status.split(",")} if status else None
    df = R.ledger_filter(decisions, equal, among, ("decided_at", since) if since else None, ("decided_at", until) if until else None, (q, "canonical_text", "rationale") if q else None)
    return df.orderBy("decided_at", "decision_id")


def health(spark, demo: bool = False, provider: str = "none", models: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(True, demo, provider, models or {})], "ok boolean, demo_mode boolean, provider string, models map<string,string>")


def stats(emails: DataFrame, threads: DataFrame, people: DataFrame, flags: DataFrame, records: DataFrame, decisions: DataFrame, conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts and shares. flags: table thread_triage."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    told = decisions.agg(F.count("*").alias("decisions"), F.count_if("authority_flag").alias("authority_flags"), F.count_if(F.col("decision_type") == "implicit").alias("implicit"))
    proof = evidence.where("owner_kind = 'decision'").agg(R.guarded_ratio(F.count_if("verified"), F.count("*"), 1.0).alias("evidence_verified_ratio"))
    row = n(emails, "emails")
    for part in (n(threads, "threads"), n(people, "people"), n(flags.where("has_candidate"), "candidate_threads"), n(records, "records"), told, n(conflicts, "conflicts"), proof):
        row = row.join(F.broadcast(part))
    filtered = F.when(F.col("threads") > 0, F.round(100 * (1 - F.col("candidate_threads") / F.col("threads")), 1)).otherwise(0.0)
    return row.withColumn("filtered_pct", filtered)


def stage_notes(runs: DataFrame, counters: tuple = ("quotes_total", "quotes_snapped", "quotes_dropped"), stages: tuple = ("extract", "reconcile")) -> DataFrame:
    """Counters summed over the notes of each stage's latest run."""
    last = R.latest(runs.where(F.col("stage").isin(*stages)), "stage", ["finished_at"], "notes")
    value = lambda c: F.coalesce(F.get_json_object("notes", f"$.{c}").cast("long"), F.lit(0))
    return last.agg(*[F.coalesce(F.sum(value(c)), F.lit(0)).alias(c) for c in counters])


def ingest_stats(emails: DataFrame, threads: DataFrame, people: DataFrame, dupes: int) -> DataFrame:
    e = emails.agg(F.count("*").alias("emails"), F.count_if(F.col("quoted_text") != "").alias("with_quotes"), F.count_if(F.col("fwd_text") != "").alias("with_forwards"))
    t = threads.agg(F.count("*").alias("threads"), F.count_if(F.col("n_msgs") > 1).alias("multi"))
    p = people.agg(F.count("*").alias("people"), F.sum(F.col("is_internal").cast("int")).alias("internal"))
    return e.join(F.broadcast(t)).join(F.broadcast(p)).withColumn("duplicates", F.lit(dupes))


def decision_page(scratch: Scratch, decision_id: str, decisions: DataFrame, edges: DataFrame, evidence: DataFrame, emails: DataFrame) -> dict[str, DataFrame]:
    """A decision, its chain over edges both ways, the edges that touch the chain, and its evidence; empty if unknown."""
    one = decisions.where(F.col("decision_id") == decision_id)
    chain = reachable(scratch, one.selectExpr("decision_id node"), edges)
    cards = evidence_cards(evidence.where((F.col("owner_kind") == "decision") & (F.col("owner_id") == decision_id)), emails)
    return {"decision": one, "chain": decisions.join(chain, F.col("decision_id") == F.col("node"), "left_semi").orderBy("decided_at", "decision_id"), "edges": R.touching(edges, chain), "evidence": cards.orderBy("id")}


def cluster_list(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters that own a decision, with its count, dates and statuses."""
    own = decisions.groupBy("cluster_id").agg(F.count("*").alias("n_decisions"), F.min("decided_at").alias("first_date"), F.max("decided_at").alias("last_date"), F.array_sort(F.collect_set("status")).alias("statuses"))
    return clusters.join(own, "cluster_id").orderBy("first_date", "cluster_id")


def cluster_page(cluster_id: str, clusters: DataFrame, decisions: DataFrame, edges: DataFrame, evidence: DataFrame, emails: DataFrame) -> dict[str, DataFrame]:
    """A cluster, its decisions by date, and the edges from them; empty if unknown."""
    one = clusters.where(F.col("cluster_id") == cluster_id)
    own = decisions.where(F.col("cluster_id") == cluster_id)
    return {"cluster": one, "decisions": decision_summaries(own, evidence, emails).orderBy("decided_at", "decision_id"), "edges": edges.join(own.select(F.col("decision_id").alias("src")), "src", "left_semi")}


def latest_report(spark, path: str) -> DataFrame | None:
    """The last exported scorecard, as it was written; None if there is none."""
    try:
        return spark.read.json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def accepted_uploads(files: DataFrame, busy: bool = False, demo: bool = False) -> DataFrame:
    """(name, accepted, code) of uploaded names: mail files and archives are taken; 409 while a run is active or in demo mode,
    400 if none is taken, else 200."""
    taken = F.lower(F.regexp_extract(F.regexp_replace("name", r"^.*[/\\]", ""), r"(\.[^.]+)$", 1)).isin(".eml", ".mbox", ".zip")
    some = files.agg(F.coalesce(F.max(taken), F.lit(False)).alias("some"))
    code = F.lit(409) if busy or demo else F.when(F.col("some"), 200).otherwise(400)
    return files.join(F.broadcast(some)).select("name", (taken & F.lit(not (busy or demo))).alias("accepted"), code.alias("code"))


def ingest(files: DataFrame, root: str, run_id: str, busy: bool = False, demo: bool = False) -> DataFrame | None:
    """Reads uploaded files (path, content) into table emails, each message once, and logs the run; None if refused."""
    from ..sources import mailbox, tables

    told = accepted_uploads(files.select(F.col("path").alias("name")), busy, demo)
    if not told.where("accepted").limit(1).count():
        return None
    spark = files.sparkSession
    found = mailbox.messages_of(files)
    kept = mailbox.first_seen(found).drop("_path", "_at")
    tables.replace(kept, root, "emails")
    emails = tables.read(spark, root, "emails")
    n_in, n_out = found.count(), emails.count()
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit("parse").alias("stage"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit(n_in).cast("long").alias("n_in"), F.lit(n_out).cast("long").alias("n_out"), F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0.0).alias("cost_usd"), F.to_json(F.struct(F.lit(n_in - n_out).alias("duplicates"))).alias("notes"))
    tables.append(row, root, "runs")
    return emails


def ask(spark, root: str, index: str, scratch: Scratch, question: str, answer: DataFrame, retry: DataFrame | None = None, classified: DataFrame | None = None) -> DataFrame | None:
    """One question against a written ledger and its index: what it may draw on is found, a model's answer (answer_id,
    answer) is held against it, and the result is logged. None for an empty question; classified: (type, as_of_date)."""
    from ..sources import tables
    from . import retrieval as V

    if not question.strip():
        return None
    read = lambda name: tables.read(spark, root, name)
    seeds, near = V.retrieve_ledger(spark, index, question)
    as_of = classified.select("type", "as_of_date").first() if classified is not None else None
    held = context(scratch, seeds.selectExpr("decision_id node"), read("decisions"), read("decision_edges"), read("evidence"), read("emails"), as_of["as_of_date"] if as_of else None)
    cited = held["evidence"].select("message_id").unionByName(near.join(spark.read.parquet(f"{index}/passages"), "passage_id").select("message_id")).distinct()
    texts = read("emails").join(cited, "message_id", "left_semi").select("message_id", "new_text", "fwd_text")
    told = V.answered(answer, retry, texts, held["decisions"]).withColumn("question", F.lit(question)).withColumn("question_type", F.lit(as_of["type"] if as_of else None).cast("string"))
    told = scratch.write(told)
    log = read("qa_log") if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/qa_log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/qa_log")) else None
    last = (log.agg(F.max("id")).first()[0] or 0) if log is not None else 0
    tables.append(told.select(F.lit(last + 1).cast("long").alias("id"), "question", F.to_json(F.struct("*")).alias("answer_json"), F.lit(0).cast("long").alias("latency_ms"), F.current_timestamp().alias("created_at")), root, "qa_log")
    return told


def lanes(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lanes with the eventful ones first, then by first date and id."""
    eventful = F.size(F.array_except("statuses", F.array(F.lit("active")))) > 0
    return cluster_list(clusters, decisions).orderBy(eventful.desc(), "first_date", "cluster_id")


def visible_graph(decisions: DataFrame, edges: DataFrame, statuses: list[str] | None = None, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = R.ledger_filter(decisions, among={c: v for c, v in (("status", statuses), ("decision_type", kinds)) if v})
    return nodes, R.sane_edges(edges, nodes)


def conflict_list(conflicts: DataFrame, sides: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts with their sides and quotes, and the first contested decision of their cluster."""
    q = evidence.where("owner_kind = 'conflict_side' and verified").select(F.split_part("owner_id", F.lit(":"), F.lit(1)).alias("conflict_id"), F.split_part("owner_id", F.lit(":"), F.lit(2)).alias("side"), "id", "message_id", "quote")
    q = q.groupBy("conflict_id", "side").agg(F.array_sort(F.collect_list(F.struct("id", "message_id", "quote"))).alias("quotes"))
    s = sides.join(q, ["conflict_id", "side"], "left").groupBy("conflict_id").agg(F.array_sort(F.collect_list(F.struct("side", "claimant", "claim", "quotes"))).alias("sides"))
    first = decisions.where("status = 'contested'").groupBy("cluster_id").agg(F.min("decision_id").alias("decision_id"))
    return conflicts.join(s, "conflict_id", "left").join(first, "cluster_id", "left").orderBy("conflict_id")


def email_page(emails: DataFrame, message_id: str) -> tuple[DataFrame, DataFrame]:
    """A mail by its id, with or without the brackets, and its thread by time."""
    full = message_id if message_id.startswith("<") else f"<{message_id}>"
    one = emails.where(F.col("message_id") == full)
    return one, emails.join(one.select("thread_id"), "thread_id", "left_semi").orderBy("sent_at", "message_id")


def dispute(feedback: DataFrame, decision_id: str, note: str) -> DataFrame:
    spark = feedback.sparkSession
    at = F.coalesce(F.max("id"), F.lit(0)) + 1
    row = feedback.agg(at.alias("id")).select("id", F.lit(decision_id).alias("decision_id"), F.lit("dispute").alias("kind"), F.lit(note[:2000]).alias("note"))
    return feedback.unionByName(spark.createDataFrame(row.collect(), row.schema))


def context(scratch: Scratch, seeds: DataFrame, decisions: DataFrame, edges: DataFrame, evidence: DataFrame, emails: DataFrame, as_of: str | None = None) -> dict[str, DataFrame]:
    """What an answer may draw on: the seeds' chain by cluster and date, marked as of a date, with quotes and edges."""
    chain = reachable(scratch, seeds, edges)
    told = R.as_of_label(decisions.join(chain, F.col("decision_id") == F.col("node"), "left_semi"), "decided_at", as_of).orderBy("cluster_id", "decided_at", "decision_id")
    quotes = evidence_cards(evidence.where("owner_kind = 'decision'").join(chain, F.col("owner_id") == F.col("node"), "left_semi"), emails)
    return {"decisions": told, "edges": R.touching(edges, chain), "evidence": quotes.orderBy("owner_id", "id")}
