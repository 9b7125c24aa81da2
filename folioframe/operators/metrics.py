"""Scores of a ledger against its truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import guarded_ratio, match_edges, percentiles, weighted_scores


def majority_split(evidence: DataFrame, manifest: DataFrame) -> DataFrame:
    """(decision_id, split): the split of most of a decision's cited mails; of equals, the first by name."""
    votes = evidence.join(manifest.select("message_id", "split"), "message_id").groupBy("decision_id", "split").agg(F.count("*").alias("n"))
    w = Window.partitionBy("decision_id").orderBy(F.col("n").desc(), "split")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("decision_id", "split")


def recall_precision(truth: DataFrame, found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(metric, score, n): yes counts 1, partial a half; unmatched rows count 0."""
    rows = {"recall": truth.join(verdicts, "truth_id", "left"), "precision": found.join(verdicts, "decision_id", "left")}
    parts = [weighted_scores(df).withColumn("metric", F.lit(m)) for m, df in rows.items()]
    return parts[0].unionByName(parts[1]).select("metric", "score", "n")


def status_accuracy(matched: DataFrame) -> DataFrame:
    return matched.agg(guarded_ratio(F.count_if(F.col("status") == F.col("truth_status")), F.count("*")).alias("score"), F.count("*").alias("n"))


def edge_scores(truth: DataFrame, predicted: DataFrame, match: DataFrame) -> DataFrame:
    return match_edges(truth, predicted, match).agg(guarded_ratio(F.count_if("hit"), F.count("*")).alias("links"), guarded_ratio(F.count_if("kind_ok"), F.count("*")).alias("kinds"))


def conflicts_surfaced(conflict_sides: DataFrame, gold: DataFrame) -> DataFrame:
    """Truth conflicts (truth_id) two or more of whose sides some conflict's evidence meets. conflict_sides:
    (conflict_id, side, message_id); gold: (truth_id, message_id)."""
    met = conflict_sides.join(gold, "message_id").groupBy("truth_id", "conflict_id").agg(F.count_distinct("side").alias("sides"))
    best = met.groupBy("truth_id").agg(F.max("sides").alias("sides"))
    return gold.select("truth_id").distinct().join(best, "truth_id", "left").select("truth_id", (F.coalesce("sides", F.lit(0)) >= 2).alias("surfaced"))


def near_decision_hits(decisions: DataFrame, non_decisions: DataFrame) -> DataFrame:
    """Decisions that cite a mail of something that never was one; both (…_id, message_id)."""
    return decisions.join(non_decisions.select("message_id").distinct(), "message_id", "left_semi").select("decision_id").distinct()


def triage_recall(gold: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of threads with gold evidence that triage kept."""
    hit = gold.select("thread_id").distinct().join(kept.select("thread_id").distinct().withColumn("hit", F.lit(1)), "thread_id", "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("recall"), F.count("*").alias("n"))


def evidence_support(cited: DataFrame, gold: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """strict: share of cited (decision_id, message_id) in the gold set; judged adds what a judge accepts."""
    row = cited.join(gold.select("decision_id", "message_id").distinct().withColumn("in_gold", F.lit(True)), ["decision_id", "message_id"], "left")
    row = row.join(judged, ["decision_id", "message_id"], "left") if judged is not None else row.withColumn("supports", F.lit(None).cast("boolean"))
    strict = F.coalesce("in_gold", F.lit(False))
    return row.agg(guarded_ratio(F.count_if(strict), F.count("*")).alias("strict"), guarded_ratio(F.count_if(strict | F.coalesce("supports", F.lit(False))), F.count("*")).alias("judged"))


def quote_validity(evidence: DataFrame, emails: DataFrame) -> DataFrame:
    """Share of verified quotes that stand verbatim in their mail."""
    held = F.coalesce(F.col("new_text").contains(F.col("quote")), F.lit(False)) | F.coalesce(F.col("fwd_text").contains(F.col("quote")), F.lit(False))
    return evidence.where("verified").join(emails.select("message_id", "new_text", "fwd_text"), "message_id", "left").agg(F.count("*").alias("quotes"), guarded_ratio(F.count_if(held), F.count("*"), 1.0).alias("validity"))


def stage_seconds(runs: DataFrame) -> DataFrame:
    """Seconds of each stage's latest run, and the minutes of all stages but the parse."""
    last = runs.groupBy("stage").agg(F.max_by(F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"), "finished_at").alias("seconds"))
    return last.withColumn("pipeline_minutes", F.round(F.sum(F.when(F.col("stage") != "parse", F.col("seconds"))).over(Window.partitionBy()) / 60, 1))


def answer_scores(graded: DataFrame) -> DataFrame:
    """Score of a graded answer: 1 if all parts hold, a half if the status and the facts do. graded: expected, got,
    facts, decision, citations, no_extra (booleans)."""
    status = (F.col("expected") == F.col("got")) | ((F.col("expected") == "found") & (F.col("got") == "partial") & F.col("facts"))
    full = status & F.col("facts") & F.col("decision") & F.col("citations") & F.col("no_extra")
    return graded.withColumn("score", F.when(full, 1.0).when(status & F.col("facts"), 0.5).otherwise(0.0))


def latency(calls: DataFrame) -> DataFrame:
    return percentiles(calls, "latency_ms")


def bucket_crosstab(threads: DataFrame) -> DataFrame:
    """Threads by bucket (a decision's before a non-decision's before filler) and stance."""
    rank = F.when(F.col("bucket") == "decision", 0).when(F.col("bucket") == "non_decision", 1).otherwise(2)
    first = threads.groupBy("thread_id", "stance").agg(F.min_by("bucket", rank).alias("bucket"))
    return first.groupBy("bucket").pivot("stance").count().na.fill(0)
