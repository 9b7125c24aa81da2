"""Filters, joins, aggregates and windows over ledger-like tables, written for any table of that shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, partitions

STRONG = ("decision", "approval", "reversal")
KEEP = ("proposal", "approval", "decision", "reversal", "commitment")
DECISIVE = ("approval", "confirmation", "reversal")


def rounded_binary(x: Column, places: int) -> Column:
    """x, a double, times 10 ** places, to the nearest whole number, halves away from 0, over 10 ** places, as C and most databases
    round; F.round goes by x's shortest decimal form instead, and knows no -0.0. Products must stay below 2 ** 63."""
    scale = 10.0 ** places
    up, sign = F.abs(x) * scale, F.signum(x)
    low = F.floor(up).cast("double")
    return F.when(F.isnan(x), x).otherwise(sign * F.when(up - low >= 0.5, low + 1).otherwise(low) / scale)


# ---- filters and predicates

def ledger_filter(df: DataFrame, equal: dict | None = None, among: dict | None = None, since: tuple | None = None, until: tuple | None = None, like: tuple | None = None) -> DataFrame:
    """AND of what is given: equalities, lists, an inclusive range of (column, bound), (text, columns...) found in any of
    the columns without regard to case. They reach the scan as pushed filters."""
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.col(c).isin(*v) for c, v in (among or {}).items()]
    tests += [F.col(since[0]) >= F.lit(since[1])] if since else []
    tests += [F.col(until[0]) <= F.lit(until[1])] if until else []
    if like:
        tests.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{like[0]}%") for c in like[1:]]))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def has_candidate(signals: Column, flag: Column | None = None) -> Column:
    """The model's flag, or any signal worth keeping (a question before an approval is among these already)."""
    kept = F.coalesce(F.arrays_overlap(signals, F.array(*map(F.lit, KEEP))), F.lit(False))
    return kept if flag is None else F.coalesce(flag, F.lit(False)) | kept


def followed_by(df: DataFrame, by: list[str], order: list[str], first: Column, then: Column, into: str = "followed") -> DataFrame:
    """Whether a row of kind ``first`` is followed, later in its group, by one of kind ``then``."""
    later = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(into, first & F.coalesce(F.max(then.cast("int")).over(later) == 1, F.lit(False)))


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def as_of_label(df: DataFrame, date: str, as_of) -> DataFrame:
    """Rows after the date are marked, not removed; without a date none is."""
    return df.withColumn("after_as_of", F.lit(False) if as_of is None else F.coalesce(F.col(date) > F.lit(as_of), F.lit(False)))


def fix_statuses(nodes: DataFrame, edges: DataFrame, key: str = "decision_id", status: str = "status") -> DataFrame:
    """Status after edges (src newer, dst older): superseded by any superseding edge, amended if it was active and an
    edge amends it; contested ones stay."""
    told = edges.groupBy("dst").agg(F.bool_or(F.col("kind") == "supersedes").alias("_s"), F.bool_or(F.col("kind") == "amends").alias("_a"))
    new = F.when(F.col(status) == "contested", F.col(status)).when(F.col("_s"), "superseded").when(F.col("_a") & (F.col(status) == "active"), "amended").otherwise(F.col(status))
    return nodes.join(told, F.col(key) == F.col("dst"), "left").withColumn(status, new).drop("dst", "_s", "_a")


def sane_edges(edges: DataFrame, nodes: DataFrame, key: str = "decision_id") -> DataFrame:
    ids = nodes.select(F.col(key).alias("_k"))
    return edges.where("src <> dst").join(ids, F.col("src") == F.col("_k"), "left_semi").join(ids, F.col("dst") == F.col("_k"), "left_semi")


def answer_confidence(status: Column, n_errors: Column, n_cites: Column, n_messages: Column, n_closest: Column, all_explicit: Column) -> Column:
    return (
        F.when((n_errors > 0) | (status == "partial"), "low")
        .when(status == "no_decision", F.when((n_closest > 0) | (n_cites > 0), "medium").otherwise("low"))
        .when(F.coalesce(all_explicit, F.lit(False)) & (n_cites >= 2) & (n_messages >= 2) & status.isin("found", "contested"), "high")
        .otherwise("medium")
    )


def card_confidence(decision_type: Column, n_quotes: Column, n_messages: Column) -> Column:
    high = (decision_type == "explicit") & (n_quotes >= 2) & (n_messages >= 2)
    reason = F.when(high, "explicit, several quotes").when(decision_type != "explicit", "implicit").otherwise("single source")
    return F.struct(F.when(high, "high").otherwise("medium").alias("level"), reason.alias("reason"))


def meets(value: Column, target: Column, at_least: bool = True) -> Column:
    return F.when(value.isNull(), None).otherwise(value >= target if at_least else value <= target)


# ---- joins

def lookup(df: DataFrame, names: DataFrame, on, value: str, otherwise: Column, into: str) -> DataFrame:
    """Left lookup with a fallback."""
    return df.join(names, on, "left").withColumn(into, F.coalesce(F.col(value), otherwise))


def alias_join(df: DataFrame, aliases: DataFrame, by: list[str], alias: str, key: str) -> DataFrame:
    """Aliases become keys; what isn't an alias stays as it is."""
    bare = F.regexp_replace(alias, r"[\[\]\s]", "")
    held = aliases.select(*by, F.col("alias").alias("_alias"), F.col(key).alias("_key"))
    out = df.withColumn("_bare", bare).join(held.withColumnsRenamed({b: f"_{b}" for b in by}), reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_{b}") for b in by] + [F.col("_bare") == F.col("_alias")]), "left")
    return out.withColumn(key, F.coalesce("_key", alias)).drop("_bare", "_alias", "_key", *[f"_{b}" for b in by])


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among the nodes (node)."""
    return edges.join(nodes, F.col("src") == F.col("node"), "left_semi").unionByName(edges.join(nodes, F.col("dst") == F.col("node"), "left_semi")).distinct()


def near_dates(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int) -> DataFrame:
    """Pairs whose dates are at most ``days`` apart: an equi-join on buckets of days, looked up with their neighbours."""
    width = days + 1
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    a = left.withColumn("_a", day(left_date)).withColumn("_k", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("_a") / width) + k)))
    b = right.withColumn("_b", day(right_date)).withColumn("_k2", F.floor(F.col("_b") / width))
    return a.join(b, F.col("_k") == F.col("_k2")).where(F.abs(F.col("_a") - F.col("_b")) <= days).drop("_a", "_b", "_k", "_k2")


def best_overlap(left: DataFrame, right: DataFrame, item: str, left_key: str, right_key: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """(left_key, right_key, shared): for each left the right that shares most items within the days, the least key of
    equals. Pairs come from the items themselves."""
    pairs = left.select(left_key, left_date, item).distinct().join(right.select(right_key, right_date, item).distinct(), item)
    near = pairs.where(F.abs(F.datediff(left_date, right_date)) <= days).groupBy(left_key, right_key).agg(F.count("*").alias("shared"))
    w = Window.partitionBy(left_key).orderBy(F.col("shared").desc(), right_key)
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def match_edges(truth: DataFrame, predicted: DataFrame, match: DataFrame) -> DataFrame:
    """Truth edges (src, dst, kind) with hit and kind_ok: whether the matched pair is linked, and by that kind."""
    m = match.select("truth_id", "decision_id")
    want = truth.join(m.withColumnsRenamed({"truth_id": "src", "decision_id": "ps"}), "src", "left").join(m.withColumnsRenamed({"truth_id": "dst", "decision_id": "pd"}), "dst", "left")
    got = predicted.groupBy("src", "dst").agg(F.collect_set("kind").alias("kinds")).withColumnsRenamed({"src": "s2", "dst": "d2"})
    out = want.join(got, (F.col("ps") == F.col("s2")) & (F.col("pd") == F.col("d2")), "left")
    return out.select("src", "dst", "kind", F.col("kinds").isNotNull().alias("hit"), F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)).alias("kind_ok"))


# ---- aggregates

def thread_summary(df: DataFrame, by: str, at: str, key: str, person: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_msgs"), F.array_sort(F.collect_set(person)).alias("participants"), F.min_by(key, F.struct(at, key)).alias("first_key"))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def usage(calls: DataFrame, by: str = "stage") -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def cost(tokens_in: Column, tokens_out: Column, cached_in: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices a million tokens; cached input counts a tenth."""
    return ((tokens_in - cached_in) * price_in + cached_in * price_in * 0.1 + tokens_out * price_out) / 1e6


def stage_totals(calls: DataFrame, run_id: str, stage: str) -> DataFrame:
    """Tokens and cost of one run's stage, 0 where it made no call."""
    return calls.where((F.col("run_id") == run_id) & (F.col("stage") == stage)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")], F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"))


def latest(df: DataFrame, by: str, order: list[str], *values: str) -> DataFrame:
    """The values of each group's last row."""
    return df.groupBy(by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(by, *[F.col(f"_v.{v}").alias(v) for v in values])


def guarded_ratio(part: Column, whole: Column, empty: float = 0.0, places: int = 3) -> Column:
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(F.lit(empty))


def percentiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50: the median, cut to an integer; p90: the value at place floor(0.9 (n - 1)) of the sorted ones.

    Values of a group are counted first, and ranks run over ranges of its values: each range's rows are summed, the sums
    place the ranges, and only the ranges that hold a wanted place are looked into. No task holds a group."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    spark = df.sparkSession
    part = Scratch(spark, "percentiles").write(counts.repartitionByRange(partitions(spark), *by, value).withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).withColumn("_n", F.sum("_s").over(Window.partitionBy(*by)))
    places = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2), F.floor(F.lit(0.9) * (F.col("_n") - 1)))
    placed = placed.withColumn("_at", places).where(F.exists("_at", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_s"))))
    placed = placed.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_before", "_at")
    cond = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    held = part.join(placed, cond).select(*by, value, "_p", "_c", "_before", "_at")
    upto = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy(value))
    held = held.withColumn("_to", F.col("_before") + upto)
    at = lambda k: F.max(F.when((F.col("_at")[k] < F.col("_to")) & (F.col("_at")[k] >= F.col("_to") - F.col("_c")), F.col(value)))
    return held.groupBy(*by).agg(F.floor((at(0) + at(1)) / 2).cast("long").alias("p50"), at(2).alias("p90"))


def global_percentiles(df: DataFrame, value: str) -> DataFrame:
    """The same over the whole table."""
    return percentiles(df, value)


def crosstab(df: DataFrame, by: str, column: str, values: list) -> DataFrame:
    return df.groupBy(by).pivot(column, values).count().na.fill(0)


def weighted_scores(matched: DataFrame, verdict: str = "verdict") -> DataFrame:
    """recall or precision over rows with a verdict: yes counts 1, partial a half."""
    weight = F.when(F.col(verdict) == "yes", 1.0).when(F.col(verdict) == "partial", 0.5).otherwise(0.0)
    return matched.agg(F.round(F.coalesce(F.sum(weight), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*")), 3).alias("score"), F.count("*").alias("n"))


def pairwise_f1(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 of pairs put together, from counts alone, without making the pairs."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.groupBy(truth, found).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    of = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    one = both.join(of(truth, "truth_pairs")).join(of(found, "found_pairs"))
    p, r = F.col("tp") / F.greatest(F.col("found_pairs"), F.lit(1e-9)), F.col("tp") / F.greatest(F.col("truth_pairs"), F.lit(1e-9))
    return one.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6).alias("f1"))


def sequential_ids(df: DataFrame, order: list, form: str, into: str, by: list | None = None) -> DataFrame:
    """Formatted row numbers, over the whole (by partition sums, so that no task holds all rows) or within groups."""
    if by:
        return df.withColumn(into, F.format_string(form, F.row_number().over(Window.partitionBy(*by).orderBy(*order))))
    spark = df.sparkSession
    part = Scratch(spark, "numbers").write(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = part.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_c"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = part.join(F.broadcast(first.select("_p", "_first")), F.shiftright("_at", 33) == F.col("_p"))
    return out.withColumn(into, F.format_string(form, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)).drop("_at", "_p", "_first")


def month_ticks(df: DataFrame, date: str) -> DataFrame:
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("month"))
