"""Tables that a run keeps: replaced, appended, looked up by content, copied and reported."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import ANSWERS, DDL, schema


def replace(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def snapshot(spark: SparkSession, root: str, to: str, names=tuple(n for n in DDL if n != "qa_log")) -> list[str]:
    """Copies the tables that exist, but the question log; restoring is the same call the other way."""
    done = []
    for name in names:
        try:
            replace(read(spark, root, name), to, name)
        except Exception as e:  # a table that no stage has written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            done.append(name)
    return done


def request_key(request: dict) -> str:
    """The content hash under which an answer is kept: canonical JSON, sorted keys, no spaces, non-ASCII as it is."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@F.pandas_udf(StringType())
def request_keys(request: pd.Series) -> pd.Series:
    """The same of requests that are JSON texts."""
    return request.map(lambda r: request_key(json.loads(r)))


def answers(requests: DataFrame, cache: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(requests with their parsed answers, requests without one): answers are a table, never a call."""
    keyed = requests.withColumn("key", request_keys("request"))
    found = keyed.join(cache.select("key", "response"), "key", "left")
    parsed = found.where("response is not null").withColumn("answer", F.from_json(F.regexp_replace(F.trim("response"), r"(?s)^```[a-zA-Z]*\n?|\n?```$", ""), ANSWERS[stage]))
    return parsed, found.where("response is null").drop("response")


def call_rows(requests: DataFrame, cache: DataFrame, run_id: str, stage: str, model: str) -> DataFrame:
    """Rows of table llm_calls: answers from the cache count as calls without tokens or cost. requests: (key, tokens_in,
    tokens_out, cost_usd)."""
    hit = cache.select("key").distinct().withColumn("cached", F.lit(True))
    told = requests.join(hit, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    spent = lambda c: F.when(F.col("cached"), F.lit(0)).otherwise(F.col(c))
    return told.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.lit(model).alias("model"), "cached", spent("tokens_in").alias("tokens_in"), spent("tokens_out").alias("tokens_out"), spent("cost_usd").cast("double").alias("cost_usd"))


def classified(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(question_id, type, as_of_date) of questions (question_id, request): null where the model gave no answer that can be
    read, which refines nothing and fails nothing."""
    found, _ = answers(requests, cache, "classify")
    told = found.select("question_id", F.col("answer.type").alias("type"), F.when(F.col("answer.as_of_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("answer.as_of_date")).alias("as_of_date"))
    return requests.select("question_id").join(told, "question_id", "left")


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh answers in place of old ones of the same key."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select("key", "response"))


def truth(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.csv(path, header=True, schema="message_id string, file string, split string, bucket string, decision_ids string, role string, traps string")
    lists = {c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "") for c in ("decision_ids", "traps")}
    return kept.withColumns(lists)


def scorecard(rows: list[dict]) -> str:
    """Markdown table of metrics (name, value, target, met)."""
    show = lambda v: "-" if v is None else f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = ["| metric | value | target | met |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r['name']} | {show(r['value'])} | {show(r.get('target'))} | {'yes' if r.get('met') else 'no'} |" for r in rows]) + "\n"


def write_report(rows: list[dict], folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, text in (("scorecard.md", scorecard(rows)), ("scorecard.json", json.dumps(rows, indent=1))):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
