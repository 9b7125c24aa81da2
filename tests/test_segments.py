"""The segmented index against BM25 without an index."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioframe.operators import retrieval as V
from folioframe.operators import segments
from folioframe.operators.segments import Segments

FIELDS, WEIGHTS = ["title", "body"], {"title": 2.0}


def table(spark, rows: dict):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, title string, body string")


def some(rng: random.Random, n: int) -> dict:
    words = ["the"] * 20 + ["of"] * 10 + [f"w{k}" for k in range(40)] + ["Rare"]
    text = lambda m: " ".join(rng.choice(words) for _ in range(m))
    return {k: (text(rng.randrange(4)) or None, text(rng.randrange(1, 40))) for k in rng.sample(range(10 * n), n)}


def agree(spark, index, rows, *questions):
    for terms, k in questions:
        got = [(r["id"], r["score"]) for r in index.search("id", terms, k, WEIGHTS).collect()]
        want = [(r["id"], r["score"]) for r in V.bm25_fields(table(spark, rows), "id", FIELDS, terms, k, WEIGHTS).collect()]
        assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


def test_segments_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "FILE", 60)
    monkeypatch.setattr(segments, "SEGMENTS", 3)
    rng = random.Random(2)
    rows, index = some(rng, 120), Segments(spark, f"file://{tmp_path}", "t")
    asked = ((["rare", "the"], 5), (["the", "of", "w3"], 8), (["w1", "rare", "of", "the"], 3), (["the"], 4), (["none"], 3))
    assert index.manifest() is None and index.search("id", ["the"], 3).collect() == []
    assert index.refresh(table(spark, rows), "id", FIELDS) == {"new": 120, "changed": 0, "gone": 0}
    agree(spark, index, rows, *asked)
    # postings are many files, as their number asks for, and a common term lies in several
    files = spark.read.parquet(f"file://{tmp_path}/t_index/postings-0").select("term", F.input_file_name().alias("f"))
    assert files.select("f").distinct().count() > 3 and files.where("term = 'the'").select("f").distinct().count() > 1
    assert index.refresh(table(spark, rows), "id", FIELDS) == {"new": 0, "changed": 0, "gone": 0} and index.manifest()["version"] == 0
    one, other, last = sorted(rows)[:3]
    rows[one] = ("rare words", "the of the")
    assert index.refresh(table(spark, rows), "id", FIELDS) == {"new": 0, "changed": 1, "gone": 0}
    assert spark.read.parquet(f"file://{tmp_path}/t_index/rows-1").count() == 1  # one row was read for words
    agree(spark, index, rows, *asked[:2])
    del rows[other]
    rows[one], rows[100_000] = ("the", "w3"), ("of", None)
    assert index.refresh(table(spark, rows), "id", FIELDS) == {"new": 1, "changed": 1, "gone": 1}
    agree(spark, index, rows, asked[2])
    rows[last] = (None, "rare")
    index.refresh(table(spark, rows), "id", FIELDS)
    # a fourth segment was one too many
    now = index.manifest()
    assert len(now["segments"]) == 1 and not now["stale"] and now["n"] == len(rows)
    agree(spark, index, rows, asked[0])


def test_common_terms_are_read_for_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 50)
    rows = {k: ("the", "the of " * 3 + ("rare " * 5 if k in (7, 444, 821) else "")) for k in range(1000)}
    index = Segments(spark, f"file://{tmp_path}", "t")
    index.refresh(table(spark, rows), "id", FIELDS)
    found = index.search("id", ["rare", "the", "of"], 3)
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(bucket" in plan.replace(" ", "") and [r["id"] for r in found.collect()] == [7, 444, 821]


def test_a_first_index_joins_nothing(spark, tmp_path, monkeypatch):
    """All rows are new then, and none is looked for."""
    rows = some(random.Random(5), 60)
    df, index = table(spark, rows), Segments(spark, f"file://{tmp_path}", "t")
    with monkeypatch.context() as m:
        m.setattr(type(df), "join", lambda *_: 1 / 0)
        assert index.refresh(df, "id", FIELDS) == {"new": 60, "changed": 0, "gone": 0}
    agree(spark, index, rows, (["the", "w3", "rare"], 7))


def test_blocks_are_packed_over_batches():
    """Blocks and postings that go on in later batches are one, whatever the batches' length."""
    rng = random.Random(6)
    words = sorted((rng.choice("abc"), rng.randrange(2), rng.randrange(9), rng.randrange(2)) for _ in range(200))
    want: dict = {}
    for term, bucket, key, f in words:
        want.setdefault((term, bucket), {}).setdefault(key, [0, 0])[f] += 1
    cols = list(zip(*words))
    ints = lambda x: pa.array(x, pa.int32())
    t = pa.table({"term": cols[0], "bucket": ints(cols[1]), "id": cols[2], "dl": ints([k + 5 for k in cols[2]]), "tf0": ints([1 - f for f in cols[3]]), "tf1": ints(cols[3])})
    for size in (1, 7, 50, 200):
        got = [r for b in segments._packed(iter(t.to_batches(size)), "id", ["tf0", "tf1"]) for r in b.to_pylist()]
        assert [(r["term"], r["bucket"]) for r in got] == sorted(want)
        for r in got:
            of = want[r["term"], r["bucket"]]
            assert r["id"] == sorted(of) and r["n"] == len(of) and r["dl"] == [k + 5 for k in sorted(of)] and r["least"] == min(of) + 5
            assert list(zip(r["tf0"], r["tf1"])) == [tuple(of[k]) for k in sorted(of)] and r["top_tf0"] == max(a for a, _ in of.values())
