"""Cases that the third round's review found: one test a finding."""

import math
import re

import duckdb
from pyspark.sql import functions as F

from folioframe.operators import relational as R
from folioframe.plans import ledger_queries as LQ  # noqa: F401
from folioframe.plans import queries as Q


def both(spark, folder, name, tables):
    """Rows of a query and of its SQL over tables given as DataFrames, as text, so that -0.0 isn't 0.0."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = Q.QUERIES[name](spark, str(folder)), con.sql(Q.SQL[name])
    columns = sorted(want.columns)
    return sorted(repr(tuple(r)) for r in got.select(*columns).collect()), sorted(repr(tuple(r)) for r in want.project(", ".join(columns)).fetchall())


def test_snapped_quotes_of_letters_that_fold_to_two(spark, tmp_path):
    said = "Der enieverß miterbechbe. \u00d6\u00e4 enß undachßlich ungeinach. Pfheitpf erßßeit in einen, und so fort. Plain words of one more sentence"
    rows = spark.createDataFrame([(1, 0, "user", said)], "conv_id long, turn int, role string, text string")
    got, want = both(spark, tmp_path, "q_snapped_quotes", {"conversations": rows})
    assert got == want and len(want) == 4


def test_unit_vectors_to_the_bit(spark, tmp_path):
    rows = [(0, [1.0, -1e-7, 1e-7, -0.0]), (1, [0.0, -0.0]), (2, None), (3, []), (4, [3.0, -4.0]), (5, [1.0, 2.5e-6, -2.5e-6])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = both(spark, tmp_path, "q_unit_vectors", {"embeddings": table})
    assert got == want


def test_rounding_as_binary(spark):
    values = [0.5189885, -0.27429749999999997, 0.7380504999999999, -1e-7, 0.49999999999999994e-6, 12.0000005, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(R.rounded_binary(F.col("x"), 6)).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want)) and math.copysign(1, got[3]) < 0


def test_alike_people_meet_in_shares(spark):
    from folioframe.operators import identity as I

    names = ["Anna Bergmann", "Anna Bergman", "Carl Ohm", "Zoe"]
    rows = [(f"p{i}@d{i % 3}.example", names[i % 4 if i < 40 else 0]) for i in range(60)]
    people = spark.createDataFrame(rows, "person string, canonical string")
    want = {(a, b, x == y) for a, x in rows for b, y in rows if a < b and a.split("@")[1] != b.split("@")[1] and len(x.split()) > 1 and (x == y or {x, y} == {"Anna Bergmann", "Anna Bergman"})}
    out = I.similar_pairs(people, share=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin"  # no table of people is broadcast
    got = out.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_domain_in_parts(spark, tmp_path):
    from folioframe.operators import identity as I
    from folioframe.plans.scratch import Scratch

    seen = [(f"a{i}@in.example", n) for i, n in enumerate(["Anna Bergmann", "Carl Ohm", "Anna Bergman", None, "C. Ohm", "Carl Ohm"] * 20)] + [("a0@in.example", "Carl Ohm"), ("dora.berg@in.example", None), ("x@in.example", "Dora Berg")]
    emails = spark.createDataFrame([(a, n, []) for a, n in seen], "from_addr string, from_name string, to_named array<struct<name:string,addr:string>>")
    named = I.addresses(emails).toPandas()
    want = sorted(map(tuple, I._same_domain(named).to_numpy()))
    assert sorted(map(tuple, I.local_people(Scratch(spark, "t"), emails).collect())) == want


def test_large_domain_of_few_names():
    import time
    from hashlib import md5

    import pandas as pd

    from folioframe.operators import identity as I

    n = 30000
    rows = pd.DataFrame([(f"c{i:05}@in.example", "{0:.9} {0:.18}".format(md5(b"%d" % (i % 60)).hexdigest()), 1) for i in range(n)], columns=["addr", "name", "n"])
    start = time.perf_counter()
    assert I._same_domain(rows)["person"].nunique() == 60
    assert time.perf_counter() - start < 15  # with a scan a merge it took four times as long for twice the rows


def test_steps_of_a_graph_are_wide(spark):
    from folioframe.operators.graph import components
    from folioframe.plans.scratch import WIDE, Scratch

    seen, plain = [], {k: spark.conf.get(k, None) for k in WIDE}

    class Watched(Scratch):
        def write(self, df, compression="zstd", wide=False):
            with self._released(wide):
                seen.append({k: spark.conf.get(k, None) for k in WIDE})
            return super().write(df, compression, wide)

    out = components(Watched(spark, "t"), spark.range(1, 200).selectExpr("id a", "id div 2 b"))
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(200)}
    assert seen and all(s == WIDE for s in seen) and {k: spark.conf.get(k, None) for k in WIDE} == plain


def test_long_texts_cross_in_small_batches(spark, monkeypatch):
    from folioframe.plans.scratch import Scratch

    size = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    rows = Scratch(spark, "t").write(spark.range(0, 1000, 1, 1).select(size("id").alias("n")), small=True)
    assert rows.agg(F.max("n")).first()[0] <= 128
    asked = []
    monkeypatch.setattr(Scratch, "write", lambda self, df, *a, **k: asked.append(k.get("small")) or df)
    for name in ("q_passages", "q_page_text"):
        Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [True, True]


def test_stretches_of_many_subjects_share_a_group(spark, tmp_path, monkeypatch):
    """A call to Python for each subject took most of the time; what is followed together gives what each alone gave."""
    from folioframe.operators import threads as TH

    real = TH._follow
    rows = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", "x") for c in range(40) for t in range(1 + c % 9)], "conv_id long, turn int, role string, text string")

    def counted(key, table):
        open(f"{tmp_path}/{len(key)}-{key[0]}", "w").close()
        return real(key, table)

    monkeypatch.setattr(TH, "_follow", lambda key, table: counted(key, table))  # by value, so that workers call this
    (tmp_path / "t").mkdir()
    got, want = both(spark, tmp_path / "t", "q_reply_threads", {"conversations": rows})
    assert got == want and len(want) == 40
    calls = [p for p in tmp_path.iterdir() if p.is_file()]
    assert 1 <= len(calls) <= 8
