"""Running sums against a plain loop."""

import random
from itertools import groupby

from folioframe.operators.running import running
from folioframe.plans.scratch import Scratch


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice((7, 7, 7, 7, rng.randrange(40))), k, rng.randrange(-(2**60), 2**60), rng.randrange(100)) for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, at long, v long, n int").repartition(3)
    got = running(Scratch(spark, "t"), df, "k", ["at"], x=("v", "xor"), s=("n", "sum"), m=("v", "max"), b=("v", "max before"), z=("n", "sum before")).collect()
    want = {}
    for k, group in groupby(sorted(rows), lambda r: r[0]):
        x = s = 0
        m = -(2**63)
        for r in group:
            b, z = m, s
            x, s, m = x ^ r[2], s + r[3], max(m, r[2])
            want[r[1]] = (k, x, s, m, b, z)
    assert {r["at"]: (r["k"], r["x"], r["s"], r["m"], r["b"], r["z"]) for r in got} == want and len(got) == len(rows)
    assert running(Scratch(spark, "t"), df.where("k > 99"), "k", ["at"], s=("n", "sum")).collect() == []
