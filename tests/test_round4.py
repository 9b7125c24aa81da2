"""Cases that the fourth round's review found: one test a finding."""

import pytest
from test_round3 import both


def test_snapped_quotes_of_a_sentence_said_twice(spark, tmp_path):
    """Sentences that differ by case alone, or of which one ends another, are told apart by the quote as it stands."""
    said = "And ththble nd inginth, thes anrent lyou.\nThe to thsh ha ane. Nd inginth, thes anrent lyou. The rest of end inginth, thes anrent lyou. nd inginth, thes anrent lyou"
    rows = spark.createDataFrame([(1, 0, "user", said)], "conv_id long, turn int, role string, text string")
    got, want = both(spark, tmp_path, "q_snapped_quotes", {"conversations": rows})
    assert got == want and len(want) == 4


@pytest.mark.parametrize("strict", ["true", "false"])
def test_extracted_records_of_a_long_conversation(spark, tmp_path, strict):
    """Turns from the 25th on have no valid time, and so came first, where casts aren't strict; where they are, the query failed."""
    said = lambda c, t: {0: "So be it. Then", 1: "Not so. But", 24: "So be it and not so. Or"}.get(t, f"Word {c} of {t}. End")
    rows = spark.createDataFrame([(c, t, "user", said(c, t)) for c in (1, 2) for t in range(30 if c == 1 else 3)], "conv_id long, turn int, role string, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", strict)
    try:
        got, want = both(spark, tmp_path, "q_extracted_records", {"conversations": rows})
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want and len(want) == 4


def _written(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_people_of_a_name_travel_to_few_shares(spark):
    """A person went to every share of the name, and their number grew with it, so what was moved grew with its square."""
    from folioframe.operators import identity as I

    rows = [(f"p{i}@d{i % 3}.example", "Anna Bergmann" if i % 4 else "Anna Bergman") for i in range(400)]
    people = spark.createDataFrame(rows, "person string, canonical string")
    want = {(min(a, b), max(a, b), x == y) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if a.split("@")[1] != b.split("@")[1]}
    before = _written(spark)
    got = I.similar_pairs(people, share=1).collect()
    moved = _written(spark) - before
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert moved < 20 * len(rows)
    got = I.similar_pairs(people, share=1, most=20).collect()  # what a task holds stays bounded
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_people_of_one_name_travel_to_few_shares(spark):
    from folioframe.operators import identity as I

    rows = [(f"p{i}@{'in' if i % 5 < 3 else f'd{i % 2}'}.example", "Carl Ohm") for i in range(400)]
    people = spark.createDataFrame(rows, "person string, canonical string")
    want = {(min(a, b), max(a, b), True) for k, (a, _) in enumerate(rows) for b, _ in rows[:k] if a.split("@")[1] != b.split("@")[1]}
    before = _written(spark)
    got = I.similar_pairs(people, share=1).collect()
    moved = _written(spark) - before
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert moved < 20 * len(rows)


def test_clusters_of_near_pairs_with_several_entities():
    """Weights of entities are summed at once for all clusters near a merged one; the clusters are those of the table of all pairs."""
    import numpy as np
    from folioframe.operators import cluster as C

    rng = np.random.default_rng(4)
    for n in (2, 40, 300):
        vec = rng.normal(size=(n, 8))
        vec[::3] = vec[0] + rng.normal(size=vec[::3].shape) * 0.1
        vec = [None if k % 37 == 5 else list(v) for k, v in enumerate(vec)]
        people = [[f"p{k % 7}"] if k % 4 else [] for k in range(n)]
        entities = [None if k % 11 == 3 else [f"e{k % 5}", f"e{k % 9}", None][: k % 4] for k in range(n)]
        assert C.agglomerate_near(vec, people, entities, 0.5) == C.agglomerate(*C.similarities(vec, people, entities), 0.5)
