"""Trained operators on held-out rows, mixing, vectors and the pipeline, against brute force."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import licenses, mixing, pii, quality, toxicity, vectors
from folioframe.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += rest * w[s] / total
        rest = 0.0
        for s in list(free):
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "B", "é", None, "z", "a", "a"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "only empty"), (None, "x y z", "b"), (5, "x y", "b"), (902, "tiny", "0tiny"), (903, "big " * 4000, "z")]
    got = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[s] for r in own)
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
    assert mixing.mix(frame(spark, [])).collect() == []


def test_mixing_stage(spark):
    """Rows come as often as the mix takes them, each for itself; nulls, repeats and clashing names do no harm."""
    rows = [(i, f"w{i} " * (i % 7), "a" if i % 3 else "b") for i in range(60)] + [(1, "other text of one", "a"), (None, "no id", "a"), (None, "no id either", "b"), (None, None, None), (7, "", "a")]
    rows += [(99, "the same row", "b")] * 5
    docs = frame(spark, rows).withColumn("copies", F.lit("x")).withColumn("_h", F.lit("y")).withColumn("h", F.lit(1))
    got = mixing.stage(spark, docs, "")
    assert got.columns == docs.columns
    want: dict = {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"], r["source"]] = want.get((r["doc_id"], r["size"], r["source"]), 0) + r["copies"]
    told: dict = {}
    for r in got.collect():
        key = (r["doc_id"], len((r["text"] or "").split()), r["source"])
        told[key] = told.get(key, 0) + 1
    assert told == {k: n for k, n in want.items() if n}
    assert mixing.stage(spark, docs.limit(0), "").collect() == []


def test_pivotal_keeps_sums_and_means():
    p, size = np.full(40, 0.3), np.arange(1.0, 41.0)
    total = np.zeros(40)
    for k in range(2000):
        q = mixing.pivotal(p, size, np.random.default_rng(k))
        between = (q > 1e-9) & (q < 1 - 1e-9)
        assert between.sum() <= 1 and abs((q * size).sum() - (p * size).sum()) < 1e-6
        total += q
    assert np.abs(total / 2000 - 0.3).max() < 0.06


def test_reduction_tree(spark):
    rows = spark.range(3000).selectExpr("id h", "1L + id % 50 size", "0.4D p", "cast(id % 3 = 0 as string) source")
    got = mixing.dependent_round(Scratch(spark, "t"), rows, "source", 16).toPandas()
    assert set(got.p) <= {0.0, 1.0} and len(got) == 3000
    for _, g in got.groupby("source"):
        assert abs((g.p * g["size"]).sum() - 0.4 * g["size"].sum()) <= 50


# ---------------------------------------------------------------- toxicity


def test_cumulative_links_learn_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 6)).astype(float)
    score = x @ np.array([2.0, 1.0, 0.5, 0, 0, -1.0]) + rng.logistic(size=3000) * 0.5
    y = np.digitize(score, [0.8, 1.8, 2.8])
    w, cut = toxicity.fit_cumulative(x[:2000], y[:2000])
    assert (np.diff(cut) >= 0).all() and w[0] > w[1] > w[2] > w[5]
    e = toxicity.expected_severity(x[2000:] @ w, cut)
    assert np.corrcoef(e, y[2000:])[0, 1] > 0.7


def test_toxicity(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["the", "of", "plan", "tree", "river", "stone"]) + rng.choice("abcdefgh") for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, clean() + (" You STUPID, moron! " if bad else " ") + clean(), "s"))
        labels.append((i, 1, int(bad)))
    docs, known = frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] < 200] + [(0, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    extra = frame(spark, [(1000, None, "s"), (1001, "", "s"), (None, "moron stupid", "s"), (1002, "stupidity " + "tree " * 30000, "s")])
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r for r in toxicity.score(docs.unionByName(extra), model).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(300))
    assert not got[1000]["toxic"] and not got[1001]["toxic"] and got[None]["toxic"]
    kept = toxicity.score(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == 240
    none = toxicity.train(docs, known.limit(0))
    assert not toxicity.score(docs, none).where("toxic").count()
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_is_not_fitted_by_the_driver(spark, monkeypatch):
    """Labelled rows and the fit's matrices stay on the executors; the driver gets the words' hashes and the model."""

    def never(*_):
        raise AssertionError("fitted by the driver")

    collected, to_arrow = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(toxicity, "fit_sparse", never)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: collected.append(self.columns) or to_arrow(self))
    docs = frame(spark, [(i, "fine words here" + (" you moron" if i % 4 == 0 else " again"), "s") for i in range(120)])
    known = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in got) and collected == [["h"]]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = toxicity.train(docs, labels.where(fold != 0))
    out = toxicity.score(docs, model).withColumnRenamed("toxic", "flag").join(labels.where(fold == 0), "doc_id").groupBy("toxic").agg(F.avg(F.col("flag").cast("int")).alias("r")).collect()
    rate = {r["toxic"]: r["r"] for r in out}
    assert rate[0] < 0.01 and rate[1] > 0.75


# ---------------------------------------------------------------- quality


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = quality.train(docs, labels.where(fold != 0))
    assert sum(model.taught) > 0
    out = quality.score(docs, model).withColumnRenamed("quality", "q").join(labels.where(fold == 0), "doc_id")
    right = out.agg(F.avg((F.col("good") == (F.col("quality") == 1)).cast("int")).alias("a")).first()["a"]
    assert right > 0.97


def test_quality_awkward(spark):
    rows = [(i, "Fine words stand here in a row." if i % 2 else "BUY!!! NOW!!! " * 9, "s") for i in range(60)] + [(100, None, None), (101, "", None), (None, "x" * 50000, "s")]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") == 3, None).otherwise(F.col("n_chars")))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 63 and all(got[i]["good"] == (i % 2 == 1) for i in range(40, 60))
    flat = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert len(flat) == 63
    assert quality.score(docs.limit(0), quality.train(docs, labels)).collect() == []


# ---------------------------------------------------------------- licences


def test_licenses(spark):
    rows = [(1, "The license plate was lost.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software", "s"), (2, None, "s"), (None, "Licensed under CC BY-SA 4.0", "s"), (3, "a copyright dispute went on", "s"), (4, "", "s"), (5, "Some words.\n" * 2000 + "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "s"), (5, "Released under the MIT License. and more words follow here", "s")]
    model = licenses.train(frame(spark, rows))
    assert model.held_out > 0.97
    got = sorted(((r["doc_id"] or 0), r["paragraph"], r["family"], r["confirmed"]) for r in licenses.scan(frame(spark, rows), model).collect())
    assert got == [(0, 0, "cc-by-sa", True), (1, 1, "mit", True), (5, 0, "mit", True), (5, 2000, "apache-2.0", True)]
    assert licenses.scan(frame(spark, []), licenses.train(frame(spark, []))).collect() == []


def test_licenses_of_very_many_paragraphs(spark):
    # each paragraph holds a cue; the text of one must not travel with every paragraph
    model = licenses.Model([])
    text = "\n\n".join([f"item 1.0 of {k}" for k in range(50_000)] + ["Released under the MIT License."])
    got = licenses.scan(frame(spark, [(1, text, "s")]), model).collect()
    assert [(r["paragraph"], r["family"]) for r in got if r["confirmed"]] == [(100_000, "mit")]


def test_licence_units_as_plain_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["mit word", "1\x01", "x", "\n", "\n", " \t", "\r\n", "a b"]) for _ in range(rng.randrange(40))) for _ in range(120)] + ["", "\n\n", "mit\n\n", None]
    got = licenses.units(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", ["mit"])
    want = []
    for k, t in enumerate(texts):
        at = 0
        for part, gap in zip(re.split(r"\n(?:[ \t\r]*\n)+", t or ""), [*re.findall(r"\n(?:[ \t\r]*\n)+", t or ""), ""]):
            lines = part.split("\n")
            units = [(at, True, part)] + [(at + n, False, line) for n, line in enumerate(lines) if len(lines) > 1]
            words = [(line, whole, re.findall(licenses.WORD, u.lower())) for line, whole, u in units]
            want += [(k, at, line, whole, w) for line, whole, w in words if "mit" in w]
            at += part.count("\n") + gap.count("\n")
    assert sorted((r["id"], r["_par"], r["paragraph"], r["whole"], r["w"]) for r in got.collect()) == sorted(want)


def test_licenses_as_plain_python(spark):
    model = licenses.Model(["some plain words stand here"])
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.ORDINARY)
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, [(i, t, "s") for i, t in enumerate(lines)]), model).collect()}
    for i, t in enumerate(lines):
        x = np.zeros(len(model.grams))
        x[[model.grams.index(g) for g in licenses.grams(t) if g in model.grams]] = 1
        p = model._softmax(((x @ model.w + model.b) / model.temperature)[None])[0]
        family = model.classes[int(p.argmax())]
        if family != licenses.UNKNOWN and p.max() >= model.least:
            assert got[i]["family"] == family and abs(got[i]["probability"] - p.max()) < 1e-3
        else:
            assert i not in got


def test_licenses_by_paragraph(spark):
    """A notice wrapped over lines is judged as one, and stands for its lines; each line is judged too."""
    wrapped = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [(1, f"Some first line.\nAnd another.\n\n{wrapped}\n\nThe end of it.", "s"), (2, "Released under LGPL v2.1.", "s"), (3, "x\n \t\n\nDistributed under the AGPL-3.0.\nplain words", "s"), (4, "\n\n", "s"), (5, "Available under the BSD 3-Clause terms.", "s")]
    got = {(r["doc_id"], r["paragraph"], r["family"]): r["confirmed"] for r in licenses.scan(frame(spark, rows), licenses.Model([])).collect()}
    assert got[1, 3, "gpl-3.0"] and sum(k[0] == 1 for k in got) == 1
    assert (2, 0, "lgpl") in got and (3, 3, "agpl") in got and (5, 0, "bsd") in got


def test_no_notice_without_a_cue():
    """The filter before the classifier drops nothing that it could accept."""
    model = licenses.Model([])
    rng = random.Random(6)
    gone = [k for k, g in enumerate(model.grams) if not set(g.split(" ")) & set(model.cues)]
    tries = [gone] + [rng.sample(gone, rng.randrange(1, len(gone))) for _ in range(300)]
    # for each family, the best that grams without a cue can do
    tries += [[k for k in gone if model.w[k, f] > 0] for f in range(len(model.classes) - 1)]
    for some in tries:
        x = np.zeros(len(model.grams))
        x[some] = 1
        p = model._softmax(((x @ model.w + model.b) / model.temperature)[None])[0]
        assert p[:-1].max() < model.least


# ---------------------------------------------------------------- vectors


def vector_rows(seed=0, n=240):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 8))
    rows = []
    for i in range(n):
        v = base[i % 6] + rng.standard_normal(8) * rng.choice([0.01, 0.12, 0.3, 1.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] + [0.0] * 6, 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] * 8, 2), (1005, rows[0][1], None), (1006, rows[0][1], 0), (1007, rows[0][1], 0), (1008, [x * 2 for x in rows[0][1]], 0), (1009, [], 1), (1010, [1.0, 2.0], 1), (1050, [0.5] * 8, 2)]
    return rows


EMB = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("leaf, chunk", [(512, 2048), (16, 2048), (64, 8)])
def test_near_duplicates(spark, monkeypatch, leaf, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rows = vector_rows()
    good = {i: (np.array(v, float) / np.linalg.norm(v), l) for i, v, l in rows if usable(v) and l is not None}
    pairs = [(a, b) for a, (x, l) in good.items() for b, (y, m) in good.items() if a != b and l == m and len(x) == len(y) and x @ y >= 0.98]
    df = spark.createDataFrame(rows, EMB).withColumn("x", F.lit(1)).withColumn("rid", F.lit("c"))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, leaf_rows=leaf).collect()}
    assert set(got) == {i for i, _, _ in rows}
    links = sum(r["n_links"] for r in got.values())
    assert links <= len(pairs) and links >= 0.9 * len(pairs)
    if leaf == 512 or chunk == 8 and leaf >= 64:
        deg = {i: 0 for i in got}
        for a, _ in pairs:
            deg[a] += 1
        at = {i: i for i in got}
        for _ in range(20):
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        assert {i: r["n_links"] for i, r in got.items()} == deg and {i: r["component_id"] for i, r in got.items()} == at
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], EMB)).collect() == []


def test_top_k(spark, monkeypatch):
    rows = vector_rows(1) + [(i, [0.01 * (i % 4)] * 8, 0) for i in range(300, 340)]
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i in (i for i in q if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    for bucket in (4096, 24):
        monkeypatch.setattr(vectors, "BUCKET", bucket)
        got = vectors.top_k(spark.createDataFrame(rows, EMB), F.col("vec_id") % 50 == 0).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.top_k(spark.createDataFrame([], EMB), F.col("vec_id") % 50 == 0).collect() == []


def test_search_prunes_only_what_cannot_win():
    rng = np.random.default_rng(5)
    for _ in range(50):
        c, q = rng.integers(-50, 50, (200, 6)), rng.integers(-50, 50, (4, 6))
        cn, qn = np.sqrt((c * c).sum(1).astype(float)), np.sqrt((q * q).sum(1).astype(float))
        order = np.argsort(-cn)
        c, cn = c[order], cn[order]
        score = q @ c.T
        theta = np.sort(score, 1)[:, -5].astype(float)
        i, j, s = vectors._search(np.arange(4) + 1000, q, qn, theta, np.arange(200), c, cn, 5)
        for k in range(4):
            best = sorted(((-score[k, x], x) for x in range(200)))[:5]
            assert sorted(zip(-s[i == k], j[i == k]))[:5] == best


# ---------------------------------------------------------------- pipeline


def awkward_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns named as those within the operators."""
    texts = [" ".join(random.Random(i).choices([f"w{k}" for k in range(97)], k=40)) for i in range(20)]
    fine = texts.__getitem__
    rows = [(i, fine(i), "s") for i in range(20)] + [(30, fine(3), "t"), (31, fine(3) + " more", None), (2, fine(2), "s"), (2, fine(9) + " x y z", "s"), (40, None, "s"), (41, "", None), (42, " \n", "s"), (43, "one two", "s"), (44, "ONE  two", "s"), (None, fine(5), "s"), (None, None, None), (45, "long " * 30000, "s"), (46, "mail a@b.cd from 10.0.0.1 é", "s")]
    return frame(spark, rows).withColumns({n: F.lit("z") for n in ("sid", "n", "pii", "h", "copies", "y", "tokens", "component_id", "d")}), rows


def test_stages_with_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    from folioframe.llm import jaccard, pieces

    docs, rows = awkward_docs(spark)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(20)] + [(40, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    d = str(tmp_path)
    told = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in df.collect()))
    every = told(docs)
    # no label tells on any word here, so nobody is toxic but by the words that toxic rows alone share
    kept = stages["toxicity"](spark, docs, d)
    assert kept.columns == docs.columns and set(told(kept)) <= set(every)
    assert {r for r in every if r[3] or not r[2].strip()} <= set(told(kept))
    # of equal and near texts the least id stays with all its rows; empty ones and rows without an id stay
    alone = stages["ngram_jaccard"](spark, docs, d)
    ids = [r["doc_id"] for r in alone.collect()]
    assert alone.columns == docs.columns and not {30, 31, 44} & set(ids) and {3, 40, 41, 42, 43, 45} <= set(ids) and ids.count(2) == 3 and ids.count(None) == 2
    reps = {r["doc_id"] for r in jaccard.join(docs).where("doc_id = component_id").collect()}
    assert {i for i in ids if i is not None} == reps
    masked = stages["pii"](spark, docs, d)
    assert masked.columns == docs.columns and [r["text"] for r in masked.where("doc_id = 46").collect()] == ["mail <email> from <ip> é"]
    assert [r for r in told(masked) if r[1] != 46] == [r for r in every if r[1] != 46]
    coded = stages["sentencepiece"](spark, docs, d)
    assert coded.columns == ["doc_id", "tokens", "n_tokens", "ids_sha256", "restored"] and coded.count() == len(rows) and coded.where("not restored").count() == 0
    assert coded.where("tokens is null").count() == sum(t is None for _, t, _ in rows)
    p = pieces.vocabulary(pieces.model_path(), "bpe")
    want = {i: p.encode([t.encode()])[0].tolist() for i, t, _ in rows if t is not None and i not in (None, 2)}
    assert {r["doc_id"]: list(r["tokens"]) for r in coded.where("tokens is not null and doc_id is not null and doc_id <> 2").collect()} == want
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), d).collect() == [], name



@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "pii", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "stages")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], SF)))
    clean, alone, masked, mixed, coded = seen[1:]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert 0 < clean.count() <= docs.count()
    from folioframe.llm import jaccard

    assert alone.count() == jaccard.join(clean).where("doc_id = component_id").count()
    assert masked.count() == alone.count() and pii.find(masked).where(F.exists("pii", lambda x: x["kind"] == "email")).count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert coded.count() == mixed.count() and coded.where("not restored").count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == coded.columns and run.count() == coded.count()
