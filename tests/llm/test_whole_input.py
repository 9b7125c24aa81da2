"""The ten operators over the whole of their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import quality


def test_quality_exchange_grows_with_the_input(spark):
    n = 20_000
    good = F.col("id") % 2 == 1
    text = F.when(good, F.concat(F.lit("Fine words stand here in row "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("BUY!!! NOW!!! BUY!!! "), F.col("id").cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(good, "a").otherwise("b").alias("source"), F.lit("en").alias("lang"), F.length(text).alias("n_chars"))
    model = quality.train(docs, docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    # five rounds of a tenth for each view, or more where both label the same rows
    assert sum(model.taught) > 12_000


@pytest.mark.parametrize("fan", [64, 2])
def test_quality_sums_as_one_fit(spark, monkeypatch, fan):
    monkeypatch.setattr(quality, "FAN", fan)
    rng = np.random.default_rng(1)
    x, draw = rng.random((300, quality.PACKED)), rng.random(300)
    x[:, -3], x[:, -2], x[:, -1] = rng.integers(-1, 5, 300), rng.integers(-1, 3, 300), draw
    packed = spark.createDataFrame([(bytearray(p.tobytes()),) for p in np.array_split(x, 7)], "v binary").repartition(7)
    inputs = [quality._wide(x[:, : quality.TEXT_FEATURES]), quality._unpacked_meta(x)]
    y = (x[:, 0] + 0.2 * rng.random(300) > 0.6).astype(float)
    train = [(v[:100], y[:100]) for v in inputs]
    views = [quality.Logistic(*t) for t in train]
    pool = quality.Pool(packed)
    assert pool.label(views)
    taught = quality._replayed(pool.rounds, inputs, draw)
    for v, (a, b), t in zip(quality._fitted(train, pool, views), train, taught):
        k = t >= 0
        of = inputs[0] if a.shape[1] == inputs[0].shape[1] else inputs[1]
        whole = quality.Logistic(np.vstack((a, of[k])), np.concatenate((b, t[k])), np.concatenate((np.ones(100), np.full(k.sum(), quality.TAUGHT))))
        assert np.abs(whole.margin(of) - v.margin(of)).max() < 1e-4
