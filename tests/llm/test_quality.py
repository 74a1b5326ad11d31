import numpy as np
from pyspark.sql import functions as F

from quotalake.llm import quality
from quotalake.llm.queries import op2_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found.predicted == found.quality).mean() > 0.95
    assert (found.predicted[found.quality == 0] == 0).mean() > 0.9


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fold = quality.fold(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, x, fold != 1) for x in (labels, turned))
    assert one.prior == two.prior and all((a == b).all() for a, b in zip(one.layers, two.layers))


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(quality.class_prior(positive, mixed) - 0.7) < 0.06


def test_risk_learns_without_negatives():
    rng = np.random.default_rng(1)
    d = quality.N_FEATURES
    good, bad = rng.normal(0.5, 1, (1500, d)), rng.normal(-0.5, 1, (1500, d))
    model = quality.fit_rows(good[:700], np.concatenate([good[700:1400], bad[:500]]))
    assert 0.5 < model.prior < 0.75
    assert (model.logit(good[1400:]) > 0).mean() > 0.9 and (model.logit(bad[500:]) < 0).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)] + [(20, 0, 0), (21, None, 1), (None, 1, 0), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    fold = quality.fold(F.col("doc_id"))
    held = F.coalesce(fold == 1, F.lit(False))
    rows = quality.quality_scores(odd_docs, labels, fold != 1, held).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = quality.quality_scores(odd_docs, labels.where("false"), fold != 1, held).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.quality_scores(no_docs, labels, fold != 1, held).count() == 0
