import zlib

import numpy as np

from tallycast.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fixed_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op6(spark, SF).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.97
    assert (Q.op6(spark, SF).toPandas().sort_values("doc_id").score.to_numpy() == got.sort_values("doc_id").score.to_numpy()).all()


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = Q.fit(docs, labels), Q.fit(docs, wrong)
    assert (a.weights == b.weights).all() and (a.scale, a.shift) == (b.scale, b.shift)


def test_odd_rows(spark):
    rows = [(1, "fine words here", 5.0, "x"), (1, "fine words here", 5.0, "x"), (2, None, 5.0, "x"), (3, "", 5.0, "x"), (None, "w " * 50_000, 5.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    got = Q.classify(docs, labels).toPandas()
    assert len(got) == 5 and got.score.notna().all() and got[got.doc_id == 1].score.nunique() == 1
    none = Q.classify(docs, labels.filter("false")).toPandas()
    assert np.allclose(none.score, 0.5)
    assert Q.classify(docs.filter("false"), labels).count() == 0
    kept = Q.accepted_documents(docs, labels.filter("false"))
    assert kept.columns == docs.columns and kept.count() == 5


def test_dual_descent_meets_the_optimum_conditions():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 80)
    rows = [np.unique(rng.integers(0, 40, 12) + 20 * y) for y in labels]
    ratios = Q.log_count_ratios(rows, labels)
    Q_EPOCHS, Q.EPOCHS = Q.EPOCHS, 500
    try:
        weights, bias = Q.dual_descent(rows, labels, ratios)
    finally:
        Q.EPOCHS = Q_EPOCHS
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    cost = 0.5 / share[labels]
    values = [ratios[r] / np.sqrt(ratios[r] @ ratios[r]) for r in rows]

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - (2 * y - 1) * (w[r] @ v + b)) for r, v, y, c in zip(rows, values, labels, cost))

    best = loss(weights, bias)
    for _ in range(50):
        noise = rng.standard_normal(60) * 0.01
        other = weights.copy()
        other[:60] += noise
        assert loss(other, bias + noise[0]) >= best - 1e-3


def test_features_mark_repeats_and_capitals():
    assert len(Q.features(None)) == len(Q.features(" ")) == 0
    same, other = Q.features("go go go"), Q.features("go to it")
    assert set(same) != set(other)
    assert set(Q.features("The cat")) != set(Q.features("THE CAT"))
