import re

import corpus_pipeline
import numpy as np

from tallycast.llm import mixing, simhash
from tallycast.llm.queries import ORACLES, QUERIES, load
from tallycast.session import materialise

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    load()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_on_odd_rows_keep_columns_and_take_effect(spark):
    long = " ".join(f"word{i} and" for i in range(200))
    rows = [(1, long, "en", "a", 1, "x"), (2, long, "en", "a", 1, "x"), (2, long, "en", "a", 1, "x"), (None, None, None, None, None, None), (4, "", "en", None, 0, "x"),
            (5, long.replace("word", "other"), "en", "b", 1, "x"), (5, "a second text of the same id", "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "5", "5", "None"]  # null and empty texts are one group, a null id is the least
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontamination, corpus_pipeline.mixing):
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.filter("false"), SF).count() == 0
    mixed = corpus_pipeline.mixing(spark, docs, SF).toPandas()
    want = mixing.mix(docs).toPandas()
    assert mixed.text.fillna("").str.split().str.len().sum() == want.taken.sum()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert len(got) == counts[-1]
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1].tolist()]
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_near_duplicate_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    prints = np.array([simhash.fingerprint(t) for t in docs.text], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    label = np.arange(len(docs))
    for _ in range(len(docs)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    order = docs.doc_id.to_numpy()
    want = sorted(order[label == k].min() for k in np.unique(label))
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert sorted(r.doc_id for r in got.collect()) == want
