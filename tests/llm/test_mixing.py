import random

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tallycast.llm import mixing as M


def rows(n=400):
    rng = random.Random(5)
    names = ["b", "B", "a", "é", None, "", "zz"]
    out = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), names[min(6, int(rng.expovariate(0.7)))], "x") for i in range(n)]
    out += [(None, "no id here", "a", "x"), (7, None, "a", "x"), (8, "", "only empty", "x"), (9, " \t\n\x0b\x0c\r ", "a", "x"), (10, "x\x85y z w", "a", "x")]
    return out + out[:5]


@pytest.mark.parametrize("count", [400, 0, 3])
def test_equal_to_sql_on_odd_rows(spark, count):
    import duckdb

    data = rows(count) if count else []
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    frame_ = df.toArrow()
    con = duckdb.connect()
    con.register("frame_", frame_)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM frame_")
    sql = f"SELECT * REPLACE (CAST(doc_id AS VARCHAR) AS doc_id) FROM ({M.OP4_SQL})"
    assert compare(spark, con, "op4", "", lambda s, f: M.mix(df).withColumn("doc_id", F.col("doc_id").cast("string")), sql) is None


def test_taken_comes_near_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(3000), "doc_id long, text string, source string, size string")
    got = M.mix(df).toPandas()
    again = M.mix(df.repartition(5)).toPandas()
    by = got.groupby(["source_size", "target"], as_index=False).agg(taken=("taken", "sum"), size=("size", "sum"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.largest).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (got.taken <= 3 * got["size"]).all()
    key = lambda f: sorted(zip(f.doc_id.fillna(-1), f["size"], f.taken))
    assert key(got) == key(again)


def test_thresholds_refine_through_all_levels(spark):
    same = [("s", (5 << 48) + h, 10) for h in (0, 1, 2, 3)]
    df = spark.createDataFrame(same, "source string, hash long, size long")
    for budget, want in ((0.5, (5 << 48)), (5.0, (5 << 48) + 1), (14.0, (5 << 48) + 1), (16.0, (5 << 48) + 2), (39.0, (5 << 48) + 4)):
        got = M.hash_thresholds(df, spark.createDataFrame([("s", budget)], "source string, budget double")).collect()
        assert [(r.source, r.threshold) for r in got] == [("s", want)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows(50), "doc_id long, text string, source string, size string")
    plan = M.sized(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_small_tables(spark):
    assert compare(spark, duck("/root/testdata/sf0.001"), "op4", "/root/testdata/sf0.001", M.op4, M.OP4_SQL) is None
