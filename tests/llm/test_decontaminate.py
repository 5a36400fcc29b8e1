import hashlib
import random
import re

import duckdb
import pytest
from compare import compare
from pyspark.sql import functions as F

from tallycast.llm import decontaminate as D

DOCS = "doc_id long, text string, n_words string, pid string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, n=13):
    windows = []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            windows += [(i, w[s : s + n]) for s in range(max(1, len(w) - n + 1))]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in windows:
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def collected(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "é", "a1", "zz", "rare", "中文", "x"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, some(30)), (2, some(14)), (10, some(13)), (3, "The, of"), (4, "zz"), (5, ""), (6, None), (None, some(20)), (7, "missing words only here")]
    items += [(8, items[0][1]), items[1]]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[0][1].upper()), (4, items[0][1] + " tail " + items[0][1]), (5, "pre " + items[1][1].replace(" ", "-, ")), (None, items[2][1]), (None, None)]
    for i in range(60):
        a = rng.choice([t for _, t in items if t])
        docs.append((100 + i, some(rng.randrange(40)) + " " + a + " " + some(rng.randrange(200))))
    return docs + docs[4:7], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_and_sql(spark, seed):
    docs, items = cases(seed)
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, n string")
    got = D.decontaminate(df, bench)
    assert collected(got) == brute(docs, items)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    con.register("benchmark", bench.toArrow())
    text = lambda f: f.withColumn("doc_id", F.col("doc_id").cast("string"))
    sql = f"SELECT * REPLACE (CAST(doc_id AS VARCHAR) AS doc_id) FROM ({D.OP3_SQL})"
    assert compare(spark, con, "op3", "", lambda s, f: text(got), sql) is None
    kept = sorted((str(r.doc_id), str(r.text)) for r in D.clean_documents(df, bench).collect())
    bad = {r[0:2] for r in brute(docs, items) if r[5]}
    assert kept == sorted((str(d), str(t)) for d, t in docs if (str(d), len(words(t))) not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontaminate(none, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "", "")], DOCS)
    assert collected(D.decontaminate(docs, bench.filter("false"))) == brute([(1, "a b c")], [])


def test_proximity(spark):
    docs = [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma BETA, alpha"), (4, "alpha beta"), (5, None)]
    items = [(7, "Alpha the beta of gamma"), (8, "unknown"), (None, "alpha")]
    filler = [(100 + i, "the of the of x x") for i in range(5)]
    got = D.proximity_matches(spark.createDataFrame(docs + filler, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, 6)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, "7"), (3, "7")]


def test_plans_have_no_python(spark):
    docs, items = cases(3)
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
