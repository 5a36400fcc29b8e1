import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from test_operators import T0, make_panel
from test_plans import make_forecast

from tallycast.operators import panel as P
from tallycast.plans import forecast as M
from tallycast.session import materialise
from tallycast.sources import readers, schemas, writers
from tallycast.streaming.buckets import stream_bucket_counts, write_buckets


def test_wide_file_keyed_by_hour(spark, tmp_path):
    f = tmp_path / "flux.csv"
    f.write_text(",date,hr,S1,S2\n0,2020-01-01,0.5,3,\n1,2020-01-01,24.0,5,7.5\n2,2020-01-02,13.5,1,2\n")
    got = readers.wide_counts(spark, str(f), schemas.wide_counts(["S1", "S2"], keyed_by_hour=True), ["S1", "S2"]).toPandas()
    rows = {(str(t), s): y for t, s, y in got.itertuples(index=False)}
    assert rows[("2020-01-01 00:30:00", "S2")] == 0.0 and rows[("2020-01-01 00:00:00", "S2")] == 7.5 and rows[("2020-01-02 13:30:00", "S1")] == 1.0


def test_wide_file_keyed_by_time(spark, tmp_path):
    f = tmp_path / "city.csv"
    f.write_text("time,a,b\n03/01/2024 00:15,1,2\n03/01/2024 00:30,,4\n")
    got = readers.wide_counts(spark, str(f), schemas.wide_counts(["a", "b"]), ["a", "b"], time_format="MM/dd/yyyy HH:mm")
    assert [tuple(r) for r in got.orderBy("ts", "sid").collect()] == [
        (dt.datetime(2024, 3, 1, 0, 15), "a", 1.0), (dt.datetime(2024, 3, 1, 0, 15), "b", 2.0),
        (dt.datetime(2024, 3, 1, 0, 30), "a", 0.0), (dt.datetime(2024, 3, 1, 0, 30), "b", 4.0)]


def test_weather_and_calendar_files(spark, tmp_path):
    w = tmp_path / "w.csv"
    w.write_text(",date,hrr,temp,precip\n1,3/1/2024,0,3.2,0\n2,12/11/2024,23,-2.7,1.5\n")
    assert [tuple(r) for r in readers.weather(spark, str(w), schemas.WEATHER_HOURLY).collect()] == [
        ("2024-03-01", 0, 3.2, 0.0), ("2024-12-11", 23, -2.7, 1.5)]
    c = tmp_path / "c.csv"
    c.write_text("Zone;Population;Annee;Debut;Fin\nParis;-;2019-2020;2020-02-08T00:00:00;2020-02-24T00:00:00\n")
    r = readers.school_calendar(spark, str(c), schemas.SCHOOL_CALENDAR).first()
    assert (r.zone, r.date_from, r.date_to) == ("Paris", dt.date(2020, 2, 8), dt.date(2020, 2, 24))


def test_panel_is_partitioned_by_day_and_pruned(spark, tmp_path):
    p = make_panel(spark, {"a": range(300), "b": range(300)})
    writers.write_panel(p, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 600
    plan = back.filter("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    writers.write_wide_counts(p, str(tmp_path / "w"), ["a", "b"])
    wide = spark.read.option("header", True).csv(str(tmp_path / "w"))
    assert wide.columns == ["ts", "a", "b"] and wide.count() == 300


def test_metrics_of_runs_share_a_table_and_reruns_replace(spark, tmp_path):
    out = str(tmp_path / "m")
    for run, value in (("r1", 1.0), ("r2", 2.0), ("r1", 3.0)):
        writers.write_metrics(spark.createDataFrame([("CRPS", value)], schemas.METRICS), out, "nb_share", run)
    got = spark.read.parquet(out).orderBy("run_id").collect()
    assert [(r.run_id, r["values"]) for r in got] == [("r1", 3.0), ("r2", 2.0)]


def test_forecast_and_parameters_survive_a_round_trip(spark, tmp_path):
    fc, rows = make_forecast(spark)
    writers.write_forecast(fc, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).select(F.sum("y")).first()[0] == sum(r[6] for r in rows)
    writers.write_mean_forecast(fc, str(tmp_path / "mean"), ["s0", "s1", "s2"])
    assert spark.read.option("header", True).csv(str(tmp_path / "mean")).count() == 4
    params = M.nb_moments(M.with_slot(make_panel(spark, {"a": range(200)})))
    writers.save_parameters({"cells": params}, str(tmp_path / "model"))
    loaded = writers.load_parameters(spark, str(tmp_path / "model"), ["cells"])["cells"]
    assert loaded.count() == params.count() and loaded.columns == params.columns


def test_materialise_cuts_lineage(spark):
    df = materialise(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_stream_buckets_equal_batch_buckets(spark, tmp_path):
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(minutes=7 * i)) for i in range(60)]
    schema = "k string, ts timestamp_ntz"
    closing = [("z", T0 + dt.timedelta(days=30))]  # moves the watermark past all of them
    source = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / "1"))
    spark.createDataFrame(closing, schema).coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = write_buckets(stream_bucket_counts(stream, "k"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).filter("sid != 'z'").toPandas()
    want = P.bucket_counts(spark.createDataFrame(rows, schema), "k").toPandas()
    key = lambda d: sorted((s, pd.Timestamp(t).tz_localize(None).isoformat(), n) for s, t, n in d[["sid", "ts", "n"]].itertuples(index=False))
    assert key(got) == key(want)
