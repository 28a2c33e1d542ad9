"""Streaming jobs on directory tables, over restarts, and with nothing to read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assaylake.streaming import jobs as j

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, value double"


def rows(spark, numbers):
    return spark.createDataFrame([(n, START + timedelta(minutes=n), float(n)) for n in numbers], SCHEMA)


def test_directory_table_and_restart(spark, tmp_path):
    table = f"{tmp_path}/events.parquet"
    rows(spark, range(9)).repartition(3).write.parquet(table)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for expected in (9, 9, 12):
        if expected == 12:
            rows(spark, range(9, 12)).write.mode("append").parquet(table)
        j.drain(j.watch_table(spark, str(tmp_path), "events"), "plain", out=out, state=state)
        assert j.collected(spark, out).count() == expected


def test_empty_feed(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/none")
    out = j.drain(stream, "plain")
    assert j.collected(spark, out, schema=SCHEMA).count() == 0


def test_state_provider_setting_is_left_as_it_was(spark, tmp_path):
    before = spark.conf.get(j.PROVIDER, None)
    rows(spark, range(2)).write.parquet(f"{tmp_path}/events.parquet")
    j.drain(j.watch_table(spark, str(tmp_path), "events"), "plain")
    assert spark.conf.get(j.PROVIDER, None) == before


def test_published_answers_have_no_reach_and_keep_unmatched_queries(spark, tmp_path):
    lab = [(1, 10, 5, 1.5), (1, 20, 2, 9.0), (1, 3000, 2900, 7.0)]
    asks = [(1, 100, 9), (1, 101, 10), (1, 102, 2500), (1, 103, 3000), (2, 200, 50), (1, 999, 9000)]
    at = lambda m: START + timedelta(minutes=m)
    spark.createDataFrame([(e, at(a), at(m), v) for e, a, m, v in lab], "entity long, available_at timestamp, measured_at timestamp, value double"
                          ).write.parquet(f"{tmp_path}/lab.parquet")
    spark.createDataFrame([(e, i, at(m)) for e, i, m in asks], "entity long, observation_id long, ts timestamp").write.parquet(f"{tmp_path}/asks.parquet")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}.parquet").schema).parquet(f"{tmp_path}/{n}.parquet")
    out = j.drain(j.published_answers(read("asks"), read("lab")), "published")
    found = {r.observation_id: r.last_value for r in j.collected(spark, out).collect()}
    # The last query waits for the watermark to pass it.
    assert found == {100: None, 101: 1.5, 102: 1.5, 103: 7.0, 200: None}
