"""Windows in time against brute force: crowded hours, late publication, ties, cut nodes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators.asof import window_published
from assaylake.operators.chunks import GRID, Chunking
from assaylake.operators.series import window_stats

START = pd.Timestamp("2024-01-01")


def crowd(n=600, seed=11):
    """Most rows lie in one key and one hour; times repeat; values sit on a large constant."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 4, n))
    seconds = np.where(rng.random(n) < 0.7, rng.integers(3_600, 7_200, n), rng.integers(0, 86_400, n))
    measured = START + pd.to_timedelta(seconds, unit="s")
    delay = np.where(rng.random(n) < 0.3, 0, rng.integers(0, 14_400, n))
    value = 1e6 + np.where(rng.random(n) < 0.5, 3.0, rng.normal(size=n))
    return pd.DataFrame({"k": key, "measured_at": measured, "available_at": measured + pd.to_timedelta(delay, unit="s"), "value": value})


def asks(n=150, seed=4):
    rng = np.random.default_rng(seed)
    seconds = np.where(rng.random(n) < 0.6, rng.integers(3_600, 10_800, n), rng.integers(0, 90_000, n))
    return pd.DataFrame({"k": rng.integers(0, 5, n), "i": np.arange(n), "q": START + pd.to_timedelta(seconds, unit="s")})


def agree(found, inside, minutes):
    if not len(inside):
        assert pd.isna(found[f"mean_{minutes}m"]) and pd.isna(found[f"std_{minutes}m"])
        return
    assert found[f"mean_{minutes}m"] == pytest.approx(inside.mean(), rel=1e-13)
    assert found[f"std_{minutes}m"] == pytest.approx(inside.std(ddof=0), abs=1e-8)


@pytest.mark.parametrize("chunking", [GRID, Chunking(86_400, 20)], ids=["whole", "cut"])
def test_published_windows(spark, chunking):
    obs, q = crowd(), asks()
    q.loc[:20, "q"] = obs["measured_at"].values[:21]  # ends that meet a query exactly
    q.loc[21:40, "q"] = obs["available_at"].values[21:41]
    q.loc[41:60, "q"] = (obs["measured_at"] + pd.Timedelta(minutes=180)).values[41:61]
    got = window_published(spark.createDataFrame(q), spark.createDataFrame(obs), keys=["k"], query_id="i", query_ts="q",
                           minutes=180, chunking=chunking).toPandas().set_index("i")
    assert len(got) == len(q)
    for row in q.itertuples():
        mine = obs[(obs["k"] == row.k) & (obs["available_at"] <= row.q) & (obs["measured_at"] <= row.q)
                   & (obs["measured_at"] >= row.q - pd.Timedelta(minutes=180))]["value"]
        agree(got.loc[row.i], mine, 180)
        assert (0 if pd.isna(got.loc[row.i, "n_180m"]) else got.loc[row.i, "n_180m"]) == len(mine)


@pytest.mark.parametrize("chunking", [GRID, Chunking(86_400, 20)], ids=["whole", "cut"])
def test_trailing_windows(spark, chunking):
    obs, q = crowd(seed=2), asks(seed=8)
    q.loc[:20, "q"] = obs["measured_at"].values[:21]
    q.loc[21:40, "q"] = (obs["measured_at"] + pd.Timedelta(minutes=60)).values[21:41]
    got = window_stats(spark.createDataFrame(q), spark.createDataFrame(obs), keys=["k"], query_id="i", query_ts="q", ts="measured_at",
                       stats=("mean", "std", "min", "max"), chunking=chunking).toPandas().set_index("i")
    assert len(got) == len(q)
    for row in q.itertuples():
        for m in (60, 180):
            mine = obs[(obs["k"] == row.k) & (obs["measured_at"] <= row.q) & (obs["measured_at"] >= row.q - pd.Timedelta(minutes=m))]["value"]
            agree(got.loc[row.i], mine, m)
            if len(mine):
                assert (got.loc[row.i, f"min_{m}m"], got.loc[row.i, f"max_{m}m"]) == (mine.min(), mine.max())


def test_constant_windows_have_no_deviation(spark):
    """A level shift by 1e6 beside a constant stretch leaves no trace in the stretch's deviation."""
    at = START + pd.to_timedelta(np.arange(400), unit="min")
    obs = pd.DataFrame({"k": 0, "measured_at": at, "value": np.where(np.arange(400) < 100, 1e6, 0.1)})
    q = pd.DataFrame({"k": 0, "i": range(40), "q": START + pd.to_timedelta(np.arange(300, 340), unit="min")})
    got = window_stats(spark.createDataFrame(q), spark.createDataFrame(obs), keys=["k"], query_id="i", query_ts="q", ts="measured_at",
                       windows=(60,)).toPandas()
    assert got["std_60m"].max() < 1e-12 and np.allclose(got["mean_60m"], 0.1, rtol=1e-14)


def test_missing_values_and_empty_sides(spark):
    obs = spark.createDataFrame(pd.DataFrame({"k": [0], "measured_at": [START], "available_at": [START], "value": [1.0]}))
    q = spark.createDataFrame(pd.DataFrame({"k": [0, 0], "i": [1, 1], "q": [START, START]}))  # a repeated ask gives one row
    run = lambda a, o: window_stats(a, o, keys=["k"], query_id="i", query_ts="q", ts="measured_at", windows=(60,)).collect()
    assert [r["mean_60m"] for r in run(q, obs)] == [1.0]
    assert [r["mean_60m"] for r in run(q, obs.withColumn("value", F.lit(None).cast("double")))] == [None]
    assert [r["mean_60m"] for r in run(q, obs.limit(0))] == [None] and run(q.limit(0), obs) == []


def test_work_grows_with_rows_not_with_pairs(spark):
    """A thousand queries and a thousand values in one hour meet as some thousand rows, not as a million."""
    n = 1_000
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_000_000)
    obs = spark.range(n).select(F.lit(0).alias("k"), at.alias("measured_at"), at.alias("available_at"), F.lit(1.0).alias("value"))
    q = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("i"), at.alias("q"))
    found = window_published(q, obs, keys=["k"], query_id="i", query_ts="q", minutes=60, chunking=GRID)
    assert found.agg(F.sum("n_60m")).first()[0] == n * (n + 1) // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # back to the queries, by their id
