"""Metric and threshold goldens."""

import inspect

import pytest
from pyspark.sql import functions as F

from assaylake.operators import metrics as m
from assaylake.operators import models as md


def test_strict_threshold_and_null_rates(spark):
    df = spark.createDataFrame([(10.0, 10.0), (8.0, 9.0)], "y double, p double")
    r = df.agg(*m.regression_columns(F.col("y"), F.col("p"), limit=10.0, near=(8.0, 12.0))).first()
    assert (r["n"], r["mae"], r["near_n"], r["exceedances"], r["missed_rate"], r["false_alarm_rate"]) == (2, 0.5, 2, 0, None, 0.0)


def test_alarm_threshold(spark):
    rows = list(zip([False] * 4 + [True] * 2, [0.05, 0.10, 0.20, 0.80, 0.40, 0.90]))
    df = spark.createDataFrame(rows, "a boolean, p double")
    r = m.alarm_threshold(df, F.col("p"), F.col("a"), 0.25).first()
    assert (r["threshold"], r["false_negative_rate"], r["false_positive_rate"]) == (0.4, 0.0, 0.25)


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.5), (False, 0.1)], "a boolean, p double")
    assert m.average_precision(df, F.col("p"), F.col("a")).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_upper_bounds(spark):
    df = spark.createDataFrame([(8.0, 8.0, 9.0), (10.0, 9.0, 11.0), (12.0, 10.0, 11.0), (14.0, 11.0, 15.0)], "y double, p double, u double")
    r = df.agg(*m.upper_columns(F.col("y"), F.col("p"), F.col("u"))).first()
    assert (r["coverage"], r["average_width"]) == (0.75, 2.0)
    with pytest.raises(Exception, match="below point"):
        df.agg(*m.upper_columns(F.col("y"), F.col("u") + 1, F.col("u"))).collect()


def test_conformal_shift(spark):
    df = spark.createDataFrame([(12.0, 10.0), (13.0, 10.0), (14.0, 10.0), (15.0, 10.0)], "y double, raw double")
    assert md.conformal_shift(df, "raw") == pytest.approx(4.85)


def events(spark, minutes, rows):
    return spark.createDataFrame([(0, minutes(a), b, c, e, p) for a, b, c, e, p in rows], "entity int, as_of timestamp_ntz, baseline double, crossing_60m boolean, event_id long, p double")


def test_events_are_counted_once(spark, minutes):
    rows = [(10 * i, 9.0, c, e, p) for i, (c, e, p) in enumerate(zip(
        [True, True, True, False, True, False, False], [1, 1, 1, None, 2, None, None], [0.8, 0.2, 0.1, 0.1, 0.2, 0.1, 0.1]))]
    r = m.event_metrics(events(spark, minutes, rows), threshold=0.5, limit=10.0).first()
    assert (r["event_count"], r["detected_events"], r["event_false_negative_rate"]) == (2, 1, 0.5)


def test_episode_weights_are_equal_mass(spark, minutes):
    from assaylake.operators.splits import episode_weights

    rows = [(10 * i, 9.0, c, e, 0.1) for i, (c, e) in enumerate(zip([True, True, True, False, True, False, False], [1, 1, 1, None, 2, None, None]))]
    frame = events(spark, minutes, rows).withColumn("month", F.date_format("as_of", "yyyy-MM"))
    w = {r["event_id"]: r["w"] for r in episode_weights(frame, "month").groupBy("event_id").agg(F.sum("weight").alias("w")).collect()}
    assert w[1] == pytest.approx(w[2])


def test_alarm_after_the_start_does_not_detect(spark, minutes):
    df = events(spark, minutes, [(0, 9.0, True, 1, 0.1), (50, 9.0, True, 1, 0.1), (60, 11.0, True, 1, 0.1)]).withColumn("event_start_at", F.lit(minutes(60)).cast("timestamp_ntz"))
    assert m.event_metrics(df, threshold=0.5, limit=10.0).first()["detected_events"] == 0


def test_bounds_name_missing_then_outside(spark):
    from assaylake.operators.applicability import check_bounds

    bounds = spark.createDataFrame([("P8", 300.0, 380.0), ("T11", 50.0, 100.0)], "feature string, lower double, upper double")
    rows = spark.createDataFrame([(1, 350.0, None), (2, 430.0, 70.0), (3, 350.0, 70.0)], "i int, P8 double, T11 double")
    got = {r["i"]: (r["reason_code"], r["violations"]) for r in check_bounds(rows, bounds).collect()}
    assert got == {1: ("FEATURES_UNAVAILABLE", ["T11"]), 2: ("OUT_OF_DOMAIN", ["P8"]), 3: (None, [])}


def test_joint_domain_rejects_unusual_combination(spark):
    import numpy as np

    from assaylake.operators.controls import distance_squared, fit_joint_domain

    rng = np.random.default_rng(42)
    base = rng.normal(size=500)
    rows = [(float(100 + b * 5), float(50 + b * 2 + e), float(200 - b * 8)) for b, e in zip(base, rng.normal(scale=0.3, size=500))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    d = fit_joint_domain(df, ["a", "b", "c"])
    probe = spark.createDataFrame([(105.0, 52.0, 192.0), (105.0, 48.0, 208.0)], "a double, b double, c double")
    near, odd = [r[0] for r in probe.select(distance_squared([F.col("a"), F.col("b"), F.col("c")], d)).collect()]
    assert near <= d.max_distance_squared < odd


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(40, 30)], "event_count long, detected_events long")
    r = m.bootstrap_event_fnr(df).first()
    assert 0.08 < r["lower"] < 0.25 < r["upper"] < 0.42 and r["samples"] == 1000


def test_boosting_rounds(spark, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def fake(**setting):
        asked.append(setting["maxIter"])
        raise Asked

    monkeypatch.setattr(md, "GBTClassifier", fake)
    with pytest.raises(Asked):
        md.fit_classifier(spark.createDataFrame([(1.0, True)], "x double, y boolean"), ["x"], "y", "boosted", F.lit(1.0))
    assert asked == [100] and [s["maxIter"] for s in md.BOOSTED] == [100, 200]
    assert inspect.signature(md.rolling_scores).parameters["rounds"].default == 100
