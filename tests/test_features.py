"""Golden feature, label, split and episode values."""

from pyspark.sql import functions as F

from assaylake.operators import features as ft
from assaylake.operators import series as s
from assaylake.operators.chunks import GRID
from assaylake.operators.splits import expanding_folds, outer_split

Q = "entity int, observation_id string, signal_id string, source string, measured_at timestamp_ntz, available_at timestamp_ntz, value double, unit string, validity string"


def quality(spark, minutes, values, source="pak"):
    return spark.createDataFrame([(0, f"o{m}", "ht:sulfur", source, minutes(m), minutes(a), v, u, ok) for m, a, v, u, ok in values], Q)


def test_ramp_lags_and_windows(spark, minutes):
    tele = spark.createDataFrame([(0, "T", minutes(10 * i), 10.0 * i) for i in range(8)], "entity int, signal_id string, ts timestamp_ntz, value double")
    target = quality(spark, minutes, [(120, 120, 5.0, "mg/kg", "valid")])
    row = ft.supervised(target, tele, target, signals=["T"], chunking=GRID).first()
    assert str(row["as_of"]) == "2024-01-01 01:00:00"
    assert [row[f"T__lag_{m}m"] for m in (0, 10, 30, 60, 180)] == [60.0, 50.0, 30.0, 0.0, None]
    assert [row[f"T__delta_{m}m"] for m in (10, 30, 60)] == [10.0, 30.0, 60.0]
    assert row["T__mean_60m"] == 30.0


def test_targets_and_autoregression(spark, minutes):
    from assaylake.operators.cleanse import eligible

    rows = quality(spark, minutes, [(60, 60, 7.0, "mg/kg", "valid"), (70, 70, 1.0, "mg/kg", "invalid"), (80, 80, 1.0, "bar", "valid"), (90, 90, 8.0, "mg/kg", "valid")])
    good = eligible(rows, "pak").orderBy("measured_at").collect()
    assert [r["value"] for r in good] == [7.0, 8.0]
    history = quality(spark, minutes, [(0, 0, 1.0, "mg/kg", "valid"), (30, 30, 3.0, "mg/kg", "valid"), (60, 60, 5.0, "mg/kg", "valid"), (120, 120, 999.0, "mg/kg", "valid")])
    none = spark.createDataFrame([], "entity int, signal_id string, ts timestamp_ntz, value double")
    row = ft.supervised(history.filter("value = 999"), none, history, signals=["T"], chunking=GRID).first()
    assert [row[f"target__lag_{m}m"] for m in (0, 30, 60)] == [5.0, 3.0, 1.0]
    assert row["target__delta_60m"] == 4.0 and row["target__mean_60m"] == 3.0 and row["baseline"] == 5.0


def test_delayed_laboratory(spark, minutes):
    lab = quality(spark, minutes, [(0, 360, 5.0, "mg/kg", "valid"), (390, 750, 999.0, "mg/kg", "valid"), (480, 840, 8.4, "mg/kg", "valid")], "lims")
    none = spark.createDataFrame([], "entity int, signal_id string, ts timestamp_ntz, value double")
    out = ft.supervised(lab, none, lab, signals=["T"], published_at_once=False, chunking=GRID)
    row = out.filter("observation_id = 'o480'").first()
    assert (row["baseline"], row["target__age_minutes"]) == (5.0, 420.0)
    assert out.count() == 3


def test_serving_equals_training(spark, minutes):
    tele = spark.createDataFrame([(0, "T", minutes(7 * i), float(i % 5)) for i in range(60)], "entity int, signal_id string, ts timestamp_ntz, value double")
    hist = quality(spark, minutes, [(11 * i, 11 * i, float(i), "mg/kg", "valid") for i in range(30)])
    trained = ft.supervised(hist, tele, hist, signals=["T"], chunking=GRID)
    asks = trained.select("entity", F.col("observation_id").alias("query_id"), "as_of")
    served = ft.feature_frame(asks, tele, hist, query_id="query_id", query_ts="as_of", signals=["T"], chunking=GRID)
    names = ft.feature_names(["T"])
    a = trained.select("observation_id", *names).toPandas().sort_values("observation_id").reset_index(drop=True)
    b = served.select(F.col("query_id").alias("observation_id"), *names).toPandas().sort_values("observation_id").reset_index(drop=True)
    import pandas as pd

    pd.testing.assert_frame_equal(a, b)


def grid(spark, minutes, values):
    return spark.createDataFrame([(0, minutes(10 * i), v) for i, v in enumerate(values)], "entity int, measured_at timestamp_ntz, value double")


def test_episode_labels(spark, minutes):
    series = grid(spark, minutes, [9.0] * 7 + [11.0] * 3 + [9.0] * 15)
    out = ft.episode_frame(series, limit=10.0, thresholds=(8.0, 9.0, 10.0), bands=(8.0, 10.0), chunking=GRID)
    rows = {r["as_of"]: r for r in out.collect()}
    assert rows[minutes(10)]["crossing_60m"] and rows[minutes(10)]["event_id"] == 1
    assert rows[minutes(10)]["event_start_at"] == minutes(70)
    assert rows[minutes(50)]["crossing_20m"] and not rows[minutes(50)]["crossing_10m"]


def test_a_single_step_counts_as_crossing(spark, minutes):
    series = grid(spark, minutes, [9.0] * 4 + [11.0] + [9.0] * 8)
    row = {r["as_of"]: r for r in ft.episode_frame(series, limit=10.0, thresholds=(8.0,), bands=(8.0,), chunking=GRID).collect()}[minutes(0)]
    assert (row["y_60m"], row["crossing_60m"], row["event_id"]) == (9.0, True, 1)


def test_gap_does_not_end_an_episode(spark, minutes):
    series = spark.createDataFrame([(0, minutes(m), v) for m, v in [(0, 11.0), (500, 12.0), (510, 9.0), (520, 11.0)]], "entity int, measured_at timestamp_ntz, value double")
    got = [r["episode_id"] for r in s.exceedance_episodes(series, keys=["entity"], ts="measured_at", limit=10.0).orderBy("measured_at").collect()]
    assert got == [1, 1, None, 2]


def test_isolated_change(spark, minutes):
    rows = [(0, minutes(10 * i), 10.0 if i < 10 else 11.0, 100.0, 30.0, 10.0 if i < 10 else 10.0 - 2.0 * (i - 10) / 29) for i in range(40)]
    plant = spark.createDataFrame(rows, "entity int, ts timestamp_ntz, P8 double, T11 double, F19 double, q double")
    got = s.isolated_changes(plant, {"P8": 0.5, "T11": 1.0, "F19": 0.5}, target="q", horizons=(30, 60), stable_minutes=60, chunking=GRID).collect()
    assert len(got) == 1
    assert (got[0]["control_id"], got[0]["control_delta"], got[0]["baseline_quality"]) == ("P8", 1.0, 10.0)


def test_split_purges_late_labels(spark, minutes):
    from datetime import datetime

    d = lambda x: datetime.fromisoformat(x)
    rows = [("a", d("2024-12-31 10:00"), d("2024-12-31 11:00"), d("2024-12-31 11:00")), ("b", d("2024-12-31 20:30"), d("2024-12-31 21:30"), d("2024-12-31 21:30")),
            ("c", d("2025-06-01 00:00"), d("2025-06-01 01:00"), d("2025-06-01 05:00")), ("d", d("2025-12-31 21:00"), d("2025-12-31 22:00"), d("2025-12-31 22:00"))]
    df = spark.createDataFrame(rows, "i string, as_of timestamp_ntz, target_at timestamp_ntz, target_available_at timestamp_ntz")
    got = {r["i"]: r["s"] for r in df.select("i", outer_split("2025-01-01", "2026-01-01", "Europe/Moscow").alias("s")).collect()}
    assert got == {"a": "train", "b": None, "c": "validation", "d": "test"}


def test_expanding_folds_follow_array_split(spark, minutes):
    df = spark.createDataFrame([(i, minutes(60 * i), minutes(60 * i + 60), minutes(60 * i + 60)) for i in range(10)], "i int, as_of timestamp_ntz, target_at timestamp_ntz, target_available_at timestamp_ntz")
    got = expanding_folds(df, 3).groupBy("fold", "role").agg(F.sort_array(F.collect_list("i")).alias("rows")).collect()
    by = {(r["fold"], r["role"]): r["rows"] for r in got}
    assert by[(1, "validation")] == [3, 4, 5] and by[(3, "validation")] == [8, 9]
    assert by[(1, "train")] == [0, 1] and by[(3, "train")] == [0, 1, 2, 3, 4, 5, 6]
