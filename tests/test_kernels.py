"""Ordered kernels against brute force, also when buckets are split because they are crowded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators.asof import asof, asof_published, window_published
from assaylake.operators.chunks import GRID, Chunking, carry_forward, over_range, over_rows
from assaylake.operators.matching import nearest_match
from assaylake.operators.quantiles import exact_quantiles

CHUNKINGS = [GRID, Chunking(86_400, 15), Chunking(3_600, None)]


def series(n=900, seed=3):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    # Two thirds of the rows crowd into one key and a few hours.
    key = np.where(rng.random(n) < 0.66, 0, rng.integers(0, 4, n))
    seconds = np.where(rng.random(n) < 0.5, rng.integers(0, 7_200, n), rng.integers(0, 8 * 86_400, n))
    return pd.DataFrame({"k": key, "ts": start + pd.to_timedelta(seconds, unit="s"), "v": rng.normal(size=n)}).drop_duplicates(["k", "ts"])


@pytest.mark.parametrize("chunking", CHUNKINGS, ids=["day", "split", "hour"])
def test_asof_equals_pandas(spark, chunking):
    ev = series()
    q = series(200, 9).rename(columns={"ts": "q"})[["k", "q"]]
    q["i"] = range(len(q))
    for direction in ("backward", "forward"):
        got = asof(spark.createDataFrame(q), spark.createDataFrame(ev), keys=["k"], query_ts="q", event_ts="ts", take=["v"],
                   direction=direction, tolerance_minutes=600, chunking=chunking).toPandas().sort_values("i")
        want = pd.merge_asof(q.sort_values("q"), ev.sort_values("ts"), left_on="q", right_on="ts", by="k", direction=direction,
                             tolerance=pd.Timedelta(minutes=600)).sort_values("i")
        np.testing.assert_array_equal(got["v"].fillna(-99).values, want["v"].fillna(-99).values)


@pytest.mark.parametrize("chunking", CHUNKINGS, ids=["day", "split", "hour"])
def test_running_sum_and_row_frames(spark, chunking):
    ev = series().sort_values(["k", "ts"]).reset_index(drop=True)
    df = spark.createDataFrame(ev)
    got = carry_forward(df, ["k"], "ts", [], {"total": ("sum", F.lit(1)), "top": ("max", F.col("v"))}, chunking=chunking).toPandas().sort_values(["k", "ts"])
    assert (got["total"].values == ev.groupby("k").cumcount().values + 1).all()
    np.testing.assert_allclose(got["top"].values, ev.groupby("k")["v"].cummax().values)
    rows = over_rows(df, ["k"], "ts", [], lambda w: {"b": F.sum("v").over(w.rowsBetween(-5, -1)), "a": F.lead("v", 3).over(w)},
                     before=5, after=3, chunking=chunking).toPandas().sort_values(["k", "ts"])
    want = ev.groupby("k")["v"].transform(lambda s: s.shift(1).rolling(5, min_periods=1).sum())
    np.testing.assert_allclose(rows["b"].fillna(0).values, want.fillna(0).values, atol=1e-9)
    np.testing.assert_array_equal(rows["a"].fillna(9).values, ev.groupby("k")["v"].shift(-3).fillna(9).values)


def test_range_frames_closed_on_both_sides(spark):
    ev = series(400).sort_values(["k", "ts"]).reset_index(drop=True)
    got = over_range(spark.createDataFrame(ev), ["k"], "ts", lambda f: {"m": F.avg("v").over(f(180)), "s": F.stddev_pop("v").over(f(180))},
                     before_minutes=180).toPandas().sort_values(["k", "ts"])
    roll = ev.set_index("ts").groupby("k")["v"].rolling("180min", closed="both")
    np.testing.assert_allclose(got["m"].values, roll.mean().values, atol=1e-9)
    np.testing.assert_allclose(got["s"].values, roll.std(ddof=0).values, atol=1e-6)


def test_published_rows_brute_force_and_future_poison(spark):
    """1000 samples with a random publication delay; rows published later change nothing."""
    rng = np.random.default_rng(24)
    n = 1000
    measured = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n), unit="min")
    obs = pd.DataFrame({"k": 0, "observation_id": [str(i) for i in range(n)], "measured_at": measured,
                        "available_at": measured + pd.to_timedelta(rng.integers(0, 300, n), unit="min"), "value": rng.normal(size=n)})
    q = pd.DataFrame({"k": 0, "i": range(60), "q": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 1300, 60), unit="min")})

    def run(frame):
        return asof_published(spark.createDataFrame(q), spark.createDataFrame(frame), keys=["k"], query_ts="q").toPandas().sort_values("i")

    got = run(obs)
    for row in got.itertuples():
        seen = obs[obs["available_at"] <= row.q]
        if seen.empty:
            assert pd.isna(row.last_value)
        else:
            best = seen.loc[seen["measured_at"].idxmax()]
            assert row.last_value == best["value"]
            assert row.age_minutes == (row.q - best["measured_at"]).total_seconds() / 60
    horizon = q["q"].max()
    poison = obs.assign(value=999.0, observation_id="p" + obs["observation_id"], available_at=horizon + pd.Timedelta(minutes=1))
    pd.testing.assert_frame_equal(run(pd.concat([obs, poison])).reset_index(drop=True), got.reset_index(drop=True))
    stats = window_published(spark.createDataFrame(q), spark.createDataFrame(obs), keys=["k"], query_id="i", query_ts="q", minutes=180).toPandas()
    for row in stats.itertuples():
        inside = obs[(obs["available_at"] <= row.q) & (obs["measured_at"] <= row.q) & (obs["measured_at"] >= row.q - pd.Timedelta(minutes=180))]["value"]
        if len(inside):
            assert row.mean_180m == pytest.approx(inside.mean())
            assert row.std_180m == pytest.approx(inside.std(ddof=0), abs=1e-12)
        else:
            assert pd.isna(row.mean_180m)


def test_a_missing_value_in_the_chosen_row_stays_missing(spark, minutes):
    ev = spark.createDataFrame([(0, minutes(0), 1.0), (0, minutes(10), None)], "k int, ts timestamp_ntz, v double")
    q = spark.createDataFrame([(0, minutes(15))], "k int, q timestamp_ntz")
    assert asof(q, ev, keys=["k"], query_ts="q", event_ts="ts", take=["v"]).first()["v"] is None


def test_empty_inputs(spark, minutes):
    ev = spark.createDataFrame([], "k int, ts timestamp_ntz, v double")
    q = spark.createDataFrame([(0, minutes(15))], "k int, q timestamp_ntz")
    assert asof(q, ev, keys=["k"], query_ts="q", event_ts="ts", take=["v"]).first()["v"] is None
    assert carry_forward(ev, ["k"], "ts", [], {"n": ("sum", F.lit(1))}).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": np.where(rng.random(3000) < 0.7, 0, 1), "x": np.round(rng.lognormal(size=3000), 2)})
    got = exact_quantiles(spark.createDataFrame(frame), ["g"], F.col("x"), {"a": 0.05, "b": 0.5, "c": 0.999}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["x"], [0.05, 0.5, 0.999]))


def test_nearest_match_is_exact(spark):
    rng = np.random.default_rng(8)
    left = pd.DataFrame(rng.normal(size=(80, 4)), columns=list("abcd")).assign(y=lambda d: [i % 2 for i in range(80)], l=range(80))
    right = pd.DataFrame(rng.normal(size=(400, 4)), columns=list("abcd")).assign(y=lambda d: [i % 2 for i in range(400)], r=range(400))
    right = pd.concat([right, right.assign(r=right["r"] + 400)])  # copies: the lower id must win
    got = nearest_match(spark.createDataFrame(left), spark.createDataFrame(right), by=["y"], dims=list("abcd"), left_id="l", right_id="r").toPandas().set_index("l")
    assert len(got) == 80
    for row in left.itertuples():
        pool = right[right["y"] == row.y]
        d = np.sqrt(((pool[list("abcd")].values - np.array([row.a, row.b, row.c, row.d])) ** 2).sum(axis=1))
        assert got.loc[row.l, "distance"] == pytest.approx(d.min())
        assert got.loc[row.l, "r"] == pool["r"].values[d.argmin()]


def test_cooldown_chain(spark, minutes):
    from assaylake.operators.cooldown import cooldown

    times = [0, 10, 59, 60, 70, 125, 130, 500, 530, 561]
    df = spark.createDataFrame([(0, minutes(m)) for m in times], "entity int, ts timestamp_ntz")
    got = sorted(r["ts"] for r in cooldown(df, keys=["entity"], ts="ts", minutes=60, chunking=GRID).collect())
    assert got == [minutes(m) for m in (0, 60, 125, 500, 561)]


def test_cuts_below_by_halving(spark):
    from pyspark.sql import functions as F

    from assaylake.operators.quantiles import _cuts_below

    for cuts in ([], [1.0], [1.0, 1.0, 2.0], [float(i // 3) for i in range(127)], [float(i) for i in range(128)]):
        array = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        rows = spark.range(-4, 270).select((F.col("id") / 2).alias("x")).select("x", _cuts_below(array, F.col("x"), 128).alias("n")).collect()
        assert all(r.n == sum(c < r.x for c in cuts) for r in rows)
