"""Leakage-safe feature frames, one function for training and serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.timecols import minutes_between, plus_minutes
from assaylake.operators.asof import asof, window_published
from assaylake.operators.chunks import DEFAULT, Chunking
from assaylake.session import materialise
from assaylake.operators.series import (
    LAGS, WINDOWS, exceedance_episodes, lag_values, published_lags, state_ages, steps_ahead, window_stats,
)

HORIZONS = (10, 20, 30, 60)
STEPS = (10, 20, 30, 40, 50, 60)


def feature_names(signals: Sequence[str]) -> list[str]:
    """Frozen column order shared by training and serving."""
    names: list[str] = []
    for s in signals:
        names += [f"{s}__lag_{m}m" for m in LAGS]
        names += [f"{s}__delta_{m}m" for m in LAGS[1:]]
        names += [f"{s}__{k}_{w}m" for w in WINDOWS for k in ("mean", "std")]
    names += ["target__last", "target__age_minutes"]
    names += [f"target__lag_{m}m" for m in LAGS] + [f"target__delta_{m}m" for m in LAGS[1:]]
    names += [f"target__{k}_{w}m" for w in WINDOWS for k in ("mean", "std")]
    return names


def feature_frame(
    queries: DataFrame,
    telemetry: DataFrame,
    history: DataFrame,
    *,
    query_id: str,
    query_ts: str,
    signals: Sequence[str],
    published_at_once: bool = True,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """All model features of every query: ``queries`` columns plus ``feature_names(signals)``.

    The telemetry lags and windows are long and pivoted once; the three parts are joined on the query
    id, so the query table is shuffled on one key only.
    """
    key = ["entity", query_id]
    lags = lag_values(
        queries, telemetry, query_id=query_id, query_ts=query_ts, signals=signals, chunking=chunking
    )
    asks = queries.select("entity", query_id, query_ts, F.explode(
        F.array(*[F.lit(s) for s in signals])).alias("signal_id"))
    windows = window_stats(
        asks, telemetry, keys=["entity", "signal_id"], query_id=query_id, query_ts=query_ts, ts="ts", chunking=chunking
    )
    tall = lags.select(
        *key, "signal_id", F.concat(F.lit("lag_"), F.col("lag").cast("string"), F.lit("m")).alias("name"), "value"
    ).unionByName(
        windows.select(*key, "signal_id", F.explode(F.array(*[
            F.struct(F.lit(f"{k}_{w}m").alias("name"), F.col(f"{k}_{w}m").alias("value"))
            for w in WINDOWS for k in ("mean", "std")
        ])).alias("_s")).select(*key, "signal_id", "_s.name", "_s.value")
    )

    def pick(s: str, n: str) -> Column:
        return F.max(F.when((F.col("signal_id") == s) & (F.col("name") == n), F.col("value")))

    wide = tall.groupBy(*key).agg(
        *[pick(s, f"lag_{m}m").alias(f"{s}__lag_{m}m") for s in signals for m in LAGS],
        *[pick(s, f"{k}_{w}m").alias(f"{s}__{k}_{w}m") for s in signals for w in WINDOWS for k in ("mean", "std")],
    )
    past = published_lags(queries, history, query_id=query_id, query_ts=query_ts, chunking=chunking)
    if published_at_once:
        recent = window_stats(
            queries, history, keys=["entity"], query_id=query_id, query_ts=query_ts, ts="measured_at", chunking=chunking
        )
    else:
        recent = queries.select(*key, query_ts)
        for w in WINDOWS:
            recent = window_published(
                recent, history, keys=["entity"], query_id=query_id, query_ts=query_ts, minutes=w, chunking=chunking
            ).drop(f"n_{w}m")
        recent = recent.drop(query_ts)
    joined = queries.join(wide, key, "left").join(past, key, "left").join(recent, key, "left")
    out: list[Column] = [F.col(c) for c in queries.columns]
    for s in signals:
        out += [F.col(f"{s}__lag_{m}m") for m in LAGS]
        out += [(F.col(f"{s}__lag_0m") - F.col(f"{s}__lag_{m}m")).alias(f"{s}__delta_{m}m") for m in LAGS[1:]]
        out += [F.col(f"{s}__{k}_{w}m") for w in WINDOWS for k in ("mean", "std")]
    out += [F.col("lag_0m").alias("target__last"), F.col("age_minutes").alias("target__age_minutes")]
    out += [F.col(f"lag_{m}m").alias(f"target__lag_{m}m") for m in LAGS]
    out += [(F.col("lag_0m") - F.col(f"lag_{m}m")).alias(f"target__delta_{m}m") for m in LAGS[1:]]
    out += [F.col(f"{k}_{w}m").alias(f"target__{k}_{w}m") for w in WINDOWS for k in ("mean", "std")]
    return joined.select(*out)


def supervised(
    targets: DataFrame,
    telemetry: DataFrame,
    history: DataFrame,
    *,
    signals: Sequence[str],
    horizon_minutes: int = 60,
    published_at_once: bool = True,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Exact target at t, features at ``t - horizon``, persistence baseline; nothing filled forward."""
    queries = targets.select(
        "entity", "observation_id", plus_minutes("measured_at", -horizon_minutes).alias("as_of"),
        F.col("measured_at").alias("target_at"), F.col("available_at").alias("target_available_at"),
        F.col("source").alias("target_source"), F.col("signal_id").alias("target_signal"),
        F.col("unit").alias("target_unit"), F.col("value").alias("y"),
    )
    frame = feature_frame(
        queries, telemetry, history, query_id="observation_id", query_ts="as_of", signals=signals,
        published_at_once=published_at_once, chunking=chunking,
    )
    return frame.withColumn("baseline", F.col("target__last"))


def check_recipe(columns: Sequence[str], expected: Sequence[str]) -> None:
    """Serving must hand the model exactly the columns it was trained on."""
    missing = sorted(set(expected) - set(columns))
    if missing:
        raise ValueError(f"feature columns are missing: {missing}")


def absent_features(required: Sequence[str]) -> Column:
    """Required features a row does not have, in the required order."""
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]))
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def missing_share(names: Sequence[str]) -> tuple[Column, Column]:
    n = sum(F.col(c).isNull().cast("int") for c in names)
    return n, n / F.lit(float(len(names)))


def episode_frame(
    series: DataFrame,
    *,
    limit: float,
    thresholds: Sequence[float],
    bands: Sequence[float],
    keys: Sequence[str] = ("entity",),
    ts: str = "measured_at",
    horizon_minutes: int = 60,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Future labels per horizon, first future episode, and causal trajectory features.

    ``series`` is the analyser on its regular grid; one frame row per target on that grid.
    """
    keys = list(keys)
    series = materialise(series, "episode-series")
    numbered = exceedance_episodes(series, keys=keys, ts=ts, limit=limit, chunking=chunking)
    frame = series.select(
        *keys, plus_minutes(ts, -horizon_minutes).alias("as_of"), F.col(ts).alias("target_at")
    )
    labelled = label_horizons(frame, numbered, keys=keys, ts=ts, limit=limit)
    with_now = asof(
        labelled, series, keys=keys, query_ts="as_of", event_ts=ts, take=["value"], prefix="_now_",
        chunking=chunking,
    ).withColumnRenamed("_now_value", "baseline").drop(f"_now_{ts}")
    with_now = materialise(with_now, "episode-labels")
    ages = state_ages(
        with_now, series, keys=keys, query_ts="as_of", ts=ts, thresholds=thresholds, bands=bands,
        chunking=chunking,
    )
    extremes = window_stats(
        with_now, series, keys=keys, query_id="target_at", query_ts="as_of", ts=ts, windows=(30, 60, 180),
        stats=("min", "max"), chunking=chunking,
    )
    lagged = lag_table(with_now, series, keys=keys, query_ts="as_of", ts=ts, lags=(30, 60, 180), chunking=chunking)
    joined = ages.join(extremes, [*keys, "target_at"], "left").join(lagged, [*keys, "target_at"], "left")
    slopes = {m: (F.col("baseline") - F.col(f"lag_{m}m")) / F.lit(float(m)) for m in (30, 60, 180)}
    return joined.select(
        *ages.columns,
        (F.col("y_60m") - F.col("baseline")).alias("delta_60m"),
        *[F.col(f"{s}_{m}m") for m in (30, 60, 180) for s in ("min", "max")],
        *[(F.col(f"max_{m}m") - F.col(f"min_{m}m")).alias(f"range_{m}m") for m in (30, 60, 180)],
        *[c.alias(f"slope_{m}m") for m, c in slopes.items()],
        (slopes[30] - slopes[60]).alias("acceleration_30_60m"),
    )


def lag_table(
    queries: DataFrame, series: DataFrame, *, keys: Sequence[str], query_ts: str, ts: str,
    lags: Sequence[int], chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Last series value at or before each lag, without an age limit, wide."""
    asks = queries.select(*keys, "target_at", query_ts).select(
        "*", F.explode(F.array(*[F.lit(m) for m in lags])).alias("lag")
    )
    found = asof(
        asks, series, keys=keys, query_ts=plus_minutes(query_ts, -F.col("lag")), event_ts=ts,
        take=["value"], chunking=chunking,
    )
    return found.groupBy(*keys, "target_at").agg(
        *[F.max(F.when(F.col("lag") == m, F.col("value"))).alias(f"lag_{m}m") for m in lags]
    )


def label_horizons(
    frame: DataFrame, numbered: DataFrame, *, keys: Sequence[str], ts: str, limit: float
) -> DataFrame:
    """y at each horizon, any crossing up to it, and the first future episode with its start."""
    steps = steps_ahead(
        frame, numbered.select(*keys, ts, "value", "episode_id", "episode_start_at"),
        keys=keys, as_of="as_of", ts=ts, steps=STEPS,
    )
    above = F.col("value") > limit
    first = F.min_by(F.struct("episode_id", "episode_start_at"), F.when(above, F.col("step")))
    labels = steps.groupBy(*keys, "as_of").agg(
        *[F.max(F.when(F.col("step") == h, F.col("value"))).alias(f"y_{h}m") for h in HORIZONS],
        *[F.coalesce(F.bool_or(above & (F.col("step") <= h)), F.lit(False)).alias(f"crossing_{h}m")
          for h in HORIZONS],
        first.alias("_event"),
    )
    return frame.join(labels, [*keys, "as_of"], "left").select(
        *frame.columns,
        *[F.col(f"y_{h}m") for h in HORIZONS],
        *[F.coalesce(F.col(f"crossing_{h}m"), F.lit(False)).alias(f"crossing_{h}m") for h in HORIZONS],
        F.col("_event.episode_id").alias("event_id"),
        F.col("_event.episode_start_at").alias("event_start_at"),
    )


def action_timeline(
    plant: DataFrame,
    quality: DataFrame,
    *,
    horizons: Sequence[int],
    keys: Sequence[str] = ("entity",),
    ts: str = "ts",
    slope_rows: int = 6,
    tolerance_minutes: float = 10,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Plant rows with the quality known then, its slope over the last rows, and future values."""
    from assaylake.operators.chunks import over_rows

    keys = list(keys)
    plant = materialise(plant, "action-plant")
    known = asof(
        plant, quality, keys=keys, query_ts=ts, event_ts="measured_at", take=["value"],
        tolerance_minutes=tolerance_minutes, prefix="_q_", chunking=chunking,
    ).withColumnRenamed("_q_value", "baseline_sulfur").drop("_q_measured_at")
    known = materialise(known, "action-known")
    sloped = over_rows(
        known, keys, ts, [],
        lambda w: {"sulfur_slope_60m": (F.col("baseline_sulfur") - F.lag("baseline_sulfur", slope_rows).over(w)) / 60.0},
        before=slope_rows, chunking=chunking,
    )
    out = sloped
    later = known.select(*keys, F.col(ts).alias("_at"), F.col("baseline_sulfur").alias("_later"))
    for h in horizons:
        shifted = later.select(*keys, plus_minutes("_at", -h).alias(ts), F.col("_later").alias(f"sulfur_{h}m"))
        out = out.join(shifted, [*keys, ts], "left")
    return out
