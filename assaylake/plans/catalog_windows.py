"""Lags, rolling windows, episodes, control changes and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.timecols import plus_minutes
from assaylake.operators import series as s
from assaylake.operators import state as st
from assaylake.operators.chunks import GRID
from assaylake.operators.features import episode_frame, lag_table
from assaylake.plans.catalog_joins import STATE_SQL, all_observations, decision_times, snapshot, WANTED
from assaylake.plans.registry import query
from assaylake.sources.adapters import (
    LIMIT, SIGNALS, analyser, analyser_grid, hour_grid, plant_hours, telemetry, with_views,
)

CONTROLS = ("click", "signup")
THRESHOLDS = (48.0, 54.0, 60.0)
BANDS = (48.0, 60.0)


@query("lag_features", with_views("pak tele", """
WITH q AS (SELECT q.entity, q.observation_id, q.signal_id, q.lag, CASE WHEN e.ts >= q.cutoff - INTERVAL 20 MINUTE THEN e.value END AS value
FROM (SELECT entity, observation_id, s.signal_id, l.lag, measured_at - INTERVAL 60 MINUTE - l.lag * INTERVAL 1 MINUTE AS cutoff
      FROM pak, (SELECT unnest(['click', 'signup', 'view']) AS signal_id) s, (SELECT unnest([0, 10, 30, 60, 180]) AS lag) l) q
ASOF LEFT JOIN tele e ON q.entity = e.entity AND q.signal_id = e.signal_id AND q.cutoff >= e.ts)
SELECT entity, observation_id, signal_id, max(value) FILTER (lag = 0) AS lag_0m, max(value) FILTER (lag = 60) AS lag_60m,
  round(max(value) FILTER (lag = 0) - max(value) FILTER (lag = 10), 6) AS delta_10m,
  round(max(value) FILTER (lag = 0) - max(value) FILTER (lag = 180), 6) AS delta_180m FROM q GROUP BY ALL"""))
def lag_features(t):
    long = s.lag_values(decision_times(t), telemetry(t), query_id="observation_id", query_ts="as_of", signals=SIGNALS)
    at = lambda m: F.max(F.when(F.col("lag") == m, F.col("value")))
    return long.groupBy("entity", "observation_id", "signal_id").agg(
        at(0).alias("lag_0m"), at(60).alias("lag_60m"),
        F.round(at(0) - at(10), 6).alias("delta_10m"), F.round(at(0) - at(180), 6).alias("delta_180m"))


@query("rolling_mean_std", with_views("pak tele", """
WITH q AS (SELECT entity, observation_id, s.signal_id, measured_at - INTERVAL 60 MINUTE AS ts, NULL::DOUBLE AS value
           FROM pak, (SELECT unnest(['click', 'signup', 'view']) AS signal_id) s),
u AS (SELECT * FROM q UNION ALL SELECT entity, NULL, signal_id, ts, value FROM tele),
r AS (SELECT entity, observation_id, signal_id, round(avg(value) OVER a, 6) AS mean_60m, round(stddev_pop(value) OVER a, 6) AS std_60m,
  round(avg(value) OVER b, 6) AS mean_180m, round(stddev_pop(value) OVER b, 6) AS std_180m FROM u
  WINDOW a AS (PARTITION BY entity, signal_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY entity, signal_id ORDER BY ts RANGE BETWEEN INTERVAL 180 MINUTE PRECEDING AND CURRENT ROW))
SELECT * FROM r WHERE observation_id IS NOT NULL"""))
def rolling_mean_std(t):
    asks = decision_times(t).select("entity", "observation_id", "as_of", s.each_of(SIGNALS).alias("signal_id"))
    out = s.window_stats(asks, telemetry(t), keys=["entity", "signal_id"], query_id="observation_id", query_ts="as_of", ts="ts")
    return out.select("entity", "observation_id", "signal_id",
                      *[F.round(n, 6).alias(n) for n in ("mean_60m", "std_60m", "mean_180m", "std_180m")])


@query("quality_rolling", with_views("pak", """
SELECT q.entity, q.observation_id, round(avg(h.value) FILTER (h.measured_at >= q.measured_at - INTERVAL 120 MINUTE), 6) AS mean_60m,
  round(stddev_pop(h.value) FILTER (h.measured_at >= q.measured_at - INTERVAL 120 MINUTE), 6) AS std_60m,
  round(avg(h.value), 6) AS mean_180m, round(stddev_pop(h.value), 6) AS std_180m
FROM pak q LEFT JOIN pak h ON h.entity = q.entity AND h.measured_at BETWEEN q.measured_at - INTERVAL 240 MINUTE AND q.measured_at - INTERVAL 60 MINUTE
GROUP BY 1, 2"""))
def quality_rolling(t):
    out = s.window_stats(decision_times(t), analyser(t), keys=["entity"], query_id="observation_id",
                         query_ts="as_of", ts="measured_at", windows=(60, 180))
    return out.select("entity", "observation_id", *[F.round(n, 6).alias(n) for n in ("mean_60m", "std_60m", "mean_180m", "std_180m")])


@query("rolling_min_max_range", with_views("frame pakg", """
SELECT q.entity, q.target_at, min(h.value) FILTER (h.measured_at >= q.as_of - INTERVAL 30 MINUTE) AS min_30m,
  max(h.value) FILTER (h.measured_at >= q.as_of - INTERVAL 30 MINUTE) AS max_30m,
  min(h.value) FILTER (h.measured_at >= q.as_of - INTERVAL 60 MINUTE) AS min_60m,
  max(h.value) FILTER (h.measured_at >= q.as_of - INTERVAL 60 MINUTE) AS max_60m, min(h.value) AS min_180m, max(h.value) AS max_180m,
  round(max_30m - min_30m, 6) AS range_30m, round(max_60m - min_60m, 6) AS range_60m, round(max(h.value) - min(h.value), 6) AS range_180m
FROM frame q LEFT JOIN pakg h ON h.entity = q.entity AND h.measured_at BETWEEN q.as_of - INTERVAL 180 MINUTE AND q.as_of
GROUP BY 1, 2"""))
def rolling_min_max_range(t):
    series = analyser_grid(t)
    asks = series.select("entity", F.col("measured_at").alias("target_at"), plus_minutes("measured_at", -60).alias("as_of"))
    out = s.window_stats(asks, series, keys=["entity"], query_id="target_at", query_ts="as_of", ts="measured_at",
                         windows=(30, 60, 180), stats=("min", "max"))
    return out.withColumns({f"range_{w}m": F.round(F.col(f"max_{w}m") - F.col(f"min_{w}m"), 6) for w in (30, 60, 180)})


@query("slope_acceleration", with_views("frame pakg", """
WITH l AS (SELECT f.entity, f.target_at, f.baseline, m.lag, h.value FROM (
   SELECT entity, target_at, baseline, lag, as_of - lag * INTERVAL 1 MINUTE AS cutoff FROM frame, (SELECT unnest([30, 60]) AS lag)) f
   JOIN (SELECT unnest([30, 60]) AS lag) m ON m.lag = f.lag
   ASOF LEFT JOIN pakg h ON h.entity = f.entity AND f.cutoff >= h.measured_at)
SELECT entity, target_at, round((baseline - v30) / 30, 6) AS slope_30m, round((baseline - v60) / 60, 6) AS slope_60m,
  round((baseline - v30) / 30 - (baseline - v60) / 60, 6) AS acceleration_30_60m
FROM (SELECT entity, target_at, baseline, max(value) FILTER (lag = 30) AS v30, max(value) FILTER (lag = 60) AS v60 FROM l GROUP BY ALL)"""))
def slope_acceleration(t):
    series = analyser_grid(t)
    asks = series.select("entity", F.col("measured_at").alias("target_at"), plus_minutes("measured_at", -60).alias("as_of"))
    lags = lag_table(asks, series, keys=["entity"], query_ts="as_of", ts="measured_at", lags=(0, 30, 60), chunking=GRID)
    s30, s60 = (F.col("lag_0m") - F.col("lag_30m")) / 30.0, (F.col("lag_0m") - F.col("lag_60m")) / 60.0
    return lags.select("entity", "target_at", F.round(s30, 6).alias("slope_30m"), F.round(s60, 6).alias("slope_60m"),
                       F.round(s30 - s60, 6).alias("acceleration_30_60m"))


@query("exceedance_episodes", with_views("pakx", """
SELECT entity, measured_at, value, CAST(episode_id AS BIGINT) AS episode_id,
  CASE WHEN episode_id IS NOT NULL THEN min(measured_at) OVER (PARTITION BY entity, episode_id) END AS episode_start_at FROM pakx"""))
def exceedance_episodes(t):
    return s.exceedance_episodes(analyser_grid(t), keys=["entity"], ts="measured_at", limit=LIMIT, chunking=GRID)


@query("time_since_crossing", with_views("frame pakg", """
WITH ch AS (SELECT entity, measured_at, value, lag(value) OVER (PARTITION BY entity ORDER BY measured_at) AS was FROM pakg)
SELECT f.entity, f.target_at, round((epoch_us(f.as_of) - epoch_us(a.measured_at)) / 60e6, 6) AS since_48_minutes,
  round((epoch_us(f.as_of) - epoch_us(b.measured_at)) / 60e6, 6) AS since_60_minutes,
  round((epoch_us(f.as_of) - epoch_us(r.measured_at)) / 60e6, 6) AS regime_minutes
FROM frame f
ASOF LEFT JOIN (SELECT * FROM ch WHERE was IS NULL OR (value >= 48) <> (was >= 48)) a ON a.entity = f.entity AND f.as_of >= a.measured_at
ASOF LEFT JOIN (SELECT * FROM ch WHERE was IS NULL OR (value >= 60) <> (was >= 60)) b ON b.entity = f.entity AND f.as_of >= b.measured_at
ASOF LEFT JOIN (SELECT * FROM ch WHERE was IS NULL OR (value >= 48)::INT + (value >= 60)::INT <> (was >= 48)::INT + (was >= 60)::INT) r
  ON r.entity = f.entity AND f.as_of >= r.measured_at"""))
def time_since_crossing(t):
    series = analyser_grid(t)
    asks = series.select("entity", F.col("measured_at").alias("target_at"), plus_minutes("measured_at", -60).alias("as_of"))
    out = s.state_ages(asks, series, keys=["entity"], query_ts="as_of", ts="measured_at", thresholds=THRESHOLDS, bands=BANDS, chunking=GRID)
    return out.select("entity", "target_at", *[F.round(n, 6).alias(n) for n in ("since_48_minutes", "since_60_minutes", "regime_minutes")])


CHANGES_SQL = """
ch AS (SELECT *, click - lag(click) OVER w AS d_click, signup - lag(signup) OVER w AS d_signup FROM plant
       WINDOW w AS (PARTITION BY entity ORDER BY ts)),
thr AS (SELECT quantile_cont(abs(d_click), 0.8) FILTER (abs(d_click) > 0 AND ts < TIMESTAMP '2024-01-16') AS t_click,
               quantile_cont(abs(d_signup), 0.8) FILTER (abs(d_signup) > 0 AND ts < TIMESTAMP '2024-01-16') AS t_signup FROM ch),
ctx0 AS (SELECT ch.*, coalesce(abs(d_click) >= 40, FALSE) AS notable_click, coalesce(abs(d_signup) >= 40, FALSE) AS notable_signup FROM ch),
ctx AS (SELECT *, sum((coalesce(abs(d_click) < 40, FALSE) AND coalesce(abs(d_signup) < 40, FALSE))::INT) OVER b = 6 AS steady,
   count(*) OVER a = 18 AND sum((notable_click OR notable_signup)::INT) OVER a = 0 AS quiet,
   count(*) OVER c = 18 AND sum((notable_click OR notable_signup)::INT) OVER c = 0 AS calm_now FROM ctx0
   WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
          a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 18 FOLLOWING),
          c AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 17 PRECEDING AND CURRENT ROW))"""


def context(t):
    return s.change_context(s.control_changes(plant_hours(t), controls=CONTROLS, chunking=GRID), {c: F.lit(40.0) for c in CONTROLS}, chunking=GRID)


@query("control_diff", with_views("plant", f"WITH {CHANGES_SQL} SELECT entity, ts, round(d_click, 6) AS d_click, round(d_signup, 6) AS d_signup FROM ch"))
def control_diff(t):
    return s.control_changes(plant_hours(t), controls=CONTROLS, chunking=GRID).select(
        "entity", "ts", F.round("d_click", 6).alias("d_click"), F.round("d_signup", 6).alias("d_signup"))


@query("stable_before", with_views("plant", f"WITH {CHANGES_SQL} SELECT entity, ts, coalesce(steady, FALSE) AS stable_before FROM ctx"))
def stable_before(t):
    return context(t).select("entity", "ts", "stable_before")


@query("quiet_after", with_views("plant", f"WITH {CHANGES_SQL} SELECT entity, ts, coalesce(quiet, FALSE) AS quiet_after FROM ctx"))
def quiet_after(t):
    return context(t).select("entity", "ts", "quiet_after")


@query("calm_rows", with_views("plant", f"WITH {CHANGES_SQL} SELECT entity, ts, coalesce(calm_now, FALSE) AS calm FROM ctx"))
def calm_rows(t):
    return context(t).select("entity", "ts", "calm")


def episodes(t):
    return episode_frame(analyser_grid(t), limit=LIMIT, thresholds=THRESHOLDS, bands=BANDS, chunking=GRID)


@query("horizon_crossing", with_views("epi", """
SELECT entity, as_of, crossing_10m, crossing_20m, crossing_30m, crossing_60m, y_10m, y_60m FROM epi"""))
def horizon_crossing(t):
    return labels(t).select("entity", "as_of", *[f"crossing_{h}m" for h in (10, 20, 30, 60)], "y_10m", "y_60m")


def labels(t):
    from assaylake.operators.features import label_horizons

    series = analyser_grid(t)
    numbered = s.exceedance_episodes(series, keys=["entity"], ts="measured_at", limit=LIMIT, chunking=GRID)
    frame = series.select("entity", plus_minutes("measured_at", -60).alias("as_of"), F.col("measured_at").alias("target_at"))
    return label_horizons(frame, numbered, keys=["entity"], ts="measured_at", limit=LIMIT)


@query("first_future_event", with_views("episodes", """
SELECT entity, as_of, event_id, event_start_at FROM episodes"""))
def first_future_event(t):
    return labels(t).select("entity", "as_of", "event_id", "event_start_at")


@query("latest_per_source", with_views("hours quality tele", f"""
WITH {STATE_SQL} SELECT entity, as_of, signal_id, source, value, measured_at FROM cand"""))
def latest_per_source(t):
    return st.latest_per_source(hour_grid(t), all_observations(t), WANTED).select(
        "entity", "as_of", "signal_id", "source", F.col("usable.value").alias("value"), F.col("usable.measured_at").alias("measured_at"))


SELECTED_SQL = """
sel AS (SELECT entity, as_of, signal_id, arg_min(source, rk) AS source, arg_min(value, rk) AS value, arg_min(age, rk) AS age,
    coalesce(arg_min(age <= fresh_minutes, rk), FALSE) AS fresh
  FROM (SELECT *, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY entity, as_of, signal_id
         ORDER BY (value IS NULL)::INT, {stale} priority, measured_at DESC) END AS rk FROM cand) GROUP BY 1, 2, 3)"""


@query("select_by_priority", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="(age > fresh_minutes)::INT,")}
SELECT entity, as_of, signal_id, source, value, round(age * 60, 3) AS age_seconds, fresh,
  CASE WHEN value IS NULL THEN 'MISSING_REQUIRED_SIGNAL' WHEN NOT fresh THEN 'STALE_REQUIRED_SIGNAL' END AS issue FROM sel"""))
def select_by_priority(t):
    return snapshot(t).select(
        "entity", "as_of", "signal_id", F.col("selected.source").alias("source"), F.col("selected.value").alias("value"),
        F.round("age_seconds", 3).alias("age_seconds"), "fresh", "issue")


@query("monotone_probability", with_views("episodes", """
SELECT entity, as_of, p * 0.9 AS p_10m, greatest(p * 0.9, p * p) AS p_20m, greatest(p * 0.9, p * p, p * 0.5 + 0.2) AS p_30m,
  greatest(p * 0.9, p * p, p * 0.5 + 0.2, p) AS p_60m FROM episodes WHERE p IS NOT NULL"""))
def monotone_probability(t):
    from assaylake.functions.scalars import running_maximum
    from assaylake.plans.frames import scored_episodes

    p = F.col("p")
    raw = {"p_10m": p * 0.9, "p_20m": p * p, "p_30m": p * 0.5 + 0.2, "p_60m": p}
    return scored_episodes(t).filter(p.isNotNull()).select("entity", "as_of", *running_maximum(raw))


@query("episode_month_weights", with_views("episodes", """
WITH w0 AS (SELECT entity, as_of, date_trunc('week', as_of) AS period, crossing_60m,
    CASE WHEN crossing_60m THEN 1.0 / count(*) OVER (PARTITION BY entity, event_id, crossing_60m) END AS share FROM episodes),
w1 AS (SELECT *, CASE WHEN crossing_60m THEN share * (SELECT count(*) FILTER (crossing_60m) / sum(share) FROM w0) ELSE 1.0 END AS w FROM w0),
w2 AS (SELECT *, w / sum(w) OVER (PARTITION BY period) AS v FROM w1)
SELECT entity, as_of, round(v * (SELECT count(*) / sum(v) FROM w2), 6) AS weight FROM w2"""))
def episode_month_weights(t):
    from assaylake.operators.splits import episode_weights
    from assaylake.plans.frames import scored_episodes

    frame = scored_episodes(t).withColumn("period", F.date_trunc("week", "as_of"))
    return episode_weights(frame, period="period").select("entity", "as_of", F.round("weight", 6).alias("weight"))


@query("isolated_changes", with_views("plant", """
WITH d AS (SELECT *, click - lag(click) OVER w AS d_click, signup - lag(signup) OVER w AS d_signup, lag(ts) OVER w AS prev_ts,
   lag(sulfur) OVER w AS baseline FROM plant WINDOW w AS (PARTITION BY entity ORDER BY ts)),
c AS (SELECT *, CASE WHEN abs(d_click) >= 40 THEN 'click' ELSE 'signup' END AS control_id FROM d
      WHERE coalesce(abs(d_click) >= 40, FALSE)::INT + coalesce(abs(d_signup) >= 40, FALSE)::INT = 1),
ok AS (SELECT c.entity, c.ts FROM c JOIN d b ON b.entity = c.entity AND b.ts < c.ts AND b.ts >= c.ts - INTERVAL 240 MINUTE
  GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) = count(b.click) AND count(*) = count(b.signup) AND count(*) = count(b.sulfur)
    AND coalesce(max(abs(b.d_click)) FILTER (b.prev_ts >= c.ts - INTERVAL 240 MINUTE), 0) < 40
    AND coalesce(max(abs(b.d_signup)) FILTER (b.prev_ts >= c.ts - INTERVAL 240 MINUTE), 0) < 40)
SELECT c.entity, c.ts AS changed_at, c.control_id, round(CASE c.control_id WHEN 'click' THEN d_click ELSE d_signup END, 6) AS control_delta,
  c.baseline AS baseline_quality, round(f1.sulfur - c.baseline, 6) AS delta_quality_60m, round(f2.sulfur - c.baseline, 6) AS delta_quality_120m
FROM c JOIN ok ON ok.entity = c.entity AND ok.ts = c.ts
JOIN plant f1 ON f1.entity = c.entity AND f1.ts = c.ts + INTERVAL 60 MINUTE
JOIN plant f2 ON f2.entity = c.entity AND f2.ts = c.ts + INTERVAL 120 MINUTE
WHERE f1.sulfur IS NOT NULL AND f2.sulfur IS NOT NULL"""))
def isolated_changes(t):
    out = s.isolated_changes(plant_hours(t), {c: 40.0 for c in CONTROLS}, target="sulfur", horizons=(60, 120), stable_minutes=240, chunking=GRID)
    return out.select("entity", "changed_at", "control_id", "baseline_quality",
                      *[F.round(n, 6).alias(n) for n in ("control_delta", "delta_quality_60m", "delta_quality_120m")])


@query("event_lead_window", with_views("episodes", """
SELECT entity, as_of, coalesce(as_of >= event_start_at - INTERVAL 60 MINUTE AND as_of <= event_start_at - INTERVAL 10 MINUTE, FALSE) AS in_lead FROM episodes"""))
def event_lead_window(t):
    from assaylake.operators.metrics import lead_window

    return labels(t).select("entity", "as_of", lead_window("as_of", "event_start_at").alias("in_lead"))


@query("half_split", with_views("scored", """
SELECT observation_id, CASE WHEN row_number() OVER (ORDER BY as_of, observation_id) <= (SELECT count(*) FROM scored WHERE split = 'validation') // 2
  THEN 1 ELSE 2 END AS half FROM scored WHERE split = 'validation'"""))
def half_split(t):
    from assaylake.plans.frames import scored

    return s.half_split(scored(t).filter(F.col("split") == "validation"), ["as_of", "observation_id"]).select("observation_id", "half")
