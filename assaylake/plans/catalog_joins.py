"""As-of, interval and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.timecols import minutes_between, plus_minutes
from assaylake.operators import asof as a
from assaylake.operators.chunks import GRID
from assaylake.operators import cleanse as c
from assaylake.operators.series import lag_values, steps_ahead
from assaylake.operators.state import latest_per_source, missing_required, state_snapshot
from assaylake.plans.registry import query
from assaylake.sources.adapters import (
    SIGNALS, analyser, analyser_grid, hour_grid, late_lab, plant_hours, plant_of, quality, telemetry, with_views,
)


@query("merge_telemetry", """
WITH one AS (SELECT user_id // 150 AS entity, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, round(avg(value), 6) AS click
             FROM events WHERE event_type = 'click' GROUP BY 1, 2),
     two AS (SELECT user_id // 150 AS entity, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, round(avg(value), 6) AS signup
             FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT entity, ts, click, signup FROM one FULL JOIN two USING (entity, ts)""")
def merge_telemetry(t):
    def installation(name):
        from assaylake.functions.timecols import floor_minutes

        return (
            t.events.filter(F.col("event_type") == name)
            .groupBy(plant_of(), floor_minutes("ts", 60).alias("ts"))
            .agg(F.round(F.avg("value"), 6).alias(name))
        )

    return installation("click").join(installation("signup"), ["entity", "ts"], "full")


def decision_times(t):
    return analyser(t).select(
        "entity", "observation_id", plus_minutes("measured_at", -60).alias("as_of"), "measured_at", "value"
    )


@query("asof_backward_tol", with_views("pak tele", """
SELECT q.entity, q.observation_id, q.signal_id, q.lag,
  CASE WHEN e.ts >= q.cutoff - INTERVAL 20 MINUTE THEN e.value END AS value
FROM (SELECT entity, observation_id, s.signal_id, l.lag, measured_at - INTERVAL 60 MINUTE - l.lag * INTERVAL 1 MINUTE AS cutoff
      FROM pak, (SELECT unnest(['click', 'signup', 'view']) AS signal_id) s, (SELECT unnest([0, 10, 30, 60, 180]) AS lag) l) q
ASOF LEFT JOIN tele e ON q.entity = e.entity AND q.signal_id = e.signal_id AND q.cutoff >= e.ts"""))
def asof_backward_tol(t):
    return lag_values(
        decision_times(t), telemetry(t), query_id="observation_id", query_ts="as_of", signals=SIGNALS
    )


@query("asof_backward", with_views("pak tele", """
SELECT q.entity, q.observation_id, e.value AS click, e.ts AS click_at
FROM pak q ASOF LEFT JOIN (SELECT * FROM tele WHERE signal_id = 'click') e ON q.entity = e.entity AND q.measured_at >= e.ts"""))
def asof_backward(t):
    clicks = telemetry(t).filter(F.col("signal_id") == "click").drop("signal_id")
    return a.asof(
        analyser(t).select("entity", "observation_id", "measured_at"), clicks, keys=["entity"],
        query_ts="measured_at", event_ts="ts", take=["value"], prefix="e_",
    ).select("entity", "observation_id", F.col("e_value").alias("click"), F.col("e_ts").alias("click_at"))


NEAREST = """
nearest AS (SELECT q.entity, q.observation_id, q.value AS lims, q.at,
  CASE WHEN bt IS NOT NULL AND (ft IS NULL OR epoch_us(q.at) - epoch_us(bt) <= epoch_us(ft) - epoch_us(q.at)) THEN bv ELSE fv END AS pak
 FROM (SELECT q.*, CASE WHEN b.measured_at >= q.at - INTERVAL 20 MINUTE THEN b.measured_at END AS bt,
        CASE WHEN b.measured_at >= q.at - INTERVAL 20 MINUTE THEN b.value END AS bv,
        CASE WHEN f.measured_at <= q.at + INTERVAL 20 MINUTE THEN f.measured_at END AS ft,
        CASE WHEN f.measured_at <= q.at + INTERVAL 20 MINUTE THEN f.value END AS fv
  FROM shifted q ASOF LEFT JOIN pak b ON q.entity = b.entity AND q.at >= b.measured_at
  ASOF LEFT JOIN pak f ON q.entity = f.entity AND q.at <= f.measured_at) q)"""


@query("asof_nearest_tol", with_views("pak lims", f"""
WITH shifted AS (SELECT *, measured_at AS at FROM lims), {NEAREST}
SELECT entity, observation_id, lims, pak FROM nearest"""))
def asof_nearest_tol(t):
    lab = c.eligible(quality(t), "lims").select(
        "entity", "observation_id", F.col("value").alias("lims"), F.col("measured_at").alias("at"))
    series = analyser(t).select("entity", "measured_at", F.col("value").alias("pak"))
    return a.asof_nearest(
        lab, series, keys=["entity"], query_ts="at", event_ts="measured_at", take=["pak"], tolerance_minutes=20
    ).select("entity", "observation_id", "lims", "pak")


@query("asof_exact", with_views("steps", """
SELECT entity, as_of, step, value, CAST(episode_id AS BIGINT) AS episode_id FROM steps"""))
def asof_exact(t):
    from assaylake.operators.features import STEPS
    from assaylake.operators.series import exceedance_episodes
    from assaylake.sources.adapters import LIMIT

    series = analyser_grid(t)
    numbered = exceedance_episodes(series, keys=["entity"], ts="measured_at", limit=LIMIT, chunking=GRID)
    frame = series.select("entity", plus_minutes("measured_at", -60).alias("as_of"))
    return steps_ahead(frame, numbered, keys=["entity"], as_of="as_of", ts="measured_at", steps=STEPS).select(
        "entity", "as_of", "step", "value", "episode_id"
    )


@query("asof_forward_tol", with_views("tele pak", """
SELECT q.entity, q.signal_id, q.ts, CASE WHEN p.measured_at <= q.ts + INTERVAL 70 MINUTE THEN p.value END AS value_60m
FROM tele q
ASOF LEFT JOIN pak p ON q.entity = p.entity AND q.ts + INTERVAL 60 MINUTE <= p.measured_at"""))
def asof_forward_tol(t):
    views = telemetry(t).select("entity", "signal_id", "ts")
    return a.asof(
        views, analyser(t).select("entity", "measured_at", "value"), keys=["entity"],
        query_ts=plus_minutes("ts", 60), event_ts="measured_at", take=["value"], direction="forward",
        tolerance_minutes=10, prefix="p_",
    ).select("entity", "signal_id", "ts", F.col("p_value").alias("value_60m"))


@query("asof_bitemporal", with_views("pak late", """
SELECT q.entity, q.observation_id, arg_max(l.value, l.measured_at) AS last_value,
  round((epoch_us(any_value(q.measured_at)) - epoch_us(max(l.measured_at))) / 60e6, 3) AS age_minutes
FROM pak q LEFT JOIN late l ON l.entity = q.entity AND l.available_at <= q.measured_at GROUP BY 1, 2"""))
def asof_bitemporal(t):
    return a.asof_published(
        analyser(t).select("entity", "observation_id", "measured_at"), late_lab(t), keys=["entity"],
        query_ts="measured_at",
    ).select("entity", "observation_id", "last_value", F.round("age_minutes", 3).alias("age_minutes"))


@query("asof_published_depth", with_views("pak late", """
SELECT q.entity, q.observation_id, h.value AS lims_published_lag_0, h.v1 AS lims_published_lag_1, h.v2 AS lims_published_lag_2,
  round((epoch_us(q.measured_at) - epoch_us(h.measured_at)) / 60e6, 3) AS lims_age_minutes_0,
  round((epoch_us(q.measured_at) - epoch_us(h.m2)) / 60e6, 3) AS lims_age_minutes_2
FROM pak q ASOF LEFT JOIN (
  SELECT *, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(measured_at, 2) OVER w AS m2 FROM late
  WINDOW w AS (PARTITION BY entity ORDER BY available_at, measured_at, observation_id)) h
ON q.entity = h.entity AND q.measured_at >= h.available_at"""))
def asof_published_depth(t):
    return a.published_depth(
        analyser(t).select("entity", "observation_id", "measured_at"), late_lab(t), keys=["entity"],
        query_ts="measured_at",
    ).select(
        "entity", "observation_id", *[f"lims_published_lag_{k}" for k in range(3)],
        *[F.round(f"lims_age_minutes_{k}", 3).alias(f"lims_age_minutes_{k}") for k in (0, 2)],
    )


@query("self_join_horizon", with_views("plant", """
SELECT a.entity, a.ts, a.sulfur, b.sulfur AS sulfur_60m FROM plant a
LEFT JOIN plant b ON b.entity = a.entity AND b.ts = a.ts + INTERVAL 60 MINUTE"""))
def self_join_horizon(t):
    plant = plant_hours(t).select("entity", "ts", "sulfur")
    ahead = plant.select(
        "entity", plus_minutes("ts", -60).alias("ts"), F.col("sulfur").alias("sulfur_60m"))
    return plant.join(ahead, ["entity", "ts"], "left")


@query("tag_antijoin", """
SELECT p_type AS raw_name, count(*) AS n FROM part
WHERE 'avt:' || p_type NOT IN (SELECT 'avt:' || p_brand FROM part) GROUP BY 1
UNION ALL SELECT p_brand, count(*) FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 7 = 0 GROUP BY 1""")
def tag_antijoin(t):
    from assaylake.plans.catalog_cleanse import brand_tags

    names = t.part.groupBy(F.col("p_type").alias("raw_name")).agg(F.count("*").alias("n")).unionByName(
        t.part.groupBy(F.col("p_brand").alias("raw_name")).agg(F.count("*").alias("n")))
    confirmed = brand_tags(t).filter(F.col("mapping_status") == "confirmed").select(
        F.substring_index("raw_name", ":", -1).alias("raw_name"))
    return names.join(confirmed, "raw_name", "left_anti")


WANTED = [("ht:sulfur", "pak"), ("ht:sulfur", "lims"), ("click", "telemetry"), ("view", "telemetry")]


def all_observations(t):
    """Quality rows and telemetry rows in one bitemporal shape."""
    tele = telemetry(t).select(
        "entity", F.concat_ws("@", "signal_id", F.col("ts").cast("string")).alias("observation_id"), "signal_id",
        F.lit("telemetry").alias("source"), F.col("ts").alias("measured_at"), F.col("ts").alias("available_at"),
        "value", F.lit("unknown").alias("unit"), F.lit("valid").alias("validity"),
        F.lit("telemetry").alias("source_ref"),
    )
    return quality(t).drop("stage").unionByName(tele)


def snapshot(t, prefer_fresh: bool = True):
    latest = latest_per_source(hour_grid(t), all_observations(t), WANTED)
    return state_snapshot(latest, prefer_fresh=prefer_fresh)


STATE_SQL = """
obs AS (SELECT entity, signal_id, source, measured_at, available_at, value, validity = 'valid' AND value IS NOT NULL AS ok FROM quality
  UNION ALL SELECT entity, signal_id, 'telemetry', ts, ts, value, value IS NOT NULL FROM tele),
asks AS (SELECT h.entity, h.as_of, w.signal_id, w.source, w.priority, w.fresh_minutes FROM hours h,
  (SELECT unnest(['ht:sulfur', 'ht:sulfur', 'click', 'view']) AS signal_id, unnest(['pak', 'lims', 'telemetry', 'telemetry']) AS source,
          unnest([1, 0, 3, 3]) AS priority, unnest([30, 2880, 20, 20]) AS fresh_minutes) w),
cand AS (SELECT a.*, o.value, o.measured_at, (epoch_us(a.as_of) - epoch_us(o.measured_at)) / 60e6 AS age
  FROM asks a ASOF LEFT JOIN (SELECT * FROM obs WHERE ok) o
  ON a.entity = o.entity AND a.signal_id = o.signal_id AND a.source = o.source AND a.as_of >= o.available_at)"""


@query("missing_required", with_views("hours quality tele", f"""
WITH {STATE_SQL} SELECT entity, as_of, signal_id FROM cand GROUP BY 1, 2, 3 HAVING count(value) = 0"""))
def missing_required_signals(t):
    return missing_required(snapshot(t))


@query("window_join_bitemporal", with_views("pak late", """
SELECT q.entity, q.observation_id, round(avg(l.value), 6) AS mean_180m, round(stddev_pop(l.value), 6) AS std_180m, count(l.value) AS n_180m
FROM pak q LEFT JOIN late l ON l.entity = q.entity AND l.measured_at <= q.measured_at
  AND l.measured_at >= q.measured_at - INTERVAL 180 MINUTE AND l.available_at <= q.measured_at GROUP BY 1, 2"""))
def window_join_bitemporal(t):
    asks = analyser(t).select("entity", "observation_id", F.col("measured_at").alias("as_of"))
    out = a.window_published(
        asks, late_lab(t), keys=["entity"], query_id="observation_id", query_ts="as_of", minutes=180)
    return out.select(
        "entity", "observation_id", F.round("mean_180m", 6).alias("mean_180m"),
        F.round("std_180m", 6).alias("std_180m"), F.coalesce("n_180m", F.lit(0)).alias("n_180m"),
    )
