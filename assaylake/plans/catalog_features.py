"""Feature frames, episode frames, snapshots and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.scalars import rounded
from assaylake.functions.timecols import minutes_between
from assaylake.operators import features as ft
from assaylake.plans.catalog_joins import STATE_SQL, snapshot
from assaylake.plans.catalog_windows import SELECTED_SQL, episodes
from assaylake.plans.registry import query
from assaylake.sources.adapters import SIGNALS, analyser, hour_grid, telemetry, with_views

CHECKED = ("click__lag_0m", "click__delta_60m", "view__mean_60m", "target__lag_30m", "target__std_180m", "target__age_minutes")


def supervised_frame(t):
    series = analyser(t)
    return ft.supervised(series, telemetry(t), series, signals=SIGNALS)


@query("supervised_dataset", with_views("sup tele", """
WITH c0 AS (SELECT s.observation_id, s.entity, CASE WHEN e.ts >= s.as_of - INTERVAL 20 MINUTE THEN e.value END AS v FROM sup s ASOF LEFT JOIN (SELECT * FROM tele WHERE signal_id = 'click') e ON e.entity = s.entity AND s.as_of >= e.ts),
c60 AS (SELECT s.observation_id, s.entity, CASE WHEN e.ts >= s.as_of - INTERVAL 80 MINUTE THEN e.value END AS v FROM sup s ASOF LEFT JOIN (SELECT * FROM tele WHERE signal_id = 'click') e ON e.entity = s.entity AND s.as_of - INTERVAL 60 MINUTE >= e.ts),
l30 AS (SELECT s.observation_id, s.entity, e.value AS v FROM sup s ASOF LEFT JOIN pak e ON e.entity = s.entity AND s.as_of - INTERVAL 30 MINUTE >= e.measured_at),
vm AS (SELECT s.observation_id, s.entity, avg(e.value) AS v FROM sup s LEFT JOIN tele e ON e.entity = s.entity AND e.signal_id = 'view' AND e.ts BETWEEN s.as_of - INTERVAL 60 MINUTE AND s.as_of GROUP BY 1, 2),
sd AS (SELECT s.observation_id, s.entity, stddev_pop(e.value) AS v FROM sup s LEFT JOIN pak e ON e.entity = s.entity AND e.measured_at BETWEEN s.as_of - INTERVAL 180 MINUTE AND s.as_of GROUP BY 1, 2)
SELECT s.observation_id, s.as_of, s.target_at, s.y, s.baseline, round(c0.v, 6) AS click__lag_0m, round(c0.v - c60.v, 6) AS click__delta_60m, round(vm.v, 6) AS view__mean_60m,
  l30.v AS target__lag_30m, round(sd.v, 6) AS target__std_180m, round(s.age_minutes, 3) AS target__age_minutes
FROM sup s JOIN c0 USING (observation_id) JOIN c60 USING (observation_id) JOIN l30 USING (observation_id) JOIN vm USING (observation_id) JOIN sd USING (observation_id)"""))
def supervised_dataset(t):
    out = supervised_frame(t).select("observation_id", "as_of", "target_at", "y", "baseline", *CHECKED)
    return rounded(rounded(out, CHECKED[:-1]), CHECKED[-1:], 3)


def serving_frame(t):
    asks = hour_grid(t).withColumn("query_id", F.col("as_of"))
    return ft.feature_frame(asks, telemetry(t), analyser(t), query_id="query_id", query_ts="as_of", signals=SIGNALS)


@query("serving_features", with_views("hours pak tele", """
SELECT h.entity, h.as_of, q.value AS target__last, CASE WHEN e.ts >= h.as_of - INTERVAL 20 MINUTE THEN e.value END AS click__lag_0m
FROM hours h ASOF LEFT JOIN pak q ON q.entity = h.entity AND h.as_of >= q.measured_at
ASOF LEFT JOIN (SELECT * FROM tele WHERE signal_id = 'click') e ON e.entity = h.entity AND h.as_of >= e.ts"""))
def serving_features(t):
    frame = serving_frame(t)
    ft.check_recipe(frame.columns, ft.feature_names(SIGNALS))
    return frame.select("entity", "as_of", "target__last", "click__lag_0m")


@query("episode_dataset", with_views("episodes", """
SELECT entity, as_of, baseline, y_60m, crossing_60m, event_id, event_start_at, round(y_60m - baseline, 6) AS delta_60m FROM episodes"""))
def episode_dataset(t):
    return rounded(episodes(t).select("entity", "as_of", "baseline", "y_60m", "crossing_60m", "event_id", "event_start_at", "delta_60m"), ("delta_60m",))


@query("state_snapshot", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="(age > fresh_minutes)::INT,")}
SELECT entity, as_of, count(*) AS signals, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value IS NOT NULL AND NOT fresh) AS stale, round(min(age) * 60, 3) AS youngest_seconds FROM sel GROUP BY 1, 2"""))
def state_snapshot(t):
    return rounded(snapshot(t).groupBy("entity", "as_of").agg(
        F.count("*").alias("signals"), F.count_if(F.col("issue") == "MISSING_REQUIRED_SIGNAL").alias("missing"),
        F.count_if(F.col("issue") == "STALE_REQUIRED_SIGNAL").alias("stale"), F.min("age_seconds").alias("youngest_seconds")), ("youngest_seconds",), 3)


@query("state_identity")
def state_identity(t):
    from assaylake.operators.state import state_ids

    return state_ids(snapshot(t), "events")


@query("stage_dashboard", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="")}
SELECT entity, as_of, CASE WHEN signal_id = 'ht:sulfur' THEN 'quality' ELSE 'process' END AS page_group, signal_id, value, source, round(CASE WHEN age IS NOT NULL THEN greatest(age, 0) END, 3) AS age_minutes,
  CASE WHEN value IS NULL THEN 'missing' WHEN fresh THEN 'fresh' ELSE 'stale' END AS freshness FROM sel"""))
def stage_dashboard(t):
    groups = t.spark.createDataFrame([("ht:sulfur", "quality"), ("click", "process"), ("view", "process")], "signal_id string, page_group string")
    rows = snapshot(t, prefer_fresh=False).join(groups, "signal_id")
    return rounded(rows.select(
        "entity", "as_of", "page_group", "signal_id", F.col("selected.value").alias("value"), F.col("selected.source").alias("source"),
        F.when(F.col("selected").isNotNull(), F.greatest(minutes_between("as_of", "selected.measured_at"), F.lit(0.0))).alias("age_minutes"),
        F.when(F.col("selected").isNull(), "missing").when(F.col("fresh"), "fresh").otherwise("stale").alias("freshness")), ("age_minutes",), 3)
