"""Metrics, thresholds, splits and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as sc
from assaylake.functions.labels import GRADE_LIMITS
from assaylake.functions.timecols import minutes_between, month_key, plus_minutes
from assaylake.operators import metrics as m
from assaylake.operators import splits as sp
from assaylake.operators.asof import asof, asof_nearest
from assaylake.operators.cleanse import eligible
from assaylake.operators.quantiles import exact_quantiles
from assaylake.operators.state import freshness_summary as fresh_counts
from assaylake.operators.thresholds import event_threshold
from assaylake.plans.catalog_joins import NEAREST, STATE_SQL, snapshot
from assaylake.plans.catalog_windows import CHANGES_SQL, CONTROLS, SELECTED_SQL
from assaylake.plans.frames import persistence, scored, scored_episodes
from assaylake.plans.registry import query
from assaylake.session import materialise
from assaylake.sources.adapters import (
    LIMIT, NEAR_LOWER, NEAR_UPPER, SIGNALS, analyser, plant_hours, quality, telemetry, with_views,
)

NEAR = (NEAR_LOWER, NEAR_UPPER)


def r6(df, *names):
    return sc.rounded(df, names)


REG = """count(*) AS n, round(avg(abs(y - {p})), 6) AS mae, count(*) FILTER (y BETWEEN 48 AND 72) AS near_n,
  round(avg(abs(y - {p})) FILTER (y BETWEEN 48 AND 72), 6) AS near_mae,
  count(*) FILTER (y > 60 AND {p} <= 60) AS missed, count(*) FILTER (y > 60) AS exceedances,
  round(count(*) FILTER (y > 60 AND {p} <= 60) / nullif(count(*) FILTER (y > 60), 0), 6) AS missed_rate,
  count(*) FILTER (y <= 60 AND {p} > 60) AS false_alarms, count(*) FILTER (y <= 60) AS non_exceedances,
  round(count(*) FILTER (y <= 60 AND {p} > 60) / nullif(count(*) FILTER (y <= 60), 0), 6) AS false_alarm_rate"""


def regression(df, p):
    out = df.agg(*m.regression_columns(F.col("y"), F.col(p), limit=LIMIT, near=NEAR))
    return r6(out, "mae", "near_mae", "missed_rate", "false_alarm_rate")


@query("regression_metrics", with_views("scored", f"SELECT {REG.format(p='baseline')} FROM scored"))
def regression_metrics(t):
    return regression(persistence(t).filter(F.col("baseline").isNotNull()), "baseline")


AGE_SQL = """CASE WHEN age_minutes <= 30 THEN '<=30m' WHEN age_minutes <= 120 THEN '30-120m' WHEN age_minutes <= 360 THEN '2-6h'
  WHEN age_minutes <= 1440 THEN '6-24h' ELSE '>24h' END"""


#: The model's features in SQL, for every target.
FEATURE_SQL = """
lagged AS (SELECT s.observation_id, g.signal_id, CASE WHEN e.ts >= s.as_of - INTERVAL 20 MINUTE THEN e.value END AS v
  FROM (SELECT * FROM sup, (SELECT unnest(['click', 'signup']) AS signal_id)) s JOIN (SELECT unnest(['click', 'signup']) AS signal_id) g USING (signal_id)
  ASOF LEFT JOIN tele e ON e.entity = s.entity AND e.signal_id = s.signal_id AND s.as_of >= e.ts),
hour_ago AS (SELECT s.observation_id, e.value AS v FROM sup s ASOF LEFT JOIN pak e ON e.entity = s.entity AND s.as_of - INTERVAL 60 MINUTE >= e.measured_at),
views AS (SELECT s.observation_id, avg(e.value) AS v FROM sup s LEFT JOIN tele e ON e.entity = s.entity AND e.signal_id = 'view'
  AND e.ts BETWEEN s.as_of - INTERVAL 180 MINUTE AND s.as_of GROUP BY 1),
past AS (SELECT s.observation_id, avg(e.value) AS m, stddev_pop(e.value) AS sd FROM sup s LEFT JOIN pak e ON e.entity = s.entity
  AND e.measured_at BETWEEN s.as_of - INTERVAL 180 MINUTE AND s.as_of GROUP BY 1),
feat AS MATERIALIZED (SELECT s.observation_id, s.as_of, s.target_at, s.y, s.baseline, s.age_minutes, sc.split,
    round(c.v, 6) AS click__lag_0m, round(w.v, 6) AS view__mean_180m, round(u.v, 6) AS signup__lag_0m, round(s.baseline, 6) AS target__last,
    round(s.age_minutes, 6) AS target__age_minutes, round(h.v, 6) AS target__lag_60m, round(p.m, 6) AS target__mean_180m, round(p.sd, 6) AS target__std_180m
  FROM sup s JOIN lagged c ON c.observation_id = s.observation_id AND c.signal_id = 'click' JOIN lagged u ON u.observation_id = s.observation_id AND u.signal_id = 'signup'
  JOIN hour_ago h ON h.observation_id = s.observation_id JOIN views w ON w.observation_id = s.observation_id JOIN past p ON p.observation_id = s.observation_id
  LEFT JOIN scored sc ON sc.observation_id = s.observation_id)"""
FEATURE_NAMES = ("click__lag_0m", "view__mean_180m", "signup__lag_0m", "target__last", "target__age_minutes", "target__lag_60m",
                 "target__mean_180m", "target__std_180m")
FEATURE_LIST = ", ".join(FEATURE_NAMES)


def model_rows(t):
    """Every target with the model's features, rounded as in SQL; the split of those with a baseline."""
    from assaylake.plans.catalog_features import supervised_frame
    from assaylake.sources.adapters import TRAIN_END, VALIDATION_END

    split = F.when(F.col("baseline").isNotNull(), sp.outer_split(TRAIN_END, VALIDATION_END))
    return materialise(sc.rounded(supervised_frame(t), FEATURE_NAMES).withColumn("split", split), "model-rows")


@query("slice_metrics", with_views("scored sup tele", f"""
WITH {FEATURE_SQL},
r AS (SELECT *, strftime(target_at, '%Y-%m') AS month, split AS part, CAST(y BETWEEN 48 AND 72 AS VARCHAR) AS near, {AGE_SQL} AS age,
  CAST({" + ".join(f"({n} IS NULL)::INT" for n in FEATURE_NAMES)} AS VARCHAR) AS missing FROM feat WHERE baseline IS NOT NULL)
SELECT 'month' AS slice, month AS value, {REG.format(p='baseline')} FROM r GROUP BY month
UNION ALL SELECT 'split', part, {REG.format(p='baseline')} FROM r GROUP BY part
UNION ALL SELECT 'near', near, {REG.format(p='baseline')} FROM r GROUP BY near
UNION ALL SELECT 'age', age, {REG.format(p='baseline')} FROM r GROUP BY age
UNION ALL SELECT 'missing', missing, {REG.format(p='baseline')} FROM r GROUP BY missing
UNION ALL SELECT 'source', 'pak', {REG.format(p='baseline')} FROM r"""))
def slice_metrics(t):
    gaps = sum(F.col(n).isNull().cast("int") for n in FEATURE_NAMES)
    rows = model_rows(t).filter("baseline IS NOT NULL").select(
        "y", "baseline", "split", month_key("target_at").alias("month"), F.col("y").between(*NEAR).alias("near"),
        sc.age_bucket(F.col("target__age_minutes")).alias("age"), gaps.cast("string").alias("missing"), F.col("target_source").alias("source"))
    out = m.slice_metrics(rows, ["month", "split", "near", "age", "missing", "source"], F.col("y"), F.col("baseline"), limit=LIMIT, near=NEAR)
    return r6(out, "mae", "near_mae", "missed_rate", "false_alarm_rate")


@query("forecast_coverage", with_views("sup", """
SELECT count(baseline) AS available_predictions, count(*) AS valid_targets, round(count(baseline) / count(*), 6) AS rate FROM sup"""))
def forecast_coverage(t):
    out = persistence(t).agg(
        F.count("baseline").alias("available_predictions"), F.count("*").alias("valid_targets"),
        m.ratio(F.count("baseline"), F.count("*")).alias("rate"))
    return r6(out, "rate")


@query("excluded_counts", with_views("quality sup", """
SELECT (SELECT count(*) FROM quality WHERE source = 'pak') - (SELECT count(*) FROM sup) AS invalid_or_wrong_unit_targets,
       (SELECT count(*) FROM sup WHERE baseline IS NULL) AS missing_baseline"""))
def excluded_counts(t):
    pak = quality(t).filter(F.col("source") == "pak").select(F.lit(1).alias("all_rows"), F.lit(0).alias("kept"), F.lit(0).alias("no_base"))
    sup = persistence(t).select(F.lit(0).alias("all_rows"), F.lit(1).alias("kept"), F.col("baseline").isNull().cast("int").alias("no_base"))
    return pak.unionByName(sup).agg(
        (F.sum("all_rows") - F.sum("kept")).alias("invalid_or_wrong_unit_targets"), F.sum("no_base").alias("missing_baseline"))


@query("binary_alarm_metrics", with_views("scored", """
SELECT count(*) AS n, count(*) FILTER (y > 60) AS positives, count(*) FILTER (y > 60 AND p < 0.3) AS false_negatives,
  round(count(*) FILTER (y > 60 AND p < 0.3) / nullif(count(*) FILTER (y > 60), 0), 6) AS false_negative_rate,
  count(*) FILTER (y <= 60 AND p >= 0.3) AS false_positives,
  round(count(*) FILTER (y <= 60 AND p >= 0.3) / nullif(count(*) FILTER (y <= 60), 0), 6) AS false_positive_rate,
  round(count(*) FILTER (y > 60 AND p >= 0.3) / nullif(count(*) FILTER (p >= 0.3), 0), 6) AS precision,
  round(avg((p - (y > 60)::INT) ** 2), 6) AS brier FROM scored"""))
def binary_alarm_metrics(t):
    out = scored(t).agg(*m.alarm_columns(F.col("y") > LIMIT, F.col("p"), 0.3))
    return r6(out, "false_negative_rate", "false_positive_rate", "precision", "brier")


CURVE_SQL = """
g AS (SELECT p, count(*) FILTER (y > 60) AS pos, count(*) FILTER (y <= 60) AS neg FROM scored GROUP BY p),
curve AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g
          WINDOW w AS (ORDER BY p DESC))"""


@query("average_precision", with_views("scored", f"WITH {CURVE_SQL} SELECT round(sum(pos * tp / (tp + fp)) / max(np), 6) AS average_precision FROM curve"))
def average_precision(t):
    return r6(m.average_precision(scored(t), F.col("p"), F.col("y") > LIMIT), "average_precision")


@query("alarm_threshold", with_views("scored", f"""
WITH {CURVE_SQL} SELECT p AS threshold, round((np - tp) / np, 6) AS false_negative_rate, round(fp / nn, 6) AS false_positive_rate
FROM curve WHERE fp / nn <= 0.2 + 1e-12 ORDER BY (np - tp) / np, p DESC LIMIT 1"""))
def alarm_threshold(t):
    out = m.alarm_threshold(scored(t), F.col("p"), F.col("y") > LIMIT)
    return r6(out, "false_negative_rate", "false_positive_rate")


@query("upper_bound_metrics", with_views("scored", """
SELECT round(avg((y <= upper)::INT), 6) AS coverage, round(avg(upper - point), 6) AS average_width, count(*) AS n FROM scored"""))
def upper_bound_metrics(t):
    return r6(scored(t).agg(*m.upper_columns(F.col("y"), F.col("point"), F.col("upper"))), "coverage", "average_width")


@query("pinball_loss", with_views("scored", """
SELECT round(avg(greatest(0.95 * (y - upper), -0.05 * (y - upper))), 6) AS pinball_loss FROM scored"""))
def pinball_loss(t):
    return r6(scored(t).agg(m.pinball(F.col("y"), F.col("upper"), 0.95).alias("pinball_loss")), "pinball_loss")


@query("robustness_cases", with_views("scored", """
WITH v AS (SELECT *, row_number() OVER (ORDER BY as_of, observation_id) - 1 AS pos, count(*) OVER () AS n FROM scored WHERE split = 'test')
SELECT 'nominal' AS name, TRUE AS available, round(avg((y <= upper)::INT), 6) AS coverage, round(avg(upper - point), 6) AS average_width, count(*) AS n, NULL AS reason_code FROM v
UNION ALL SELECT 'measurement_error', TRUE, round(avg((y + 0.5 <= upper)::INT), 6), round(avg(upper - point), 6), count(*), NULL FROM v
UNION ALL SELECT 'last_quarter', TRUE, round(avg((y <= upper)::INT), 6), round(avg(upper - point), 6), count(*), NULL FROM v WHERE pos >= n * 3 // 4
UNION ALL SELECT 'delayed_source', FALSE, NULL, NULL, 0, 'UNCERTAINTY_UNAVAILABLE'"""))
def robustness_cases(t):
    """Nominal, shifted and late-regime cases; a case without rows is reported, not dropped."""
    from assaylake.operators.series import half_split

    placed = half_split(scored(t).filter(F.col("split") == "test"), ["as_of", "observation_id"])
    n = placed.agg(F.max("position").alias("n")).first()["n"] or 0
    cases = F.array_compact(F.array(
        F.struct(F.lit("nominal").alias("name"), F.lit(0.0).alias("error")),
        F.struct(F.lit("measurement_error").alias("name"), F.lit(0.5).alias("error")),
        F.when(F.col("position") - 1 >= n * 3 // 4, F.struct(F.lit("last_quarter").alias("name"), F.lit(0.0).alias("error"))),
    ))
    rows = placed.select("point", "upper", "y", F.explode(cases).alias("_c")).select(
        F.col("_c.name").alias("name"), (F.col("y") + F.col("_c.error")).alias("y"), "point", "upper")
    figures = rows.groupBy("name").agg(*m.upper_columns(F.col("y"), F.col("point"), F.col("upper")))
    wanted = t.spark.createDataFrame([(n,) for n in ("nominal", "measurement_error", "last_quarter", "delayed_source")], "name string")
    out = wanted.join(figures, "name", "left").select(
        "name", F.col("n").isNotNull().alias("available"), "coverage", "average_width", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n").isNull(), "UNCERTAINTY_UNAVAILABLE").alias("reason_code"))
    return r6(out, "coverage", "average_width")


EVENT_SQL = """
rowsx AS (SELECT *, coalesce(p >= {th}, FALSE) OR coalesce(baseline > 60, FALSE) AS alarm,
   coalesce(as_of >= event_start_at - INTERVAL 60 MINUTE AND as_of <= event_start_at - INTERVAL 10 MINUTE, FALSE) AS lead FROM {src}),
evx AS (SELECT {g} AS g, count(*) AS event_count, count(*) FILTER (hit) AS detected_events FROM
   (SELECT {g}, entity, event_id, bool_or(alarm AND lead) AS hit, bool_or(crossing_60m) AS cnt FROM rowsx WHERE event_id IS NOT NULL GROUP BY ALL) WHERE cnt GROUP BY 1),
hrx AS (SELECT {g} AS g, count(*) FILTER (f) AS false_alarm_opportunities, count(*) AS negative_opportunities FROM
   (SELECT {g}, entity, date_trunc('hour', as_of) AS h, bool_or(alarm) AS f FROM rowsx WHERE NOT crossing_60m AND baseline <= 60 GROUP BY ALL) GROUP BY 1),
rwx AS (SELECT {g} AS g, round(count(*) FILTER (NOT crossing_60m AND baseline <= 60 AND alarm) / nullif(count(*) FILTER (NOT crossing_60m AND baseline <= 60), 0), 6) AS row_false_positive_rate,
   count(*) FILTER (crossing_60m AND NOT alarm) AS row_false_negatives,
   round(count(*) FILTER (crossing_60m AND NOT alarm) / nullif(count(*) FILTER (crossing_60m), 0), 6) AS row_false_negative_rate,
   round(avg((p - crossing_60m::INT) ** 2), 6) AS brier FROM rowsx GROUP BY 1)
SELECT {key} coalesce(event_count, 0) AS event_count, coalesce(detected_events, 0) AS detected_events,
  round(1 - detected_events / nullif(event_count, 0), 6) AS event_false_negative_rate,
  coalesce(false_alarm_opportunities, 0) AS false_alarm_opportunities, coalesce(negative_opportunities, 0) AS negative_opportunities,
  round(false_alarm_opportunities / nullif(negative_opportunities, 0), 6) AS event_false_positive_rate,
  row_false_positive_rate, row_false_negatives, row_false_negative_rate, brier
FROM rwx LEFT JOIN evx USING (g) LEFT JOIN hrx USING (g)"""
EVENT_RATES = ("event_false_negative_rate", "event_false_positive_rate", "row_false_positive_rate", "row_false_negative_rate", "brier")


@query("event_metrics", with_views("episodes", "WITH " + EVENT_SQL.format(th=0.3, src="episodes", g="'all'", key="")))
def event_metrics(t):
    return r6(m.event_metrics(scored_episodes(t), threshold=0.3, limit=LIMIT), *EVENT_RATES)


UPPER_LIMIT_SQL = """count(*) FILTER (y_60m > 60 AND up <= 60) AS upper_limit_misses,
  round(count(*) FILTER (y_60m > 60 AND up <= 60) / nullif(count(*) FILTER (y_60m > 60 AND up IS NOT NULL), 0), 6) AS upper_limit_miss_rate,
  round(count(*) FILTER (y_60m <= 60 AND up > 60) / nullif(count(*) FILTER (y_60m <= 60 AND up IS NOT NULL), 0), 6) AS upper_limit_false_alarm_rate"""


@query("upper_limit_metrics", with_views("episodes", f"SELECT {UPPER_LIMIT_SQL} FROM (SELECT *, baseline + 15 AS up FROM episodes)"))
def upper_limit_metrics(t):
    out = scored_episodes(t).agg(*m.upper_limit_columns(F.col("y_60m"), F.col("baseline") + 15, LIMIT))
    return r6(out, "upper_limit_miss_rate", "upper_limit_false_alarm_rate")


@query("monthly_report", with_views("episodes", f"""
WITH mo AS (SELECT *, strftime(as_of, '%Y-%m') AS month FROM episodes),
{EVENT_SQL.format(th=0.3, src="mo", g="month", key="g AS month, upper_coverage, upper_limit_misses, upper_limit_miss_rate, upper_limit_false_alarm_rate,")}
LEFT JOIN (SELECT month AS g, round(avg((y_60m <= up)::INT), 6) AS upper_coverage, {UPPER_LIMIT_SQL}
  FROM (SELECT *, baseline + 15 AS up FROM mo) GROUP BY 1) USING (g)"""))
def monthly_report(t):
    rows = scored_episodes(t).withColumn("month", month_key("as_of"))
    up = F.col("baseline") + 15
    bound = rows.groupBy("month").agg(
        F.avg((F.col("y_60m") <= up).cast("double")).alias("upper_coverage"), *m.upper_limit_columns(F.col("y_60m"), up, LIMIT))
    out = m.event_metrics(rows, threshold=0.3, limit=LIMIT, group="month").join(bound, "month")
    return r6(out, *EVENT_RATES, "upper_coverage", "upper_limit_miss_rate", "upper_limit_false_alarm_rate")


REGIMES = ("below_48", "48_to_60", "above_60")


@query("regime_report", with_views("episodes", f"""
WITH mo AS (SELECT *, CASE WHEN baseline < 48 THEN 'below_48' WHEN baseline < 60 THEN '48_to_60' ELSE 'above_60' END AS regime FROM episodes WHERE baseline IS NOT NULL),
{EVENT_SQL.format(th=0.3, src="mo", g="regime", key="g AS regime,")}"""))
def regime_report(t):
    rows = scored_episodes(t).withColumn("regime", sc.band(F.col("baseline"), (48.0, 60.0), REGIMES)).filter(F.col("regime").isNotNull())
    return r6(m.event_metrics(rows, threshold=0.3, limit=LIMIT, group="regime"), *EVENT_RATES)


@query("lead_time_report", with_views("episodes", f"""
WITH mo AS (SELECT entity, as_of, baseline, p, event_id, event_start_at, h.horizon,
   CASE h.horizon WHEN '10m' THEN crossing_10m WHEN '20m' THEN crossing_20m WHEN '30m' THEN crossing_30m ELSE crossing_60m END AS crossing_60m
   FROM episodes, (SELECT unnest(['10m', '20m', '30m', '60m']) AS horizon) h),
{EVENT_SQL.format(th=0.3, src="mo", g="horizon", key="g AS horizon,")}"""))
def lead_time_report(t):
    return r6(m.lead_time_report(scored_episodes(t), threshold=0.3, limit=LIMIT), *EVENT_RATES)


@query("bootstrap_fnr")
def bootstrap_fnr(t):
    return m.bootstrap_event_fnr(m.event_metrics(scored_episodes(t), threshold=0.3, limit=LIMIT))


@query("event_threshold", with_views("episodes", """
WITH neg AS (SELECT * FROM episodes WHERE NOT crossing_60m AND baseline <= 60),
b1 AS (SELECT p AS edge FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS n FROM neg) WHERE r = n - floor(0.2 * n) - 1),
hr AS (SELECT max(p) AS top FROM neg GROUP BY entity, date_trunc('hour', as_of)),
b2 AS (SELECT top AS edge FROM (SELECT top, row_number() OVER (ORDER BY top) - 1 AS r, count(*) OVER () AS n FROM hr) WHERE r = n - floor(0.2 * n) - 1)
SELECT round(CASE WHEN (SELECT count(*) FILTER (top > (SELECT edge FROM b1)) / count(*) FROM hr) > 0.2
  THEN coalesce((SELECT min(p) FROM episodes WHERE p > (SELECT edge FROM b2)), 1.0) ELSE (SELECT edge FROM b1) END, 6) AS threshold"""))
def event_threshold_query(t):
    value = event_threshold(scored_episodes(t), limit=LIMIT)
    return t.spark.range(1).select(F.round(F.lit(value), 6).alias("threshold"))


DRIFT_SQL = """count(*) AS n, round(avg(y), 6) AS target_mean, round(stddev_pop(y), 6) AS target_std, round(avg((y > 60)::INT), 6) AS exceedance_rate,
  round(avg((baseline <= 60 AND y > 60)::INT), 6) AS transition_rate, count(*) FILTER (baseline <= 60 AND y > 60) AS transition_count,
  round(avg(abs(y - baseline)), 6) AS persistence_mae, round(corr(baseline, y), 6) AS current_future_correlation"""
DRIFT_NUM = ("target_mean", "target_std", "exceedance_rate", "transition_rate", "persistence_mae", "current_future_correlation")


@query("temporal_drift", with_views("scored", f"SELECT split, {DRIFT_SQL} FROM scored WHERE split IS NOT NULL GROUP BY split"))
def temporal_drift(t):
    out = scored(t).filter(F.col("split").isNotNull()).groupBy("split").agg(*m.drift_columns(F.col("y"), F.col("baseline"), LIMIT))
    return r6(out, *DRIFT_NUM)


BANDS4 = ("below_48", "48_to_60", "60_to_72", "above_72")


@query("regime_diagnostics", with_views("scored", """
WITH s AS (SELECT *, CASE WHEN baseline < 48 THEN 'below_48' WHEN baseline < 60 THEN '48_to_60' WHEN baseline < 72 THEN '60_to_72' ELSE 'above_72' END AS band FROM scored),
d AS (SELECT a.split, b.band FROM (SELECT unnest(['train', 'validation', 'test']) AS split) a, (SELECT unnest(['below_48', '48_to_60', '60_to_72', 'above_72']) AS band) b)
SELECT d.split, d.band, count(s.y) AS n, round(avg(abs(y - baseline)), 6) AS persistence_mae, round(avg((y > 60)::INT), 6) AS future_exceedance_rate,
  count(*) FILTER (baseline <= 60 AND y > 60) AS transition_count FROM d LEFT JOIN s ON s.split = d.split AND s.band = d.band GROUP BY 1, 2"""))
def regime_diagnostics(t):
    rows = scored(t).withColumn("band", sc.band(F.col("baseline"), (48.0, 60.0, 72.0), BANDS4))
    figures = rows.groupBy("split", "band").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("baseline"))).alias("persistence_mae"),
        F.avg((F.col("y") > LIMIT).cast("double")).alias("future_exceedance_rate"),
        F.count_if((F.col("baseline") <= LIMIT) & (F.col("y") > LIMIT)).alias("transition_count"))
    dim = t.spark.createDataFrame([(s, b) for s in ("train", "validation", "test") for b in BANDS4], "split string, band string")
    out = dim.join(figures, ["split", "band"], "left").fillna(0, ["n", "transition_count"])
    return r6(out, "persistence_mae", "future_exceedance_rate")


OFFSETS = tuple(range(-180, 181, 30))


@query("source_alignment", with_views("pak lims", f"""
WITH shifted AS (SELECT l.*, o.off, l.measured_at + o.off * INTERVAL 1 MINUTE AS at FROM lims l, (SELECT unnest([{', '.join(map(str, OFFSETS))}]) AS off) o),
{NEAREST.replace('q.value AS lims,', 'q.off, q.value AS lims,')},
both_ AS (SELECT 'raw' AS policy, * FROM nearest UNION ALL SELECT 'training', * FROM nearest WHERE lims <= 300)
SELECT policy, off AS offset_minutes, count(*) AS n, round(avg(abs(lims - pak)), 6) AS mae, round(avg(lims - pak), 6) AS bias_lims_minus_pak,
  round(corr(lims, pak), 6) AS correlation FROM both_ WHERE lims IS NOT NULL AND pak IS NOT NULL GROUP BY 1, 2"""))
def source_alignment(t):
    """Laboratory against analyser at 13 time shifts, before and after confirmed exclusions."""
    lab = eligible(quality(t), "lims").select("entity", "observation_id", F.col("value").alias("lims"), "measured_at")
    shifted = lab.select("*", F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("offset_minutes")).withColumn(
        "at", plus_minutes("measured_at", F.col("offset_minutes"))).drop("measured_at")
    pairs = asof_nearest(
        shifted, analyser(t).select("entity", "measured_at", F.col("value").alias("pak")), keys=["entity"],
        query_ts="at", event_ts="measured_at", take=["pak"], tolerance_minutes=20).filter(F.col("pak").isNotNull())
    confirmed = F.col("lims") > 300
    policy = F.explode(F.array_compact(F.array(F.lit("raw"), F.when(~confirmed, "training"))))
    out = pairs.select("*", policy.alias("policy")).groupBy("policy", "offset_minutes").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("lims") - F.col("pak"))).alias("mae"),
        F.avg(F.col("lims") - F.col("pak")).alias("bias_lims_minus_pak"), m.guarded_corr("lims", "pak", 2).alias("correlation"))
    return r6(out, "mae", "bias_lims_minus_pak", "correlation")


SCREEN_SQL = """
SELECT {name}, train_n, validation_n, test_n, round(train_correlation, 6) AS train_correlation, round(validation_correlation, 6) AS validation_correlation,
  round(test_correlation, 6) AS test_correlation, coalesce(sign(train_correlation) = sign(validation_correlation) AND sign(validation_correlation) = sign(test_correlation), FALSE) AS stable_sign
FROM (SELECT {name}, coalesce(max(n) FILTER (split = 'train'), 0) AS train_n, coalesce(max(n) FILTER (split = 'validation'), 0) AS validation_n, coalesce(max(n) FILTER (split = 'test'), 0) AS test_n,
  max(c) FILTER (split = 'train') AS train_correlation, max(c) FILTER (split = 'validation') AS validation_correlation, max(c) FILTER (split = 'test') AS test_correlation
  FROM (SELECT {name}, split, count(*) AS n, CASE WHEN count(*) >= 100 THEN corr(x, res) END AS c FROM tall WHERE x IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
WHERE train_correlation IS NOT NULL ORDER BY abs(train_correlation) DESC, {name} LIMIT {top}"""
SCREEN_NUM = ("train_correlation", "validation_correlation", "test_correlation")


def signal_tall(t):
    asks = scored(t).select("entity", "observation_id", "as_of", "split", (F.col("y") - F.col("baseline")).alias("res"),
                            F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("signal_id"))
    return asof(asks, telemetry(t), keys=["entity", "signal_id"], query_ts="as_of", event_ts="ts", take=["value"], tolerance_minutes=20)


@query("signal_residual_screen", with_views("scored tele", f"""
WITH tall AS (SELECT q.split, q.signal_id, q.y - q.baseline AS res, CASE WHEN e.ts >= q.as_of - INTERVAL 20 MINUTE THEN e.value END AS x
  FROM (SELECT * FROM scored, (SELECT unnest(['click', 'signup', 'view']) AS signal_id)) q
  ASOF LEFT JOIN tele e ON e.entity = q.entity AND e.signal_id = q.signal_id AND q.as_of >= e.ts)
{SCREEN_SQL.format(name='signal_id', top=20)}"""))
def signal_residual_screen(t):
    return r6(m.residual_screen(signal_tall(t), name="signal_id", value="value", residual="res", top_n=20), *SCREEN_NUM)


def feature_tall(t):
    rows = model_rows(t).filter("baseline IS NOT NULL").select("split", (F.col("y") - F.col("baseline")).alias("res"), *FEATURE_NAMES)
    return rows.unpivot(["split", "res"], list(FEATURE_NAMES), "feature", "value")


FEATURE_TALL_SQL = f"""{FEATURE_SQL},
tall AS (SELECT split, res, feature, x FROM (UNPIVOT (SELECT split, y - baseline AS res, {FEATURE_LIST} FROM feat WHERE baseline IS NOT NULL)
  ON {FEATURE_LIST} INTO NAME feature VALUE x))"""


@query("feature_residual_screen", with_views("scored sup tele", f"WITH {FEATURE_TALL_SQL} {SCREEN_SQL.format(name='feature', top=20)}"))
def feature_residual_screen(t):
    return r6(m.residual_screen(feature_tall(t), name="feature", value="value", residual="res", top_n=20), *SCREEN_NUM)


@query("topn_abs_correlation", with_views("scored sup tele", f"WITH {FEATURE_TALL_SQL} {SCREEN_SQL.format(name='feature', top=2)}"))
def topn_abs_correlation(t):
    return r6(m.residual_screen(feature_tall(t), name="feature", value="value", residual="res", top_n=2), *SCREEN_NUM)


@query("dataset_diagnostics")
def dataset_diagnostics(t):
    """Drift, regimes, alignment and screens as one tall (section, key, metric, value) report."""
    def tall(df, section, keys):
        names = [c for c in df.columns if c not in keys]
        return df.select(
            F.lit(section).alias("section"), F.concat_ws("|", *keys).alias("key"),
            F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("_m"),
        ).select("section", "key", "_m.metric", "_m.value")

    return (
        tall(temporal_drift(t), "temporal_drift", ["split"])
        .unionByName(tall(regime_diagnostics(t), "regime", ["split", "band"]))
        .unionByName(tall(source_alignment(t), "alignment", ["policy", "offset_minutes"]))
        .unionByName(tall(feature_residual_screen(t), "features", ["feature"]))
        .unionByName(tall(signal_residual_screen(t), "signals", ["signal_id"]))
    )


def control_long(t):
    from assaylake.operators.chunks import GRID, over_rows

    tall = plant_hours(t).unpivot(["entity", "ts"], list(CONTROLS), "signal_id", "value")
    present = tall.filter(F.col("value").isNotNull())
    return tall, over_rows(
        present, ["entity", "signal_id"], "ts", [], lambda w: {"step": F.abs(F.col("value") - F.lag("value").over(w))},
        before=1, chunking=GRID)


@query("observed_control_stats", with_views("plant", """
WITH l AS (SELECT entity, ts, 'click' AS signal_id, click AS v FROM plant UNION ALL SELECT entity, ts, 'signup', signup FROM plant),
s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY entity, signal_id ORDER BY ts)) AS step FROM l WHERE v IS NOT NULL)
SELECT s.signal_id, count(*) AS count, any_value(x.missing) AS missing, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(step, 0.5), 6) AS median_abs_step, round(quantile_cont(step, 0.95), 6) AS q95_abs_step
FROM s JOIN (SELECT signal_id, count(*) - count(v) AS missing FROM l GROUP BY 1) x ON x.signal_id = s.signal_id GROUP BY 1"""))
def observed_control_stats(t):
    tall, stepped = control_long(t)
    values = exact_quantiles(stepped, ["signal_id"], F.col("value"), {"q05": 0.05, "median": 0.5, "q95": 0.95}).withColumnRenamed("n", "count")
    steps = exact_quantiles(stepped, ["signal_id"], F.col("step"), {"median_abs_step": 0.5, "q95_abs_step": 0.95}).drop("n")
    missing = tall.groupBy("signal_id").agg(F.count_if(F.col("value").isNull()).alias("missing"))
    out = values.join(steps, "signal_id", "left").join(missing, "signal_id")
    return r6(out, "q05", "median", "q95", "median_abs_step", "q95_abs_step")


def train_thresholds(t, quantile: float = 0.8):
    from assaylake.operators.chunks import GRID
    from assaylake.operators.series import control_changes

    changes = control_changes(plant_hours(t), controls=CONTROLS, chunking=GRID)
    steps = changes.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).unpivot(
        ["entity"], [f"d_{c}" for c in CONTROLS], "control", "d").filter(F.abs(F.col("d")) > 0)
    return exact_quantiles(steps, ["control"], F.abs(F.col("d")), {"threshold": quantile}).select(
        F.substring_index("control", "_", -1).alias("control_id"), "threshold", "n")


@query("change_thresholds", with_views("plant", f"""
WITH {CHANGES_SQL} SELECT 'click' AS control_id, round(t_click, 6) AS threshold, (SELECT count(*) FROM ch WHERE abs(d_click) > 0 AND ts < TIMESTAMP '2024-01-16') AS n FROM thr
UNION ALL SELECT 'signup', round(t_signup, 6), (SELECT count(*) FROM ch WHERE abs(d_signup) > 0 AND ts < TIMESTAMP '2024-01-16') FROM thr"""))
def change_thresholds(t):
    return r6(train_thresholds(t), "threshold")


@query("robust_domain_stats", with_views("plant", """
WITH d AS (SELECT * FROM plant WHERE click IS NOT NULL AND signup IS NOT NULL AND ts < TIMESTAMP '2024-01-16'),
q AS (SELECT quantile_cont(click, 0.5) AS mc, quantile_cont(click, 0.75) - quantile_cont(click, 0.25) AS sc,
             quantile_cont(signup, 0.5) AS ms, quantile_cont(signup, 0.75) - quantile_cont(signup, 0.25) AS ss FROM d),
z AS (SELECT (click - mc) / sc AS a, (signup - ms) / ss AS b FROM d, q),
v AS (SELECT var_samp(a) AS vaa, var_samp(b) AS vbb, covar_samp(a, b) AS vab FROM z),
dist AS (SELECT (vbb * a * a - 2 * vab * a * b + vaa * b * b) / (vaa * vbb - vab * vab) AS d2 FROM z, v)
SELECT round(mc, 6) AS center_click, round(sc, 6) AS scale_click, round(ms, 6) AS center_signup, round(ss, 6) AS scale_signup,
  round(vab, 6) AS covariance, round((SELECT quantile_cont(d2, 0.99) FROM dist), 5) AS max_distance_squared FROM q, v"""))
def robust_domain_stats(t):
    from assaylake.operators.controls import fit_joint_domain

    train = plant_hours(t).filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    d = fit_joint_domain(train, CONTROLS)
    return t.spark.range(1).select(
        F.round(F.lit(d.center[0]), 6).alias("center_click"), F.round(F.lit(d.scale[0]), 6).alias("scale_click"),
        F.round(F.lit(d.center[1]), 6).alias("center_signup"), F.round(F.lit(d.scale[1]), 6).alias("scale_signup"),
        F.round(F.lit(d.covariance[0][1]), 6).alias("covariance"), F.round(F.lit(d.max_distance_squared), 5).alias("max_distance_squared"))


BOUNDS_SQL = f"""{FEATURE_SQL},
tall AS (SELECT observation_id, split, feature, x FROM (SELECT observation_id, split, {FEATURE_LIST} FROM feat)
  UNPIVOT INCLUDE NULLS (x FOR feature IN ({FEATURE_LIST}))),
bounds AS (SELECT feature, quantile_cont(x, 0.001) AS low, quantile_cont(x, 0.999) AS high FROM tall WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)"""


@query("feature_bounds", with_views("scored sup tele", f"""
WITH {BOUNDS_SQL} SELECT feature, round(low, 6) AS lower, round(high, 6) AS upper FROM bounds"""))
def feature_bounds(t):
    from assaylake.operators.applicability import feature_bounds as bounds

    return r6(bounds(model_rows(t).filter("split = 'train'"), FEATURE_NAMES), "lower", "upper")


@query("applicability_bounds", with_views("scored sup tele", f"""
WITH {BOUNDS_SQL}
SELECT observation_id, CASE WHEN count(*) FILTER (x IS NULL) > 0 THEN 'FEATURES_UNAVAILABLE' WHEN count(*) FILTER (x < low OR x > high) > 0 THEN 'OUT_OF_DOMAIN' END AS reason_code,
  coalesce(CASE WHEN count(*) FILTER (x IS NULL) > 0 THEN string_agg(feature, ',' ORDER BY feature) FILTER (x IS NULL)
    ELSE string_agg(feature, ',' ORDER BY feature) FILTER (x < low OR x > high) END, '') AS names
FROM tall JOIN bounds USING (feature) GROUP BY observation_id"""))
def applicability_bounds(t):
    from assaylake.operators.applicability import check_bounds, feature_bounds as bounds

    rows = model_rows(t)
    out = check_bounds(rows, bounds(rows.filter("split = 'train'"), FEATURE_NAMES))
    return out.select("observation_id", "reason_code", F.array_join("violations", ",").alias("names"))


@query("missing_fraction", with_views("plant", """
SELECT entity, ts, (click IS NULL)::INT + (signup IS NULL)::INT + (view IS NULL)::INT + (sulfur IS NULL)::INT AS missing_count,
  ((click IS NULL)::INT + (signup IS NULL)::INT + (view IS NULL)::INT + (sulfur IS NULL)::INT) / 4.0 AS missing_fraction FROM plant"""))
def missing_fraction(t):
    from assaylake.operators.features import missing_share

    n, share = missing_share(["click", "signup", "view", "sulfur"])
    return plant_hours(t).select("entity", "ts", n.alias("missing_count"), share.alias("missing_fraction"))


@query("freshness_summary", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="")}
SELECT signal_id, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh AND value IS NOT NULL) AS stale, count(*) FILTER (value IS NULL) AS missing FROM sel GROUP BY 1"""))
def freshness_summary(t):
    return fresh_counts(snapshot(t, prefer_fresh=False), "signal_id")


@query("gate_report", with_views("scored", """
SELECT gate, passed, CASE WHEN NOT passed THEN reason END AS reason_code FROM (
 SELECT 'mae_10_percent_better' AS gate, (SELECT avg(abs(y - point)) <= 0.9 * avg(abs(y - baseline)) FROM scored WHERE split = 'validation') AS passed, 'ACTION_MODEL_GAIN_BELOW_10_PERCENT' AS reason
 UNION ALL SELECT 'upper_coverage_95', (SELECT avg((y <= upper)::INT) >= 0.95 FROM scored WHERE split = 'validation'), 'ACTION_INTERVAL_COVERAGE_INSUFFICIENT'
 UNION ALL SELECT 'minimum_100_rows', (SELECT count(*) >= 100 FROM scored WHERE split = 'validation'), 'INSUFFICIENT_PER_CONTROL_EPISODES'
 UNION ALL SELECT 'engineering_bounds_confirmed', FALSE, 'CONTROL_LIMITS_UNCONFIRMED')"""))
def gate_report(t):
    """Named gates over measured figures; gates that need outside evidence are passed in as False."""
    from assaylake.operators.actions import gate_rows

    figures = scored(t).filter(F.col("split") == "validation").agg(
        F.avg(F.abs(F.col("y") - F.col("point"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("baseline"))).alias("hold_mae"),
        F.avg((F.col("y") <= F.col("upper")).cast("double")).alias("coverage"), F.count("*").alias("rows"))
    return gate_rows(figures, {
        "mae_10_percent_better": (F.col("mae") <= 0.9 * F.col("hold_mae"), "ACTION_MODEL_GAIN_BELOW_10_PERCENT"),
        "upper_coverage_95": (F.col("coverage") >= 0.95, "ACTION_INTERVAL_COVERAGE_INSUFFICIENT"),
        "minimum_100_rows": (F.col("rows") >= 100, "INSUFFICIENT_PER_CONTROL_EPISODES"),
        "engineering_bounds_confirmed": (F.lit(False), "CONTROL_LIMITS_UNCONFIRMED"),
    })


@query("outer_split", with_views("sup", """
SELECT observation_id, CASE WHEN as_of < TIMESTAMP '2024-01-15 21:00:00' AND target_available_at < TIMESTAMP '2024-01-15 21:00:00' THEN 'train'
  WHEN as_of >= TIMESTAMP '2024-01-15 21:00:00' AND as_of < TIMESTAMP '2024-01-23 21:00:00' AND target_available_at < TIMESTAMP '2024-01-23 21:00:00' THEN 'validation'
  WHEN as_of >= TIMESTAMP '2024-01-23 21:00:00' THEN 'test' END AS split FROM sup"""))
def outer_split(t):
    return persistence(t).select("observation_id", sp.outer_split("2024-01-16", "2024-01-24", "Europe/Moscow").alias("split"))


@query("expanding_folds", with_views("scored", """
WITH tr AS (SELECT * FROM scored WHERE split = 'train'),
b AS (SELECT as_of, ntile(4) OVER (ORDER BY as_of) - 1 AS block FROM (SELECT DISTINCT as_of FROM tr)),
f AS (SELECT block AS fold, min(as_of) AS start FROM b WHERE block > 0 GROUP BY 1)
SELECT fold, 'validation' AS role, count(*) AS n, min(tr.as_of) AS first_as_of, max(tr.as_of) AS last_as_of FROM tr JOIN b USING (as_of) JOIN f ON f.fold = b.block GROUP BY 1
UNION ALL SELECT fold, 'train', count(*), min(as_of), max(as_of) FROM tr, f WHERE as_of < start AND target_at < start AND target_available_at < start GROUP BY 1"""))
def expanding_folds(t):
    from assaylake.session import materialise

    train = materialise(scored(t).filter(F.col("split") == "train"), "train")
    return sp.expanding_folds(train, 3).groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(
        F.count("*").alias("n"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"))


@query("rolling_month_folds", with_views("scored", """
WITH f AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-28', INTERVAL 7 DAY)) AS fold_start)
SELECT fold_start, 'train' AS role, count(*) AS n FROM scored, f WHERE as_of < fold_start AND target_available_at < fold_start GROUP BY 1
UNION ALL SELECT fold_start, 'validation', count(*) FROM scored, f WHERE as_of >= fold_start AND as_of < fold_start + INTERVAL 7 DAY GROUP BY 1"""))
def rolling_month_folds(t):
    """The step is a parameter (one month in production); the test tables span one month, so weeks."""
    return sp.rolling_folds(scored(t), "2024-01-08", "2024-01-29", "7 DAY").groupBy("fold_start", "role").agg(F.count("*").alias("n"))


@query("horizon_check", with_views("sup", "SELECT count(*) FILTER (target_at - as_of <> INTERVAL 60 MINUTE) AS violations, count(*) AS n FROM sup"))
def horizon_check(t):
    return sp.horizon_violations(persistence(t), 60)


@query("age_minutes", with_views("sup", "SELECT observation_id, round(age_minutes, 3) AS age_minutes FROM sup"))
def age_minutes(t):
    return sc.rounded(persistence(t).select("observation_id", "age_minutes"), ("age_minutes",), 3)


@query("age_bucket", with_views("scored", f"SELECT {AGE_SQL} AS age_bucket, count(*) AS n FROM scored GROUP BY 1"))
def age_bucket(t):
    return scored(t).groupBy(sc.age_bucket(F.col("age_minutes")).alias("age_bucket")).agg(F.count("*").alias("n"))


@query("regime_band", """
SELECT event_id, CASE WHEN value < 48 THEN 'below_48' WHEN value < 60 THEN '48_to_60' WHEN value < 72 THEN '60_to_72' ELSE 'above_72' END AS band FROM events""")
def regime_band(t):
    return t.events.select("event_id", sc.band(F.col("value"), (48.0, 60.0, 72.0), BANDS4).alias("band"))


@query("month_hour_bucket", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, date_trunc('hour', o_orderdate) AS hour, count(*) AS n FROM orders GROUP BY 1, 2""")
def month_hour_bucket(t):
    return t.orders.groupBy(month_key("o_orderdate").alias("month"), F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("severity_contribution", """
SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN event_id % 2 = 0 THEN (value - 20.0) / (120.0 - 20.0) ELSE (80.0 - value) / (80.0 - 10.0) END)), 6) AS contribution FROM events""")
def severity_contribution(t):
    even = F.col("event_id") % 2 == 0
    c = sc.severity(F.col("value"), F.when(even, 20.0).otherwise(80.0), F.when(even, 120.0).otherwise(10.0), F.when(even, "higher").otherwise("lower"))
    return r6(t.events.select("event_id", c.alias("contribution")), "contribution")


@query("relative_improvement", """
SELECT o_orderkey, round((o_totalprice - 200000.0) / greatest(abs(o_totalprice), 1e-9), 6) AS lower_is_better,
  round((200000.0 - o_totalprice) / greatest(abs(o_totalprice), 1e-9), 6) AS higher_is_better FROM orders""")
def relative_improvement(t):
    now, then = F.col("o_totalprice"), F.lit(200000.0)
    return r6(t.orders.select(
        "o_orderkey", sc.relative_improvement(now, then, False).alias("lower_is_better"),
        sc.relative_improvement(now, then, True).alias("higher_is_better")), "lower_is_better", "higher_is_better")


@query("logit_sigmoid", """
SELECT event_id, round(ln(q / (1 - q)), 6) AS logit, round(1.0 / (1.0 + exp(-ln(q / (1 - q)))), 6) AS back
FROM (SELECT event_id, least(greatest(value / 400.0, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q FROM events)""")
def logit_sigmoid(t):
    z = sc.logit(F.col("value") / 400.0)
    return r6(t.events.select("event_id", z.alias("logit"), sc.sigmoid(z).alias("back")), "logit", "back")


GRADES = list(GRADE_LIMITS)


@query("grade_limits", """
SELECT o_orderkey, g AS grade, CASE g WHEN 'summer_diesel' THEN 51.0 WHEN 'winter_diesel' THEN 49.0 END::DOUBLE AS cetane_lower,
  CASE g WHEN 'winter_diesel' THEN 800.0 ELSE 820.0 END::DOUBLE AS density_lower, 845.0::DOUBLE AS density_upper
FROM (SELECT o_orderkey, (['hds_diesel', 'summer_diesel', 'winter_diesel'])[1 + o_orderkey % 3] AS g FROM orders)""")
def grade_limits(t):
    g = F.element_at(F.array(*[F.lit(x) for x in GRADES]), (F.lit(1) + F.col("o_orderkey") % 3).cast("int"))
    cetane = sc.grade_limit(F.col("grade"), "cetane_lower")
    return t.orders.select("o_orderkey", g.alias("grade")).select(
        "o_orderkey", "grade", F.when(cetane > F.lit(float("-inf")), cetane).alias("cetane_lower"),
        sc.grade_limit(F.col("grade"), "density_lower").alias("density_lower"), sc.grade_limit(F.col("grade"), "density_upper").alias("density_upper"))


@query("stable_fingerprint", """
SELECT o_orderkey, substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}'), 1, 12) AS fingerprint FROM orders""")
def stable_fingerprint(t):
    return t.orders.select("o_orderkey", sc.fingerprint(["o_orderkey", "o_custkey", "o_orderpriority"], 12).alias("fingerprint"))


@query("piecewise_clip_bounds", with_views("scored", "SELECT observation_id, round(greatest(point, baseline * 0.9 + 4.85), 6) AS upper FROM scored"))
def piecewise_clip_bounds(t):
    return r6(scored(t).select("observation_id", sc.upper_bound(F.col("point"), F.col("baseline") * 0.9, 4.85).alias("upper")), "upper")


@query("dataset_manifest", with_views("tele quality", """
SELECT 'telemetry' AS table_name, count(*) AS row_count, min(ts) AS min_at, max(ts) AS max_at FROM tele
UNION ALL SELECT 'quality', count(*), min(measured_at), max(measured_at) FROM quality"""))
def dataset_manifest(t):
    from assaylake.sources.prepared import manifest_rows

    return manifest_rows({"telemetry": (telemetry(t), "ts"), "quality": (quality(t), "measured_at")}).drop("fingerprint", "hash_sum")
