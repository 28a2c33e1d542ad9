"""Historical action study and setpoint decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.scalars import rounded
from assaylake.operators import actions as ac
from assaylake.operators import decisions as de
from assaylake.operators.chunks import GRID
from assaylake.operators.controls import JointDomain, distance_squared
from assaylake.operators.features import action_timeline
from assaylake.plans.registry import query
from assaylake.sources.adapters import LIMIT, analyser, plant_hours, with_views

HORIZONS = (60, 120, 180)
CONTROLS = ("click", "signup")
CONTEXT = ("view",)


def timeline(t):
    plant = plant_hours(t).drop("sulfur")
    return action_timeline(plant, analyser(t).select("entity", "measured_at", "value"), horizons=HORIZONS,
                           tolerance_minutes=60, chunking=GRID)


TIMELINE_SQL = """
k AS (SELECT p.entity, p.ts, p.click, p.signup, p.view, CASE WHEN q.measured_at >= p.ts - INTERVAL 60 MINUTE THEN q.value END AS baseline_sulfur
  FROM plant p ASOF LEFT JOIN pak q ON q.entity = p.entity AND p.ts >= q.measured_at),
tl AS (SELECT k.*, (k.baseline_sulfur - lag(k.baseline_sulfur, 6) OVER (PARTITION BY k.entity ORDER BY k.ts)) / 60.0 AS sulfur_slope_60m,
   a.baseline_sulfur AS sulfur_60m, b.baseline_sulfur AS sulfur_120m, c.baseline_sulfur AS sulfur_180m FROM k
  LEFT JOIN k a ON a.entity = k.entity AND a.ts = k.ts + INTERVAL 60 MINUTE LEFT JOIN k b ON b.entity = k.entity AND b.ts = k.ts + INTERVAL 120 MINUTE
  LEFT JOIN k c ON c.entity = k.entity AND c.ts = k.ts + INTERVAL 180 MINUTE)"""


@query("action_timeline", with_views("plant pak", f"""
WITH {TIMELINE_SQL} SELECT entity, ts, click, signup, view, baseline_sulfur, round(sulfur_slope_60m, 6) AS sulfur_slope_60m, sulfur_60m, sulfur_120m, sulfur_180m FROM tl"""))
def action_timeline_query(t):
    return rounded(timeline(t), ("sulfur_slope_60m",))


STATE = "baseline_sulfur sulfur_slope_60m click signup view".split()
DIST = " + ".join(f"(((t.{c} - m_{c}) / s_{c}) - ((c.{c} - m_{c}) / s_{c})) ** 2" for c in STATE)
PAIRS_SQL = f"""
{TIMELINE_SQL},
d AS (SELECT *, click - lag(click) OVER w AS d_click, signup - lag(signup) OVER w AS d_signup FROM tl WINDOW w AS (PARTITION BY entity ORDER BY ts)),
n AS (SELECT *, coalesce(abs(d_click) >= 45, FALSE) AS nc, coalesce(abs(d_signup) >= 45, FALSE) AS ns,
   {' AND '.join(f'{c} IS NOT NULL' for c in STATE)} AND sulfur_60m IS NOT NULL AND sulfur_120m IS NOT NULL AND sulfur_180m IS NOT NULL AS complete FROM d),
f AS (SELECT *, (nc::INT + ns::INT = 1) AND complete AND coalesce(sum((coalesce(abs(d_click) < 45, FALSE) AND coalesce(abs(d_signup) < 45, FALSE))::INT) OVER b = 2, FALSE)
     AND count(*) OVER a = 2 AND sum((nc OR ns)::INT) OVER a = 0 AS treated,
   complete AND count(*) OVER c = 2 AND sum((nc OR ns)::INT) OVER c = 0 AS calm FROM n
   WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING),
          c AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in STATE)} FROM f WHERE complete AND ts < TIMESTAMP '2024-01-16'),
mt AS (SELECT t.entity, t.ts AS treated_ts, min(sqrt({DIST})) AS distance, arg_min(c.ts, sqrt({DIST})) AS calm_ts FROM (SELECT * FROM f WHERE treated) t
  JOIN (SELECT * FROM f WHERE calm) c ON c.entity = t.entity AND year(c.ts) = year(t.ts), st GROUP BY 1, 2)"""


def pairs(t):
    return ac.action_pairs(
        timeline(t), controls=CONTROLS, context=CONTEXT, thresholds={c: 45.0 for c in CONTROLS}, horizons=HORIZONS,
        train_end="2024-01-16", before_rows=2, quiet_rows=2)


@query("match_nearest_state", with_views("plant pak", f"""
WITH {PAIRS_SQL} SELECT entity, treated_ts, calm_ts, round(distance, 6) AS distance FROM mt"""))
def match_nearest_state(t):
    both = pairs(t)
    left = both.filter("is_action_episode").select("entity", "pair_id", F.col("ts").alias("treated_ts"), F.col("match_distance").alias("distance"))
    right = both.filter("NOT is_action_episode").select("pair_id", F.col("ts").alias("calm_ts"))
    return rounded(left.join(right, "pair_id").drop("pair_id"), ("distance",))


@query("action_pairs", with_views("plant pak", f"""
WITH {PAIRS_SQL}
SELECT f.entity, f.ts, TRUE AS is_action_episode, CASE WHEN nc THEN 'click' ELSE 'signup' END AS control_id, round(CASE WHEN nc THEN d_click ELSE 0 END, 6) AS delta_click,
  round(CASE WHEN NOT nc THEN d_signup ELSE 0 END, 6) AS delta_signup, f.baseline_sulfur, f.sulfur_60m, round(mt.distance, 6) AS match_distance FROM mt JOIN f ON f.entity = mt.entity AND f.ts = mt.treated_ts
UNION ALL SELECT c.entity, c.ts, FALSE, CASE WHEN f.nc THEN 'click' ELSE 'signup' END, 0.0, 0.0, c.baseline_sulfur, c.sulfur_60m, round(mt.distance, 6)
FROM mt JOIN f ON f.entity = mt.entity AND f.ts = mt.treated_ts JOIN f c ON c.entity = mt.entity AND c.ts = mt.calm_ts"""))
def action_pairs(t):
    return rounded(pairs(t).select("entity", "ts", "is_action_episode", "control_id", "delta_click", "delta_signup", "baseline_sulfur", "sulfur_60m", "match_distance"),
                   ("delta_click", "delta_signup", "match_distance"))


@query("union_pairs", with_views("plant pak", f"""
WITH {PAIRS_SQL} SELECT TRUE AS is_action_episode, count(*) AS n FROM mt UNION ALL SELECT FALSE, count(*) FROM mt"""))
def union_pairs(t):
    return pairs(t).groupBy("is_action_episode").agg(F.count("*").alias("n"))


@query("observed_delta_bounds", with_views("plant pak", f"""
WITH {PAIRS_SQL}, x AS (SELECT CASE WHEN nc THEN 'click' ELSE 'signup' END AS control_id, CASE WHEN nc THEN d_click ELSE d_signup END AS d FROM mt JOIN f ON f.entity = mt.entity AND f.ts = mt.treated_ts)
SELECT control_id, round(min(d), 6) AS lower, round(max(d), 6) AS upper, count(*) AS n, round((SELECT quantile_cont(distance, 0.99) FROM mt), 6) AS match_distance_limit FROM x WHERE d <> 0 GROUP BY 1"""))
def observed_delta_bounds(t):
    from assaylake.operators.quantiles import exact_quantiles
    from assaylake.session import materialise

    both = materialise(pairs(t), "pairs")
    limit = exact_quantiles(both.filter("is_action_episode"), [], F.col("match_distance"), {"q": 0.99}).first()["q"]
    out = ac.observed_bounds(both, CONTROLS).withColumn("match_distance_limit", F.lit(limit))
    return rounded(out, ("lower", "upper", "match_distance_limit"))


# A fixed model scenario: control limits, effect coefficients and a fitted joint domain.
SPECS = {"click": dict(lower=5.0, upper=120.0, max_step=8.0, step=4.0), "signup": dict(lower=10.0, upper=150.0, max_step=6.0, step=5.0)}
EFFECTS = {"sulfur": {"click": 0.4, "signup": -0.2}, "risk": {"click": 0.002}, "throughput": {"click": 0.01, "signup": 0.02}, "cost": {"click": 0.005, "signup": 0.001}}
DOMAIN = JointDomain(CONTROLS, (45.0, 45.0), (30.0, 30.0), ((1.0, 0.2), (0.2, 1.0)), ((1.04, -0.21), (-0.21, 1.04)), 4.0)


def setpoint_rows(t):
    return plant_hours(t).filter(F.col("click").isNotNull() & F.col("signup").isNotNull() & F.col("sulfur").isNotNull()).select(
        "entity", "ts", "click", "signup", "sulfur").withColumnRenamed("sulfur", "baseline").withColumn("baseline_upper", F.col("baseline") + 6.0)


GRID_SQL = """
g0 AS (SELECT entity, ts, click, signup, sulfur FROM plant WHERE click IS NOT NULL AND signup IS NOT NULL AND sulfur IS NOT NULL),
g1 AS (SELECT *, unnest(list_distinct([click, least(120.0, greatest(5.0, click - 8)), least(120.0, greatest(5.0, click - 4)), least(120.0, greatest(5.0, click + 4)), least(120.0, greatest(5.0, click + 8))])) AS sc FROM g0),
g2 AS (SELECT *, unnest(list_distinct([signup, least(150.0, greatest(10.0, signup - 5)), least(150.0, greatest(10.0, signup + 5))])) AS ss FROM g1),
g3 AS (SELECT *, abs(sc - click) <= 1e-12 AND abs(ss - signup) <= 1e-12 AS hold, 1.04 * ((sc - 45) / 30) ** 2 - 0.42 * ((sc - 45) / 30) * ((ss - 45) / 30) + 1.04 * ((ss - 45) / 30) ** 2 AS d2 FROM g2),
g4 AS (SELECT *, d2 <= 4.0 AS in_domain, CASE WHEN hold THEN 'hold' ELSE 'setpoints:click=' || printf('%.6f', round(sc, 6)) || ',signup=' || printf('%.6f', round(ss, 6)) END AS candidate_id FROM g3 WHERE hold OR d2 <= 4.0)"""


@query("setpoint_grid", with_views("plant", f"WITH {GRID_SQL} SELECT entity, ts, candidate_id, round(sc, 6) AS set_click, round(ss, 6) AS set_signup FROM g4"))
def setpoint_grid(t):
    out = ac.setpoint_grid(setpoint_rows(t), SPECS, DOMAIN)
    return rounded(out.select("entity", "ts", "candidate_id", "set_click", "set_signup"), ("set_click", "set_signup"))


@query("joint_domain_distance", with_views("plant", f"""
WITH {GRID_SQL} SELECT entity, ts, round(1.04 * ((click - 45) / 30) ** 2 - 0.42 * ((click - 45) / 30) * ((signup - 45) / 30) + 1.04 * ((signup - 45) / 30) ** 2, 6) AS distance_squared FROM g0"""))
def joint_domain_distance(t):
    rows = setpoint_rows(t)
    return rows.select("entity", "ts", F.round(distance_squared([F.col("click"), F.col("signup")], DOMAIN), 6).alias("distance_squared"))


OUTCOME_SQL = f"""{GRID_SQL},
o AS (SELECT *, sulfur + 0.4 * (sc - click) - 0.2 * (ss - signup) AS s1, sulfur + 6 + (0.4 * (sc - click) - 0.2 * (ss - signup)) AS su,
  greatest(0.0, least(1.0, 0.5 + 0.002 * (sc - click))) AS risk, 1 + 0.01 * (sc - click) + 0.02 * (ss - signup) AS thr, 1 + 0.005 * (sc - click) + 0.001 * (ss - signup) AS cost,
  abs(sc - click) / 4 + abs(ss - signup) / 5 AS chg, concat_ws(',', CASE WHEN sc < 5 OR sc > 120 OR ss < 10 OR ss > 150 THEN 'CONTROL_BOUND_VIOLATION' END,
   CASE WHEN abs(sc - click) > 8 + 1e-12 OR abs(ss - signup) > 6 + 1e-12 THEN 'CONTROL_STEP_VIOLATION' END, CASE WHEN NOT in_domain THEN 'OUT_OF_DOMAIN' END,
   CASE WHEN sulfur + 6 + (0.4 * (sc - click) - 0.2 * (ss - signup)) > 60 THEN 'QUALITY_LIMIT_VIOLATION' END) AS codes FROM g4)"""


def outcomes(t):
    return ac.linear_outcomes(ac.setpoint_grid(setpoint_rows(t), SPECS, DOMAIN), SPECS, EFFECTS, baseline="baseline", baseline_upper="baseline_upper", limit=LIMIT)


@query("linear_action_outcome", with_views("plant", f"""
WITH {OUTCOME_SQL} SELECT entity, ts, candidate_id, round(s1, 6) AS sulfur, round(su, 6) AS sulfur_upper, round(risk, 6) AS risk_index, round(thr, 6) AS throughput, round(cost, 6) AS cost_proxy, round(chg, 6) AS change_size, codes, codes = '' AS feasible FROM o"""))
def linear_action_outcome(t):
    out = outcomes(t).select("entity", "ts", "candidate_id", "sulfur", "sulfur_upper", "risk_index", "throughput", "cost_proxy", "change_size",
                             F.array_join("codes", ",").alias("codes"), "feasible")
    return rounded(out, ("sulfur", "sulfur_upper", "risk_index", "throughput", "cost_proxy", "change_size"))


@query("action_history_decision", with_views("plant", f"""
WITH {OUTCOME_SQL}, r AS (SELECT entity, ts, candidate_id, hold, codes, round(risk, 9) AS risk, round(thr, 9) AS thr, round(cost, 9) AS cost, round(chg, 9) AS chg FROM o),
h AS (SELECT * FROM r WHERE hold),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, ts ORDER BY risk, -thr, cost, chg, candidate_id) AS rk FROM r WHERE codes = '' AND NOT hold) WHERE rk = 1),
p AS (SELECT h.entity, h.ts, h.codes, b.candidate_id AS bid, CASE WHEN abs(b.risk - h.risk) > 1e-9 THEN h.risk - b.risk >= 0.01 WHEN abs(b.thr - h.thr) > 1e-9 THEN (b.thr - h.thr) / greatest(abs(h.thr), 1e-9) >= 0.01
   WHEN abs(b.cost - h.cost) > 1e-9 THEN (h.cost - b.cost) / greatest(abs(h.cost), 1e-9) >= 0.01 ELSE FALSE END AS ok FROM h LEFT JOIN b ON b.entity = h.entity AND b.ts = h.ts)
SELECT entity, ts, CASE WHEN codes = '' AND (bid IS NULL OR NOT ok) THEN 'hold' WHEN codes = '' THEN 'recommend' WHEN bid IS NULL THEN 'abstain' ELSE 'recommend' END AS status,
  CASE WHEN codes = '' AND (bid IS NULL OR NOT ok) THEN 'hold' WHEN codes = '' OR bid IS NOT NULL THEN bid END AS selected_id FROM p"""))
def action_history_decision(t):
    """Setpoint candidates over the known quality, ranked and decided like blends."""
    ranked = rounded(outcomes(t), ("risk_index", "throughput", "cost_proxy", "change_size"), 9)
    limits = ranked.withColumn("min_risk", F.lit(0.01)).withColumn("min_throughput", F.lit(0.01)).withColumn("min_cost", F.lit(0.01))
    return de.decide(limits, keys=["entity", "ts"]).select("entity", "ts", "status", F.col("selected.candidate_id").alias("selected_id"))
