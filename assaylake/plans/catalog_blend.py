"""Blends, checks, ranking and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.scalars import rounded
from assaylake.operators import blend as bl
from assaylake.operators import decisions as de
from assaylake.plans.catalog_joins import STATE_SQL, snapshot
from assaylake.plans.catalog_windows import SELECTED_SQL
from assaylake.plans.frames import scored
from assaylake.plans.registry import query
from assaylake.sources.adapters import LIMIT, with_views
from assaylake.sources.scenarios import SCENARIO_SQL, curve_literal, part_scenarios

METRICS = ("sulfur_value", "sulfur_upper", "t95_value", "t95_upper", "cetane_value", "cetane_lower", "density_value",
           "risk_index", "throughput", "cost_proxy", "change_size")


def evaluated(t):
    return bl.evaluate(bl.candidate_grid(part_scenarios(t)))


@query("candidate_cross", f"""
WITH {SCENARIO_SQL} SELECT scenario_id, candidate_id, round(dose, 6) AS dose, round(fa, 6) AS share_a, round(fb, 6) AS share_b FROM cand""")
def candidate_cross(t):
    rows = bl.candidate_grid(part_scenarios(t))
    return rows.select("scenario_id", "candidate_id", F.round("dose", 6).alias("dose"),
                       F.round(F.col("fractions")[0], 6).alias("share_a"), F.round(F.col("fractions")[1], 6).alias("share_b"))


@query("recipe_grid", """
SELECT s_suppkey, i AS step, round(1.0 - i * 0.05, 6) AS share_a, round(i * 0.05, 6) AS share_b FROM supplier, (SELECT unnest(range(21)) AS i)""")
def recipe_grid(t):
    shares = bl.recipe_grid(0.05)
    grid = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(s).alias("b")) for i, s in enumerate(shares)])
    return t.supplier.select("s_suppkey", F.explode(grid).alias("_g")).select(
        "s_suppkey", "_g.step", F.round(1.0 - F.col("_g.b"), 6).alias("share_a"), F.round("_g.b", 6).alias("share_b"))


@query("curve_interpolate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN d <= 0.01::DOUBLE THEN d / 0.01 * 3 WHEN d <= 0.02::DOUBLE THEN 3 + (d - 0.01) / 0.01 * 2
  WHEN d <= 0.03::DOUBLE THEN 5 + (d - 0.02) / 0.01 * 1.5 END, 6) AS gain FROM (SELECT *, l_discount * 0.35::DOUBLE AS d FROM lineitem)""")
def curve_interpolate(t):
    gain = bl.interpolate(curve_literal(), F.col("l_discount") * 0.35)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(gain, 6).alias("gain"))


def order_recipes(t):
    """Each order is a recipe of its lines; part and supplier columns are the properties."""
    share = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("_q"))
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(share, "l_orderkey")
        .join(t.part.select("p_partkey", "p_size", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("recipe_id"), (F.col("l_quantity") / F.col("_q")).alias("fraction"),
            F.col("p_size").cast("double").alias("sulfur_value"),
            F.when(F.col("p_size") != 50, F.col("p_size") * 1.1).alias("sulfur_upper"),
            (F.col("p_retailprice") / 3.0).alias("t95_value"), (F.col("p_retailprice") / 3.0 + 2).alias("t95_upper"),
            F.when(F.col("p_size") != 49, 46.0 + F.col("p_partkey") % 7).alias("cetane_value"),
            F.when(F.col("p_size") != 49, 45.5 + F.col("p_partkey") % 7).alias("cetane_lower"),
            (815.0 + F.col("p_partkey") % 30).alias("density_value"), (814.0 + F.col("p_partkey") % 30).alias("density_lower"),
            (816.0 + F.col("p_partkey") % 30).alias("density_upper"),
            F.lit(100.0).alias("total_mass"), (F.col("l_quantity") + 20.0).alias("stock"),
        )
    )


RECIPE_SQL = """
li AS (SELECT l_orderkey AS recipe_id, l_quantity, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS w, p_size, p_retailprice / 3.0::DOUBLE AS t, p_partkey
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("mass_blend", f"""
WITH {RECIPE_SQL}
SELECT recipe_id, round(sum(w * p_size), 6) AS sulfur_value, round(CASE WHEN count(*) FILTER (p_size = 50) = 0 THEN sum(w * p_size * 1.1) END, 6) AS sulfur_upper,
  round(sum(w * t) / sum(w), 6) AS t95_value, round(CASE WHEN count(*) FILTER (p_size = 49) = 0 THEN sum(w * (45.5 + p_partkey % 7)) / sum(w) END, 6) AS cetane_lower,
  count(*) FILTER (w * 100 > l_quantity + 20 + 1e-9) AS stock_shortfalls, count(*) AS components,
  CASE WHEN count(*) FILTER (p_size = 49) > 0 THEN 'cetane_number' ELSE '' END AS unassessed FROM li GROUP BY 1""")
def mass_blend(t):
    out = bl.mass_blend(order_recipes(t), ["recipe_id"])
    return rounded(out.select(
        "recipe_id", "sulfur_value", "sulfur_upper", "t95_value", "cetane_lower", "stock_shortfalls", "components",
        F.array_join("unassessed", ",").alias("unassessed")), ("sulfur_value", "sulfur_upper", "t95_value", "cetane_lower"))


@query("weighted_mean_nullsafe", f"""
WITH {RECIPE_SQL} SELECT recipe_id, round(CASE WHEN count(*) FILTER (p_size = 50) = 0 THEN sum(w * p_size * 1.1) END, 6) AS mean FROM li GROUP BY 1""")
def weighted_mean_nullsafe(t):
    return bl.mass_blend(order_recipes(t), ["recipe_id"]).select("recipe_id", F.round("sulfur_upper", 6).alias("mean"))


@query("reciprocal_mix", f"""
WITH {RECIPE_SQL} SELECT recipe_id, round(1 / sum(w / (815.0 + p_partkey % 30)), 6) AS density_value, round(1 / sum(w / (816.0 + p_partkey % 30)), 6) AS density_lower,
  round(1 / sum(w / (814.0 + p_partkey % 30)), 6) AS density_upper FROM li GROUP BY 1""")
def reciprocal_mix(t):
    # Bounds swap: the reference lower bound is mixed from the components' upper ones.
    out = bl.mass_blend(order_recipes(t), ["recipe_id"])
    return out.select("recipe_id", *[F.round(c, 6).alias(c) for c in ("density_value", "density_lower", "density_upper")])


def part_components(t):
    return part_scenarios(t).select("scenario_id", F.explode("components").alias("c")).select(
        "scenario_id", F.col("c.id").alias("component_id"), F.col("c.sulfur_value").alias("sulfur_value"), F.col("c.sulfur_upper").alias("sulfur_upper"))


@query("component_forecast_override", f"""
WITH {SCENARIO_SQL}
SELECT scenario_id, 'A' AS component_id, round(CASE WHEN scenario_id % 4 = 0 THEN 7.5 ELSE "as" END, 6) AS sulfur_value, round(CASE WHEN scenario_id % 4 = 0 THEN 8.5 ELSE asu END, 6) AS sulfur_upper, scenario_id % 4 = 0 AS forecast_used FROM scen
UNION ALL SELECT scenario_id, 'B', round(bs, 6), round(bsu, 6), FALSE FROM scen""")
def component_forecast_override(t):
    parts = part_components(t)
    forecasts = t.part.filter(F.col("p_partkey") % 4 == 0).select(
        F.col("p_partkey").alias("scenario_id"), F.lit("A").alias("component_id"), F.lit(7.5).alias("sulfur_value"), F.lit(8.5).alias("sulfur_upper"))
    known = forecasts.join(parts.select("scenario_id").distinct(), "scenario_id", "left_semi")
    return rounded(bl.override_component(parts, known, ["scenario_id"]), ("sulfur_value", "sulfur_upper"))


CHECK_IDS = ["blend_sulfur", "blend_t95", "blend_cetane", "component_stock:A", "component_stock:B", "additive_fraction", "additive_stock"]


def long_checks(t):
    # The outer form is not filtered by the list's size, for which every candidate would be checked twice.
    return evaluated(t).select("scenario_id", "candidate_id", F.explode_outer("checks").alias("k")).filter("k IS NOT NULL").select(
        "scenario_id", "candidate_id", "k.constraint_id", "k.actual", "k.reason_code", bl.status_of(F.col("k.reason_code")).alias("status"))


STATUS = "CASE WHEN r = 'OK' THEN 'pass' WHEN r IN ('UNCERTAINTY_UNAVAILABLE', 'UNIT_MISMATCH') THEN 'unknown' ELSE 'fail' END"


@query("constraint_join", f"""
WITH {SCENARIO_SQL}, k AS (SELECT scenario_id, candidate_id, unnest(['blend_sulfur', 'blend_t95', 'blend_cetane']) AS constraint_id,
  unnest([round(sulfur_upper, 6), round(t95_upper, 6), round(cetane_lower, 6)]) AS actual, unnest([c1, c2, c3]) AS r FROM chk)
SELECT scenario_id, candidate_id, constraint_id, actual, r AS reason_code, {STATUS} AS status FROM k""")
def constraint_join(t):
    """Each scenario constraint met by the metric it names, for every candidate."""
    rows = long_checks(t).filter(F.col("constraint_id").startswith("blend_"))
    return rows.select("scenario_id", "candidate_id", "constraint_id", F.round("actual", 6).alias("actual"), "reason_code", "status")


@query("constraint_check", f"""
WITH {SCENARIO_SQL}, k AS (SELECT scenario_id, unnest(['blend_sulfur', 'blend_t95', 'blend_cetane']) AS constraint_id, unnest([c1, c2, c3]) AS r FROM chk)
SELECT scenario_id, constraint_id, count(*) FILTER (r = 'OK') AS passed, count(*) FILTER (r = 'QUALITY_LIMIT') AS failed, count(*) FILTER (r = 'UNCERTAINTY_UNAVAILABLE') AS unknown FROM k GROUP BY 1, 2""")
def constraint_check(t):
    rows = long_checks(t).filter(F.col("constraint_id").startswith("blend_"))
    return rows.groupBy("scenario_id", "constraint_id").agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "unknown").alias("unknown"))


@query("stock_check", f"""
WITH {SCENARIO_SQL}, k AS (SELECT scenario_id, unnest(['component_stock:A', 'component_stock:B', 'additive_fraction', 'additive_stock']) AS constraint_id, unnest([c4, c5, c6, c7]) AS r FROM chk)
SELECT scenario_id, constraint_id, count(*) FILTER (r = 'OK') AS passed, count(*) FILTER (r <> 'OK') AS failed FROM k GROUP BY 1, 2""")
def stock_check(t):
    rows = long_checks(t).filter(~F.col("constraint_id").startswith("blend_"))
    return rows.groupBy("scenario_id", "constraint_id").agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))


@query("evaluate_candidates", f"""
WITH {SCENARIO_SQL} SELECT scenario_id, candidate_id, feasible, {', '.join(f'round({m}, {8 if m == "cost_proxy" else 6}) AS {m}' for m in METRICS)} FROM evf""")
def evaluate_candidates(t):
    out = rounded(evaluated(t).select("scenario_id", "candidate_id", "feasible", *METRICS), [m for m in METRICS if m != "cost_proxy"])
    return rounded(out, ("cost_proxy",), 8)


@query("rank_candidates", f"""
WITH {SCENARIO_SQL} SELECT scenario_id, candidate_id, rank FROM (SELECT scenario_id, candidate_id, row_number() OVER (PARTITION BY scenario_id
  ORDER BY risk_index, -throughput, cost_proxy, change_size, candidate_id) AS rank FROM evf WHERE feasible) WHERE rank <= 4""")
def rank_candidates(t):
    """Best candidate and three alternatives; the candidates of a scenario are bounded by the grid limit."""
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("feasible"), de.rank_key()))), 1, 4)
    return evaluated(t).groupBy("scenario_id").agg(top.alias("_t")).select(
        "scenario_id", F.posexplode("_t").alias("_p", "k")).select(
        "scenario_id", F.col("k.id").alias("candidate_id"), (F.col("_p") + 1).cast("long").alias("rank"))


@query("rank_blends", f"""
WITH {SCENARIO_SQL}, g AS (SELECT *, (['hds_diesel', 'summer_diesel', 'winter_diesel'])[1 + scenario_id % 3] AS grade FROM met WHERE dose = 0 AND candidate_id <> 'hold'),
f AS (SELECT *, 1.0 / (CASE WHEN fa > 0 THEN fa / (ad + 1.5) ELSE 0 END + CASE WHEN fb > 0 THEN fb / (bd + 1.5) ELSE 0 END) AS dhi, 1.0 / (CASE WHEN fa > 0 THEN fa / (ad - 1.5) ELSE 0 END + CASE WHEN fb > 0 THEN fb / (bd - 1.5) ELSE 0 END) AS dlo FROM g)
SELECT scenario_id, candidate_id, grade, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY risk_index, -throughput, cost_proxy, change_size, candidate_id) AS rank FROM f
 WHERE fa * 100 <= ak + 1e-9 AND fb * 100 <= bk + 1e-9 AND sulfur_upper <= 10 AND t95_upper <= 360 AND cetane_lower IS NOT NULL AND (grade = 'hds_diesel' OR cetane_lower >= CASE grade WHEN 'summer_diesel' THEN 51 ELSE 49 END)
 AND dlo >= CASE grade WHEN 'winter_diesel' THEN 800 ELSE 820 END AND dhi <= 845) WHERE rank <= 3""")
def rank_blends(t):
    """Additive-free recipes under the limits of the product grade."""
    from assaylake.functions.scalars import grade_limit

    grades = F.array(F.lit("hds_diesel"), F.lit("summer_diesel"), F.lit("winter_diesel"))
    rows = bl.blend_metrics(bl.candidate_grid(part_scenarios(t)).filter((F.col("dose") == 0) & (F.col("candidate_id") != "hold"))).withColumn(
        "grade", F.element_at(grades, (F.lit(1) + F.col("scenario_id") % 3).cast("int")))
    stock = F.forall(F.zip_with("components", "fractions", lambda c, w: w * F.col("total_mass") <= c["stock"] + 1e-9), lambda ok: ok)
    g = F.col("grade")
    kept = rows.filter(
        stock & (F.col("sulfur_upper") <= 10) & (F.col("t95_upper") <= 360) & (F.col("cetane_lower") >= grade_limit(g, "cetane_lower"))
        & (F.col("density_lower") >= grade_limit(g, "density_lower")) & (F.col("density_upper") <= grade_limit(g, "density_upper")))
    top = F.slice(F.array_sort(F.collect_list(de.rank_key())), 1, 3)
    return kept.groupBy("scenario_id", "grade").agg(top.alias("_t")).select("scenario_id", "grade", F.posexplode("_t").alias("_p", "k")).select(
        "scenario_id", F.col("k.id").alias("candidate_id"), "grade", (F.col("_p") + 1).cast("long").alias("rank"))


@query("rejection_summary", f"""
WITH {SCENARIO_SQL} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM evf WHERE NOT feasible) GROUP BY 1""")
def rejection_summary(t):
    return de.rejection_summary(evaluated(t), [])


@query("blocking_reasons", f"""
WITH {SCENARIO_SQL}, x AS (SELECT scenario_id, position, unnest(codes) AS code, generate_subscripts(codes, 1) AS i FROM evf),
y AS (SELECT scenario_id, code, min(position * 100 + i) AS o FROM x GROUP BY 1, 2)
SELECT scenario_id, string_agg(code, ',' ORDER BY o) AS reasons FROM y GROUP BY 1""")
def blocking_reasons(t):
    rows = evaluated(t).groupBy("scenario_id").agg(F.array_join(de.reason_order(), ",").alias("reasons"))
    return rows.filter(F.col("reasons") != "")


DECISION_SQL = """
h AS (SELECT * FROM evf WHERE candidate_id = 'hold'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY risk_index, -throughput, cost_proxy, change_size, candidate_id) AS rk FROM evf WHERE feasible AND candidate_id <> 'hold') WHERE rk = 1),
rs AS (SELECT scenario_id, string_agg(code, ',' ORDER BY o) AS all_reasons, string_agg(code, ',' ORDER BY o) FILTER (hold) AS hold_reasons FROM (
   SELECT scenario_id, code, min(position * 100 + i) AS o, bool_or(position = 0) AS hold FROM (SELECT scenario_id, position, unnest(codes) AS code, generate_subscripts(codes, 1) AS i FROM evf) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT h.scenario_id, h.feasible AS hf, b.candidate_id AS bid, rs.all_reasons, rs.hold_reasons,
   CASE WHEN abs(b.risk_index - h.risk_index) > 1e-9 THEN CASE WHEN h.risk_index - b.risk_index >= 0.02 THEN 'MATERIAL_IMPROVEMENT' ELSE 'NO_MATERIAL_IMPROVEMENT' END
        WHEN abs(b.cost_proxy - h.cost_proxy) > 1e-9 THEN CASE WHEN (h.cost_proxy - b.cost_proxy) / greatest(abs(h.cost_proxy), 1e-9) >= 0.02 THEN 'MATERIAL_IMPROVEMENT' ELSE 'NO_MATERIAL_IMPROVEMENT' END
        ELSE 'NO_MATERIAL_IMPROVEMENT' END AS pol FROM h LEFT JOIN b USING (scenario_id) LEFT JOIN rs USING (scenario_id)),
dec AS (SELECT scenario_id, CASE WHEN hf AND (bid IS NULL OR pol <> 'MATERIAL_IMPROVEMENT') THEN 'hold' WHEN hf THEN 'recommend' WHEN bid IS NULL THEN 'abstain' ELSE 'recommend' END AS status,
   CASE WHEN hf AND (bid IS NULL OR pol <> 'MATERIAL_IMPROVEMENT') THEN 'hold' WHEN hf OR bid IS NOT NULL THEN bid END AS selected_id,
   CASE WHEN hf AND bid IS NULL THEN '' WHEN hf THEN pol WHEN bid IS NULL THEN coalesce(all_reasons, 'NO_FEASIBLE_CANDIDATE') ELSE coalesce(hold_reasons, 'BASELINE_INFEASIBLE') END AS reasons FROM j)"""


def grid_decisions(t):
    return de.decide(evaluated(t))


@query("decision", f"WITH {SCENARIO_SQL}, {DECISION_SQL} SELECT scenario_id, status, selected_id, reasons FROM dec")
def decision(t):
    return grid_decisions(t).select(
        "scenario_id", "status", F.col("selected.candidate_id").alias("selected_id"), F.array_join("reason_codes", ",").alias("reasons"))


@query("decision_with_search")
def decision_with_search(t):
    """Grid decisions plus the continuous search where the grid holds nothing feasible."""
    return de.decide_blends(part_scenarios(t)).select(
        "scenario_id", "status", F.col("selected.candidate_id").alias("selected_id"), F.array_join("reason_codes", ",").alias("reasons"))


@query("replay_summary", f"""
WITH {SCENARIO_SQL}, {DECISION_SQL}
SELECT 'status' AS kind, status AS code, count(*) AS n FROM dec GROUP BY 2
UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM dec WHERE reasons <> '') GROUP BY 2
UNION ALL SELECT 'points', 'all', count(*) FROM dec""")
def replay_summary(t):
    from assaylake.plans.replay import summary

    return summary(grid_decisions(t))


@query("expectation_join", f"""
WITH {SCENARIO_SQL}, {DECISION_SQL}, x AS (SELECT p_partkey AS scenario_id, CASE WHEN p_partkey % 3 = 0 THEN 'hold' ELSE 'recommend' END AS s FROM part WHERE p_partkey % 2 = 0)
SELECT failure, count(*) AS n FROM (
 SELECT CASE WHEN d.scenario_id IS NULL THEN 'decision missing' WHEN x.scenario_id IS NULL THEN 'not expected' WHEN d.status <> x.s THEN 'status changed' END AS failure
 FROM dec d FULL JOIN x ON x.scenario_id = d.scenario_id) WHERE failure IS NOT NULL GROUP BY 1""")
def expectation_join(t):
    expected = t.part.filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_partkey").alias("scenario_id"), F.when(F.col("p_partkey") % 3 == 0, "hold").otherwise("recommend").alias("status"))
    got = grid_decisions(t).select("scenario_id", "status")
    return de.expectation_failures(got, expected, ["scenario_id"], []).groupBy("failure").agg(F.count("*").alias("n"))


@query("acceptance_report", f"""
WITH {SCENARIO_SQL}, {DECISION_SQL}
SELECT d.scenario_id, d.status, (d.status = 'abstain') = (s.miss) AS passed, substr(sha256('{{"reasons":"' || d.reasons || '","scenario_id":' || d.scenario_id || ',"status":"' || d.status || '"}}'), 1, 12) AS fingerprint
FROM dec d JOIN (SELECT scenario_id, bool_and(NOT feasible) AS miss FROM evf GROUP BY 1) s USING (scenario_id)""")
def acceptance_report(t):
    """Every scenario decided again, compared with what its candidates allow, and fingerprinted."""
    from assaylake.functions.scalars import fingerprint

    rows = grid_decisions(t).select("scenario_id", "status", F.array_join("reason_codes", ",").alias("reasons"))
    possible = evaluated(t).groupBy("scenario_id").agg(F.bool_and(~F.col("feasible")).alias("none"))
    return rows.join(possible, "scenario_id").select(
        "scenario_id", "status", ((F.col("status") == "abstain") == F.col("none")).alias("passed"),
        fingerprint(["scenario_id", "status", "reasons"], 12).alias("fingerprint"))


@query("feasible_share_interval", f"""
WITH {SCENARIO_SQL}, d AS (SELECT DISTINCT scen.*, i * 0.01::DOUBLE AS dose FROM scen, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i * 0.01::DOUBLE * 100 <= addk + 1e-9),
g AS (SELECT *, 1.0::DOUBLE - dose AS dies, CASE WHEN dose = 0 THEN 0.0 WHEN dose <= 0.01::DOUBLE THEN dose / 0.01::DOUBLE * 3.0 WHEN dose <= 0.02::DOUBLE THEN 3 + (dose - 0.01::DOUBLE) / 0.01::DOUBLE * 2 ELSE 5 + (dose - 0.02::DOUBLE) / 0.01::DOUBLE * 1.5 END AS gain FROM d),
l AS (SELECT scenario_id, dose, dies, ak, bk, asu IS NULL OR bsu IS NULL OR acl IS NULL OR bcl IS NULL AS broken,
  bsu - asu AS s1, dies * asu AS i1, (btu - atu) / dies AS s2, atu AS i2, (bcl - acl) / dies AS s3, acl + gain AS i3 FROM g),
b AS (SELECT *, broken OR (abs(s1) < 1e-12 AND i1 > 10 + 1e-10) OR (abs(s2) < 1e-12 AND i2 > 360 + 1e-10) OR (abs(s3) < 1e-12 AND i3 < 51 - 1e-10) AS bad FROM l)
SELECT scenario_id, round(dose, 6) AS dose, round(CASE WHEN bad THEN 1.0 ELSE greatest(0.0, dies - ak / 100, CASE WHEN s1 <= -1e-12 THEN (10 - i1) / s1 END, CASE WHEN s2 <= -1e-12 THEN (360 - i2) / s2 END, CASE WHEN s3 >= 1e-12 THEN (51 - i3) / s3 END) END, 6) AS lo,
  round(CASE WHEN bad THEN 0.0 ELSE least(dies, bk / 100, CASE WHEN s1 >= 1e-12 THEN (10 - i1) / s1 END, CASE WHEN s2 >= 1e-12 THEN (360 - i2) / s2 END, CASE WHEN s3 <= -1e-12 THEN (51 - i3) / s3 END) END, 6) AS hi FROM b""")
def feasible_share_interval(t):
    out = bl.share_interval(part_scenarios(t)).select("scenario_id", "dose", "lo", "hi")
    return rounded(out, ("dose", "lo", "hi"))


@query("assist_three")
def assist_three(t):
    rows = bl.evaluate(bl.assisted_candidates(part_scenarios(t)))
    return rounded(bl.assist_three(rows), ("dose", "share_b", "cost_proxy", "distance"))


POLICY_IN = """
pc AS (SELECT o_orderkey, (o_custkey % 10) / 20.0 AS hr, (o_orderkey % 10) / 20.0 AS cr, 100.0 AS ht, 100.0 + o_orderkey % 3 AS ct,
  o_totalprice / 1e5 AS hc, o_totalprice * 0.985 / 1e5 AS cc, o_orderstatus <> 'P' AS hf, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 120 END AS mins, o_orderstatus = 'F' AS req FROM orders),
pd AS (SELECT *, CASE WHEN abs(cr - hr) > 1e-9 THEN 'risk_index' WHEN abs(ct - ht) > 1e-9 THEN 'throughput' WHEN abs(cc - hc) > 1e-9 THEN 'cost_proxy' END AS crit FROM pc)"""
MATERIAL = "CASE crit WHEN 'risk_index' THEN hr - cr >= {r} WHEN 'throughput' THEN (ct - ht) / greatest(abs(ht), 1e-9) >= {t} WHEN 'cost_proxy' THEN (hc - cc) / greatest(abs(hc), 1e-9) >= {c} END"


def policy_cases(t):
    side = lambda risk, thr, cost: F.struct(risk.alias("risk_index"), thr.alias("throughput"), cost.alias("cost_proxy"))
    ago = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 120)
    return t.orders.select(
        "o_orderkey", side((F.col("o_custkey") % 10) / 20.0, F.lit(100.0), F.col("o_totalprice") / 1e5).alias("hold"),
        side((F.col("o_orderkey") % 10) / 20.0, F.lit(100.0) + F.col("o_orderkey") % 3, F.col("o_totalprice") * 0.985 / 1e5).alias("candidate"),
        (F.col("o_orderstatus") != "P").alias("hold_feasible"), F.col("o_orderdate").alias("now"),
        (F.col("o_orderdate") - F.make_dt_interval(mins=ago.cast("int"))).alias("last_recommended_at"), (F.col("o_orderstatus") == "F").alias("change_required"))


@query("change_policy", f"""
WITH {POLICY_IN}
SELECT o_orderkey, CASE WHEN hf THEN crit END AS criterion, CASE WHEN NOT hf THEN 'HOLD_INFEASIBLE' WHEN crit IS NULL OR NOT ({MATERIAL.format(r=0.1, t=0.02, c=0.01)}) THEN 'NO_MATERIAL_IMPROVEMENT'
  WHEN mins < 60 THEN 'ACTION_COOLDOWN' ELSE 'MATERIAL_IMPROVEMENT' END AS reason FROM pd""")
def change_policy(t):
    v = de.change_policy(
        hold=F.col("hold"), candidate=F.col("candidate"), hold_feasible=F.col("hold_feasible"), risk=F.lit(0.1), throughput=F.lit(0.02),
        cost=F.lit(0.01), now="now", last_recommended_at="last_recommended_at", cooldown_minutes=F.lit(60))
    return policy_cases(t).withColumn("_v", v).select("o_orderkey", F.col("_v.criterion").alias("criterion"), F.col("_v.reason").alias("reason"))


PARAMETERS = [dict(risk=r, throughput=th, cost=c, cooldown=60.0) for r in (0.02, 0.1, 0.2) for th in (0.01, 0.02) for c in (0.01, 0.02)]


@query("tune_policy", f"""
WITH {POLICY_IN}, q AS (SELECT unnest([0.02, 0.1, 0.2]) AS r), q2 AS (SELECT unnest([0.01, 0.02]) AS th), q3 AS (SELECT unnest([0.01, 0.02]) AS c),
a AS (SELECT r::DOUBLE AS risk, th::DOUBLE AS throughput, c::DOUBLE AS cost, req, NOT hf OR (crit IS NOT NULL AND ({MATERIAL.format(r='r', t='th', c='c')}) AND coalesce(mins >= 60, TRUE)) AS ok FROM pd, q, q2, q3)
SELECT count(*) FILTER (req AND NOT ok) AS missed, count(*) FILTER (NOT req AND ok) AS unnecessary, count(*) FILTER (ok) AS actions, risk, throughput, cost, 60.0::DOUBLE AS cooldown
FROM a GROUP BY risk, throughput, cost ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 1""")
def tune_policy(t):
    return de.tune_policy(policy_cases(t), PARAMETERS)


def severity_factors(t):
    return t.spark.createDataFrame(
        [("click", "unknown", 20.0, 120.0, "higher"), ("view", "unknown", 60.0, 5.0, "lower"), ("ht:sulfur", "mg/kg", 40.0, 90.0, "higher")],
        "signal_id string, unit string, normal_edge double, model_boundary double, direction string")


@query("severity_index", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="(age > fresh_minutes)::INT,")},
s AS (SELECT entity, as_of, signal_id, value, fresh, CASE signal_id WHEN 'click' THEN (value - 20) / 100.0 WHEN 'view' THEN (60 - value) / 55.0 ELSE (value - 40) / 50.0 END AS raw FROM sel)
SELECT entity, as_of, round(max(least(1.0, greatest(0.0, raw))) FILTER (fresh), 6) AS risk_index, count(*) FILTER (fresh) AS usable_factors,
  CASE WHEN count(*) FILTER (fresh) = 0 THEN 'unavailable' WHEN count(*) FILTER (NOT fresh) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM s GROUP BY 1, 2"""))
def severity_index(t):
    snap = snapshot(t)
    # The analyser unit is not under test here: every reading is taken in its own unit.
    factors = severity_factors(t)
    own_unit = snap.withColumn("selected", F.when(F.col("selected").isNotNull(), F.col("selected").withField(
        "unit", F.when(F.col("signal_id") == "ht:sulfur", "mg/kg").otherwise("unknown"))))
    return rounded(de.severity_index(own_unit, factors).drop("issues"), ("risk_index",))


@query("quality_assessment", with_views("hours quality tele", f"""
WITH {STATE_SQL}, {SELECTED_SQL.format(stale="(age > fresh_minutes)::INT,")}
SELECT entity, as_of, signal_id, CASE WHEN value IS NULL THEN 'unavailable' WHEN NOT fresh THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN value IS NULL THEN 'MISSING_REQUIRED_SIGNAL' WHEN NOT fresh THEN 'STALE_REQUIRED_SIGNAL' END AS code, value FROM sel"""))
def quality_assessment(t):
    """Every signal's reading as an assessment, each in its own unit."""
    return de.history_quality(snapshot(t), F.col("selected.unit"), carry=["signal_id"])


@query("composite_alarm", with_views("scored", """
SELECT observation_id, baseline > 60 OR p >= 0.3 AS alarm, greatest(point, upper) AS upper, array_to_string(list_filter([CASE WHEN baseline > 60 THEN 'CURRENT_SULFUR_LIMIT' END,
  CASE WHEN baseline <= 60 AND p >= 0.3 THEN 'EXCEEDANCE_PROBABILITY_THRESHOLD' END, CASE WHEN age_minutes > 120 THEN 'OUT_OF_DOMAIN' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored"""))
def composite_alarm(t):
    from assaylake.operators.alarms import composite_alarm as rows

    out = rows(scored(t).withColumn("applicability_code", F.when(F.col("age_minutes") > 120, "OUT_OF_DOMAIN")), threshold=0.3, limit=LIMIT)
    return out.select("observation_id", "alarm", "upper", F.array_join("reason_codes", ",").alias("reasons"))


@query("hybrid_blend", with_views("scored", """
SELECT observation_id, round(0.693 * point + 0.297 * 30, 6) AS blend_sulfur_point, round(0.693 * upper + 0.297 * 31, 6) AS blend_sulfur_upper,
  CASE WHEN 0.693 * upper + 0.297 * 31 <= 60 THEN 'pass' ELSE 'fail' END AS constraint_status FROM scored"""))
def hybrid_blend(t):
    """The forecast at each decision time stands in for component A; B keeps its passport."""
    f = scored(t).select("observation_id", "point", "upper")
    parts = f.select("observation_id", F.explode(F.array(
        F.struct(F.lit(0.693).alias("fraction"), F.col("point").alias("sulfur_value"), F.col("upper").alias("sulfur_upper"), F.lit(100.0).alias("stock")),
        F.struct(F.lit(0.297).alias("fraction"), F.lit(30.0).alias("sulfur_value"), F.lit(31.0).alias("sulfur_upper"), F.lit(30.0).alias("stock")),
    )).alias("_c")).select("observation_id", "_c.*", F.lit(100.0).alias("total_mass"))
    none = F.lit(None).cast("double")
    filled = parts.select("*", *[none.alias(c) for c in ("t95_value", "t95_upper", "cetane_value", "cetane_lower", "density_value", "density_lower", "density_upper")])
    out = bl.mass_blend(filled, ["observation_id"]).withColumn("constraint_status", bl.sulfur_status(LIMIT))
    return rounded(out.select("observation_id", F.col("sulfur_value").alias("blend_sulfur_point"), F.col("sulfur_upper").alias("blend_sulfur_upper"), "constraint_status"),
                   ("blend_sulfur_point", "blend_sulfur_upper"))
