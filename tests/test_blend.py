"""Blend passports and decisions of the scenario episodes."""

import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import blend as bl
from assaylake.operators import decisions as de
from assaylake.sources.scenarios import blend_rows, scan_scenarios, scenario_tables


def estimate(value, lower=None, upper=None, unit="mg/kg"):
    return {"value": value, "lower": lower, "upper": upper, "unit": unit}


def component(name, sulfur, t95, cetane, stock, cost):
    return {"id": name, "sulfur": estimate(*sulfur[:1], upper=sulfur[1]), "t95": estimate(t95[0], upper=t95[1], unit="degC"),
            "cetane_number": estimate(cetane[0], lower=cetane[1], unit="cetane_number"), "available_mass_t": stock, "cost_proxy_per_t": cost, "risk_index": 0.0}


def limit(i, metric, lower, upper, unit, up, low):
    return {"id": i, "metric": metric, "lower": lower, "upper": upper, "unit": unit, "use_upper_estimate": up, "use_lower_estimate": low}


def document(name, a, b, current, dose=0.01):
    return {
        "id": name, "mode": "model_demo", "total_mass_t": 100.0, "current_blend_mass_fractions": dict(zip("AB", current)), "current_additive_mass_fraction": dose,
        "constraints": [limit("s", "sulfur", None, 10.0, "mg/kg", True, False), limit("t", "t95", None, 360.0, "degC", True, False), limit("c", "cetane_number", 51.0, None, "cetane_number", False, True)],
        "blend_components": [component("A", *a), component("B", *b)],
        "cetane_additive": {"id": "x", "max_mass_fraction": 0.03, "fraction_step": 0.01, "available_mass_t": 3.0, "cost_proxy_per_t": 100.0,
                            "response_curve": [{"mass_fraction": d, "cetane_gain": g} for d, g in ((0.0, 0.0), (0.01, 3.0), (0.02, 5.0), (0.03, 6.5))]},
        "active_criteria": ["risk_index", "throughput", "cost_proxy"], "materiality_thresholds": {"risk_index": 0.02, "throughput": 0.02, "cost_proxy": 0.02},
        "require_upper_bound": True, "action_cooldown_minutes": 60,
    }


A, B = ((6.0, 7.0), (350.0, 352.0), (50.5, 50.0), 100.0, 1.0), ((30.0, 31.0), (370.0, 372.0), (46.5, 46.0), 30.0, 0.8)
DOCS = [
    document("stable", A, B, (0.891, 0.099)),
    document("risk", A, B, (0.693, 0.297)),
    document("t95", ((5.0, 6.0), (340.0, 342.0), (50.5, 50.0), 100.0, 1.0), ((8.0, 9.0), (390.0, 392.0), (46.5, 46.0), 60.0, 0.8), (0.495, 0.495)),
    document("cetane", ((5.0, 6.0), (340.0, 342.0), (53.0, 52.5), 100.0, 1.0), ((8.0, 9.0), (350.0, 352.0), (46.0, 45.5), 80.0, 0.8), (0.297, 0.693)),
    document("missing", ((None, None), *A[1:]), B, (0.693, 0.297)),
]


@pytest.fixture(scope="module")
def scenarios(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scenarios")
    for d in DOCS:
        (folder / f"{d['id']}.json").write_text(json.dumps(d))
    return scan_scenarios(spark, str(folder))


def test_scenario_tables(scenarios):
    tables = scenario_tables(scenarios)
    assert {k: v.count() for k, v in tables.items()} == {"scenario": 5, "constraint": 15, "component": 10, "additive_point": 20}


def test_episode_decisions(scenarios):
    got = {r["scenario_id"]: r for r in de.decide_blends(blend_rows(scenarios)).collect()}
    upper = lambda r: (round(r["sulfur_upper"], 6), round(r["t95_upper"], 6), round(r["cetane_lower"], 6))
    recipe = lambda r: ([round(x, 6) for x in r["fractions"]], round(r["dose"], 6))
    assert (got["stable"]["status"], got["stable"]["reason_codes"]) == ("hold", ["NO_MATERIAL_IMPROVEMENT"])
    risk = got["risk"]
    assert (risk["status"], risk["reason_codes"]) == ("recommend", ["QUALITY_LIMIT"])
    assert upper(risk["baseline"]) == (14.058, 358.0, 51.8) and upper(risk["selected"]) == (9.306, 354.0, 52.6)
    assert recipe(risk["selected"]) == ([0.891, 0.099], 0.01)
    assert len(risk["alternatives"]) <= 3 and risk["selected"]["candidate_id"] not in risk["alternatives"]
    assert upper(got["t95"]["baseline"]) == (7.425, 367.0, 51.0) and recipe(got["t95"]["selected"]) == ([0.6435, 0.3465], 0.01)
    assert upper(got["cetane"]["selected"]) == (6.6, 344.0, 51.1) and recipe(got["cetane"]["selected"]) == ([0.8, 0.2], 0.0)
    assert got["missing"]["status"] == "abstain" and "MISSING_REQUIRED_SIGNAL" in got["missing"]["reason_codes"]


def test_mass_blend_of_rows(spark):
    cols = "r string, fraction double, sulfur_value double, sulfur_upper double, t95_value double, t95_upper double, cetane_value double, cetane_lower double, density_value double, density_lower double, density_upper double, total_mass double, stock double"
    rows = [("m", 0.9, 6.0, 7.0, 350.0, 352.0, 50.5, 50.0, 830.0, 825.0, 835.0, 100.0, 100.0), ("m", 0.1, 30.0, 31.0, 370.0, 372.0, 46.5, 46.0, 840.0, None, 845.0, 100.0, 30.0)]
    r = bl.mass_blend(spark.createDataFrame(rows, cols), ["r"]).withColumn("status", bl.sulfur_status(10.0)).first()
    assert [round(r[c], 6) for c in ("sulfur_value", "sulfur_upper", "t95_value", "t95_upper", "cetane_value", "cetane_lower")] == [8.4, 9.4, 352.0, 354.0, 50.1, 49.6]
    assert r["status"] == "pass" and r["density_upper"] is None and r["density_lower"] is not None


def test_assisted_options_pass_the_checks(scenarios):
    options = bl.evaluate(bl.assisted_candidates(blend_rows(scenarios).filter("scenario_id = 'risk'")))
    three = bl.assist_three(options).collect()
    assert 1 <= len(three) <= 3 and {r["label"] for r in three} <= {"nearest", "cheapest", "least_additive"}
    spans = bl.share_interval(blend_rows(scenarios).filter("scenario_id = 'risk'")).filter("round(dose, 2) = 0.01").first()
    assert round(spans["hi"], 6) == round((10 - 0.99 * 7) / 24, 6)


def test_grid_above_the_limit_fails(scenarios):
    with pytest.raises(Exception, match="limit"):
        bl.candidate_grid(blend_rows(scenarios), max_candidates=50).collect()
    with pytest.raises(ValueError):
        bl.recipe_grid(0.03)


def test_override_needs_exactly_one_match(spark):
    parts = spark.createDataFrame([("s", "A", 1.0, 2.0), ("s", "A", 1.0, 2.0)], "scenario_id string, component_id string, sulfur_value double, sulfur_upper double")
    with pytest.raises(Exception, match="exactly one"):
        bl.override_component(parts, parts.limit(1), ["scenario_id"]).collect()


def test_change_policy(spark):
    cases = [(0.8, 0.73, 1.0, True, "MATERIAL_IMPROVEMENT"), (0.8, 0.79, 1.0, True, "NO_MATERIAL_IMPROVEMENT"), (None, 0.1, 1.0, True, "CRITERION_UNAVAILABLE"),
             (0.8, 0.9, 1.0, False, "HOLD_INFEASIBLE"), (0.8, 0.8, 1.05, True, "MATERIAL_IMPROVEMENT"), (0.8, 0.8, 1.0, True, "NO_MATERIAL_IMPROVEMENT")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h double, c double, t double, ok boolean, want string")
    one = F.lit(1.0)
    pack = lambda risk, thr: F.struct(risk.alias("risk_index"), thr.alias("throughput"), one.alias("cost_proxy"))
    v = de.change_policy(hold=pack(F.col("h"), one), candidate=pack(F.col("c"), F.col("t")), hold_feasible=F.col("ok"), risk=F.lit(0.02), throughput=F.lit(0.02), cost=F.lit(0.02))
    for r in df.withColumn("v", v).collect():
        assert r["v"]["reason"] == r["want"], r


def test_policy_tuning(spark, minutes):
    one = F.lit(1.0)
    df = spark.createDataFrame([(0.4, 0.35, minutes(0))], "h double, c double, now timestamp_ntz")
    pack = lambda risk: F.struct(risk.alias("risk_index"), one.alias("throughput"), one.alias("cost_proxy"))
    cases = df.select(pack(F.col("h")).alias("hold"), pack(F.col("c")).alias("candidate"), F.lit(True).alias("hold_feasible"), "now",
                      F.lit(None).cast("timestamp_ntz").alias("last_recommended_at"), F.lit(True).alias("change_required"))
    best = de.tune_policy(cases, [dict(risk=r, throughput=0.02, cost=0.02, cooldown=60) for r in (0.1, 0.02)]).first()
    assert (best["risk"], best["missed"]) == (0.02, 0)
