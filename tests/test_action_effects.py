"""Effect model of control changes on planted effects."""

import datetime as dt
import math
import random

import pytest

from assaylake.operators import actions as ac

CONTROLS = ["a", "b"]
STATE = ["baseline_sulfur", "a", "b"]
HORIZONS = (30, 60)


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(7)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(240):
        for treated in (True, False):
            base, a, b = draw.uniform(40, 60), draw.uniform(0, 10), draw.uniform(0, 10)
            control = CONTROLS[i % 2]
            delta = draw.choice([-4.0, -2.0, 2.0, 4.0]) if treated else 0.0
            da, db = (delta, 0.0) if control == "a" else (0.0, delta)
            effect = 1.5 * da - 0.5 * db
            rows.append((
                "p", start + dt.timedelta(hours=i), base, a, b, base + effect / 2 + draw.gauss(0, 0.1), base + effect + draw.gauss(0, 0.1),
                str(i), treated, control, da, db, "train" if i < 120 else "validation" if i < 190 else "audit",
            ))
    return spark.createDataFrame(
        rows, "entity string, ts timestamp_ntz, baseline_sulfur double, a double, b double, sulfur_30m double, sulfur_60m double, "
        "pair_id string, is_action_episode boolean, control_id string, delta_a double, delta_b double, split string"
    ).cache()


@pytest.fixture(scope="module")
def model(pairs):
    return ac.fit_effect_model(pairs, controls=CONTROLS, state=STATE, horizons=HORIZONS, alpha=0.1, rounds=1, min_pairs=50, coverage=0.8)


def ask(spark, *rows):
    return spark.createDataFrame(
        [(str(i), *r) for i, r in enumerate(rows)],
        "entity string, baseline_sulfur double, a double, b double, control_id string, proposed_delta double")


def test_effects_bounds_and_reasons(spark, model):
    asked = ask(
        spark, (50.0, 5.0, 5.0, "a", 2.0), (50.0, 5.0, 5.0, "b", 4.0), (50.0, 5.0, 5.0, "a", 9.0), (500.0, 5.0, 5.0, "a", -2.0),
        (50.0, None, 5.0, "a", 2.0), (50.0, 5.0, 5.0, "c", 2.0), (50.0, 5.0, 5.0, None, 2.0), (50.0, 5.0, 5.0, "a", None),
        (50.0, 5.0, 5.0, "a", math.nan), (50.0, 5.0, 5.0, "a", math.inf),
    )
    got = sorted(ac.estimate_effects(asked, model, limit=80.0, keys=["entity"]).collect(), key=lambda r: int(r.entity))
    assert model.bounds == {"a": (-4.0, 4.0), "b": (-4.0, 4.0)} and model.validated, model.gates
    assert got[0].effect_30m == pytest.approx(1.5, abs=0.2) and got[0].effect_60m == pytest.approx(3.0, abs=0.2)
    assert got[1].effect_60m == pytest.approx(-2.0, abs=0.2)
    assert all(r.sulfur_upper_60m >= r.sulfur_60m for r in got[:5])
    assert got[0].applicable and got[1].applicable and got[0].within_observed_domain and got[0].safety_passes
    assert got[2].reason_codes == ["ACTION_DELTA_OUT_OF_OBSERVED_RANGE"] and not got[2].applicable
    assert "OUT_OF_DOMAIN" in got[3].reason_codes and "SULFUR_UPPER_LIMIT_60M" in got[3].reason_codes
    assert not got[3].safety_passes and got[4].reason_codes == ["FEATURES_UNAVAILABLE"]
    assert [r.reason_codes for r in got[5:]] == [["CONTROL_UNKNOWN"]] * 2 + [["ACTION_DELTA_INVALID"]] * 3
    assert all(r.effect_60m is None and not r.safety_passes for r in got[5:])


def test_gates_come_from_the_evidence(spark, pairs, model):
    asked = ask(spark, (50.0, 5.0, 5.0, "a", 2.0))
    from dataclasses import replace

    strict = replace(model, gates=model.gates | {"pilot": False})
    row = ac.estimate_effects(asked, strict, limit=80.0, keys=["entity"]).first()
    assert row.reason_codes == ["ACTION_EFFECT_VALIDATION_FAILED"] and not row.model_validated and row.safety_passes
    few = ac.fit_effect_model(
        pairs.filter("split <> 'audit'"), controls=CONTROLS, state=STATE, horizons=(60,), alpha=0.1, rounds=1, coverage=0.8)
    assert not few.gates["pairs_per_control"] and not few.gates["audit_upper_coverage"] and few.gates["better_than_hold"]
