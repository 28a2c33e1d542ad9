"""Kernels that must not lean on a group's size, and checks that must not be blind."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators.decisions import decide
from assaylake.operators.quantiles import exact_quantiles, value_at_rank
from assaylake.sources.prepared import manifest_rows


def test_quantiles_of_values_crowded_near_zero(spark):
    x = np.concatenate([np.random.default_rng(1).exponential(1e-6, 5000), [5.0, 9.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row = exact_quantiles(df, [], F.col("x"), {"a": 0.5, "b": 0.95, "c": 1.0}).first()
    assert np.allclose([row.a, row.b, row.c], np.quantile(x, [0.5, 0.95, 1.0]), rtol=1e-12) and row.n == 5002
    assert value_at_rank(df, F.col("x"), lambda n: n - 2).first().value == 5.0
    assert exact_quantiles(df.limit(0), [], F.col("x"), {"a": 0.5}).count() == 0


def test_one_group_needs_no_cross_join(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    plan = exact_quantiles(df, [], F.col("x"), {"a": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_manifest_tells_doubled_rows_apart(spark):
    at = datetime(2024, 1, 1)
    table = lambda *v: spark.createDataFrame([(at, x) for x in v], "ts timestamp_ntz, x double")
    one, other = (manifest_rows({"t": (table(*v), "ts")}).first() for v in ((2.0, 2.0, 1.0), (9.0, 9.0, 1.0)))
    assert one.fingerprint == other.fingerprint and one != other


def test_cooldown_holds_an_improvement_back(spark):
    """An improvement half an hour after the last recommendation waits; an hour after it goes ahead."""
    row = lambda s, c, risk, minute: (s, c, True, 0 if c == "hold" else 1, risk, 1.0, 1.0, 0.0 if c == "hold" else 0.1, [], datetime(2024, 1, 1, 12), minute)
    data = []
    for s, last in ((1, datetime(2024, 1, 1, 11, 30)), (2, datetime(2024, 1, 1, 11)), (3, None)):
        data += [row(s, "hold", 0.5, last), row(s, "c1", 0.1, last)]
    schema = ("scenario_id int, candidate_id string, feasible boolean, position int, risk_index double, throughput double, "
              "cost_proxy double, change_size double, codes array<string>, as_of timestamp_ntz, last_recommended_at timestamp_ntz")
    frame = spark.createDataFrame(data, schema)
    found = {r.scenario_id: (r.status, r.reason_codes) for r in decide(frame).collect()}
    assert found == {1: ("hold", ["ACTION_COOLDOWN"]), 2: ("recommend", ["MATERIAL_IMPROVEMENT"]), 3: ("recommend", ["MATERIAL_IMPROVEMENT"])}
    late = frame.withColumn("last_recommended_at", F.col("as_of") + F.expr("INTERVAL 1 MINUTE"))
    with pytest.raises(Exception, match="after the decision time"):
        decide(late).collect()


def test_steps_ahead_takes_the_nearest_within_a_second(spark):
    from assaylake.operators.series import steps_ahead

    frame = spark.createDataFrame([(1, datetime(2024, 1, 1))], "entity int, as_of timestamp_ntz")
    at = lambda *x: datetime(2024, 1, 1, 0, *x)
    series = spark.createDataFrame(
        [(1, at(9, 59, 300_000), 1.0), (1, at(10, 0, 600_000), 2.0), (1, at(20, 1, 1), 3.0), (1, at(29, 59, 0), 4.0)],
        "entity int, ts timestamp_ntz, value double",
    )
    found = steps_ahead(frame, series, keys=["entity"], as_of="as_of", ts="ts", steps=(10, 20, 30)).collect()
    assert {(r.step, r.value, r.ts) for r in found} == {(10, 2.0, at(10)), (30, 4.0, at(30))}
