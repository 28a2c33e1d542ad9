"""Candidates are evaluated once and told apart by plain expressions, with the same results for any list of constraints."""

import pytest
from pyspark.sql import functions as F

from assaylake.functions.scalars import half_up
from assaylake.operators import blend as bl
from assaylake.operators import decisions as de
from assaylake.plans import catalog_blend
from assaylake.sources.scenarios import limits_literal, part_scenarios


class Parts:
    def __init__(self, part):
        self.part = part


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(1, 41).select(
        F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"), (900.0 + F.col("id")).alias("p_retailprice"))
    return Parts(rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def conditions(df):
    """Filters and join conditions of the optimised plan."""
    return "\n".join(line for line in plan(df).splitlines() if "Filter " in line or "Join " in line)


def test_half_up_is_round(spark):
    values = [0.0, -0.0, 2.5, -2.5, 0.1234565, 1.0000005, -1.0000005, 0.285, 1.005, 123456.7890125, 1e12 + 0.3, 1e300, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").union(spark.range(5000).select((F.rand(3) - 0.5) * 1000))
    for digits in (0, 3, 6, 8):
        same = F.round("x", digits).eqNullSafe(half_up(F.col("x"), digits))
        assert rows.filter(~same).count() == 0, digits


def test_rejections_do_not_evaluate_twice(parts):
    assert "sulfur" not in conditions(de.rejection_summary(bl.evaluate(bl.candidate_grid(part_scenarios(parts))), []))


@pytest.mark.parametrize("name", ["rank_candidates", "constraint_check", "stock_check"])
def test_queries_do_not_filter_by_what_they_evaluate(parts, name):
    assert "array_except" not in conditions(getattr(catalog_blend, name)(parts))
    assert "posexplode(_grid" in plan(getattr(catalog_blend, name)(parts))


def test_codes_are_those_of_the_checks(parts):
    """A list that is too long to be written out included; without a list of constraints there is no verdict."""
    odd = (("a", "sulfur", None, 10.0, "mg/kg", True, False), ("b", "t95", None, 350.0, "K", True, False),
           ("c", "octane", 1.0, None, "x", False, False), ("d", "density", 820.0, 840.0, "kg/m3", False, True),
           ("e", "cetane_number", 51.0, None, "cetane_number", False, True))
    rows = bl.evaluate(bl.candidate_grid(part_scenarios(parts).withColumn("constraints", limits_literal(odd))))
    told = F.concat("issues", F.filter(F.transform("checks", lambda c: c["reason_code"]), lambda r: r != "OK"))
    wrong, n, checks = rows.agg(F.count_if(~told.eqNullSafe(F.col("codes"))), F.count("*"), F.max(F.size("checks"))).first()
    assert (wrong, n, checks) == (0, 39 * 84, len(odd) + 4)
    assert len(odd) > bl.WRITTEN_OUT
    none = bl.evaluate(bl.candidate_grid(part_scenarios(parts).withColumn("constraints", F.when(F.col("scenario_id") < 0, limits_literal()))))
    assert none.filter("codes IS NOT NULL OR feasible").count() == 0
