"""From evaluated candidates to recommend / hold / abstain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.scalars import relative_improvement
from assaylake.functions.timecols import minutes_between
from assaylake.session import materialise

# Every code a candidate can carry; a fixed list keeps the reason aggregate small.
CODES = (
    "MISSING_REQUIRED_SIGNAL", "UNASSESSED_REQUIRED_PROPERTY", "UNCERTAINTY_UNAVAILABLE", "UNIT_MISMATCH",
    "QUALITY_LIMIT", "COMPONENT_STOCK", "ADDITIVE_LIMIT", "ADDITIVE_STOCK", "CONTROL_LIMITS_UNCONFIRMED",
    "CONTROL_BOUND_VIOLATION", "CONTROL_STEP_VIOLATION", "OUT_OF_DOMAIN", "NON_FINITE_ACTION_FORECAST",
    "QUALITY_LIMIT_VIOLATION",
)
#: More than any candidate's list of codes is long.
_PLACES = 1 << 30
#: More than any candidate's list of codes is long.
_PLACES = 1 << 30
CRITERIA = ("risk_index", "throughput", "cost_proxy")


def rank_key() -> Column:
    """Lower risk, then more throughput, lower cost, smaller change, then the id."""
    return F.struct(
        F.col("risk_index").alias("risk"), (-F.col("throughput")).alias("throughput"),
        F.col("cost_proxy").alias("cost"), F.col("change_size").alias("change"), F.col("candidate_id").alias("id"),
    )


def change_policy(
    *,
    hold: Column, candidate: Column, hold_feasible: Column,
    risk: Column, throughput: Column, cost: Column,
    now: str | None = None, last_recommended_at: str | None = None, cooldown_minutes: Column | None = None,
    criteria: Sequence[str] = CRITERIA, zero: float = 1e-9,
) -> Column:
    """STRUCT<allow, reason, criterion>: materiality of the first criterion that differs, then cooldown."""
    listed = F.array(*[
        F.struct(F.lit(c).alias("name"), hold[c].alias("now"), candidate[c].alias("then")) for c in criteria
    ])
    # Criteria are read in order and reading stops at the first unknown or different one.
    first = F.get(F.filter(listed, lambda x: x["now"].isNull() | x["then"].isNull() | (F.abs(x["then"] - x["now"]) > zero)), F.lit(0))
    unknown = first["now"].isNull() | first["then"].isNull()
    name, a, b = first["name"], first["now"], first["then"]
    material = (
        F.when(name == "risk_index", a - b >= risk)
        .when(name == "throughput", relative_improvement(a, b, True) >= throughput)
        .when(name == "cost_proxy", relative_improvement(a, b, False) >= cost)
    )
    cooling = F.lit(False)
    if last_recommended_at is not None:
        elapsed = minutes_between(now, last_recommended_at)
        cooling = F.coalesce(elapsed < cooldown_minutes, F.lit(False))
    reason = (
        F.when(~hold_feasible, "HOLD_INFEASIBLE")
        .when(first.isNotNull() & unknown, "CRITERION_UNAVAILABLE")
        .when(first.isNull() | (name == "change_size"), "NO_MATERIAL_IMPROVEMENT")
        .when(material.isNull(), "CRITERION_UNAVAILABLE")
        .when(~material, "NO_MATERIAL_IMPROVEMENT")
        .when(cooling, "ACTION_COOLDOWN")
        .otherwise("MATERIAL_IMPROVEMENT")
    )
    return F.struct(
        reason.isin("HOLD_INFEASIBLE", "MATERIAL_IMPROVEMENT").alias("allow"), reason.alias("reason"),
        F.when(hold_feasible, name).alias("criterion"),
    )


def reason_order(codes: str = "codes", position: str = "position", only: Column | None = None) -> Column:
    """Distinct codes in order of first appearance over the candidates of a group.

    One minimum per known code: the partial aggregate has a fixed size, whatever the candidates.  Candidate and place in
    its list are one number, which a hash aggregate keeps in place.
    """
    arms = []
    for code in CODES:
        i = F.array_position(F.col(codes), code)
        here = i > 0
        if only is not None:
            here = here & only
        at = F.min(F.when(here, F.col(position).cast("long") * F.lit(_PLACES) + i))
        arms.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(code).alias("code"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*arms))), lambda x: x["code"])


def decide(evaluated: DataFrame, keys: Sequence[str] = ("scenario_id",), cooldown_minutes: float = 60.0) -> DataFrame:
    """One decision per scenario.

    If ``evaluated`` has ``as_of`` and ``last_recommended_at``, an improvement within ``cooldown_minutes`` of the last
    recommendation is held back (``ACTION_COOLDOWN``); a last recommendation after ``as_of`` is an error.

    The candidates of a scenario come out of one row, so the grouping is almost entirely map-side; a
    scenario never has more candidates than the grid limit.
    """
    return _decided(_gathered(evaluated, keys), keys, cooldown_minutes)


def _gathered(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a decision needs to know of a scenario's candidates, one row per scenario."""
    is_hold = F.col("candidate_id") == "hold"
    ok, key = F.col("feasible"), rank_key()
    shown = [c for c in ("sulfur_upper", "t95_upper", "cetane_lower", "fractions", "dose") if c in evaluated.columns]
    body = F.struct("candidate_id", *CRITERIA, "change_size", *shown)
    thresholds = [c for c in ("min_risk", "min_throughput", "min_cost") if c in evaluated.columns]
    timed = [c for c in ("as_of", "last_recommended_at") if {"as_of", "last_recommended_at"} <= {*evaluated.columns}]
    return evaluated.groupBy(*keys).agg(
        F.max_by(body, is_hold.cast("int")).alias("hold"),
        F.bool_or(is_hold & ok).alias("hold_feasible"),
        F.min_by(body, F.when(ok & ~is_hold, key)).alias("best"),
        F.count_if(ok & ~is_hold).alias("feasible_candidates"),
        F.slice(F.sort_array(F.collect_list(F.when(ok, key))), 1, 4).alias("_top"),
        F.bool_or(ok).alias("_any"),
        reason_order().alias("_all_reasons"),
        reason_order(only=is_hold).alias("_hold_reasons"),
        *[F.first(c).alias(c) for c in [*thresholds, *timed]],
    )


def _decided(grouped: DataFrame, keys: Sequence[str], cooldown_minutes: float = 60.0) -> DataFrame:
    thresholds = [c for c in ("min_risk", "min_throughput", "min_cost") if c in grouped.columns]
    timed = [c for c in ("as_of", "last_recommended_at") if {"as_of", "last_recommended_at"} <= {*grouped.columns}]
    lim = {c: F.col(c) if c in thresholds else F.lit(0.0) for c in ("min_risk", "min_throughput", "min_cost")}
    policy = change_policy(
        hold=F.col("hold"), candidate=F.col("best"), hold_feasible=F.lit(True),
        risk=lim["min_risk"], throughput=lim["min_throughput"], cost=lim["min_cost"],
    )
    none = F.col("feasible_candidates") == 0
    held = F.col("hold_feasible")
    decided = grouped.withColumn("_policy", policy)
    if timed:
        elapsed = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last_recommended_at").cast("timestamp"))) / 60e6
        checked = F.when(elapsed < 0, F.raise_error("a last recommendation lies after the decision time").cast("double")).otherwise(elapsed)
        cold = F.col("_policy.allow") & F.coalesce(checked < cooldown_minutes, F.lit(False))
        decided = decided.withColumn("_policy", F.when(cold, F.col("_policy").withField("allow", F.lit(False)).withField(
            "reason", F.lit("ACTION_COOLDOWN"))).otherwise(F.col("_policy")))
    status = (
        F.when(held & (none | ~F.col("_policy.allow")), "hold").when(held, "recommend")
        .when(none, "abstain").otherwise("recommend")
    )
    fallback = lambda c, code: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(code)))
    reasons = (
        F.when(held & none, F.array().cast("array<string>"))
        .when(held, F.array(F.when(F.col("_policy.allow"), "MATERIAL_IMPROVEMENT").otherwise(F.col("_policy.reason"))))
        .when(none, fallback(F.col("_all_reasons"), "NO_FEASIBLE_CANDIDATE"))
        .otherwise(fallback(F.col("_hold_reasons"), "BASELINE_INFEASIBLE"))
    )
    selected = F.when(status == "hold", F.col("hold")).when(status == "recommend", F.col("best"))
    others = F.slice(F.filter(F.transform("_top", lambda k: k["id"]), lambda i: i != selected["candidate_id"]), 1, 3)
    return decided.select(
        *keys, status.alias("status"), selected.alias("selected"), F.col("hold").alias("baseline"),
        reasons.alias("reason_codes"),
        F.when(status == "abstain", F.array().cast("array<string>")).otherwise(others).alias("alternatives"),
        "feasible_candidates",
    )


def decide_blends(scenarios: DataFrame, max_candidates: int = 125) -> DataFrame:
    """Grid first; scenarios whose grid holds nothing feasible are searched continuously as well.

    The grid is evaluated once.  Its candidates are gathered to a row per scenario, which is written; a scenario that was
    searched takes from its grid the hold and the reasons, as a feasible candidate has none, and from the search the rest.
    """
    from assaylake.operators.blend import assisted_candidates, candidate_grid, evaluate

    keys = ["scenario_id"]
    grid = materialise(_gathered(evaluate(candidate_grid(scenarios, max_candidates=max_candidates)), keys), "grid-gathered")
    empty = grid.filter(~F.col("_any")).select(*keys)
    extra = _gathered(evaluate(assisted_candidates(scenarios.join(empty, keys, "left_semi"))), keys)
    searched = ("best", "feasible_candidates", "_top")
    both = grid.join(extra.filter("_any").select(*keys, F.struct(*searched).alias("_x")), keys, "left")
    merged = both.select(
        *[F.when(F.col("_x").isNotNull(), F.col("_x")[c]).otherwise(F.col(c)).alias(c) if c in searched else F.col(c)
          for c in grid.columns])
    return _decided(merged, keys)


def rejection_summary(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A filter by feasibility would be pushed down to the candidates and evaluate them a second time.
    codes = F.when(~F.col("feasible"), F.col("codes"))
    return (
        evaluated.select(*keys, F.explode_outer(codes).alias("code")).filter(F.col("code").isNotNull())
        .groupBy(*keys, "code").agg(F.count("*").alias("n"))
    )


def tune_policy(cases: DataFrame, parameters: list[dict]) -> DataFrame:
    """Fewest missed, then unnecessary, then total changes over the replay cases.

    Each case meets each parameter set of the short literal list; three counts per set remain.
    """
    sets = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in p.items()]) for p in parameters]))
    tried = cases.select("*", sets.alias("q"))
    verdict = change_policy(
        hold=F.col("hold"), candidate=F.col("candidate"), hold_feasible=F.col("hold_feasible"),
        risk=F.col("q.risk"), throughput=F.col("q.throughput"), cost=F.col("q.cost"),
        now="now", last_recommended_at="last_recommended_at", cooldown_minutes=F.col("q.cooldown"),
    )
    judged = tried.withColumn("_allow", verdict["allow"])
    scores = judged.groupBy("q").agg(
        F.count_if(F.col("change_required") & ~F.col("_allow")).alias("missed"),
        F.count_if(~F.col("change_required") & F.col("_allow")).alias("unnecessary"),
        F.count_if(F.col("_allow")).alias("actions"),
    )
    best = F.struct("missed", "unnecessary", "actions", "q.risk", "q.throughput", "q.cost", "q.cooldown")
    return scores.agg(F.min(best).alias("_b")).select("_b.*")


def severity_index(snapshot: DataFrame, factors: DataFrame) -> DataFrame:
    """Largest contribution of the usable factors per decision time, and the issues of the others.

    ``factors`` is configuration, a row per monitored signal, hence the broadcast.
    """
    from assaylake.functions.scalars import severity

    rows = snapshot.join(factors, "signal_id")
    issue = (
        F.when(F.col("selected").isNull(), "MISSING_REQUIRED_SIGNAL")
        .when(F.col("selected.unit") != F.col("unit"), "UNIT_UNCONFIRMED")
        .when(~F.col("fresh"), "STALE_REQUIRED_SIGNAL")
    )
    part = F.when(issue.isNull(), severity(
        F.col("selected.value"), F.col("normal_edge"), F.col("model_boundary"), F.col("direction")))
    return rows.groupBy("entity", "as_of").agg(
        F.max(part).alias("risk_index"),
        F.count(part).alias("usable_factors"),
        # One entry per configured factor.
        F.array_sort(F.collect_set(issue)).alias("issues"),
    ).withColumn(
        "status", F.when(F.col("risk_index").isNull(), "unavailable")
        .when(F.size("issues") > 0, "degraded").otherwise("ok"))


def history_quality(snapshot: DataFrame, unit: str | Column, carry: Sequence[str] = ()) -> DataFrame:
    """Measured quality as an assessment: available, degraded by age, or unavailable with a code."""
    code = (
        F.when(F.col("selected").isNull(), "MISSING_REQUIRED_SIGNAL")
        .when(F.col("selected.unit") != unit, "UNIT_UNCONFIRMED")
        .when(~F.col("fresh"), "STALE_REQUIRED_SIGNAL")
    )
    status = F.when(code.isNull(), "ok").when(code == "STALE_REQUIRED_SIGNAL", "degraded").otherwise("unavailable")
    return snapshot.select(
        "entity", "as_of", *carry, status.alias("status"), code.alias("code"),
        F.when(status != "unavailable", F.col("selected.value")).alias("value"),
    )


def forecast_quality(rows: DataFrame, *, require_upper: bool = True) -> DataFrame:
    """Forecast as an assessment: applicability first, then upper bound, then the alarm."""
    blocked = F.col("applicability_code").isNotNull()
    codes = F.when(blocked, F.array("applicability_code")).otherwise(F.array_compact(F.array(
        F.when(F.lit(require_upper) & F.col("upper").isNull(), F.lit("UNCERTAINTY_UNAVAILABLE")),
        F.when(F.coalesce(F.col("alarm"), F.lit(False)), F.lit("SULFUR_EXCEEDANCE_RISK")),
    )))
    return rows.select(
        "*", codes.alias("quality_codes"),
        F.when(blocked, "unavailable").when(F.size(codes) > 0, "degraded").otherwise("ok").alias("quality_status"),
    )


def expectation_failures(
    decisions: DataFrame, expected: DataFrame, keys: Sequence[str], numbers: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """Every way in which a decision departs from what was expected, one row each."""
    e = expected.select(*keys, *[F.col(c).alias(f"x_{c}") for c in expected.columns if c not in keys], F.lit(True).alias("_e"))
    d = decisions.withColumn("_d", F.lit(True))
    joined = d.join(e, list(keys), "full")
    arms = [
        F.when(F.col("_d").isNull(), F.lit("decision missing")),
        F.when(F.col("_e").isNull(), F.lit("not expected")),
        F.when(F.col("_d") & F.col("_e") & (F.col("status") != F.col("x_status")), F.lit("status changed")),
    ]
    if "x_reason_codes" in joined.columns:
        arms.append(F.when(F.size(F.array_except("x_reason_codes", "reason_codes")) > 0, F.lit("reason lost")))
    for n in numbers:
        off = F.when(F.col(n).isNull() | F.col(f"x_{n}").isNull(), F.col(n).isNull() != F.col(f"x_{n}").isNull()).otherwise(
            F.abs(F.col(n) - F.col(f"x_{n}")) > tolerance)
        arms.append(F.when(F.col("_d") & F.col("_e") & off, F.lit(f"{n} changed")))
    return joined.select(*keys, F.explode(F.array_compact(F.array(*arms))).alias("failure"))
