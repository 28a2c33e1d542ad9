"""Historical control actions: matching, pairs, effect model, estimates and evidence gates."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def gate_rows(figures: DataFrame, gates: dict[str, tuple[Column, str]]) -> DataFrame:
    """One row per gate with its verdict and, when it fails, its reason."""
    return figures.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(why).alias("reason"))
        for g, (ok, why) in gates.items()
    ])).alias("_g")).select(
        "_g.gate", "_g.passed", F.when(~F.col("_g.passed"), F.col("_g.reason")).alias("reason_code")
    )


STATE = ("baseline_sulfur", "sulfur_slope_60m")


def action_pairs(
    timeline: DataFrame,
    *,
    controls,
    context,
    thresholds: dict[str, float],
    horizons,
    train_end: str,
    before_rows: int = 6,
    quiet_rows: int = 18,
    keys=("entity",),
    ts: str = "ts",
) -> DataFrame:
    """Isolated control changes, each with the most similar calm row of the same plant and year.

    Two rows per pair; the matched row carries zero deltas.
    """
    from assaylake.operators.chunks import GRID
    from assaylake.operators.matching import nearest_match
    from assaylake.operators.series import change_context, control_changes
    from assaylake.session import materialise

    keys = list(keys)
    state = [*STATE, *controls, *context]
    outcomes = [f"sulfur_{h}m" for h in horizons]
    changes = materialise(control_changes(timeline, controls=controls, keys=keys, ts=ts, chunking=GRID), "action-changes")
    marked = change_context(
        changes, {c: F.lit(thresholds[c]) for c in controls}, keys=keys, ts=ts, before_rows=before_rows,
        quiet_rows=quiet_rows, chunking=GRID,
    )
    complete = F.lit(True)
    for c in [*state, *outcomes]:
        complete = complete & F.col(c).isNotNull()
    one = sum(F.col(f"notable_{c}").cast("int") for c in controls) == 1
    rows = materialise(
        marked.withColumn("_year", F.year(ts)).withColumn("_complete", complete)
        .withColumn("_treated", one & F.col("stable_before") & F.col("quiet_after") & complete)
        .withColumn("_calm", F.col("calm") & complete), "action-rows")
    # Mean and spread of the training states: two numbers per feature.
    train = rows.filter(F.col("_complete") & (F.col(ts) < F.lit(train_end).cast("timestamp_ntz")))
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in state for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def z(c):
        return ((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(f"z_{c}")

    dims = [f"z_{c}" for c in state]
    left = rows.filter("_treated").select(*keys, "_year", F.col(ts).alias("treated_ts"), *[z(c) for c in state])
    right = rows.filter("_calm").select(*keys, "_year", F.col(ts).alias("calm_ts"), *[z(c) for c in state])
    matched = nearest_match(left, right, by=[*keys, "_year"], dims=dims, left_id="treated_ts", right_id="calm_ts")
    pair = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("treated_ts").cast("string"))
    matched = matched.withColumn("pair_id", pair)
    which = F.coalesce(*[F.when(F.col(f"notable_{c}"), F.lit(c)) for c in controls])
    base = [*keys, ts, *state, *outcomes]
    treated = rows.filter("_treated").join(
        matched.withColumnRenamed("treated_ts", ts), [*keys, "_year", ts]
    ).select(
        *base, "pair_id", F.lit(True).alias("is_action_episode"), which.alias("control_id"),
        *[F.when(which == c, F.col(f"d_{c}")).otherwise(0.0).alias(f"delta_{c}") for c in controls],
        F.col("distance").alias("match_distance"),
    )
    treated = materialise(treated, "action-treated")
    calm = rows.join(matched.withColumnRenamed("calm_ts", ts), [*keys, "_year", ts]).join(
        treated.select("pair_id", "control_id"), "pair_id"
    ).select(
        *base, "pair_id", F.lit(False).alias("is_action_episode"), "control_id",
        *[F.lit(0.0).alias(f"delta_{c}") for c in controls], F.col("distance").alias("match_distance"),
    )
    return treated.unionByName(calm)


def observed_bounds(pairs: DataFrame, controls) -> DataFrame:
    """Smallest and largest observed change of each control."""
    tall = pairs.filter("is_action_episode").unpivot(["pair_id"], [f"delta_{c}" for c in controls], "control", "d")
    return tall.filter(F.col("d") != 0).groupBy(F.substring_index("control", "delta_", -1).alias("control_id")).agg(
        F.min("d").alias("lower"), F.max("d").alias("upper"), F.count("*").alias("n"))


@dataclass
class EffectModel:
    """What was learned from the pairs: per horizon a point and an upper head, the domain of states, and the evidence."""

    controls: list[str]
    state: list[str]
    points: dict
    uppers: dict
    domain: object
    bounds: dict[str, tuple[float, float]]
    gates: dict[str, bool]

    @property
    def validated(self) -> bool:
        return all(self.gates.values())


def fit_effect_model(
    pairs: DataFrame, *, controls: Sequence[str], state: Sequence[str], horizons: Sequence[int], alpha: float = 10.0,
    rounds: int | None = None, min_pairs: int = 100, better: float = 0.9, coverage: float = 0.95,
    confirmed: dict[str, bool] | None = None,
) -> EffectModel:
    """Fit outcomes on state and changes, and measure whether the evidence carries an estimate.

    ``pairs`` are those of ``action_pairs`` with ``split`` (train, validation, audit).  The upper head is chosen and shifted on
    validation rows, the gates compare point and upper with validation and audit outcomes.  ``confirmed`` adds gates that
    data cannot decide (limits, pilots).  No training pairs are an error, another empty period fails its gates; an unmoved control has no bounds.
    """
    from assaylake.operators import models as md

    controls, state = list(controls), list(state)
    names = [*state, *[f"delta_{c}" for c in controls]]
    rows = pairs.withColumn("as_of", F.col("ts")).withColumn(
        "observation_id", F.concat_ws("|", "pair_id", F.col("is_action_episode").cast("string")))
    if rows.filter("split = 'train'").isEmpty():
        raise ValueError("no pairs in the training period")
    setting = {} if rounds is None else {"rounds": rounds}

    def fitted(h: int):
        y = f"sulfur_{h}m"
        point = md.fit_regression(rows.filter("split = 'train'"), names, y, "ridge", alpha=alpha)
        upper = md.fit_upper_head(rows.drop("y").withColumnRenamed(y, "y"), names, **setting)
        held = upper.score(md.predict(point, rows.filter("split <> 'train'"), names, "point"))
        per = held.groupBy("split").agg(
            F.avg(F.abs(F.col(y) - F.col("point"))).alias("mae"), F.avg(F.abs(F.col(y) - F.col("baseline_sulfur"))).alias("hold_mae"),
            F.avg((F.col(y) <= F.col("upper")).cast("double")).alias("coverage"))
        # One row per period.
        return point, upper, {r["split"]: r for r in per.collect()}

    # Horizons do not depend on each other, and each is a chain of jobs.
    with ThreadPoolExecutor(len(horizons)) as pool:
        found = dict(zip(horizons, pool.map(fitted, horizons)))
    points, uppers, figures = ({h: f[i] for h, f in found.items()} for i in range(3))

    def every(split: str, test) -> bool:
        return all(split in f and test(f[split]) for f in figures.values())

    moved = pairs.filter("is_action_episode").groupBy("control_id").count()
    counts = {r["control_id"]: r["count"] for r in moved.filter(F.col("control_id").isin(controls)).collect()}
    gates = {
        "pairs_per_control": all(counts.get(c, 0) >= min_pairs for c in controls),
        "better_than_hold": every("validation", lambda f: f["mae"] <= better * f["hold_mae"]),
        "upper_coverage": every("validation", lambda f: f["coverage"] >= coverage),
        "audit_upper_coverage": every("audit", lambda f: f["coverage"] >= coverage),
        **(confirmed or {}),
    }
    bounds = {r["control_id"]: (r["lower"], r["upper"]) for r in observed_bounds(pairs, controls).collect()}
    domain = md.fit_joint_applicability(rows.filter("split = 'train'"), state, state)
    return EffectModel(controls, state, points, uppers, domain, bounds, gates)


def estimate_effects(asked: DataFrame, model: EffectModel, *, limit: float, keys=("entity", "ts")) -> DataFrame:
    """What the model expects of each proposed change against leaving the controls alone.

    ``asked`` has the keys, the state, ``control_id`` and ``proposed_delta``; NULL or unknown controls and changes that are
    NULL or not finite are refused with a reason, not scored.  Per horizon: ``sulfur``, ``sulfur_upper`` (never below the point)
    and ``effect`` (the difference of two scores of one row).  A row is applicable if no reason speaks against it.
    """
    from assaylake.operators import models as md

    names = [*model.state, *[f"delta_{c}" for c in model.controls]]
    change = F.col("proposed_delta")
    known = F.coalesce(F.col("control_id").isin(model.controls), F.lit(False))
    finite = change.isNotNull() & ~F.isnan(change) & (F.abs(change) < float("inf"))
    ok = F.coalesce(known & finite, F.lit(False))
    moved = {c: F.when(ok & (F.col("control_id") == c), change).otherwise(0.0) for c in model.controls}
    out = asked.withColumn("_ok", ok).withColumns({f"delta_{c}": v for c, v in moved.items()})
    out = model.domain.score(out).withColumnRenamed("applicability_code", "_domain")
    scored = []
    for h in model.points:
        out = model.uppers[h].score(md.predict(model.points[h], out, names, "_point"), "_point", "_upper")
        # The same row without the change; the changes come back afterwards.
        kept = {f"_kept_{c}": F.col(f"delta_{c}") for c in model.controls}
        out = out.withColumns(kept).withColumns({f"delta_{c}": F.lit(0.0) for c in model.controls})
        out = md.predict(model.points[h], out, names, "_hold").withColumns({f"delta_{c}": F.col(f"_kept_{c}") for c in model.controls})
        out = out.withColumns({
            f"sulfur_{h}m": F.when(F.col("_ok"), F.col("_point")), f"sulfur_upper_{h}m": F.when(F.col("_ok"), F.col("_upper")),
            f"effect_{h}m": F.when(F.col("_ok"), F.col("_point") - F.col("_hold")),
        }).drop("_point", "_upper", "_hold", *kept)
        scored += [f"sulfur_{h}m", f"sulfur_upper_{h}m", f"effect_{h}m"]
    inside = F.lit(False)
    for c, (low, high) in model.bounds.items():
        inside = inside | ((F.col("control_id") == c) & change.between(F.lit(low), F.lit(high)))
    inside = F.coalesce(inside, F.lit(False))
    over = {h: F.col(f"sulfur_upper_{h}m") > limit for h in model.points}
    reasons = F.array_compact(F.array(
        F.when(~known, F.lit("CONTROL_UNKNOWN")), F.when(known & ~F.col("_ok"), F.lit("ACTION_DELTA_INVALID")),
        F.lit(None if model.validated else "ACTION_EFFECT_VALIDATION_FAILED").cast("string"),
        F.when(F.col("_ok") & ~inside, F.lit("ACTION_DELTA_OUT_OF_OBSERVED_RANGE")),
        F.col("_domain"), *[F.when(test, F.lit(f"SULFUR_UPPER_LIMIT_{h}M")) for h, test in over.items()]))
    safe = F.col("_ok") & reduce(lambda a, b: a & b, [F.coalesce(~test, F.lit(False)) for test in over.values()])
    return out.select(
        *keys, "control_id", "proposed_delta", *scored, (inside & F.col("_domain").isNull()).alias("within_observed_domain"),
        F.lit(model.validated).alias("model_validated"), safe.alias("safety_passes"), reasons.alias("reason_codes"),
    ).withColumn("applicable", F.size("reason_codes") == 0)


def setpoint_grid(rows: DataFrame, specs: dict[str, dict], domain=None, max_combinations: int = 125) -> DataFrame:
    """Hold and every combination of +-1 and +-2 steps within limits and the joint domain.

    One to three controls; the grid is built inside the row, so nothing is joined.
    """
    from assaylake.operators.controls import distance_squared

    names = sorted(specs)
    if not 1 <= len(names) <= 3:
        raise ValueError("setpoint search requires one to three controls")
    grids = []
    for n in names:
        s = specs[n]
        moves = [m for m in (-2, -1, 1, 2) if abs(m * s["step"]) <= s["max_step"] + 1e-12]
        moved = [F.least(F.lit(s["upper"]), F.greatest(F.lit(s["lower"]), F.col(n) + m * s["step"])) for m in moves]
        grids.append(F.array_sort(F.array_distinct(F.array(F.col(n), *moved))))
    size = F.lit(1)
    for g in grids:
        size = size * F.size(g)
    out = rows.withColumn("_size", size)
    for n, g in zip(names, grids):
        out = out.withColumn(f"_g_{n}", g)
    guard = F.when(F.col("_size") - 1 <= max_combinations, F.lit(True)).otherwise(
        F.raise_error(F.lit("setpoint grid exceeds the limit")).cast("boolean"))
    out = out.filter(guard)
    for n in names:
        out = out.withColumn(f"set_{n}", F.explode(f"_g_{n}"))
    hold = F.lit(True)
    for n in names:
        hold = hold & (F.abs(F.col(f"set_{n}") - F.col(n)) <= 1e-12)
    out = out.withColumn("_hold", hold)
    if domain is not None:
        inside = distance_squared([F.col(f"set_{n}") for n in domain.names], domain) <= domain.max_distance_squared
        out = out.withColumn("in_domain", inside).filter(F.col("_hold") | F.col("in_domain"))
    payload = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.format_string("%.6f", F.round(F.col(f"set_{n}"), 6))) for n in names])
    return out.withColumn(
        "candidate_id", F.when(F.col("_hold"), "hold").otherwise(F.concat(F.lit("setpoints:"), payload))
    ).drop("_size", "_hold", *[f"_g_{n}" for n in names])


def linear_outcomes(
    candidates: DataFrame, specs: dict[str, dict], coefficients: dict[str, dict[str, float]], *,
    baseline: str, baseline_upper: str, limit: float, risk: float = 0.5, throughput: float = 1.0, cost: float = 1.0,
) -> DataFrame:
    """Consequences of each setpoint candidate and the reasons that rule it out."""
    names = sorted(specs)
    unknown = {c for m in coefficients.values() for c in m} - set(names)
    if unknown:
        raise ValueError(f"coefficients reference unknown controls: {sorted(unknown)}")
    delta = {n: F.col(f"set_{n}") - F.col(n) for n in names}

    def move(metric: str) -> Column:
        out = F.lit(0.0)
        for n in names:
            out = out + coefficients.get(metric, {}).get(n, 0.0) * delta[n]
        return out

    change = F.lit(0.0)
    arms = []
    for n in names:
        s = specs[n]
        change = change + F.abs(delta[n]) / s["step"]
        at = F.col(f"set_{n}")
        arms.append(F.when((at < s["lower"]) | (at > s["upper"]), F.lit("CONTROL_BOUND_VIOLATION")))
        arms.append(F.when(F.abs(delta[n]) > s["max_step"] + 1e-12, F.lit("CONTROL_STEP_VIOLATION")))
    if "in_domain" in candidates.columns:
        arms.append(F.when(~F.col("in_domain"), F.lit("OUT_OF_DOMAIN")))
    upper = F.col(baseline_upper) + move("sulfur")
    arms.append(F.when(upper.isNull(), F.lit("UNCERTAINTY_UNAVAILABLE")).when(upper > limit, F.lit("QUALITY_LIMIT_VIOLATION")))
    codes = F.array_distinct(F.array_compact(F.array(*arms)))
    return candidates.select(
        "*",
        (F.col(baseline) + move("sulfur")).alias("sulfur"), upper.alias("sulfur_upper"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(risk) + move("risk"))).alias("risk_index"),
        (F.lit(throughput) + move("throughput")).alias("throughput"), (F.lit(cost) + move("cost")).alias("cost_proxy"),
        change.alias("change_size"), codes.alias("codes"),
    ).withColumn("feasible", F.size("codes") == 0).withColumn("position", F.when(F.col("candidate_id") == "hold", 0).otherwise(1))
