"""Blends: mixing rules, candidate grids, closed-form share intervals.

A scenario is one row with short arrays (its components, constraints and additive curve), so the whole
chain from grid to checks is a narrow transformation.  Recipes of open length are rows instead and are
mixed by ``mass_blend``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.scalars import half_up

TOLERANCE = 1e-9
COMPONENT = (
    "struct<id:string,sulfur_value:double,sulfur_upper:double,t95_value:double,t95_upper:double,"
    "cetane_value:double,cetane_lower:double,density_value:double,density_lower:double,"
    "density_upper:double,stock:double,cost:double,risk:double>"
)
CONSTRAINT = (
    "struct<id:string,metric:string,lower:double,upper:double,unit:string,use_upper:boolean,use_lower:boolean>"
)
METRIC_UNIT = {"sulfur": "mg/kg", "t95": "degC", "cetane_number": "cetane_number", "density": "kg/m3"}
ESTIMATES = {
    "sulfur": ("sulfur_value", None, "sulfur_upper"),
    "t95": ("t95_value", None, "t95_upper"),
    "cetane_number": ("cetane_value", "cetane_lower", None),
    "density": ("density_value", "density_lower", "density_upper"),
}


def _a(field: str) -> Column:
    return F.col(f"a_{field}")


def _b(field: str) -> Column:
    return F.col(f"b_{field}")


def _fa() -> Column:
    return F.col("fractions")[0]


def _fb() -> Column:
    return F.col("fractions")[1]


def weighted(field: str, normalize: bool = False) -> Column:
    """NULL when a positively weighted component lacks the value; absence is never zero.

    Written out for the two components of a scenario: plain arithmetic stays inside generated code,
    which a lambda over an array would not.
    """
    unknown = ((_fa() > 0) & _a(field).isNull()) | ((_fb() > 0) & _b(field).isNull())
    mixed = _fa() * F.coalesce(_a(field), F.lit(0.0)) + _fb() * F.coalesce(_b(field), F.lit(0.0))
    return F.when(~unknown, mixed / (_fa() + _fb()) if normalize else mixed)


def reciprocal(field: str) -> Column:
    """Mass over volume; undefined with an additive, which has no density passport."""
    def volume(w: Column, v: Column) -> Column:
        return F.when(w <= 0, 0.0).when(v > 0, w / v)

    whole = volume(_fa(), _a(field)) + volume(_fb(), _b(field))
    return F.when((F.col("dose") == 0) & (whole > 0), 1.0 / whole)


def interpolate(curve: Column, dose: Column) -> Column:
    """Piecewise-linear lookup in the first matching segment; outside the curve is NULL."""
    segments = F.zip_with(
        F.slice(curve, 1, F.greatest(F.size(curve) - 1, F.lit(0))),
        F.slice(curve, 2, F.greatest(F.size(curve) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    hit = F.get(F.filter(segments, lambda s: (s["a"]["dose"] <= dose) & (dose <= s["b"]["dose"])), F.lit(0))
    share = (dose - hit["a"]["dose"]) / (hit["b"]["dose"] - hit["a"]["dose"])
    return hit["a"]["gain"] + share * (hit["b"]["gain"] - hit["a"]["gain"])


def additive_gain(dose: Column) -> Column:
    return F.when(dose == 0, 0.0).when(
        F.col("additive").isNotNull() & (dose <= F.col("additive.max_fraction") + TOLERANCE),
        interpolate(F.col("additive.curve"), dose),
    )


def blend_metrics(candidates: DataFrame) -> DataFrame:
    """Passport and ranking proxies of every candidate row."""
    gain = F.col("gain")
    change = (
        F.abs(_fa() - F.col("current_fractions")[0]) + F.abs(_fb() - F.col("current_fractions")[1])
        + F.abs(F.col("dose") - F.col("current_dose"))
    )
    return candidates.select(
        "*",
        weighted("sulfur_value").alias("sulfur_value"),
        weighted("sulfur_upper").alias("sulfur_upper"),
        weighted("t95_value", True).alias("t95_value"),
        weighted("t95_upper", True).alias("t95_upper"),
        (weighted("cetane_value", True) + gain).alias("cetane_value"),
        (weighted("cetane_lower", True) + gain).alias("cetane_lower"),
        reciprocal("density_value").alias("density_value"),
        reciprocal("density_upper").alias("density_lower"),
        reciprocal("density_lower").alias("density_upper"),
        weighted("risk", True).alias("risk_index"),
        F.col("total_mass").alias("throughput"),
        (weighted("cost") + F.coalesce(F.col("dose") * F.col("additive_cost"), F.lit(0.0))).alias("cost_proxy"),
        change.alias("change_size"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the scenarios over all cores before each becomes a hundred candidates.

    The later grouping by scenario then needs no further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)


def _flat(scenarios: DataFrame) -> DataFrame:
    """The additive and the two components as plain columns; the nested additive stays behind at the grid.

    Reaching into an array for every number of every candidate makes methods too long for the JVM's compiler.
    """
    a = F.col("additive")
    fields = [f.name for f in scenarios.schema["components"].dataType.elementType.fields]
    return scenarios.select(
        "*", *[F.get("components", F.lit(i))[f].alias(f"{side}_{f}") for i, side in enumerate("ab") for f in fields],
        a.isNotNull().alias("has_additive"), a["max_fraction"].alias("additive_limit"),
        a["stock"].alias("additive_stock"), a["cost"].alias("additive_cost"))


def _carried(scenarios: DataFrame) -> list[str]:
    """Scenario columns that travel with every candidate; the curve has done its work in ``gain``."""
    return [c for c in scenarios.columns if c != "additive"]


def candidate_grid(scenarios: DataFrame, share_steps: int = 20, max_candidates: int = 125) -> DataFrame:
    """Hold plus the share x dose grid of each two-component scenario.

    A grid above the limit fails the job; it is never cut.  A scenario lists only the numbers of its grid points; what a
    point stands for is worked out on the candidate rows, by plain arithmetic.
    """
    scenarios = _flat(spread(scenarios, "scenario_id"))
    points = share_steps + 1
    doses = F.when(F.col("additive").isNull(), F.array(F.lit(0.0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.round(F.col("additive.max_fraction") / F.col("additive.step")).cast("int")),
            lambda i: i * F.col("additive.step"),
        )
    )
    dosed = F.transform(doses, lambda d: F.struct(d.alias("dose"), additive_gain(d).alias("gain")))
    hold = F.struct(F.col("current_dose").alias("dose"), additive_gain(F.col("current_dose")).alias("gain"))

    def near(x: Column, y: Column) -> Column:
        return F.coalesce(F.abs(x - y) <= TOLERANCE, F.lit(True))

    def same_share(dose: Column, j: Column) -> Column:
        first, second = _shares(dose, j, share_steps)
        return near(first, F.col("current_fractions")[0]) & near(second, F.col("current_fractions")[1])

    # Numbers of the points that are the current recipe; shares are only looked at for doses that are the current one.
    current = F.flatten(F.transform("_doses", lambda d, i: F.when(
        near(d["dose"], F.col("current_dose")),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(share_steps)), lambda j: same_share(d["dose"], j)), lambda j: i * points + j),
    ).otherwise(F.array().cast("array<int>"))))
    fresh = F.array_except(F.sequence(F.lit(0), F.size("_doses") * points - 1), current)
    listed = scenarios.withColumn("_doses", dosed).withColumn("_grid", F.concat(F.array(F.lit(-1)), fresh))
    two = F.size("components") == 2
    guarded = listed.withColumn(
        "_grid",
        F.when(two & (F.size("_grid") <= max_candidates), F.col("_grid")).otherwise(
            F.raise_error(F.concat(
                F.lit("two components and a grid within the limit are required, got a grid of "),
                F.size("_grid").cast("string")))
            .cast("array<int>")
        ),
    ).withColumn("_doses", F.concat(F.array(hold), F.col("_doses")))
    # The outer form keeps the planner from filtering by the list's size, for which it would be made once more.
    rows = guarded.select("*", F.posexplode_outer("_grid").alias("position", "_k")).drop("_grid").filter("_k IS NOT NULL")
    at = F.when(F.col("_k") < 0, 0).otherwise(F.expr(f"CAST(_k DIV {points} AS INT)") + 1)
    rows = rows.withColumn("_g", F.col("_doses")[at]).drop("_doses")
    dose = F.col("_g.dose")
    fractions = F.when(F.col("_k") < 0, F.col("current_fractions")).otherwise(
        F.array(*_shares(dose, F.col("_k") % points, share_steps)))
    rows = rows.select(
        *_carried(scenarios), "position", dose.alias("dose"), F.col("_g.gain").alias("gain"), fractions.alias("fractions"))
    return rows.withColumn("candidate_id", F.when(F.col("position") == 0, "hold").otherwise(
        candidate_id("blend", F.col("fractions"), F.col("dose"))))


def _shares(dose: Column, j: Column, share_steps: int) -> tuple[Column, Column]:
    """Fractions of the two components at the share ``j / share_steps`` of the second."""
    share = j / F.lit(float(share_steps))
    return (1.0 - dose) * (1.0 - share), (1.0 - dose) * share


def candidate_id(kind: str, fractions: Column, dose: Column) -> Column:
    listed = F.split(F.lit(",".join(f"{k // 1000}.{k % 1000:03d}" for k in range(1001))), ",")

    def written(k: Column) -> Column:
        return F.concat((k / 1000).cast("int").cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))

    def text(x: Column) -> Column:
        """Three decimals from whole thousandths; those of a share are in a list."""
        k = half_up(x * 1000.0, 0).cast("int")
        return F.coalesce(F.get(listed, k), F.transform(F.array(k), written)[0])

    return F.concat(
        F.lit(f"{kind}:"), _a("id"), F.lit("="), text(fractions[0]), F.lit(","), _b("id"), F.lit("="),
        text(fractions[1]), F.lit(",additive="), text(dose),
    )


def recipe_grid(step: float, max_recipes: int = 125) -> list[float]:
    """Shares of the second component; the step must divide one exactly."""
    n = round(1.0 / step)
    if abs(n * step - 1.0) > TOLERANCE:
        raise ValueError("fraction step must divide one exactly")
    if n + 1 > max_recipes:
        raise ValueError(f"recipe grid requires {n + 1} recipes, limit {max_recipes}")
    return [i * step for i in range(n + 1)]


def _estimate(c: Column) -> Column:
    """The estimate a constraint looks at: its metric and its bound choice."""
    nothing = F.lit(None).cast("double")
    out = None
    for name, (value, lower, upper) in ESTIMATES.items():
        picked = (
            F.when(c["use_upper"], F.col(upper) if upper else nothing)
            .when(c["use_lower"], F.col(lower) if lower else nothing)
            .otherwise(F.col(value))
        )
        out = F.when(c["metric"] == name, picked) if out is None else out.when(c["metric"] == name, picked)
    return out


def check_status(
    known: Column, unit_matches: Column, actual: Column, lower: Column, upper: Column, tolerance: float = 1e-10
) -> Column:
    """pass / fail / unknown with its reason; an absent estimate is unknown, never a pass."""
    reason = (
        F.when(~known, "UNCERTAINTY_UNAVAILABLE")
        .when(~unit_matches, "UNIT_MISMATCH")
        .when(actual.isNull(), "UNCERTAINTY_UNAVAILABLE")
        .when(lower.isNotNull() & (actual < lower - tolerance), "QUALITY_LIMIT")
        .when(upper.isNotNull() & (actual > upper + tolerance), "QUALITY_LIMIT")
        .otherwise("OK")
    )
    return reason


def status_of(reason: Column) -> Column:
    return (
        F.when(reason == "OK", "pass")
        .when(reason.isin("UNCERTAINTY_UNAVAILABLE", "UNIT_MISMATCH"), "unknown")
        .otherwise("fail")
    )


#: So many constraints of a scenario are checked in plain expressions; a longer list goes through a lambda,
#: which takes longer.
WRITTEN_OUT = 4


def _quality_check(c: Column) -> tuple[Column, Column]:
    """What a constraint sees of the candidate, and its reason code."""
    unit = None
    for name, wanted in METRIC_UNIT.items():
        unit = F.when(c["metric"] == name, c["unit"] == wanted) if unit is None else unit.when(c["metric"] == name, c["unit"] == wanted)
    known, same_unit = c["metric"].isin(*ESTIMATES), F.coalesce(unit, F.lit(False))
    actual = F.when(known & same_unit, _estimate(c))
    return actual, check_status(known, same_unit, actual, c["lower"], c["upper"])


def quality_checks() -> Column:
    """Array of checks of the scenario's constraints against the candidate's metrics."""

    def one(c):
        actual, reason = _quality_check(c)
        return F.struct(
            c["id"].alias("constraint_id"), actual.alias("actual"), c["lower"].alias("lower"), c["upper"].alias("upper"),
            reason.alias("reason_code"),
        )

    written = F.array(*[one(F.get("constraints", F.lit(i))) for i in range(WRITTEN_OUT)])
    n = F.size("constraints")
    return F.when(n <= WRITTEN_OUT, F.slice(written, F.lit(1), n)).otherwise(F.transform("constraints", one))


def _stock_parts() -> list[tuple[Column, Column, Column, Column, str]]:
    """Name, actual, bound, verdict and reason code of the component stocks, additive fraction and additive stock."""
    parts = [
        (F.concat(F.lit("component_stock:"), of("id")), w * F.col("total_mass"), of("stock"),
         w * F.col("total_mass") <= of("stock"), "COMPONENT_STOCK")
        for of, w in ((_a, _fa()), (_b, _fb()))
    ]
    dose, mass = F.col("dose"), F.col("dose") * F.col("total_mass")
    limit, stock = F.col("additive_limit"), F.col("additive_stock")
    return [
        *parts,
        (F.lit("additive_fraction"), dose, limit, dose <= limit + TOLERANCE, "ADDITIVE_LIMIT"),
        (F.lit("additive_stock"), mass, stock, mass <= stock + TOLERANCE, "ADDITIVE_STOCK"),
    ]


def stock_checks() -> Column:
    """Component stocks, then additive fraction and additive stock."""
    nothing = F.lit(None).cast("double")
    checks = [
        F.struct(
            name.alias("constraint_id"), actual.alias("actual"), nothing.alias("lower"), upper.alias("upper"),
            F.when(ok, "OK").otherwise(reason).alias("reason_code"),
        )
        for name, actual, upper, ok, reason in _stock_parts()
    ]
    return F.when(F.col("has_additive"), F.array(*checks)).otherwise(F.array(*checks[:2]))


def _issue_codes() -> list[Column]:
    """The assessment's blocking codes in order, OK where one does not apply."""
    first = [
        (F.col("sulfur_value").isNull(), "MISSING_REQUIRED_SIGNAL"),
        (F.col("t95_value").isNull() | F.col("t95_upper").isNull(), "UNASSESSED_REQUIRED_PROPERTY"),
        ((F.coalesce(F.col("grade"), F.lit("")) != "hds_diesel")
         & (F.col("cetane_value").isNull() | F.col("cetane_lower").isNull()), "UNASSESSED_REQUIRED_PROPERTY"),
    ]
    late = F.col("require_upper") & F.col("sulfur_upper").isNull() & ~(first[0][0] | first[1][0] | first[2][0])
    return [F.when(met, code).otherwise("OK") for met, code in (*first, (late, "UNCERTAINTY_UNAVAILABLE"))]


def assessment_issues() -> Column:
    """Blocking issue codes of the quality assessment, in order."""
    return F.array_remove(F.array(*_issue_codes()), "OK")


def blocking_codes() -> Column:
    """Issue codes and then the codes of checks that were not passed, in order.

    They are told from the candidate's metrics, without the rows of ``checks``; NULL without a list of constraints.
    """
    n = F.size("constraints")
    checked = [
        F.when(n > i, _quality_check(F.get("constraints", F.lit(i)))[1]).otherwise("OK") for i in range(WRITTEN_OUT)
    ]
    parts = _stock_parts()
    stocks = [F.when(ok, "OK").otherwise(reason) for *_, ok, reason in parts[:2]]
    stocks += [F.when(~F.col("has_additive") | ok, "OK").otherwise(reason) for *_, ok, reason in parts[2:]]
    many = F.concat(
        F.array(*_issue_codes()), F.transform("constraints", lambda c: _quality_check(c)[1]), F.array(*stocks))
    # A lambda over the short list of codes keeps these expressions out of whole-stage code, where they would make one
    # method that is too long for the JVM's compiler.
    listed = F.when(n <= WRITTEN_OUT, F.array(*_issue_codes(), *checked, *stocks)).otherwise(many)
    return F.filter(listed, lambda code: code != "OK")


def evaluate(candidates: DataFrame) -> DataFrame:
    """Metrics, checks, blocking codes in order, and feasibility of every candidate."""
    measured = blend_metrics(candidates)
    checked = measured.select(
        "*", F.concat(quality_checks(), stock_checks()).alias("checks"), assessment_issues().alias("issues"),
        blocking_codes().alias("codes"))
    ranked = (
        F.col("risk_index").isNotNull() & F.col("throughput").isNotNull() & F.col("cost_proxy").isNotNull()
    )
    # Codes hold the issues; where there are none for want of constraints, an issue still decides.
    clear = F.coalesce(F.size("codes") == 0, F.when(F.size("issues") > 0, F.lit(False)))
    return checked.withColumn("feasible", clear & ranked)


def mass_blend(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mix recipes given as rows (keys, fraction, properties); any number of components.

    Every rule is a sum, so partial sums leave each task and a crowded recipe is not a problem.
    """
    w = F.col("fraction")
    used = w > 0

    def mix(name: str, normalize: bool = False) -> Column:
        unknown = F.count_if(used & F.col(name).isNull())
        mixed = F.sum(F.when(used, w * F.col(name)))
        return F.when(unknown == 0, mixed / F.sum(w) if normalize else mixed)

    def volume(name: str) -> Column:
        unknown = F.count_if(used & (F.col(name).isNull() | (F.col(name) <= 0)))
        return F.when(unknown == 0, 1.0 / F.sum(F.when(used, F.try_divide(w, F.col(name)))))

    return rows.groupBy(*keys).agg(
        mix("sulfur_value").alias("sulfur_value"), mix("sulfur_upper").alias("sulfur_upper"),
        mix("t95_value", True).alias("t95_value"), mix("t95_upper", True).alias("t95_upper"),
        mix("cetane_value", True).alias("cetane_value"), mix("cetane_lower", True).alias("cetane_lower"),
        volume("density_value").alias("density_value"), volume("density_upper").alias("density_lower"),
        volume("density_lower").alias("density_upper"),
        F.count_if(w * F.col("total_mass") > F.col("stock") + TOLERANCE).alias("stock_shortfalls"),
        F.count("*").alias("components"),
    ).withColumn(
        "unassessed",
        F.array_compact(F.array(
            F.when(F.col("t95_upper").isNull(), F.lit("t95")), F.when(F.col("cetane_lower").isNull(), F.lit("cetane_number")))),
    )


def sulfur_status(limit: Column | float, require_upper: bool = True) -> Column:
    lim = F.lit(limit) if isinstance(limit, float) else limit
    value = F.col("sulfur_upper") if require_upper else F.col("sulfur_value")
    return (
        F.when(F.col("stock_shortfalls") > 0, "fail").when(value.isNull(), "unknown")
        .when(value <= lim, "pass").otherwise("fail")
    )


def override_component(components: DataFrame, forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the sulfur of one component by its forecast; each forecast must match exactly once."""
    at = [*keys, "component_id"]
    f = forecasts.select(
        *at, F.col("sulfur_value").alias("_v"), F.col("sulfur_upper").alias("_u"), F.lit(True).alias("_hit"))
    # Counting matches is an aggregate over the component table, not a list.
    matches = components.groupBy(*at).agg(F.count("*").alias("_n"))
    guarded = f.join(matches, at, "left").withColumn(
        "_v", F.when(F.col("_n") == 1, F.col("_v")).otherwise(
            F.raise_error(F.lit("forecast component must match exactly one blend component")).cast("double")))
    joined = components.join(guarded, at, "left")
    return joined.select(
        *[c for c in components.columns if c not in ("sulfur_value", "sulfur_upper")],
        F.when(F.col("_hit"), F.col("_v")).otherwise(F.col("sulfur_value")).alias("sulfur_value"),
        F.when(F.col("_hit"), F.col("_u")).otherwise(F.col("sulfur_upper")).alias("sulfur_upper"),
        F.coalesce("_hit", F.lit(False)).alias("forecast_used"),
    )


def share_interval(scenarios: DataFrame, desired_b: Column | None = None, desired_dose: Column | None = None) -> DataFrame:
    """Closed interval [lo, hi] of the second share per dose, from stocks and linear constraints."""
    a, b = F.col("components")[0], F.col("components")[1]
    wish = F.coalesce(desired_dose, F.col("current_dose")) if desired_dose is not None else F.col("current_dose")
    grid = F.transform(
        F.sequence(F.lit(0), F.round(F.col("additive.max_fraction") / F.col("additive.step")).cast("int")),
        lambda i: i * F.col("additive.step"))
    doses = F.when(F.col("additive").isNull(), F.array(F.lit(0.0))).otherwise(
        F.array_sort(F.array_union(grid, F.array(wish))))
    rows = scenarios.select("*", F.explode(doses).alias("dose")).filter(
        F.col("additive").isNull()
        | ((F.col("dose") >= 0) & (F.col("dose") <= F.col("additive.max_fraction") + TOLERANCE)
           & (F.col("dose") * F.col("total_mass") <= F.col("additive.stock") + TOLERANCE)))
    rows = rows.withColumn("gain", additive_gain(F.col("dose")))
    diesel = 1.0 - F.col("dose")
    mass = F.col("total_mass")
    gain = F.col("gain")

    def edge(c):
        """(slope, intercept) of the constrained estimate as a function of the second share."""
        which = F.when(c["use_upper"], "upper").when(c["use_lower"], "lower").otherwise("value")

        def of(side):
            out = None
            for name, names in ESTIMATES.items():
                if name == "density":
                    continue
                value, lower, upper = names
                none = F.lit(None).cast("double")
                v = (F.when(which == "upper", side[upper] if upper else none)
                     .when(which == "lower", side[lower] if lower else none).otherwise(side[value]))
                out = F.when(c["metric"] == name, v) if out is None else out.when(c["metric"] == name, v)
            return out

        left, right = of(a), of(b)
        is_sulfur = c["metric"] == "sulfur"
        slope = F.when(is_sulfur, right - left).otherwise((right - left) / diesel)
        start = F.when(is_sulfur, diesel * left).otherwise(
            left + F.when(c["metric"] == "cetane_number", gain).otherwise(0.0))
        return slope, start

    none = F.lit(None).cast("double")

    def bounds(c):
        slope, start = edge(c)
        flat = F.abs(slope) < 1e-12
        up, lo = c["upper"], c["lower"]
        unknown = slope.isNull() | start.isNull()
        broken = (
            unknown
            | F.coalesce(flat & (start > up + 1e-10), F.lit(False))
            | F.coalesce(flat & (start < lo - 1e-10), F.lit(False))
        )
        cut_up, cut_lo = F.when(~flat, (up - start) / slope), F.when(~flat, (lo - start) / slope)
        hi = F.least(F.when(slope > 0, cut_up).otherwise(none), F.when(slope < 0, cut_lo).otherwise(none))
        low = F.greatest(F.when(slope < 0, cut_up).otherwise(none), F.when(slope > 0, cut_lo).otherwise(none))
        return F.struct(broken.alias("broken"), low.alias("lo"), hi.alias("hi"))

    cuts = F.transform("constraints", bounds)
    located = rows.withColumn("_cuts", cuts)
    lo = F.greatest(F.lit(0.0), diesel - a["stock"] / mass, F.array_max(F.transform("_cuts", lambda x: x["lo"])))
    hi = F.least(diesel, b["stock"] / mass, F.array_min(F.transform("_cuts", lambda x: x["hi"])))
    broken = F.exists("_cuts", lambda x: x["broken"])
    return located.withColumn("lo", F.when(broken, 1.0).otherwise(lo)).withColumn(
        "hi", F.when(broken, 0.0).otherwise(hi)
    ).drop("_cuts")


def assisted_candidates(scenarios: DataFrame) -> DataFrame:
    """Interval ends, the nearest shares to the current recipe and the middle, as candidates."""
    scenarios = _flat(spread(scenarios, "scenario_id"))
    spans = share_interval(scenarios).filter(F.col("lo") <= F.col("hi") + TOLERANCE)
    clamp = lambda x: F.greatest(F.col("lo"), F.least(F.col("hi"), x))
    points = F.array_sort(F.array_distinct(F.array(
        clamp(F.col("lo")), clamp(F.col("hi")), clamp(F.col("current_fractions")[1]),
        clamp(1.0 - F.col("dose") - F.col("current_fractions")[0]), clamp((F.col("lo") + F.col("hi")) / 2.0))))
    rows = spans.select("*", F.explode(points).alias("_b"))
    fractions = F.array(1.0 - F.col("dose") - F.col("_b"), F.col("_b"))
    return rows.select(
        *_carried(scenarios), F.lit(1000).alias("position"), "dose", "gain", fractions.alias("fractions"),
        F.concat(F.lit("assisted:"), F.format_string("%.12f", F.col("_b")), F.lit(",dose="), F.format_string("%.12f", F.col("dose"))).alias("candidate_id"),
    )


def assist_three(evaluated: DataFrame) -> DataFrame:
    """Nearest, cheapest and least-additive feasible option per scenario, equal options once."""
    distance = (
        F.abs(_fa() - F.col("current_fractions")[0]) + F.abs(_fb() - F.col("current_fractions")[1])
        + F.abs(F.col("dose") - F.col("current_dose"))
    )
    rows = evaluated.filter("feasible").withColumn("_d", distance)
    b = F.col("fractions")[1]
    option = F.struct(F.col("dose"), b.alias("share_b"), F.col("cost_proxy"), F.col("_d").alias("distance"))
    best = rows.groupBy("scenario_id").agg(
        F.min_by(option, F.struct("_d", "cost_proxy", "dose", b)).alias("nearest"),
        F.min_by(option, F.struct("cost_proxy", "_d", "dose", b)).alias("cheapest"),
        F.min_by(option, F.struct("dose", "_d", "cost_proxy", b)).alias("least_additive"),
    )

    def same(x, y):
        return (F.abs(F.col(x)["dose"] - F.col(y)["dose"]) < 1e-10) & (
            F.abs(F.col(x)["share_b"] - F.col(y)["share_b"]) < 1e-10)

    listed = F.array_compact(F.array(
        F.struct(F.lit("nearest").alias("label"), F.col("nearest").alias("o")),
        F.when(~same("cheapest", "nearest"), F.struct(F.lit("cheapest").alias("label"), F.col("cheapest").alias("o"))),
        F.when(~same("least_additive", "nearest") & ~same("least_additive", "cheapest"),
               F.struct(F.lit("least_additive").alias("label"), F.col("least_additive").alias("o"))),
    ))
    return best.select("scenario_id", F.explode(listed).alias("_x")).select("scenario_id", "_x.label", "_x.o.*")
