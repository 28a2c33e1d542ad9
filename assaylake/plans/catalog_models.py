"""Model training, scoring and audits; figures are checked for shape and sanity, not bit by bit."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.scalars import rounded
from assaylake.operators import metrics as m
from assaylake.operators import models as md
from assaylake.operators import splits as sp
from assaylake.operators.alarms import composite_alarm
from assaylake.operators.asof import published_depth
from assaylake.operators.cleanse import eligible
from assaylake.operators.thresholds import event_threshold
from assaylake.plans.catalog_actions import CONTEXT, CONTROLS, HORIZONS, timeline
from assaylake.plans.catalog_features import serving_frame, supervised_frame
from assaylake.plans.catalog_windows import episodes
from assaylake.plans.frames import alarm_score, persistence, scored
from assaylake.plans.registry import query
from assaylake.plans.replay import summary
from assaylake.sources.adapters import LIMIT, SIGNALS, TRAIN_END, VALIDATION_END, analyser, hour_grid, quality, telemetry, with_views
from assaylake.session import materialise

FEATURES = ("click__lag_0m", "view__mean_180m", "signup__lag_0m", "target__last", "target__age_minutes", "target__lag_60m",
            "target__mean_180m", "target__std_180m")


def training_frame(t):
    frame = supervised_frame(t).withColumn("split", sp.outer_split(TRAIN_END, VALIDATION_END))
    return materialise(frame, "training-frame")


@query("argmin_model", with_views("scored", """
WITH c AS (SELECT * FROM (SELECT 'last_value' AS model, avg(abs(y - baseline)) AS mae, count(*) FILTER (y > 60 AND baseline <= 60) AS missed, 0 AS cx FROM scored WHERE split = 'validation'
 UNION ALL SELECT 'ridge', avg(abs(y - point)), count(*) FILTER (y > 60 AND point <= 60), 1 FROM scored WHERE split = 'validation'
 UNION ALL SELECT 'boosted', avg(abs(y - upper)), count(*) FILTER (y > 60 AND upper <= 60), 2 FROM scored WHERE split = 'validation')),
e AS (SELECT * FROM c WHERE missed <= (SELECT missed FROM c WHERE model = 'last_value'))
SELECT arg_min(model, (round(mae, 12), cx)) AS model, round(min(mae), 6) AS mae, count(*) AS eligible FROM e"""))
def argmin_model(t):
    rows = scored(t).filter("split = 'validation'")
    tall = rows.select("y", F.explode(F.array(
        F.struct(F.lit("last_value").alias("model"), F.col("baseline").alias("x"), F.lit(0).alias("complexity")),
        F.struct(F.lit("ridge").alias("model"), F.col("point").alias("x"), F.lit(1).alias("complexity")),
        F.struct(F.lit("boosted").alias("model"), F.col("upper").alias("x"), F.lit(2).alias("complexity")))).alias("_m")).select("y", "_m.*")
    table = tall.groupBy("model", "complexity").agg(
        F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"), F.count_if((F.col("y") > LIMIT) & (F.col("x") <= LIMIT)).alias("missed"))
    return rounded(md.argmin_model(table), ("mae",))


@query("train_point_models")
def train_point_models(t):
    model = md.train_point_model(training_frame(t), FEATURES, limit=LIMIT)
    return t.spark.createDataFrame(
        [(r["model"], float(r["mae"]), int(r["missed"]), r["model"] == model.family) for r in model.comparison],
        "model string, validation_mae double, missed long, selected boolean")


@query("upper_shift", with_views("scored", """
WITH v AS (SELECT *, row_number() OVER (ORDER BY as_of, observation_id) AS pos, count(*) OVER () AS n FROM scored WHERE split = 'validation')
SELECT round(greatest(0, quantile_cont(y - point, 0.95)), 6) AS shift FROM v WHERE pos > n // 2"""))
def upper_shift(t):
    from assaylake.operators.series import half_split

    halves = half_split(scored(t).filter("split = 'validation'"), ["as_of", "observation_id"])
    value = md.conformal_shift(halves.filter("half = 2"), "point")
    return t.spark.range(1).select(F.round(F.lit(value), 6).alias("shift"))


@query("upper_quantile_head")
def upper_quantile_head(t):
    frame = training_frame(t).filter("baseline IS NOT NULL")
    point = md.fit_regression(frame.filter("split = 'train'"), FEATURES, "y", "ridge", alpha=1.0)
    frame = materialise(md.predict(point, frame, FEATURES, "point"), "upper-frame")
    head = md.fit_upper_head(frame, FEATURES)
    judged = head.score(frame.filter(F.col("split").isNotNull())).groupBy("split").agg(
        *m.upper_columns(F.col("y"), F.col("point"), F.col("upper")))
    return judged.withColumn("model_id", F.lit(head.model_id)).withColumn("shift", F.lit(head.shift))


@query("joint_applicability")
def joint_applicability(t):
    frame = training_frame(t)
    model = md.fit_joint_applicability(frame.filter("split = 'train'"), FEATURES, ["target__last"])
    return model.score(frame).groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("applicability_code").isNull()).alias("applicable"),
        F.count_if(F.col("applicability_code") == "OUT_OF_DOMAIN").alias("out_of_domain"))


@query("risk_classifier")
def risk_classifier(t):
    frame = training_frame(t)
    model = md.fit_risk_model(frame, FEATURES, limit=LIMIT)
    test = model.score(frame.filter("split = 'test' AND y IS NOT NULL AND baseline IS NOT NULL"))
    out = test.agg(*m.alarm_columns(F.col("y") > LIMIT, F.col("p"), model.threshold))
    return out.select(F.lit(model.family).alias("family"), F.lit(model.positive_weight).alias("positive_weight"), F.lit(model.threshold).alias("threshold"), "*")


@query("lims_correction")
def lims_correction(t):
    """Laboratory targets over the forecast of the model fitted on analyser targets."""
    from assaylake.operators.asof import published_depth
    from assaylake.operators.features import supervised

    lab = eligible(quality(t), "lims")
    analysed = training_frame(t).filter("split = 'train' AND baseline IS NOT NULL")
    model = md.fit_regression(analysed, FEATURES, "y", "ridge", alpha=1.0)
    asks = supervised(lab, telemetry(t), analyser(t), signals=SIGNALS).filter("baseline IS NOT NULL")
    known = md.predict(model, asks, FEATURES, "pak_point")
    lagged = published_depth(known, lab, keys=["entity"], query_ts="as_of")
    frame = lagged.withColumn("split", sp.outer_split(TRAIN_END, VALIDATION_END)).filter("split IS NOT NULL")
    fit = md.fit_lab_correction(frame, ["pak_point", "baseline", "target__age_minutes", *[f"lims_published_lag_{k}" for k in range(3)], "lims_age_minutes_0"])
    return fit["report"].withColumn("selected", F.lit(fit["selected"])).withColumn("promotion_eligible", F.lit(bool(fit["promotion_eligible"])))


#: Boosting rounds of the ablation, where only feature groups are compared.
ABLATION_ROUNDS = 8
EPISODE_FEATURES = ("baseline", "min_30m", "max_60m", "range_180m", "slope_30m", "slope_60m", "since_60_minutes", "regime_minutes")


def episode_training(t):
    frame = episodes(t).filter(F.col("baseline").isNotNull()).withColumn("target_available_at", F.col("target_at"))
    frame = frame.withColumn("row_id", F.concat_ws("|", F.col("entity").cast("string"), F.col("as_of").cast("string")))
    return materialise(sp.episode_weights(frame.withColumn("_w", F.date_trunc("week", "as_of")), period="_w").drop("_w"), "episode-training")


PERIOD = "8 DAY"
HORIZONS_AHEAD = (10, 20, 30, 60)


def periods(frame) -> list[str]:
    """Starts of three folds of eight days, and the end, counted back from the last row."""
    row = frame.agg(F.max("as_of").alias("b")).select(*[
        F.date_format(F.date_add(F.to_date("b"), 1 - 8 * k), "yyyy-MM-dd").alias(f"c{k}") for k in (3, 2, 1, 0)
    ]).first()
    return list(row)


@query("cap_training_rows")
def cap_training_rows(t):
    frame = episode_training(t)
    kept = sp.cap_training_rows(frame, 1200, "row_id", F.col("crossing_60m"), 42)
    return kept.groupBy("crossing_60m").agg(F.count("*").alias("n"))


@query("episode_forecaster")
def episode_forecaster(t):
    """Families compared on one period, calibrated and thresholded on the next, audited on the last."""
    frame = episode_training(t)
    first, second, third, end = periods(frame)
    reports, picks = [], []
    for order, family in enumerate(("logistic", "boosted")):
        rows = md.rolling_scores(frame, EPISODE_FEATURES, family, first, second, step=PERIOD, horizons=HORIZONS_AHEAD)
        threshold = event_threshold(rows, limit=LIMIT)
        figures = m.event_metrics(rows, threshold=threshold, limit=LIMIT).first()
        mae = rows.agg(F.avg(F.abs(F.col("y_60m") - F.col("baseline") - F.col("predicted_delta"))).alias("e")).first()["e"]
        ok = (figures["event_false_positive_rate"] or 0) <= 0.2 and (figures["row_false_positive_rate"] or 0) <= 0.2
        fnr = figures["event_false_negative_rate"]
        picks.append((0 if ok else 1, 1.0 if fnr is None else fnr, figures["brier"], mae, order, family))
        reports.append(("selection", family, threshold, figures["event_count"], fnr, figures["event_false_positive_rate"]))
    family = min(picks)[-1]
    tuned = md.rolling_scores(frame, EPISODE_FEATURES, family, second, third, step=PERIOD, horizons=HORIZONS_AHEAD, delta=False, upper=True)
    calibration = md.fit_platt(tuned, "p", "crossing_60m")
    policy = materialise(tuned.withColumn("p", md.platt(F.col("p"), calibration)), "policy")
    threshold = event_threshold(policy, limit=LIMIT)
    # The upper head is shifted, and the domain drawn, before the period that is audited.
    change = lambda rows: rows.withColumn("y", F.col("y_60m") - F.col("baseline")).filter("y IS NOT NULL")
    shift = md.conformal_shift(change(policy), "upper_delta")
    domain = md.fit_joint_applicability(frame.filter(F.col("as_of") < F.lit(third).cast("timestamp_ntz")), EPISODE_FEATURES, ["baseline"])
    audit = md.rolling_scores(frame, EPISODE_FEATURES, family, third, end, step=PERIOD, horizons=HORIZONS_AHEAD, upper=True)
    audit = audit.withColumn("p", md.platt(F.col("p"), calibration))
    for stage, rows in (("threshold", policy), ("audit", audit)):
        f = m.event_metrics(rows, threshold=threshold, limit=LIMIT).first()
        raised = F.col("upper_delta") + F.lit(shift)
        point = F.lit(None).cast("double")
        if "predicted_delta" in rows.columns:
            point = F.col("predicted_delta")
            raised = F.greatest(point, raised)
        u = change(domain.score(rows)).agg(
            F.avg((F.col("y") <= raised).cast("double")).alias("coverage"), F.avg(raised - point).alias("width"),
            F.avg(F.col("applicability_code").isNull().cast("double")).alias("applicable"),
            F.avg(F.when(F.col("applicability_code").isNull(), (F.col("y") <= raised).cast("double"))).alias("inside")).first()
        reports.append((stage, family, threshold, f["event_count"], f["event_false_negative_rate"], f["event_false_positive_rate"],
                        u["coverage"], u["width"], u["applicable"], u["inside"]))
    return t.spark.createDataFrame(
        [r if len(r) == 10 else (*r, None, None, None, None) for r in reports],
        "stage string, family string, threshold double, event_count long, event_fnr double, event_fpr double, upper_coverage double, "
        "upper_width double, applicable_rate double, coverage_in_domain double")


@query("episode_scoring")
def episode_scoring(t):
    """One forecast record per decision time with horizon probabilities and ordered reasons."""
    frame = episode_training(t)
    first, second, _, end = periods(frame)
    with_point = lambda df: df.withColumn("point", F.col("baseline") + F.col("predicted_delta"))
    # Threshold and upper shift come from the period before the one that is scored.
    tuned = with_point(md.rolling_scores(frame, EPISODE_FEATURES, "logistic", first, second, step=PERIOD, horizons=HORIZONS_AHEAD))
    threshold = event_threshold(tuned, limit=LIMIT)
    shift = md.conformal_shift(tuned.withColumn("y", F.col("y_60m")).filter("y IS NOT NULL"), "point")
    rows = md.rolling_scores(frame, EPISODE_FEATURES, "logistic", second, end, step=PERIOD, horizons=HORIZONS_AHEAD)
    model = md.fit_joint_applicability(frame.filter(F.col("as_of") < F.lit(second).cast("timestamp_ntz")), EPISODE_FEATURES, ["baseline"])
    ready = with_point(model.score(rows)).withColumn("upper", F.col("point") + shift)
    alarmed = composite_alarm(ready, threshold=threshold, limit=LIMIT)
    from assaylake.functions.scalars import running_maximum

    calm = running_maximum({f"p_{h}m": F.col(f"p_{h}m") for h in (10, 20, 30, 60)})
    return alarmed.select("entity", "as_of", "point", "upper", "alarm", "applicable", F.col("predicted_delta"), *calm, F.array_join("reason_codes", ",").alias("reasons"))


@query("feature_ablation")
def feature_ablation(t):
    """Fixed feature groups compared on the same folds under the same training budget."""
    frame = episode_training(t)
    groups = {"level_only": ["baseline"], "trajectory": ["baseline", "slope_30m", "slope_60m", "range_180m"], "full": list(EPISODE_FEATURES)}
    out = []
    for name, features in groups.items():
        for family in ("logistic", "boosted"):
            rows = md.rolling_scores(frame, features, family, *periods(frame)[1:3], step=PERIOD, horizons=(60,), cap=20_000, delta=False,
                                     rounds=ABLATION_ROUNDS)
            threshold = event_threshold(rows, limit=LIMIT)
            f = m.event_metrics(rows, threshold=threshold, limit=LIMIT).first()
            out.append((name, family, len(features), f["event_false_negative_rate"], f["event_false_positive_rate"], f["row_false_positive_rate"], f["brier"]))
    table = t.spark.createDataFrame(out, "feature_group string, family string, feature_count int, event_fnr double, event_fpr double, row_fpr double, brier double")
    eligible_rows = (F.col("event_fpr") <= 0.2) & (F.col("row_fpr") <= 0.2)
    best = table.groupBy("feature_group").agg(F.min_by("family", F.when(eligible_rows, F.struct("event_fnr", "brier", "family"))).alias("selected_family"))
    return table.join(best, "feature_group")


STATE = ["baseline_sulfur", "sulfur_slope_60m", *CONTROLS, *CONTEXT]
ACTION_FEATURES = [*STATE, *[f"delta_{c}" for c in CONTROLS]]


def action_rows(t):
    from assaylake.operators import actions as ac

    both = ac.action_pairs(timeline(t), controls=CONTROLS, context=CONTEXT, thresholds={c: 25.0 for c in CONTROLS}, horizons=HORIZONS,
                           train_end=TRAIN_END, before_rows=1, quiet_rows=1)
    split = F.when(F.col("ts") < TRAIN_END, "train").when(F.col("ts") < VALIDATION_END, "validation").otherwise("audit")
    return materialise(both.withColumn("split", split), "action-rows")


@query("action_effect_model")
def action_effect_model(t):
    rows = action_rows(t)
    train = rows.filter("split = 'train'")
    parts = []
    for h in HORIZONS:
        y = f"sulfur_{h}m"
        model = md.fit_regression(train, ACTION_FEATURES, y, "ridge", alpha=10.0)
        out = md.predict(model, rows, ACTION_FEATURES, "point").withColumn("y", F.col(y))
        raw = md.bucket_upper(out.filter("split = 'train'"), 3)
        held = out.withColumn("_raw", raw)
        shift = md.conformal_shift(held.filter("split = 'validation'"), "_raw")
        parts.append(held.withColumn("upper", F.greatest("point", F.col("_raw") + shift)).filter("split <> 'train'").groupBy("split").agg(
            F.count("*").alias("rows"), F.avg(F.abs(F.col("y") - F.col("point"))).alias("mae"),
            F.avg(F.abs(F.col("y") - F.col("baseline_sulfur"))).alias("hold_mae"),
            F.avg((F.col("y") <= F.col("upper")).cast("double")).alias("upper_coverage")).withColumn("horizon", F.lit(h)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Proposed changes of every control; the outer ones lie beyond what most plants have seen.
PROPOSED = (-10.0, -5.0, 5.0, 10.0)


@query("action_estimate")
def action_estimate(t):
    """Effects of proposed changes of every control, over all horizons, at every known state."""
    from assaylake.operators import actions as ac

    model = ac.fit_effect_model(
        action_rows(t), controls=CONTROLS, state=STATE, horizons=HORIZONS,
        confirmed={"sign_stability": False, "engineering_bounds": False, "shadow_replay": False, "pilot": False})
    asked = timeline(t).filter(" AND ".join(f"{c} IS NOT NULL" for c in STATE)).select("entity", "ts", *STATE)
    asked = asked.withColumn("control_id", F.explode(F.array(*[F.lit(c) for c in CONTROLS]))).withColumn(
        "proposed_delta", F.explode(F.array(*[F.lit(d) for d in PROPOSED])))
    out = ac.estimate_effects(asked, model, limit=LIMIT)
    return out.withColumn("reasons", F.array_join("reason_codes", ",")).drop("reason_codes")


@query("temporal_residualization")
def temporal_residualization(t):
    """Residual-on-residual effect with forward-only cross-fitting, and its sign per fold."""
    from assaylake.operators.quantiles import exact_quantiles

    train = action_rows(t).filter("split = 'train'")
    blocks = sp.time_blocks(train.withColumn("as_of", F.col("ts")), 4)
    rows = materialise(train.join(blocks.withColumnRenamed("as_of", "ts"), "ts"), "residual-rows")
    y = "sulfur_60m"
    pieces = []
    for k in (1, 2, 3):
        past, now = rows.filter(F.col("block") < k), rows.filter(F.col("block") == k)
        for target, out in ((f"delta_{CONTROLS[0]}", "a0"), (f"delta_{CONTROLS[1]}", "a1"), (y, "yh")):
            now = md.predict(md.fit_regression(past, STATE, target, "ridge", alpha=10.0), now, STATE, out)
        pieces.append(now.select(F.lit(k).alias("fold"), (F.col(f"delta_{CONTROLS[0]}") - F.col("a0")).alias("r0"),
                                 (F.col(f"delta_{CONTROLS[1]}") - F.col("a1")).alias("r1"), (F.col(y) - F.col("yh")).alias("ry")))
    residuals = pieces[0]
    for p in pieces[1:]:
        residuals = residuals.unionByName(p)
    residuals = materialise(residuals, "residuals")
    out = []
    for fold in (0, 1, 2, 3):
        part = residuals if fold == 0 else residuals.filter(F.col("fold") == fold)
        effect = md.fit_regression(part, ["r0", "r1"], "ry", "ridge", alpha=10.0)
        for i, control in enumerate(CONTROLS):
            scale = exact_quantiles(part, [], F.abs(F.col(f"r{i}")), {"q": 0.75}).first()["q"]
            probe = t.spark.createDataFrame([(0, 0.0, 0.0), (1, scale if i == 0 else 0.0, scale if i == 1 else 0.0)], "k int, r0 double, r1 double")
            got = {r["k"]: r["e"] for r in md.predict(effect, probe, ["r0", "r1"], "e").collect()}
            out.append((control, fold, got[1] - got[0], part.count()))
    return t.spark.createDataFrame(out, "control_id string, fold int, effect double, rows long")


#: Penalty of the replayed point model, and the quantiles that bound its domain.
REPLAY_ALPHA = 1.0
DOMAIN = (0.001, 0.999)


def replay_model(t):
    """The point model and shift fitted on the persistence frame, stored and read back as a replay would find them."""
    from assaylake.operators.quantiles import exact_quantiles
    from assaylake.operators.series import half_split
    from assaylake.session import shared_dir
    from assaylake.sources.model_store import ForecastModel, Manifest, load_model, save_model

    frame = materialise(scored(t).select("as_of", "observation_id", "split", "y", "baseline"), "replay-train")
    train = frame.filter("split = 'train'")
    point = md.PointModel("ridge", ["baseline"], md.fit_regression(train, ["baseline"], "y", "ridge", alpha=REPLAY_ALPHA), [])
    halves = half_split(frame.filter("split = 'validation'"), ["as_of", "observation_id"])
    shift = md.conformal_shift(point.score(halves.filter("half = 2")), "point")
    edges = exact_quantiles(train, [], F.col("baseline"), {"low": DOMAIN[0], "high": DOMAIN[1]}).first()
    boundaries = {"train_end": TRAIN_END, "validation_end": VALIDATION_END}
    manifest = Manifest("replay", ["baseline"], "baseline", 60, LIMIT, "tables", boundaries, {"baseline": (edges["low"], edges["high"])})
    root = shared_dir(t.spark, "models")
    save_model(root, ForecastModel(manifest, point, md.UpperHead("shifted_point", None, shift)), t.spark)
    return load_model(t.spark, root, "replay", features=["baseline"], dataset_id="tables", boundaries=boundaries)


def replayed(t):
    """Every hour of the period: what was known, the stored model's forecast, its assessment and the decision.

    Without a model of actions a forecast recommends nothing, which the model's manifest says.
    """
    from assaylake.operators.asof import asof_published
    from assaylake.operators.decisions import forecast_quality

    model = replay_model(t)
    known = asof_published(hour_grid(t), analyser(t), keys=["entity"], query_ts="as_of").withColumnRenamed("last_value", "baseline")
    limit = model.manifest.limit
    rows = model.score(known).withColumn("alarm", F.coalesce((F.col("baseline") > limit) | (F.col("upper") > limit), F.lit(False)))
    judged = forecast_quality(rows)
    codes = F.col("quality_codes")
    if not model.manifest.supports_actions:
        codes = F.array_append(codes, F.lit("ACTION_MODEL_UNAVAILABLE"))
    status = F.when(F.array_contains(codes, "ACTION_MODEL_UNAVAILABLE") | (F.col("quality_status") == "unavailable"), "abstain").otherwise("hold")
    return judged.select("entity", "as_of", "point", "upper", status.alias("status"), codes.alias("reason_codes"))


REPLAY_SQL = f"""
tr AS (SELECT count(*) AS n, avg(baseline) AS mx, stddev_samp(baseline) AS sx, avg(y) AS my, covar_samp(baseline, y) AS c,
  quantile_cont(baseline, {DOMAIN[0]}) AS low, quantile_cont(baseline, {DOMAIN[1]}) AS high FROM scored WHERE split = 'train'),
line AS (SELECT c * (n - 1) / (sx * sx * (n - 1 + {REPLAY_ALPHA})) AS slope, mx, my, low, high FROM tr),
half AS (SELECT y, my + slope * (baseline - mx) AS point, row_number() OVER (ORDER BY as_of, observation_id) AS pos, count(*) OVER () AS n
  FROM scored, line WHERE split = 'validation'),
shift AS (SELECT greatest(0, quantile_cont(y - point, 0.95)) AS shift FROM half WHERE pos > n // 2),
replay AS (SELECT h.entity, h.as_of, q.value AS baseline,
  CASE WHEN q.value IS NULL THEN 'FEATURES_UNAVAILABLE' WHEN q.value < low OR q.value > high THEN 'OUT_OF_DOMAIN' END AS code,
  my + slope * (q.value - mx) AS point, my + slope * (q.value - mx) + shift AS upper
  FROM hours h ASOF LEFT JOIN pak q ON q.entity = h.entity AND h.as_of >= q.measured_at, line, shift)"""


@query("interval_replay", with_views("hours pak scored", f"""
WITH {REPLAY_SQL}
SELECT entity, as_of, round(CASE WHEN code IS NULL THEN point END, 6) AS point, round(CASE WHEN code IS NULL THEN upper END, 6) AS upper,
  'abstain' AS status, concat_ws(',', code, CASE WHEN code IS NULL AND (baseline > {LIMIT} OR upper > {LIMIT}) THEN 'SULFUR_EXCEEDANCE_RISK' END,
  'ACTION_MODEL_UNAVAILABLE') AS reasons FROM replay"""))
def interval_replay(t):
    out = replayed(t).select("entity", "as_of", "point", "upper", "status", F.array_join("reason_codes", ",").alias("reasons"))
    return rounded(out, ("point", "upper"))


@query("interval_result_table", with_views("hours pak scored", f"""
WITH {REPLAY_SQL}
SELECT entity, as_of + INTERVAL 60 MINUTE AS target_at, round(CASE WHEN code IS NULL THEN point END, 6) AS point,
  round(CASE WHEN code IS NULL THEN upper END, 6) AS upper FROM replay"""))
def interval_result_table(t):
    """Chart rows of a replay: shifted by the horizon, missing values stay NULL, time order."""
    from assaylake.operators.cleanse import finite

    rows = rounded(replayed(t), ("point", "upper"))
    return rows.select("entity", (F.col("as_of") + F.expr("INTERVAL 60 MINUTES")).alias("target_at"),
                       finite(F.col("point")).alias("point"), finite(F.col("upper")).alias("upper")).orderBy("target_at", "entity")
