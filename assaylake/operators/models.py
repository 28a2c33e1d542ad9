"""Forecast, upper-bound, risk and applicability models on MLlib.

The driver loops over a handful of candidates; every fit and score runs on distributed rows.  Inputs
are written once (``materialise``) because each fit passes over them several times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.scalars import logit
from assaylake.operators import metrics as m
from assaylake.operators.quantile_trees import ROUNDS, QuantileTrees, fit_quantile_trees
from assaylake.operators.quantiles import exact_quantiles
from assaylake.operators.series import half_split
from assaylake.operators.splits import expanding_folds, rolling_folds
from assaylake.session import materialise

# Fixed values - candidate settings of the model search.
RIDGE_ALPHAS = (0.1, 1.0, 10.0)
POSITIVE_WEIGHTS = (1.0, 2.0, 5.0, 10.0, 20.0)
COMPLEXITY = {"last_value": 0, "ridge": 1, "boosted": 2}
BOOSTED = ({"maxIter": 100, "maxDepth": 3}, {"maxIter": 200, "maxDepth": 4})
BOOSTING_ROUNDS = 100


def _prepared(names: Sequence[str], scale: bool = True) -> list:
    filled = [f"_f_{i}" for i, _ in enumerate(names)]
    stages = [
        Imputer(inputCols=list(names), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "_x", handleInvalid="keep"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True))
    return stages


def _drop_work(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = [f"_f_{i}" for i, _ in enumerate(names)] + ["_raw", "_x", "rawPrediction", "probability", "_z"]
    return df.drop(*gone)


def usable_features(train: DataFrame, names: Sequence[str]) -> list[str]:
    """Features missing in every training row are left out."""
    counts = train.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if counts[n]]


def fit_regression(train: DataFrame, names: Sequence[str], label: str, family: str, **setting) -> PipelineModel:
    rows = train.filter(F.col(label).isNotNull())
    if family == "boosted":
        model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_p", seed=42, **setting)
        return Pipeline(stages=[*_prepared(names, scale=False), model]).fit(rows)
    # A penalty on the sum of squares becomes alpha / n on the mean.  For squared errors MLlib divides it by the label's
    # deviation, which is put back here.
    loss = setting.get("loss", "squaredError")
    size = rows.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("spread")).first()
    scale = size["spread"] or 1.0 if loss == "squaredError" else 1.0
    model = LinearRegression(
        featuresCol="_x", labelCol=label, predictionCol="_p", elasticNetParam=0.0, loss=loss,
        regParam=setting.get("alpha", 1.0) * scale / max(size["n"], 1), maxIter=setting.get("maxIter", 100), standardization=False,
    )
    return Pipeline(stages=[*_prepared(names), model]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    return _drop_work(model.transform(rows), names).withColumnRenamed("_p", out)


def _figures(rows: DataFrame, p: str, limit: float) -> dict:
    y = F.col("y")
    r = rows.agg(
        F.avg(F.abs(y - F.col(p))).alias("mae"),
        F.count_if((y > limit) & (F.col(p) <= limit)).alias("missed"),
        F.count_if((y > limit) & (F.col("baseline") <= limit)).alias("base_missed"),
    ).first()
    return {"mae": r["mae"], "missed": r["missed"], "base_missed": r["base_missed"]}


def argmin_model(comparison: DataFrame) -> DataFrame:
    """No more misses than the last value, then the smallest error, then the simplest family.

    ``comparison`` has one row per model family.
    """
    base = comparison.filter(F.col("model") == "last_value").agg(F.max("missed").alias("allowed")).first()["allowed"]
    fit = comparison.filter(F.col("missed") <= F.lit(base))
    key = F.struct(F.round("mae", 12), F.col("complexity"))
    return fit.agg(F.min_by("model", key).alias("model"), F.min("mae").alias("mae"), F.count("*").alias("eligible"))


@dataclass
class PointModel:
    family: str
    names: list[str]
    fitted: PipelineModel | None
    comparison: list[dict]

    def score(self, rows: DataFrame, out: str = "point") -> DataFrame:
        if self.fitted is None:
            return rows.withColumn(out, F.col("baseline"))
        return predict(self.fitted, rows, self.names, out)


def train_point_model(
    frame: DataFrame, names: Sequence[str], *, limit: float, boosted: Sequence[dict] = BOOSTED,
    alphas: Sequence[float] = RIDGE_ALPHAS, n_splits: int = 3,
) -> PointModel:
    """Tune each family on purged folds of train, compare on validation, refit the winner on both."""
    rows = materialise(frame.filter(F.col("baseline").isNotNull() & F.col("split").isin("train", "validation")), "point-train")
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    kept = usable_features(train, names)
    folded = materialise(expanding_folds(train, n_splits), "point-folds")
    folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]

    def tuned(family: str, settings: Sequence[dict]) -> dict:
        scored = []
        for setting in settings:
            parts = []
            for k in folds:
                one = folded.filter(F.col("fold") == k)
                model = fit_regression(one.filter("role = 'train'"), kept, "y", family, **setting)
                parts.append(predict(model, one.filter("role = 'validation'"), kept, "_s").select("y", "baseline", "_s"))
            scored.append((setting, _figures(reduce(DataFrame.unionByName, parts), "_s", limit)))
        fair = [s for s in scored if s[1]["missed"] <= s[1]["base_missed"]]
        pool = fair or scored
        return min(pool, key=lambda s: (0 if fair else s[1]["missed"], s[1]["mae"], repr(sorted(s[0].items()))))[0]

    chosen = {"ridge": tuned("ridge", [{"alpha": a} for a in alphas]), "boosted": tuned("boosted", list(boosted))}
    compared = [{"model": "last_value", **_figures(validation, "baseline", limit)}]
    for family, setting in chosen.items():
        model = fit_regression(train, kept, "y", family, **setting)
        compared.append({"model": family, **_figures(predict(model, validation, kept, "_s"), "_s", limit)})
    for row in compared:
        row["complexity"] = COMPLEXITY[row["model"]]
    table = frame.sparkSession.createDataFrame(
        [(r["model"], float(r["mae"]), int(r["missed"]), r["complexity"]) for r in compared],
        "model string, mae double, missed long, complexity int")
    winner = argmin_model(table).first()["model"] or "last_value"
    final = None if winner == "last_value" else fit_regression(rows, kept, "y", winner, **chosen[winner])
    return PointModel(winner, kept, final, compared)


def bucket_upper(train: DataFrame, buckets: int, level: float = 0.95, point: str = "point") -> Column:
    """Raw upper estimate: the residual quantile of the point's own prediction bucket.

    MLlib has no quantile loss; a step function of the prediction fitted by exact quantiles takes its
    place.  The fitted steps are ``buckets`` numbers, so they enter the rows as literals.
    """
    probs = {f"q{i}": i / buckets for i in range(1, buckets)}
    row = exact_quantiles(train, [], F.col(point), probs).first()
    edges = sorted({row[f"q{i}"] for i in range(1, buckets)}) if buckets > 1 else []
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col(point) >= e, 1).otherwise(0)
    fitted = {
        r["_bucket"]: r["q"] for r in exact_quantiles(
            train.withColumn("_bucket", bucket), ["_bucket"], F.col("y") - F.col(point), {"q": level}).collect()
    }
    worst = max(fitted.values())
    lift = F.lit(float(worst))
    for k, q in fitted.items():
        lift = F.when(bucket == k, F.lit(float(q))).otherwise(lift)
    return F.col(point) + lift


def conformal_shift(rows: DataFrame, raw: str, level: float = 0.95) -> float:
    """Non-negative correction that restores coverage on the calibration half."""
    q = exact_quantiles(rows, [], F.col("y") - F.col(raw), {"q": level}).first()
    return max(0.0, q["q"]) if q else 0.0


@dataclass
class UpperHead:
    """An upper estimate, never below the point: a quantile model, or without one the point itself, plus a shift."""

    model_id: str
    trees: QuantileTrees | None
    shift: float
    level: float = 0.95

    def score(self, rows: DataFrame, point: str = "point", out: str = "upper") -> DataFrame:
        if self.trees is None:
            return rows.withColumn(out, F.col(point) + F.lit(self.shift))
        raw = self.trees.score(rows, "_raw_upper")
        return raw.withColumn(out, F.greatest(F.col(point), F.col("_raw_upper") + F.lit(self.shift))).drop("_raw_upper")


def fit_upper_head(
    frame: DataFrame, names: Sequence[str], *, level: float = 0.95, leaves: Sequence[int] = (15, 31), rounds: int = ROUNDS,
    label: str = "y",
) -> UpperHead:
    """Quantile models on train, chosen on the first validation half by pinball loss, shifted on the second.

    ``frame`` has split, as_of, observation_id, the label and the features.  Test rows are not read.
    """
    rows = materialise(frame.filter(F.col(label).isNotNull() & F.col("split").isin("train", "validation")), "upper-rows")
    train = rows.filter("split = 'train'")
    kept = usable_features(train, names)
    fitted = {f"quantile_trees_{n}": fit_quantile_trees(train, kept, label, level=level, leaves=n, rounds=rounds) for n in leaves}
    scored = half_split(rows.filter("split = 'validation'"), ["as_of", "observation_id"])
    for name, trees in fitted.items():
        scored = trees.score(scored, name)
    scored = materialise(scored.select("half", F.col(label).alias("y"), *fitted), "upper-halves")
    losses = scored.filter("half = 1").agg(*[m.pinball(F.col("y"), F.col(k), level).alias(k) for k in fitted]).first()
    if any(losses[k] is None for k in fitted):
        raise ValueError("validation has too few rows to choose an upper model")
    best = min(fitted, key=lambda k: (losses[k], k))
    return UpperHead(best, fitted[best], conformal_shift(scored.filter("half = 2"), best, level), level)


@dataclass
class JointApplicability:
    """Squared distance in whitened principal-component space against a training quantile."""

    names: list[str]
    required: list[str]
    pipeline: PipelineModel
    inverse_variance: list[float]
    limit: float

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.pipeline.transform(rows)
        scale = F.array(*[F.lit(v) for v in self.inverse_variance])
        proj = F.slice(vector_to_array("_z"), 1, len(self.inverse_variance))
        d2 = F.aggregate(F.zip_with(proj, scale, lambda p, s: p * p * s), F.lit(0.0), lambda a, x: a + x)
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.required], F.lit(False))
        code = F.when(missing, "FEATURES_UNAVAILABLE").when(~(d2 <= self.limit), "OUT_OF_DOMAIN")
        return _drop_work(out.withColumn("distance_squared", d2).withColumn("applicability_code", code), self.names)


def fit_joint_applicability(
    train: DataFrame, names: Sequence[str], required: Sequence[str], coverage: float = 0.99, keep: float = 0.99
) -> JointApplicability:
    kept = usable_features(train, names)
    k = min(len(kept), 64)
    pipeline = Pipeline(stages=[*_prepared(kept), PCA(k=k, inputCol="_x", outputCol="_z")]).fit(train)
    ratio = np.asarray(pipeline.stages[-1].explainedVariance.toArray())
    count = int(np.searchsorted(np.cumsum(ratio), keep) + 1)
    arr = vector_to_array("_z")
    projected = pipeline.transform(train)
    # One variance per kept component.
    var = projected.agg(*[F.var_pop(arr[i]).alias(f"v{i}") for i in range(min(count, k))]).first()
    inverse = [1.0 / var[f"v{i}"] if var[f"v{i}"] else 0.0 for i in range(min(count, k))]
    draft = JointApplicability(kept, list(required), pipeline, inverse, math.inf)
    limit = exact_quantiles(draft.score(train), [], F.col("distance_squared"), {"q": coverage}).first()["q"]
    return JointApplicability(kept, list(required), pipeline, inverse, limit)


def fit_classifier(train: DataFrame, names: Sequence[str], label: str, family: str, weight: Column, **setting) -> PipelineModel:
    rows = train.withColumn("_w", weight).withColumn("_label", F.col(label).cast("double"))
    if family == "boosted":
        model = GBTClassifier(featuresCol="_x", labelCol="_label", weightCol="_w", predictionCol="_p", seed=42,
                              **{"maxIter": BOOSTING_ROUNDS, "maxDepth": 3, **setting})
        stages = [*_prepared(names, scale=False), model]
    else:
        model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", predictionCol="_p", maxIter=100)
        stages = [*_prepared(names), model]
    return Pipeline(stages=stages).fit(rows)


def probability(model: PipelineModel, rows: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    scored = model.transform(rows.drop("_w", "_label"))
    return _drop_work(scored.withColumn(out, vector_to_array("probability")[1]), names).drop("_p")


def fit_platt(rows: DataFrame, raw: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a sigmoid on the logit of the raw probability."""
    data = rows.select(logit(F.col(raw)).alias("_l"), F.col(label).cast("double").alias("_label"))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["_l"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_label", regParam=0.0, maxIter=100),
    ]).fit(data).stages[-1]
    return float(model.coefficients[0]), float(model.intercept)


def platt(raw: Column, fitted: tuple[float, float]) -> Column:
    return 1.0 / (1.0 + F.exp(-(logit(raw) * fitted[0] + fitted[1])))


@dataclass
class RiskModel:
    family: str
    positive_weight: float
    names: list[str]
    fitted: PipelineModel
    calibration: tuple[float, float]
    threshold: float
    candidates: list[dict]

    def score(self, rows: DataFrame, out: str = "p") -> DataFrame:
        raw = probability(self.fitted, rows, self.names, "_raw_p")
        return raw.withColumn(out, platt(F.col("_raw_p"), self.calibration)).drop("_raw_p")


def fit_risk_model(
    frame: DataFrame, names: Sequence[str], *, limit: float, budget: float = 0.20,
    families: Sequence[str] = ("logistic", "boosted"), weights: Sequence[float] = POSITIVE_WEIGHTS, n_splits: int = 3,
) -> RiskModel:
    """Weighted classifiers judged out of fold on train, calibrated and thresholded on validation halves."""
    rows = materialise(
        frame.filter(F.col("y").isNotNull() & F.col("baseline").isNotNull()).withColumn("over", F.col("y") > limit), "risk-rows")
    train = rows.filter("split = 'train'")
    kept = usable_features(train, names)
    folded = materialise(expanding_folds(train, n_splits), "risk-folds")
    folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    weigh = lambda w: F.when(F.col("over"), F.lit(float(w))).otherwise(1.0)
    found = []
    for family in families:
        for w in weights:
            parts = []
            for k in folds:
                one = folded.filter(F.col("fold") == k)
                model = fit_classifier(one.filter("role = 'train'"), kept, "over", family, weigh(w))
                parts.append(probability(model, one.filter("role = 'validation'"), kept, "_s").select("over", "_s"))
            oof = materialise(reduce(DataFrame.unionByName, parts), "risk-oof")
            best = m.alarm_threshold(oof, F.col("_s"), F.col("over"), budget).first()
            brier = oof.agg(F.avg((F.col("_s") - F.col("over").cast("double")) ** 2).alias("b")).first()["b"]
            fnr = best["false_negative_rate"]
            found.append({"family": family, "weight": float(w), "fnr": 1.0 if fnr is None else fnr, "brier": brier})
    order = {f: i for i, f in enumerate(families)}
    pick = min(found, key=lambda c: (c["fnr"], c["brier"], order[c["family"]], c["weight"]))
    model = fit_classifier(train, kept, "over", pick["family"], weigh(pick["weight"]))
    halves = half_split(rows.filter("split = 'validation'"), ["as_of", "observation_id"])
    scored = materialise(probability(model, halves, kept, "_raw_p").select("half", "over", "_raw_p"), "risk-halves")
    calibration = fit_platt(scored.filter("half = 1"), "_raw_p", "over")
    policy = scored.filter("half = 2").withColumn("_p2", platt(F.col("_raw_p"), calibration))
    threshold = m.alarm_threshold(policy, F.col("_p2"), F.col("over"), budget).first()["threshold"]
    return RiskModel(pick["family"], pick["weight"], kept, model, calibration, 1.0 if threshold is None else threshold, found)


def fit_lab_correction(frame: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> dict:
    """Residual of laboratory targets over the analyser forecast: ridge or huber, with an upper bound.

    ``frame`` has split, as_of, observation_id, y, pak_point (the fitted analyser model's forecast) and the features; promotion looks at validation only.
    """
    rows = materialise(frame.withColumn("residual", F.col("y") - F.col("pak_point")), "lab-rows")
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    kept = usable_features(train, names)
    models, errors = {}, {}
    for name, setting in (("ridge", {"alpha": 10.0}), ("huber", {"alpha": 1.0, "loss": "huber"})):
        models[name] = fit_regression(train, kept, "residual", "ridge", **setting)
        errors[name] = predict(models[name], validation, kept, "_s").agg(
            F.avg(F.abs(F.col("residual") - F.col("_s"))).alias("e")).first()["e"]
    best = min(errors, key=lambda k: (errors[k], k))
    corrected = predict(models[best], rows, kept, "_s").withColumn("point", F.col("pak_point") + F.col("_s")).drop("_s")
    head = fit_upper_head(rows, kept, leaves=(15,), rounds=rounds, label="residual")
    # The head bounds the residual, so it is compared on that scale and moved to the laboratory's.
    bounded = head.score(corrected.withColumn("_delta", F.col("point") - F.col("pak_point")), "_delta", "_over")
    judged = bounded.withColumn("upper", F.col("pak_point") + F.col("_over")).groupBy("split").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("pak_point"))).alias("pak_point_mae"),
        F.avg(F.abs(F.col("y") - F.col("point"))).alias("corrected_mae"),
        F.avg((F.col("y") <= F.col("upper")).cast("double")).alias("upper_coverage"),
        F.avg(F.col("upper") - F.col("point")).alias("upper_width"))
    judged = materialise(judged, "lab-judged")
    v = judged.filter("split = 'validation'").first()
    promoted = v["corrected_mae"] <= 0.95 * v["pak_point_mae"] and v["upper_coverage"] >= 0.95
    return {"selected": best, "errors": errors, "report": judged, "promotion_eligible": promoted}


def rolling_scores(
    frame: DataFrame, names: Sequence[str], family: str, start: str, end: str, *, step: str, horizons: Sequence[int],
    weight: str | None = "weight", cap: int | None = None, delta: bool = True,
    rounds: int = BOOSTING_ROUNDS, upper: bool = False,
) -> DataFrame:
    """Out-of-fold probabilities per horizon over rolling folds.

    With ``delta`` also the predicted change, with ``upper`` its upper estimate, both of the folds' own models.

    ``cap`` bounds the rows a *classifier* is fitted on, all positives first; the regression of the change sees all rows.
    ``rounds`` are the boosting rounds of the boosted family.
    """
    from assaylake.operators.splits import cap_training_rows

    folded = materialise(rolling_folds(frame, start, end, step), "rolling-folds")
    starts = [r["fold_start"] for r in folded.groupBy("fold_start").agg(
        F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "validation").alias("b"))
        .filter("a > 0 AND b > 0").orderBy("fold_start").collect()]
    parts = []
    for s in starts:
        one = folded.filter(F.col("fold_start") == F.lit(s).cast("timestamp_ntz"))
        train, score = one.filter("role = 'train'"), one.filter("role = 'validation'")
        labelled = train
        if cap:
            positive = reduce(lambda a, b: a | b, [F.col(f"crossing_{h}m") for h in horizons])
            labelled = cap_training_rows(train, cap, "row_id", positive, 42)
        w = F.col(weight) if weight else F.lit(1.0)
        for h in horizons:
            model = fit_classifier(labelled, names, f"crossing_{h}m", family, w, maxIter=rounds)
            score = probability(model, score, names, f"p_{h}m")
        if delta:
            reg = fit_regression(train, names, "delta_60m", "boosted" if family == "boosted" else "ridge",
                                 **({"maxIter": rounds, "maxDepth": 3} if family == "boosted" else {}))
            score = predict(reg, score, names, "predicted_delta")
        if upper:
            score = fit_quantile_trees(train, names, "delta_60m").score(score, "upper_delta")
        parts.append(score.drop("fold_start", "role"))
    if not parts:
        raise ValueError("rolling backtest produced no folds")
    out = reduce(DataFrame.unionByName, parts)
    top = [F.col(f"p_{h}m") for h in horizons]
    return materialise(out.withColumn("p", F.greatest(*top) if len(top) > 1 else top[0]), "rolling-scores")
