"""Forecast, alarm and episode metrics: aggregates only, no row leaves the executors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.timecols import minutes_between
from assaylake.operators.chunks import carry_forward


def ratio(a: Column, b: Column) -> Column:
    """A zero denominator gives NULL."""
    return F.try_divide(a.cast("double"), b)


def lead_window(as_of: str, start: str) -> Column:
    """The row lies 10 to 60 minutes before its episode starts."""
    gap = minutes_between(start, as_of)
    return F.coalesce((gap >= 10) & (gap <= 60), F.lit(False))


def regression_columns(
    y: Column, p: Column, *, limit: float, near: tuple[float, float]
) -> list[Column]:
    """Error overall and near the limit; misses and false alarms of ``p > limit`` (strict)."""
    error = F.abs(y - p)
    inside = (y >= near[0]) & (y <= near[1])
    over, alarm = y > limit, p > limit
    return [
        F.count("*").alias("n"),
        F.avg(error).alias("mae"),
        F.count_if(inside).alias("near_n"),
        F.avg(F.when(inside, error)).alias("near_mae"),
        F.count_if(over & ~alarm).alias("missed"),
        F.count_if(over).alias("exceedances"),
        ratio(F.count_if(over & ~alarm), F.count_if(over)).alias("missed_rate"),
        F.count_if(~over & alarm).alias("false_alarms"),
        F.count_if(~over).alias("non_exceedances"),
        ratio(F.count_if(~over & alarm), F.count_if(~over)).alias("false_alarm_rate"),
    ]


def slice_metrics(
    df: DataFrame, slices: Sequence[str], y: Column, p: Column, *, limit: float, near: tuple[float, float]
) -> DataFrame:
    """The same figures for each value of each slice column, in one pass of grouping sets."""
    cols = [F.col(s) for s in slices]
    grouped = df.select(*cols, y.alias("_y"), p.alias("_p")).groupingSets([[c] for c in cols], *cols)
    figures = regression_columns(F.col("_y"), F.col("_p"), limit=limit, near=near)
    which = [F.grouping(s).alias(f"_g_{s}") for s in slices]
    out = grouped.agg(*figures, *which)
    name = F.coalesce(*[F.when(F.col(f"_g_{s}") == 0, F.lit(s)) for s in slices])
    value = F.coalesce(*[F.when(F.col(f"_g_{s}") == 0, F.col(s).cast("string")) for s in slices])
    drop = {*slices, *[f"_g_{s}" for s in slices]}
    return out.select(name.alias("slice"), value.alias("value"), *[c for c in out.columns if c not in drop])


def alarm_columns(actual: Column, p: Column, threshold: float) -> list[Column]:
    alarm = p >= threshold
    tp, fp = F.count_if(actual & alarm), F.count_if(~actual & alarm)
    return [
        F.count("*").alias("n"),
        F.count_if(actual).alias("positives"),
        F.count_if(actual & ~alarm).alias("false_negatives"),
        ratio(F.count_if(actual & ~alarm), F.count_if(actual)).alias("false_negative_rate"),
        fp.alias("false_positives"),
        ratio(fp, F.count_if(~actual)).alias("false_positive_rate"),
        ratio(tp, tp + fp).alias("precision"),
        F.avg((p - actual.cast("double")) ** 2).alias("brier"),
    ]


def score_curve(df: DataFrame, score: Column, actual: Column) -> DataFrame:
    """Per distinct score, from the top: cumulative true and false positives, ties together.

    Scores lie in [0, 1]; the axis is cut into 1024 chunks and the totals of higher chunks are
    carried in, so the curve of any number of scores is built in parallel.
    """
    counts = (
        df.select(score.alias("score"), actual.alias("_a")).filter(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.count_if("_a").alias("pos"), F.count_if(~F.col("_a")).alias("neg"))
        .withColumn("_all", F.lit(0))
        .withColumn("_chunk", F.floor(F.col("score") * 1024).cast("long"))
    )
    return carry_forward(
        counts, ["_all"], "score", [],
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, backwards=True,
    ).drop("_all")


def average_precision(df: DataFrame, score: Column, actual: Column) -> DataFrame:
    """Sum over score ties of (gain in recall) x precision."""
    curve = score_curve(df, score, actual)
    step = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.agg(ratio(F.sum(step), F.sum("pos")).alias("average_precision"))


def alarm_threshold(df: DataFrame, score: Column, actual: Column, budget: float = 0.20) -> DataFrame:
    """The score with the fewest misses whose false-positive rate stays within the budget."""
    curve = score_curve(df, score, actual)
    # The totals ride along as the largest cumulative counts: one small row.
    totals = df.agg(F.count_if(actual & score.isNotNull()).alias("P"),
                    F.count_if(~actual & score.isNotNull()).alias("N")).first()
    positives, negatives = totals["P"], totals["N"]
    if not positives or not negatives:
        raise ValueError("threshold selection needs both classes")
    fnr = (F.lit(positives) - F.col("tp")) / F.lit(float(positives))
    fpr = F.col("fp") / F.lit(float(negatives))
    return (
        curve.select("score", "tp", "fp", fnr.alias("fnr"), fpr.alias("fpr"))
        .filter(F.col("fpr") <= budget + 1e-12)
        .agg(F.min_by(F.struct("score", "fnr", "fpr"), F.struct(F.col("fnr"), -F.col("score"))).alias("_b"))
        .select(
            F.col("_b.score").alias("threshold"), F.col("_b.fnr").alias("false_negative_rate"),
            F.col("_b.fpr").alias("false_positive_rate"),
        )
    )


def pinball(y: Column, q: Column, level: float) -> Column:
    r = y - q
    return F.avg(F.greatest(level * r, (level - 1.0) * r))


def upper_columns(y: Column, point: Column, upper: Column) -> list[Column]:
    """Coverage and width; an upper bound below the point is an error, not a number."""
    bad = F.count_if(upper < point)
    checked = F.when(bad > 0, F.raise_error(F.lit("upper bound below point")).cast("double"))
    return [
        F.coalesce(checked, F.avg((y <= upper).cast("double"))).alias("coverage"),
        F.avg(upper - point).alias("average_width"),
        F.count("*").alias("n"),
    ]


def upper_limit_columns(y: Column, upper: Column, limit: float) -> list[Column]:
    over, alarm = y > limit, upper > limit
    known = y.isNotNull() & upper.isNotNull()
    misses = F.count_if(known & over & ~alarm)
    return [
        misses.alias("upper_limit_misses"),
        ratio(misses, F.count_if(known & over)).alias("upper_limit_miss_rate"),
        ratio(F.count_if(known & ~over & alarm), F.count_if(known & ~over)).alias("upper_limit_false_alarm_rate"),
    ]


def event_metrics(
    frame: DataFrame,
    *,
    threshold: float,
    limit: float,
    group: str | None = None,
    score: str = "p",
    actual: str = "crossing_60m",
    keys: Sequence[str] = ("entity",),
) -> DataFrame:
    """Episodes counted once, false alarms counted per hour of opportunity, and row rates.

    An episode is detected when any of its rows alarms 10 to 60 minutes before its start.
    """
    g = group or "_all"
    keys = list(keys)
    base = frame if group else frame.withColumn("_all", F.lit("all"))
    now = F.col("baseline")
    alarm = F.coalesce(F.col(score) >= threshold, F.lit(False)) | F.coalesce(now > limit, F.lit(False))
    rows = base.withColumn("_actual", F.coalesce(F.col(actual), F.lit(False))).withColumn("_alarm", alarm)
    lead = (
        F.col("_alarm") & lead_window("as_of", "event_start_at")
        if "event_start_at" in frame.columns else F.col("_alarm")
    )
    events = (
        rows.filter(F.col("event_id").isNotNull())
        .groupBy(g, *keys, "event_id")
        .agg(F.bool_or("_actual").alias("_counts"), F.bool_or(lead).alias("_hit"))
        .filter("_counts")
        .groupBy(g)
        .agg(F.count("*").alias("event_count"), F.count_if("_hit").alias("detected_events"))
    )
    negative = ~F.col("_actual") & (now <= limit)
    hours = (
        rows.filter(negative)
        .groupBy(g, *keys, F.date_trunc("hour", "as_of").alias("_hour"))
        .agg(F.bool_or("_alarm").alias("_false"))
        .groupBy(g)
        .agg(F.count_if("_false").alias("false_alarm_opportunities"), F.count("*").alias("negative_opportunities"))
    )
    plain = rows.groupBy(g).agg(
        ratio(F.count_if(negative & F.col("_alarm")), F.count_if(negative)).alias("row_false_positive_rate"),
        F.count_if(F.col("_actual") & ~F.col("_alarm")).alias("row_false_negatives"),
        ratio(F.count_if(F.col("_actual") & ~F.col("_alarm")), F.count_if("_actual")).alias("row_false_negative_rate"),
        F.avg((F.col(score) - F.col("_actual").cast("double")) ** 2).alias("brier"),
    )
    zero = F.lit(0).cast("long")
    # One row per group from each: put together by an aggregate, which needs no join where there is one group.
    stacked = plain.unionByName(events, allowMissingColumns=True).unionByName(hours, allowMissingColumns=True)
    out = stacked.groupBy(g).agg(*[F.max(c).alias(c) for c in stacked.columns if c != g]).select(
        g,
        F.coalesce("event_count", zero).alias("event_count"),
        F.coalesce("detected_events", zero).alias("detected_events"),
        (1.0 - ratio(F.col("detected_events"), F.col("event_count"))).alias("event_false_negative_rate"),
        F.coalesce("false_alarm_opportunities", zero).alias("false_alarm_opportunities"),
        F.coalesce("negative_opportunities", zero).alias("negative_opportunities"),
        ratio(F.col("false_alarm_opportunities"), F.col("negative_opportunities")).alias("event_false_positive_rate"),
        "row_false_positive_rate", "row_false_negatives", "row_false_negative_rate", "brier",
    )
    return out if group else out.drop("_all")


def lead_time_report(
    frame: DataFrame, *, threshold: float, limit: float, horizons: Sequence[int] = (10, 20, 30, 60)
) -> DataFrame:
    """Event metrics with the label of each horizon in turn, as one grouped pass."""
    tall = frame.select(
        *[c for c in frame.columns if not c.startswith("crossing_")],
        F.explode(F.array(*[
            F.struct(F.lit(f"{h}m").alias("horizon"), F.col(f"crossing_{h}m").alias("crossing_60m")) for h in horizons
        ])).alias("_h"),
    ).select("*", "_h.horizon", "_h.crossing_60m").drop("_h")
    return event_metrics(tall, threshold=threshold, limit=limit, group="horizon")


def bootstrap_event_fnr(metrics: DataFrame, *, samples: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of the episode miss rate.

    Drawing n of n episodes with replacement and counting the detected ones is a binomial draw, so a
    sample needs the two counts and not the episodes.
    """
    draws = metrics.select(
        F.col("event_count").alias("n"), F.col("detected_events").alias("d"),
        F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"),
    ).filter(F.col("n") > 0)

    def resample(batches):
        for b in batches:
            yield pd.DataFrame({
                "fnr": [
                    1.0 - np.random.default_rng([seed, int(s)]).binomial(int(n), d / n) / n
                    for s, n, d in zip(b["sample"], b["n"], b["d"])
                ]
            })

    drawn = draws.mapInPandas(resample, "fnr double")
    # ``samples`` values in one group: the size is a parameter, not the data.
    return drawn.agg(
        F.percentile("fnr", 0.025).alias("lower"), F.percentile("fnr", 0.975).alias("upper"),
        F.count("*").alias("samples"),
    )


def guarded_corr(x: str, y: str, minimum: int) -> Column:
    """Correlation, NULL when there are too few pairs or either side does not vary."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when((F.count_if(pair) >= minimum) & varies, F.corr(xs, ys))


def drift_columns(y: Column, now: Column, limit: float) -> list[Column]:
    known = y.isNotNull() & now.isNotNull()
    a, b = F.when(known, y), F.when(known, now)
    moved = known & (now <= limit) & (y > limit)
    return [
        F.count(a).alias("n"),
        F.avg(a).alias("target_mean"),
        F.stddev_pop(a).alias("target_std"),
        F.avg((a > limit).cast("double")).alias("exceedance_rate"),
        ratio(F.count_if(moved), F.count(a)).alias("transition_rate"),
        F.count_if(moved).alias("transition_count"),
        F.avg(F.abs(a - b)).alias("persistence_mae"),
        F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(b, a)).alias("current_future_correlation"),
    ]


def residual_screen(
    tall: DataFrame, *, name: str, value: str, residual: str, top_n: int, minimum: int = 100
) -> DataFrame:
    """Strongest train correlations with the residual and whether their sign survives later periods."""
    per = tall.filter(F.col("split").isNotNull()).groupBy(name, "split").agg(
        F.count_if(F.col(value).isNotNull() & F.col(residual).isNotNull()).alias("n"),
        guarded_corr(value, residual, minimum).alias("correlation"),
    )
    parts = ("train", "validation", "test")
    wide = per.groupBy(name).agg(*[
        x for s in parts for x in (
            F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_n"),
            F.max(F.when(F.col("split") == s, F.col("correlation"))).alias(f"{s}_correlation"),
        )
    ])
    sign = [F.signum(f"{s}_correlation") for s in parts]
    stable = F.coalesce((sign[0] == sign[1]) & (sign[1] == sign[2]), F.lit(False))
    return (
        wide.filter(F.col("train_correlation").isNotNull())
        .withColumn("stable_sign", stable)
        .orderBy(F.abs(F.col("train_correlation")).desc(), name)
        .limit(top_n)
    )
