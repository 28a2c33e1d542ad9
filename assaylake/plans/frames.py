"""Shared frames of the catalog: persistence forecasts and labelled episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaylake.functions.timecols import plus_minutes
from assaylake.operators.asof import asof, asof_published
from assaylake.operators.chunks import GRID
from assaylake.operators.splits import outer_split
from assaylake.session import materialise
from assaylake.sources.adapters import TRAIN_END, VALIDATION_END, analyser


def persistence(t) -> DataFrame:
    """Every valid target with the value known 60 minutes earlier."""
    series = analyser(t)
    asks = series.select(
        "entity", "observation_id", plus_minutes("measured_at", -60).alias("as_of"),
        F.col("measured_at").alias("target_at"), F.col("available_at").alias("target_available_at"),
        F.col("value").alias("y"),
    )
    return asof_published(asks, series, keys=["entity"], query_ts="as_of").withColumnRenamed("last_value", "baseline")


def alarm_score(baseline) -> "F.Column":
    return F.round(1.0 / (1.0 + F.exp(-(baseline - 60.0) / 20.0)), 2)


def scored(t) -> DataFrame:
    b = F.col("baseline")
    point = b * 0.5 + 20.0
    return persistence(t).filter(b.isNotNull()).select(
        "*",
        outer_split(TRAIN_END, VALIDATION_END).alias("split"),
        alarm_score(b).alias("p"),
        point.alias("point"),
        F.greatest(point, b * 0.9 + 35.0).alias("upper"),
    )


def scored_episodes(t) -> DataFrame:
    from assaylake.plans.catalog_windows import labels
    from assaylake.sources.adapters import analyser_grid

    known = asof(
        materialise(labels(t), "labels"), analyser_grid(t), keys=["entity"], query_ts="as_of",
        event_ts="measured_at", take=["value"], prefix="_now_", chunking=GRID,
    ).withColumnRenamed("_now_value", "baseline").drop("_now_measured_at")
    return materialise(known.withColumn("p", alarm_score(F.col("baseline"))), "scored-episodes")
