"""Cooldown: a change is dropped while the last *kept* change is younger than the limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assaylake.functions.timecols import minutes_between, plus_minutes
from assaylake.operators.asof import asof
from assaylake.operators.chunks import DEFAULT, Chunking, over_rows
from assaylake.session import materialise


def cooldown(changes: DataFrame, *, keys: Sequence[str], ts: str, minutes: int, chunking: Chunking = DEFAULT) -> DataFrame:
    """The (keys, ts) that survive.

    Each change points to the first change at least ``minutes`` later; the survivors are the chains
    that start where nothing precedes within the limit.  The chains are followed by doubling the
    pointer, so a series of any length takes log2(length) joins and never sits in one task.
    """
    keys = list(keys)
    points = materialise(changes.select(*keys, ts).distinct(), "cooldown-points")
    following = asof(
        points, points.withColumn("_next", F.col(ts)), keys=keys, query_ts=plus_minutes(ts, minutes), event_ts=ts,
        take=["_next"], direction="forward", prefix="n", chunking=chunking,
    ).select(*keys, ts, F.col("n_next").alias("_to")).filter(F.col("_to").isNotNull())
    jump = materialise(following, "cooldown-jump")
    gaps = over_rows(points, keys, ts, [], lambda w: {"_gap": minutes_between(ts, F.lag(ts).over(w))}, before=1, chunking=chunking)
    kept = materialise(gaps.filter(F.col("_gap").isNull() | (F.col("_gap") >= minutes)).select(*keys, ts), "cooldown-kept")
    while True:
        reached = kept.join(jump, [*keys, ts]).select(*keys, F.col("_to").alias(ts))
        kept = materialise(kept.unionByName(reached).distinct(), "cooldown-kept")
        further = jump.join(
            jump.select(*keys, F.col(ts).alias("_to"), F.col("_to").alias("_far")), [*keys, "_to"]
        ).select(*keys, ts, F.col("_far").alias("_to"))
        jump = materialise(further, "cooldown-jump")
        if jump.isEmpty():
            return kept
