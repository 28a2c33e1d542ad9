"""Time splits, purged folds and training weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaylake.functions.timecols import civil_to_utc, minutes_between
from assaylake.operators.chunks import carry_forward


def boundary(day: str, zone: str = "UTC") -> Column:
    """Start of a civil day of the source zone as UTC wall clock."""
    return civil_to_utc(F.lit(day).cast("timestamp_ntz"), zone)


def outer_split(train_end: str, validation_end: str, zone: str = "UTC") -> Column:
    """train / validation / test by decision time; labels published across a boundary are purged (NULL)."""
    a, b = boundary(train_end, zone), boundary(validation_end, zone)
    as_of, target, available = F.col("as_of"), F.col("target_at"), F.col("target_available_at")
    return (
        F.when((as_of < a) & (target < a) & (available < a), "train")
        .when((as_of >= a) & (as_of < b) & (target < b) & (available < b), "validation")
        .when(as_of >= b, "test")
    )


def horizon_violations(frame: DataFrame, minutes: int) -> DataFrame:
    gap = minutes_between("target_at", "as_of")
    return frame.agg(F.count_if(F.abs(gap - minutes) > 1e-9).alias("violations"), F.count("*").alias("n"))


def time_blocks(frame: DataFrame, n_blocks: int) -> DataFrame:
    """Distinct decision times cut into equal runs, larger runs first.

    The position of a time is a running count carried over chunks, so no task sorts them all.
    """
    times = frame.select("as_of").distinct().withColumn("_all", F.lit(0))
    placed = carry_forward(times, ["_all"], "as_of", [], {"_pos": ("sum", F.lit(1).cast("long"))})
    n = times.agg(F.count("*").alias("n")).first()["n"]
    big, rest = divmod(n, n_blocks)
    edge = rest * (big + 1)
    pos = F.col("_pos") - 1
    block = F.when(pos < edge, F.floor(pos / F.lit(big + 1))).otherwise(
        F.lit(rest) + F.floor((pos - edge) / F.lit(max(big, 1)))
    )
    return placed.select("as_of", block.cast("int").alias("block"))


def expanding_folds(frame: DataFrame, n_splits: int = 3) -> DataFrame:
    """Long table (fold, role, row): expanding training part purged at each validation start."""
    blocks = time_blocks(frame, n_splits + 1)
    # One row per fold: at most ``n_splits`` rows, so its array travels with every row.
    starts = blocks.filter(F.col("block") > 0).groupBy("block").agg(F.min("as_of").alias("start"))
    edges = [(r["block"], r["start"]) for r in starts.orderBy("block").collect()]
    located = frame.join(blocks, "as_of")
    arms = []
    for fold, start in edges:
        s = F.lit(start).cast("timestamp_ntz")
        purged = (F.col("as_of") < s) & (F.col("target_at") < s) & (F.col("target_available_at") < s)
        arms.append(
            F.when(F.col("block") == fold, F.struct(F.lit(fold).alias("fold"), F.lit("validation").alias("role")))
            .when(purged, F.struct(F.lit(fold).alias("fold"), F.lit("train").alias("role")))
        )
    return located.select(
        *frame.columns, F.explode(F.array_compact(F.array(*arms))).alias("_f")
    ).select(*frame.columns, "_f.fold", "_f.role")


def rolling_folds(frame: DataFrame, start: str, end: str, step: str = "1 MONTH") -> DataFrame:
    """Folds starting every ``step`` in [start, end), purged by publication time (UTC dates)."""
    begin, stop = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    width = F.expr(f"INTERVAL {step}")
    starts = F.filter(F.sequence(begin, stop, width), lambda s: s < stop)
    located = frame.select("*", F.explode(starts).alias("fold_start"))
    train = (F.col("as_of") < F.col("fold_start")) & (F.col("target_available_at") < F.col("fold_start"))
    inside = (F.col("as_of") >= F.col("fold_start")) & (F.col("as_of") < F.col("fold_start") + width)
    return located.select(
        *frame.columns, "fold_start", F.when(train, "train").when(inside, "validation").alias("role")
    ).filter(F.col("role").isNotNull())


def episode_weights(frame: DataFrame, period: str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Each positive episode weighs the same, then each period, then the mean is one.

    Only the table of periods is scanned as a whole; it has one row per calendar period.
    """
    positive = F.col("crossing_60m")
    sizes = frame.filter(positive).groupBy(*keys, "event_id").agg(F.count("*").alias("_size"))
    shared = frame.join(sizes, [*keys, "event_id"], "left").withColumn(
        "_share", F.when(positive, 1.0 / F.col("_size"))
    )
    whole = Window.partitionBy()
    periods = shared.groupBy(period).agg(
        F.count("*").alias("_n"),
        F.count_if(~positive).alias("_neg"),
        F.count_if(positive).alias("_pos"),
        F.coalesce(F.sum("_share"), F.lit(0.0)).alias("_mass"),
    )
    scale = F.sum("_pos").over(whole) / F.nullif(F.sum("_mass").over(whole), F.lit(0.0))
    periods = periods.select(
        period,
        F.coalesce(scale, F.lit(1.0)).alias("_scale"),
        (F.col("_neg") + F.coalesce(scale, F.lit(1.0)) * F.col("_mass")).alias("_period_mass"),
        (F.sum("_n").over(whole) / F.count("*").over(whole)).alias("_mean"),
    )
    weight = F.when(positive, F.col("_share") * F.col("_scale")).otherwise(F.lit(1.0))
    return shared.join(periods, period).select(
        *frame.columns, (weight / F.col("_period_mass") * F.col("_mean")).alias("weight")
    )


def cap_training_rows(frame: DataFrame, cap: int, row_id: str, positive: Column, seed: int) -> DataFrame:
    """A seeded training sample of at most ``cap`` rows that keeps positives first.

    This bound is the reference feature itself (an exploration budget).  Rows are ranked by a salted
    hash; the cut-off is found on a 4096-cell histogram of that hash, so nothing is sorted globally.
    """
    if cap <= 0:
        return frame
    hashed = frame.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)) / F.lit(2.0**64) + 0.5).withColumn(
        "_rank", F.col("_h") + F.when(positive, 0.0).otherwise(1.0)
    )
    cells = hashed.groupBy(F.floor(F.col("_rank") * 2048).cast("long").alias("_cell")).count()
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = cells.select("_cell", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    tagged = hashed.withColumn("_cell", F.floor(F.col("_rank") * 2048).cast("long")).join(cut, "_cell")
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_rank", row_id))
    # Only the cell that holds the cut-off needs an order inside it.
    return (
        tagged.filter(F.col("_before") < cap)
        .withColumn("_pos", F.col("_before") + inside)
        .filter(F.col("_pos") <= cap)
        .select(*frame.columns)
    )
