"""Whether a row lies inside the domain a model was trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assaylake.operators.quantiles import exact_quantiles


def feature_bounds(train: DataFrame, names: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Training quantiles per feature, exact."""
    tall = train.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names
    ])).alias("_f")).select("_f.feature", "_f.x")
    return exact_quantiles(tall, ["feature"], F.col("x"), {"lower": low, "upper": high}).select("feature", "lower", "upper")


def check_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Missing features first, then features outside their bounds; names sorted.

    The bounds are one row per model feature, so they are fitted parameters: they come to the driver
    once and enter the rows as literals, which keeps the check free of a join.
    """
    fitted = {r["feature"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in fitted])))
    outside = F.array_sort(F.array_compact(F.array(*[
        F.when((F.col(n) < lo) | (F.col(n) > hi), F.lit(n)) for n, (lo, hi) in fitted.items()
    ])))
    reason = F.when(F.size(missing) > 0, "FEATURES_UNAVAILABLE").when(F.size(outside) > 0, "OUT_OF_DOMAIN")
    return rows.select(
        "*", reason.alias("reason_code"),
        F.when(F.size(missing) > 0, missing).otherwise(outside).alias("violations"),
    )
