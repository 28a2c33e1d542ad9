"""Replay of a period: decide at every step, then count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def summary(decisions: DataFrame) -> DataFrame:
    """Status counts, reason counts and the number of points as one tall table, in one pass."""
    kinds = F.concat(
        F.array(
            F.struct(F.lit("status").alias("kind"), F.col("status").alias("code")),
            F.struct(F.lit("points").alias("kind"), F.lit("all").alias("code")),
        ),
        F.transform("reason_codes", lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("code"))),
    )
    return decisions.select(F.explode(kinds).alias("_k")).groupBy("_k.kind", "_k.code").agg(F.count("*").alias("n"))
