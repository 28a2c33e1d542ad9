"""Exact nearest-neighbour matching without comparing every pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.session import materialise

COARSE = tuple(range(-3, 7))
TOP = 99


def _cells(x: Sequence[Column], edge: Column) -> list[Column]:
    return [F.floor(v / edge).cast("long") for v in x]


def nearest_match(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    dims: Sequence[str],
    left_id: str,
    right_id: str,
    hash_dims: int = 3,
) -> DataFrame:
    """(by, left_id, right_id, distance): the nearest right row of the same group, ties to the lower id.

    1. Both sides are laid on grids of several cell sizes; one representative per cell gives each left
       row some neighbour, hence an upper bound of its distance.
    2. The bound fixes a cell size at which the ball around the left row touches at most two cells per
       axis; only right rows of those cells are compared.

    Equal right states are reduced to one row first, so copies cost nothing.  Sizes are powers of two
    between fixed ends, so the number of grids is a constant.
    """
    by, dims = list(by), list(dims)
    states = right.groupBy(*by, *dims).agg(F.min(right_id).alias(right_id))
    states = materialise(states, "match-states")
    point = lambda p, names: [F.col(f"{p}{n}") for n in names]

    def laid(df: DataFrame) -> DataFrame:
        levels = F.explode(F.array(*[F.lit(k) for k in (*COARSE, TOP)]))
        placed = df.withColumn("_level", levels)
        edge = F.pow(F.lit(2.0), F.col("_level").cast("double"))
        top = F.col("_level") == TOP
        return placed.select(
            "*", *[F.when(top, F.lit(0).cast("long")).otherwise(c).alias(f"_c{i}")
                   for i, c in enumerate(_cells([F.col(d) for d in dims], edge))])

    cell = ["_level", *[f"_c{i}" for i in range(len(dims))]]
    reps = laid(states).groupBy(*by, *cell).agg(F.min_by(F.struct(*dims), F.col(right_id)).alias("_r"))
    near = laid(left.select(*by, left_id, *dims)).join(reps, [*by, *cell])
    gap = sum((F.col(d) - F.col(f"_r.{d}")) ** 2 for d in dims)
    bounded = near.groupBy(*by, left_id, *dims).agg(F.sqrt(F.min(gap)).alias("_ub"))
    level = F.greatest(F.lit(-20), F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.col("_ub") * 2.000001, F.lit(1e-9))))))
    asked = materialise(bounded.withColumn("_l", level.cast("int")), "match-bounds")
    # At most 51 sizes exist; the ones in use come back as plain numbers.
    used = [r["_l"] for r in asked.select("_l").distinct().collect()]
    if not used:
        return asked.select(*by, left_id, F.lit(None).cast(dict(states.dtypes)[right_id]).alias(right_id), F.lit(None).cast("double").alias("distance"))
    axes = dims[:hash_dims]
    edge = F.pow(F.lit(2.0), F.col("_l").cast("double"))
    reach = F.col("_ub") * 1.000001 + 1e-12
    probes = asked
    for i, d in enumerate(axes):
        probes = probes.withColumn(
            f"_k{i}", F.explode(F.sequence(
                F.floor((F.col(d) - reach) / edge).cast("long"), F.floor((F.col(d) + reach) / edge).cast("long"))))
    key = ["_l", *[f"_k{i}" for i in range(len(axes))]]
    targets = states.withColumn("_l", F.explode(F.array(*[F.lit(int(k)) for k in used])))
    targets = targets.select(
        *by, right_id, *[F.col(d).alias(f"_s_{d}") for d in dims], "_l",
        *[c.alias(f"_k{i}") for i, c in enumerate(_cells([F.col(d) for d in axes], edge))])
    exact = F.sqrt(sum((F.col(d) - F.col(f"_s_{d}")) ** 2 for d in dims))
    pairs = probes.join(targets, [*by, *key]).withColumn("_dist", exact).filter(F.col("_dist") <= reach)
    best = F.min(F.struct(F.col("_dist").alias("distance"), F.col(right_id).alias("id")))
    return pairs.groupBy(*by, left_id).agg(best.alias("_b")).select(
        *by, left_id, F.col("_b.id").alias(right_id), F.col("_b.distance").alias("distance"))
