"""Ordered computations that do not need one task per key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole series into one task.  One plant or one
signal may hold a third of the data, so every ordered operator here works on *chunks*: a chunk is a
(key, time bucket) group, and a bucket holding more than ``hot_rows`` rows is cut further.

* ``carry_forward``  - running last / max / sum over a whole series.  A small per-chunk summary is
  scanned once, and its result enters each chunk as one extra first row.  No join.
* ``over_rows``      - ROWS frames and lag/lead of bounded depth; the bordering rows of the
  neighbouring chunks are copied in as a halo.
* ``over_range``     - RANGE frames of bounded length; each row is also copied to the next bucket.

Every pass reads its input two or three times (summary or border, and the rows).  A chain of passes
over one another would multiply that, so composed operators write the intermediate table once
(``session.materialise``) and go on from the copy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaylake.functions.timecols import micros

MAX_PARTS = 1 << 20


@dataclass(frozen=True)
class Chunking:
    """``hot_rows=None`` skips the extra counting pass when the caller knows the rows are spread."""

    seconds: int = 86_400
    hot_rows: int | None = 5_000_000


DEFAULT = Chunking()
# A regular grid has a known number of rows per bucket, so nothing needs to be counted.
GRID = Chunking(hot_rows=None)


def assign_chunks(
    df: DataFrame, keys: Sequence[str], ts: str, chunking: Chunking = DEFAULT, out: str = "_chunk"
) -> DataFrame:
    """Add a chunk id that grows with time within a key.

    The table of hot buckets is broadcast: it has one row per bucket above ``hot_rows`` rows, so
    never more than ``total rows / hot_rows`` of them (one million for 5e12 rows).
    """
    width = chunking.seconds * 1_000_000
    us = micros(ts)
    bucket = F.floor(us / F.lit(width)).cast("long")
    if chunking.hot_rows is None:
        return df.withColumn(out, bucket * F.lit(MAX_PARTS))
    hot = (
        df.groupBy(*keys, bucket.alias("_bucket"))
        .count()
        .filter(F.col("count") > chunking.hot_rows)
        .select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys],
            F.col("_bucket").alias("_hot_bucket"),
            F.least(
                F.lit(MAX_PARTS), 4 * F.ceil(F.col("count") / F.lit(chunking.hot_rows))
            ).alias("_parts"),
        )
    )
    condition = F.col("_bucket") == F.col("_hot_bucket")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    offset = (us - F.col("_bucket") * F.lit(width)).cast("double")
    sub = F.floor(offset * parts / F.lit(float(width))).cast("long")
    return (
        df.withColumn("_bucket", bucket)
        .join(hot, condition, "left")
        .withColumn(out, F.col("_bucket") * F.lit(MAX_PARTS) + sub)
        .drop("_bucket", "_hot_bucket", "_parts", *[f"_hot_{k}" for k in keys])
    )


_CHUNK_TOTAL = {
    "last": lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
    "max": lambda v, order: F.max(v),
    "min": lambda v, order: F.min(v),
    "sum": lambda v, order: F.sum(v),
}
_RUNNING = {
    "last": lambda v, w: F.last(v, ignorenulls=True).over(w),
    "max": lambda v, w: F.max(v).over(w),
    "min": lambda v, w: F.min(v).over(w),
    "sum": lambda v, w: F.sum(v).over(w),
}


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    columns: Mapping[str, tuple[str, Column]],
    *,
    backwards: bool = False,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Running aggregates, current row included, over the whole series of a key.

    ``columns`` maps an output name to (kind, expression), kind one of last, max, min, sum.  ``order``
    breaks ties of ``ts``.  ``backwards`` scans from the future, so that ``last`` becomes ``next``.
    An input that already has a ``_chunk`` column (growing with ``ts``) keeps it.
    """
    base = df if "_chunk" in df.columns else assign_chunks(df, keys, ts, chunking)
    for name, (_, expression) in columns.items():
        base = base.withColumn(f"_v_{name}", expression)
    order_cols = [F.col(ts), *[F.col(c) for c in order]]
    position = F.struct(*order_cols)
    pick = {k: v for k, v in _CHUNK_TOTAL.items()}
    if backwards:
        pick["last"] = lambda v, o: F.min_by(v, F.when(v.isNotNull(), o))
    totals = base.groupBy(*keys, "_chunk").agg(
        *[pick[kind](F.col(f"_v_{n}"), position).alias(f"_v_{n}") for n, (kind, _) in columns.items()]
    )
    chunk_order = F.col("_chunk").desc() if backwards else F.col("_chunk").asc()
    before = (
        Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_chunk",
        F.lit(0).alias("_real"),
        *[_RUNNING[kind](F.col(f"_v_{n}"), before).alias(f"_v_{n}") for n, (kind, _) in columns.items()],
    )
    rows = base.withColumn("_real", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    sort = [c.desc() if backwards else c.asc() for c in order_cols]
    window = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(F.col("_real").asc(), *sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.select(
            "*",
            *[_RUNNING[kind](F.col(f"_v_{n}"), window).alias(n) for n, (kind, _) in columns.items()],
        )
        .filter(F.col("_real") == 1)
        .drop("_real", "_chunk", *[f"_v_{n}" for n in columns])
    )


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    build: Callable[[object], Mapping[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Columns over ROWS frames reaching at most ``before`` rows back and ``after`` rows ahead.

    ``build`` receives the window specification (ordered, no frame) and returns the new columns.
    """
    names = df.columns
    base = assign_chunks(df, keys, ts, chunking)
    parts = [base.withColumn("_halo", F.lit(False))]
    position = [F.col(ts), *[F.col(c) for c in order]]
    inner = Window.partitionBy(*keys, "_chunk")
    outer = Window.partitionBy(*keys).orderBy("_chunk")

    def border(depth: int, tail: bool) -> DataFrame:
        """The ``depth`` rows next to each chunk's edge; every list is at most ``depth`` long."""
        rank = F.row_number().over(inner.orderBy(*[c.desc() if tail else c.asc() for c in position]))
        edge = (
            base.withColumn("_rank", rank)
            .filter(F.col("_rank") <= depth)
            .groupBy(*keys, "_chunk")
            .agg(
                F.sort_array(
                    F.collect_list(F.struct((-F.col("_rank") if tail else F.col("_rank")).alias("o"),
                                            F.struct(*[F.col(n) for n in names]).alias("row")))
                ).alias("_edge")
            )
        )
        frame = outer.rowsBetween(-depth, -1) if tail else outer.rowsBetween(1, depth)
        near = F.flatten(F.collect_list("_edge").over(frame))
        cut = (
            F.slice(near, F.greatest(F.size(near) - depth + 1, F.lit(1)), F.lit(depth))
            if tail
            else F.slice(near, 1, depth)
        )
        return (
            edge.select("_chunk", cut.alias("_near"))
            .select("_chunk", F.explode("_near").alias("_n"))
            .select("_chunk", "_n.row.*", F.lit(True).alias("_halo"))
        )

    if before:
        parts.append(border(before, True))
    if after:
        parts.append(border(after, False))
    rows = parts[0]
    for extra in parts[1:]:
        rows = rows.unionByName(extra)
    window = inner.orderBy(*position)
    new = build(window)
    return (
        rows.select("*", *[c.alias(n) for n, c in new.items()])
        .filter(~F.col("_halo"))
        .drop("_halo", "_chunk")
    )


def over_range(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    build: Callable[[Callable[[int], object]], Mapping[str, Column]],
    *,
    before_minutes: int,
    bucket_minutes: int | None = None,
) -> DataFrame:
    """Columns over time frames ``[t - w, t]`` with w up to ``before_minutes``.

    ``build`` receives ``frame(minutes)`` and returns the new columns.  A bucket is as long as the
    longest frame, so each row is copied at most once and no task sees more than two frame lengths.
    """
    width = (bucket_minutes or before_minutes) * 60_000_000
    us = micros(ts)
    first = F.floor(us / F.lit(width))
    last = F.floor((us + F.lit(before_minutes * 60_000_000)) / F.lit(width))
    rows = (
        df.withColumn("_us", us)
        .withColumn("_home", first)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
    )

    def frame(minutes: int):
        return (
            Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(-minutes * 60_000_000, 0)
        )

    new = build(frame)
    return (
        rows.select("*", *[c.alias(n) for n, c in new.items()])
        .filter(F.col("_home") == F.col("_chunk"))
        .drop("_us", "_home", "_chunk")
    )
