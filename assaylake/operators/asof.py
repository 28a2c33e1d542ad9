"""As-of lookups: one union, one shuffle, no join.

Queries and events of a key go into one ordered stream and a running ``last`` picks the event.  See
``chunks.carry_forward`` for how a long series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.timecols import micros
from assaylake.operators.chunks import DEFAULT, Chunking, carry_forward, over_rows
from assaylake.operators.spans import span_stats


def _stream(
    queries: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    query_ts: Column,
    event_ts: Column,
    payload: Column,
    tie: Sequence[str],
    query_tag: int,
) -> DataFrame:
    left = queries.select(
        *keys,
        query_ts.alias("_t"),
        F.lit(query_tag).alias("_tag"),
        F.struct(*[F.col(c) for c in queries.columns]).alias("_q"),
    )
    right = events.filter(event_ts.isNotNull()).select(
        *keys,
        event_ts.alias("_t"),
        F.lit(1).alias("_tag"),
        F.struct(*[F.col(c) for c in tie]).alias("_tie") if tie else F.lit(0).alias("_tie"),
        payload.alias("_e"),
    )
    return left.unionByName(right, allowMissingColumns=True)


def asof(
    queries: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str],
    query_ts: Column | str,
    event_ts: str,
    take: Sequence[str],
    direction: str = "backward",
    exact: bool = True,
    tolerance_minutes: float | None = None,
    tie: Sequence[str] = (),
    prefix: str = "",
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Attach to each query the last event row at or before it (or the first at or after it).

    The event *row* is chosen first; a NULL inside it stays NULL and is not searched past.  Output
    columns are the query columns, ``prefix + take`` and ``prefix + event_ts``.
    """
    backward = direction == "backward"
    q = F.col(query_ts) if isinstance(query_ts, str) else query_ts
    # Tag 1 are events.  A query sorts after equal-time events going backward, before them forward.
    query_tag = 2 if backward == exact else 0
    payload = F.struct(F.col(event_ts).alias("_at"), *[F.col(c) for c in take])
    stream = _stream(queries, events, keys, q, F.col(event_ts), payload, tie, query_tag)
    found = carry_forward(
        stream,
        keys,
        "_t",
        ["_tag", "_tie"],
        {"_m": ("last", F.col("_e"))},
        backwards=not backward,
        chunking=chunking,
    ).filter(F.col("_q").isNotNull())
    if tolerance_minutes is not None:
        gap = F.abs(micros("_t") - micros("_m._at"))
        ok = gap <= F.lit(int(tolerance_minutes * 60_000_000))
    else:
        ok = F.lit(True)
    return found.select(
        "_q.*",
        *[F.when(ok, F.col(f"_m.{c}")).alias(f"{prefix}{c}") for c in take],
        F.when(ok, F.col("_m._at")).alias(f"{prefix}{event_ts}"),
    )


def asof_nearest(
    queries: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str],
    query_ts: str,
    event_ts: str,
    take: Sequence[str],
    tolerance_minutes: float,
    tie: Sequence[str] = (),
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Nearest event on either side; equal gaps take the earlier one."""
    common = dict(keys=keys, query_ts=query_ts, event_ts=event_ts, take=take, tie=tie,
                  tolerance_minutes=tolerance_minutes, chunking=chunking)
    back = asof(queries, events, prefix="_b_", **common)
    both = asof(back, events, prefix="_f_", direction="forward", **common)
    b, f = F.col(f"_b_{event_ts}"), F.col(f"_f_{event_ts}")
    use_back = b.isNotNull() & (
        f.isNull() | (micros(query_ts) - micros(b) <= micros(f) - micros(query_ts))
    )
    names = [*take, event_ts]
    return both.select(
        *queries.columns,
        *[F.when(use_back, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(
            c if c not in queries.columns else f"event_{c}") for c in names],
    )


def asof_published(
    queries: DataFrame,
    observations: DataFrame,
    *,
    keys: Sequence[str],
    query_ts: Column | str,
    value: str = "value",
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Latest *measured* value among the rows *published* by the query time, and its age.

    When that row was sampled after the query time the result is NULL; an older row is not used.
    """
    q = F.col(query_ts) if isinstance(query_ts, str) else query_ts
    payload = F.struct(
        F.col("measured_at"), (-micros("available_at")).alias("_first_published"), F.col(value).alias("value")
    )
    stream = _stream(queries, observations, keys, q, F.col("available_at"), payload, (), 2)
    found = carry_forward(
        stream, keys, "_t", ["_tag"], {"_m": ("max", F.col("_e"))}, chunking=chunking
    ).filter(F.col("_q").isNotNull())
    visible = F.col("_m.measured_at") <= F.col("_t")
    return found.select(
        "_q.*",
        F.when(visible, F.col("_m.value")).alias("last_value"),
        F.when(visible, (micros("_t") - micros("_m.measured_at")) / F.lit(60e6)).alias("age_minutes"),
    )


def published_depth(
    queries: DataFrame,
    observations: DataFrame,
    *,
    keys: Sequence[str],
    query_ts: str,
    depth: int = 3,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """The last ``depth`` published values with ages; samples taken after the query stay hidden."""
    history = over_rows(
        observations.select(*keys, "observation_id", "available_at", "measured_at", "value"),
        keys,
        "available_at",
        ["measured_at", "observation_id"],
        lambda w: {
            f"{c}_{k}": F.lag(c, k).over(w) for k in range(depth) for c in ("value", "measured_at")
        },
        before=depth - 1,
        chunking=chunking,
    )
    take = [f"{c}_{k}" for k in range(depth) for c in ("value", "measured_at")]
    found = asof(
        queries, history, keys=keys, query_ts=query_ts, event_ts="available_at", take=take,
        tie=["measured_at", "observation_id"], prefix="_p_", chunking=chunking,
    )
    out = []
    for k in range(depth):
        seen = F.col(f"_p_measured_at_{k}") <= F.col(query_ts)
        out.append(F.when(seen, F.col(f"_p_value_{k}")).alias(f"lims_published_lag_{k}"))
        out.append(
            F.when(seen, (micros(query_ts) - micros(f"_p_measured_at_{k}")) / F.lit(60e6)).alias(
                f"lims_age_minutes_{k}"
            )
        )
    return found.select(*queries.columns, *out)


def window_published(
    queries: DataFrame,
    observations: DataFrame,
    *,
    keys: Sequence[str],
    query_id: str,
    query_ts: str,
    minutes: int,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Mean and population deviation over ``[q - w, q]`` of values already published at ``q``.

    A value counts from the later of its measuring and publication until its window closes, or never if it was published
    after that.  ``spans`` finds what counts without pairing a query with each value.
    """
    seen_from = F.greatest(micros("measured_at"), micros("available_at"))
    seen_to = micros("measured_at") + F.lit(minutes * 60_000_000)
    spans = observations.filter(F.col("value").isNotNull() & (seen_from <= seen_to)).select(
        *keys, F.lit(minutes).alias("_span"), seen_from.alias("_from"), seen_to.alias("_to"),
        F.col("value").cast("double").alias("value"),
    )
    asks = queries.select(*keys, query_id, micros(query_ts).alias("_q"))
    found = span_stats(
        asks, spans, keys=keys, ids=[query_id], lengths=[minutes], stats=("mean", "std", "n"), chunking=chunking
    )
    stats = found.drop(*keys).filter(F.col(f"n_{minutes}m") > 0)
    return queries.join(stats, query_id, "left")
