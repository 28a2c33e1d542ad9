"""Features of ordered series: lags, rolling statistics, episodes, ages, control changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.timecols import micros, minutes_between, plus_minutes
from assaylake.operators.asof import asof, asof_published
from assaylake.operators.chunks import DEFAULT, Chunking, carry_forward, over_rows
from assaylake.operators.spans import span_stats
from assaylake.session import materialise

LAGS = (0, 10, 30, 60, 180)
WINDOWS = (60, 180)
TELEMETRY_MAX_AGE = 20


def each_of(names: Sequence[str]) -> Column:
    """One copy of a row per name of a short literal list."""
    return F.explode(F.array(*[F.lit(n) for n in names]))


def lag_values(
    queries: DataFrame,
    telemetry: DataFrame,
    *,
    query_id: str,
    query_ts: str,
    signals: Sequence[str],
    lags: Sequence[int] = LAGS,
    max_age: float = TELEMETRY_MAX_AGE,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Long table (query, signal, lag, value): the last telemetry row at or before each cutoff.

    All cutoffs of all queries share one ordered pass per signal.  If the last row holds no value the
    lag is NULL; an older row is not searched.
    """
    asks = queries.select("entity", query_id, query_ts, each_of(signals).alias("signal_id")).select(
        "*", F.explode(F.array(*[F.lit(m) for m in lags])).alias("lag")
    )
    return asof(
        asks, telemetry, keys=["entity", "signal_id"],
        query_ts=plus_minutes(query_ts, -F.col("lag")), event_ts="ts", take=["value"],
        tolerance_minutes=max_age, chunking=chunking,
    ).select("entity", query_id, "signal_id", "lag", "value")


def window_stats(
    queries: DataFrame,
    series: DataFrame,
    *,
    keys: Sequence[str],
    query_id: str,
    query_ts: str,
    ts: str,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ("mean", "std"),
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Rolling statistics ending exactly at the query time, both ends closed; one row per key, id and time.

    ``series`` holds one row per key and instant (see ``collapse_duplicates``).  A value counts from its own time to
    the window's length later (see ``spans``); no frame is aggregated again for each row.
    """
    spans = (
        series.filter(F.col("value").isNotNull() & F.col(ts).isNotNull())
        .select(*keys, micros(ts).alias("_from"), F.col("value").cast("double").alias("value"),
                F.explode(F.array(*[F.lit(m) for m in windows])).alias("_span"))
        .withColumn("_to", F.col("_from") + F.col("_span").cast("long") * F.lit(60_000_000))
    )
    asks = queries.filter(F.col(query_id).isNotNull()).select(*keys, query_id, micros(query_ts).alias("_q"))
    return span_stats(
        asks, spans, keys=keys, ids=[query_id], lengths=windows, stats=stats, inner=False, chunking=chunking
    )


def published_lags(
    queries: DataFrame,
    observations: DataFrame,
    *,
    query_id: str,
    query_ts: str,
    lags: Sequence[int] = LAGS,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Wide table of the last visible quality value at each lag, plus its age at lag 0."""
    asks = queries.select("entity", query_id, query_ts).select(
        "*", F.explode(F.array(*[F.lit(m) for m in lags])).alias("lag")
    )
    found = asof_published(
        asks, observations, keys=["entity"], query_ts=plus_minutes(query_ts, -F.col("lag")), chunking=chunking
    )
    return found.groupBy("entity", query_id).agg(
        *[F.max(F.when(F.col("lag") == m, F.col("last_value"))).alias(f"lag_{m}m") for m in lags],
        F.max(F.when(F.col("lag") == 0, F.col("age_minutes"))).alias("age_minutes"),
    )


def exceedance_episodes(
    series: DataFrame, *, keys: Sequence[str], ts: str, limit: float, chunking: Chunking = DEFAULT
) -> DataFrame:
    """Consecutive rows above the limit share an episode id and a start time.

    Adjacency is by row: a gap in time does not end an episode.
    """
    above = F.col("value") > limit
    flagged = over_rows(
        series, keys, ts, [], lambda w: {"_was": F.lag("value").over(w)}, before=1, chunking=chunking
    ).withColumn("_start", above & ~F.coalesce(F.col("_was") > limit, F.lit(False)))
    numbered = carry_forward(
        flagged, keys, ts, [],
        {
            "_id": ("sum", F.col("_start").cast("long")),
            "_at": ("last", F.when(F.col("_start"), F.col(ts))),
        },
        chunking=chunking,
    )
    return numbered.select(
        *series.columns,
        F.when(above, F.col("_id")).alias("episode_id"),
        F.when(above, F.col("_at")).alias("episode_start_at"),
    )


def state_ages(
    queries: DataFrame,
    series: DataFrame,
    *,
    keys: Sequence[str],
    query_ts: str,
    ts: str,
    thresholds: Sequence[float],
    bands: Sequence[float],
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Minutes since the value last changed sides of each threshold, and since its band changed."""
    changes = over_rows(
        series, keys, ts, [], lambda w: {"_was": F.lag("value").over(w)}, before=1, chunking=chunking
    )
    first = F.col("_was").isNull()
    band = sum((F.col("value") >= b).cast("int") for b in bands)
    old_band = sum((F.col("_was") >= b).cast("int") for b in bands)
    marks = {
        f"since_{int(x)}": first | ((F.col("value") >= x) != (F.col("_was") >= x)) for x in thresholds
    }
    marks["regime"] = first | (band != old_band)
    # One ordered stream: queries after equal-time events, one running last per mark.
    events = changes.select(
        *keys, F.col(ts).alias("_t"), F.lit(1).alias("_tag"),
        *[F.when(m, F.col(ts)).alias(f"_at_{n}") for n, m in marks.items()],
    )
    asks = queries.select(
        *keys, F.col(query_ts).alias("_t"), F.lit(2).alias("_tag"),
        F.struct(*queries.columns).alias("_q"),
    )
    found = carry_forward(
        asks.unionByName(events, allowMissingColumns=True), keys, "_t", ["_tag"],
        {n: ("last", F.col(f"_at_{n}")) for n in marks}, chunking=chunking,
    ).filter(F.col("_q").isNotNull())
    return found.select("_q.*", *[minutes_between("_t", n).alias(f"{n}_minutes") for n in marks])


def control_changes(
    plant: DataFrame, *, controls: Sequence[str], keys: Sequence[str] = ("entity",), ts: str = "ts",
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Row-to-row change of each control."""
    return over_rows(
        plant, keys, ts, [],
        lambda w: {f"d_{c}": F.col(c) - F.lag(c).over(w) for c in controls},
        before=1, chunking=chunking,
    )


def change_context(
    changes: DataFrame,
    thresholds: dict[str, Column],
    *,
    keys: Sequence[str] = ("entity",),
    ts: str = "ts",
    before_rows: int = 6,
    quiet_rows: int = 18,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Per row: stable before, quiet after and calm now, all by row count.

    * stable_before: the largest absolute change of the six rows before this one is below the
      threshold for every control, and all six changes are known.
    * quiet_after: none of the next 18 rows moves a control; an incomplete tail is not quiet.
    * calm: none of the last 18 rows, this one included, moves a control.
    """
    noted = changes
    for c, x in thresholds.items():
        noted = noted.withColumn(f"notable_{c}", F.coalesce(F.abs(F.col(f"d_{c}")) >= x, F.lit(False)))
        noted = noted.withColumn(
            f"_steady_{c}", F.coalesce(F.abs(F.col(f"d_{c}")) < x, F.lit(False)).cast("int")
        )
    moved = F.greatest(*[F.col(f"notable_{c}") for c in thresholds], F.lit(False)).cast("int")
    noted = noted.withColumn("_moved", moved)

    def build(w):
        back, ahead = w.rowsBetween(-before_rows, -1), w.rowsBetween(1, quiet_rows)
        last = w.rowsBetween(1 - quiet_rows, 0)
        steady = F.lit(True)
        for c in thresholds:
            steady = steady & (F.coalesce(F.sum(f"_steady_{c}").over(back), F.lit(0)) == before_rows)
        return {
            "stable_before": steady,
            "quiet_after": (F.count("_moved").over(ahead) == quiet_rows)
            & (F.coalesce(F.sum("_moved").over(ahead), F.lit(1)) == 0),
            "calm": (F.count("_moved").over(last) == quiet_rows) & (F.sum("_moved").over(last) == 0),
        }

    out = over_rows(
        noted, keys, ts, [], build, before=quiet_rows, after=quiet_rows, chunking=chunking
    )
    return out.drop("_moved", *[f"_steady_{c}" for c in thresholds])


def isolated_changes(
    plant: DataFrame,
    thresholds: dict[str, float],
    *,
    target: str,
    horizons: Sequence[int],
    stable_minutes: int,
    keys: Sequence[str] = ("entity",),
    ts: str = "ts",
    tolerance_minutes: float = 10,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Rows where exactly one control moved after a complete stable stretch, with what followed.

    "Stable stretch" means: three or more rows within ``[t - w, t)``, no missing value among them,
    and no step between two of them reaches a threshold.  Each condition only needs the *latest*
    offending row, so a running last replaces a scan of the stretch.
    """
    controls = list(thresholds)

    def before_row(w, k: int) -> Column:
        """Whether the row ``k`` places back was reached by a step of threshold size."""
        return F.greatest(
            *[F.coalesce(F.abs(F.lag(c, k).over(w) - F.lag(c, k + 1).over(w)) >= x, F.lit(False))
              for c, x in thresholds.items()],
            F.lit(False),
        )

    def build(w):
        hole = F.greatest(*[F.lag(c).over(w).isNull() for c in [*controls, target]])
        return {
            **{f"d_{c}": F.col(c) - F.lag(c).over(w) for c in controls},
            "_third_ts": F.lag(ts, 3).over(w),
            "baseline_quality": F.lag(target).over(w),
            # Offending rows strictly before this one, so the running values stop short of it.
            "_b": F.when(before_row(w, 1), F.lag(ts, 2).over(w)),
            "_h": F.when(hole, F.lag(ts).over(w)),
        }

    steps = over_rows(
        plant.select(*keys, ts, *controls, target), keys, ts, [], build, before=3, chunking=chunking
    )
    big = {c: F.coalesce(F.abs(F.col(f"d_{c}")) >= x, F.lit(False)) for c, x in thresholds.items()}
    seen = carry_forward(
        steps, keys, ts, [], {"_last_big": ("last", F.col("_b")), "_last_hole": ("last", F.col("_h"))},
        chunking=chunking,
    )
    start = plus_minutes(ts, -stable_minutes)
    active = sum(b.cast("int") for b in big.values())
    chosen = F.coalesce(*[F.when(b, F.lit(c)) for c, b in big.items()])
    delta = F.coalesce(*[F.when(b, F.col(f"d_{c}")) for c, b in big.items()])
    events = seen.filter(
        (active == 1)
        & (F.col("_third_ts") >= start)
        & (F.col("_last_big").isNull() | (F.col("_last_big") < start))
        & (F.col("_last_hole").isNull() | (F.col("_last_hole") < start))
    ).select(
        *keys, F.col(ts).alias("changed_at"), chosen.alias("control_id"),
        delta.alias("control_delta"), "baseline_quality",
    )
    events = materialise(events, "isolated-changes")
    series = plant.select(*keys, ts, F.col(target).alias("_target"))
    asks = events.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("_h"))
    reached = asof(
        asks, series, keys=keys, query_ts=plus_minutes("changed_at", F.col("_h")), event_ts=ts,
        take=["_target"], direction="forward", tolerance_minutes=tolerance_minutes, chunking=chunking,
    ).filter(F.col("_target").isNotNull())
    wide = reached.groupBy(*events.columns).agg(
        F.count("*").alias("_n"),
        *[F.max(F.when(F.col("_h") == h, F.col("_target") - F.col("baseline_quality")))
          .alias(f"delta_quality_{h}m") for h in horizons],
    )
    return wide.filter(F.col("_n") == len(horizons)).drop("_n")


def steps_ahead(
    frame: DataFrame, series: DataFrame, *, keys: Sequence[str], as_of: str, ts: str, steps: Sequence[int]
) -> DataFrame:
    """Long table of the values ``step`` minutes after each decision time, exact to ``SAME_INSTANT_US``.

    Of several values near enough the nearest counts, and of equally near ones the earlier.  Both sides meet on whole
    seconds: a wanted instant looks at its own second and its neighbours.
    """
    asks = frame.select(*keys, as_of).distinct().select("*", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asks = asks.withColumn(ts, plus_minutes(as_of, F.col("step"))).withColumn("_at", micros(ts)).withColumn(
        "_second", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_at") / 1e6) + d))
    )
    values = [c for c in series.columns if c not in (*keys, ts)]
    rows = series.select(
        *keys, micros(ts).alias("_us"), F.floor(micros(ts) / 1e6).alias("_second"), F.struct(*values).alias("_row")
    )
    off = F.abs(F.col("_us") - F.col("_at"))
    return (
        asks.join(rows, [*keys, "_second"]).filter(off <= SAME_INSTANT_US)
        .groupBy(*keys, as_of, "step", ts).agg(F.min_by("_row", F.struct(off.alias("off"), F.col("_us"))).alias("_row"))
        .select(*keys, as_of, "step", ts, "_row.*")
    )


#: Two instants this near are the same.
SAME_INSTANT_US = 1_000_000


def half_split(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First and second half by position in time.

    Position is a count, not a sort of all rows in one task: instants are counted, the counts are
    accumulated by ``carry_forward`` and only ties inside one instant are numbered.
    """
    ts, *rest = order
    df = materialise(df, "half-split")
    counts = df.groupBy(ts).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    placed = carry_forward(counts, ["_all"], ts, [], {"_upto": ("sum", F.col("_n"))})
    total = df.agg(F.count("*").alias("_total")).first()["_total"]
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy(ts).orderBy(*rest or [ts]))
    return (
        df.join(placed.select(ts, (F.col("_upto") - F.col("_n")).alias("_before")), ts)
        .withColumn("position", F.col("_before") + inside)
        .withColumn("half", F.when(F.col("position") <= total // 2, 1).otherwise(2))
        .drop("_before")
    )
