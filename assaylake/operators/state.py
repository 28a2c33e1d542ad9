"""State snapshots: what was known about each signal at each decision time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.labels import FRESH_MINUTES, SOURCE_PRIORITY, lookup
from assaylake.functions.timecols import micros, minutes_between
from assaylake.operators.chunks import DEFAULT, Chunking, carry_forward

OBS = ("observation_id", "signal_id", "source", "measured_at", "available_at", "value", "unit",
       "validity", "source_ref")


def freshness_limit(source: Column) -> Column:
    return lookup(FRESH_MINUTES, source, F.lit(0))


def priority(source: Column) -> Column:
    return lookup(SOURCE_PRIORITY, source, F.lit(99))


def latest_per_source(
    as_of: DataFrame,
    observations: DataFrame,
    signal_sources: Sequence[tuple[str, str]],
    *,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """Latest visible and latest usable row per (plant, decision time, signal, source).

    Visible means sampled and published by then.  An invalid newer sample must not hide an older
    valid one, hence both.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(g).alias("signal_id"), F.lit(s).alias("source")) for g, s in signal_sources
    ]))
    asks = as_of.select("entity", "as_of", pairs.alias("_p")).select(
        "entity", F.col("_p.signal_id").alias("signal_id"), F.col("_p.source").alias("source"),
        F.col("as_of").alias("_t"), F.lit(2).alias("_tag"), "as_of",
    )
    wanted = {f"{g}|{s}" for g, s in signal_sources}
    body = F.struct(F.col("measured_at").alias("at"), *[F.col(c) for c in OBS])
    usable = (F.col("validity") == "valid") & F.col("value").isNotNull()
    # A row becomes visible when it is both sampled and published.
    events = observations.filter(
        F.concat_ws("|", "signal_id", "source").isin(*sorted(wanted))
    ).select(
        "entity", "signal_id", "source", F.greatest("measured_at", "available_at").alias("_t"),
        F.lit(1).alias("_tag"), body.alias("_any"), F.when(usable, body).alias("_ok"),
    )
    found = carry_forward(
        asks.unionByName(events, allowMissingColumns=True), ["entity", "signal_id", "source"], "_t",
        ["_tag"], {"latest": ("max", F.col("_any")), "usable": ("max", F.col("_ok"))}, chunking=chunking,
    )
    return found.filter(F.col("as_of").isNotNull()).select(
        "entity", "as_of", "signal_id", "source", "latest", "usable"
    )


def state_snapshot(latest: DataFrame, *, prefer_fresh: bool = True) -> DataFrame:
    """One row per (plant, decision time, signal): selected observation, age, freshness, issues.

    ``prefer_fresh``: any fresh reading beats any stale one, then source priority, then the newest.
    Without it (dashboards) priority alone decides and freshness is only reported.
    """
    at = F.col("usable.measured_at")
    fresh = minutes_between("as_of", at) <= freshness_limit(F.col("source"))
    rank = F.struct(
        (F.when(fresh, 0).otherwise(1) if prefer_fresh else F.lit(0)).alias("stale"),
        priority(F.col("source")).alias("priority"),
        (-micros(at)).alias("newest"),
    )
    ok = F.col("usable").isNotNull()
    grouped = latest.groupBy("entity", "as_of", "signal_id").agg(
        F.min_by(F.col("usable"), F.when(ok, rank)).alias("selected"),
        # At most two rows per source, so this list is short whatever the data size.
        F.collect_list(F.col("latest")).alias("_latest"),
        F.collect_list(F.col("usable")).alias("_usable"),
    )
    seconds = minutes_between("as_of", "selected.measured_at") * 60.0
    limit = freshness_limit(F.col("selected.source")) * 60
    is_fresh = F.coalesce(seconds <= limit, F.lit(False))
    issue = (
        F.when(F.col("selected").isNull(), "MISSING_REQUIRED_SIGNAL")
        .when(~is_fresh, "STALE_REQUIRED_SIGNAL")
    )
    candidates = F.array_distinct(F.concat("_latest", "_usable"))
    others = F.filter(
        candidates,
        lambda o: F.col("selected").isNull() | (o["observation_id"] != F.col("selected.observation_id")),
    )
    return grouped.select(
        "entity", "as_of", "signal_id", "selected", others.alias("alternatives"),
        seconds.alias("age_seconds"), is_fresh.alias("fresh"), issue.alias("issue"),
    )


def state_ids(snapshot: DataFrame, dataset_id: str) -> DataFrame:
    """16-character identity of each state; the signals of one state are a short fixed list."""
    signal = F.struct("signal_id", "selected", "fresh", "issue")
    return snapshot.groupBy("entity", "as_of").agg(
        F.substring(
            F.sha2(
                F.concat_ws("\n", F.lit(dataset_id), F.col("as_of").cast("string"),
                            F.to_json(F.sort_array(F.collect_list(signal)))),
                256,
            ), 1, 16,
        ).alias("state_id")
    )


def missing_required(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(F.col("selected").isNull()).select("entity", "as_of", "signal_id")


def freshness_summary(snapshot: DataFrame, group: str) -> DataFrame:
    missing = F.col("selected").isNull()
    return snapshot.groupBy(group).agg(
        F.count_if(F.col("fresh")).alias("fresh"),
        F.count_if(~F.col("fresh") & ~missing).alias("stale"),
        F.count_if(missing).alias("missing"),
    )
