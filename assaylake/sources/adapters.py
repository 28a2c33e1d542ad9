"""Process-data views over the TPC-H-like tables.

``events`` plays the plant: click / signup / view are telemetry signals, purchase is the online
analyser (published at once), error the laboratory (published four hours later).  A plant is a block
of 150 users, so the number of plants grows with the data.  ``CTE`` holds the same views as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaylake.functions.timecols import floor_minutes, plus_minutes

LIMIT = 60.0
NEAR_LOWER, NEAR_UPPER = 48.0, 72.0
SIGNALS = ("click", "signup", "view")
TRAIN_END, VALIDATION_END = "2024-01-16", "2024-01-24"

CTE: dict[str, str] = {
    "quality": """
SELECT user_id // 150 AS entity, CAST(event_id AS VARCHAR) AS observation_id,
       'ht:sulfur' AS signal_id, 'ht' AS stage,
       CASE event_type WHEN 'purchase' THEN 'pak' ELSE 'lims' END AS source,
       ts AS measured_at,
       CASE event_type WHEN 'purchase' THEN ts ELSE ts + INTERVAL 4 HOUR END AS available_at,
       value,
       CASE WHEN event_id % 37 = 0 THEN 'unknown' ELSE 'mg/kg' END AS unit,
       CASE WHEN event_id % 50 = 0 THEN 'invalid' ELSE 'valid' END AS validity,
       'events#' || CAST(event_id AS VARCHAR) AS source_ref
FROM events WHERE event_type IN ('purchase', 'error')""",
    "pak": """
SELECT * FROM quality WHERE source = 'pak' AND validity = 'valid' AND unit = 'mg/kg' AND value IS NOT NULL""",
    "lims": """
SELECT * FROM quality WHERE source = 'lims' AND validity = 'valid' AND unit = 'mg/kg' AND value IS NOT NULL""",
    "late": """
SELECT * REPLACE (measured_at + CAST(CAST(observation_id AS BIGINT) % 6 AS INTEGER) * INTERVAL 50 MINUTE AS available_at)
FROM quality WHERE source = 'lims' AND validity = 'valid' AND unit = 'mg/kg' AND value IS NOT NULL""",
    "tele": """
SELECT user_id // 150 AS entity, event_type AS signal_id, ts,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value
FROM events WHERE event_type IN ('click', 'signup', 'view')""",
    "sup": """
SELECT t.observation_id, t.entity, t.measured_at - INTERVAL 60 MINUTE AS as_of,
       t.measured_at AS target_at, t.available_at AS target_available_at, t.value AS y,
       h.value AS baseline,
       (epoch_us(t.measured_at - INTERVAL 60 MINUTE) - epoch_us(h.measured_at)) / 60e6 AS age_minutes
FROM pak t ASOF LEFT JOIN pak h
  ON t.entity = h.entity AND t.measured_at - INTERVAL 60 MINUTE >= h.measured_at""",
    "scored": """
SELECT *, CASE WHEN as_of < TIMESTAMP '2024-01-16' AND target_available_at < TIMESTAMP '2024-01-16' THEN 'train'
               WHEN as_of >= TIMESTAMP '2024-01-16' AND as_of < TIMESTAMP '2024-01-24'
                    AND target_available_at < TIMESTAMP '2024-01-24' THEN 'validation'
               WHEN as_of >= TIMESTAMP '2024-01-24' THEN 'test' END AS split,
       round(1.0 / (1.0 + exp(-(baseline - 60.0) / 20.0)), 2) AS p,
       baseline * 0.5 + 20.0 AS point, greatest(baseline * 0.5 + 20.0, baseline * 0.9 + 35.0) AS upper
FROM sup WHERE baseline IS NOT NULL""",
    "pakg": """
SELECT entity, time_bucket(INTERVAL 10 MINUTE, measured_at) AS measured_at, round(avg(value), 6) AS value
FROM pak GROUP BY 1, 2""",
    "pakx": """
SELECT *, CASE WHEN value > 60.0 THEN sum(st) OVER (PARTITION BY entity ORDER BY measured_at) END AS episode_id
FROM (SELECT *, CASE WHEN value > 60.0 AND NOT coalesce(lag(value) OVER (PARTITION BY entity ORDER BY measured_at) > 60.0, FALSE)
                     THEN 1 ELSE 0 END AS st FROM pakg)""",
    "starts": """
SELECT entity, episode_id, min(measured_at) AS started_at FROM pakx WHERE episode_id IS NOT NULL GROUP BY 1, 2""",
    "frame": """
SELECT t.entity, t.measured_at - INTERVAL 60 MINUTE AS as_of, t.measured_at AS target_at, h.value AS baseline
FROM pakg t ASOF LEFT JOIN pakg h
  ON t.entity = h.entity AND t.measured_at - INTERVAL 60 MINUTE >= h.measured_at""",
    "steps": """
SELECT f.entity, f.as_of, s.step, p.value, p.episode_id
FROM frame f CROSS JOIN (SELECT unnest([10, 20, 30, 40, 50, 60]) AS step) s
JOIN pakx p ON p.entity = f.entity AND p.measured_at = f.as_of + s.step * INTERVAL 1 MINUTE""",
    "epi": """
SELECT f.entity, f.as_of, f.target_at, f.baseline,
       max(s.value) FILTER (s.step = 10) AS y_10m, max(s.value) FILTER (s.step = 20) AS y_20m,
       max(s.value) FILTER (s.step = 30) AS y_30m, max(s.value) FILTER (s.step = 60) AS y_60m,
       coalesce(bool_or(s.value > 60.0 AND s.step <= 10), FALSE) AS crossing_10m,
       coalesce(bool_or(s.value > 60.0 AND s.step <= 20), FALSE) AS crossing_20m,
       coalesce(bool_or(s.value > 60.0 AND s.step <= 30), FALSE) AS crossing_30m,
       coalesce(bool_or(s.value > 60.0), FALSE) AS crossing_60m,
       CAST(arg_min(s.episode_id, s.step) FILTER (s.value > 60.0) AS BIGINT) AS event_id
FROM frame f LEFT JOIN steps s ON s.entity = f.entity AND s.as_of = f.as_of
GROUP BY ALL""",
    "episodes": """
SELECT e.*, s.started_at AS event_start_at,
       round(1.0 / (1.0 + exp(-(e.baseline - 60.0) / 20.0)), 2) AS p
FROM epi e LEFT JOIN starts s ON s.entity = e.entity AND s.episode_id = e.event_id""",
    "hours": """
SELECT entity, unnest(generate_series(h0, h1, INTERVAL 1 HOUR)) AS as_of
FROM (SELECT user_id // 150 AS entity, date_trunc('hour', min(ts)) AS h0, date_trunc('hour', max(ts)) AS h1
      FROM events GROUP BY 1)""",
    "plant": """
SELECT user_id // 150 AS entity, date_trunc('hour', ts) AS ts,
       round(avg(value) FILTER (event_type = 'click'), 6) AS click,
       round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
       round(avg(value) FILTER (event_type = 'view'), 6) AS view,
       round(avg(value) FILTER (event_type = 'purchase'), 6) AS sulfur
FROM events GROUP BY 1, 2""",
}

_NEEDS = {
    "pak": ["quality"], "lims": ["quality"], "late": ["quality"], "sup": ["pak"], "scored": ["sup"],
    "pakg": ["pak"], "pakx": ["pakg"], "starts": ["pakx"], "frame": ["pakg"],
    "steps": ["frame", "pakx"], "epi": ["frame", "steps"], "episodes": ["epi", "starts"],
}


def with_views(names: str, body: str) -> str:
    """``WITH`` clause holding the named views and everything they read, before ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def plant_of(user: str = "user_id"):
    """A plant is a block of 150 users."""
    return F.floor(F.col(user) / 150).cast("long").alias("entity")


def quality(t) -> DataFrame:
    return quality_of(t.events)


def quality_of(events: DataFrame) -> DataFrame:
    """Analyser and laboratory observations among ``events``, a table or a stream."""
    pak = F.col("event_type") == "purchase"
    return events.filter(F.col("event_type").isin("purchase", "error")).select(
        plant_of(),
        F.col("event_id").cast("string").alias("observation_id"),
        F.lit("ht:sulfur").alias("signal_id"),
        F.lit("ht").alias("stage"),
        F.when(pak, "pak").otherwise("lims").alias("source"),
        F.col("ts").alias("measured_at"),
        F.when(pak, F.col("ts")).otherwise(plus_minutes("ts", 240)).alias("available_at"),
        "value",
        F.when(F.col("event_id") % 37 == 0, "unknown").otherwise("mg/kg").alias("unit"),
        F.when(F.col("event_id") % 50 == 0, "invalid").otherwise("valid").alias("validity"),
        F.concat(F.lit("events#"), F.col("event_id").cast("string")).alias("source_ref"),
    )


def late_lab(t) -> DataFrame:
    """Laboratory rows with a publication delay of 0 to 250 minutes."""
    delay = (F.col("observation_id").cast("long") % 6 * 50).cast("int")
    from assaylake.operators.cleanse import eligible

    return eligible(quality(t), source="lims").withColumn(
        "available_at", plus_minutes("measured_at", delay)
    )


def telemetry(t) -> DataFrame:
    return t.events.filter(F.col("event_type").isin(*SIGNALS)).select(
        plant_of(),
        F.col("event_type").alias("signal_id"),
        "ts",
        F.when(F.col("event_id") % 41 == 0, None).otherwise(F.col("value")).alias("value"),
    )


def analyser(t) -> DataFrame:
    from assaylake.operators.cleanse import eligible

    return eligible(quality(t), source="pak")


def analyser_grid(t) -> DataFrame:
    """Analyser values averaged on the ten-minute grid, the shape the episode study expects."""
    return (
        analyser(t)
        .groupBy("entity", floor_minutes("measured_at", 10).alias("measured_at"))
        .agg(F.round(F.avg("value"), 6).alias("value"))
    )


def plant_hours(t) -> DataFrame:
    """Wide hourly plant table: three signals and the analyser."""

    def mean_of(kind: str, name: str):
        return F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6).alias(name)

    return t.events.groupBy(plant_of(), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        mean_of("click", "click"),
        mean_of("signup", "signup"),
        mean_of("view", "view"),
        mean_of("purchase", "sulfur"),
    )


def hour_grid(t) -> DataFrame:
    """Hourly decision times of each plant over its own time range."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    span = t.events.groupBy(plant_of()).agg(F.min(hour).alias("h0"), F.max(hour).alias("h1"))
    return span.select("entity", F.explode(F.sequence("h0", "h1", F.expr("INTERVAL 1 HOUR"))).alias("as_of"))
