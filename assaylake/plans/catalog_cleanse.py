"""Cleansing, issues and deduplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.labels import (
    METRIC_TEXT, NO_REASON, REASON_TEXT, STAGE_OF_NAMESPACE, UNIT_SPELLINGS, UNKNOWN_REASON, lookup,
)
from assaylake.functions.timecols import civil_to_utc, floor_minutes
from assaylake.operators import cleanse as c
from assaylake.plans.registry import query
from assaylake.sources.adapters import plant_of, analyser, quality, telemetry, with_views

UNIT_LIST = list(UNIT_SPELLINGS)
NAMESPACES = list(STAGE_OF_NAMESPACE)


def sql_case(values: dict, key: str, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {default} END"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def brand_tags(t):
    """Tag dictionary made of the part brands: 25 rows whatever the scale."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return t.part.select("p_brand").distinct().select(
        F.concat(F.lit("avt:"), F.col("p_brand")).alias("raw_name"),
        F.concat(F.lit("sig:"), F.lower(F.col("p_brand"))).alias("signal_id"),
        F.when(n % 5 == 0, "ht").otherwise("avt").alias("stage"),
        F.when(n % 4 == 0, "% масс.").when(n % 4 == 1, "ppm").when(n % 4 == 2, "МПа").alias("raw_unit"),
        F.when(n % 4 < 2, "mg/kg").when(n % 4 == 2, "MPa").otherwise("degC").alias("canonical_unit"),
        F.when(n % 4 == 0, "mass_percent_to_mg_kg").when(n % 4 == 1, "ppm_mass_to_mg_kg")
        .otherwise("none").alias("conversion"),
        F.when(n % 7 == 0, "unconfirmed").otherwise("confirmed").alias("mapping_status"),
    )


TAGS_SQL = """
tags AS (SELECT 'avt:' || p_brand AS raw_name, 'sig:' || lower(p_brand) AS signal_id,
   CASE WHEN n % 5 = 0 THEN 'ht' ELSE 'avt' END AS stage,
   CASE n % 4 WHEN 0 THEN '% масс.' WHEN 1 THEN 'ppm' WHEN 2 THEN 'МПа' END AS raw_unit,
   CASE n % 4 WHEN 0 THEN 'mg/kg' WHEN 1 THEN 'mg/kg' WHEN 2 THEN 'MPa' ELSE 'degC' END AS canonical_unit,
   CASE n % 4 WHEN 0 THEN 'mass_percent_to_mg_kg' WHEN 1 THEN 'ppm_mass_to_mg_kg' ELSE 'none' END AS conversion,
   CASE WHEN n % 7 = 0 THEN 'unconfirmed' ELSE 'confirmed' END AS mapping_status
 FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS n FROM part))
"""


@query("scan_tag_dim", f"""
WITH {TAGS_SQL}
SELECT raw_name, signal_id, stage, raw_unit, canonical_unit, conversion, mapping_status FROM tags""")
def scan_tag_dim(t):
    from assaylake.sources.readers import checked_tags

    return checked_tags(brand_tags(t))


@query("canonical_signal", f"""
WITH {TAGS_SQL}
SELECT p.p_partkey, coalesce(g.signal_id, p.name) AS signal_id
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'avt:' || p_brand
        WHEN p_partkey % 3 = 1 THEN 'avt:' || p_brand ELSE 'avt:' || p_type END AS name FROM part) p
LEFT JOIN tags g ON g.raw_name = p.name""")
def canonical_signal(t):
    raw = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("avt:"), "p_brand"))
        .when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
        .otherwise(F.col("p_type"))
    )
    named = t.part.select("p_partkey", c.prefixed("avt", raw).alias("raw_name"))
    tags = brand_tags(t).select("raw_name", "signal_id")
    return named.join(tags, "raw_name", "left").select(
        "p_partkey", F.coalesce("signal_id", "raw_name").alias("signal_id")
    )


@query("to_utc", """
SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN ts - INTERVAL 3 HOUR END AS measured_at,
       event_id % 17 = 0 AS bad_time FROM events""")
def to_utc(t):
    text = F.when(F.col("event_id") % 17 == 0, "broken").otherwise(F.col("ts").cast("string"))
    at = c.utc_of(F.col("text"), "Europe/Moscow")
    return t.events.select("event_id", text.alias("text")).select(
        "event_id", at.alias("measured_at"), (F.col("text").isNotNull() & at.isNull()).alias("bad_time")
    )


@query("stage_of_namespace", f"""
SELECT p_partkey, {sql_case(STAGE_OF_NAMESPACE, f"({sql_list(NAMESPACES)})[1 + p_partkey % {len(NAMESPACES)}]", "NULL")} AS stage
FROM part""")
def stage_of_namespace(t):
    names = F.array(*[F.lit(n) for n in NAMESPACES])
    ns = F.element_at(names, (F.lit(1) + F.col("p_partkey") % len(NAMESPACES)).cast("int"))
    return t.part.select("p_partkey", ns.alias("ns")).select(
        "p_partkey", c.stage_of_namespace(F.col("ns")).alias("stage")
    )


@query("resolve_unit", f"""
SELECT p_partkey, {sql_case(UNIT_SPELLINGS, f"trim(({sql_list(UNIT_LIST + ['furlong'])})[1 + p_partkey % {len(UNIT_LIST) + 1}])", "'unknown'")} AS unit
FROM part""")
def resolve_unit(t):
    names = F.array(*[F.lit(f" {n} ") for n in [*UNIT_LIST, "furlong"]])
    raw = F.element_at(names, (F.lit(1) + F.col("p_partkey") % (len(UNIT_LIST) + 1)).cast("int"))
    return t.part.select("p_partkey", raw.alias("raw")).select(
        "p_partkey", c.resolve_unit(F.col("raw")).alias("unit")
    )


AUDIT_IN = """
src AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'avt:?' ELSE 'avt:' || p_brand END AS raw_name,
   (['% масс.', 'ppm', 'МПа', '°C', 'furlong'])[1 + p_size % 5] AS raw_unit, 'avt' AS source_stage FROM part)
"""
AUDIT_SQL = f"""
audit AS (
 SELECT s.p_partkey, coalesce(g.signal_id, s.raw_name) AS signal_id, s.u AS src_unit,
   coalesce(g.canonical_unit, s.u) AS unit, coalesce(g.conversion, 'none') AS conversion,
   CASE WHEN g.signal_id IS NULL OR g.mapping_status <> 'confirmed' THEN 'TAG_UNCONFIRMED'
        WHEN g.stage <> s.source_stage THEN 'TAG_STAGE_MISMATCH' END AS tag_code,
   CASE WHEN s.u = 'unknown' OR coalesce({sql_case(UNIT_SPELLINGS, 'g.raw_unit', 'NULL')}, s.u) <> s.u
             OR coalesce(g.canonical_unit, s.u) = 'unknown' THEN 'UNIT_UNCONFIRMED'
        WHEN g.conversion = 'ppm_mass_to_mg_kg' AND (s.u <> 'ppm' OR g.canonical_unit <> 'mg/kg') THEN 'UNIT_CONVERSION_INVALID'
        WHEN g.conversion = 'mass_percent_to_mg_kg' AND (s.u <> 'mass%' OR g.canonical_unit <> 'mg/kg') THEN 'UNIT_CONVERSION_INVALID'
        WHEN coalesce(g.conversion, 'none') = 'none' AND s.u <> coalesce(g.canonical_unit, s.u) THEN 'UNIT_HEADER_OVERRIDDEN' END AS unit_code
 FROM (SELECT *, {sql_case(UNIT_SPELLINGS, 'raw_unit', "'unknown'")} AS u FROM src) s
 LEFT JOIN tags g ON g.raw_name = s.raw_name)
"""


def audited_parts(t):
    units = F.array(*[F.lit(u) for u in ["% масс.", "ppm", "МПа", "°C", "furlong"]])
    src = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 == 0, "avt:?")
        .otherwise(F.concat(F.lit("avt:"), "p_brand")).alias("raw_name"),
        F.element_at(units, (F.lit(1) + F.col("p_size") % 5).cast("int")).alias("raw_unit"),
        F.lit("avt").alias("source_stage"),
        F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("source_ref"),
    )
    return c.mapping_audit(src, brand_tags(t))


@query("mapping_audit", f"""
WITH {TAGS_SQL}, {AUDIT_IN}, {AUDIT_SQL}
SELECT p_partkey, signal_id, unit, conversion,
   CASE WHEN tag_code IS NOT NULL OR unit_code IN ('UNIT_UNCONFIRMED', 'UNIT_CONVERSION_INVALID') THEN 'invalid' ELSE 'valid' END AS mapping_validity,
   concat_ws(';', tag_code, unit_code) AS codes
FROM audit""")
def mapping_audit(t):
    return audited_parts(t).select(
        "p_partkey", "signal_id", "unit", "conversion", "mapping_validity",
        F.array_join(F.transform("mapping_issues", lambda i: i["code"]), ";").alias("codes"),
    )


@query("issue_log", f"""
WITH {TAGS_SQL}, {AUDIT_IN}, {AUDIT_SQL}
SELECT 'part#' || p_partkey AS source_ref, code, 'warning' AS severity, signal_id FROM (
  SELECT p_partkey, signal_id, tag_code AS code FROM audit WHERE tag_code IS NOT NULL
  UNION ALL SELECT p_partkey, signal_id, unit_code FROM audit WHERE unit_code IS NOT NULL)
UNION ALL SELECT 'events#' || event_id, 'INVALID_VALUE', 'warning', event_type FROM events WHERE event_id % 19 = 0""")
def issue_log(t):
    mapped = c.issue_rows(audited_parts(t), "mapping_issues", "source_ref", "signal_id").drop("detail")
    return mapped.unionByName(value_issues(t))


def dirty_events(t):
    """Events as they would leave a text export: a few broken values and times."""
    return t.events.select(
        "event_id",
        "event_type",
        F.when(F.col("event_id") % 19 == 0, "Pt Created")
        .otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(F.col("event_id") % 17 == 0, "broken")
        .otherwise(F.col("ts").cast("string")).alias("time_text"),
    )


def value_issues(t):
    coerced = c.coerce_values(dirty_events(t), "value_text", "time_text", "Europe/Moscow")
    return (
        coerced.select("event_id", "event_type", F.explode("issue_codes").alias("code"))
        .filter(F.col("code") == "INVALID_VALUE")
        .select(
            F.concat(F.lit("events#"), F.col("event_id").cast("string")).alias("source_ref"),
            "code",
            F.lit("warning").alias("severity"),
            F.col("event_type").alias("signal_id"),
        )
    )


@query("coerce_numeric", """
SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN value END AS value,
  CASE WHEN event_id % 17 <> 0 THEN ts - INTERVAL 3 HOUR END AS measured_at,
  concat_ws(';', CASE WHEN event_id % 17 = 0 THEN 'INVALID_TIMESTAMP' END,
                 CASE WHEN event_id % 19 = 0 THEN 'INVALID_VALUE' END) AS codes FROM events""")
def coerce_numeric(t):
    return c.coerce_values(dirty_events(t), "value_text", "time_text", "Europe/Moscow").select(
        "event_id", "value", "measured_at", F.array_join("issue_codes", ";").alias("codes")
    )


@query("convert_unit", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice * 10000.0 ELSE p_retailprice END AS value FROM part""")
def convert_unit(t):
    conversion = (
        F.when(F.col("p_size") % 3 == 0, "mass_percent_to_mg_kg")
        .when(F.col("p_size") % 3 == 1, "ppm_mass_to_mg_kg").otherwise("none")
    )
    return t.part.select("p_partkey", c.convert_unit(F.col("p_retailprice"), conversion).alias("value"))


def sentinel_rules(t):
    """Each signal's own largest reading stands in for the instrument code."""
    return telemetry(t).groupBy("signal_id").agg(F.max("value").alias("exact_value")).select(
        "signal_id", "exact_value", F.lit("CONFIRMED_SENTINEL").alias("issue_code"),
        F.lit("confirmed instrument code").alias("detail"),
    )


@query("mask_sentinel", with_views("tele", """
SELECT signal_id, count(*) AS n, count(value) - count(CASE WHEN value = top THEN 1 END) AS kept,
  count(CASE WHEN value = top THEN 1 END) AS masked,
  'confirmed instrument code rows_masked=' || count(CASE WHEN value = top THEN 1 END) AS detail
FROM (SELECT *, max(value) OVER (PARTITION BY signal_id) AS top FROM tele) GROUP BY signal_id"""))
def mask_sentinel(t):
    rows = telemetry(t)
    clean, issues = c.mask_sentinels(rows, sentinel_rules(t), "events")
    before = rows.groupBy("signal_id").agg(F.count("value").alias("had"))
    after = clean.groupBy("signal_id").agg(F.count("*").alias("n"), F.count("value").alias("kept"))
    return (
        after.join(before, "signal_id")
        .join(issues.select("signal_id", "detail"), "signal_id")
        .select("signal_id", "n", "kept", (F.col("had") - F.col("kept")).alias("masked"), "detail")
    )


@query("observation_id", """
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS observation_id
FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('events#' || event_id)) AS h FROM events)""")
def observation_id(t):
    return t.events.select(
        "event_id",
        c.observation_uuid(F.concat(F.lit("events#"), F.col("event_id").cast("string"))).alias("observation_id"),
    )


SECTION_SQL = """CASE WHEN p_partkey % 7 = 0 THEN p_name || '.'
  WHEN p_partkey % 5 = 0 THEN 'Установка ''' || p_brand || '''.'
  ELSE 'Установка ''' || p_brand || '''. Точка отбора ''' || p_type || '''. Продукт' END"""


@query("normalize_section", f"""
SELECT p_partkey, CASE WHEN u = '' THEN txt WHEN pt = '' THEN u ELSE u || '.' || pt END AS section FROM (
 SELECT p_partkey, txt, regexp_extract(txt, 'Установка\\s+''([^'']+)''', 1) AS u,
        regexp_extract(txt, 'Точка отбора\\s+''([^'']+)''', 1) AS pt
 FROM (SELECT p_partkey, replace(rtrim({SECTION_SQL}, '.'), '..', '.') AS txt FROM part))""")
def normalize_section(t):
    section = (
        F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(".")))
        .when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Установка '"), "p_brand", F.lit("'.")))
        .otherwise(F.concat(F.lit("Установка '"), "p_brand", F.lit("'. Точка отбора '"), "p_type", F.lit("'. Продукт")))
    )
    return t.part.select("p_partkey", section.alias("s")).select(
        "p_partkey", c.normalize_section(F.col("s")).alias("section")
    )


@query("feature_order", with_views("tele", "SELECT DISTINCT signal_id FROM tele"))
def feature_order(t):
    return telemetry(t).select("signal_id").distinct().orderBy("signal_id")


@query("eligible_targets", with_views("pak", """
SELECT 'duplicate_times' AS rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT entity, measured_at FROM pak GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'published_before_sampling', count(*) FROM pak WHERE available_at < measured_at
UNION ALL SELECT 'eligible', count(*) FROM pak"""))
def eligible_targets(t):
    rows = analyser(t)
    return c.target_violations(rows, ["entity"]).unionByName(
        rows.agg(F.count("*").alias("n")).select(F.lit("eligible").alias("rule"), "n")
    )


@query("exclude_confirmed", with_views("lims", """
SELECT count(*) FILTER (value <= 300) AS kept, count(*) FILTER (value > 300) AS excluded,
  round(sum(value) FILTER (value > 300), 6) AS excluded_sum FROM lims"""))
def exclude_confirmed(t):
    lab = c.eligible(quality(t), "lims")
    confirmed = lab.filter(F.col("value") > 300).select("observation_id").distinct()
    kept, out = exclude_ids(lab, confirmed)
    tagged = kept.select("value", F.lit(True).alias("kept")).unionByName(
        out.select("value", F.lit(False).alias("kept"))
    )
    return tagged.agg(
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("excluded"),
        F.round(F.sum(F.when(~F.col("kept"), F.col("value"))), 6).alias("excluded_sum"),
    )


def exclude_ids(rows, confirmed):
    """Rows without the confirmed outliers, and the outliers for the report."""
    return (
        rows.join(confirmed, "observation_id", "left_anti"),
        rows.join(confirmed, "observation_id", "left_semi"),
    )


@query("observation_contract", with_views("quality", """
SELECT rule, count(*) AS n FROM (
  SELECT 'available_before_measured' AS rule FROM quality WHERE CAST(observation_id AS BIGINT) % 23 = 0
  UNION ALL SELECT 'valid_without_value' FROM quality WHERE CAST(observation_id AS BIGINT) % 29 = 0 AND CAST(observation_id AS BIGINT) % 50 <> 0
  UNION ALL SELECT 'missing_with_value' FROM quality WHERE CAST(observation_id AS BIGINT) % 50 = 0 AND CAST(observation_id AS BIGINT) % 29 <> 0)
GROUP BY rule"""))
def observation_contract(t):
    n = F.col("observation_id").cast("long")
    rows = quality(t).select(
        "observation_id", "measured_at",
        F.when(n % 23 == 0, F.col("measured_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("available_at")).alias("available_at"),
        F.when(n % 29 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(n % 50 == 0, "missing").otherwise("valid").alias("validity"),
    )
    return c.observation_contract(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("normalize_formula", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(translate(regexp_replace(text, '^\s+|\s+$', '', 'g'), '−×', '-*'),
  '(\d),(\d)', '\1.\2', 'g'), '(\d),(\d)', '\1.\2', 'g')) AS digest FROM documents""")
def normalize_formula(t):
    return t.documents.select("doc_id", F.md5(c.normalize_formula(F.col("text"))).alias("digest"))


@query("formula_overlay", """
SELECT p.p_partkey, coalesce(s.s_name, p.p_name) AS formula, s.s_name IS NOT NULL AS corrected
FROM part p LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s.s_suppkey = p.p_partkey""")
def formula_overlay(t):
    raw = t.part.select("p_partkey", F.col("p_name").alias("formula"))
    fix = t.supplier.filter(F.col("s_acctbal") > 5000).select(
        F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("formula")
    )
    return c.overlay_formulas(raw, fix, "p_partkey")


@query("lab_inventory", """
SELECT p_type AS sampling_point, trim(p_name) AS parameter, min(p_partkey) AS first_row, count(*) AS n
FROM part WHERE trim(p_name) <> '' GROUP BY 1, 2""")
def lab_inventory(t):
    """Long form of the point -> parameters list, so a crowded point is never one group."""
    return (
        t.part.select(F.col("p_type").alias("sampling_point"), F.trim("p_name").alias("parameter"), "p_partkey")
        .filter(F.col("parameter") != "")
        .groupBy("sampling_point", "parameter")
        .agg(F.min("p_partkey").alias("first_row"), F.count("*").alias("n"))
    )


GAS = ("avt:Brand#2", "avt:Brand#22", "avt:Brand#11", "avt:Brand#99")


@query("gas_context", f"""
WITH {TAGS_SQL}
SELECT o.pos AS position, g.signal_id, g.canonical_unit AS unit, g.stage
FROM (SELECT unnest({sql_list(GAS)}) AS raw_name, unnest([0, 1, 2, 3]) AS pos) o JOIN tags g ON g.raw_name = o.raw_name""")
def gas_context(t):
    wanted = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("raw_name")) for i, n in enumerate(GAS)])
    return (
        brand_tags(t)
        .withColumn("_w", F.filter(wanted, lambda w: w["raw_name"] == F.col("raw_name")))
        .filter(F.size("_w") == 1)
        .select(
            F.col("_w")[0]["position"].alias("position"), "signal_id",
            F.col("canonical_unit").alias("unit"),
            F.when(F.col("stage") == "avt", F.col("stage")).otherwise(
                F.raise_error(F.lit("context signal of another stage")).cast("string")).alias("stage"),
        )
    )


CODES = ["QUALITY_LIMIT", "COMPONENT_STOCK", "NOT_LISTED", "OUT_OF_DOMAIN", "ADDITIVE_STOCK"]


@query("label_dim_lookup", f"""
SELECT o_orderkey, coalesce({sql_case(REASON_TEXT, 'a', f"'{UNKNOWN_REASON}'")} ||
   CASE WHEN {sql_case(REASON_TEXT, 'a', f"'{UNKNOWN_REASON}'")} = {sql_case(REASON_TEXT, 'b', f"'{UNKNOWN_REASON}'")} THEN ''
        ELSE '; ' || {sql_case(REASON_TEXT, 'b', f"'{UNKNOWN_REASON}'")} END) AS reasons,
   {sql_case(METRIC_TEXT, 'm', 'm')} AS metric
FROM (SELECT o_orderkey, ({sql_list(CODES)})[1 + o_orderkey % 5] AS a, ({sql_list(CODES)})[1 + o_custkey % 5] AS b,
   (['sulfur', 't95', 'density'])[1 + o_orderkey % 3] AS m FROM orders)""")
def label_dim_lookup(t):
    codes = F.array(*[F.lit(x) for x in CODES])
    pick = lambda k: F.element_at(codes, (F.lit(1) + F.col(k) % 5).cast("int"))
    metric = F.element_at(F.array(F.lit("sulfur"), F.lit("t95"), F.lit("density")),
                          (F.lit(1) + F.col("o_orderkey") % 3).cast("int"))
    texts = F.array_distinct(F.transform(
        F.array(pick("o_orderkey"), pick("o_custkey")), lambda x: lookup(REASON_TEXT, x, F.lit(UNKNOWN_REASON))))
    return t.orders.select(
        "o_orderkey",
        F.when(F.size(texts) > 0, F.array_join(texts, "; ")).otherwise(NO_REASON).alias("reasons"),
        lookup(METRIC_TEXT, metric, metric).alias("metric"),
    )


@query("collapse_duplicates", """
SELECT user_id // 150 AS entity, event_type AS signal_id, time_bucket(INTERVAL 60 MINUTE, ts) AS ts,
  CASE WHEN min(value) = max(value) THEN min(value) END AS value, coalesce(min(value) <> max(value), FALSE) AS conflict
FROM events GROUP BY 1, 2, 3""")
def collapse_duplicates(t):
    rows = t.events.select(plant_of(), F.col("event_type").alias("signal_id"), floor_minutes("ts", 60).alias("ts"), "value")
    return c.collapse_duplicates(rows, ["entity", "signal_id", "ts"])


def hourly_quality(t):
    return hourly(quality(t))


def hourly(q):
    """Times cut to the hour and values made coarse, so that copies and conflicts occur."""
    return q.withColumn("measured_at", floor_minutes("measured_at", 60)).withColumn(
        "available_at", floor_minutes("available_at", 60)
    ).withColumn("value", F.floor(F.col("value") / 40))


HOURQ = """
hq AS (SELECT * REPLACE (time_bucket(INTERVAL 60 MINUTE, measured_at) AS measured_at,
  time_bucket(INTERVAL 60 MINUTE, available_at) AS available_at, CAST(floor(value / 40) AS BIGINT) AS value) FROM quality)"""
DEDUPE = """
dd AS (SELECT entity, source, signal_id, measured_at, count(*) AS refs,
    count(DISTINCT (coalesce(value, -1), unit, available_at, validity)) > 1 AS conflict,
    arg_min(observation_id, source_ref) AS observation_id, arg_min(unit, source_ref) AS unit,
    arg_min(value, source_ref) AS v, arg_min(validity, source_ref) AS val
  FROM hq GROUP BY 1, 2, 3, 4)"""


@query("dedupe_quality", with_views("quality", f"""
WITH {HOURQ}, {DEDUPE}
SELECT entity, source, signal_id, measured_at, observation_id, unit, CASE WHEN NOT conflict THEN v END AS value,
  CASE WHEN conflict THEN 'conflict' ELSE val END AS validity, refs FROM dd"""))
def dedupe_quality(t):
    return c.dedupe_quality(hourly_quality(t), ["entity", *c.QUALITY_KEY]).select(
        "entity", "source", "signal_id", "measured_at", "observation_id", "unit", "value", "validity", "refs"
    )


@query("dedupe_conflict_refs", with_views("quality", f"""
WITH {HOURQ}, {DEDUPE}
SELECT h.entity, h.source, h.signal_id, h.measured_at, h.observation_id, h.source_ref
FROM hq h JOIN dd USING (entity, source, signal_id, measured_at) WHERE dd.conflict"""))
def dedupe_conflict_refs(t):
    return c.conflict_refs(hourly_quality(t), ["entity", *c.QUALITY_KEY])


@query("union_sources", with_views("quality", """
SELECT source, count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT * FROM quality WHERE source = 'pak' UNION ALL SELECT * FROM quality WHERE source = 'lims') GROUP BY source"""))
def union_sources(t):
    q = quality(t)
    both = q.filter(F.col("source") == "pak").unionByName(q.filter(F.col("source") == "lims"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("period_overlap", with_views("quality, tele".replace(",", ""), """
SELECT least((SELECT max(ts) FROM tele), (SELECT max(available_at) FROM quality)) AS as_of,
       greatest((SELECT min(ts) FROM tele), (SELECT min(measured_at) FROM quality)) AS common_start"""))
def period_overlap(t):
    spans = (
        telemetry(t).select(F.lit("tele").alias("kind"), F.col("ts").alias("t0"), F.col("ts").alias("t1"))
        .unionByName(quality(t).select(
            F.lit("quality").alias("kind"), F.col("measured_at").alias("t0"), F.col("available_at").alias("t1")))
        .groupBy("kind").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    )
    return spans.agg(F.min("t1").alias("as_of"), F.max("t0").alias("common_start"))


@query("ordered_output", with_views("pak", """
SELECT measured_at, signal_id, observation_id, value FROM pak ORDER BY 1, 2, 3"""))
def ordered_output(t):
    return analyser(t).select("measured_at", "signal_id", "observation_id", "value").orderBy(
        "measured_at", "signal_id", "observation_id"
    )


@query("distinct_doses", """
SELECT c_custkey, array_to_string(list_sort(list_distinct([0.0::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.03::DOUBLE, round((c_custkey % 7) * 0.005::DOUBLE, 3)])), ',') AS doses FROM customer""")
def distinct_doses(t):
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.round(i * 0.01, 3))
    wanted = F.array(F.round((F.col("c_custkey") % 7) * F.lit(0.005), 3))
    doses = F.array_sort(F.array_union(grid, wanted))
    return t.customer.select(
        "c_custkey", F.array_join(F.transform(doses, lambda d: d.cast("string")), ",").alias("doses")
    )
