"""Scenario tables: JSON files, and two-component scenarios made of neighbouring parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ESTIMATE = "struct<value:double,lower:double,upper:double,unit:string>"
SCENARIO_SCHEMA = f"""
  id string, mode string, total_mass_t double, product_grade string,
  current_blend_mass_fractions map<string,double>, current_additive_mass_fraction double,
  constraints array<struct<id:string,metric:string,lower:double,upper:double,unit:string,
                           use_upper_estimate:boolean,use_lower_estimate:boolean>>,
  blend_components array<struct<id:string,sulfur:{ESTIMATE},density:{ESTIMATE},t95:{ESTIMATE},cetane_number:{ESTIMATE},
                                available_mass_t:double,cost_proxy_per_t:double,risk_index:double>>,
  cetane_additive struct<id:string,max_mass_fraction:double,fraction_step:double,available_mass_t:double,
                         cost_proxy_per_t:double,response_curve:array<struct<mass_fraction:double,cetane_gain:double>>>,
  active_criteria array<string>, materiality_thresholds map<string,double>, require_upper_bound boolean,
  action_cooldown_minutes int
"""


def scan_scenarios(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Scenario documents as rows (a file each, or JSON lines); the schema is given, nothing is inferred."""
    return spark.read.schema(SCENARIO_SCHEMA).json(path, multiLine=one_per_file)


def scenario_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Scenario, constraint, component and curve tables."""
    key = F.col("id").alias("scenario_id")
    return {
        "scenario": docs.select(key, "mode", "total_mass_t", "require_upper_bound", "action_cooldown_minutes"),
        "constraint": docs.select(key, F.explode_outer("constraints").alias("c")).select("scenario_id", "c.*"),
        "component": docs.select(key, F.explode_outer("blend_components").alias("c")).select("scenario_id", "c.*"),
        "additive_point": docs.select(key, F.explode_outer("cetane_additive.response_curve").alias("p")).select(
            "scenario_id", F.col("p.mass_fraction").alias("dose"), F.col("p.cetane_gain").alias("gain")),
    }


def blend_rows(docs: DataFrame) -> DataFrame:
    """Documents in the shape the blend operators read: one row with short arrays."""
    components = F.transform("blend_components", lambda c: F.struct(
        c["id"].alias("id"),
        c["sulfur"]["value"].alias("sulfur_value"), c["sulfur"]["upper"].alias("sulfur_upper"),
        c["t95"]["value"].alias("t95_value"), c["t95"]["upper"].alias("t95_upper"),
        c["cetane_number"]["value"].alias("cetane_value"), c["cetane_number"]["lower"].alias("cetane_lower"),
        c["density"]["value"].alias("density_value"), c["density"]["lower"].alias("density_lower"),
        c["density"]["upper"].alias("density_upper"),
        c["available_mass_t"].alias("stock"), c["cost_proxy_per_t"].alias("cost"), c["risk_index"].alias("risk")))
    constraints = F.transform("constraints", lambda c: F.struct(
        c["id"].alias("id"), c["metric"].alias("metric"), c["lower"].alias("lower"), c["upper"].alias("upper"),
        c["unit"].alias("unit"), c["use_upper_estimate"].alias("use_upper"),
        F.coalesce(c["use_lower_estimate"], F.lit(False)).alias("use_lower")))
    a = F.col("cetane_additive")
    additive = F.when(a.isNotNull(), F.struct(
        a["max_mass_fraction"].alias("max_fraction"), a["fraction_step"].alias("step"),
        a["available_mass_t"].alias("stock"), a["cost_proxy_per_t"].alias("cost"),
        F.transform(a["response_curve"], lambda p: F.struct(
            p["mass_fraction"].alias("dose"), p["cetane_gain"].alias("gain"))).alias("curve")))
    threshold = lambda n: F.coalesce(F.try_element_at("materiality_thresholds", F.lit(n)), F.lit(0.0))
    return docs.select(
        F.col("id").alias("scenario_id"), components.alias("components"), constraints.alias("constraints"),
        additive.alias("additive"), F.col("total_mass_t").alias("total_mass"),
        F.transform("blend_components", lambda c: F.try_element_at("current_blend_mass_fractions", c["id"])).alias("current_fractions"),
        F.coalesce("current_additive_mass_fraction", F.lit(0.0)).alias("current_dose"),
        F.col("product_grade").alias("grade"), F.coalesce("require_upper_bound", F.lit(False)).alias("require_upper"),
        threshold("risk_index").alias("min_risk"), threshold("throughput").alias("min_throughput"),
        threshold("cost_proxy").alias("min_cost"),
    )


# Fixed values - the additive response curve of the blend scenarios.
CURVE = ((0.0, 0.0), (0.01, 3.0), (0.02, 5.0), (0.03, 6.5))
LIMITS = (("blend_sulfur", "sulfur", None, 10.0, "mg/kg", True, False),
          ("blend_t95", "t95", None, 360.0, "degC", True, False),
          ("blend_cetane", "cetane_number", 51.0, None, "cetane_number", False, True))


def curve_literal():
    return F.array(*[F.struct(F.lit(d).alias("dose"), F.lit(g).alias("gain")) for d, g in CURVE])


def limits_literal(rows=LIMITS):
    none = F.lit(None).cast("double")
    num = lambda v: none if v is None else F.lit(float(v))
    return F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(m).alias("metric"), num(lo).alias("lower"), num(hi).alias("upper"),
                 F.lit(u).alias("unit"), F.lit(up).alias("use_upper"), F.lit(low).alias("use_lower"))
        for i, m, lo, hi, u, up, low in rows])


def part_properties(side: str):
    """Passport of a part as component A (clean) or B (sulfurous)."""
    key, size = F.col(f"{side}.p_partkey"), F.col(f"{side}.p_size")
    s0, s1 = (3.0, 0.11) if side == "a" else (8.0, 0.4)
    t0, c0 = (338.0, 48.0) if side == "a" else (352.0, 46.0)
    k0, k1 = (18.3, 1.9) if side == "a" else (12.7, 0.9)
    sulfur, t95 = size * s1 + s0, (key % 9) * 2.3 + t0
    cetane = F.when(size % 19 != 0, (key % 5) * 0.9 + c0)
    density = (key % 13) * 1.7 + 822.0
    return F.struct(
        F.lit(side.upper()).alias("id"), sulfur.alias("sulfur_value"),
        F.when(size % 17 != 0, sulfur * 1.08).alias("sulfur_upper"),
        t95.alias("t95_value"), (t95 + 2.1).alias("t95_upper"),
        cetane.alias("cetane_value"), (cetane - 0.45).alias("cetane_lower"),
        density.alias("density_value"), (density - 1.5).alias("density_lower"), (density + 1.5).alias("density_upper"),
        (size * k1 + k0).alias("stock"), (F.col(f"{side}.p_retailprice") / 1000.0).alias("cost"), ((key % 10) / 10.0).alias("risk"))


def part_scenarios(t) -> DataFrame:
    """One scenario per part, blended with the next part."""
    a = t.part.alias("a")
    b = t.part.select((F.col("p_partkey") - 1).alias("prev"), "*").alias("b")
    return a.join(b, F.col("a.p_partkey") == F.col("b.prev")).select(
        F.col("a.p_partkey").alias("scenario_id"),
        F.array(part_properties("a"), part_properties("b")).alias("components"),
        limits_literal().alias("constraints"),
        F.struct(F.lit(0.03).alias("max_fraction"), F.lit(0.01).alias("step"),
                 ((F.col("a.p_size") % 3) * 0.3 + 2.5).alias("stock"), F.lit(100.0).alias("cost"), curve_literal().alias("curve")).alias("additive"),
        F.lit(100.0).alias("total_mass"), F.array(F.lit(0.693), F.lit(0.297)).alias("current_fractions"),
        F.lit(0.01).alias("current_dose"), F.lit("summer_diesel").alias("grade"), F.lit(True).alias("require_upper"),
        F.lit(0.02).alias("min_risk"), F.lit(0.02).alias("min_throughput"), F.lit(0.02).alias("min_cost"),
    )


def _side_sql(s: str) -> str:
    s0, s1 = ("3.0", "0.11") if s == "a" else ("8.0", "0.4")
    t0, c0 = ("338.0", "48.0") if s == "a" else ("352.0", "46.0")
    k0, k1 = ("18.3", "1.9") if s == "a" else ("12.7", "0.9")
    d = "::DOUBLE"
    return f"""
  {s}.p_size * {s1}{d} + {s0}{d} AS {s}s, CASE WHEN {s}.p_size % 17 <> 0 THEN ({s}.p_size * {s1}{d} + {s0}{d}) * 1.08{d} END AS {s}su,
  ({s}.p_partkey % 9) * 2.3{d} + {t0}{d} AS {s}t, ({s}.p_partkey % 9) * 2.3{d} + {t0}{d} + 2.1{d} AS {s}tu,
  CASE WHEN {s}.p_size % 19 <> 0 THEN ({s}.p_partkey % 5) * 0.9{d} + {c0}{d} END AS {s}c,
  CASE WHEN {s}.p_size % 19 <> 0 THEN ({s}.p_partkey % 5) * 0.9{d} + {c0}{d} - 0.45{d} END AS {s}cl,
  ({s}.p_partkey % 13) * 1.7{d} + 822.0{d} AS {s}d, {s}.p_size * {k1}{d} + {k0}{d} AS {s}k, {s}.p_retailprice / 1000.0{d} AS {s}cost, ({s}.p_partkey % 10) / 10.0{d} AS {s}r"""


SCENARIO_SQL = f"""
scen AS (SELECT a.p_partkey AS scenario_id, {_side_sql('a')}, {_side_sql('b')}, (a.p_size % 3) * 0.3::DOUBLE + 2.5::DOUBLE AS addk
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
cand AS (SELECT *, 0 AS position, 0.01::DOUBLE AS dose, 0.693::DOUBLE AS fa, 0.297::DOUBLE AS fb, 'hold' AS candidate_id FROM scen
  UNION ALL SELECT *, 'blend:A=' || printf('%.3f', round(fa * 1000) / 1000) || ',B=' || printf('%.3f', round(fb * 1000) / 1000) || ',additive=' || printf('%.3f', round(dose * 1000) / 1000) FROM (
   SELECT scen.*, 1 + i * 21 + j AS position, i * 0.01::DOUBLE AS dose, (1.0::DOUBLE - i * 0.01::DOUBLE) * (1.0::DOUBLE - j / 20.0::DOUBLE) AS fa,
     (1.0::DOUBLE - i * 0.01::DOUBLE) * (j / 20.0::DOUBLE) AS fb FROM scen, (SELECT unnest([0, 1, 2, 3]) AS i), (SELECT unnest(range(21)) AS j))
   WHERE NOT (abs(dose - 0.01) <= 1e-9 AND abs(fa - 0.693) <= 1e-9 AND abs(fb - 0.297) <= 1e-9)),
gain AS (SELECT *, CASE WHEN dose = 0 THEN 0.0 WHEN dose <= 0.01::DOUBLE THEN 0 + (dose - 0) / 0.01::DOUBLE * 3.0
   WHEN dose <= 0.02::DOUBLE THEN 3 + (dose - 0.01::DOUBLE) / (0.02::DOUBLE - 0.01::DOUBLE) * 2 ELSE 5 + (dose - 0.02::DOUBLE) / (0.03::DOUBLE - 0.02::DOUBLE) * 1.5 END AS gain FROM cand),
met AS (SELECT *, fa * \"as\" + fb * bs AS sulfur_value,
   CASE WHEN (fa > 0 AND asu IS NULL) OR (fb > 0 AND bsu IS NULL) THEN NULL ELSE fa * coalesce(asu, 0) + fb * coalesce(bsu, 0) END AS sulfur_upper,
   (fa * at_ + fb * bt) / (fa + fb) AS t95_value, (fa * atu + fb * btu) / (fa + fb) AS t95_upper,
   CASE WHEN (fa > 0 AND ac IS NULL) OR (fb > 0 AND bc IS NULL) THEN NULL ELSE (fa * coalesce(ac, 0) + fb * coalesce(bc, 0)) / (fa + fb) + gain END AS cetane_value,
   CASE WHEN (fa > 0 AND acl IS NULL) OR (fb > 0 AND bcl IS NULL) THEN NULL ELSE (fa * coalesce(acl, 0) + fb * coalesce(bcl, 0)) / (fa + fb) + gain END AS cetane_lower,
   CASE WHEN dose = 0 THEN 1.0 / (CASE WHEN fa > 0 THEN fa / ad ELSE 0 END + CASE WHEN fb > 0 THEN fb / bd ELSE 0 END) END AS density_value,
   (fa * ar + fb * br) / (fa + fb) AS risk_index, 100.0::DOUBLE AS throughput, fa * acost + fb * bcost + dose * 100.0::DOUBLE AS cost_proxy,
   abs(fa - 0.693) + abs(fb - 0.297) + abs(dose - 0.01) AS change_size FROM gain),
chk AS (SELECT *, sulfur_value IS NULL AS miss, cetane_value IS NULL OR cetane_lower IS NULL AS unass, sulfur_upper IS NULL AS nounc,
   CASE WHEN sulfur_upper IS NULL THEN 'UNCERTAINTY_UNAVAILABLE' WHEN sulfur_upper > 10 + 1e-10 THEN 'QUALITY_LIMIT' ELSE 'OK' END AS c1,
   CASE WHEN t95_upper > 360 + 1e-10 THEN 'QUALITY_LIMIT' ELSE 'OK' END AS c2,
   CASE WHEN cetane_lower IS NULL THEN 'UNCERTAINTY_UNAVAILABLE' WHEN cetane_lower < 51 - 1e-10 THEN 'QUALITY_LIMIT' ELSE 'OK' END AS c3,
   CASE WHEN fa * 100.0 <= ak THEN 'OK' ELSE 'COMPONENT_STOCK' END AS c4, CASE WHEN fb * 100.0 <= bk THEN 'OK' ELSE 'COMPONENT_STOCK' END AS c5,
   CASE WHEN dose <= 0.03 + 1e-9 THEN 'OK' ELSE 'ADDITIVE_LIMIT' END AS c6, CASE WHEN dose * 100 <= addk + 1e-9 THEN 'OK' ELSE 'ADDITIVE_STOCK' END AS c7 FROM met),
ev AS (SELECT *, list_filter(list_concat(CASE WHEN unass THEN ['UNASSESSED_REQUIRED_PROPERTY'] WHEN nounc THEN ['UNCERTAINTY_UNAVAILABLE'] ELSE [] END, [c1, c2, c3, c4, c5, c6, c7]), lambda x: x <> 'OK') AS codes FROM chk),
evf AS MATERIALIZED (SELECT *, len(codes) = 0 AS feasible FROM ev)""".replace('\"as\"', '"as"').replace("at_", '"at"')
SCENARIO_SQL = SCENARIO_SQL.replace(" AS as,", ' AS "as",').replace(" AS at,", ' AS "at",')
