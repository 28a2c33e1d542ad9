"""Scans of exported text, prepared datasets, journal and cooldown.

The exports are written from the event table first, as text files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.plans.frames import scored
from assaylake.plans.registry import query
from assaylake.session import materialise, shared_dir
from assaylake.sources import journal as jr
from assaylake.sources import prepared as pr
from assaylake.sources import readers as rd
from assaylake.sources.adapters import quality, telemetry, with_views


def tag_dim(t):
    rows = [
        ("click", "avt:click", "avt", None, "unknown", "none", "confirmed"), ("signup", "avt:signup", "avt", None, "unknown", "none", "confirmed"),
        ("view", "avt:view", "avt", None, "unknown", "none", "unconfirmed"),
        ("ht:sulfur", "24-2000:Sulfur", "ht", "ppm", "mg/kg", "ppm_mass_to_mg_kg", "confirmed"),
        ("ht:density", "24-2000:Density", "ht", "кг/м3", "kg/m3", "none", "confirmed"),
        ("ht:sulfur", "LIMS:24-2000.1:Sulfur", "ht", "мг/кг", "mg/kg", "none", "confirmed"),
        ("ht:density", "LIMS:24-2000.1:Density", "ht", "кг/м3", "kg/m3", "none", "confirmed"),
    ]
    return rd.checked_tags(t.spark.createDataFrame(
        rows, "signal_id string, raw_name string, stage string, raw_unit string, canonical_unit string, conversion string, mapping_status string"))


def civil(c="ts"):
    return (F.col(c) + F.expr("INTERVAL 3 HOURS")).cast("string")


def telemetry_export(t) -> str:
    path = shared_dir(t.spark, "telemetry-export")
    value = lambda k: F.when(F.col("event_type") == k, F.col("value").cast("string")).alias(k)
    t.events.filter(F.col("event_type").isin("click", "signup", "view")).select(
        F.col("event_id").alias("Unnamed: 0"), F.when(F.col("event_id") % 53 == 0, "broken").otherwise(civil()).alias("date"),
        value("click"), value("signup"), value("view")).write.csv(path, header=True)
    return path


@query("scan_telemetry", """
SELECT ts, CASE s WHEN 'view' THEN 'view' ELSE s END AS signal_id, CASE WHEN event_type = s THEN value END AS value
FROM events, (SELECT unnest(['click', 'signup', 'view']) AS s) WHERE event_type IN ('click', 'signup', 'view') AND event_id % 53 <> 0""")
def scan_telemetry(t):
    return rd.scan_telemetry(t.spark, telemetry_export(t), "avt", tag_dim(t))[0].select("ts", "signal_id", "value")


def sheet(t, kinds, header, offset):
    """A side-by-side export: each event fills the pair of its own kind."""
    path = shared_dir(t.spark, "sheet-export")
    names = [f"c{i + 1}" for i in range(2 * len(kinds))]
    n = F.col("event_id")
    text = F.when(n % 19 == 0, "Pt Created").otherwise(F.col("value").cast("string"))
    cells = []
    for i, k in enumerate(kinds):
        mine = F.col("event_type") == k
        cells += [F.when(mine, F.when(n % 53 == 0, "broken").otherwise(civil())).alias(names[2 * i]), F.when(mine, text).alias(names[2 * i + 1])]
    data = t.events.filter(F.col("event_type").isin(*kinds)).select((n + offset).alias("row_no"), *cells)
    top = t.spark.createDataFrame([(r, *line) for r, line in enumerate(header, start=1)], "row_no long, " + ", ".join(f"{c} string" for c in names))
    top.unionByName(data).write.csv(path, header=True)
    return t.spark.read.schema("row_no long, " + ", ".join(f"{c} string" for c in names)).csv(path, header=True, enforceSchema=True)


def analyser_sheet(t):
    return sheet(t, ["purchase", "error"], [("24-2000:Sulfur", None, "24-2000:Density", None), ("ppm", None, "кг/м3", None)], 3)


def lab_sheet(t):
    return sheet(t, ["purchase", "error"], [
        ("Установка '24-2000'. Точка отбора '1'. Продукт", None, None, None), ("Sulfur", None, "Density", None),
        ("мг/кг", None, "кг/м3", None), ("100", None, "100", None)], 5)


PAIR_SQL = """
SELECT {path} || '#row=' || (event_id + {off}) || CASE event_type WHEN 'purchase' THEN ';columns=1,2' ELSE ';columns=3,4' END AS source_ref,
  CASE event_type WHEN 'purchase' THEN 'ht:sulfur' ELSE 'ht:density' END AS signal_id, ts AS measured_at, ts + INTERVAL {delay} HOUR AS available_at,
  CASE WHEN event_id % 19 <> 0 THEN value END AS value, CASE event_type WHEN 'purchase' THEN 'mg/kg' ELSE 'kg/m3' END AS unit,
  CASE WHEN event_id % 19 = 0 THEN 'invalid' ELSE 'valid' END AS validity FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 53 <> 0"""


@query("scan_pair_table", PAIR_SQL.format(path="'analyser'", off=3, delay=0))
def scan_pair_table(t):
    out = rd.scan_pair_table(analyser_sheet(t), tag_dim(t), path="analyser")[0]
    return out.select("source_ref", "signal_id", "measured_at", "available_at", "value", "unit", "validity")


@query("scan_sectioned_pairs", PAIR_SQL.format(path="'laboratory'", off=5, delay=4))
def scan_sectioned_pairs(t):
    out = rd.scan_sectioned_pairs(lab_sheet(t), tag_dim(t), path="laboratory")[0]
    return out.select("source_ref", "signal_id", "measured_at", "available_at", "value", "unit", "validity")


@query("prepare_job", """
SELECT 'telemetry' AS table_name, count(*) * 3 AS row_count FROM events WHERE event_type IN ('click', 'signup', 'view') AND event_id % 53 <> 0
UNION ALL SELECT 'quality', count(*) * 2 FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 53 <> 0""")
def prepare_job(t):
    from assaylake.plans.prepare import prepare

    rules = t.spark.createDataFrame([("click", 307.0, "CONFIRMED_SENTINEL", "confirmed code")], "signal_id string, exact_value double, issue_code string, detail string")
    tables = prepare(t.spark, telemetry_path=telemetry_export(t), analyser_sheet=analyser_sheet(t), lab_sheet=lab_sheet(t), tags=tag_dim(t), rules=rules)
    target = pr.write_prepared(shared_dir(t.spark, "prepared"), {"telemetry": (tables["telemetry"], "ts"), "quality": (tables["quality"], "measured_at")},
                               {"telemetry": "signal_id"})
    return t.spark.read.parquet(f"{target}/manifest").select("table_name", "row_count")


@query("read_prepared", with_views("tele quality", """
SELECT 'telemetry' AS table_name, signal_id, count(*) AS n FROM tele GROUP BY 2 UNION ALL SELECT 'quality', signal_id, count(*) FROM quality GROUP BY 2"""))
def read_prepared(t):
    """Published once, read back and verified against its manifest."""
    tables = {"telemetry": (telemetry(t), "ts"), "quality": (quality(t), "measured_at")}
    root = shared_dir(t.spark, "prepared")
    target = pr.write_prepared(root, tables, {"telemetry": "signal_id"})
    back = pr.read_prepared(t.spark, target, {"telemetry": "ts", "quality": "measured_at"})
    count = lambda n: back[n].groupBy("signal_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "signal_id", "n")
    return count("telemetry").unionByName(count("quality"))


@query("write_evaluation", with_views("scored", "SELECT split, count(*) AS n, round(avg(abs(y - baseline)), 6) AS mae FROM scored GROUP BY 1"))
def write_evaluation(t):
    rows = scored(t).select("observation_id", "as_of", "split", "y", "baseline", (F.col("y") - F.col("baseline")).alias("residual"))
    path = shared_dir(t.spark, "evaluation")
    pr.write_evaluation(path, rows.agg(F.count("*").alias("n"), F.avg(F.abs("residual")).alias("mae")), rows)
    return t.spark.read.parquet(f"{path}/residuals").groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("residual")), 6).alias("mae"))


def run_statuses(t):
    """Orders as runs: every run started; F completed, P failed, O never finished."""
    final = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"),
        F.explode(F.array_compact(F.array(F.lit("started"), final))).alias("status"))


@query("journal_list", "SELECT o_orderkey AS run_id, o_orderdate AS at, 'completed' AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY 2 DESC, 1")
def journal_list(t):
    return jr.completed_runs(run_statuses(t))


@query("journal_recover", "SELECT o_orderkey AS run_id, o_orderdate AS at, 'interrupted' AS status FROM orders WHERE o_orderstatus = 'O'")
def journal_recover(t):
    return jr.interrupted_runs(run_statuses(t))


@query("journal_append", with_views("hours", "SELECT CAST(as_of AS DATE) AS day, count(*) AS n FROM hours GROUP BY 1"))
def journal_append(t):
    from assaylake.plans.catalog_models import replayed

    path = shared_dir(t.spark, "journal")
    decisions = materialise(replayed(t), "replayed")
    # The second call stands for a job that runs again after its commit.
    for _ in range(2):
        jr.append(path, decisions, "replay-1")
    return jr.read(t.spark, path).groupBy("day").agg(F.count("*").alias("n"))


@query("export_journal", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, d AS document, sha256(o_orderkey || ':' || d || ':' || o_orderpriority) AS sha256, CAST(strlen(o_orderkey || ':' || d || ':' || o_orderpriority) AS BIGINT) AS size
FROM orders, (SELECT unnest(['input', 'features', 'candidates', 'trace', 'explanation', 'result']) AS d) WHERE o_orderstatus = 'F'""")
def export_journal(t):
    key = F.col("o_orderkey").cast("string")
    docs = t.orders.filter(F.col("o_orderstatus") == "F").select(
        key.alias("run_id"), "o_orderpriority", F.explode(F.array(*[F.lit(d) for d in jr.DOCUMENTS])).alias("document"))
    out = jr.export_journal(docs.withColumn("body", F.concat_ws(":", "run_id", "document", "o_orderpriority")))
    return out.select("run_id", "document", "sha256", F.col("size").cast("long").alias("size"))


@query("cooldown", with_views("scored", """
WITH c AS (SELECT entity, as_of AS ts FROM scored WHERE p >= 0.3),
k AS (SELECT entity, min(ts) AS ts FROM c GROUP BY 1 UNION ALL
  SELECT k.entity, (SELECT min(c.ts) FROM c WHERE c.entity = k.entity AND c.ts >= k.ts + INTERVAL 60 MINUTE) FROM k
  WHERE EXISTS (SELECT 1 FROM c WHERE c.entity = k.entity AND c.ts >= k.ts + INTERVAL 60 MINUTE))
SELECT entity, ts FROM k""").replace("WITH quality", "WITH RECURSIVE quality", 1))
def cooldown(t):
    from assaylake.operators.cooldown import cooldown as keep

    return keep(scored(t).filter(F.col("p") >= 0.3).select("entity", F.col("as_of").alias("ts")), keys=["entity"], ts="ts", minutes=60)


@query("write_prepared", with_views("tele quality", """
SELECT 'telemetry' AS table_name, count(*) AS row_count, min(ts) AS min_at, max(ts) AS max_at FROM tele
UNION ALL SELECT 'quality', count(*), min(measured_at), max(measured_at) FROM quality"""))
def write_prepared(t):
    """Published twice: the second call finds the finished dataset and changes nothing."""
    tables = {"telemetry": (telemetry(t), "ts"), "quality": (quality(t), "measured_at")}
    root = shared_dir(t.spark, "prepared")
    target = pr.write_prepared(root, tables, {"telemetry": "signal_id"})
    if pr.write_prepared(root, tables) != target:
        raise ValueError("the same tables must give the same dataset")
    return t.spark.read.parquet(f"{target}/manifest").drop("fingerprint", "hash_sum")


@query("scan_rule_dim", with_views("tele", """
SELECT signal_id, max(value) AS exact_value, 'CONFIRMED_SENTINEL' AS issue_code, 'largest reading' AS detail FROM tele GROUP BY 1"""))
def scan_rule_dim(t):
    """A rule document that names each signal's largest reading, written and read back."""
    rules = telemetry(t).groupBy("signal_id").agg(F.max("value").alias("top")).select(F.struct(
        "signal_id", F.array("top").alias("exact_values"), F.lit("missing").alias("action"), F.lit("CONFIRMED_SENTINEL").alias("issue_code"),
        F.lit("tables").alias("evidence_ref"), F.lit("largest reading").alias("detail")).alias("rule"))
    path = shared_dir(t.spark, "rules")
    # One rule per signal: a configuration document of a few lines.
    rules.agg(F.lit(1).alias("version"), F.sort_array(F.collect_list("rule")).alias("rules")).coalesce(1).write.json(path)
    return rd.read_rules(t.spark, path)


@query("scan_scenarios", """
SELECT 'part-' || p_partkey AS scenario_id, 'A' AS component_id, p_size * 0.4::DOUBLE AS sulfur, p_retailprice AS cost FROM part
UNION ALL SELECT 'part-' || p_partkey, 'B', p_size * 0.8::DOUBLE, p_retailprice * 0.5 FROM part""")
def scan_scenarios(t):
    """Scenario documents made of the parts, written as JSON lines and read into tables."""
    from assaylake.sources.scenarios import scan_scenarios as scan
    from assaylake.sources.scenarios import scenario_tables

    def part(name, factor, price):
        return F.struct(F.lit(name).alias("id"), F.struct((F.col("p_size") * factor).alias("value"), F.lit("mg/kg").alias("unit")).alias("sulfur"),
                        (F.col("p_retailprice") * price).alias("cost_proxy_per_t"))

    path = shared_dir(t.spark, "scenarios")
    t.part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("model_demo").alias("mode"), F.lit(100.0).alias("total_mass_t"),
        F.array(part("A", 0.4, 1.0), part("B", 0.8, 0.5)).alias("blend_components")).write.json(path)
    parts = scenario_tables(scan(t.spark, path, one_per_file=False))["component"]
    return parts.select("scenario_id", F.col("id").alias("component_id"), F.col("sulfur.value").alias("sulfur"), F.col("cost_proxy_per_t").alias("cost"))


@query("drop_service_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_service_columns(t):
    from assaylake.operators.cleanse import drop_service_columns as drop

    return drop(t.orders.select(F.col("o_custkey").alias("Unnamed: 0"), "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias(" ")))


@query("schema_difference", with_views("plant", """
SELECT entity, ts, concat_ws(',', CASE WHEN click IS NULL THEN 'click' END, CASE WHEN signup IS NULL THEN 'signup' END,
  CASE WHEN view IS NULL THEN 'view' END, CASE WHEN sulfur IS NULL THEN 'sulfur' END) AS absent FROM plant"""))
def schema_difference(t):
    from assaylake.operators.features import absent_features
    from assaylake.sources.adapters import plant_hours

    names = ["click", "signup", "view", "sulfur"]
    return plant_hours(t).select("entity", "ts", F.array_join(absent_features(names), ",").alias("absent"))
