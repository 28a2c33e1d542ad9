"""Readers of exported files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def checked_tags(tags: DataFrame) -> DataFrame:
    """The tag dictionary; a raw name given twice fails the job instead of overwriting a row."""
    repeats = tags.groupBy("raw_name").agg(F.count("*").alias("_n"))
    return tags.join(repeats, "raw_name").select(
        F.when(F.col("_n") == 1, F.col("raw_name"))
        .otherwise(F.raise_error(F.concat(F.lit("duplicate raw_name in tag dictionary: "), "raw_name")).cast("string"))
        .alias("raw_name"),
        *[c for c in tags.columns if c != "raw_name"],
    )


def read_tags(spark, path: str) -> DataFrame:
    """Tag dictionary file: blanks become NULL where allowed, the flag is a boolean."""
    raw = spark.read.csv(path, header=True)
    tags = raw.select(*[
        F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c == "raw_unit"
        else (F.lower(F.trim(F.col(c))) == "true").alias(c) if c == "controllable" else F.col(c)
        for c in raw.columns
    ])
    return checked_tags(tags)


def read_rules(spark, path: str) -> DataFrame:
    """Sentinel rules: only ``missing`` with exact values, one rule per signal."""
    docs = spark.read.schema(
        "version int, rules array<struct<signal_id:string,exact_values:array<double>,action:string,"
        "issue_code:string,evidence_ref:string,detail:string>>"
    ).json(path, multiLine=True)
    rules = docs.select(F.explode("rules").alias("r")).select("r.*")
    repeats = rules.groupBy("signal_id").agg(F.count("*").alias("_n"))
    good = (F.col("action") == "missing") & (F.size("exact_values") > 0) & (F.col("_n") == 1)
    checked = rules.join(repeats, "signal_id").withColumn(
        "signal_id", F.when(good, F.col("signal_id")).otherwise(
            F.raise_error(F.concat(F.lit("invalid telemetry rule: "), "signal_id")).cast("string")))
    return checked.select(
        "signal_id", F.explode("exact_values").alias("exact_value"), "issue_code", "detail")


def scan_telemetry(spark, path: str, namespace: str, tags: DataFrame, zone: str = "Europe/Moscow"):
    """Wide text export (``date`` plus one column per tag) to long UTC telemetry and issues.

    Every row keeps all its signals, also the empty ones: a lag must see that the last row had no
    value.  The dictionary is a small configuration file.
    """
    from assaylake.operators import cleanse as c

    raw = c.drop_service_columns(spark.read.csv(path, header=True, inferSchema=False))
    if "date" not in raw.columns:
        raise ValueError(f"{path}: required date column is missing")
    names = [n for n in raw.columns if n != "date"]
    tall = raw.select("date", c.utc_of(F.col("date"), zone).alias("ts"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("text")) for n in names])).alias("_v")
    ).select("date", "ts", "_v.column", "_v.text").withColumn("raw_name", c.prefixed(namespace, F.col("column")))
    dim = tags.select("raw_name", F.col("signal_id").alias("_signal"), F.col("mapping_status").alias("_status"))
    named = tall.join(dim, "raw_name", "left").withColumn("signal_id", F.coalesce("_signal", "raw_name")).withColumn(
        "value", c.number_of(F.col("text")))
    good = named.filter(F.col("ts").isNotNull())
    collapsed = c.collapse_duplicates(good, ["signal_id", "ts"])
    ref = lambda *parts: F.concat(F.lit(f"{path}#"), *parts)
    row = lambda code, df, where: df.select(
        where.alias("source_ref"), F.lit(code).alias("code"), F.lit("warning").alias("severity"), "signal_id")
    bad_times = raw.filter(F.col("date").isNotNull() & c.utc_of(F.col("date"), zone).isNull()).withColumn("signal_id", F.lit(None).cast("string"))
    at = lambda df: ref(F.lit("date="), F.col("date"))
    unknown = named.filter(F.col("_signal").isNull() | (F.col("_status") != "confirmed")).select("column", "signal_id").distinct()
    broken = good.filter(F.col("text").isNotNull() & F.col("value").isNull())
    clash = collapsed.filter("conflict")
    issues = (
        row("INVALID_TIMESTAMP", bad_times, at(bad_times))
        .unionByName(row("TAG_UNCONFIRMED", unknown, ref(F.lit("column="), F.col("column"))))
        .unionByName(row("INVALID_VALUE", broken, ref(F.lit("date="), F.col("date"), F.lit(";column="), F.col("column"))))
        .unionByName(row("SOURCE_CONFLICT", clash, ref(F.lit("timestamp="), F.col("ts").cast("string"), F.lit(";column="), F.col("signal_id"))))
    )
    return collapsed.drop("conflict"), issues


def _pairs(sheet: DataFrame, first_data_row: int) -> DataFrame:
    """(row_no, column_no, time_text, value_text) of side-by-side column pairs; empty pairs skipped."""
    cells = sorted((c for c in sheet.columns if c != "row_no"), key=lambda c: int(c[1:]))
    pairs = [(i + 1, cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
    return sheet.filter(F.col("row_no") >= first_data_row).select("row_no", F.explode(F.array(*[
        F.struct(F.lit(k).alias("column_no"), F.col(a).alias("time_text"), F.col(b).alias("value_text")) for k, a, b in pairs
    ])).alias("_p")).select("row_no", "_p.*").filter(F.col("time_text").isNotNull() | F.col("value_text").isNotNull())


def _header(sheet: DataFrame, rows: dict[str, int]) -> DataFrame:
    """Header cells by column number: one row per sheet column, so it is small whatever the data."""
    cells = sorted((c for c in sheet.columns if c != "row_no"), key=lambda c: int(c[1:]))
    top = sheet.filter(F.col("row_no") <= max(rows.values()))
    tall = top.select("row_no", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("column_no"), F.col(n).alias("text")) for i, n in enumerate(cells)])).alias("_c")).select("row_no", "_c.*")
    return tall.groupBy("column_no").agg(*[
        F.max(F.when(F.col("row_no") == r, F.trim("text"))).alias(n) for n, r in rows.items()])


def _observations(long: DataFrame, header: DataFrame, tags: DataFrame, *, source: str, path: str, zone: str, delay_minutes: int):
    from assaylake.functions.timecols import plus_minutes
    from assaylake.operators import cleanse as c

    mapped = c.mapping_audit(header, tags).withColumn(
        "mapping_ref", F.concat(F.lit(f"{path}#columns="), F.col("column_no").cast("string"), F.lit(","), (F.col("column_no") + 1).cast("string")))
    dim = mapped.select("column_no", "signal_id", "unit", "conversion", "mapping_validity", F.col("source_stage").alias("stage"))
    rows = long.join(dim, "column_no").select(
        "*",
        F.concat(F.lit(f"{path}#row="), F.col("row_no").cast("string"), F.lit(";columns="), F.col("column_no").cast("string"),
                 F.lit(","), (F.col("column_no") + 1).cast("string")).alias("source_ref"),
        c.utc_of(F.col("time_text"), zone).alias("measured_at"), c.number_of(F.col("value_text")).alias("_number"))
    good = rows.filter(F.col("measured_at").isNotNull())
    observations = good.select(
        c.observation_uuid(F.col("source_ref")).alias("observation_id"), "signal_id", "stage", F.lit(source).alias("source"), "measured_at",
        plus_minutes("measured_at", delay_minutes).alias("available_at"), c.convert_unit(F.col("_number"), F.col("conversion")).alias("value"), "unit",
        F.when(F.col("_number").isNull(), "invalid").otherwise(F.col("mapping_validity")).alias("validity"), "source_ref")
    issue = lambda df, code: df.select("source_ref", F.lit(code).alias("code"), F.lit("warning").alias("severity"), "signal_id")
    issues = (
        c.issue_rows(mapped, "mapping_issues", "mapping_ref", "signal_id").drop("detail")
        .unionByName(issue(rows.filter(F.col("measured_at").isNull()), "INVALID_TIMESTAMP"))
        .unionByName(issue(good.filter(F.col("_number").isNull()), "INVALID_VALUE")))
    return observations, issues


def scan_pair_table(sheet: DataFrame, tags: DataFrame, *, path: str, zone: str = "Europe/Moscow"):
    """Side-by-side (time, value) pairs, tag in row 1 and unit in row 2 (exported with ``row_no``)."""
    header = _header(sheet, {"raw_name": 1, "raw_unit": 2}).filter(F.col("raw_name").isNotNull()).withColumn("source_stage", F.lit("ht"))
    return _observations(_pairs(sheet, 3), header, tags, source="pak", path=path, zone=zone, delay_minutes=0)


def scan_sectioned_pairs(sheet: DataFrame, tags: DataFrame, *, path: str, zone: str = "Europe/Moscow", delay_minutes: int = 240):
    """As the pair table, with a section heading carried right over empty cells and data from row 5."""
    from pyspark.sql import Window

    from assaylake.operators import cleanse as c

    cells = _header(sheet, {"section": 1, "parameter": 2, "raw_unit": 3})
    # One row per sheet column; the carry runs over these few header cells only.
    carried = cells.withColumn("section", F.last("section", ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy("column_no").rowsBetween(Window.unboundedPreceding, 0)))
    named = carried.filter(F.col("parameter").isNotNull()).withColumn("_ns", c.normalize_section(F.coalesce("section", F.lit(""))))
    header = named.select(
        "column_no", "raw_unit", F.concat(F.lit("LIMS:"), "_ns", F.lit(":"), "parameter").alias("raw_name"),
        c.stage_of_namespace(F.substring_index("_ns", ".", 1)).alias("source_stage"))
    return _observations(_pairs(sheet, 5), header, tags, source="lims", path=path, zone=zone, delay_minutes=delay_minutes)
