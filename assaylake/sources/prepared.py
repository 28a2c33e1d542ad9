"""Prepared dataset: manifest, write once, read and verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaylake.session import materialise


def manifest_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count, time range and an order-free content fingerprint of each table."""
    parts = []
    for name, (df, ts) in tables.items():
        parts.append(df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("row_count"),
            F.min(ts).alias("min_at"), F.max(ts).alias("max_at"),
            F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("fingerprint"),
            # Equal rows cancel in the exclusive or, but not in the sum.
            F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("hash_sum"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_identity(manifest: DataFrame, version: str = "1") -> str:
    """12 characters over the sorted table fingerprints; the manifest has one row per table."""
    row = manifest.agg(F.substring(F.sha2(F.concat_ws(
        "\n", F.array_sort(F.collect_list(F.concat_ws("|", "table_name", F.col("row_count").cast("string"), F.col("fingerprint").cast("string"), F.col("hash_sum").cast("string")))),
        F.lit(version)), 256), 1, 12).alias("id")).first()
    return row["id"]


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_prepared(root: str, tables: dict[str, tuple[DataFrame, str]], partition_by: dict[str, str] | None = None) -> str:
    """Publish tables under ``dataset_id=...``; the manifest goes last and marks completeness.

    A finished dataset of the same identity is left as it is; an unfinished one is an error.
    """
    # Written once, so that manifest and published tables come from the same rows and nothing is evaluated twice.
    tables = {name: (materialise(df, f"prepared-{name}"), ts) for name, (df, ts) in tables.items()}
    manifest = manifest_rows(tables)
    spark = manifest.sparkSession
    target = f"{root.rstrip('/')}/dataset_id={dataset_identity(manifest)}"
    if _exists(spark, f"{target}/manifest/_SUCCESS"):
        return target
    if _exists(spark, target):
        raise FileExistsError(f"dataset folder exists without a manifest: {target}")
    for name, (df, _) in tables.items():
        writer = df.write.mode("errorifexists")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(by) if by else writer).parquet(f"{target}/{name}")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{target}/manifest")
    return target


def read_prepared(spark, target: str, times: dict[str, str]) -> dict[str, DataFrame]:
    """Load the tables and fail when counts, ranges or contents differ from the manifest."""
    stored = {r["table_name"]: r for r in spark.read.parquet(f"{target}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{target}/{name}") for name in stored}
    found = {r["table_name"]: r for r in manifest_rows({n: (df, times[n]) for n, df in tables.items()}).collect()}
    wrong = [n for n in stored if stored[n] != found.get(n)]
    if wrong:
        raise ValueError(f"prepared tables do not match the manifest: {wrong}")
    return tables


def write_evaluation(path: str, report: DataFrame, residuals: DataFrame) -> None:
    """Metrics document and row-level residuals; an existing evaluation is never overwritten."""
    report.select(F.to_json(F.struct(*sorted(report.columns))).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/metrics")
    residuals.write.mode("errorifexists").parquet(f"{path}/residuals")
