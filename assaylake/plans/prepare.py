"""Raw exports to prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaylake.operators.cleanse import dedupe_quality, mask_sentinels
from assaylake.sources.readers import scan_pair_table, scan_sectioned_pairs, scan_telemetry


def prepare(spark, *, telemetry_path: str, analyser_sheet: DataFrame, lab_sheet: DataFrame, tags: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Telemetry, quality and issues, each as one lazily planned table."""
    tele, tele_issues = scan_telemetry(spark, telemetry_path, "avt", tags)
    tele, masked = mask_sentinels(tele, rules, telemetry_path)
    pak, pak_issues = scan_pair_table(analyser_sheet, tags, path="analyser")
    lab, lab_issues = scan_sectioned_pairs(lab_sheet, tags, path="laboratory")
    quality = dedupe_quality(pak.unionByName(lab))
    conflicts = quality.filter(F.col("validity") == "conflict").select(
        "source_ref", F.lit("SOURCE_CONFLICT").alias("code"), F.lit("warning").alias("severity"), "signal_id")
    issues = (
        tele_issues.unionByName(masked.drop("detail")).unionByName(pak_issues).unionByName(lab_issues).unionByName(conflicts))
    return {"telemetry": tele, "quality": quality, "issues": issues}
