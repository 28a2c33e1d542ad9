"""Readers and cleansing on small exports."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from assaylake.operators import cleanse as c
from assaylake.sources import prepared as pr
from assaylake.sources import readers as rd

TAGS = "signal_id string, raw_name string, stage string, raw_unit string, canonical_unit string, conversion string, mapping_status string"


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), TAGS)


def test_observation_id_is_uuid5(spark):
    refs = ["a#row=1", "данные.csv#row=2;columns=1,2"]
    got = [r["u"] for r in spark.createDataFrame([(x,) for x in refs], "r string").select(c.observation_uuid(F.col("r")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in refs]


def test_telemetry_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Unnamed: 0,date,T1\n0,2026-01-15 12:00:00,130\n1,2026-01-15 12:00:00,131\n2,broken,132\n")
    dim = tags(spark, ("ht:T1", "ht:T1", "ht", None, "unknown", "none", "ambiguous"))
    rows, issues = rd.scan_telemetry(spark, str(path), "ht", dim)
    got = rows.collect()
    assert len(got) == 1 and got[0]["value"] is None and got[0]["signal_id"] == "ht:T1"
    assert str(got[0]["ts"]) == "2026-01-15 09:00:00"
    assert {r["code"] for r in issues.collect()} == {"INVALID_TIMESTAMP", "SOURCE_CONFLICT", "TAG_UNCONFIRMED"}


def test_date_column_is_required(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="date"):
        rd.scan_telemetry(spark, str(path), "ht", tags(spark, ("x", "x", "ht", None, "u", "none", "confirmed")))


def sheet(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, start=1)], "row_no long, c1 string, c2 string")


def test_pair_table(spark):
    s = sheet(spark, [("24-2000:D15", None), ("кг/м3", None), ("2026-01-15 12:00:00", "830.0"), ("2026-01-15 12:10:00", "Pt Created")])
    dim = tags(spark, ("ht:density", "24-2000:D15", "ht", "кг/м3", "kg/m3", "none", "confirmed"))
    obs, issues = rd.scan_pair_table(s, dim, path="p")
    got = obs.orderBy("measured_at").collect()
    assert str(got[0]["measured_at"]) == "2026-01-15 09:00:00" and got[0]["available_at"] == got[0]["measured_at"]
    assert (got[0]["value"], got[0]["validity"]) == (830.0, "valid")
    assert (got[1]["value"], got[1]["validity"]) == (None, "invalid")
    assert [r["code"] for r in issues.collect()] == ["INVALID_VALUE"]


def test_sectioned_table_and_delay(spark):
    s = sheet(spark, [("Установка '24-2000'. Точка отбора '1'.", None), ("Sulfur", None), ("мг/кг", None), ("5", None), ("2026-01-15 12:00:00", "8.4")])
    dim = tags(spark, ("ht:s", "LIMS:24-2000.1:Sulfur", "ht", "мг/кг", "mg/kg", "none", "confirmed"))
    row = rd.scan_sectioned_pairs(s, dim, path="l", delay_minutes=360)[0].first()
    assert (row["available_at"] - row["measured_at"]).total_seconds() == 6 * 3600
    assert (row["value"], row["unit"], row["validity"]) == (8.4, "mg/kg", "valid")


def test_unit_rules(spark):
    rows = spark.createDataFrame([("a", "ppm", "ht"), ("b", "кг/м3", "ht"), ("z", "ppm", "ht")], "raw_name string, raw_unit string, source_stage string")
    dim = tags(spark, ("s", "a", "ht", "ppm", "mg/kg", "ppm_mass_to_mg_kg", "confirmed"), ("t", "b", "ht", "кг/м3", "degC", "none", "confirmed"))
    got = {r["raw_name"]: r for r in c.mapping_audit(rows, dim).collect()}
    assert got["a"]["unit"] == "mg/kg" and got["a"]["mapping_validity"] == "valid"
    assert [i["code"] for i in got["b"]["mapping_issues"]] == ["UNIT_HEADER_OVERRIDDEN"] and got["b"]["mapping_validity"] == "valid"
    assert [i["code"] for i in got["z"]["mapping_issues"]] == ["TAG_UNCONFIRMED"]


def test_rules_and_tags_files(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"version": 1, "rules": [{"signal_id": "q", "exact_values": [307.0], "action": "missing", "issue_code": "CONFIRMED_SENTINEL", "evidence_ref": "e", "detail": "code"}]}))
    rules = rd.read_rules(spark, str(path))
    data = spark.createDataFrame([("q", 307.0), ("q", 5.0), ("r", 307.0)], "signal_id string, value double")
    clean, issues = c.mask_sentinels(data, rules, "f")
    assert sorted((r["signal_id"], r["value"]) for r in clean.collect() if r["value"] is not None) == [("q", 5.0), ("r", 307.0)]
    assert issues.first()["detail"] == "code rows_masked=1"
    tag_file = tmp_path / "tags.csv"
    tag_file.write_text("signal_id,raw_name,stage,meaning,raw_unit,canonical_unit,conversion,mapping_status,controllable,evidence_ref\na,x,ht,m,,u,none,confirmed,true,e\n")
    row = rd.read_tags(spark, str(tag_file)).first()
    assert row["raw_unit"] is None and row["controllable"] is True
    twice = tags(spark, ("a", "x", "ht", None, "u", "none", "confirmed"), ("b", "x", "ht", None, "u", "none", "confirmed"))
    with pytest.raises(Exception, match="duplicate raw_name"):
        rd.checked_tags(twice).collect()


def test_dedupe_null_equals_null(spark, minutes):
    cols = "observation_id string, signal_id string, source string, measured_at timestamp_ntz, available_at timestamp_ntz, value double, unit string, validity string, source_ref string"
    at = minutes(0)
    q = spark.createDataFrame([
        ("1", "s", "pak", at, at, None, "u", "invalid", "r1"), ("2", "s", "pak", at, at, None, "u", "invalid", "r2"),
        ("3", "t", "pak", at, at, 1.0, "u", "valid", "r3"), ("4", "t", "pak", at, at, None, "u", "valid", "r4")], cols)
    got = {r["signal_id"]: r for r in c.dedupe_quality(q).collect()}
    assert got["s"]["validity"] == "invalid" and got["s"]["refs"] == 2
    assert got["t"]["validity"] == "conflict" and got["t"]["value"] is None
    assert sorted(r["source_ref"] for r in c.conflict_refs(q).collect()) == ["r3", "r4"]


def test_contracts(spark):
    curve = spark.createDataFrame([("c", 0.0, 0.0), ("c", 0.01, 3.0), ("c", 0.02, 2.0)], "id string, dose double, gain double")
    assert [r["rule"] for r in c.curve_contract(curve, ["id"]).collect()] == ["gain_falls"]
    limits = spark.createDataFrame([("x", None, None, True, True), ("y", 2.0, 1.0, False, False)], "constraint_id string, lower double, upper double, use_upper boolean, use_lower boolean")
    assert sorted(r["rule"] for r in c.constraint_contract(limits).collect()) == ["both_estimates", "lower_above_upper", "no_bound"]


def test_prepared_round_trip_and_tampering(spark, tmp_path, minutes):
    df = spark.createDataFrame([("a", minutes(0), 1.0), ("b", minutes(5), None)], "signal_id string, ts timestamp_ntz, value double")
    root = str(tmp_path / "prepared")
    target = pr.write_prepared(root, {"telemetry": (df, "ts")}, {"telemetry": "signal_id"})
    assert pr.write_prepared(root, {"telemetry": (df, "ts")}) == target
    assert pr.read_prepared(spark, target, {"telemetry": "ts"})["telemetry"].count() == 2
    df.limit(1).write.mode("append").partitionBy("signal_id").parquet(f"{target}/telemetry")
    with pytest.raises(ValueError, match="do not match"):
        pr.read_prepared(spark, target, {"telemetry": "ts"})


def test_incomplete_journal_is_rejected(spark):
    from assaylake.sources.journal import DOCUMENTS, export_journal

    docs = spark.createDataFrame([("r", d, "x") for d in DOCUMENTS[:-1]], "run_id string, document string, body string")
    with pytest.raises(Exception, match="incomplete run"):
        export_journal(docs).collect()
