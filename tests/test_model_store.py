"""Quantile trees, stored models and the journal."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assaylake.operators import models as md
from assaylake.operators.quantile_trees import fit_quantile_trees
from assaylake.session import materialise
from assaylake.sources import journal as jr
from assaylake.sources.model_store import ForecastModel, Manifest, load_model, save_model

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def noisy(spark):
    """y = 2 x + noise whose spread grows tenfold where z is 1; about a third of each split."""
    rows = spark.range(6000).select(
        "id", (F.col("id") % 97 / 10.0).alias("x"), (F.col("id") % 2).cast("double").alias("z"),
        ((F.xxhash64("id") % 100_000) / 100_000.0).alias("u"))
    split = F.when(F.col("id") < 3000, "train").when(F.col("id") < 4500, "validation").otherwise("test")
    return materialise(rows.select(
        "x", "z", (2 * F.col("x") + F.col("u") * (1 + 9 * F.col("z"))).alias("y"), split.alias("split"),
        F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("as_of"),
        F.col("id").cast("string").alias("observation_id"), (2 * F.col("x")).alias("point")), "noisy")


def test_quantile_trees_follow_the_spread(noisy):
    trees = fit_quantile_trees(noisy.filter("split = 'train'"), ["x", "z"], "y", level=0.9, leaves=31)
    out = trees.score(noisy.filter("split = 'test'"), "q")
    assert "_qx" not in out.columns and "_leaf" not in out.columns
    covered = {r["z"]: (r["c"], r["w"]) for r in out.groupBy("z").agg(
        F.avg((F.col("y") <= F.col("q")).cast("double")).alias("c"), F.avg(F.col("q") - 2 * F.col("x")).alias("w")).collect()}
    # The 90 % quantile of noise that is even on -1 to 1, times 1 or 10.
    assert all(abs(c - 0.9) < 0.06 for c, _ in covered.values())
    assert covered[1.0][1] > 3 * covered[0.0][1] > 0


def test_upper_head_covers_what_it_did_not_see(noisy):
    head = md.fit_upper_head(noisy, ["x", "z"], level=0.9, leaves=(7, 15), rounds=5)
    assert head.model_id in ("quantile_trees_7", "quantile_trees_15") and head.shift >= 0
    test = head.score(noisy.filter("split = 'test'"))
    r = test.agg(F.avg((F.col("y") <= F.col("upper")).cast("double")).alias("c"), F.count_if(F.col("upper") < F.col("point")).alias("below")).first()
    assert 0.85 <= r["c"] <= 0.97 and r["below"] == 0
    # Test rows have no say.
    other = noisy.withColumn("y", F.when(F.col("split") == "test", F.col("y") + 1000).otherwise(F.col("y")))
    again = md.fit_upper_head(other, ["x", "z"], level=0.9, leaves=(7, 15), rounds=5)
    assert (again.model_id, again.shift) == (head.model_id, head.shift)


def forecast(noisy, trees=True):
    train = noisy.filter("split = 'train'")
    point = md.PointModel("ridge", ["x", "z"], md.fit_regression(train, ["x", "z"], "y", "ridge", alpha=1.0), [{"model": "ridge"}])
    head = md.fit_upper_head(noisy, ["x", "z"], leaves=(7,), rounds=2) if trees else md.UpperHead("shifted_point", None, 1.5)
    manifest = Manifest("m1", ["x", "z"], "x", 60, 10.0, "abc", {"train_end": "2024-01-16"}, {"x": (0.0, 9.0), "z": (0.0, 1.0)})
    return ForecastModel(manifest, point, head)


@pytest.mark.parametrize("trees", [True, False])
def test_stored_model_scores_as_before(spark, noisy, tmp_path, trees):
    model = forecast(noisy, trees)
    root = str(tmp_path / "models")
    save_model(root, model, spark)
    back = load_model(spark, root, "m1", features=["x", "z"], dataset_id="abc", boundaries={"train_end": "2024-01-16"})
    rows = noisy.filter("split = 'test'").drop("point").limit(500)
    show = lambda m: [tuple(r) for r in m.score(rows).select("observation_id", "point", "upper", "applicability_code").orderBy("observation_id").collect()]
    assert show(back) == show(model)
    assert {c for *_, c in show(back)} == {None, "OUT_OF_DOMAIN"}
    gap = spark.createDataFrame([(None, 1.0), (3.0, float("nan")), (3.0, 1.0)], "x double, z double")
    assert [(r.applicability_code, r.upper is None) for r in back.score(gap).collect()] == [
        ("FEATURES_UNAVAILABLE", True), ("FEATURES_UNAVAILABLE", True), (None, False)]
    with pytest.raises(ValueError, match="features are missing"):
        back.score(gap.drop("z"))


def test_stored_model_is_refused(spark, noisy, tmp_path):
    root = str(tmp_path / "models")
    save_model(root, forecast(noisy, False), spark)
    for asked in ({"features": ["z", "x"]}, {"dataset_id": "abd"}, {"boundaries": {"train_end": "2024-01-17"}}):
        with pytest.raises(ValueError, match="another"):
            load_model(spark, root, "m1", **asked)
    with pytest.raises(Exception, match="(?i)exist"):
        save_model(root, forecast(noisy, False), spark)
    with pytest.raises(FileNotFoundError):
        load_model(spark, root, "m2")
    (tmp_path / "models/model_id=m1").rename(tmp_path / "models/model_id=m3")
    with pytest.raises(ValueError, match="model_id"):
        load_model(spark, root, "m3")


def test_changed_files_are_refused(spark, noisy, tmp_path):
    root = str(tmp_path / "models")
    folder = save_model(root, forecast(noisy, False), spark)
    document = json.loads(spark.read.parquet(f"{folder}/manifest").first()["value"])
    assert document["manifest"]["feature_names"] == ["x", "z"]
    other = md.fit_regression(noisy.filter("split = 'test'"), ["x", "z"], "y", "ridge", alpha=5.0)
    other.write().overwrite().save(f"{folder}/point")
    with pytest.raises(ValueError, match="files"):
        load_model(spark, root, "m1")


def decided(spark, days, status="hold"):
    return spark.createDataFrame([(d, START + timedelta(days=d), status) for d in days], "entity int, as_of timestamp_ntz, status string")


def test_journal_has_every_run_once(spark, tmp_path):
    path = str(tmp_path / "journal")
    assert jr.committed(spark, path) == set()
    for _ in range(2):
        jr.append(path, decided(spark, range(4)), "7")
    jr.append(path, decided(spark, [1, 9]), "8")
    seen = jr.read(spark, path).groupBy("run").count().collect()
    assert {(r["run"], r["count"]) for r in seen} == {("7", 4), ("8", 2)} and jr.committed(spark, path) == {"7", "8"}


def test_unfinished_run_is_not_read_and_is_replaced(spark, tmp_path):
    path = str(tmp_path / "journal")
    jr.append(path, decided(spark, [0]), "a")
    # A job that died before its commit, having written other days.
    decided(spark, [5, 6, 7], "broken").withColumn("day", F.to_date("as_of")).write.partitionBy("day").parquet(f"{path}/rows/run=b")
    assert jr.read(spark, path).count() == 1
    jr.append(path, decided(spark, [5]), "b")
    assert sorted((r.run, r.entity, r.status) for r in jr.read(spark, path).collect()) == [("a", 0, "hold"), ("b", 5, "hold")]
