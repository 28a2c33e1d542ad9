"""Stored forecast models: MLlib parts, a manifest with the feature order, and a fingerprint over all of it.

A model is a folder ``model_id=...``: ``point`` and ``upper`` hold what MLlib saves, ``manifest`` one JSON document, written
last.  A folder without a manifest is unfinished.  Loading refuses a model whose files, name, schema, features, data or time
boundaries are not the ones that were stored or asked for.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pyspark
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from assaylake.operators.models import PointModel, UpperHead
from assaylake.operators.quantile_trees import QuantileTrees

SCHEMA_VERSION = "1.0"


@dataclass
class Manifest:
    """What is stored beside the fitted parts."""

    model_id: str
    feature_names: list[str]
    baseline_feature: str
    horizon_minutes: int
    limit: float
    dataset_id: str
    boundaries: dict[str, str]
    bounds: dict[str, tuple[float, float]]
    supports_actions: bool = False
    schema_version: str = SCHEMA_VERSION
    spark_version: str = field(default_factory=lambda: pyspark.__version__)


@dataclass
class ForecastModel:
    """A point model, its upper head and the domain they were trained on."""

    manifest: Manifest
    point: PointModel
    head: UpperHead

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with point, upper and applicability_code; a forecast outside the domain is no forecast."""
        names = self.manifest.feature_names
        missing = [n for n in names if n not in rows.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        code = F.lit(None).cast("string")
        for n in names:
            low, high = self.manifest.bounds[n]
            code = F.when(F.col(n).isNotNull() & ~F.col(n).between(low, high), "OUT_OF_DOMAIN").otherwise(code)
        for n in names:
            code = F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")), "FEATURES_UNAVAILABLE").otherwise(code)
        scored = self.head.score(self.point.score(rows.withColumn("applicability_code", code)))
        known = F.col("applicability_code").isNull()
        return scored.withColumn("point", F.when(known, F.col("point"))).withColumn("upper", F.when(known, F.col("upper")))


def _folder(root: str, model_id: str) -> str:
    return f"{root.rstrip('/')}/model_id={model_id}"


def _fingerprint(spark: SparkSession, folder: str) -> dict[str, str]:
    """Number of files and sums over their hashes, whatever their order; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/point", f"{folder}/upper"])
    # The name below the model's folder counts, so that parts cannot change places.
    name = F.element_at(F.split("path", "/model_id=[^/]*/"), -1)
    row = files.filter(~F.col("path").rlike("/[_.][^/]*$")).agg(
        F.count("*").alias("files"), F.sum(F.xxhash64(name, "content").cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64("content", name)).alias("mixed"),
    ).first()
    return {k: str(row[k]) for k in ("files", "total", "mixed")}


def save_model(root: str, model: ForecastModel, spark: SparkSession) -> str:
    """Write ``model`` below ``root``; an existing model of that id is an error."""
    folder = _folder(root, model.manifest.model_id)
    if model.point.fitted is None:
        raise ValueError("the last value is no fitted model")
    if list(model.point.names) != list(model.manifest.feature_names):
        raise ValueError("the manifest lists other features than the point model")
    # MLlib's own save fails on a folder that exists.
    model.point.fitted.save(f"{folder}/point")
    head = {"model_id": model.head.model_id, "shift": model.head.shift, "level": model.head.level, "trees": None}
    trees = model.head.trees
    if trees is None:
        spark.range(0).write.parquet(f"{folder}/upper/none")
    else:
        trees.prepared.save(f"{folder}/upper/prepared")
        for i, tree in enumerate(trees.trees):
            tree.save(f"{folder}/upper/tree-{i}")
        head["trees"] = {
            "names": trees.names, "level": trees.level, "start": trees.start, "rate": trees.rate,
            "lifts": [{str(k): v for k, v in lift.items()} for lift in trees.lifts],
        }
    document = {
        "manifest": asdict(model.manifest), "head": head, "point": {"family": model.point.family, "comparison": model.point.comparison},
        "fingerprint": _fingerprint(spark, folder),
    }
    text = json.dumps(document, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").withColumn("sha256", F.sha2("value", 256)).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def load_model(
    spark: SparkSession, root: str, model_id: str, *, features: Sequence[str] | None = None, dataset_id: str | None = None,
    boundaries: dict[str, str] | None = None,
) -> ForecastModel:
    """Read a model back; what is given beside its id must be what it was stored with."""
    folder = _folder(root, model_id)
    try:
        row = spark.read.parquet(f"{folder}/manifest").select("value", "sha256", F.sha2("value", 256).alias("now")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no finished model {model_id}") from None
    if row is None or row["sha256"] != row["now"]:
        raise ValueError("the manifest was changed")
    document = json.loads(row["value"])
    stored = document["manifest"]
    manifest = Manifest(**{**stored, "bounds": {k: tuple(v) for k, v in stored["bounds"].items()}})
    asked = {"model_id": model_id, "schema_version": SCHEMA_VERSION, "feature_names": features and list(features),
             "dataset_id": dataset_id, "boundaries": boundaries}
    wrong = [k for k, v in asked.items() if v is not None and getattr(manifest, k) != v]
    if manifest.spark_version.split(".")[0] != pyspark.__version__.split(".")[0]:
        wrong.append("spark_version")
    if wrong:
        raise ValueError(f"the stored model has another {', '.join(wrong)}")
    if document["fingerprint"] != _fingerprint(spark, folder):
        raise ValueError("the model's files are not those of its manifest")
    point = PointModel(document["point"]["family"], manifest.feature_names, PipelineModel.load(f"{folder}/point"), document["point"]["comparison"])
    head = document["head"]
    trees = None
    if head["trees"]:
        t = head["trees"]
        trees = QuantileTrees(
            t["names"], t["level"], t["start"], t["rate"], PipelineModel.load(f"{folder}/upper/prepared"),
            [DecisionTreeRegressionModel.load(f"{folder}/upper/tree-{i}") for i in range(len(t["lifts"]))],
            [{int(k): v for k, v in lift.items()} for lift in t["lifts"]],
        )
    return ForecastModel(manifest, point, UpperHead(head["model_id"], trees, head["shift"], head["level"]))
