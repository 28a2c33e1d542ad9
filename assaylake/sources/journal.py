"""Run journal: append, list, recover, export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENTS = ("input", "features", "candidates", "trace", "explanation", "result")
TERMINAL = ("completed", "failed", "interrupted")


def append(journal: str, decisions: DataFrame, run_id: str) -> None:
    """Write the decisions (``as_of``) of one run, partitioned by run and day, nested columns kept.

    The run enters the list of commits last.  Written again after a failure or for a repeated micro-batch, it replaces what
    it had left; a run that is committed already is left as it is, so nothing is there twice.
    """
    if run_id in committed(decisions.sparkSession, journal):
        return
    rows = decisions.withColumn("day", F.to_date("as_of"))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{journal}/rows/run={run_id}")
    done = decisions.sparkSession.createDataFrame([(run_id,)], "run_id string")
    done.coalesce(1).write.mode("overwrite").parquet(f"{journal}/commits/commit={run_id}")


def committed(spark: SparkSession, journal: str) -> set[str]:
    """Ids of committed runs."""
    try:
        return {r["run_id"] for r in spark.read.parquet(f"{journal}/commits").select("run_id").collect()}
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def read(spark: SparkSession, journal: str) -> DataFrame:
    """Rows of committed runs, with ``run`` and ``day``; what an unfinished run left is not seen."""
    rows = spark.read.parquet(f"{journal}/rows").withColumn("run", F.col("run").cast("string"))
    commits = spark.read.parquet(f"{journal}/commits").select(F.col("run_id").alias("run"))
    return rows.join(commits, "run", "left_semi")


def completed_runs(statuses: DataFrame) -> DataFrame:
    """Completed runs, newest first."""
    return statuses.filter(F.col("status") == "completed").orderBy(F.col("at").desc(), "run_id")


def interrupted_runs(statuses: DataFrame) -> DataFrame:
    """Runs that started and never reached a final status, as rows to append."""
    ended = statuses.filter(F.col("status").isin(*TERMINAL)).select("run_id")
    return statuses.filter(F.col("status") == "started").join(ended, "run_id", "left_anti").select(
        "run_id", "at", F.lit("interrupted").alias("status"))


def export_journal(documents: DataFrame) -> DataFrame:
    """One checksum per document of complete runs; a run lacking a document fails the export."""
    counts = documents.groupBy("run_id").agg(F.count_distinct("document").alias("_n"))
    return documents.join(counts, "run_id").select(
        F.when(F.col("_n") == len(DOCUMENTS), F.col("run_id")).otherwise(
            F.raise_error(F.concat(F.lit("incomplete run: "), F.col("run_id").cast("string"))).cast("string")).alias("run_id"),
        "document", F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("size"))
