"""The corpus pipeline: each stage reads what its predecessor wrote and works on all of it.

Repeated rows, null texts and extra columns are treated as each operator's docstring says.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import dedup, jaccard, mixing, pieces, quality
from assaylake.llm.common import fresh
from assaylake.llm.queries import tokenizer_path
from assaylake.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base counts hold and whose probability of being good is high enough stay."""
    name = fresh(docs, "quality_")
    return quality.judge(docs, column=name).where(f"`{name}`.kept").drop(name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    name = fresh(docs, "dedup_")
    return dedup.groups(docs, column=name).where(f"`{name}`.kept").drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 of their sets of five-word shingles, the one with the smallest doc_id stays."""
    name = fresh(docs, "near_")
    return jaccard.groups(docs, jaccard.Rule(words=5, percent=80), column=name).where(f"`{name}`.kept").drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated as equal rows."""
    name, turn = fresh(docs, "mix_"), fresh(docs, "turn_")
    mixed = mixing.copies(docs, column=name).where(F.col(name)["copies"] > 0)
    repeated = mixed.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])))
    return repeated.drop(name, turn)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, with digests of ids, spans and decoded text."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "spans_crc32")
    # Workers outlive the stage, so a smaller cache leaves memory to the stages of the next run.
    found = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), outputs, carry=["doc_id", "source"], cache=250_000)
    return found.select("doc_id", "source", "pieces.*")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("encode pieces", encode_pieces),
]

#: SQL has neither the hashes that draw the mix nor the tokenizer; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
