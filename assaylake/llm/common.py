"""What several operators share: word and white-space rules, row locators, name clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from assaylake.session import materialise

#: White space of all word rules here: space and the controls 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(body) > 0, F.split(body, SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def located(docs: DataFrame, purpose: str) -> DataFrame:
    """``docs`` with ``_llm_file`` and ``_llm_row`` (longs), which tell every row apart, also repeated ones.

    Columns of a Parquet table read as it is have their places there.  Any other frame is written once to the shared folder:
    a number given on the fly would change when a lost task runs again, and after an explode or a join several rows would
    have one place.
    """
    stored = docs if _is_table(docs) else materialise(docs, purpose)
    return stored.select("*", F.xxhash64("_metadata.file_path").alias("_llm_file"), F.col("_metadata.row_index").alias("_llm_row"))


def at_places(rows: DataFrame, found: DataFrame, kept: list[str], column: str) -> DataFrame:
    """Columns ``kept`` of ``rows`` (as ``located``) with ``column``: the last column of ``found`` (file, row, value)."""
    f, r, s = (fresh(rows, x) for x in ("_f", "_r", "_s"))
    joined = rows.join(found.toDF(f, r, s), (F.col("_llm_file") == F.col(f)) & (F.col("_llm_row") == F.col(r)))
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(s).alias(column))


def _is_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is nothing but columns of one folder or file of Parquet, each row once."""
    try:
        files = docs.inputFiles()
    except AnalysisException:
        return False
    # The folder of a written table, or the only file of one.
    folders = {f.rsplit("/", 1)[0] for f in files}
    paths = [*(folders if len(folders) == 1 else ()), *(files if len(files) == 1 else ())]
    # A local path is listed with its scheme, whether it was given so or not.
    for path in [*paths, *(p.removeprefix("file://") for p in paths if p.startswith("file://"))]:
        try:
            table = docs.sparkSession.read.parquet(path)
        except AnalysisException:
            continue
        if set(docs.columns) <= set(table.columns) and any(
            docs.sameSemantics(same) for same in (table, table.select(*docs.columns))
        ):
            return True
    return False
