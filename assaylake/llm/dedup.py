"""Exact duplicates by a stateful stream.

A stream of (digest, id, locator) runs into keyed state on disk (RocksDB), without watermark and without expiry.  For each
digest the state retains the smallest identifier with the locator of its content, and how many rows had the digest.
The stream carries no texts; Spark sums up each batch in the map tasks before the shuffle, so a digest that a third of
all rows share reaches the state as one row per map task and batch.

A digest alone decides nothing: the rows of every digest that was hit more than once have their full bytes compared with
the content at the retained locator.  Rows whose bytes differ are grouped by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import SPACE_CLASS, fresh, located
from assaylake.session import materialise, shared_dir

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What one micro-batch reads of the feed of digests, about 100 bytes a document.
BYTES_A_BATCH = 8 << 30
#: Rows of the feed for each partition of the state, and the memory that a store may fill before it writes to disk.
ROWS_A_STORE = 32_000
STORE_BUFFER_MB = 8
#: Up to so many digests that were hit again, their 64-bit hashes (16 MB) go to all tasks and keep other texts from moving.
#: With more of them, the join moves all texts.
FILTER_DIGESTS = 1_000_000


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def state_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session of its own for the stream, so that the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Else every store sets 4 MB aside for its log of files.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", str(STORE_BUFFER_MB))
    # Stores of streams that have ended are closed by maintenance.
    own.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "10s")
    return own


def run_state(spark: SparkSession, feed: str, checkpoint: str, out: str, bytes_a_batch: int = BYTES_A_BATCH) -> None:
    """Bring the state at ``checkpoint`` up to date with the Parquet files below ``feed``.

    Each batch writes the digests it changed to its own folder below ``out``, overwriting what an interrupted try left.
    A later call reads only files that are new since, and goes on from the stored state, whose partitions stay as many as
    the first call found fit for the feed, at most the session's own.
    """
    stored = spark.read.parquet(feed)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = state_session(spark, max(1, min(most, -(-stored.count() // ROWS_A_STORE))))
    schema = stored.schema
    grouped = (
        own.readStream.schema(schema).option("maxBytesPerTrigger", bytes_a_batch).parquet(feed)
        .groupBy("digest").agg(F.min("entry").alias("kept"), F.count(F.lit(1)).alias("seen"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        grouped.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The state after the last batch: digests hit more than once, with the retained entry and the number of rows."""
    changes = spark.read.parquet(out)
    return changes.groupBy("digest").agg(F.min("kept").alias("kept"), F.max("seen").alias("seen")).where("seen > 1")


def groups(docs: DataFrame, digest=sha256, carry: list[str] | None = None, bytes_a_batch: int = BYTES_A_BATCH,
           column: str = "dedup") -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with a struct ``column``: text_sha256, keep_id, group_size, kept.

    Texts are equal if their bytes are, after ``normalised``.  Of equal texts the row with the smallest doc_id stays, a
    null id counting as the largest; of repeated ids the first row in the files.  A null text counts as empty.
    ``keep_id`` is the doc_id of the row that stays.  With ``carry`` only those columns of ``docs`` are returned.  Other
    columns may have any names but ``column``.  An empty table gives no rows.

    ``digest`` is the key of the state; its collisions cost time but change no result.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    spark = docs.sparkSession
    kept_columns = docs.columns if carry is None else carry
    rows = located(docs, "dedup-input")
    body, dig = fresh(docs, "_body"), fresh(docs, "_digest")
    entry = F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_llm_file").alias("file"),
        F.col("_llm_row").alias("row"),
    )
    feed, checkpoint, out = (shared_dir(spark, f"dedup-{x}") for x in ("feed", "state", "changes"))
    rows.select(digest(normalised(F.col("text"))).alias("digest"), entry.alias("entry")).write.parquet(feed)
    if spark.read.parquet(feed).isEmpty():
        empty = F.struct(F.lit("").alias("text_sha256"), F.col("doc_id").alias("keep_id"),
                         F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        return docs.select(*kept_columns, empty.alias(column))
    run_state(spark, feed, checkpoint, out, bytes_a_batch)
    hit = materialise(latest(spark, out), "dedup-hit")
    return _decide(rows, hit, digest, kept_columns, body, dig, column)


def _decide(rows, hit, digest, kept_columns, body, dig, column) -> DataFrame:
    # Full bytes of every row with a digest that was hit again; only these texts move.
    text = rows.select(
        F.col("doc_id").alias("id"), F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row"),
        normalised(F.col("text")).alias("body"), digest(normalised(F.col("text"))).alias("digest"),
    )
    if hit.count() <= FILTER_DIGESTS:
        short = hit.select(F.xxhash64("digest").alias("short")).distinct()
        text = text.join(F.broadcast(short), F.xxhash64("digest") == F.col("short"), "left_semi")
    again = materialise(text.join(hit, "digest"), "dedup-again")
    is_kept = (F.col("file") == F.col("kept.file")) & (F.col("row") == F.col("kept.row"))
    contents = again.where(is_kept).select("digest", F.col("body").alias("content"))
    checked = again.where(~is_kept).join(contents, "digest").select(
        "id", "file", "row", "kept", "digest", "body", (F.col("body") == F.col("content")).alias("same")
    )
    checked = materialise(checked.select("id", "file", "row", "kept", "digest", "same",
                                         F.when(~F.col("same"), F.col("body")).alias("body")), "dedup-checked")
    # Same digest, other bytes: groups by the bytes themselves.
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    other = checked.where(~F.col("same"))
    other_groups = other.groupBy("digest", "body").agg(F.min(entry).alias("kept"), F.count(F.lit(1)).alias("size"))
    strangers = other.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = hit.join(strangers, "digest", "left").select(
        "digest", (F.col("seen") - F.coalesce("n", F.lit(0))).alias("size")
    )
    first = F.col("kept")
    members = (
        again.where(is_kept).select("file", "row", "kept", "digest")
        .unionByName(checked.where("same").select("file", "row", "kept", "digest"))
        .join(sizes, "digest").select("file", "row", first.alias("kept"), "size")
        .unionByName(
            other.drop("kept").join(other_groups, ["digest", "body"]).select("file", "row", "kept", "size")
        )
    )
    members = members.select(
        F.col("file").alias(f"{dig}_f"), F.col("row").alias(f"{dig}_r"), F.col("kept").alias(f"{dig}_k"),
        F.col("size").alias(f"{dig}_n"),
    )
    light = rows.select(*kept_columns, "_llm_file", "_llm_row", F.col("doc_id").alias(f"{dig}_id"),
                        sha256(normalised(F.col("text"))).alias(dig))
    joined = light.join(
        members, (F.col("_llm_file") == F.col(f"{dig}_f")) & (F.col("_llm_row") == F.col(f"{dig}_r")), "left"
    )
    alone = F.col(f"{dig}_k").isNull()
    stays = alone | ((F.col("_llm_file") == F.col(f"{dig}_k.file")) & (F.col("_llm_row") == F.col(f"{dig}_k.row")))
    return joined.select(*kept_columns, F.struct(
        F.col(dig).alias("text_sha256"),
        F.when(alone, F.col(f"{dig}_id")).otherwise(F.col(f"{dig}_k.id")).alias("keep_id"),
        F.coalesce(F.col(f"{dig}_n"), F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"),
    ).alias(column))
