"""Live forms of the batch operators, on Structured Streaming.

All state is keyed; sinks are folders under ``spark.checkpoint.dir`` written per micro-batch id, so a
batch repeated after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaylake.functions.timecols import plus_minutes
from assaylake.session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_table(spark: SparkSession, folder: str, table: str, bytes_a_batch: int | None = None) -> DataFrame:
    """A table of a folder as a stream, one file or a directory of files; event time is zoned.

    The path is written as a pattern that only it matches, because a stream takes a plain path for a directory.
    ``bytes_a_batch`` limits what a micro-batch reads; it is for files that arrive in the order of their times, as rows that
    come later than a job's delay allows are late.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if bytes_a_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_a_batch)
    rows = reader.parquet(f"{folder}/{table}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(
    stream: DataFrame, purpose: str, write: Callable[[DataFrame, str], None] | None = None, mode: str = "append",
    out: str | None = None, state: str | None = None,
) -> str:
    """Process everything available, then stop; returns the output folder.

    With the folders ``out`` and ``state`` of an earlier call, the job goes on where that one stopped; a batch that was
    interrupted replaces its own output.  Without them each call starts anew in fresh folders.
    """
    spark = stream.sparkSession
    out, state = out or shared_dir(spark, purpose), state or shared_dir(spark, f"{purpose}-state")

    def put(batch: DataFrame, batch_id: int) -> None:
        (write or _plain)(batch, f"{out}/{{table}}/batch={batch_id}")

    # A query copies its session's settings when it starts; the caller's own stay as they are.
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", state)
            .trigger(availableNow=True).foreachBatch(put).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return out


def _plain(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path.format(table="rows"))


def collected(spark: SparkSession, out: str, table: str = "rows", schema: str | None = None) -> DataFrame:
    """What a job has written; with ``schema``, a job that had nothing to do counts as no rows."""
    try:
        return spark.read.parquet(f"{out}/{table}").drop("batch")
    except AnalysisException as missing:
        if schema is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def clean_stream(stream: DataFrame, clean: Callable[[DataFrame], tuple[DataFrame, DataFrame]], purpose: str = "clean") -> str:
    """Cleaned rows and issue rows of each micro-batch into two folders."""

    def write(batch: DataFrame, path: str) -> None:
        good, issues = clean(batch)
        good.write.mode("overwrite").parquet(path.format(table="rows"))
        issues.write.mode("overwrite").parquet(path.format(table="issues"))

    return drain(stream, purpose, write)


def dedupe_stream(stream: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def conflict_stream(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dedupe_quality`` of everything seen so far, for the keys that a micro-batch changed; to be drained in update mode.

    The state holds per key the least and greatest payload, the first copy and the number of copies, on disk and without
    expiry.  A key that passed as a clean row is sent again, as a conflict, when a differing copy arrives.
    """
    from assaylake.operators.cleanse import dedupe_quality

    return dedupe_quality(stream, keys)


def settled(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last word on each key among the rows of ``conflict_stream``: copies only grow in number."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("refs")).alias("_last")).select(*keys, "_last.*")


def sliding_stats(stream: DataFrame, keys: Sequence[str], delay: str = "10 minutes", length: str = "180 minutes", step: str = "10 minutes") -> DataFrame:
    """Mean and deviation per sliding window, emitted once a window is closed."""
    w = F.window("ts", length, step)
    return stream.withWatermark("ts", delay).groupBy(*keys, w).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")
    ).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "mean", "std", "n")


def hourly_alarms(stream: DataFrame, keys: Sequence[str], limit: float, delay: str = "10 minutes") -> DataFrame:
    """Hours of opportunity and whether any row alarmed in them."""
    return stream.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "1 hour")).agg(
        F.max((F.col("value") > limit).cast("int")).alias("alarm"), F.count("*").alias("n")
    ).select(*keys, F.col("window.start").alias("hour"), (F.col("alarm") == 1).alias("alarm"), "n")


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them over in time order.

    Open rows lie in buckets of time, each an entry of its own in the state, with a timer for its first row.  A batch
    writes only the buckets it has rows for; a timer reads its bucket alone, and only the bucket in which the watermark
    stands is written back.  So a key may have any number of open rows: memory is that of one bucket.
    """

    #: Columns of a row beside ``us``, the time in microseconds, as (name, state type, Python type).
    fields: tuple = (("value", "double", float),)
    bucket_us = 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        columns = ", ".join(f"{n} array<{t}>" for n, t, _ in (("us", "bigint", int), *self.fields))
        self._open = handle.getMapState("open", "bucket long", columns)
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["us", *[n for n, _, _ in self.fields]]
        for chunk in rows:
            if len(chunk) == 0:
                continue
            for bucket, part in chunk.groupby(chunk["us"].astype("int64") // self.bucket_us):
                own = (int(bucket),)
                held = self._open.getValue(own) if self._open.containsKey(own) else None
                first = int(part["us"].min())
                # The bucket's timer stands at its first open row.
                if held is None or first < min(held[0]):
                    self._handle.registerTimer(first // 1000 + 1)
                new = [part["us"].astype("int64").tolist()]
                new += [[None if pd.isna(v) else kind(v) for v in part[n]] for n, _, kind in self.fields]
                merged = new if held is None else [[*a, *b] for a, b in zip(held, new)]
                self._open.updateValue(own, tuple(merged[: len(names)]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        # Of the open buckets only the numbers are read here; the first timer of a batch takes all that are due.
        for bucket in sorted(k[0] for k in self._open.keys() if k[0] <= mark // self.bucket_us):
            rows = sorted(zip(*self._open.getValue((bucket,))), key=self.order)
            ready = [r for r in rows if r[0] <= mark]
            rest = rows[len(ready):]
            if rest:
                self._open.updateValue((bucket,), tuple(list(c) for c in zip(*rest)))
                self._handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self._open.removeKey((bucket,))
            if ready:
                yield from self.advance(key, ready)
        yield from self.settle(key, mark)

    @staticmethod
    def order(row: tuple):
        return row[0]

    def advance(self, key, ready) -> Iterator[pd.DataFrame]:
        """Take rows in order; earlier calls had all earlier rows."""
        raise NotImplementedError

    def settle(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Asked once all rows up to ``mark`` were taken."""
        return iter(())

    def close(self) -> None: ...


class CooldownProcessor(_Ordered):
    """Passes a change only when the last passed one is at least an hour old."""

    minutes = 60

    def setup(self, handle) -> None:
        self._last = handle.getValueState("last", "us long")

    def advance(self, key, ready):
        last = self._last.get()[0] if self._last.exists() else None
        kept = []
        for us, _ in ready:
            if last is None or us - last >= self.minutes * 60_000_000:
                kept.append(us)
                last = us
        if last is not None:
            self._last.update((last,))
        if kept:
            yield pd.DataFrame({"entity": [key[0]] * len(kept), "us": kept})


class EpisodeProcessor(_Ordered):
    """Numbers runs of consecutive rows above the limit; emits a run when it ends."""

    limit = 60.0

    def setup(self, handle) -> None:
        self._run = handle.getValueState("run", "id long, start_us long, end_us long, n long, live int")

    def advance(self, key, ready):
        run = self._run.get() if self._run.exists() else (0, 0, 0, 0, 0)
        number, start, end, n, live = (int(x) for x in run)
        done = []
        for us, value in ready:
            if value is not None and value > self.limit:
                if not live:
                    number, start, n, live = number + 1, us, 0, 1
                end, n = us, n + 1
            elif live:
                done.append((key[0], number, start, end, n))
                live = 0
        self._run.update((number, start, end, n, live))
        if done:
            yield pd.DataFrame(done, columns=["entity", "episode_id", "start_us", "end_us", "n"])


class SnapshotProcessor(_Ordered):
    """Latest and latest usable reading of a signal's source, as of every moment that changes them.

    A reading is known from when it is both measured and published.  The newest *measured* one counts, so a sample that is
    published late takes its place in the order of samples, and an unusable one does not hide an older usable one.  When
    the usable reading grows older than ``fresh_minutes`` a timer of its own writes that down, without any new row.
    """

    fields = (("measured", "bigint", int), ("value", "double", float), ("flag", "int", int), ("fresh_minutes", "int", int))

    def setup(self, handle) -> None:
        self._any = handle.getValueState("any", "measured long, known long, value double")
        self._ok = handle.getValueState("ok", "measured long, known long, value double, stale_us long, fresh int")

    @staticmethod
    def order(row):
        return row[0], row[1]

    def _row(self, key, changed, latest, usable):
        us = ("measured", "known")
        out = {"entity": key[0], "signal_id": key[1], "source": key[2], "changed_us": changed, "latest_us": latest[0],
               "latest_value": latest[2]}
        out |= {f"usable_{n}_us": None if usable is None else usable[i] for i, n in enumerate(us)}
        return out | {"usable_value": None if usable is None else usable[2], "fresh": usable is not None and bool(usable[4])}

    def _aged(self, usable, now):
        """Whether the usable reading is too old at ``now``, at the time that was written down for it."""
        return usable is not None and usable[4] and now > usable[3]

    def advance(self, key, ready):
        latest = tuple(self._any.get()) if self._any.exists() else None
        usable = tuple(self._ok.get()) if self._ok.exists() else None
        rows = []
        for k, (us, measured, value, flag, fresh_minutes) in enumerate(ready):
            # What grew old before this row came says so at its own time.
            if self._aged(usable, us):
                usable = (*usable[:4], 0)
                rows.append(self._row(key, usable[3] + 1, latest, usable))
            if latest is None or measured >= latest[0]:
                latest = (measured, us, value)
            if flag and value is not None and (usable is None or measured >= usable[0]):
                stale = measured + fresh_minutes * 60_000_000
                usable = (measured, us, value, stale, int(us <= stale))
            # Of rows known at one moment the last says what holds then.
            if k + 1 == len(ready) or ready[k + 1][0] != us:
                rows.append(self._row(key, us, latest, usable))
        self._any.update(latest)
        if usable is not None:
            self._ok.update(usable)
        if rows:
            yield _typed(rows)

    def settle(self, key, mark):
        usable = tuple(self._ok.get()) if self._ok.exists() else None
        if usable is None or not usable[4]:
            return
        if self._aged(usable, mark):
            usable = (*usable[:4], 0)
            self._ok.update(usable)
            yield _typed([self._row(key, usable[3] + 1, tuple(self._any.get()), usable)])
        else:
            self._handle.registerTimer(usable[3] // 1000 + 2)


def _typed(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    whole = {c: "Int64" for c in frame.columns if c.endswith("_us")}
    return frame.astype(whole | {c: "Float64" for c in frame.columns if c.endswith("_value")})


def cooldown_stream(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    rows = changes.withWatermark("ts", delay).select("entity", "ts", F.unix_micros("ts").alias("us"), "value")
    return rows.groupBy("entity").transformWithStateInPandas(
        CooldownProcessor(), outputStructType="entity long, us long", outputMode="Append", timeMode="EventTime")


def episode_stream(series: DataFrame, delay: str = "10 minutes") -> DataFrame:
    rows = series.withWatermark("ts", delay).select("entity", "ts", F.unix_micros("ts").alias("us"), "value")
    return rows.groupBy("entity").transformWithStateInPandas(
        EpisodeProcessor(), outputStructType="entity long, episode_id long, start_us long, end_us long, n long",
        outputMode="Append", timeMode="EventTime")


SNAPSHOT_SCHEMA = (
    "entity long, signal_id string, source string, changed_us long, latest_us long, latest_value double, "
    "usable_measured_us long, usable_known_us long, usable_value double, fresh boolean"
)


def snapshot_stream(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes of the latest and usable reading per (entity, signal_id, source), in the order of ``changed_us``.

    ``readings`` has entity, signal_id, source, measured_at and available_at (zoned), value, usable (boolean) and
    fresh_minutes.  A row says what is known from ``changed_us`` on until the next row of its key; ``fresh`` turns false
    right after the usable reading's age has passed its minutes.  Rows appear once the watermark has passed them.
    """
    known = readings.select(
        "entity", "signal_id", "source", F.greatest("measured_at", "available_at").alias("ts"),
        F.unix_micros("measured_at").alias("measured"), F.col("value").cast("double").alias("value"),
        F.col("usable").cast("int").alias("flag"), "fresh_minutes",
    ).withWatermark("ts", delay).select("*", F.unix_micros("ts").alias("us"))
    return known.groupBy("entity", "signal_id", "source").transformWithStateInPandas(
        SnapshotProcessor(), outputStructType=SNAPSHOT_SCHEMA, outputMode="Append", timeMode="EventTime")


class PublishedProcessor(_Ordered):
    """Meets queries with the latest *measured* laboratory row among those published by then.

    Beside the open rows the state keeps that one row, however long ago it was published.
    """

    fields = (("asks", "int", int), ("id", "bigint", int), ("value", "double", float))

    def setup(self, handle) -> None:
        self._best = handle.getValueState("best", "measured long, value double")

    @staticmethod
    def order(row):
        # At one instant, publications come before queries.
        return row[:3]

    def advance(self, key, ready):
        best = tuple(self._best.get()) if self._best.exists() else None
        answers = []
        for _, asks, number, value in ready:
            if asks:
                answers.append((key[0], number, None if best is None else best[1]))
            elif best is None or number >= best[0]:
                best = (number, value)
        if best is not None:
            self._best.update(best)
        if answers:
            yield pd.DataFrame(answers, columns=["entity", "observation_id", "last_value"]).astype({"last_value": "Float64"})


def published_answers(queries: DataFrame, lab: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Each query (entity, observation_id, ts) with ``last_value``, null if nothing was published before it.

    ``lab`` has entity, available_at, measured_at and value.  A query is answered once the watermark has passed it.
    """
    asks = queries.select("entity", F.col("ts").alias("at"), F.lit(1).alias("asks"), F.col("observation_id").alias("id"),
                          F.lit(0.0).alias("value"))
    known = lab.select("entity", F.col("available_at").alias("at"), F.lit(0).alias("asks"),
                       F.unix_micros("measured_at").alias("id"), F.col("value").cast("double").alias("value"))
    rows = asks.unionByName(known).withWatermark("at", delay)
    return rows.select("entity", "at", F.unix_micros("at").alias("us"), "asks", "id", "value").groupBy("entity").transformWithStateInPandas(
        PublishedProcessor(), outputStructType="entity long, observation_id long, last_value double",
        outputMode="Append", timeMode="EventTime")
