"""Ordered keyed state, snapshots that grow stale, conflicts, over restarts and with late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assaylake.operators.cleanse import dedupe_quality
from assaylake.streaming import jobs as j

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that rows are added to, read as a stream; every drain goes on where the last one stopped."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def drain(self, job, mode="append"):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        return j.drain(job(stream), "job", mode=mode, out=f"{self.path}/out", state=f"{self.path}/state")

    def seen(self, schema=None):
        return j.collected(self.spark, f"{self.path}/out", schema=schema).collect()


READING = "entity long, signal_id string, source string, measured_at timestamp, available_at timestamp, value double, usable boolean, fresh_minutes int"


def changes_of(rows):
    """Per key the state after every moment at which it changes, from the whole history at once."""
    out = []
    for key in {r[:3] for r in rows}:
        own = [r for r in rows if r[:3] == key]
        known = lambda r: max(r[3], r[4])
        moments = {known(r) for r in own}
        moments |= {r[3] + timedelta(minutes=r[7], microseconds=1) for r in own if r[6]}
        for m in sorted(moments):
            past = [r for r in own if known(r) <= m]
            if not past:
                continue
            latest = max(past, key=lambda r: r[3])
            usable = max((r for r in past if r[6]), key=lambda r: r[3], default=None)
            fresh = usable is not None and m <= usable[3] + timedelta(minutes=usable[7])
            out.append((*key, m, latest[3], latest[5], usable and usable[3], usable and usable[5], fresh))
    return out


def state_at(found, key, moment):
    """What the stream's changes say at a moment."""
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    past = [r for r in found if (r.entity, r.signal_id, r.source) == key and r.changed_us <= us(moment)]
    if not past:
        return None
    r = max(past, key=lambda r: (r.changed_us, r.fresh, r.latest_us))
    back = lambda u: None if u is None else datetime(1970, 1, 1) + timedelta(microseconds=u)
    return back(r.latest_us), r.latest_value, back(r.usable_measured_us), r.usable_value, r.fresh


def test_snapshot_with_late_samples_restarts_and_stale_values(spark, tmp_path):
    rng = random.Random(6)
    feed = Feed(spark, str(tmp_path), READING)
    rows = []
    for n in range(160):
        source = rng.choice(["pak", "lims"])
        measured = n * 7 + rng.random()
        delay = rng.choice([0, 30, 300]) if source == "lims" else 0
        rows.append((rng.randrange(2), "s", source, at(measured), at(measured + delay), float(n), rng.random() < 0.8, 25 if source == "pak" else 400))
    rows.sort(key=lambda r: max(r[3], r[4]))
    # One quiet signal, whose reading grows stale without another one, and a reading that is stale when it is published.
    rows[10:10] = [(7, "quiet", "pak", at(80), at(80), 1.0, True, 25), (8, "old", "lims", at(1), at(70), 2.0, True, 60)]
    cuts = [0, 40, 41, 110, len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        part = rows[lo:hi]
        rng.shuffle(part)
        feed.add(part)
        feed.drain(lambda s: j.snapshot_stream(s, "10 minutes"))
    found = feed.seen()
    mark = max(max(r[3], r[4]) for r in rows) - timedelta(minutes=10, milliseconds=5)
    checked = 0
    for *key, moment, latest_at, latest, usable_at, usable, fresh in changes_of(rows):
        if moment <= mark:
            assert state_at(found, tuple(key), moment) == (latest_at, latest, usable_at, usable, fresh), (key, moment)
            checked += 1
    assert checked > 150
    assert state_at(found, (7, "quiet", "pak"), at(105))[-1] and not state_at(found, (7, "quiet", "pak"), at(106))[-1]
    assert not state_at(found, (8, "old", "lims"), at(70))[-1]


QUALITY = ("source string, signal_id string, measured_at timestamp, observation_id string, value double, unit string, "
           "available_at timestamp, validity string, source_ref string")


def test_conflicts_are_corrected_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    keys = ["source", "signal_id", "measured_at"]
    rows = []
    for n in range(120):
        m = rng.randrange(25)
        rows.append(("lims", "s", at(m), str(n), rng.choice([None, 1.0, float(m)]), rng.choice(["u", "u", None]), at(m + 5), "valid", f"f{n:03d}"))
    rows += rows[:9]
    feed = Feed(spark, str(tmp_path), QUALITY)
    for lo, hi in ((0, 30), (30, 31), (31, 90), (90, len(rows))):
        feed.add(rows[lo:hi])
        feed.drain(lambda s: j.conflict_stream(s, keys), mode="update")
        want = dedupe_quality(spark.createDataFrame(rows[:hi], QUALITY), keys)
        told = j.settled(j.collected(spark, f"{feed.path}/out"), keys).select(*want.columns)
        assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))
    assert want.filter("validity = 'conflict'").count() > 3


SERIES = "entity long, ts timestamp, value double"


@pytest.mark.parametrize("bucket", [60_000_000, 3_600_000_000])
def test_episodes_do_not_depend_on_buckets_or_batches(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(j._Ordered, "bucket_us", bucket)
    rng = random.Random(1)
    rows = [(e, at(3 * n + e / 7), rng.choice([10.0, 90.0, 90.0, None])) for n in range(150) for e in (0, 1)]
    feed = Feed(spark, str(tmp_path), SERIES)
    for lo in range(0, len(rows), 70):
        # Within the delay, order of arrival is free.
        part = rows[lo:lo + 70]
        rng.shuffle(part)
        feed.add(part)
        feed.drain(lambda s: j.episode_stream(s, "10 minutes"))
    got = sorted((r.entity, r.episode_id, r.n) for r in feed.seen())
    mark = rows[-1][1] - timedelta(minutes=10)
    want = []
    for e in (0, 1):
        run = number = 0
        for _, ts, v in [r for r in rows if r[0] == e and r[1] <= mark]:
            if v is not None and v > 60:
                number += run == 0
                run += 1
            elif run:
                want.append((e, number, run))
                run = 0
    assert got == sorted(want)


def test_many_open_rows_of_one_key_are_read_bucket_by_bucket(spark, tmp_path):
    """Open rows wait in the state; the batch that closes them meets one bucket at a time."""
    feed = Feed(spark, str(tmp_path), SERIES)
    n = 60_000
    spark.range(n).select(F.lit(1).cast("long").alias("entity"), F.timestamp_seconds(F.col("id") * 30 + 1_700_000_000).alias("ts"),
                          (F.col("id") % 5 * 20.0).alias("value")).coalesce(1).write.parquet(f"{feed.path}/in")
    feed.drain(lambda s: j.episode_stream(s, "30 days"))
    assert not feed.seen("entity long, episode_id long, start_us long, end_us long, n long")
    feed.add([(2, datetime(2025, 1, 1), 0.0)])
    feed.drain(lambda s: j.episode_stream(s, "30 days"))
    # Of five rows one is above the limit, and the row after it ends the run.
    assert len(feed.seen()) == n // 5 - 1 + (1 if (n - 1) % 5 != 4 else 0)


def test_cooldown_passes_the_limit_of_batches(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SERIES)
    minutes = [0, 30, 59, 60, 61, 119, 121, 300]
    for part in ([0, 30, 59], [60, 61], [119, 121, 300], [400]):
        feed.add([(1, at(m), 90.0) for m in part])
        feed.drain(j.cooldown_stream)
    kept = sorted(r.us // 60_000_000 for r in feed.seen())
    want, last = [], None
    for m in minutes:
        if last is None or m - last >= 60:
            want.append(int((at(m) - datetime(1970, 1, 1)).total_seconds()) // 60)
            last = m
    assert kept == want
