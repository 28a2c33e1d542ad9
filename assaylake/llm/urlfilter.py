"""URL rules through a cascade of Bloom filters.

The keys a corpus can ask for are known: host suffix plus path start, for the path lengths that occur in rules.  Level 1
of the cascade encodes the listed keys, level 2 those other corpus keys that level 1 lets pass, level 3 the listed keys
that level 2 lets pass, and so on until none is left.  A lookup walks the levels to the first that says no; over the
corpus's keys the answer is exact, and the pages are never joined with the list.

A second cascade, over the listed keys, tells those that block from those that allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import fresh, located
from assaylake.session import materialise

#: False positive rates of the first level and of the others.
FIRST_RATE, NEXT_RATE = 0.01, 0.5
#: A cascade above this is not sent to executors; the pages' keys are then joined with the list.
MAX_CASCADE_BYTES = 64 << 20
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys a rule for this url could have, the longest first; of equal lengths the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>")
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("order"), (-F.length(s)).alias("host_order"), F.concat(s, p).alias("key")
    ))))
    return F.transform(F.array_sort(F.filter(keys, lambda k: F.length(host) > 0)), lambda k: k["key"])


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray | None = None

    def positions(self, h1: np.ndarray, h2: np.ndarray, number: int) -> Iterator[np.ndarray]:
        """Bits of keys at level ``number``; levels hash alike keys apart."""
        salt = np.uint64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))
        a, b = _mix(h1.astype(np.uint64) ^ salt), _mix(h2.astype(np.uint64) + salt) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def passes(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for at in self.positions(h1, h2, number):
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def sized_level(n: int, rate: float) -> Level:
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    return Level(-(-bits // 64) * 64, max(1, round(math.log(1 / rate) / math.log(2))))


class Cascade:
    """Levels alternate between listed keys (first) and other keys."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        going = np.arange(len(h1))
        for number, level in enumerate(self.levels):
            ok = level.passes(h1[going], h2[going], number)
            # A level that encodes listed keys says no to keys that aren't; one that encodes others, to listed ones.
            out[going[~ok]] = number % 2 == 1
            going = going[ok]
        out[going] = len(self.levels) % 2 == 1
        return out


def build(keys: DataFrame, max_bytes: int = MAX_CASCADE_BYTES) -> Cascade | None:
    """The cascade of ``keys`` (h1, h2, listed), which hold every key that will be asked, each once.

    None if a level would take more than ``max_bytes``.  Bits are set in the tasks and or-ed by word, so what reaches the
    driver is the filter itself.
    """
    spark = keys.sparkSession
    levels: list[Level] = []
    inside, outside = keys.where("listed").select("h1", "h2"), keys.where("NOT listed").select("h1", "h2")
    total, before = 0, None
    while True:
        n = inside.count()
        if n == 0:
            # Nothing to encode: the keys still open are all on the other side.
            return Cascade(levels)
        number = len(levels)
        level = sized_level(n, FIRST_RATE if number == 0 else NEXT_RATE)
        total += level.bits // 8
        if total > max_bytes:
            return None
        if number >= MAX_LEVELS or (before is not None and number > 8 and n >= before):
            raise ValueError("keys cannot be told apart by their hashes")
        before = n if number % 2 == 0 else before
        level.words = _set_bits(inside, level, number)
        levels.append(level)
        passed = _passing(spark, outside, level, number)
        inside, outside = materialise(passed, "cascade"), inside


def _set_bits(keys: DataFrame, level: Level, number: int) -> np.ndarray:
    shape = Level(level.bits, level.hashes)

    def bits(batches):
        for b in batches:
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate(list(shape.positions(h1, h2, number))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"]
            )

    rows = keys.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    words = np.zeros(level.bits // 64, np.uint64)
    for word, value in rows:
        words[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return words


def _passing(spark: SparkSession, keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(level)

    def keep(batches):
        for b in batches:
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield b.filter(pa.array(shared.value.passes(h1, h2, number)))

    return keys.mapInArrow(keep, "h1 long, h2 long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", column: str = "judged",
          max_bytes: int = MAX_CASCADE_BYTES) -> DataFrame:
    """``pages`` (``url``) with a struct ``column``: host, path, rule, verdict.

    ``rules`` (host, path, verdict ``allow`` or ``block``): a rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest rule wins.  Rule hosts are in lower case; of repeated rules that disagree, block
    holds.  Where no rule fits, ``rule`` is null and the verdict ``default``.  A null url, or one without ``://``, has
    empty host and path and fits no rule.  Repeated rows are judged each; empty tables give no rows, or defaults only.
    If ``pages`` has a column of the name ``column``, give another.
    """
    if column.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"pages has a column {column}; name another")
    spark = pages.sparkSession
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").groupBy(
        F.concat("host", "path").alias("key")
    ).agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.length("path")).alias("n"))
    # Distinct lengths of rule paths: as many as the longest path has characters at most.
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())
    host_of, path_of, keys_of = (fresh(pages, f"{column}_{x}") for x in ("host", "path", "keys"))
    host, path = host_and_path(F.col("url"))
    if not lengths:
        return pages.withColumn(column, F.struct(
            host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        ))
    parted = pages.withColumns({host_of: host, path_of: path}).withColumn(
        keys_of, candidates(F.col(host_of), F.col(path_of), lengths)
    )
    asked = parted.select(F.explode(keys_of).alias("key")).select("key", F.lit(None).cast("boolean").alias("block"))
    universe = materialise(
        asked.unionByName(listed.select("key", "block")).groupBy("key").agg(F.max("block").alias("block"))
        .select(*hashes(F.col("key")), F.col("block").isNotNull().alias("listed"), "block"), "cascade-keys",
    )
    member = build(universe, max_bytes)
    blocks = build(universe.where("listed").select("h1", "h2", F.col("block").alias("listed")), max_bytes) if member else None
    if member is None or blocks is None:
        return _judge_by_join(parted, listed, host_of, path_of, keys_of, column, default)
    shared = spark.sparkContext.broadcast((member, blocks))

    @F.pandas_udf("int")
    def winner(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """2 * place of the first listed key + whether it blocks; -1 without one."""
        n = h1.map(len).to_numpy()
        out = np.full(len(n), -1, np.int64)
        if n.sum():
            a, b = (np.concatenate(x.to_list()).astype(np.int64).view(np.uint64) for x in (h1, h2))
            on, off = shared.value
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            hit = np.flatnonzero(on.listed(a, b))
            rows, first = np.unique(row[hit], return_index=True)
            at = hit[first]
            out[rows] = 2 * (at - start[rows]) + off.listed(a[at], b[at])
        return pd.Series(out, dtype="int32")

    won = fresh(pages, f"{column}_won")
    hashed = [F.transform(keys_of, lambda k: hashes(k)[0]), F.transform(keys_of, lambda k: hashes(k)[1])]
    out = parted.withColumn(won, winner(*hashed))
    rule = F.when(F.col(won) >= 0, F.get(F.col(keys_of), F.shiftright(won, 1)))
    verdict = F.when(F.col(won) < 0, F.lit(default)).when(F.col(won) % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*pages.columns, F.struct(
        F.col(host_of).alias("host"), F.col(path_of).alias("path"), rule.alias("rule"), verdict.alias("verdict")
    ).alias(column))


def _judge_by_join(parted, listed, host_of, path_of, keys_of, column, default) -> DataFrame:
    """For lists whose cascade is too large to send out."""
    names = [c for c in parted.columns if c not in (host_of, path_of, keys_of)]
    rows = located(materialise(parted, "urls"), "urls")
    first = rows.select("_llm_file", "_llm_row", F.posexplode(keys_of).alias("pos", "key")).join(listed, "key").groupBy(
        F.col("_llm_file").alias("f_"), F.col("_llm_row").alias("r_")
    ).agg(F.min(F.struct("pos", "key", "block")).alias("won_"))
    return rows.join(first, (F.col("_llm_file") == F.col("f_")) & (F.col("_llm_row") == F.col("r_")), "left").select(
        *names, F.struct(
            F.col(host_of).alias("host"), F.col(path_of).alias("path"), F.col("won_.key").alias("rule"),
            F.when(F.col("won_").isNull(), F.lit(default)).when(F.col("won_.block"), F.lit("block"))
            .otherwise(F.lit("allow")).alias("verdict"),
        ).alias(column),
    )
