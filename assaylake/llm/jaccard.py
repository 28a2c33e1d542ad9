"""Exact set-similarity join on word shingles, with set-relation skipping.

Texts with the same set are one node.  Nodes whose set is similar to a leader's, up to twice the distance that links, are
compared with it once and form a ball.  From then on the ball stands for its members in two ways:

* Index lists (token -> sets that have it in their prefix) hold a ball once, whatever its size, with bounds over its
  members: sizes, and how much of a set follows the token.  Lists are ordered by size and cut into blocks; pairs of
  blocks, and then of entries, whose bounds rule out the threshold by size or position are skipped.
* Answers: two balls are compared through their leaders.  Jaccard distance is a metric, so the leaders' distance and the
  members' distances to them bound every distance between members, also of one ball.  Members at about one distance from
  their leader are dealt into blocks of bounded size; where the bounds settle two blocks, links are counted as the size of
  the block.  Blocks that the bounds leave open are dealt into packs; two packs meet in a task, which compares the members
  of their open blocks and gives the number of links of each and a forest of links that ties together what is linked.

Copies are one node, so no step lists pairs of them, nor pairs of members: a member is sent along once for each pack
that its own is compared with, and packs of a group of m hold about 16 * sqrt(m) members.  A prefix is what is left of a set after the number of tokens
that a linked set must share, in the order rare tokens first; which tokens are common is a hint from local counts and
changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import fresh, located
from assaylake.llm.components import components
from assaylake.llm.shingles import mix, sets
from assaylake.session import materialise

#: Bands of two minima each; sets that agree in a band are compared with the band's smallest node.
BANDS = 4
#: A token is common if found in this share of all sets, copies counted each; the most frequent MOST_COMMON are kept.
COMMON_SHARE = 0.0001
MOST_COMMON = 500_000
#: Tokens found so often in the texts of one task are counted for the order.
LOCAL_COUNT = 2
#: A task that holds more counts than this forgets the tokens found once.
LOCAL_TOKENS = 1_000_000
#: Distances this near to the threshold are not settled by bounds.
EPS = 1e-9
#: Characters of texts hashed together, bytes of prefixes indexed together, and pairs that a list passes on at once.
CHARACTERS_AT_ONCE = 1 << 20
PREFIX_BYTES = 1 << 22
PAIRS_AT_ONCE = 100_000
#: Entries of a block of an index list.
BLOCK = 64
#: Least members of a block or a pack, about; most shingles of one of several; members on a side compared at once, and tokens that
#: these are multiplied over at once.
MEMBERS = 256
SHINGLES = 1 << 20
TILE = 256
TOKENS_AT_ONCE = 4096
#: Up to so many wanted rows, their 64-bit hashes (16 MB) go to all tasks and keep other texts from moving.
FILTER_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * shared >= percent * union."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """Tokens of a set of n of which a linked set has at least one."""
        return n - -(-self.percent * n // 100) + 1 if n else 0

    @property
    def slack(self) -> float:
        """The largest distance of linked sets."""
        return 1 - self.percent / 100

    @property
    def wide(self) -> float:
        """The largest distance of a ball's members from its leader."""
        return max(self.slack, min(2 * self.slack, 0.5))


def _minima(tokens: np.ndarray) -> list[int]:
    """Per band a hash of the two smallest of the tokens' hashes under two functions."""
    salts = np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = np.array([mix(tokens ^ salt).min() for salt in salts]).reshape(BANDS, 2)
    return mix(least[:, 0] * np.uint64(3) + least[:, 1]).view(np.int64).tolist()


def _parts(*texts) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts, of all columns, have about ``CHARACTERS_AT_ONCE`` bytes; only these become Python's."""
    sizes = sum(np.asarray(pc.binary_length(t).fill_null(0)).astype(np.int64) for t in texts)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > CHARACTERS_AT_ONCE:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


class _Counts:
    """Tokens of a task with the number of sets that have them."""

    def __init__(self) -> None:
        self.token, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []

    def add(self, found: list[np.ndarray]) -> None:
        self.held += found
        if sum(map(len, self.held)) > LOCAL_TOKENS // 2:
            self.merge()
            if len(self.token) > LOCAL_TOKENS:
                self._only(self.count > 1)

    def merge(self) -> None:
        token = np.concatenate([self.token, *self.held])
        count = np.concatenate([self.count, np.ones(len(token) - len(self.token), np.int64)])
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[:len(token)])
        self.token, self.held = token[first], []
        self.count = np.add.reduceat(count, first) if len(first) else count

    def _only(self, which: np.ndarray) -> None:
        self.token, self.count = self.token[which], self.count[which]

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        self._only(self.count >= LOCAL_COUNT)
        return self.token.view(np.int64), self.count


def _parities(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of about as many cells: two sets differ in at least as many tokens as cells."""
    cells = 1 << min(max(8, int(len(tokens)).bit_length()), 20)
    return np.packbits(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1 == 1).tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """How many tokens two sets differ in at least, by their parities; the longer ones are folded to the shorter."""
    # Cell i holds tokens whose low bits are i, so halves of the array are xor-ed.
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


_DESCRIBED = pa.schema([
    ("file", pa.int64()), ("row", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("parities", pa.binary()), ("token", pa.int64()), ("seen", pa.int64()),
])


def _describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of ``docs`` (_llm_file, _llm_row, text) with the key of their set, its size, band keys and parities; and common tokens."""

    def run(batches):
        counts = _Counts()
        for b in batches:
            files, rows = (b.column(i).to_pylist() for i in range(2))
            for lo, hi in _parts(b.column(2)):
                found = sets(b.column(2).slice(lo, hi - lo).to_pylist(), rule.words)
                counts.add(found)
                keys = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() for s in found]
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(files[lo:hi], pa.int64()), pa.array(rows[lo:hi], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([_minima(s) if len(s) else None for s in found], pa.list_(pa.int64())),
                    pa.array([_parities(s) for s in found], pa.binary()), none, none,
                ], schema=_DESCRIBED)
        token, seen = counts.often()
        for at in range(0, len(token), 100_000):
            part = token[at:at + 100_000]
            empty = [pa.nulls(len(part), f.type) for f in _DESCRIBED][:-2]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part), pa.array(seen[at:at + 100_000])], schema=_DESCRIBED)

    return docs.select("_llm_file", "_llm_row", "text").mapInArrow(
        run, "file long, row long, k1 long, k2 long, n long, bands array<bigint>, parities binary, token long, seen long"
    )


def _common(described: DataFrame, n_sets: int) -> np.ndarray:
    """Common tokens, the most frequent last; the order is a hint, so those cut at MOST_COMMON change no result."""
    seen = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    often = seen.where(F.col("seen") >= max(10.0, COMMON_SHARE * n_sets))
    rows = often.orderBy(F.desc("seen"), F.desc("token")).limit(MOST_COMMON).select("token").toArrow()
    return rows.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """Per row the prefix of its set in the global order, as bytes."""
    at = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[at], at))

    def run(batches):
        known, rank = shared.value
        for b in batches:
            files, rows = (b.column(i).to_pylist() for i in range(2))
            for lo, hi in _parts(b.column(2)):
                out = []
                for s in sets(b.column(2).slice(lo, hi - lo).to_pylist(), rule.words):
                    place = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    often = known[place] == s if len(known) else np.zeros(len(s), bool)
                    last = s[often][np.argsort(rank[place[often]])] if often.any() else s[:0]
                    out.append(np.concatenate([s[~often], last])[:rule.prefix(len(s))].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files[lo:hi], pa.int64()), pa.array(rows[lo:hi], pa.int64()), pa.array(out, pa.binary())],
                    names=["file", "row", "prefix"],
                )

    return docs.select("_llm_file", "_llm_row", "text").mapInArrow(run, "file long, row long, prefix binary")


def _compare(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (a, b: nodes) with shared, na, nb: sizes of the common part and of both sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(wanted.join(nodes, "node").select("node", "file", "row"), docs)
    joined = (
        pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            for lo, hi in _parts(batch.column(2), batch.column(3)):
                ta, tb = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (2, 3))
                distinct = dict(zip(a[lo:hi] + b[lo:hi], ta + tb))
                found = dict(zip(distinct, sets(list(distinct.values()), rule.words)))
                shared = [
                    len(np.intersect1d(found[x], found[y], assume_unique=True)) for x, y in zip(a[lo:hi], b[lo:hi])
                ]
                sizes = [[len(found[x]) for x in side[lo:hi]] for side in (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (a[lo:hi], b[lo:hi], shared, *sizes)],
                    names=["a", "b", "shared", "na", "nb"],
                )

    return materialise(joined.mapInArrow(run, "a long, b long, shared long, na long, nb long"), "compared")


def _texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Node and text of ``places`` (node, file, row), written."""
    places = materialise(places, "wanted")
    texts = docs.select(F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row"), "text")
    if places.count() <= FILTER_ROWS:
        short = places.select(F.xxhash64("file", "row").alias("short")).distinct()
        texts = texts.join(F.broadcast(short), F.xxhash64("file", "row") == F.col("short"), "left_semi")
    return materialise(texts.join(places, ["file", "row"]).select("node", "text"), "wanted-texts")


def _linked(rule: Rule):
    return F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * rule.percent


def _distance():
    return 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def _postings(members: DataFrame) -> DataFrame:
    """Index entries (token, ball, least, most, rest) from (ball, n, prefix); a task's entries of a ball are merged."""

    def run(batches):
        owners, prefixes, held = [], [], 0

        def flush():
            length = np.array([len(p) // 8 for p in prefixes])
            token = np.frombuffer(b"".join(prefixes), np.int64)
            ball, n = (np.repeat(np.concatenate(x), length) for x in zip(*owners))
            rest = n - (np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length))
            return _merge(token, ball, n, n, rest)

        for b in batches:
            if not b.num_rows:
                continue
            owners.append([b.column(i).to_numpy() for i in range(2)])
            prefixes += b.column(2).to_pylist()
            held += b.column(2).nbytes
            if held > PREFIX_BYTES:
                yield flush()
                owners, prefixes, held = [], [], 0
        if prefixes:
            yield flush()

    return members.select("ball", "n", "prefix").mapInArrow(run, _ENTRY)


_ENTRY = "token long, ball long, least long, most long, rest long"


def _merge(token, ball, least, most, rest) -> pa.RecordBatch:
    order = np.lexsort((ball, token))
    token, ball, least, most, rest = (x[order] for x in (token, ball, least, most, rest))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (ball[1:] != ball[:-1])
    first = np.flatnonzero(new)
    if len(first):
        least = np.minimum.reduceat(least, first)
        most, rest = np.maximum.reduceat(most, first), np.maximum.reduceat(rest, first)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (token[first], ball[first], least, most, rest)],
        names=["token", "ball", "least", "most", "rest"],
    )


def _candidates(postings: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of balls (a < b) that some index list leaves open, each once."""

    def lists(batches):
        """Whole lists, many small ones together: batches cut where the token changes."""
        kept = []
        for b in batches:
            if not b.num_rows:
                continue
            kept.append([c.to_numpy() for c in b.columns])
            token = kept[-1][0]
            last = np.searchsorted(token, token[-1])  # sorted within the partition
            if last > 0:
                whole = [np.concatenate([k[i] for k in kept[:-1]] + [kept[-1][i][:last]]) for i in range(5)]
                kept = [[c[last:] for c in kept[-1]]]
                yield whole
        if kept:
            yield [np.concatenate([k[i] for k in kept]) for i in range(5)]

    def passed(found) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches):
        for columns in lists(batches):
            merged = _merge(*columns)
            token, ball, least, most, rest = (c.to_numpy() for c in merged.columns)
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            size = np.diff(edge)
            found, held = [], 0
            for start, n in zip(edge[:-1][size > 1].tolist(), size[size > 1].tolist()):
                at = slice(start, start + n)
                for pairs in _open_pairs(ball[at], least[at], most[at], rest[at], rule):
                    found.append(pairs)
                    held += len(pairs)
                    if held > PAIRS_AT_ONCE:
                        yield passed(found)
                        found, held = [], 0
            if found:
                yield passed(found)

    parted = postings.repartition("token").sortWithinPartitions("token")
    return parted.mapInArrow(run, "a long, b long").distinct()


def _plausible(pairs: DataFrame, leading: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose leaders' parities leave it open that any two members link."""
    side = lambda x: leading.select(*[F.col(c).alias(f"{c}_{x}") for c in ("ball", "n", "parities", "r")])
    joined = pairs.join(side("a"), F.col("a") == F.col("ball_a")).join(side("b"), F.col("b") == F.col("ball_b")).select(
        "a", "b", "n_a", "n_b", "parities_a", "parities_b", (F.col("r_a") + F.col("r_b")).alias("r")
    )

    def run(batches):
        for batch in batches:
            n, m, r = (batch.column(i).to_numpy() for i in (2, 3, 6))
            apart = np.array([
                _least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ], np.int64)
            shared = (n + m - apart) // 2
            ok = shared >= (1 - (1 - rule.percent / 100 + 1e-9 + r)) * (n + m - shared) - 1e-6
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _open_pairs(ball, least, most, rest, rule: Rule) -> Iterator[np.ndarray]:
    """Pairs of a list's entries whose bounds allow a link, block by block."""
    order = np.lexsort((rest, least))
    ball, least, most, rest = ball[order], least[order], most[order], rest[order]

    def allowed(i: slice, j: slice) -> np.ndarray:
        p = rule.percent
        by_size = (most[i, None] * 100 >= least[None, j] * p) & (most[None, j] * 100 >= least[i, None] * p)
        need = (least[i, None] + least[None, j]) * p
        return by_size & (np.minimum(rest[i, None], rest[None, j]) * (100 + p) >= need)

    cuts = range(0, len(ball), BLOCK)
    # Per block: least size, largest size, largest rest.
    bounds = [(least[c], most[c:c + BLOCK].max(), rest[c:c + BLOCK].max()) for c in cuts]
    for x, c in enumerate(cuts):
        for y in range(x, len(bounds)):
            (lo, hi, r), (lo2, hi2, r2) = bounds[x], bounds[y]
            if hi * 100 < lo2 * rule.percent:
                # Later blocks are larger still.
                break
            if min(r, r2) * (100 + rule.percent) < (lo + lo2) * rule.percent:
                continue
            d = cuts[y]
            i, j = np.nonzero(allowed(slice(c, c + BLOCK), slice(d, d + BLOCK)))
            i, j = i + c, j + d
            one = i < j
            a, b = ball[i[one]], ball[j[one]]
            if len(a):
                yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def groups(docs: DataFrame, rule: Rule = Rule(), carry: list[str] | None = None, column: str = "near") -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with a struct ``column``: n_shingles, component_id, links, kept.

    Words are runs without white space, A-Z lower-cased.  A set holds the distinct shingles of ``rule.words`` words; a
    text of fewer words has all of them as its only shingle; a text without words, or null, has the empty set and links
    with nothing.  ``component_id`` is the smallest doc_id that links reach, itself included, null ids last; ``links`` the
    number of other sets that a text's set links with, copies of a text being one set; ``kept`` is true for one row of each component, the one with the smallest doc_id (of repeated ids the
    first row in the files).  Other columns are not read; ``docs`` may not have one called ``column``.  An empty table
    gives no rows.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    kept_columns = docs.columns if carry is None else carry
    rows = located(docs, "near-input")
    described = materialise(_describe(rows, rule), "described")
    described_rows = described.where("file IS NOT NULL")
    ids = rows.select(F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row"), F.col("doc_id").alias("id"))
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    light = materialise(described_rows.select("file", "row", "k1", "k2", "n", "bands", "parities").join(ids, ["file", "row"])
                        .withColumn("entry", entry).drop("id"), "near-rows")
    nodes = materialise(
        light.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("entry", "n", "bands", "parities")).alias("first"))
        .select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first.*", "first.entry.file", "first.entry.row"),
        "near-nodes",
    )
    n_nodes = nodes.count()

    # Balls: in each band the smallest node leads; of the leaders near enough, a node joins the one near to most.
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = banded.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    led = materialise(
        banded.join(leaders, ["band", "key"]).where("leader <> node")
        .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "led",
    )
    compared = _compare(led, nodes, rows, rule).select("a", "b", _distance().alias("d"), _linked(rule).alias("to_leader"))
    around = compared.where(F.col("to_leader") | (F.col("d") <= rule.wide))
    wanted = around.groupBy("a").agg((-F.count(F.lit(1))).alias("fewest"))
    balls = around.join(wanted, "a").groupBy(F.col("b").alias("node")).agg(
        F.min(F.struct("fewest", "a", "d", "to_leader")).alias("first")
    ).select("node", F.col("first.a").alias("ball"), "first.d", "first.to_leader")
    # Everybody else, leaders included, is in the ball of its own number.
    members = materialise(
        nodes.select("node", "n", "file", "row").join(balls, "node", "left").select(
            "node", "n", "file", "row", F.coalesce("ball", "node").alias("ball"), F.coalesce("d", F.lit(0.0)).alias("d"),
            F.coalesce("to_leader", F.lit(True)).alias("to_leader"),
        ), "members",
    )
    sure = materialise(compared.where("to_leader").select("a", "b"), "ball-links")

    common = _common(described, n_nodes)
    prefixes = _prefixes(rows, rule, common).join(members.select("file", "row", "ball", "n"), ["file", "row"])
    radius = members.groupBy("ball").agg(F.max("d").alias("r"))
    # A ball is compared through its leader, also where the leader itself is in another ball.
    leading = nodes.select(F.col("node").alias("ball"), "n", "parities").join(radius, "ball")
    open_pairs = materialise(_plausible(_candidates(_postings(prefixes), rule), leading, rule), "open-pairs")
    answers = _compare(open_pairs, nodes, rows, rule)
    bounded = answers.withColumn("d", _distance()).join(
        radius.select(F.col("ball").alias("a"), F.col("r").alias("ra")), "a"
    ).join(radius.select(F.col("ball").alias("b"), F.col("r").alias("rb")), "b")
    near = bounded.where(_linked(rule) | (F.col("d") <= rule.slack + EPS + F.col("ra") + F.col("rb")))
    # A ball of several members is also near itself.
    itself = members.groupBy(F.col("ball").alias("a")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(
        "a", F.col("a").alias("b"), F.lit(0.0).alias("d"), F.lit(True).alias("linked")
    )
    near = materialise(near.select("a", "b", "d", _linked(rule).alias("linked")).unionByName(itself), "near-balls")
    sure = sure.unionByName(answers.where(_linked(rule)).select("a", "b"))

    blocked = materialise(_blocked(members, rule), "blocked")
    open_, degree = _settled(near, blocked, rule)
    if not open_.isEmpty():
        more = _compare_blocks(open_, blocked, rows, rule)
        sure = sure.unionByName(more.where("a IS NOT NULL").select("a", "b"))
        degree = degree.unionByName(more.where("node IS NOT NULL").select("node", "links"))
    degree = degree.groupBy("node").agg(F.sum("links").alias("links"))
    return _result(rows, light, nodes, components(materialise(sure.distinct(), "links")), degree, kept_columns, column)


def _dealt(m, n):
    """Into how many parts ``m`` members of ``n`` shingles are dealt.

    Parts grow with the root of m, so comparing all of them sends m ** 1.5 rows, until parts would exceed ``SHINGLES``.
    """
    size = F.greatest(F.lit(float(MEMBERS)), F.sqrt(m * MEMBERS))
    return F.greatest(F.ceil(m / size), F.ceil(n / F.lit(float(SHINGLES)))).cast("int")


def _blocked(members: DataFrame, rule: Rule) -> DataFrame:
    """``members`` with the block of their ball that they are in: a ring (-1: the leader alone) and a part of it.

    A ball of up to ``MEMBERS`` has one ring.
    """
    large = members.groupBy("ball").agg((F.count(F.lit(1)) > MEMBERS).alias("large"))
    ring = F.when(F.col("d") == 0, -1).when(F.col("large"), F.floor(F.col("d") / max(rule.slack / 2, EPS)).cast("int")).otherwise(0)
    ringed = members.join(large, "ball").select("node", "n", "file", "row", "ball", "d", "to_leader", ring.alias("ring"))
    parts = ringed.groupBy("ball", "ring").agg(_dealt(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    return ringed.join(parts, ["ball", "ring"]).select(
        "node", "n", "file", "row", "ball", "d", "to_leader",
        F.struct("ring", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")).alias("block"),
    )


def _settled(near: DataFrame, members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """What the bounds say of ``near`` (balls a, b, distance d of their leaders, linked).

    Gives the pairs of blocks (a, block_a, b, block_b) left open, those of one ball in one order, and (node, links) of the
    settled ones.
    """
    blocks = members.groupBy("ball", "block").agg(
        F.count(F.lit(1)).alias("m"), F.min("d").alias("least"), F.max("d").alias("most")
    )
    side = lambda x: blocks.select(F.col("ball").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("block", "m", "least", "most")])
    same = F.col("a") == F.col("b")
    own = same & (F.col("block_a") == F.col("block_b"))
    leads = [F.col(f"block_{x}.ring") == -1 for x in "ab"]
    # The leaders' own pair has been compared, and so have members with their leader, whose links are added below.
    known = F.when(same, leads[0] | leads[1]).otherwise(leads[0] & leads[1])
    reach = F.col("most_a") + F.col("most_b")
    apart = F.greatest(
        F.col("d") - reach, F.col("least_a") - F.col("d") - F.col("most_b"), F.col("least_b") - F.col("d") - F.col("most_a")
    )
    state = F.when(known, F.when(~same & F.col("linked"), 1).otherwise(-1)).when(
        F.col("d") + reach <= rule.slack - EPS, 1).when(apart > rule.slack + EPS, -1).otherwise(0)
    both = materialise(
        near.join(side("a"), "a").join(side("b"), "b")
        .where((~same | (F.col("block_a") <= F.col("block_b"))) & ~(own & (F.col("m_a") == 1)))
        .withColumn("state", state).where("state >= 0"), "blocks",
    )
    open_ = both.where("state = 0").select("a", "block_a", "b", "block_b")
    linked = both.where("state = 1")
    # A member is no link of its own block; a block with itself is seen from one side only.
    gains = linked.select(
        F.col("a").alias("ball"), F.col("block_a").alias("block"), (F.col("m_b") - own.cast("long")).alias("links")
    ).unionByName(
        linked.where(~own).select(F.col("b").alias("ball"), F.col("block_b").alias("block"), F.col("m_a").alias("links"))
    ).groupBy("ball", "block").agg(F.sum("links").alias("links"))
    degree = members.join(gains, ["ball", "block"]).select("node", "links")
    # A leader that is in another ball meets its members there.
    led = members.where("d > 0 AND to_leader").join(members.where("d = 0").select("ball"), "ball", "left_semi")
    one = F.lit(1).cast("long")
    return open_, degree.unionByName(led.select("node", one.alias("links"))).unionByName(
        led.groupBy(F.col("ball").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    )


def _links(xs: list[np.ndarray], ys: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Whether each of the sets ``xs`` links with each of ``ys``."""
    sizes = [np.array([len(s) for s in z], np.int64) for z in (xs, ys)]
    tokens = [np.concatenate(z) for z in (xs, ys)]
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(*tokens)
    shared = np.zeros((len(xs), len(ys)), np.int64)
    for at in range(0, len(common), TOKENS_AT_ONCE):
        part = common[at:at + TOKENS_AT_ONCE]
        held = []
        for token, owner, n in zip(tokens, owners, sizes):
            place = np.minimum(np.searchsorted(part, token), len(part) - 1)
            has = part[place] == token
            held.append(np.zeros((len(n), len(part)), np.float32))
            held[-1][owner[has], place[has]] = 1
        shared += (held[0] @ held[1].T).astype(np.int64)
    return shared * 100 >= (sizes[0][:, None] + sizes[1][None, :] - shared) * rule.percent


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """New labels of what the links (i, j) tie together, and of these links those that tied what was apart before them."""
    tied = []
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return label, tied
        # Each label moves below one smaller label, so no two links tie the same.
        high, first = np.unique(np.maximum(label[i], label[j]), return_index=True)
        tied.append(np.stack([i[first], j[first]], axis=1))
        top = np.arange(len(label))
        top[high] = np.minimum(label[i], label[j])[first]
        while not np.array_equal(top, top[top]):
            top = top[top]
        label = top[label]


def _meetings(open_: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the pairs of blocks meet: blocks (id, ball, block) and ``open_`` as (meeting, x, y: ids).

    Balls tied by open pairs are a family, whose blocks are dealt into packs; pairs of blocks of the same two packs are one
    meeting, so a block is sent to a meeting for each pack of its family at most.  Balls whose hub (of those left open with
    a ball the one with most such balls) is the same share a pack, unless they are too many for one.
    """
    around = open_.select("a", "b").unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
        open_.select(F.explode(F.array("a", "b")).alias("a")).select("a", F.col("a").alias("b"))
    ).distinct()
    degree = around.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    hubs = around.join(degree, "b").groupBy(F.col("a").alias("ball")).agg(
        F.max(F.struct("k", (-F.col("b")).alias("least"))).alias("most")
    ).select("ball", (-F.col("most.least")).alias("hub"))
    ends = F.array(*[F.struct(F.col(x).alias("ball"), F.col(f"block_{x}").alias("block")) for x in "ab"])
    blocks = open_.select(F.explode(ends).alias("end")).select("end.*").distinct()
    sizes = members.groupBy("ball", "block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    families = components(open_.select("a", "b").where("a <> b")).toDF("ball", "family")
    blocks = materialise(
        blocks.join(sizes, ["ball", "block"]).join(hubs, "ball").join(families, "ball", "left")
        .withColumn("family", F.coalesce("family", "ball")), "open-blocks",
    )
    packs = blocks.groupBy("family").agg(F.sum("m").alias("all"), _dealt(F.sum("m"), F.sum("n")).alias("packs"))
    about = blocks.groupBy("family", "hub").agg(F.sum("m").alias("near")).join(packs, "family")
    small = F.col("near") * F.col("packs") * 2 <= F.col("all")
    dealt = F.when(small, F.xxhash64("hub")).otherwise(F.xxhash64("ball", "block"))
    # Packs and meetings are hashes: were two equal, both would meet in one task, each with its own pairs.
    pack = F.xxhash64("family", F.pmod(dealt, F.col("packs")))
    blocks = materialise(
        blocks.join(about, ["family", "hub"]).select(F.monotonically_increasing_id().alias("id"), "ball", "block", pack.alias("pack")), "packs"
    )
    side = lambda x, i: blocks.select(F.col("ball").alias(x), F.col("block").alias(f"block_{x}"), F.col("id").alias(i), F.col("pack").alias(f"pack_{x}"))
    meeting = F.xxhash64(F.least("pack_a", "pack_b"), F.greatest("pack_a", "pack_b")).alias("meeting")
    return blocks, open_.join(side("a", "x"), ["a", "block_a"]).join(side("b", "y"), ["b", "block_b"]).select(meeting, "x", "y")


def _compare_blocks(open_: DataFrame, members: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """For pairs of blocks: rows (a, b) of links that connect all that is linked, and rows (node, links) of counts."""
    blocks, pairs = _meetings(open_, members)
    pairs = materialise(pairs, "block-pairs")
    # However many pairs a block has in a meeting, its members are sent there once.
    there = pairs.select("meeting", F.explode(F.array("x", "y")).alias("id")).distinct().join(blocks, "id")
    sent = materialise(
        there.join(members.select("node", "file", "row", "ball", "block"), ["ball", "block"])
        .select("meeting", "id", "node", "file", "row"), "block-members",
    )
    texts = _texts(sent.select("node", "file", "row").distinct(), docs)

    def run(met: pa.Table, pairs: pa.Table) -> pa.Table:
        met = met.sort_by("id").combine_chunks()
        node = met.column("node").to_numpy()
        found = []
        for chunk in met.column("text").chunks:
            for lo, hi in _parts(chunk):
                found += sets(chunk.slice(lo, hi - lo).to_pylist(), rule.words)
        ids, block = np.unique(met.column("id").to_numpy(), return_inverse=True)
        x, y = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in "xy")
        wanted = np.zeros((len(ids), len(ids)), bool)
        wanted[x, y] = wanted[y, x] = True
        label, count, tied = np.arange(len(node)), np.zeros(len(node), np.int64), [np.zeros((0, 2), np.int64)]
        for at in range(0, len(node), TILE):
            for to in range(at, len(node), TILE):
                here, other = slice(at, at + TILE), slice(to, to + TILE)
                both = wanted[block[here, None], block[None, other]]
                if at == to:
                    both = np.triu(both, 1)
                if not both.any():
                    continue
                rows, columns = np.flatnonzero(both.any(axis=1)), np.flatnonzero(both.any(axis=0))
                links = _links([found[at + i] for i in rows], [found[to + j] for j in columns], rule) & both[np.ix_(rows, columns)]
                count[at + rows] += links.sum(axis=1)
                count[to + columns] += links.sum(axis=0)
                i, j = np.nonzero(links)
                label, new = _forest(label, at + rows[i], to + columns[j])
                tied += new
        ties = np.concatenate(tied)
        linked = np.flatnonzero(count)
        first, last = pa.nulls(len(ties), pa.int64()), pa.nulls(len(linked), pa.int64())
        return pa.table([
            pa.concat_arrays([pa.array(node[ties[:, 0]]), last]), pa.concat_arrays([pa.array(node[ties[:, 1]]), last]),
            pa.concat_arrays([first, pa.array(node[linked])]), pa.concat_arrays([first, pa.array(count[linked])]),
        ], names=["a", "b", "node", "links"])

    met = sent.select("meeting", "id", "node").join(texts, "node").groupBy("meeting").cogroup(pairs.groupBy("meeting")).applyInArrow(
        run, "a long, b long, node long, links long"
    )
    return materialise(met, "block-links")


def _result(rows, light, nodes, joined, degree, kept_columns, column) -> DataFrame:
    labelled = nodes.select("node", "k1", "k2", "entry").join(joined, "node", "left").join(degree, "node", "left").select(
        "k1", "k2", "entry", F.coalesce("component", "node").alias("component"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
    first = labelled.groupBy("component").agg(F.min("entry").alias("first"))
    classes = materialise(labelled.join(first, "component").select("k1", "k2", "first", "links"), "near-classes")
    alone = F.col("first").isNull()
    found = light.join(classes, ["k1", "k2"], "left").select(
        F.col("file").alias("f_"), F.col("row").alias("r_"), F.struct(
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("entry.id")).otherwise(F.col("first.id")).alias("component_id"),
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
            (alone | ((F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row")))).alias("kept"),
        ).alias("found_"),
    )
    f, r, s = (fresh(rows, x) for x in ("_f", "_r", "_s"))
    found = found.toDF(f, r, s)
    return rows.join(found, (F.col("_llm_file") == F.col(f)) & (F.col("_llm_row") == F.col(r))).select(
        *kept_columns, F.col(s).alias(column)
    )
