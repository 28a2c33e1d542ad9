"""Two tokenizers' tokens of one text, brought together by the bytes they cover.

Both tokenizers tile the same bytes, so each text gives two rising lists of token ends.  Merging them finds the ends that
both have, which cut the tokens into groups, and on the way every pair of tokens that overlap.  The merge is cut by the
merge path: on each of the evenly spaced diagonals of the grid of both lists a binary search finds the one place where the
merge passes, so pieces of equal work start independently of each other.  A piece emits the overlaps of its steps; a group
that runs over a border is stitched, as every group is counted where it ends.

How often a pair of ids occurs is counted over the whole table; the counts of frequent pairs, of proven number, are looked
up in place, those of all others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm import pieces
from assaylake.llm.common import fresh
from assaylake.llm.shingles import slices
from assaylake.llm.wordcache import UnitCache
from assaylake.session import materialise

#: Steps of a merge that one piece takes.
PIECE_STEPS = 1 << 16
CHARACTERS_AT_ONCE = 1 << 19
#: An id of the second tokenizer takes so many bits of a pair's number.
LOW_BITS = 24
#: Counts of so many pairs at most are looked up in place (24 bytes each); the others are joined.
FREQUENT_PAIRS = 500_000
#: Distinct pairs that a task holds before it passes on its counts.
PAIRS_AT_ONCE = 1 << 20


# ------------------------------------------------------------------------------------------ the merge


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where the merge of rising ``a`` and ``b`` crosses every ``steps``-th diagonal, both ends included.

    A place says that the first i + j ends in order are the first i of ``a`` and the first j of ``b``; of equal ends the
    one of ``a`` comes first.  All diagonals are searched at once, each by halving.
    """
    at = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b)).astype(np.int64)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            break
        i = (low[todo] + high[todo]) // 2
        # a[i] belongs to the first places if it does not come after b[at - i - 1].
        before = a[i] <= b[at[todo] - i - 1]
        low[todo] = np.where(before, i + 1, low[todo])
        high[todo] = np.where(before, high[todo], i)
    return low, at - low


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) met on the merge's steps from (i0, j0) to (i1, j1), and of each whether both tokens end there.

    A step passes the end of one token; the token of the other list that is open there overlaps it.  Where both end
    together, the step of ``b`` finds no open token and the one of ``a`` stands for both.
    """
    # Own ends in order: those of a come first among equals.
    i, j = np.arange(i0, i1), np.arange(j0, j1)
    open_b = j0 + np.searchsorted(b[j0:j1], a[i0:i1], "left")
    open_a = i0 + np.searchsorted(a[i0:i1], b[j0:j1], "right")
    both = np.zeros(len(i), bool)
    inside = open_b < len(b)
    both[inside] = b[open_b[inside]] == a[i[inside]]
    # An end of b that a's last passed end equals was met on that step, maybe of an earlier piece.
    alone = np.ones(len(j), bool)
    passed = open_a > 0
    alone[passed] = a[open_a[passed] - 1] != b[j[passed]]
    left, right = np.concatenate([i, open_a[alone]]), np.concatenate([open_b, j[alone]])
    ends = np.concatenate([both, np.zeros(int(alone.sum()), bool)])
    order = np.argsort(left + right, kind="stable")
    return left[order], right[order], ends[order]


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlaps of tokens with ends ``a`` and ``b``, which tile the same bytes, in order, piece by piece."""
    i, j = diagonals(a, b, steps)
    for k in range(len(i) - 1):
        yield merged_piece(a, b, int(i[k]), int(i[k + 1]), int(j[k]), int(j[k + 1]))


# ------------------------------------------------------------------------------------------ both tokenizers


def _letter_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: itself if printable in Latin-1, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(printable)]
    return {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}


class Pair:
    """Ids and byte widths of both tokenizers for whole texts, each unit of a text once."""

    def __init__(self, byte_path: str, piece_path: str, cache: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True
        self.pieces = pieces.Encoder(piece_path, cache=1000)
        letters = _letter_bytes()
        size = self.byte_level.get_vocab_size()
        tokens = [self.byte_level.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        library = self.pieces.library
        self.bytes_b = []
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace(pieces.MARK, " ").encode())
        self.widths_a, self.widths_b = (np.array([len(x) for x in side], np.int32) for side in (self.bytes_a, self.bytes_b))
        # Units end where neither tokenizer joins what is before and after: the second one's own units, put together
        # again where white space meets white space, which the first one may join, and where two or more of it meet a
        # word, as the first one then keeps the last of them for itself.
        space = r"[\s\x1c-\x1f\x85]"
        unit = rf"(?:{self.pieces.units.pattern.replace(pieces.MARK, ' ')})"
        self.units = re.compile(rf"{unit}(?:(?:(?<={space})(?={space})|(?<={space}{space})(?=.)){unit})*", re.S)
        self.known = UnitCache(self._encode, cache)

    def _encode(self, units: list[str]):
        first = self.byte_level.encode_batch(units, add_special_tokens=False)
        normal = [u.replace(" ", pieces.MARK) for u in units]
        second = self._by_parts(normal)
        for unit, a, b in zip(units, first, second):
            own = unit.encode()
            fits = b"".join([self.bytes_a[i] for i in a.ids]) == own == b"".join([self.bytes_b[i] for i in b])
            yield (struct.pack(f"<{len(a.ids)}i", *a.ids), struct.pack(f"<{len(b)}i", *b)) if fits else False

    def _by_parts(self, normal: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer for units that may hold several of its own."""
        parts = [self.pieces.units.findall(u) for u in normal]
        ids = iter(self.pieces._ids([p for own in parts for p in own]))
        return [list(chain.from_iterable(next(ids) for _ in own)) for own in parts]

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Per text ids and byte widths of the first and the second tokenizer, or None where they do not tile its bytes.

        An empty text, and one that holds the second tokenizer's sign for a space, have none.
        """
        given = [f" {t}" if t and pieces.MARK not in t else "" for t in texts]
        if not self.pieces.plain:
            yield from (self._whole(t) for t in given)
            return
        units = [self.units.findall(t) for t in given]
        values = iter(self.known.of([u for own in units for u in own]))
        for own in units:
            found = [next(values) for _ in own]
            if not found or not all(found):
                yield None
                continue
            a, b = (np.frombuffer(b"".join(side), "<i4") for side in zip(*found))
            yield a, self.widths_a[a], b, self.widths_b[b]

    def _whole(self, given: str):
        """Without borders that hold for every text, the libraries encode the whole text."""
        if not given:
            return None
        a = self.byte_level.encode(given, add_special_tokens=False).ids
        b = self.pieces.library.encode(given[1:])
        left, right = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if not b"".join(left) == given.encode() == b"".join(right):
            return None
        return np.array(a, np.int32), self.widths_a[a], np.array(b, np.int32), self.widths_b[b]


@lru_cache(maxsize=2)
def pair_of(byte_path: str, piece_path: str) -> Pair:
    """One per Python worker, which outlives a task."""
    return Pair(byte_path, piece_path)


# ------------------------------------------------------------------------------------------ a batch of texts


_DIGITS = 8


@lru_cache(maxsize=2)
def _digit_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of small numbers, right-aligned, and how many each has."""
    text = np.char.zfill(np.arange(size).astype(str), _DIGITS - 1)
    digits = np.frombuffer("".join(text.tolist()).encode(), np.uint8).reshape(size, _DIGITS - 1)
    return digits, np.maximum(1, np.floor(np.log10(np.maximum(np.arange(size), 1))).astype(np.int8) + 1)


def _group_text(ids_a, ids_b, group_a, group_b) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;...`` over all groups, and for each group where its text ends."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    ids = np.concatenate([ids_a, ids_b])[order]
    side = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
    changes = np.append(side[1:] != side[:-1], True)
    mark = np.where(~changes, ord(","), np.where(side % 2 == 0, ord("|"), ord(";"))).astype(np.uint8)
    digits, count = _digit_table(1 << max(16, int(ids.max()).bit_length()))
    field = np.empty((len(ids), _DIGITS), np.uint8)
    field[:, :-1] = digits[ids]
    field[:, -1] = mark
    shown = np.arange(_DIGITS)[None, :] >= (_DIGITS - 1 - count[ids])[:, None]
    widths = count[ids].astype(np.int64) + 1
    last = np.flatnonzero(changes & (side % 2 == 1))
    ends = np.cumsum(widths)[last] if n_groups else np.zeros(0, np.int64)
    return field[shown], ends


def aligned(found: list, steps: int = PIECE_STEPS) -> Iterator[tuple]:
    """Per text of ``Pair.tokens``: n_a, n_b, n_groups, n_links, group text as bytes, its distinct id pairs and how often.

    Texts of a batch are laid end to end, so that pieces have equal work whatever the texts' lengths.
    """
    have = [k for k, f in enumerate(found) if f is not None]
    nothing = (0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int32))
    if not have:
        yield from (nothing for _ in found)
        return
    ids_a, ids_b = (np.concatenate([found[k][s] for k in have]).astype(np.int64) for s in (0, 2))
    ends_a, ends_b = (np.cumsum(np.concatenate([found[k][s] for k in have]), dtype=np.int64) for s in (1, 3))
    n_a, n_b = (np.array([len(found[k][s]) for k in have]) for s in (0, 2))
    last_a = np.cumsum(n_a)
    left, right, common = [], [], []
    for i, j, both in overlaps(ends_a, ends_b, steps):
        left.append(i)
        right.append(j)
        common.append(both)
    left, right, common = (np.concatenate(x) for x in (left, right, common))
    # A group is counted where it ends, so one that runs over a border of pieces is whole again here.
    group_of_link = np.cumsum(common) - common
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[left], group_b[right] = group_of_link, group_of_link
    text, text_ends = _group_text(ids_a, ids_b, group_a, group_b)
    text = text.tobytes()
    last_group = group_a[last_a - 1] + 1
    owner = np.searchsorted(last_a, left, "right")
    keys = (ids_a[left] << LOW_BITS) | ids_b[right]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(keys))).astype(np.int32)
    distinct, of = keys[starts], owner[starts]
    bounds = np.searchsorted(of, np.arange(len(have) + 1))
    links = np.bincount(owner, minlength=len(have))
    at = dict(zip(have, range(len(have))))
    for k in range(len(found)):
        if k not in at:
            yield nothing
            continue
        t = at[k]
        g0, g1 = (int(last_group[t - 1]) if t else 0), int(last_group[t])
        begin = int(text_ends[g0 - 1]) if g0 else 0
        lo, hi = bounds[t], bounds[t + 1]
        # The last group's text ends with a mark that only separates.
        yield int(n_a[t]), int(n_b[t]), g1 - g0, int(links[t]), text[begin:int(text_ends[g1 - 1]) - 1], distinct[lo:hi], times[lo:hi]


# ------------------------------------------------------------------------------------------ the operator


_OUT = pa.struct([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("groups_sha256", pa.string()),
])
_OUT_DDL = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,groups_sha256:string>"


def align(docs: DataFrame, byte_path: str, piece_path: str, column: str = "aligned", carry: list[str] | None = None,
          with_groups: bool = True) -> DataFrame:
    """``docs`` (``text``) with a struct ``column``: n_a, n_b, n_groups, n_links, groups, groups_sha256, n_best, count_sum.

    The byte-level tokenizer (A) encodes a space and the text, the piece tokenizer (B) the text, which puts the space there
    itself; ends that both have cut the tokens into groups, written as ``a1,a2|b1;a3|b2,b3`` in ``groups`` (null unless
    ``with_groups``).  Links are all overlaps of an A and a B token.  The count of an id pair is the number of rows of ``docs``
    that hold it linked; ``count_sum`` adds up the counts of a row's links, and ``n_best`` is how many of them have the
    highest count among all pairs of their A id, ties included.

    A text that is null or empty, or that either tokenizer's tokens do not give back byte by byte, has zeros and empty
    texts.  Equal rows count each for itself.  An empty table gives an empty result.  A text of any length is encoded whole;
    its merge runs in pieces.  Other columns are kept, or those of ``carry``; none is read, whatever its name.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    kept = docs.columns if carry is None else carry
    inner = fresh(docs, "_given")
    given = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*kept).alias(inner))
    ddl = f"`{inner}` {given.schema[inner].dataType.simpleString()}, found {_OUT_DDL}, pairs array<bigint>, times array<int>"

    def run(batches):
        own = pair_of(byte_path, piece_path)
        for b in batches:
            texts = b.column(0).to_pylist()
            rest = b.column(1)
            for lo, hi in slices(texts, CHARACTERS_AT_ONCE):
                rows, pairs, times = [], [], []
                for a, c, g, n, text, distinct, often in aligned(list(own.tokens(texts[lo:hi]))):
                    rows.append({
                        "n_a": a, "n_b": c, "n_groups": g, "n_links": n, "groups": text.decode() if with_groups else None,
                        "groups_sha256": hashlib.sha256(text).hexdigest() if a else "",
                    })
                    pairs.append(distinct)
                    times.append(often)
                yield pa.RecordBatch.from_arrays(
                    [rest.slice(lo, hi - lo), pa.array(rows, _OUT), _lists(pairs, np.int64), _lists(times, np.int32)],
                    names=[inner, "found", "pairs", "times"],
                )

    rows = materialise(
        given.mapInArrow(run, ddl).withColumn("at", F.monotonically_increasing_id()), "aligned"
    )
    counted = materialise(_counted(rows), "pair-counts")
    summed = _summed(rows.select("at", "pairs", "times"), counted)
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(summed, "at", "left").select(
        *[F.col(inner)[c].alias(c) for c in kept],
        F.struct(
            "found.*", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum")
        ).alias(column),
    )


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *[len(v) for v in values]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(kind) if values else np.zeros(0, kind)))


def _counted(rows: DataFrame) -> DataFrame:
    """(pair, n, best): rows that hold each pair, and whether no pair of the same A id has more.

    Tasks pass on sums of many rows; the highest count per A id has as many rows as the vocabulary.
    """

    def add(batches):
        held, size = [], 0

        def passed() -> pa.RecordBatch:
            pair, n = _summed_up(held)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for b in batches:
            flat = np.asarray(b.column(0).flatten())
            if len(flat):
                held.append(np.unique(flat, return_counts=True))
                size += len(held[-1][0])
            if size > PAIRS_AT_ONCE:
                held = [_summed_up(held)]
                size = len(held[0][0])
                if size > PAIRS_AT_ONCE // 2:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    part = rows.select("pairs").mapInArrow(add, "pair long, n long")
    counts = part.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", LOW_BITS))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed_up(held: list) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pair, np.bincount(at, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)


def _summed(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(at, n_best, count_sum) of rows with pairs.

    The pairs with a count of at least the least power of two that at most ``FREQUENT_PAIRS`` pairs reach are looked up
    where the rows are; what is left of each row, pairs of few rows, is joined.
    """
    spark = rows.sparkSession
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True)
    least, total = 63, 0
    for x in levels:
        total += x["pairs"]
        if total > FREQUENT_PAIRS:
            break
        least = x["level"]
    frequent = counted.where(level >= least).toArrow()
    columns = [np.asarray(frequent.column(c).combine_chunks()) for c in ("pair", "n", "best")]
    order = np.argsort(columns[0])
    known = spark.sparkContext.broadcast([c[order] for c in columns])

    def look(batches):
        pair, n, best = known.value
        for b in batches:
            flat, times = (np.asarray(b.column(k).flatten()).astype(np.int64) for k in (1, 2))
            owner = np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths()))
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            place = np.asarray(b.column(0))
            sums = [np.zeros(b.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * n[at[hit]])
            rest = ~hit
            none = np.full(b.num_rows, -1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([place, place[owner[rest]]])), pa.array(np.concatenate([none, flat[rest]])),
                    pa.array(np.concatenate([sums[0], times[rest]])),
                    pa.array(np.concatenate([sums[1], times[rest]])),
                ],
                names=["at", "pair", "n_best", "count_sum"],
            )

    looked = materialise(rows.mapInArrow(look, "at long, pair long, n_best long, count_sum long"), "pair-sums")
    done = looked.where("pair < 0").drop("pair")
    left = looked.where("pair >= 0").join(counted, "pair").select(
        "at", (F.col("n_best") * F.col("best").cast("long")).alias("n_best"), (F.col("count_sum") * F.col("n")).alias("count_sum")
    )
    return done.unionByName(left).groupBy("at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
