"""Repeated passages by longest previous factors, over a corpus of any size.

A window is a run of ``L`` bytes.  It is repeated if the same bytes start anywhere else.  In the order of all suffixes, the
longest match of a place with any earlier place is with one of two neighbours: the nearest place before it in that order, or
after it, that is smaller (Crochemore and Ilie).  The larger of the two common prefixes is the place's *longest previous
factor*; from L bytes on, its window is a later copy.  The mirror image, with nearest larger places, gives later matches.
As no more than L bytes matter, suffixes are ordered, and factors measured, up to L bytes; ties stand in corpus order.

To sort little, and never all of a corpus in one place, windows are first told apart by what they contain:

1. Each window has an anchor: of its byte strings of length ``K`` the one with the smallest hash.  Windows in a row share
   an anchor, so a text of n bytes has about 2 n / W runs, W = L - K + 1.  Equal windows have equal anchors at equal
   places, and an anchor found once in the corpus rules out all its windows: one count by anchor drops most of the text.
2. Runs with the same anchor and the same bytes are copies of each other as a whole, and are one *segment* with a number of
   copies.  Counting finds them, so a passage in a third of all texts never comes together in one task.
3. Only the different segments of one anchor are left.  They meet in a task, which builds the suffix array of their
   windows by prefix doubling, and the factors of all of them.

Should one anchor have over ``MOST_SEGMENTS`` different segments, their windows are counted by hash over all tasks instead,
as no task may hold a group without a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.anchors import FILTER_ROWS, MOST_SEGMENTS, ranges, smallest, wanted, whole_anchors
from assaylake.llm.common import fresh, located
from assaylake.llm.passages import shared_words
from assaylake.llm.shingles import _constants, _powers, mix
from assaylake.session import materialise

#: Window starts handled at once.
PIECE = 1 << 19
_U = np.uint64


def offsets_of(length: int) -> int:
    """W for windows of ``length`` bytes: a power of two, about two thirds."""
    if length < 16:
        raise ValueError("windows of under 16 bytes are not passages")
    return 1 << int(np.log2(length * 0.65))


def runs_of(data: bytes, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with a common anchor: first start, number of starts, anchor's place, anchor's hash."""
    w = offsets_of(length)
    k = length - w + 1
    out = []
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at:at + PIECE + length - 1]
        letters = _constants()[0]
        raw = np.frombuffer(part, np.uint8)
        up, down = _powers(1 << max(16, len(raw).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(letters[raw] * up[:len(raw)], out=sums[1:])
        n = len(raw) - k + 1
        hashes = mix((sums[k:] - sums[:-k]) * down[:n])
        place = smallest(hashes, w)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(first, append=len(place))
        out.append((first + at, count, place[first] + at, hashes[place[first]]))
    return out


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: anchor, 128-bit hash of the run's bytes and the anchor's place in it, and where it is."""

    def run(batches):
        for b in batches:
            columns = [[] for _ in range(9)]
            for file, row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                data = (text or "").encode()
                view = memoryview(data)
                for first, count, place, anchor in runs_of(data, length):
                    digests = b"".join([
                        xxhash.xxh3_128_digest(view[s:s + n + length - 1], seed=p - s)
                        for s, n, p in zip(first.tolist(), count.tolist(), place.tolist())
                    ])
                    u = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    m = len(first)
                    for c, v in zip(columns, (
                        anchor.view(np.int64), u[:, 0], u[:, 1], [doc_id] * m, [file] * m, [row] * m, first, count,
                        place - first,
                    )):
                        c.append(v)
            if columns[0]:
                ids = pa.array([x for part in columns[3] for x in part], pa.int64())
                arrays = [ids if i == 3 else pa.array(np.concatenate(c).astype(np.int64)) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["anchor", "u1", "u2", "id", "file", "row", "start", "n", "off"]
                )

    return docs.select("_llm_file", "_llm_row", "doc_id", "text").mapInArrow(
        run, "anchor long, u1 long, u2 long, id long, file long, row long, start long, n long, off long"
    )


def prefix_ranks(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Prefix doubling: for 8, 16, ... up to ``length`` bytes the rank of each place's next bytes among those of all places."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = word << _U(8) | padded[j:j + n]
    ranks = {8: _dense(word)}
    size = 8
    while size * 2 <= length:
        r = ranks[size]
        later = np.zeros(n, np.int64)
        later[:max(n - size, 0)] = r[size:]
        ranks[size * 2] = _dense(r.astype(np.int64) * (n + 1) + later)
        size *= 2
    return ranks


def suffix_classes(ranks: dict[int, np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """For each start the rank of its ``length`` bytes among those of all starts, in byte order; equal bytes, equal rank."""
    # What is left of the length is read by ranks that may overlap what was read before.
    keys, at = [], 0
    for size in sorted(ranks, reverse=True):
        while at + size <= length:
            keys.append(ranks[size][starts + at])
            at += size
    if at < length:
        keys.append(ranks[8][starts + length - 8])
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(starts), bool)
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new)
    return out


def common_prefixes(ranks: dict[int, np.ndarray], data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the windows at ``a`` and ``b`` have in common from their start, at most ``length``."""
    at = np.zeros(len(a), np.int64)
    # Each size is needed once at most, as twice the largest is above the length.
    for size in sorted(ranks, reverse=True):
        r = ranks[size]
        same = r.take(a + at, mode="clip") == r.take(b + at, mode="clip")
        same &= at <= length - size
        at += same * np.int64(size)
    going = np.flatnonzero(at < length)
    for _ in range(7):
        going = going[data[a[going] + at[going]] == data[b[going] + at[going]]]
        at[going] += 1
        going = going[at[going] < length]
    return at


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each element the index of the nearest smaller one before it, or -1: up and down a tree of block minima."""
    n = len(x)
    levels = [x]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.append(low, np.iinfo(x.dtype).max)
        levels.append(np.minimum(low[::2], low[1::2]))
    out = np.full(n, -1, np.int64)
    open_ones, node = np.arange(n), np.arange(n)
    found = []
    for k, level in enumerate(levels):
        hit = (node & 1 == 1) & (level[node - 1] < x[open_ones])
        found.append((open_ones[hit], node[hit] - 1))
        open_ones, node = open_ones[~hit], node[~hit] >> 1
    who, node = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        who, node = np.concatenate([who, found[k][0]]), np.concatenate([node, found[k][1]])
        if k:
            below = levels[k - 1]
            right = np.minimum(2 * node + 1, len(below) - 1)
            node = np.where(below[right] < x[who], right, 2 * node)
    out[who] = node
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x), np.int32)
    ranks[order] = np.cumsum(np.concatenate([[0], x[order][1:] != x[order][:-1]]))
    return ranks


def longest_factors(
    ranks: dict[int, np.ndarray], data: np.ndarray, starts: np.ndarray, order: np.ndarray, places: np.ndarray, length: int,
    asked: np.ndarray | None = None,
) -> np.ndarray:
    """Longest match, up to ``length`` bytes, of each start with one of a smaller place; ``order`` is the suffix array of the starts.

    With negated places: with one of a larger place.  Starts that are not ``asked`` for get 0; others may match them.
    """
    n = len(order)
    x = places[order]
    out = np.zeros(n, np.int64)
    before = nearest_smaller(x)
    after = n - 1 - nearest_smaller(x[::-1])[::-1]
    open_ones = np.ones(n, bool) if asked is None else asked[order]
    for near in (before, after):
        at = np.flatnonzero((near >= 0) & (near < n) & open_ones)
        one, other = order[at], order[near[at]]
        out[one] = np.maximum(out[one], common_prefixes(ranks, data, starts[one], starts[other], length))
    return out


_FOUND = "file long, row long, start long, n long"


def _match(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Ranges of repeated windows of different segments with one anchor (anchor, copies, bytes, and where the first is)."""

    def run(batches):
        for rows in whole_anchors(batches):
            n = np.array([r["n"] for r in rows], np.int64)
            sizes = n + length - 1
            base = np.cumsum(sizes) - sizes
            seg = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
            # Segments in corpus order; a window's place is its segment's, then its start.
            order = sorted(range(len(rows)), key=lambda i: (
                rows[i]["id"] is None, rows[i]["id"] or 0, rows[i]["file"], rows[i]["row"], rows[i]["start"]
            ))
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            starts, places = base[seg] + inside, rank[seg] * (1 << 32) + inside
            ranks = prefix_ranks(data, length)
            order = np.lexsort((places, suffix_classes(ranks, starts, length)))
            # Windows of copied runs are found already, where all copies go.
            asked = (np.array([r["copies"] for r in rows]) == 1)[seg] | keep_first
            hit = longest_factors(ranks, data, starts, order, places, length, asked) >= length
            if not keep_first:
                hit |= longest_factors(ranks, data, starts, order, -places, length, asked & ~hit) >= length
            yield _ranges(hit, seg, inside, rows)

    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def _ranges(hit, seg, inside, rows) -> pa.RecordBatch:
    owner, off, n = ranges(hit, seg, inside)
    take = lambda k: np.array([r[k] for r in rows], np.int64)[owner]
    return pa.RecordBatch.from_arrays([
        pa.array(take("file")), pa.array(take("row")), pa.array(take("start") + off), pa.array(n),
    ], names=["file", "row", "start", "n"])


def _count_windows(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """As _match, for anchors with too many segments for one task: by the hash of every window."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                view, n = memoryview(r["bytes"]), r["n"]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:i + length]) for i in range(n)), np.int64)
                h = h.reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([r["copies"]] * n, pa.int64()),
                    pa.array([r["id"]] * n, pa.int64()), pa.array([r["file"]] * n, pa.int64()),
                    pa.array([r["row"]] * n, pa.int64()), pa.array(np.arange(n) + r["start"]),
                ], names=["h1", "h2", "copies", "id", "file", "row", "start"])

    windows = materialise(segments.mapInArrow(
        run, "h1 long, h2 long, copies long, id long, file long, row long, start long"
    ), "repeat-windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row", "start")
    seen = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("first")).where("m > 1")
    joined = windows.join(seen, ["h1", "h2"])
    is_first = (F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row")) & (
        F.col("first.start") == F.col("start")
    )
    hit = ~is_first if keep_first else F.col("copies") == 1
    return joined.where(hit).select("file", "row", "start", F.lit(1).cast("long").alias("n"))


def repeated_windows(docs: DataFrame, length: int, keep_first: bool = False, most: int = MOST_SEGMENTS) -> DataFrame:
    """Ranges of starts (file, row, start, n) of windows that are repeated; with ``keep_first`` all but the first of each."""
    runs = materialise(_runs(docs, length), "repeat-runs")
    # Written, so that the join has a shuffle of its own on both sides and Spark can split a hot anchor's rows.
    often = materialise(
        runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor"), "repeat-often"
    )
    again = materialise(runs.join(often, "anchor"), "repeat-again")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row", "start")
    segments = materialise(again.groupBy("anchor", "u1", "u2").agg(
        F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.min("n").alias("n")
    ), "repeat-segments")
    copied = again.join(segments.where("copies > 1").select("anchor", "u1", "u2", "first"), ["anchor", "u1", "u2"])
    if keep_first:
        copied = copied.where(
            (F.col("first.file") != F.col("file")) | (F.col("first.row") != F.col("row"))
            | (F.col("first.start") != F.col("start"))
        )
    whole = copied.select("file", "row", "start", "n")
    mixed = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("copies").alias("fewest")).where("m > 1")
    if not keep_first:
        # All windows of copied runs are found already.
        mixed = mixed.where("fewest = 1")
    mixed = mixed.select("anchor", "m")
    open_ones = materialise(
        segments.join(mixed, "anchor").select("anchor", "m", "copies", "n", "first.id", "first.file", "first.row", "first.start"),
        "repeat-open",
    )
    texts = wanted(docs, open_ones.select("file", "row").distinct()).select(
        F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row"), F.col("text").cast("binary").alias("data")
    )
    cut = materialise(open_ones.join(texts, ["file", "row"]).select(
        "anchor", "m", "copies", "n", "id", "file", "row", "start",
        F.substring("data", (F.col("start") + 1).cast("int"), (F.col("n") + length - 1).cast("int")).alias("bytes"),
    ), "repeat-cut")
    found = whole.unionByName(_match(cut.where(F.col("m") <= most), length, keep_first))
    large = cut.where(F.col("m") > most)
    if not large.isEmpty():
        found = found.unionByName(_count_windows(large, length, keep_first))
    return materialise(found, "repeat-found")


def remove(docs: DataFrame, length: int = 400, keep_first: bool = False, carry: list[str] | None = None,
           column: str = "repeats", most: int = MOST_SEGMENTS, passage: int | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with a struct ``column``: n_bytes, n_removed, spans (start, end) and kept (binary).

    A byte goes if it lies in a run of ``length`` bytes that also starts anywhere else, in the same text or another; with
    ``keep_first`` the first such run in the order of doc_id (null last, then place in the files) and byte stays.  Runs do
    not cross texts.  Texts are judged as UTF-8 bytes, so what is kept may split a character.  A null text counts as empty;
    texts under ``length`` bytes keep everything.  Spans are the maximal runs of removed bytes.  Repeated rows are copies
    of each other.  Other columns are not read; ``docs`` may not have one called ``column``.

    With ``passage`` the struct ends with n_shared: how many words lie in a run of that many words which another row holds
    too, whatever white space lies between them.  That removes nothing, as such a run may be under ``length`` bytes.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    kept_columns = docs.columns if carry is None else carry
    rows = located(docs, "repeat-input")
    found = repeated_windows(rows, length, keep_first, most)
    f, r, s, p, own = (fresh(rows, x) for x in ("_f", "_r", "_s", "_p", "_data"))
    no_spans = F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)")
    per_text = found.groupBy("file", "row").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + length - 1).alias("end")))).alias(s)
    )
    if passage is not None:
        per_text = per_text.join(shared_words(rows, passage, most), ["file", "row"], "full").select(
            "file", "row", F.coalesce(s, no_spans).alias(s), F.coalesce("n_shared", F.lit(0).cast("long")).alias(p)
        )
    per_text = materialise(per_text, "repeat-texts")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    flat = rows.select(*kept_columns, data.alias(own), "_llm_file", "_llm_row")
    # Overlapping ranges become spans; what lies between spans stays.
    merged = F.aggregate(s, no_spans, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")
        ))),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    keys = per_text.withColumnsRenamed({"file": f, "row": r})
    hit = wanted(flat, per_text.select("file", "row")).join(
        keys, (F.col("_llm_file") == F.col(f)) & (F.col("_llm_row") == F.col(r))
    ).withColumn(s, merged)
    between = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(
        F.col(own),
        (F.when(i > 0, F.get(F.col(s), i - 1)["end"]).otherwise(F.lit(0)) + 1).cast("int"),
        (F.coalesce(F.get(F.col(s), i)["start"], F.octet_length(own).cast("long"))
         - F.when(i > 0, F.get(F.col(s), i - 1)["end"]).otherwise(F.lit(0))).cast("int"),
    ))
    joined = F.aggregate(between, F.lit(b""), lambda acc, x: F.concat(acc, x))
    removed = F.aggregate(F.transform(s, lambda x: x["end"] - x["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    out = lambda n, spans, kept, shared: F.struct(
        F.octet_length(own).cast("long").alias("n_bytes"), n.alias("n_removed"), spans.alias("spans"), kept.alias("kept"),
        *([] if passage is None else [shared.alias("n_shared")]),
    ).alias(column)
    changed = hit.select(*kept_columns, out(removed, F.col(s), joined, F.col(p)))
    short = per_text.select(F.col("file").alias(f), F.col("row").alias(r))
    same = flat.join(short, (F.col("_llm_file") == F.col(f)) & (F.col("_llm_row") == F.col(r)), "left_anti")
    if per_text.count() <= FILTER_ROWS:
        short = per_text.select(F.struct("file", "row").alias(f))
        same = flat.join(F.broadcast(short), F.struct(F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row")) == F.col(f), "left_anti")
    untouched = same.select(*kept_columns, out(
        F.lit(0).cast("long"), no_spans, F.col(own), F.lit(0).cast("long")
    ))
    return changed.unionByName(untouched)
