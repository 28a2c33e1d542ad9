"""Passages of words that other texts hold too: how many words of each text lie in a run of so many words found elsewhere.

The way of ``repeats``, on words in the place of bytes: a window is a run of ``words`` words, whatever white space lies
between them, and its anchor is the run of ``ANCHOR`` words in it with the smallest hash.  Windows in a row share an anchor.

1. An anchor found in one text alone rules out all its windows.
2. Runs with the same anchor and the same words are one segment; if it comes from several texts, all its windows are shared.
3. Where an anchor has different segments, and not all of them are shared, their windows meet in a task, which compares them
   by hash.  Should one anchor have over ``most`` segments, their windows are counted by hash over all tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.anchors import MOST_SEGMENTS, ranges, smallest, wanted, whole_anchors
from assaylake.llm.shingles import _constants, _pieces, _powers, _word_hashes, mix, slices
from assaylake.session import materialise

#: Words of an anchor: rare as a run, and few, so that many windows share one.
ANCHOR = 8
#: Window starts handled at once.
PIECE = 1 << 19
_PLACE = ["file", "row"]


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their first bytes in the texts joined by one byte, and each text's first word (and the end)."""
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    found = [(h, s + at) for at, piece in _pieces(b"\n".join(texts)) for h, s in [_word_hashes(piece)]]
    h = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in found]])
    starts = np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]])
    return h, starts, np.searchsorted(starts, bounds)


def runs_of(h: np.ndarray, owner: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with a common anchor, none across two texts: first word, number of windows, anchor's place, its hash."""
    k = min(ANCHOR, words)
    text = np.repeat(np.arange(len(owner) - 1), np.diff(owner))
    for at in range(0, len(h) - words + 1, PIECE):
        part = h[at:at + PIECE + words - 1]
        n = len(part) - k + 1
        grams = np.zeros(n, np.uint64)
        for j, factor in enumerate(_constants()[2][:k]):
            grams += part[j:j + n] * factor
        grams = mix(grams)
        place = smallest(grams, words - k + 1)
        whole = np.flatnonzero(text[at:at + len(place)] == text[at + words - 1:at + words - 1 + len(place)])
        if not len(whole):
            continue
        new = np.ones(len(whole), bool)
        new[1:] = (np.diff(place[whole]) != 0) | (np.diff(whole) != 1)
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(whole))
        first = whole[first]
        yield first + at, count, place[first] + at, grams[place[first]]


def _runs(docs: DataFrame, words: int) -> DataFrame:
    """Runs of all texts: anchor, 128-bit hash of the run's words and the anchor's place in it, where it is, and its bytes there."""
    names = ["anchor", "u1", "u2", "file", "row", "start", "n", "from", "to"]

    def run(batches):
        for b in batches:
            file, row = (b.column(i).to_numpy() for i in range(2))
            texts = b.column(2).to_pylist()
            for lo, hi in slices(texts):
                part = [t or b"" for t in texts[lo:hi]]
                h, starts, owner = word_places(part)
                base = np.cumsum([0, *[len(t) + 1 for t in part]])
                view = memoryview(h.view(np.uint8))
                for first, count, place, anchor in runs_of(h, owner, words):
                    last = first + count + words - 1
                    digests = b"".join([
                        xxhash.xxh3_128_digest(view[8 * s:8 * e], seed=p - s)
                        for s, e, p in zip(first.tolist(), last.tolist(), place.tolist())
                    ])
                    u = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    i = np.searchsorted(owner, first, side="right") - 1
                    # A run's bytes go up to the next word, or to the end of its text.
                    end = np.minimum(np.append(starts, base[-1])[last], base[i + 1] - 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(x.astype(np.int64)) for x in (
                            anchor.view(np.int64), u[:, 0], u[:, 1], file[lo + i], row[lo + i], first - owner[i], count,
                            starts[first] - base[i], end - base[i],
                        )
                    ], names=names)

    return docs.select("_llm_file", "_llm_row", F.col("text").cast("binary")).mapInArrow(
        run, ", ".join(f"`{c}` long" for c in names)
    )


def window_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of the ``words`` words from each word on: a polynomial in their hashes."""
    up, down = _powers(1 << max(16, len(h).bit_length()))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    n = max(len(h) - words + 1, 0)
    return mix((sums[words:words + n] - sums[:n]) * down[:n])


def _windows(rows: list[dict], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments: the hash of each of their windows, the segment it is in, and its place there."""
    n = np.array([r["n"] for r in rows], np.int64)
    h, _, owner = word_places([r["bytes"] for r in rows])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    seg = np.repeat(np.arange(len(rows)), n)
    return window_hashes(h, words)[owner[seg] + inside], seg, inside


_HITS = "anchor long, u1 long, u2 long, off long, n long"


def _match(segments: DataFrame, words: int) -> DataFrame:
    """Ranges of windows of segments of one text that another text holds in another segment of their anchor."""

    def run(batches):
        for rows in whole_anchors(batches):
            g, seg, inside = _windows(rows, words)
            texts: dict = {}
            text = np.array([texts.setdefault((r["file"], r["row"]), len(texts)) for r in rows])
            across = np.array([r["across"] for r in rows])
            anchors = np.array([r["anchor"] for r in rows])
            order = np.lexsort((g, anchors[seg]))
            s = seg[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(g[order]) != 0) | (np.diff(anchors[s]) != 0)]))
            # A segment of several texts differs from any one of them.
            low = np.minimum.reduceat(np.where(across, -1, text)[s], first)
            shared = low != np.maximum.reduceat(text[s], first)
            hit = np.empty(len(g), bool)
            hit[order] = np.repeat(shared, np.diff(first, append=len(g)))
            owner, off, n = ranges(hit & ~across[seg], seg, inside)
            u1, u2 = (np.array([r[c] for r in rows], np.int64) for c in ("u1", "u2"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchors[owner], u1[owner], u2[owner], off, n)], names=["anchor", "u1", "u2", "off", "n"]
            )

    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _HITS)


def _count_windows(segments: DataFrame, words: int) -> DataFrame:
    """As _match, for anchors with too many segments for one task: by the hash of every window."""
    keys = ["anchor", "u1", "u2", *_PLACE]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            if rows:
                g, seg, inside = _windows(rows, words)
                places = [np.array([r[c] for r in rows], np.int64)[seg] for c in keys]
                across = np.array([r["across"] for r in rows])[seg]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*places, across, g.view(np.int64), inside)], names=[*keys, "across", "g", "off"]
                )

    windows = materialise(segments.mapInArrow(
        run, ", ".join(f"`{c}` long" for c in keys) + ", across boolean, g long, off long"
    ), "passage-windows")
    shared = windows.groupBy("anchor", "g").agg(_several(), F.max("across").alias("any")).where("several OR any")
    return windows.where("NOT across").join(shared.select("anchor", "g"), ["anchor", "g"]).select(
        "anchor", "u1", "u2", "off", F.lit(1).cast("long").alias("n")
    )


def _several():
    """Whether the rows of a group are of more than one text."""
    return ((F.min("file") != F.max("file")) | (F.min("row") != F.max("row"))).alias("several")


def shared_words(docs: DataFrame, words: int, most: int = MOST_SEGMENTS) -> DataFrame:
    """For rows of ``docs`` (as ``located``, with ``text``): file, row and the number of words in windows that other rows hold.

    Rows without such words are left out.
    """
    if words < 2:
        raise ValueError("a passage has two words at least")
    runs = materialise(_runs(docs, words), "passage-runs")
    often = materialise(runs.groupBy("anchor").agg(_several()).where("several").select("anchor"), "passage-often")
    again = materialise(runs.join(often, "anchor"), "passage-again")
    segments = materialise(again.groupBy("anchor", "u1", "u2").agg(
        _several(), F.min(F.struct(*_PLACE, "start", "n", "from", "to")).alias("first")
    ).select("anchor", "u1", "u2", F.col("several").alias("across"), "first.*"), "passage-segments")
    mixed = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("across").alias("settled"))
    open_ones = materialise(
        segments.join(mixed.where("m > 1 AND NOT settled").select("anchor", "m"), "anchor"), "passage-open"
    )
    texts = wanted(docs, open_ones.select(*_PLACE).distinct()).select(
        F.col("_llm_file").alias("file"), F.col("_llm_row").alias("row"), F.col("text").cast("binary").alias("data")
    )
    cut = materialise(open_ones.join(texts, _PLACE).select(
        "anchor", "m", "u1", "u2", "across", *_PLACE, "n",
        F.substring("data", (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("bytes"),
    ), "passage-cut")
    hits = segments.where("across").select("anchor", "u1", "u2", F.lit(0).cast("long").alias("off"), "n")
    hits = hits.unionByName(_match(cut.where(F.col("m") <= most), words))
    large = cut.where(F.col("m") > most)
    if not large.isEmpty():
        hits = hits.unionByName(_count_windows(large, words))
    hits = materialise(hits, "passage-hits")
    start = F.col("start") + F.col("off")
    found = again.drop("n").join(hits, ["anchor", "u1", "u2"]).select(
        *_PLACE, F.struct(start.alias("start"), (start + F.col("n") + words - 1).alias("end")).alias("range")
    )
    state = "cast(named_struct('n', 0, 'reach', 0) AS struct<n:bigint,reach:bigint>)"
    covered = F.aggregate("ranges", F.expr(state), lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["reach"]))).alias("n"),
        F.greatest(acc["reach"], x["end"]).alias("reach"),
    ))
    return found.groupBy(*_PLACE).agg(F.sort_array(F.collect_list("range")).alias("ranges")).select(
        *_PLACE, covered["n"].alias("n_shared")
    )
