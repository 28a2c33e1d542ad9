"""What repeated passages of bytes and of words share: anchors of windows, segments of one anchor, texts worth moving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of segments that are compared at once.
CHUNK = 1 << 20
#: Different segments of an anchor that one task may hold.
MOST_SEGMENTS = 4_000
#: Up to so many wanted rows, their 64-bit hashes (16 MB) go to all tasks and keep other texts from moving.
FILTER_ROWS = 1_000_000
_U = np.uint64
_PLACE = 21


def smallest(hashes: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash in each window of ``w`` places, the leftmost of equal ones: block-wise minima from both sides."""
    n = len(hashes)
    packed = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (hashes >> _U(_PLACE) << _U(_PLACE)) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - w + 1
    return (np.minimum(left[:starts], right[w - 1:w - 1 + starts]) & _U((1 << _PLACE) - 1)).astype(np.int64)


def whole_anchors(batches) -> Iterator[list[dict]]:
    """Rows of whole anchors, about CHUNK bytes together; rows come sorted by anchor."""
    held, size = [], 0
    for b in batches:
        for r in b.to_pylist():
            if size >= CHUNK and r["anchor"] != held[-1]["anchor"]:
                yield held
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
    if held:
        yield held


def ranges(hit: np.ndarray, seg: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits in a row in one segment: the segment, the first one's place in it, and how many."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (seg[at][1:] != seg[at][:-1])
    first = np.flatnonzero(new)
    return seg[at[first]], inside[at[first]], np.diff(first, append=len(at)).astype(np.int64)


def wanted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` without most rows that ``places`` (file, row) does not have, where a short list of them can tell."""
    if places.count() > FILTER_ROWS:
        return docs
    short = places.select(F.xxhash64("file", "row").alias("short")).distinct()
    return docs.join(F.broadcast(short), F.xxhash64("_llm_file", "_llm_row") == F.col("short"), "left_semi")
