"""Token ids in files of word-aligned blocks (Simple-8b).

A 64-bit word holds a selector in its low 4 bits and, above, as many ids of one width as fit into 60 bits:

    selector  0    1    2   3   4   5   6   7   8  9  10  11  12  13  14
    ids       esc  60   30  20  15  12  10  8   7  6  5   4   3   2   1
    bits      -    1    2   3   4   5   6   7   8  10 12  15  20  30  60

Selector 0 is an escape: one id of more than 60 bits, which stands in the block's escape area.  An encoder takes at every
id the selector that holds the most of what follows; a block's last word may hold fewer ids than its selector says, and
the block's number of ids tells.

A block holds whole documents in order, and is a row of a Parquet table, so that Spark writes and commits it and any
store can hold it: ``part`` and ``block`` (place in the order), ``doc_ids`` and ``lengths`` (ids of each document),
``n_ids``, ``words`` and ``escapes`` (little-endian), and ``offsets``: for every 64th word the number of ids before it.
With selectors and offsets the place of every id is known before any is unpacked, and all words of a selector are
unpacked at once.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaylake.llm.wordcache import UnitCache

#: Ids per word and bits per id by selector, fixed by the format.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
OFFSET_EVERY = 64
#: A block is closed at so many ids.  A longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Texts of about so many bytes are encoded together, so that a unit is looked up once for all of them.
BYTES_AT_ONCE = 1 << 22

BLOCK_SCHEMA = (
    "part int, block int, doc_ids array<{id}>, lengths array<bigint>, n_ids bigint, words binary, escapes binary, "
    "offsets array<bigint>"
)


def _fits_from(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id the selector an encoder takes there, and how many ids that word holds."""
    n = len(ids)
    selector, taken = np.zeros(n, np.int8), np.ones(n, np.int32)
    small = np.arange(n, dtype=np.int32)
    # The narrowest width that holds every id beats all wider ones.
    most = int(ids.max()) if n else 0
    first = next((s for s in range(1, len(COUNTS)) if most < 1 << int(WIDTHS[s])), len(COUNTS) - 1)
    if most < 1 << 31:
        ids = ids.astype(np.int32)
    # From wide to narrow: a narrower selector that is full, or reaches the end, holds more and wins.
    for s in range(first, 0, -1):
        small = small[ids[small] < ids.dtype.type(1 << int(WIDTHS[s]))] if s < first or most >= 1 << 60 else small
        if not len(small):
            break
        # Ids in a row that are small enough end where the next place is not the next small one.
        last = np.flatnonzero(np.diff(small, append=np.int32(n + 1)) != 1)
        run = np.diff(last, prepend=-1)
        count = int(COUNTS[s])
        # Short runs hold no full word, unless they reach the end.
        good = (run >= count) | (small[last] == n - 1)
        if not good.any():
            continue
        where = small if good.all() else small[np.repeat(good, run)]
        wanted = np.minimum(count, n - where)
        ok = np.repeat(small[last][good] + 1, run[good]) - where >= wanted
        where = where[ok]
        selector[where], taken[where] = s, wanted[ok]
    return selector, taken


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and offsets of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    selector, taken = _fits_from(ids)
    step, starts, i, n = taken.tolist(), [], 0, len(ids)
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    chosen, held = selector[at].astype(np.int64), taken[at]
    words = chosen.astype(np.uint64)
    for s in range(1, len(COUNTS)):
        here = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            has = here[held[here] > k]
            if not len(has):
                break
            words[has] |= ids[at[has] + k] << np.uint64(4 + k * int(WIDTHS[s]))
    return words, ids[at[chosen == 0]], at[::OFFSET_EVERY]


def unpack(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of a block."""
    chosen = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[chosen]
    # Places of words: the stored offset of their group, plus what the group's earlier words hold.
    inside = np.cumsum(counts) - counts
    group = np.arange(len(words)) // OFFSET_EVERY
    at = offsets[group] + inside - inside[::OFFSET_EVERY][group] if len(words) else inside
    out = np.zeros(n_ids + int(COUNTS.max()), np.uint64)
    for s in range(1, len(COUNTS)):
        here = np.flatnonzero(chosen == s)
        if len(here):
            width, count = int(WIDTHS[s]), int(COUNTS[s])
            shifts = np.uint64(4) + np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = (words[here][:, None] >> shifts) & np.uint64((1 << width) - 1)
            places = at[here][:, None] + np.arange(count)
            real = places < n_ids
            out[places[real]] = values[real]
    out[at[chosen == 0]] = escapes
    return out[:n_ids]


def blocks_of(part: int, documents: Iterator[tuple[int | None, bytes]], block_ids: int = BLOCK_IDS) -> Iterator[dict]:
    """Blocks of (doc_id, ids as little-endian uint32 bytes) in order."""
    doc_ids, chunks, held, number = [], [], 0, 0

    def close() -> dict:
        ids = np.frombuffer(b"".join(chunks), "<u4").astype(np.uint64)
        words, escapes, offsets = pack(ids)
        return {
            "part": part, "block": number, "doc_ids": doc_ids, "lengths": [len(c) // 4 for c in chunks],
            "n_ids": len(ids), "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes(),
            "offsets": offsets.tolist(),
        }

    for doc_id, data in documents:
        n = len(data) // 4
        if doc_ids and held + n > block_ids:
            yield close()
            doc_ids, chunks, held, number = [], [], 0, number + 1
        doc_ids.append(doc_id)
        chunks.append(data)
        held += n
    if doc_ids:
        yield close()


def write(docs: DataFrame, path: str, encode, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``) below ``path``, documents in ascending doc_id.

    ``encode()`` is called once per task and returns a function from an Arrow array of texts to their ids in order, each the
    little-endian uint32 bytes of a document.  A null text counts as empty.  ``doc_id`` is a number or a text; null comes first,
    repeated ids follow their texts' order.  Other columns are not read.  An empty table writes a table without blocks.

    One range shuffle orders the documents; each task writes its blocks as it goes.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange(n, "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def encoded(batches):
        run, part = encode(), 0

        def documents():
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column(2)[0].as_py()
                    yield from zip(b.column(0).to_pylist(), run(b.column(1)))

        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(arrow_id)),
            ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary()),
            ("offsets", pa.list_(pa.int64())),
        ])
        for block in blocks_of(0, documents(), block_ids):
            yield pa.RecordBatch.from_pylist([block | {"part": part}], schema)

    ordered.mapInArrow(encoded, BLOCK_SCHEMA.format(id=id_type.simpleString())).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: doc_id, part, block, place, ids (array of longs).  Order as written."""

    stored = spark.read.parquet(path)
    id_type = stored.schema["doc_ids"].dataType.elementType
    arrow_id = to_arrow_type(id_type)

    def decoded(batches):
        for block, rows, ids in _documents(batches):
            ends = np.cumsum(rows["lengths"])
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
            n = len(rows["doc_ids"])
            yield pa.RecordBatch.from_arrays([
                pa.array(rows["doc_ids"], arrow_id), pa.array([rows["part"]] * n, pa.int32()),
                pa.array([rows["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), arrays,
            ], names=["doc_id", "part", "block", "place", "ids"])

    return stored.mapInArrow(decoded, f"doc_id {id_type.simpleString()}, part int, block int, place int, ids array<bigint>")


def _documents(batches):
    for b in batches:
        for i, rows in enumerate(b.to_pylist()):
            yield i, rows, unpack(
                np.frombuffer(rows["words"], "<u8").astype(np.uint64), np.frombuffer(rows["escapes"], "<u8").astype(np.uint64),
                np.array(rows["offsets"], np.int64), rows["n_ids"],
            )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    ``ids_crc32`` is over the ids, decoded from the files, as little-endian unsigned 32-bit integers.  Starts come from the
    number of ids of each block, summed up inside a part and over the parts: two small tables.
    """
    stored = spark.read.parquet(path)
    id_type = stored.schema["doc_ids"].dataType.elementType
    arrow_id = to_arrow_type(id_type)
    sizes = stored.select("part", "block", "n_ids")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("part_start")
    )
    starts = sizes.select(
        "part", "block", F.coalesce(F.sum("n_ids").over(before("part", "block")), F.lit(0)).alias("block_start")
    ).join(per_part, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))

    def summed(batches):
        for _, rows, ids in _documents(batches):
            lengths = np.array(rows["lengths"], np.int64)
            ends = np.cumsum(lengths)
            data = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array([rows["part"]] * len(lengths), pa.int32()), pa.array([rows["block"]] * len(lengths), pa.int32()),
                pa.array(rows["doc_ids"], arrow_id), pa.array(ends - lengths), pa.array(lengths),
                pa.array([zlib.crc32(data[4 * (e - n):4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())], pa.int64()),
            ], names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = stored.mapInArrow(summed, f"part int, block int, doc_id {id_type.simpleString()}, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


#: What is not Latin letters, digits and ASCII marks, on which lower-casing and normal form are plain; "<|" opens added tokens.
_ODD = "<[|]|[^!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]"
#: The model's word pattern over plain characters (fixed by the model), and the border between units.
_WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\sa-z0-9\xDF-\xF6\xF8-\xFF]+")
_PIECES_AT_ONCE = 4096


def _byte_letters() -> list[str]:
    """The model's character for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def _known_words(model_path: str, cache: int) -> tuple[UnitCache, UnitCache]:
    """What a Python worker keeps beyond a task: ids of pieces of plain units, and of other units."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer = Tokenizer.from_file(model_path)
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = WhitespaceSplit()
    alphabet = _byte_letters()

    def pieces(new: list[str]) -> Iterator[bytes]:
        # What the model's earlier steps would make of a piece: its bytes as characters, none of them white space.
        letters = [p if p.isascii() else "".join([alphabet[b] for b in p.encode()]) for p in new]
        for at in range(0, len(letters), _PIECES_AT_ONCE):
            part = letters[at:at + _PIECES_AT_ONCE]
            found = bare.encode(" ".join(part), add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            edges = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            yield from (data[a:b] for a, b in zip(edges, edges[1:]))

    def others(new: list[str]) -> Iterator[bytes]:
        for found in tokenizer.encode_batch(new, add_special_tokens=False):
            yield np.array(found.ids, "<u4").tobytes()

    return UnitCache(pieces, cache), UnitCache(others, cache // 2)


def word_encoder(model_path: str, end_id: int, cache: int = 800_000):
    """An ``encode`` for ``write``: the tokenizers library's ids without special tokens, then ``end_id``.

    The model drops white space and never merges across it, and neither its normaliser nor its added tokens look across
    white space; so a text's ids are those of its units between white space.  A plain unit's are those of its pieces by the
    model's word pattern.  Units and pieces repeat: each is looked up once for all its places in a slice of texts.
    """

    def make():
        known = _known_words(model_path, cache)

        def run(texts) -> Iterator[bytes]:
            texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
            for part in _slices(texts):
                yield from _ids_of(part, *known, end_id)

        return run

    return make


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of about ``BYTES_AT_ONCE``; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield texts.slice(at, to - at)
        at = to


class _Runs:
    """Runs of ids, one after the other in ``flat``."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size, self.first = flat, size, np.cumsum(size) - size

    @staticmethod
    def of(values: list[bytes]) -> _Runs:
        return _Runs(np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs at ``places`` in a row, and how many of them lie before each place and the end."""
        n = self.size[places]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.first[places] - ends[:-1], n) + np.arange(ends[-1])], ends


def _ids_of(texts: pa.Array, pieces: UnitCache, others: UnitCache, end_id: int) -> Iterator[bytes]:
    """The ids of each text and ``end_id``."""
    parts = pc.ascii_split_whitespace(texts)
    units = parts.flatten().dictionary_encode()
    odd = pc.match_substring_regex(units.dictionary, _ODD)
    plain = _plain_runs(units.dictionary.filter(pc.invert(odd)), pieces)
    other = _Runs.of(others.of(units.dictionary.filter(odd).to_pylist()))
    both = _Runs(np.concatenate([plain.flat, other.flat]), np.concatenate([plain.size, other.size]))
    # Plain units first, others behind them, each in the dictionary's order.
    odd = odd.to_numpy(zero_copy_only=False).astype(bool)
    place = np.where(odd, len(plain.size) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
    ids, ends = both.at(place[units.indices.to_numpy()])
    edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])].tolist()
    end = struct.pack("<I", end_id)
    for a, b in zip(edges, edges[1:]):
        yield ids[a:b].tobytes() + end


def _joined(texts: pa.Array) -> str:
    """Texts with a line feed between two, as one string: far cheaper than a Python string for each."""
    rows = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(rows, pa.scalar("\n", texts.type))[0].as_py()


def _plain_runs(units: pa.Array, known: UnitCache) -> _Runs:
    """The ids of plain units; an empty one, as white space at a text's borders leaves it, has none."""
    if not len(units):
        return _Runs.of([])
    found = pa.array(_WORD.findall(_joined(units).lower()), pa.string()).dictionary_encode()
    border = pc.index(found.dictionary, "\n").as_py()
    names = found.dictionary.filter(pc.not_equal(found.dictionary, "\n"))
    values = known.of(_joined(names).split("\n") if len(names) else [])
    if border >= 0:
        values.insert(border, b"")
    runs, codes = _Runs.of(values), found.indices.to_numpy()
    flat, _ = runs.at(codes)
    unit = np.cumsum(codes == border)
    return _Runs(flat, np.bincount(unit, runs.size[codes], len(units)).astype(np.int64))
