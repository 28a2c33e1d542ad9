"""SentencePiece ids with the original bytes behind every piece.

Normalisation walks the text by the longest prefix in the model's compiled character map (a double-array trie and its
replacements), and notes for every normalised byte the original byte it comes from.  Pieces tile the normalised text, so
the notes project each piece to a span of the original text, whatever was replaced, dropped or put in between.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import fresh
from assaylake.llm.shingles import slices
from assaylake.llm.wordcache import UnitCache

MARK = "▁"
#: Texts of about so many characters are encoded together.
CHARACTERS_AT_ONCE = 1 << 20
#: Units that a worker keeps with their ids.
CACHE = 700_000
_NOTHING = (0, "", np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), "")


# ------------------------------------------------------------------------------------------ the model file


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; value is an int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at:at + n]
            at += n


class CharacterMap:
    """The compiled map: size of the trie in bytes, its 32-bit units, then replacements that end with a zero byte."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        best = None
        node = self._child_base(0, self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            # The low byte of a unit is the label that leads to it; values have the top bit and no label.
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            base = self._child_base(node, unit)
            if unit >> 8 & 1:
                text = self.units[base] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[text:self.texts.index(b"\0", text)]
            node = base
        return best

    @staticmethod
    def _child_base(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))


class Model:
    """What normalisation needs of a model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        compiled, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        suffix = False
        for number, value in _fields(data):
            if number == 1:
                self.pieces.append(next((v for k, v in _fields(value) if k == 1), b"").decode())
            elif number == 2:
                suffix = any(k == 24 and v for k, v in _fields(value))
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        compiled = v
                    elif k in (3, 4, 5):
                        setattr(self, {3: "dummy_prefix", 4: "trim", 5: "escape"}[k], bool(v))
        if suffix or not self.escape:
            raise ValueError("models with white space as suffix, or kept as it is, are not covered")
        self.map = CharacterMap(compiled)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes, and its end, the original byte it starts from."""
        raw = text.encode()
        if not self.map.units and not self.trim:
            return self._plain(text, raw)
        chunks: list[bytes] = []
        starts: list[int] = []
        at = 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, raw[at:at + n]
            chunks.append(found[1])
            starts.append(at)
            at += found[0]
        if self.trim:
            while chunks and chunks[0] in (b" ", b""):
                del chunks[0], starts[0]
        out, source = bytearray(), []
        mark = MARK.encode()
        if chunks and self.dummy_prefix:
            out += mark
            source += [starts[0]] * 3
        spaced = self.trim
        for chunk, start in zip(chunks, starts):
            for byte in chunk:
                if byte == 0x20 and self.trim and spaced:
                    continue
                spaced = byte == 0x20
                new = mark if spaced else bytes([byte])
                out += new
                source += [start] * len(new)
        end = len(raw)
        if self.trim:
            while out.endswith(mark):
                end = source[-3]
                del out[-3:], source[-3:]
        return out.decode(), np.array([*source, end], np.int64)

    def _plain(self, text: str, raw: bytes) -> tuple[str, np.ndarray]:
        """No map and no trimming: each space becomes three bytes, all else stays."""
        if not raw:
            return "", np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        width = np.ones(len(raw) + 1, np.int8)
        width[:-1][data == 0x20] = 3
        if self.dummy_prefix:
            width[0] += 3
        normal = text.replace(" ", MARK)
        return MARK + normal if self.dummy_prefix else normal, np.repeat(np.arange(len(raw) + 1, dtype=np.int32), width)


# ------------------------------------------------------------------------------------------ encoding


class Encoder:
    """Ids, spans and decoded text of whole texts."""

    def __init__(self, model_path: str, cache: int = CACHE) -> None:
        import sentencepiece

        with open(model_path, "rb") as file:
            data = file.read()
        self.model = Model(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.mark_id = self.library.piece_to_id(MARK)
        # Borders across which nothing merges: before a run of marks, and around characters found in no longer piece.
        joined = {c for p in self.model.pieces if len(p) > 1 and not re.fullmatch(r"<0x[0-9A-F]{2}>", p) for c in p}
        across = any(a != MARK and b == MARK for p in self.model.pieces for a, b in zip(p, p[1:]))
        alone = "" if "\n" in joined else "\n"
        self.plain = not self.model.map.units and not self.model.trim and self.model.dummy_prefix and not across
        # A word ends before these signs, as no piece joins them to the letter before; letters for which one does are left out.
        signs = ".,;:!?|*#$%&"
        out = {a for p in self.model.pieces for a, b in zip(p, p[1:]) if b in signs and a.isalnum() and not a.isdecimal()}
        letters = r"[^\W\d_" + re.escape("".join(sorted(out))) + "]"
        word = rf"{MARK}*{letters}+(?=[{re.escape(signs)}{MARK}{alone}]|\Z)|"
        self.units = re.compile(word + f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.widths = [self._width(i) for i in range(self.library.vocab_size())]
        n = self.library.vocab_size()
        self.digits = [str(i) for i in range(n)]
        self.surface = [self.library.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.simple = {i for i in range(n) if not (
            self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)
        )}
        self.known = UnitCache(self._encode_units, cache)

    def _width(self, i: int) -> int:
        return 1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode())

    def _ids(self, units: list[str]) -> list[list[int]]:
        """Ids of parts of normalised text that start with a mark, or right after a border."""
        # The library puts one mark before what it gets; where there is none, a border character comes first and goes again.
        given = [u[1:] if u[0] == MARK else "\n" + u for u in units]
        found = self.library.encode(given)
        return [
            ([self.mark_id] if u == MARK else ids) if u[0] == MARK else ids[2:] for u, ids in zip(units, found)
        ]

    def _encode_units(self, new: list[str]):
        """Per unit: digits, ids and byte widths as little-endian 32-bit integers, and what it adds to the decoded text."""
        found = self._ids(new)
        odd = [k for k, ids in enumerate(found) if not self.simple.issuperset(ids)]
        # Byte pieces and the like are decoded by the library; a mark before keeps the unit's own leading space.
        texts = dict(zip(odd, self.library.decode([[self.mark_id, *found[k]] for k in odd])))
        for k, (unit, ids) in enumerate(zip(new, found)):
            widths = [self.widths[i] for i in ids]
            if 0 in ids:
                widths = self._unknown(unit, ids, widths)
            text = texts[k] if k in texts else "".join([self.surface[i] for i in ids])
            form = f"<{len(ids)}i"
            yield ",".join([self.digits[i] for i in ids]), struct.pack(form, *ids), struct.pack(form, *widths), text

    def _unknown(self, unit: str, ids: list[int], widths: list[int]) -> list[int]:
        """Without byte fallback, an unknown id stands for the characters up to where the next known piece starts."""
        data, at = unit.encode(), 0
        for k, i in enumerate(ids):
            if i == 0:
                after = next((self.library.id_to_piece(j).encode() for j in ids[k + 1:] if j), None)
                end = data.index(after, at + 1) if after else len(data)
                widths[k] = end - at
            at += widths[k]
        return widths

    def encode(self, text: str) -> tuple[int, str, np.ndarray, np.ndarray, np.ndarray, str]:
        """Number of ids, their digits joined by commas, ids, first and end byte of each in ``text``, decoded text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, str]]:
        """As ``encode``; what is new in some texts is encoded together."""
        for lo, hi in slices(texts, CHARACTERS_AT_ONCE):
            normal = [self.model.normalise(t) for t in texts[lo:hi]]
            if not self.plain:
                yield from (self._by_library(t, n, source) for t, (n, source) in zip(texts[lo:hi], normal))
                continue
            units = [self.units.findall(n) for n, _ in normal]
            values = iter(self.known.of([u for own in units for u in own]))
            for own, (_, source) in zip(units, normal):
                yield self._tiled(list(islice(values, len(own))), source)

    def _tiled(self, values: list[tuple], source: np.ndarray):
        if not values:
            return _NOTHING
        digits, ids, widths, decoded = zip(*values)
        ids, widths = (np.frombuffer(b"".join(x), "<i4") for x in (ids, widths))
        # The first mark is the model's own and is not decoded.
        return self._spans(ids, ",".join(digits), widths, "".join(decoded)[1:], source)

    def _by_library(self, text: str, normal: str, source: np.ndarray):
        if not normal:
            return _NOTHING
        ids = self.library.encode(text)
        widths = [self.widths[i] for i in ids]
        widths = np.array(self._unknown(normal, ids, widths) if 0 in ids else widths, np.int64)
        return self._spans(np.array(ids, np.int32), ",".join(map(str, ids)), widths, self.library.decode(ids), source)

    def _spans(self, ids, digits, widths, decoded, source):
        ends = np.cumsum(widths)
        if ends[-1] != len(source) - 1:
            raise ValueError("pieces do not tile the normalised text")
        places = source[np.concatenate([[0], ends])].astype(np.int64)
        return len(ids), digits, ids, places[:-1], places[1:], decoded

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids))


@lru_cache(maxsize=4)
def encoder(model_path: str, cache: int = CACHE) -> Encoder:
    """One per Python worker, which outlives a task."""
    return Encoder(model_path, cache)


#: Columns that ``encode`` can add.
OUTPUTS = {
    "n_tokens": "bigint", "ids": "array<int>", "starts": "array<bigint>", "ends": "array<bigint>", "decoded": "string",
    "ids_sha256": "string", "decoded_sha256": "string", "spans_crc32": "bigint",
}


def encode(docs: DataFrame, model_path: str, outputs: Sequence[str] = ("ids", "starts", "ends"),
           carry: list[str] | None = None, column: str = "pieces", cache: int = CACHE) -> DataFrame:
    """``docs`` (``text``) with a struct ``column`` of ``outputs``.

    ``ids`` are those of the sentencepiece library without begin and end; ``starts`` and ``ends`` the bytes of the text's
    UTF-8 form behind each id; ``decoded`` the library's text for the ids.  Byte pieces of one character all have that
    character's place.  Of the digests, ``ids_sha256`` is over decimal ids joined by commas, ``spans_crc32`` over starts
    and ends as little-endian 64-bit integers.  A null text counts as empty: no ids, empty arrays, empty decoded text.
    Rows are independent, so order, repeats and other columns do not matter; if ``docs`` has a column of the name
    ``column``, give another.  With ``carry`` only those columns are returned.  No rows are moved.
    A Python worker keeps up to ``cache`` units of texts with their ids, also after the last task; the result is the same.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    kept = docs.columns if carry is None else carry
    text = fresh(docs, "_text")
    rows = docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias(text))
    names = list(outputs)
    fields = [*[f for f in rows.schema.fields if f.name != text]]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                     f"`{column}` struct<{', '.join(f'{n}:{OUTPUTS[n]}' for n in names)}>"])
    arrow = pa.struct([(n, _ARROW[OUTPUTS[n]]) for n in names])

    def run(batches):
        own = encoder(model_path, cache)
        for b in batches:
            found = []
            for n, digits, ids, first, end, decoded in own.encode_all(b.column(len(fields)).to_pylist()):
                found.append(_row(names, n, digits, ids, first, end, decoded))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(fields)], pa.array(found, arrow)], names=[*[f.name for f in fields], column]
            )

    return rows.mapInArrow(run, ddl)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def _row(names, n, digits, ids, first, end, decoded) -> dict:
    make = {
        "n_tokens": lambda: n, "ids": lambda: ids, "starts": lambda: first, "ends": lambda: end, "decoded": lambda: decoded,
        "ids_sha256": lambda: hashlib.sha256(digits.encode()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
        "spans_crc32": lambda: zlib.crc32(end.astype("<i8").tobytes(), zlib.crc32(first.astype("<i8").tobytes())),
    }
    return {k: make[k]() for k in names}
