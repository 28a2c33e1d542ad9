"""Language identification by a byte convolutional network in numpy.

A window of ``WINDOW`` bytes passes filters of several widths; each filter keeps its largest response in the window, and a
softmax layer turns these into language probabilities.  A text is cut into windows from start to end, the last one filled
up with spaces; the windows' log probabilities are averaged.

On bytes, a filter is a table: its response is a sum of one entry per position.  Prediction joins entries of neighbouring
positions to tables over byte pairs, so a filter of width 4 takes two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.llm.common import fresh

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bounds of the training sample: rows, and windows of a row.  Nothing else is bounded.
TRAIN_ROWS, TRAIN_WINDOWS = 6000, 2
MAX_LANGUAGES = 1000
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Bytes whose responses are in memory at once.
SLICE = 1 << 18
UNKNOWN = "und"


@dataclass
class Network:
    """``filters[w]``: (w, 256, FILTERS); ``dense``: (features, languages)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray
    _tables: dict = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def fresh(languages: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        size = FILTERS * len(WIDTHS)
        return Network(
            languages,
            {w: rng.normal(0, 0.5 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            rng.normal(0, size**-0.5, (size, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width: (position, table) with tables over byte pairs, and one over bytes where the width is odd."""
        if not self._tables:
            for w, f in self.filters.items():
                parts = [(j, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
                self._tables[w] = parts + ([(w - 1, f[w - 1])] if w % 2 else [])
        return self._tables

    def features(self, data: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes to (windows, features)."""
        pairs = data[:, :-1].astype(np.uint16) << 8 | data[:, 1:]
        out = []
        for w, parts in self.tables().items():
            n = WINDOW - w + 1
            sums = None
            for j, table in parts:
                at = pairs[:, j:j + n] if len(table) == 65536 else data[:, j:j + n]
                got = table.take(at.ravel(), axis=0)
                sums = got if sums is None else np.add(sums, got, out=sums)
            out.append(np.maximum(sums.reshape(len(data), n, FILTERS).max(axis=1) + self.offsets[w], 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        return _log_softmax(self.features(data) @ self.dense + self.bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows(text: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes of a whole text, the end filled up with spaces."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Adam on the cross-entropy of single windows; rare languages weigh as much as frequent ones."""
    languages = sorted(set(labels))
    net = Network.fresh(languages, seed)
    data = np.stack([windows(t[:WINDOW])[0] for t in texts])
    target = np.searchsorted(languages, labels)
    weight = len(target) / (len(languages) * np.bincount(target, minlength=len(languages)))
    params = [*net.filters.values(), *net.offsets.values(), net.dense, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            grads = _gradients(net, data[rows], target[rows], weight[target[rows]].astype(np.float32))
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _gradients(net: Network, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, rows = len(data), np.arange(len(data))[:, None]
    best, pooled = {}, []
    for w, f in net.filters.items():
        span = WINDOW - w + 1
        sums = sum(f[j].take(data[:, j:j + span].ravel(), axis=0) for j in range(w)).reshape(n, span, FILTERS)
        best[w] = sums.argmax(axis=1)
        pooled.append(sums.max(axis=1) + net.offsets[w])
    raw = np.concatenate(pooled, axis=1)
    features = np.maximum(raw, 0)
    error = np.exp(_log_softmax(features @ net.dense + net.bias))
    error[np.arange(n), target] -= 1
    error *= weight[:, None] / n
    back = (error @ net.dense.T) * (raw > 0)
    filters, offsets = [], []
    for k, (w, f) in enumerate(net.filters.items()):
        part = back[:, k * FILTERS:(k + 1) * FILTERS]
        g = np.zeros_like(f)
        for j in range(w):
            np.add.at(g[j], (data[rows, best[w] + j], np.arange(FILTERS)), part)
        filters.append(g)
        offsets.append(part.sum(axis=0))
    return [*filters, *offsets, features.T @ error, error.sum(axis=0)]


def sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """Up to ``rows`` texts' windows with their label, about as many of each language, chosen by a hash of the text.

    A counting pass over distinct texts gives each language its share, which thins frequent ones; of what is left, every
    language gives its next text in turn, so that one with few texts keeps them all.  ``rows`` bounds what reaches the
    driver.
    """
    place = F.xxhash64("text", F.lit("sample"))
    per_language = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count_distinct(place).alias("n")).collect()}
    if len(per_language) > MAX_LANGUAGES:
        raise ValueError(f"{len(per_language)} labels; the bound is {MAX_LANGUAGES}")
    share = F.lit(0.0)
    for lang, n in per_language.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * rows / len(per_language) / n))).otherwise(share)
    uniform = F.shiftrightunsigned(place, 11) / float(1 << 53)
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    cuts = F.array(*[
        F.substring(F.col("text"), (F.pmod(F.xxhash64("text", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW))
        for i in range(TRAIN_WINDOWS)
    ])
    chosen = labelled.where(uniform < share).select("lang", place.alias("place"), cuts.alias("cuts")).distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "cuts"))
    taken = chosen.withColumn("turn", turn).orderBy("turn", "lang").limit(rows).collect()
    return [(r.lang, cut) for r in taken for cut in r.cuts]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None, carry: list[str] | None = None, column: str = "language") -> DataFrame:
    """``docs`` (``text``) with a struct ``column``: lang_pred and score (0 to 1).

    Whole texts are read.  A null or empty text, or one without a letter, is ``und`` with score 0, and so is every text if
    there is no network because nothing was labelled.  Rows are independent; other columns are not read, and repeated
    rows get the same answer.  If ``docs`` has a column of the name ``column``, give another.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    kept = docs.columns if carry is None else carry
    if net is None:
        unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return docs.select(*kept, unknown.alias(column))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return predict_texts(shared.value, [t.encode() if isinstance(t, str) else None for t in texts])

    own = fresh(docs, "_text")
    return docs.select(*kept, F.when(has_letter(F.col("text")), F.col("text")).alias(own)).withColumn(
        column, run(own)
    ).drop(own)


def predict_texts(net: Network, texts: list[bytes | None]) -> pd.DataFrame:
    total = np.zeros((len(texts), len(net.languages)))
    count = np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            owner = np.concatenate(owners)
            np.add.at(total, owner, net.log_probabilities(np.concatenate(held)))
            np.add.at(count, owner, 1)
        held.clear()
        owners.clear()
        size = 0

    step = SLICE // WINDOW
    for i, text in enumerate(texts):
        if text is None:
            continue
        cut = windows(text)
        for at in range(0, len(cut), step):
            held.append(cut[at:at + step])
            owners.append(np.full(len(held[-1]), i))
            size += held[-1].size
            if size >= SLICE:
                flush()
    flush()
    known = count > 0
    p = np.exp(_log_softmax(total / np.maximum(count, 1)[:, None]))
    best = p.argmax(axis=1)
    return pd.DataFrame({
        "lang_pred": np.where(known, np.array(net.languages, object)[best], UNKNOWN),
        "score": np.where(known, p[np.arange(len(p)), best], 0.0),
    })
