"""Near copies among vectors, by spherical-cap filters.

A filter is a direction; a vector is stored under every filter whose direction it leans to by at least ``lean``.  The
directions of one table are a random product code: the rotated space is cut into blocks, each block has a small code, and
every combination of one code word per block is a direction.  A vector's filters are list-decoded: per block only words
that can still reach ``lean`` with the best of the other blocks are combined.  Vectors that meet in a filter are compared.

Equal vectors are one node.  Nodes within half the angle of a common centre are all linked and form a ball, so a large
group of near copies is a few balls; filters are joined ball by ball, and two balls are settled by the angle of their
centres and their radii wherever these leave no doubt.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import fresh
from assaylake.llm.components import components
from assaylake.session import materialise

#: Vectors that chance brings into one filter.
CROWD = 8.0
#: Filters that a pair at the wanted cosine shares on average in codes of two blocks; finer codes, whose directions
#: depend more on each other, get half as many more for each further block, and as many more tables.
SHARED = 9.0
LEAST_MEET = 0.15
#: Tables, each with a rotation of its own; many small ones share filters more independently than one large one.
TABLES = 24
#: Words in the code of a block, at most; beyond it the space is cut into more blocks.
WORDS = 512
#: A node looks for a centre in so many of its filters, the ones it leans to most.
LEAD_FILTERS = 4
#: Bits of the sign sketch, and how many standard deviations beyond the mean distance still count as possible.
SKETCH_BITS = 64
SKETCH_REACH = 4.0
#: Angles are compared with so much room for rounding; inside it vectors are compared themselves.
ROOM = 1e-7


# --------------------------------------------------------------------------------------------------- the code


@lru_cache(maxsize=64)
def _tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines in order, and the probability that a random direction has at least that cosine with a given one."""
    t = np.linspace(0.0, 1.0, 200_001)
    density = (1 - t * t) ** ((max(dim, 3) - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return t, tail / (2 * tail[0])


def _lean(dim: int, rows: int, cosine: float) -> tuple[float, float]:
    """The lean of filters, and the probability that a random vector passes one.

    A filter holds about ``CROWD`` random vectors, unless pairs at ``cosine`` would then share less than one in
    1 / ``LEAST_MEET`` of their filters, as in few dimensions; there it holds more.
    """
    t, tail = _tail(dim)
    at = min(int(np.searchsorted(-tail, -min(CROWD / max(rows, 1), 0.2))), len(t) - 2)
    low, high = 0, at
    if _meet(dim, t[at], cosine) < LEAST_MEET:
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if _meet(dim, t[middle], cosine) >= LEAST_MEET else (low, middle)
        at = low
    return float(t[at]), float(tail[at])


def _meet(dim: int, lean: float, cosine: float) -> float:
    """Probability that a vector passes a filter which another one, at ``cosine``, passes."""
    t = np.linspace(lean, 1.0, 2001)[:-1]
    weight = (1 - t * t) ** ((max(dim, 3) - 3) / 2)
    # Given the first one's part t, the second has cosine * t plus a part of a random direction of one dimension less.
    need = (lean - cosine * t) / (math.sqrt(1 - cosine * cosine) * np.sqrt(1 - t * t))
    s = np.linspace(-1.0, 1.0, 20_001)
    density = (1 - s * s) ** ((max(dim, 4) - 4) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    passes = np.where(need <= -1, 1.0, np.where(need >= 1, 0.0, np.interp(need, s, above)))
    return float((weight * passes).sum() / weight.sum())


@dataclass(frozen=True)
class Code:
    """The least lean, one rotation, a table's own signs of the components before it, and the code words of its blocks."""

    lean: float
    turn: np.ndarray
    signs: np.ndarray
    words: tuple
    sketch: np.ndarray

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, filter and lean of all filters that unit vectors pass, by row, largest lean first."""
        rows, codes, leans = [], [], []
        size = math.prod(len(w) for w in self.words[0])
        for table, (signs, words) in enumerate(zip(self.signs, self.words)):
            y = (x * signs) @ self.turn
            first, scores = 0, []
            for w in words:
                scores.append(y[:, first:first + w.shape[1]] @ w.T)
                first += w.shape[1]
            row, code, lean = self._decode(scores)
            rows.append(row)
            codes.append(code + table * size)
            leans.append(lean)
        row, code, lean = (np.concatenate(v) for v in (rows, codes, leans))
        order = np.lexsort((code, -lean, row))
        return row[order], code[order], lean[order]

    def _decode(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = np.stack([s.max(axis=1) for s in scores])
        total = best.sum(axis=0)
        n = scores[0].shape[0]
        row, code, lean = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        left = total.copy()
        for j, s in enumerate(scores):
            left -= best[j]
            # Words that reach the lean with the best words of all other blocks.
            at, word = np.nonzero(s >= (self.lean - (total - best[j]))[:, None])
            count = np.bincount(at, minlength=n)
            start = np.cumsum(count) - count
            many = count[row]
            part = np.repeat(np.arange(len(row)), many)
            inside = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
            pick = start[row[part]] + inside
            new = lean[part] + s[at[pick], word[pick]]
            good = new + left[row[part]] >= self.lean
            row, code, lean = row[part][good], code[part][good] * s.shape[1] + word[pick][good], new[good]
        good = lean >= self.lean
        return row[good], code[good], lean[good]

    def bits(self, x: np.ndarray) -> np.ndarray:
        """One long of sign bits per vector."""
        return np.packbits(x @ self.sketch > 0, axis=1).view(">i8").ravel().astype(np.int64)


@lru_cache(maxsize=8)
def code_for(dim: int, rows: int, cosine: float) -> Code:
    """The code for so many vectors of ``dim`` components; the same in every task.  It takes ``dim`` squared numbers.

    The caps shrink with the number of rows, so that a filter holds about ``CROWD`` vectors by chance at every size, and
    the number of filters grows so that pairs at ``cosine`` share about ``SHARED``.
    """
    lean, chance = _lean(dim, rows, cosine)
    each = SHARED / max(_meet(dim, lean, cosine), 1e-6) / chance / TABLES
    blocks = min(dim, max(2, math.ceil(math.log(max(each, 2)) / math.log(WORDS))))
    more = 1 + (max(blocks, 2) - 2) / 2
    tables, directions = math.ceil(TABLES * more), each
    count = max(2, math.ceil(directions ** (1 / blocks)))
    rng = np.random.default_rng(dim * 1_000_003 + 17)
    cuts = [len(c) for c in np.array_split(np.arange(dim), blocks)]

    def units(n: int, width: int) -> np.ndarray:
        g = rng.standard_normal((n, width))
        return g / np.linalg.norm(g, axis=1, keepdims=True)

    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    signs = rng.integers(0, 2, (tables, dim)) * 2.0 - 1.0
    words = tuple(tuple(units(count, w) * math.sqrt(w / dim) for w in cuts) for _ in range(tables))
    return Code(lean, turn, signs, words, rng.standard_normal((dim, SKETCH_BITS)))


# --------------------------------------------------------------------------------------------------- in tasks


def _sketched(rows: int, cosine: float):
    """Arrow batches of (vector, carried columns) to the same with digest, sketch and filters; null where not usable."""

    def run(batches):
        for b in batches:
            lists = b.column(0)
            n = len(lists)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten()
            bad = np.asarray(flat.is_null())
            values = np.array(flat.fill_null(0), np.float64)
            ends = np.cumsum(sizes)
            first = ends - sizes
            digest = np.zeros((n, 2), np.int64)
            sketch = np.zeros(n, np.int64)
            filters: list = [None] * n
            usable = np.zeros(n, bool)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                mine = np.flatnonzero(sizes == dim)
                at = first[mine][:, None] + np.arange(dim)
                x = values[at]
                top = np.abs(x).max(axis=1)
                fine = np.isfinite(x).all(axis=1) & ~bad[at].any(axis=1) & (top > 0)
                mine, x = mine[fine], x[fine]
                if not len(mine):
                    continue
                x = x + 0.0  # -0.0 equals 0.0
                unit = x / top[fine][:, None]
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                code = code_for(dim, rows, cosine)
                usable[mine] = True
                sketch[mine] = code.bits(unit)
                digest[mine] = np.frombuffer(
                    b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x), "<i8"
                ).reshape(-1, 2)
                row, found, _ = code.filters(unit)
                parts = np.split(found + (dim << 48), np.cumsum(np.bincount(row, minlength=len(mine)))[:-1])
                for k, own in zip(mine.tolist(), parts):
                    filters[k] = own
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns, pa.array(usable), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sketch),
                    pa.array(filters, pa.list_(pa.int64())),
                ],
                names=[*b.schema.names, "usable", "d1", "d2", "sketch", "filters"],
            )

    return run


def _angles(batches):
    """Arrow batches that start with two vector columns: these give way to cosine and angle, in double precision."""
    for b in batches:
        x, y = (np.array(b.column(i).flatten(), np.float64) for i in (0, 1))
        sizes = np.asarray(b.column(0).value_lengths())
        first = np.cumsum(sizes) - sizes
        cosine = np.zeros(len(sizes))
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            at = first[mine][:, None] + np.arange(dim)
            u, v = x[at], y[at]
            u, v = (z / np.abs(z).max(axis=1, keepdims=True) for z in (u, v))
            cosine[mine] = np.einsum("ij,ij->i", u, v) / np.sqrt(
                np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v)
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(cosine), pa.array(np.arccos(np.clip(cosine, -1, 1))), *b.columns[2:]],
            names=["cosine", "angle", *b.schema.names[2:]],
        )


def _compared(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``cosine`` and ``angle`` of the vectors of nodes ``a`` and ``b`` (of one dimension)."""
    given = pairs.join(vectors.select(F.col("node").alias(a), F.col("vector").alias("vector_a")), a).join(
        vectors.select(F.col("node").alias(b), F.col("vector").alias("vector_b")), b
    )
    rest = [f for f in pairs.schema.fields]
    ddl = "cosine double, angle double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return given.select("vector_a", "vector_b", *[f.name for f in rest]).mapInArrow(_angles, ddl)


# --------------------------------------------------------------------------------------------------- the operator


def _reach(angle: Column) -> Column:
    """Largest number of differing sketch bits that vectors at ``angle`` may have."""
    q = F.least(angle / math.pi, F.lit(1.0))
    return SKETCH_BITS * q + SKETCH_REACH * F.sqrt(SKETCH_BITS * q * (1 - q)) + 1


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def groups(vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", value: str = "embedding",
           carry: list[str] | None = None, column: str = "caps") -> DataFrame:
    """``vectors`` with a struct ``column`` of ``n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable by links, its own included) and ``kept`` (its id is that one).

    Two rows link if they meet in a filter, or stand in balls that do, and their cosine, in double precision, is at least
    ``cosine``; no pair below links.  What filters miss is stated by ``recall`` in the tests: pairs right at the cosine are
    found with a probability over 0.95, closer ones almost surely, equal vectors always.  Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing and are components of their own, as are vectors of
    another number of components.  Rows with one id are rows of their own; a null id is in a component like any other but
    never its smallest id, unless all are null.  Ties of ids are broken by rows.  An empty table gives an empty result.
    Extra columns stay; with ``carry`` only those do.  If ``vectors`` has a column of the name ``column``, give another.
    """
    if column.lower() in {c.lower() for c in vectors.columns}:
        raise ValueError(f"vectors has a column {column}; name another")
    kept = vectors.columns if carry is None else carry
    inner = fresh(vectors, "_given")
    wide = math.acos(cosine)
    half = wide / 2 - ROOM
    total = vectors.count()
    given = vectors.select(
        F.col(value).alias("vector"), F.col(id_column).alias("id"), F.struct(*kept).alias(inner)
    )
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    found = given.mapInArrow(
        _sketched(total, cosine), f"{ddl}, usable boolean, d1 long, d2 long, sketch long, filters array<long>"
    )
    # Written once: numbers given on the way would change when a lost task runs again.
    rows = materialise(found.withColumn("at", F.monotonically_increasing_id()), "caps-rows")
    copies = materialise(
        rows.where("usable").groupBy("d1", "d2").agg(
            F.min("at").alias("node"), F.min("id").alias("label"), F.count(F.lit(1)).alias("weight")
        ), "caps-nodes",
    )
    usable = rows.where("usable").select(F.col("at").alias("node"), "vector", "sketch", "filters")
    nodes = usable.drop("vector").join(copies.select("node", "weight", "label"), "node")
    vectors_of = usable.select("node", "vector")

    balls, members = _balls(nodes, vectors_of, half)
    joined = _ball_pairs(nodes, members, balls, vectors_of, wide)
    per_ball, per_node, edges = _links(joined, members, balls, vectors_of, wide, cosine)

    inside = members.join(balls.select("ball", "mass", "least"), "ball")
    edges = edges.unionByName(
        inside.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    )
    linked = components(edges)
    names = linked.join(copies.select("node", "label"), "node").groupBy("component").agg(F.min("label").alias("component_id"))
    named = linked.join(names, "component").select("node", "component_id")
    sums = inside.join(per_ball, "ball", "left").join(per_node, "node", "left").select(
        "node", (F.col("mass") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("node_links", F.lit(0))).alias("n_links")
    )
    result = copies.join(sums, "node").join(named, "node", "left").select(
        "d1", "d2", "n_links", F.coalesce("component_id", "label").alias("component_id")
    )
    good = rows.where("usable").select("d1", "d2", "id", inner).join(result, ["d1", "d2"])
    alone = rows.where("NOT usable").select(inner, "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = good.select(*alone.columns).unionByName(alone)
    return both.select(
        *[F.col(inner)[c].alias(c) for c in kept],
        F.struct("n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).alias(column),
    )


def _balls(nodes: DataFrame, vectors: DataFrame, half: float) -> tuple[DataFrame, DataFrame]:
    """Balls (ball, radius, mass, least, size) and members (node, ball, angle, weight); each node is in one ball.

    Every filter names one node, and a node takes the foremost of those its leading filters name, if it lies within half
    the angle.  The centre itself may be in another ball; that changes nothing, as a ball is a place, not a group.
    """
    few = nodes.select("node", "sketch", F.explode(F.slice("filters", 1, LEAD_FILTERS)).alias("filter"))
    lead = few.groupBy("filter").agg(F.min(F.struct(F.xxhash64("node").alias("turn"), "node", "sketch")).alias("lead"))
    close = F.bit_count(F.col("sketch").bitwiseXOR(F.col("lead.sketch"))) <= _reach(F.lit(half))
    named = few.join(lead, "filter").where((F.col("lead.node") != F.col("node")) & close)
    asked = named.groupBy("node").agg(F.min("lead").alias("lead")).select("node", F.col("lead.node").alias("ball"))
    near = _compared(asked, vectors, "node", "ball").where(F.col("angle") <= half).select("node", "ball", "angle")
    members = materialise(
        nodes.select("node", "weight").join(near, "node", "left").select(
            "node", F.coalesce("ball", "node").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"), "weight"
        ), "caps-members",
    )
    balls = materialise(members.groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("weight").alias("mass"), F.min("node").alias("least"),
        F.count(F.lit(1)).alias("size"),
    ), "caps-balls")
    return balls, members


def _ball_pairs(nodes: DataFrame, members: DataFrame, balls: DataFrame, vectors: DataFrame, wide: float) -> DataFrame:
    """Pairs of balls that meet in a filter and may hold links: a, b, their radii, masses and so on, angle of centres."""
    of_ball = balls.select("ball", "radius", "size").join(
        nodes.select(F.col("node").alias("ball"), F.col("sketch").alias("centre")), "ball"
    )
    held = nodes.select("node", "filters").join(members.select("node", "ball"), "node").join(of_ball, "ball")
    rows = held.select("ball", "radius", "size", "centre", F.explode("filters").alias("filter"))
    several = rows.where("size > 1").groupBy("filter", "ball").agg(
        F.first("radius").alias("radius"), F.first("centre").alias("centre")
    )
    stored = rows.where("size = 1").select("filter", "ball", "radius", "centre").unionByName(
        several.select("filter", "ball", "radius", "centre")
    )
    left = stored.select("filter", *[F.col(c).alias(f"{c}_a") for c in ("ball", "radius", "centre")])
    right = stored.select("filter", *[F.col(c).alias(f"{c}_b") for c in ("ball", "radius", "centre")])
    met = left.join(right, "filter").where(
        (F.col("ball_a") < F.col("ball_b"))
        & (_differ("centre_a", "centre_b") <= _reach(F.col("radius_a") + F.col("radius_b") + wide))
    ).select("ball_a", "ball_b").distinct()
    side = lambda k: balls.select(*[F.col(c).alias(f"{c}_{k}") for c in ("ball", "radius", "mass", "least", "size")])
    far = F.col("angle") - F.col("radius_a") - F.col("radius_b") > wide + ROOM
    compared = _compared(met, vectors, "ball_a", "ball_b").join(side("a"), "ball_a").join(side("b"), "ball_b")
    return materialise(compared.where(~far), "caps-pairs")


def _links(pairs: DataFrame, members: DataFrame, balls: DataFrame, vectors: DataFrame, wide: float, cosine: float):
    """Links beyond balls: (ball, ball_links), (node, node_links) and edges (a, b) of nodes."""
    single = (F.col("size_a") == 1) & (F.col("size_b") == 1) & (F.col("radius_a") == 0) & (F.col("radius_b") == 0)
    whole = F.when(single, F.col("cosine") >= cosine).otherwise(
        F.col("angle") + F.col("radius_a") + F.col("radius_b") <= wide - ROOM
    )
    settled = pairs.where(whole)
    open_pairs = pairs.where(~whole & ~single)
    # The larger ball's members are compared with the smaller one's centre, and the smaller one's members only if need be.
    swap = F.col("size_a") < F.col("size_b")
    sided = open_pairs.select(*[
        F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
        for c in ("ball", "radius", "mass", "least") for x, y in (("a", "b"), ("b", "a"))
    ])
    rows = sided.join(
        members.select(F.col("ball").alias("ball_a"), F.col("node").alias("node_a"), F.col("weight").alias("weight_a")), "ball_a"
    ).select("node_a", "weight_a", "ball_b", "radius_b", "mass_b", "least_b")
    against = materialise(_compared(rows, vectors, "node_a", "ball_b"), "caps-against")
    inside = F.col("angle") + F.col("radius_b") <= wide - ROOM
    outside = F.col("angle") - F.col("radius_b") > wide + ROOM
    one_sided = against.where(inside)
    each = against.where(~inside & ~outside).select("node_a", "weight_a", "ball_b").join(
        members.select(F.col("ball").alias("ball_b"), F.col("node").alias("node_b"), F.col("weight").alias("weight_b")), "ball_b"
    ).select("node_a", "weight_a", "node_b", "weight_b")
    single_links = materialise(
        _compared(each, vectors, "node_a", "node_b").where(F.col("cosine") >= cosine), "caps-single"
    )
    per_ball = settled.select(F.col("ball_a").alias("ball"), F.col("mass_b").alias("n")).unionByName(
        settled.select(F.col("ball_b").alias("ball"), F.col("mass_a").alias("n"))
    ).unionByName(one_sided.select(F.col("ball_b").alias("ball"), F.col("weight_a").alias("n")))
    per_node = one_sided.select(F.col("node_a").alias("node"), F.col("mass_b").alias("n")).unionByName(
        single_links.select(F.col("node_a").alias("node"), F.col("weight_b").alias("n"))
    ).unionByName(single_links.select(F.col("node_b").alias("node"), F.col("weight_a").alias("n")))
    edges = settled.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")).unionByName(
        one_sided.select(F.col("node_a").alias("a"), F.col("least_b").alias("b"))
    ).unionByName(single_links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return (
        per_ball.groupBy("ball").agg(F.sum("n").alias("ball_links")),
        per_node.groupBy("node").agg(F.sum("n").alias("node_links")), edges,
    )
