"""The prefix trie of conversations, and totals over its subtrees by parallel tree contraction.

A node is a distinct sequence of first turns.  Each turn gives 128 bits of hash of its place, role and text, and a prefix is
known by the sums of its turns' parts, which any number of tasks can add up; no conversation is walked by one task.

Totals over subtrees come from contraction: rounds take away all leaves (rake) and, of every chain of nodes with a single
child, those whose random draw is below their neighbours' (compress), so that a tree of any shape is gone after a number of
rounds that grows with the logarithm of its size.  Then the rounds are gone through backwards, and what was taken away gets
its total from the node that stood in for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import materialise

#: Turns of one conversation that are added up together.
CHUNK_TURNS = 1024
#: Ids in one piece of the list of a node's conversations.
IDS_AT_ONCE = 1 << 16
#: Characters of a text by which turns of one place and role are ordered, before its digest.
TIE_CHARACTERS = 64
_SUMS = ("s1", "s2", "s3", "s4")
_PARTS = ("p1", "p2", "p3", "p4")
_ENDS_NONE = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------------------------------ places and prefixes


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns (``conv_id``, ``turn``, ``role``, ``text``) as conv_id, place (1, 2, ...), digest and n_bytes of the text.

    Turns are in the order of ``turn``, null first; of one turn, in that of role, then of the text's first
    ``TIE_CHARACTERS`` characters, then of its digest; equal rows are turns of their own.  A null role or text is empty.
    Rows of a null conv_id belong to no conversation and are left out.

    Rows are ordered by ranges, so a conversation of any length is spread over tasks, and numbered inside a range first.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", empty("role").alias("role"), F.substring(empty("text"), 1, TIE_CHARACTERS).alias("head"),
        F.md5(F.concat(F.length(empty("role")).cast("string"), F.lit(":"), empty("role"), empty("text")).cast("binary")).alias("digest"),
        F.octet_length(empty("text")).cast("long").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(
        turns.repartitionByRange(n, "conv_id", *order).withColumn("range", F.spark_partition_id()), "trie-turns"
    )
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("conv_id", "range").count().select(
        "conv_id", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead")
    )
    return ranges.select("conv_id", "range", "digest", "n_bytes", F.row_number().over(inside).alias("inside")).join(
        sizes, ["conv_id", "range"]
    ).select("conv_id", (F.col("ahead") + F.col("inside")).alias("place"), "digest", "n_bytes")


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, key sums ``s1`` to ``s4``, those of the prefix before, n_bytes.

    ``turns`` is as ``numbered`` gives it; ``conversations`` (conv_id, distinct) also has those without a turn, whose only
    prefix is the empty one of depth 0, which all have.
    """
    low = F.lit((1 << 32) - 1)
    halves = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), F.col("place"), F.col("digest"))
        halves += [F.shiftrightunsigned(h, 32), h.bitwiseAND(low)]
    parts = turns.select(
        "conv_id", "place", "n_bytes", F.floor((F.col("place") - 1) / CHUNK_TURNS).alias("chunk"),
        *[h.alias(p) for h, p in zip(halves, _PARTS)],
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = parts.groupBy("conv_id", "chunk").agg(*[F.sum(p).alias(p) for p in _PARTS]).select(
        "conv_id", "chunk", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"ahead_{p}") for p in _PARTS]
    )
    summed = parts.select("*", *[F.sum(p).over(inside).alias(s) for p, s in zip(_PARTS, _SUMS)]).join(chunks, ["conv_id", "chunk"])
    sums = [(F.col(s) + F.col(f"ahead_{p}")) for p, s in zip(_PARTS, _SUMS)]
    deep = summed.select(
        "conv_id", F.col("place").cast("long").alias("depth"), *[v.alias(s) for v, s in zip(sums, _SUMS)],
        *[(v - F.col(p)).alias(f"up_{s}") for v, p, s in zip(sums, _PARTS, _SUMS)], "n_bytes",
    )
    zero = F.lit(0).cast("long")
    top = conversations.select(
        "conv_id", zero.alias("depth"), *[zero.alias(s) for s in _SUMS],
        *[F.lit(None).cast("long").alias(f"up_{s}") for s in _SUMS], zero.alias("n_bytes"),
    )
    return deep.unionByName(top)


# ------------------------------------------------------------------------------------------ the trie


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (as ``numbered``) of ``conversations`` (conv_id, distinct).

    ``conv_id`` (smallest member; with ``depth`` it names the node), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (members: conversations that start with the node's turns), ``n_children``, ``n_leaves`` (nodes without
    children in the subtree, which includes its top), ``saved_tokens`` (over the subtree, members but one times bytes of the
    last text), ``ends_sha256`` (SHA-256 in hex of the decimal ids, ascending and joined by commas, of the members that have
    no further turn).  Without conversations there is no node, and the result is empty.
    """
    every = materialise(prefixes(turns, conversations), "trie-prefixes")
    key = ["depth", *_SUMS]
    # A number for each node, written once.
    trie = materialise(every.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        *[F.min(f"up_{s}").alias(f"up_{s}") for s in _SUMS],
    ).withColumn("node", F.monotonically_increasing_id()), "trie-nodes")
    above = trie.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"),
        *[F.col(s).alias(f"up_{s}") for s in _SUMS],
    )
    placed = trie.join(above, ["depth", *[f"up_{s}" for s in _SUMS]], "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes"
    )
    children = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = materialise(
        placed.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-tree"
    )
    tree = placed.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    last = every.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last")).select("conv_id", "last.*")
    ends = id_digests(last.join(trie.select("node", *key), key).select("node", "conv_id"))
    return placed.join(totals, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_ENDS_NONE)).alias("ends_sha256"),
    )


def id_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``members`` (node, conv_id): over decimal ids in ascending order, joined by commas.

    Ranges of members become pieces of text; a node's digest takes its pieces in order, so any number of ids passes through
    as a few pieces, none of them held together.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = members.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(batches):
        held, node, size = [], None, 0
        out: list[tuple] = []
        for b in batches:
            for at, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (at != node or len(held) >= IDS_AT_ONCE):
                    out.append((node, held[0], ",".join(map(str, held))))
                    size += len(held)
                    held = []
                    if size > IDS_AT_ONCE:
                        yield _piece_batch(out)
                        out, size = [], 0
                node = at
                held.append(conv)
        if held:
            out.append((node, held[0], ",".join(map(str, held))))
        if out:
            yield _piece_batch(out)

    def digests(batches):
        node, digest, done = None, None, []
        for b in batches:
            for at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if done:
                yield _digest_batch(done)
                done = []
        if node is not None:
            yield _digest_batch([(node, digest.hexdigest())])

    texts = ranges.mapInArrow(pieces, "node long, first long, piece string")
    in_order = texts.repartition("node").sortWithinPartitions("node", "first").select("node", "piece")
    return in_order.mapInArrow(digests, "node long, ends_sha256 string")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    node, first, piece = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(piece)], names=["node", "first", "piece"]
    )


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    node, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(digest)], names=["node", "ends_sha256"])


# ------------------------------------------------------------------------------------------ contraction


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, *values): each value added up over the node's subtree, for ``tree`` (node, parent or null, *values).

    A forest works as well.  While nodes are alive, ``n`` is the number of their living children, ``v`` holds their own value
    and that of the children already taken away, and ``e`` what was taken out between them and their present parent.
    """
    numbers = range(len(values))
    v = [f"v{i}" for i in numbers]
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    alive = materialise(tree.join(kids, "node", "left").select(
        "node", "parent", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)],
        *[F.lit(0).cast("long").alias(f"e{i}") for i in numbers],
    ), "trie-alive")
    records = []
    while alive.where("parent IS NOT NULL").limit(1).count():
        raked = alive.where(_LEAF).select("node", *v)
        alive = materialise(_round(alive, numbers, len(records)), "trie-alive")
        compressed = alive.where("gone IS NOT NULL").select(
            F.col("gone").alias("node"), F.col("node").alias("child"), *[f"w{i}" for i in numbers]
        )
        records.append((raked, compressed))
        alive = alive.drop("gone", *[f"w{i}" for i in numbers])
    known = alive.select("node", *v)
    for raked, compressed in reversed(records):
        again = compressed.join(known.withColumnRenamed("node", "child"), "child").select(
            "node", *[(F.col(f"w{i}") + F.col(f"v{i}")).alias(f"v{i}") for i in numbers]
        )
        # Written whole: what is known before a round is what is alive after it, a share that falls from round to round, and
        # no plan has more than one round in it.
        known = materialise(known.unionByName(raked).unionByName(again), "trie-totals")
    return known.select("node", *[F.col(f"v{i}").alias(c) for i, c in enumerate(values)])


_LEAF = "n = 0 AND parent IS NOT NULL"


def _round(alive: DataFrame, numbers: range, turn: int) -> DataFrame:
    """What is alive after a rake and a compress.

    A row also names the node that was taken out above it (``gone``), whose total is its own plus ``w``.  What several
    parts of a round read is written, so that no plan holds it, and the joins below it, several times.
    """
    v, e, w = ([f"{c}{i}" for i in numbers] for c in "vew")
    leaf = F.expr(_LEAF)
    sent = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        *[F.sum(F.when(leaf, F.col(a) + F.col(b))).alias(f"g{i}") for i, a, b in zip(numbers, v, e)],
        F.count(F.when(~leaf, 1)).alias("left"), F.min(F.when(~leaf, F.col("node"))).alias("only"),
    )
    inner = materialise(alive.where(~leaf).join(sent, "node", "left").select(
        "node", "parent", F.coalesce("left", F.lit(0).cast("long")).alias("n"), "only",
        *[(F.col(a) + F.coalesce(f"g{i}", F.lit(0))).alias(a) for i, a in zip(numbers, v)], *e,
        F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("by")).alias("own"),
    ), "trie-inner")
    # A chain's node is taken out if its draw is below that of its parent and of its child, where these are of the chain.
    single = (F.col("n") == 1) & F.col("parent").isNotNull()
    chain = inner.where(single)
    none = F.lit(None).cast("struct<draw:bigint,by:bigint>")
    told = chain.select(F.col("only").alias("node"), F.col("own").alias("above"), none.alias("below")).unionByName(
        chain.select(F.col("parent").alias("node"), none.alias("above"), F.col("own").alias("below"))
    ).groupBy("node").agg(F.min("above").alias("above"), F.min("below").alias("below"))
    lowest = [F.col(c).isNull() | (F.col("own") < F.col(c)) for c in ("above", "below")]
    decided = materialise(inner.join(told, "node", "left").select(
        *[c for c in inner.columns if c != "own"], (single & lowest[0] & lowest[1]).alias("out")
    ), "trie-decided")
    gone = decided.where("out").select(
        F.col("only").alias("node"), F.col("node").alias("gone"), F.col("parent").alias("up"),
        *[F.col(a).alias(f"out_{a}") for a in [*v, *e]],
    )
    zero = F.lit(0)
    return decided.where("NOT out").join(gone, "node", "left").select(
        "node", F.coalesce("up", "parent").alias("parent"), "n", *v,
        *[(F.col(b) + F.coalesce(f"out_{a}", zero) + F.coalesce(f"out_{b}", zero)).alias(b) for a, b in zip(v, e)],
        "gone", *[(F.col(f"out_{a}") + F.col(b)).alias(c) for a, b, c in zip(v, e, w)],
    )
