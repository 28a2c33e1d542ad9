"""Mixing sources to target weights by pivotal dependent rounding.

A source with target ``t`` and size ``s`` wants every document ``t / s`` times: the whole part is fixed, the fraction is a
copy probability.  Fractions are rounded in pairs: mass, counted in words, moves between two documents until one is a
whole number, in a random direction that keeps both expectations.  What a source takes in words therefore stays the same
at every step, and ends off its target by less than one document.

The pairs form a reduction tree.  Documents of a source fall into blocks of about ``BLOCK``; a block is folded in one
array and leaves at most one document with a fraction, and these meet in the blocks of the next level, until every source
has one left.  No block grows with the input, whatever the size of the source.  Only DataFrame expressions are used.

The last document with a fraction is rounded to the nearer whole number.  As that may be a large one, the root block of a
source is folded with ``TRIES`` sets of draws, and the set that ends nearest to the target holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import at_places, located, words_of
from assaylake.session import materialise

BLOCK = 128
TRIES = 16
#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source.
MOST = 3.0
#: A fraction this near to a whole number is one.
NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets over
    ``most`` times its size, and what is cut goes to the others by weight.  That is one common level: sources whose
    ``most * size / weight`` lies below it are full, the others get level * weight.  Filling the sources in that order
    raises the level as long as the next source lies below it, so the level is the highest on the way.  One row per source
    passes through one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    )).withColumn("fill", cap / F.col("weight"))
    up_to = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    levels = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum(cap).over(up_to), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)),
    }).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max("level").over(everything)
    return levels.withColumn("level", level).select(
        "source", "source_size", F.least(cap, F.col("weight") * F.col("level")).alias("target")
    )


def _draw(seed: int, level: int, *parts: Column) -> Column:
    """Between 0 and 1, a function of seed, level and row only."""
    h = F.xxhash64(F.lit(seed), F.lit(level), *parts)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def _fold(items: Column) -> Column:
    """Fold an array of (at, words, p, draw) to one open item and the decided ones.

    Open item i and the next item j share mass ``p_i w_i + p_j w_j``.  Either p_i rises by u and p_j falls by u w_i / w_j,
    or p_i falls by d and p_j rises by d w_i / w_j; u and d are the largest steps inside [0, 1], and the first happens
    with chance d / (u + d).
    """
    item = "struct<at:bigint,key:string,words:bigint,p:double,draw:double>"
    empty = f"named_struct('open', cast(null AS {item}), 'done', cast(array() AS array<struct<at:bigint,taken:int>>))"

    def step(acc: Column, x: Column) -> Column:
        i = acc["open"]
        ratio = i["words"] / x["words"]
        up = F.least(1 - i["p"], x["p"] / ratio)
        down = F.least(i["p"], (1 - x["p"]) / ratio)
        rises = x["draw"] * (up + down) < down
        move = F.when(rises, up).otherwise(-down)
        pi, pj = i["p"] + move, x["p"] - move * ratio
        # One of the two is whole by construction; the nearer one counts as such.
        off = lambda p: F.least(F.abs(p), F.abs(1 - p))
        first_open = off(pi) > off(pj)
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        keep = F.struct(
            F.when(first_open, i["at"]).otherwise(x["at"]).alias("at"),
            F.when(first_open, i["key"]).otherwise(x["key"]).alias("key"),
            F.when(first_open, i["words"]).otherwise(x["words"]).alias("words"),
            clip(F.when(first_open, pi).otherwise(pj)).alias("p"),
            F.when(first_open, i["draw"]).otherwise(x["draw"]).alias("draw"),
        )
        done = F.struct(
            F.when(first_open, x["at"]).otherwise(i["at"]).alias("at"),
            F.round(F.when(first_open, pj).otherwise(pi)).cast("int").alias("taken"),
        )
        return F.when(
            i.isNull(), F.struct(x.cast(item).alias("open"), acc["done"].alias("done"))
        ).otherwise(F.struct(keep.alias("open"), F.concat(acc["done"], F.array(done)).alias("done")))

    return F.aggregate(items, F.expr(empty), step)


def _best_fold(items: str, seed: int, level: int, tries: int) -> Column:
    def fold(t: Column) -> Column:
        return _fold(F.transform(items, lambda x: F.struct(
            x["at"].alias("at"), x["key"].alias("key"), x["words"].alias("words"), x["p"].alias("p"),
            _draw(seed, level, t, x["key"]).alias("draw"),
        )))

    if tries == 1:
        return fold(F.lit(0))
    scored = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.struct(fold(t).alias("f")))
    scored = F.transform(scored, lambda c: F.struct(
        (F.least(c["f"]["open"]["p"], 1 - c["f"]["open"]["p"]) * c["f"]["open"]["words"]).alias("off"), c["f"].alias("f")
    ))
    return F.array_min(scored)["f"]


def _own_keys(sized: DataFrame) -> DataFrame:
    """``sized`` where rows of a repeated ``key`` have the row number ``at`` in it, so that they spread over blocks."""
    again = sized.groupBy(F.col("key").alias("again")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("again")
    own = F.when(F.col("again").isNotNull(), F.concat_ws(" row ", "key", F.col("at").cast("string"))).otherwise(F.col("key"))
    joined = sized.join(again, F.col("key") == F.col("again"), "left")
    return joined.select(*[own.alias("key") if c == "key" else F.col(c) for c in sized.columns])


def copies(docs: DataFrame, seed: int = 0, column: str = "copies", carry: list[str] | None = None,
           weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) with a struct ``column``: size, source_size, target, copies.

    ``size`` is the number of words, 0 for a null or blank text; such documents weigh nothing and are taken the whole
    part of their source's ratio.  A null source is a source of its own, the last.  Repeated rows are rounded each.  A
    source without words has target 0.  An empty table gives no rows.  Draws depend on seed and row, so a rerun over the
    same files agrees.  With ``carry`` only those columns of ``docs`` are kept; without it the rows' places are written and
    joined with ``docs`` in the end, so that texts move once and no copy of them stays on disk.  If ``docs`` has a column
    of the name ``column``, give another.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    rows = located(docs, "mix-input") if carry is None else docs
    kept = ["_llm_file", "_llm_row"] if carry is None else carry
    # Draws hang on doc_id, so they are the same however the files are split; rows without one, or with one that other
    # rows have too, go by row number.
    number = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    sized = rows.select(
        F.struct(*kept).alias("doc"), F.col("source").alias("from"), F.size(words_of(F.col("text"))).cast("long").alias("words"),
        F.coalesce(F.col("doc_id").cast("string"), number).alias("key"), F.monotonically_increasing_id().alias("at"),
    )
    # Written once: the row numbers then stay when a lost task runs again.
    sized = _own_keys(materialise(sized, "mix-sizes"))
    per_source = sized.groupBy(F.col("from").alias("source")).agg(
        F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    want = materialise(
        targets(per_source.select("source", "source_size"), weights, most).join(
            per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))
        ).drop("s"), "mix-targets",
    )
    largest = want.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = sized.join(want, F.col("from").eqNullSafe(F.col("source"))).withColumn(
        "whole", F.floor(ratio + NEAR).cast("int")
    ).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    items = planned.where((F.col("words") > 0) & (F.col("p") > NEAR)).select("source", "n", "at", "key", "words", "p")
    decided = []
    level, left = 0, largest
    while True:
        is_root = left <= block
        blocks = F.ceil(F.col("n") / F.lit(float(block ** (level + 1)))).cast("long")
        grouped = items.select(
            "source", "n",
            F.pmod(F.xxhash64(F.lit(seed), F.lit(-1 - level), "key"), blocks).alias("block"),
            F.struct("words", "key", "at", "p").alias("item"),
        ).groupBy("source", "n", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = grouped.select("source", "n", _best_fold("items", seed, level, TRIES if is_root else 1).alias("f"))
        if is_root:
            last = F.struct(F.col("f.open.at").alias("at"), F.round("f.open.p").cast("int").alias("taken"))
            decided.append(folded.select(F.inline(F.concat("f.done", F.array(last)))))
            break
        folded = materialise(folded, f"mix-level{level}")
        decided.append(folded.select(F.inline("f.done")))
        items = folded.select("source", "n", *[F.col(f"f.open.{c}").alias(c) for c in ("at", "key", "words", "p")])
        level, left = level + 1, math.ceil(left / block)
    last = decided[0]
    for part in decided[1:]:
        last = last.unionByName(part)
    chosen = last.select(F.col("at").alias("chosen"), "taken")
    found = planned.join(chosen, F.col("at") == F.col("chosen"), "left").select(
        "doc.*", F.struct(
            F.col("words").alias("size"), "source_size", "target",
            (F.col("whole") + F.coalesce("taken", F.lit(0))).alias("copies"),
        ).alias(column),
    )
    return at_places(rows, found, docs.columns, column) if carry is None else found
