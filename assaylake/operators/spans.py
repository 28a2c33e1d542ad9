"""Statistics of the values whose span of time holds the query time, without a row per pair.

A value counts for a query at ``q`` if ``from <= q <= to``; a trailing RANGE frame of length w is the span ``[t, t + w]``, and a
value that is published late has a span that starts later.  Time is cut into blocks as long as the longest span:

* a span over a border is open to the right in its first block and open to the left in the second;
* a span inside a block is cut once, at the midpoint of the one halving of the block that separates its ends, and is open
  to the right in the left half and open to the left in the right half.

So every value gives at most two rows, and a query one row per halving that occurs.  In each *node* (block or half) the values
that count are all that entered up to ``q`` and all that leave from ``q`` on: one running aggregate forwards and one
backwards.  Nothing is ever subtracted, so sums and deviations lose no digits, and least and largest values come the same way.

A node of more than ``hot_rows`` rows is cut in time; the totals of its other parts enter as one row per part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaylake.operators.chunks import DEFAULT, Chunking, assign_chunks

_ENTER, _ASK, _LEAVE = 0, 1, 2
_NODE = ("_span", "_block", "_level", "_half")
#: What a statistic is made of; deviations are kept as squares about the mean, so that parts can be merged.
_NEEDS = {"n": "n", "mean": "n s", "std": "n s m2", "min": "n lo", "max": "n hi"}


def _fields(stats: Sequence[str]) -> list[str]:
    wanted = {f for s in stats for f in _NEEDS[s].split()}
    return [f for f in ("n", "s", "m2", "lo", "hi") if f in wanted]


def _moments(value: Column, fields: Sequence[str], prefix: str, window=None) -> list[Column]:
    """Count, sum, squared deviations, least and largest value, running where a window is given."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    made = {
        "n": lambda: over(F.count(value)), "s": lambda: over(F.sum(value)),
        "m2": lambda: over(F.var_pop(value)) * over(F.count(value)),
        "lo": lambda: over(F.min(value)), "hi": lambda: over(F.max(value)),
    }
    return [made[f]().alias(prefix + f) for f in fields]


def _both(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two parts together; a part without values has a count of 0."""
    n = a["n"] + b["n"]
    out = {"n": n}
    if "s" in a:
        out["s"] = F.when(a["n"] == 0, b["s"]).when(b["n"] == 0, a["s"]).otherwise(a["s"] + b["s"])
    if "m2" in a:
        apart = b["s"] / b["n"] - a["s"] / a["n"]
        out["m2"] = F.when(a["n"] == 0, b["m2"]).when(b["n"] == 0, a["m2"]).otherwise(
            a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n
        )
    if "lo" in a:
        out["lo"] = F.least(a["lo"], b["lo"])
    if "hi" in a:
        out["hi"] = F.greatest(a["hi"], b["hi"])
    return out


def _struct(moments: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(f) for f, c in moments.items()])


def _of(struct: Column, fields: Sequence[str]) -> dict[str, Column]:
    return {f: struct[f] for f in fields}


def _merged(parts: Column, fields: Sequence[str]) -> Column:
    """One struct of moments out of a list of them."""
    kind = "struct<" + ",".join(f"{f}:{'bigint' if f == 'n' else 'double'}" for f in fields) + ">"
    none = F.struct(*[F.lit(0 if f == "n" else None).alias(f) for f in fields]).cast(kind)
    return F.aggregate(parts, none, lambda x, y: _struct(_both(_of(x, fields), _of(y, fields))).cast(kind))


def _crowded(asks: DataFrame, spans: DataFrame, keys: Sequence[str], width: Column, most: int) -> bool:
    """Whether any block could have more rows than ``most``: its values, each in two nodes at most, and its queries."""
    block = lambda c: F.floor(F.col(c) / width).cast("long").alias("_block")
    rows = spans.select(*keys, block("_from")).unionByName(asks.select(*keys, block("_q")))
    return not rows.groupBy(*keys, "_block").count().filter(F.col("count") * 2 > most).isEmpty()


def _half(offset: Column, level: Column) -> Column:
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(
        F.floor(offset / F.pow(F.lit(2.0), level - 1)).cast("long")
    )


def _nodes_of_spans(spans: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    first, last = F.floor(F.col("_from") / width).cast("long"), F.floor(F.col("_to") / width).cast("long")
    at = spans.withColumns({"_b0": first, "_b1": last}).withColumns(
        {"_o0": F.col("_from") - F.col("_b0") * width, "_o1": F.col("_to") - F.col("_b1") * width}
    )
    inside = F.col("_b0") == F.col("_b1")
    # The highest bit in which the ends differ is the halving that separates them.
    bits = F.length(F.bin(F.col("_o0").bitwiseXOR(F.col("_o1")))).cast("long")
    at = at.withColumn("_level", F.when(inside, bits).otherwise(F.lit(0).cast("long")))

    def piece(kind: int, block: str, offset: str, when: str) -> Column:
        return F.struct(
            F.lit(kind).alias("_kind"), F.col(block).alias("_block"), F.col("_level"),
            _half(F.col(offset), F.col("_level")).alias("_half"), F.col(when).alias("_at"),
        )

    pieces = F.array(piece(_ENTER, "_b0", "_o0", "_from"), piece(_LEAVE, "_b1", "_o1", "_to"))
    # A span of a single instant enters only; it would be counted twice.
    pieces = F.when(F.col("_from") == F.col("_to"), F.slice(pieces, 1, 1)).otherwise(pieces)
    return at.select(*keys, "_span", F.explode(pieces).alias("_p"), "value").select(*keys, "_span", "_p.*", "value")


def span_stats(
    asks: DataFrame,
    spans: DataFrame,
    *,
    keys: Sequence[str],
    ids: Sequence[str],
    lengths: Sequence[int],
    stats: Sequence[str],
    inner: bool = True,
    chunking: Chunking = DEFAULT,
) -> DataFrame:
    """For each ask (``keys``, ``ids``, ``_q``) ``<stat>_<length>m`` of the values whose span holds ``_q``.

    ``spans`` has ``keys``, ``_span`` (one of ``lengths``, in minutes; no span is longer), ``_from``, ``_to`` and ``value``; times are
    microseconds.  Missing values and spans that end before they start must have been left out.  Rows equal in keys,
    ids and time give one row.  ``inner=False`` promises that every span is as long as its length says.  ``stats`` are
    of mean, population std, min, max (NULL without values) and n.
    """
    fields = _fields(stats)
    width = F.col("_span").cast("long") * F.lit(60_000_000)
    pieces = _nodes_of_spans(spans, keys, width)
    levels = [0]
    if inner:
        # At most as many numbers as a block's length has bits.
        levels = sorted({0} | {r["_level"] for r in pieces.select("_level").distinct().collect()})
    block = F.floor(F.col("_q") / width).cast("long")
    level = F.col("_level")
    wanted = (
        asks.select(*keys, *ids, "_q", F.explode(F.array(*[F.lit(m) for m in lengths])).alias("_span"))
        .withColumn("_level", F.explode(F.array(*[F.lit(x).cast("long") for x in levels])))
        .withColumn("_block", block)
        .withColumn("_half", _half(F.col("_q") - F.col("_block") * width, level))
        .withColumns({"_kind": F.lit(_ASK), "_at": F.col("_q")})
    )
    rows = pieces.unionByName(wanted, allowMissingColumns=True)
    node = [*keys, *_NODE]
    enters = F.when(F.col("_kind") == _ENTER, F.col("value"))
    leaves = F.when(F.col("_kind") == _LEAVE, F.col("value"))
    longest = F.lit(max(lengths) * 60_000_000)
    single = spans.filter(F.col("_span") == max(lengths))
    cut = chunking.hot_rows is not None and _crowded(asks, single, keys, longest, chunking.hot_rows)
    if cut:
        timed = rows.withColumn("_time", F.timestamp_micros("_at"))
        rows = assign_chunks(timed, node, "_time", chunking).drop("_time")
        totals = rows.groupBy(*node, "_chunk").agg(
            F.struct(*_moments(enters, fields, "")).alias("_in"), F.struct(*_moments(leaves, fields, "")).alias("_out")
        )
        near = Window.partitionBy(*node).orderBy("_chunk")
        others = totals.select(
            *node, "_chunk", F.lit(-1).alias("_kind"),
            _merged(F.collect_list("_in").over(near.rowsBetween(Window.unboundedPreceding, -1)), fields).alias("_before"),
            _merged(F.collect_list("_out").over(near.rowsBetween(1, Window.unboundedFollowing)), fields).alias("_after"),
        )
        rows = rows.unionByName(others, allowMissingColumns=True)
    part = Window.partitionBy(*node, *(["_chunk"] if cut else []))
    sofar = (Window.unboundedPreceding, Window.currentRow)
    # The row of the other parts comes first; of one instant, values enter before an ask and leave after it.
    ahead = part.orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(*sofar)
    back = part.orderBy(F.col("_at").desc_nulls_last(), F.col("_kind").desc()).rowsBetween(*sofar)
    carried = [F.first(c, ignorenulls=True).over(ahead).alias(f"_c{c}") for c in ("_before", "_after")] if cut else []
    here = rows.select(
        *keys, *ids, "_q", "_span", "_level", "_kind",
        *_moments(enters, fields, "_e_", ahead), *_moments(leaves, fields, "_l_", back), *carried,
    ).filter(F.col("_kind") == _ASK)
    own = _both({f: F.col(f"_e_{f}") for f in fields}, {f: F.col(f"_l_{f}") for f in fields})
    here = here.withColumns({f"_m_{f}": c for f, c in own.items()})
    for c in ("_before", "_after") if cut else ():
        more = _both({f: F.col(f"_m_{f}") for f in fields}, _of(F.col(f"_c{c}"), fields))
        here = here.withColumns({f"_m_{f}": x for f, x in more.items()})
    here = here.select(*keys, *ids, "_q", "_span", "_level", *[F.col(f"_m_{f}").alias(f) for f in fields])
    mine = lambda m, c: F.when(F.col("_span") == m, c)
    if len(levels) == 1:
        # One node for each length; repeated asks have equal moments.
        found = here.groupBy(*keys, *ids, "_q").agg(*[F.max(mine(m, F.col(f))).alias(f"_{f}_{m}") for m in lengths for f in fields])
        of = lambda m: {f: F.col(f"_{f}_{m}") for f in fields}
    else:
        # One list per ask and length, no longer than there are levels.
        found = here.filter("n > 0 OR _level = 0").groupBy(*keys, *ids, "_q").agg(*[
            F.collect_set(mine(m, F.struct("_level", *fields))).alias(f"_p_{m}") for m in lengths
        ]).withColumns({f"_m_{m}": _merged(F.array_sort(f"_p_{m}"), fields) for m in lengths})
        of = lambda m: _of(F.col(f"_m_{m}"), fields)
    return found.select(*keys, *ids, *[_figure(of(m), s).alias(f"{s}_{m}m") for m in lengths for s in stats])


def _figure(moments: dict[str, Column], stat: str) -> Column:
    return {
        "n": lambda: moments["n"],
        "mean": lambda: moments["s"] / F.nullif(moments["n"], F.lit(0)),
        "std": lambda: F.sqrt(moments["m2"] / F.nullif(moments["n"], F.lit(0))),
        "min": lambda: moments["lo"],
        "max": lambda: moments["hi"],
    }[stat]()
