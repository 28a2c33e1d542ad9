"""Scalar rules: bands, ages, contributions, probabilities, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaylake.functions.labels import GRADE_LIMITS, literal_map

AGE_EDGES = ((30.0, "<=30m"), (120.0, "30-120m"), (360.0, "2-6h"), (1440.0, "6-24h"))


def age_bucket(minutes: Column) -> Column:
    """Right-closed age buckets; unknown age stays NULL."""
    out = None
    for edge, label in AGE_EDGES:
        out = F.when(minutes <= edge, label) if out is None else out.when(minutes <= edge, label)
    return F.when(minutes.isNotNull(), out.otherwise(">24h"))


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: the first label is below the first edge."""
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return F.when(value.isNotNull(), out.otherwise(labels[-1]))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def severity(value: Column, normal: Column, boundary: Column, direction: Column) -> Column:
    """Zero at the normal edge, one at the model boundary, linear between, either direction."""
    up = (value - normal) / (boundary - normal)
    down = (normal - value) / (normal - boundary)
    return clamp(F.when(direction == "higher", up).otherwise(down), 0.0, 1.0)


def relative_improvement(current: Column, proposed: Column, higher_is_better: bool) -> Column:
    gain = proposed - current if higher_is_better else current - proposed
    return gain / F.greatest(F.abs(current), F.lit(1e-9))


def logit(p: Column) -> Column:
    q = clamp(p, 1e-6, 1.0 - 1e-6)
    return F.log(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def grade_limit(grade: Column, which: str) -> Column:
    at = ("cetane_lower", "density_lower", "density_upper").index(which)
    return F.try_element_at(literal_map({g: float("-inf") if v[at] is None else v[at] for g, v in GRADE_LIMITS.items()}), grade)


def upper_bound(point: Column, raw: Column, shift: Column | float) -> Column:
    return F.greatest(point, raw + shift)


def running_maximum(columns: Mapping[str, Column]) -> list[Column]:
    """Each column becomes the maximum of itself and those before it."""
    seen: list[Column] = []
    out = []
    for name, c in columns.items():
        seen.append(c)
        out.append((F.greatest(*seen) if len(seen) > 1 else c).alias(name))
    return out


def fingerprint(columns: Sequence[str], length: int = 12) -> Column:
    """SHA-256 over canonical JSON of the sorted columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)


def half_up(x: Column, digits: int) -> Column:
    """``F.round`` of doubles, by arithmetic wherever no tie is near; the decimal numbers of ``F.round`` take far longer.

    The product is off by less than 1e-4 there, so its nearest whole number is the one that the decimal digits give, and
    dividing two whole numbers gives the double nearest to the rounded decimal, as ``F.round`` does.
    """
    scaled = x * float(10 ** digits)
    sure = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(sure, F.floor(scaled + 0.5) / float(10 ** digits)).otherwise(F.round(x, digits))


def rounded(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    nearest = lambda c: half_up(F.col(c), digits) if kinds[c] == "double" else F.round(F.col(c), digits)
    return df.select(*[
        (nearest(c) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns
    ])
