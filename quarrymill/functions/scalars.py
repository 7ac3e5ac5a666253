"""Scalar expressions on scores, rates and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude_bucket(value: Column, edges: Sequence[int] = (0, 1, 100, 300, 900), missing: str = "unlabelled") -> Column:
    """The band of |value|, truncated to a whole number: "0", "1-99", ..., "900+"; ``missing`` for null."""
    size = F.abs(value).cast("long")
    out = F.when(value.isNull(), missing)
    for low, high in zip(edges, edges[1:]):
        out = out.when(size < high, f"{low}" if high - low == 1 else f"{low}-{high - 1}")
    return out.otherwise(f"{edges[-1]}+")


def logistic_score(value: Column, scale: float = 256.0, clip: float = 60.0) -> Column:
    """Expected score on the natural scale: 1 / (1 + e^(-value / scale)), exponents clipped; null for null."""
    return F.when(value.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), value / scale)))))


def rating_score(value: Column, scale: float = 400.0) -> Column:
    """Expected score on the base-10 scale: 1 / (1 + 10^(-value / scale))."""
    return 1 / (1 + F.pow(F.lit(10.0), -value / scale))


def unit_bin(value: Column, bins: int = 20) -> Column:
    """The index of one of equal bins over [0, 1], clamped to the first and last."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins).cast("int")))


def mate_sentinel(moves: Column, base: int = 1_000_000) -> Column:
    """A score for "mate in n": base less the distance, with the sign of n; 0 counts as being mated."""
    return F.when(moves > 0, base - F.abs(moves)).otherwise(-(base - F.abs(moves)))


def point_of_view(value: Column, side: Column) -> Column:
    """A score for white from one for the side to move."""
    return F.when(side == "b", -value).otherwise(value)


def blended_target(score: Column, result: Column, weight: float) -> Column:
    """score and game result mixed; the score alone where there is no result."""
    return F.when(result.isNull(), score).otherwise((1 - weight) * score + weight * result)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading entries two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def whole_share(fraction: Column | float, n: Column) -> Column:
    """round(fraction * n), halves to even."""
    return F.bround(F.lit(fraction) * n if not isinstance(fraction, Column) else fraction * n, 0).cast("long")


def slug(text: Column, width: int = 24) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), 1, width)


def parameter_label(n: Column) -> Column:
    """12000 as 12K, 1500000 as 1.5M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M"))).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def date_in(text: Column) -> Column:
    """The first eight digits in a row as a date; null if there are none or they are no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def dig(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path ends early."""
    return F.get_json_object(json, "$." + path)
