"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of a 95% interval; with these the published cutoffs are met exactly.
Z95, HIDE_WIDTH, GREY_WIDTH = 1.959964, 1.0, 0.5


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null for a zero or null divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson_half_width(k: Column, n: Column, z: float = Z95) -> Column:
    """Half the width of the Wilson interval of k / n; null where n is 0."""
    p, z2 = ratio(k, n), z * z
    m = n.cast("double")
    return ratio(z * F.sqrt(ratio(p * (1 - p), m) + ratio(F.lit(z2), 4 * m * m)), 1 + ratio(F.lit(z2), m))


def relative_width(k: Column, n: Column) -> Column:
    """The half-width as a part of the share itself; infinite for k = 0."""
    return F.when(k == 0, F.lit(float("inf"))).otherwise(ratio(wilson_half_width(k, n), ratio(k, n)))


def point_status(k: Column, n: Column) -> Column:
    """hide, grey or ok, by how wide the interval is against the share."""
    rel = relative_width(k, n)
    return F.when(rel > HIDE_WIDTH, "hide").when(rel > GREY_WIDTH, "grey").when(n > 0, "ok").otherwise("hide")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded on the scaled value, halves to the even neighbour, as NumPy and pandas do."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def pairs_of(n: Column) -> Column:
    """n choose 2."""
    return n.cast("double") * (n.cast("double") - 1) / 2


def year_date(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_window(year: Column, first: int = 2018, size: int = 2) -> Column:
    """The first year of the window that holds a year."""
    return (F.floor((year - first) / size) * size + first).cast("int")


def scaled(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """x carried linearly from [low, high] to [to_low, to_high]."""
    return F.lit(to_low) + (x - low) * ((to_high - to_low) / (high - low))
