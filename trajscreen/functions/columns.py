"""Column expressions shared by the operators: geometry, arrays, hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm3(x: Column, y: Column, z: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(x * x + y * y + z * z)


def median(value: Column) -> Column:
    """Exact median, interpolated; also over windows, where F.median is not allowed."""
    return F.percentile(value, F.lit(0.5))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays as doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def unit_vector(a: Column) -> Column:
    """The array divided by its length; a zero array stays."""
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 2**32) from the md5 of the parts; the same in any engine that has md5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array; probabilities are at least 1e-12."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp((v - top) / F.lit(temperature)))
    total = F.aggregate(powers, F.lit(0.0), lambda t, x: t + x)
    return F.transform(powers, lambda p: F.greatest(p / total, F.lit(1e-12)))


def log1p_abs(value: Column) -> Column:
    return F.log1p(F.abs(value))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def terms(text: Column, stems: Sequence[str]) -> Column:
    """Which of the stems occur in the lower-cased text; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(s) for s in stems]), lambda s: F.contains(low, s))
