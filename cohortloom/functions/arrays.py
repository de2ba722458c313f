"""Array geometry: list literals, axes, field of view, volume, label masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(c: Column, element: str = "double") -> Column:
    """A list literal such as ``[256, 256, 176]`` as an array; malformed text gives NULL."""
    return F.from_json(c, f"array<{element}>")


def n_dims(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def axis(c: Column, i: int) -> Column:
    """Element ``i`` (0-based), NULL when the array is shorter."""
    return F.get(c, F.lit(i))


def array_product(c: Column) -> Column:
    """Product of all elements; NULL when any element is NULL."""
    return F.aggregate(c, F.lit(1.0), lambda acc, x: acc * x)


def field_of_view(shape: Column, pixdim: Column) -> Column:
    """Extent per axis over the first three axes, stopping at the shorter array."""
    n = F.least(F.lit(3), F.size(shape), F.size(pixdim))
    return F.when(
        shape.isNotNull() & pixdim.isNotNull(),
        F.zip_with(
            F.slice(shape, F.lit(1), n),
            F.slice(pixdim, F.lit(1), n),
            lambda a, b: a.cast("double") * b,
        ),
    )


def label_mask(c: Column) -> Column:
    """0/1 mask of an array of segmentation labels."""
    return F.transform(c, lambda v: (v > 0).cast("tinyint"))


def dot(weights: Column, values: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
