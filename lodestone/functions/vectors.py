"""Vector checks, normalisation and cosine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_vector(vector: Column | str, dimensions: int) -> Column:
    """L2-normalised float vector; null where the input is not a usable vector.

    Values are divided by the largest magnitude first, so 1e30 and 1e-30 neither overflow
    nor vanish. Wrong length, non-finite values and zero vectors give null.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    doubles = v.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scale = F.array_max(F.transform(doubles, lambda x: F.abs(x)))
    scaled = F.transform(doubles, lambda x: x / scale)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    usable = (F.size(v) == dimensions) & finite & (scale > 0)
    return F.when(usable, F.transform(scaled, lambda x: (x / norm).cast("float")))


def require_unit_vector(vector: Column | str, dimensions: int) -> Column:
    """As :func:`unit_vector` but an unusable vector fails the job."""
    unit = unit_vector(vector, dimensions)
    return F.coalesce(
        unit, F.raise_error(F.lit("Embedding has invalid dimensions, values or norm")).cast("array<float>")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two aligned vectors, accumulated in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    return dot / (norm(a) * norm(b))
