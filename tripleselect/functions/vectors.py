"""Vector algebra on ``ARRAY<FLOAT|DOUBLE>`` columns.

All arithmetic runs as built-in higher-order functions (``zip_with``,
``aggregate``, ``transform``) so it stays inside whole-stage codegen.  Sums
are strictly left-to-right in double precision, which makes results
reproducible bit-for-bit by any engine that sums in the same order.

Triple vectors are laid out ``query ‖ positive ‖ negative`` with ``dim``
floats per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Inner product in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def block(col, dim: int, i: int) -> Column:
    """Block ``i`` (0 = query, 1 = positive, 2 = negative) of a triple vector."""
    return F.slice(_c(col), i * dim + 1, dim)


def vector_view(col, dim: int, view: str, sig: int | None = None) -> Column:
    """Block view of a triple vector.

    ``query`` first block; ``pos`` query + positive; ``trunc`` first ``sig``
    floats of each block; anything else returns the full vector.
    """
    c = _c(col)
    if view == "query":
        return F.slice(c, 1, dim)
    if view == "pos":
        return F.slice(c, 1, 2 * dim)
    if view == "trunc":
        if sig is None:
            raise ValueError("view='trunc' needs sig")
        return F.concat(*[F.slice(c, i * dim + 1, sig) for i in range(3)])
    return c


def with_l2_normalized(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """L2-normalise ``col`` row-wise (double array); zero vectors stay zero."""
    # the norm is an element of an array: as a column, a filter on the result would put it into the inner
    # lambda function and compute it again for every element
    unit = F.transform(F.array(norm(col)), lambda n: F.transform(F.col(col), lambda x: F.when(n > 0, x.cast("double") / n)
                                                                                         .otherwise(x.cast("double"))))
    return df.withColumn(out or col, unit[0])


def block_weights(alpha: float, beta: float, clip_gamma: bool = True) -> tuple[float, float, float]:
    """(alpha, beta, gamma) with gamma = 1 - alpha - beta, clipped at 0 unless
    ``clip_gamma`` is False (then a negative gamma flips the negative block)."""
    gamma = 1.0 - alpha - beta
    if clip_gamma:
        gamma = max(gamma, 0.0)
    return float(alpha), float(beta), float(gamma)


def weight_vectors(df: DataFrame, col: str, dim: int, alpha: float = 1.0, beta: float = 1.0,
                   equal: bool = False, clip_gamma: bool = True, out: str | None = None) -> DataFrame:
    """Scale the three blocks by alpha, beta, gamma, then L2-normalise.

    ``equal=True`` skips the weighting and only normalises.
    """
    out = out or col
    if equal:
        return with_l2_normalized(df, col, out)
    a, b, g = block_weights(alpha, beta, clip_gamma)
    w = F.transform(F.col(col), lambda x, i: x.cast("double") * F.when(i < dim, F.lit(a))
                    .when(i < 2 * dim, F.lit(b)).otherwise(F.lit(g)))
    return with_l2_normalized(df.withColumn(out, w), out, out)


def cosine_margin(col, dim: int) -> Column:
    """cos(query, positive) - cos(query, negative) of a triple vector."""
    q, p, n = (block(col, dim, i) for i in range(3))
    return cosine(q, p) - cosine(q, n)


def mean_vector(a, b) -> Column:
    """Element-wise mean of two vectors."""
    return F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2.0)
