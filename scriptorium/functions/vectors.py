"""Vector expressions (R3), built-in higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot_score(a, b) -> Column:
    """Inner product of two equal-length arrays, accumulated in double.

    On unit vectors this is the cosine similarity.
    """
    products = F.zip_with(_col(a), _col(b),
                          lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
