"""Vector arithmetic on ``array<double>`` columns with higher-order functions.

Every helper binds the per-row scalars (maximum, denominator) once, outside
the inner lambda: inside it they would be recomputed for each element pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c



def total(c: Column | str) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, v: acc + v)


def mean(c: Column | str) -> Column:
    return total(c) / F.size(_col(c))



def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body(value)`` — a one-element transform."""
    return F.transform(F.array(value), body)[0]


def softmax(c: Column | str) -> Column:
    """Numerically safe softmax of one array."""
    def normalise(exps: Column) -> Column:
        return let(total(exps), lambda s: F.transform(exps, lambda e: e / s))

    shifted = let(F.array_max(_col(c)), lambda top: F.transform(_col(c), lambda v: F.exp(v - top)))
    return let(shifted, normalise)


def max_pool(c: Column | str, width: int = 2) -> Column:
    """Maximum of each run of ``width`` neighbours; an incomplete tail is left out."""
    x = _col(c)
    runs = F.floor(F.size(x) / F.lit(width)).cast("int")
    pooled = F.transform(
        F.sequence(F.lit(0), runs - 1),
        lambda i: F.array_max(F.slice(x, i * width + 1, width)),
    )
    return F.when(runs > 0, pooled).otherwise(F.array().cast("array<double>"))


def standardise(c: Column | str, eps: float = 1e-12) -> Column:
    """Layer normalisation with unit weight and zero bias."""
    x = _col(c)
    return let(
        mean(x),
        lambda m: let(
            F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))) + F.lit(eps)),
            lambda s: F.transform(x, lambda v: (v - m) / s),
        ),
    )
