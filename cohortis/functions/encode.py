"""Encoders as column expressions (and the few that need an aggregate, as DataFrame functions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES_NO = {"Y": 1, "N": 0}
SEX = {"F": 1, "M": 0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_map(col: Column | str, mapping: Mapping[str, int], strict: bool = True) -> Column:
    """Map codes to ints. Strict: an unmapped or null value fails the job; else it becomes null."""
    c = _col(col)
    expr = None
    for code, value in mapping.items():
        test = c == F.lit(code)
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    if strict:
        text = F.concat(F.lit("unmapped code: "), F.coalesce(c.cast("string"), F.lit("NULL")))
        expr = expr.otherwise(F.raise_error(text).cast("int"))
    return expr.cast("int")


def recode(col: Column | str, mapping: Mapping) -> Column:
    """Replace listed values; every other value passes through."""
    c = _col(col)
    expr = None
    for old, new in mapping.items():
        expr = F.when(c == F.lit(old), F.lit(new)) if expr is None else expr.when(c == F.lit(old), F.lit(new))
    return expr.otherwise(c)


def one_hot(
    df: DataFrame,
    col: str,
    categories: Sequence[str] | None = None,
    drop_first: bool = False,
) -> DataFrame:
    """Append ``<col>_<value>`` 0/1 columns (sorted values, null gives zeros) and drop the source.

    Pass ``categories`` to keep the plan lazy and the schema fixed; without
    them one distinct job finds the values present.
    """
    if categories is None:
        found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(10_001).collect()
        if len(found) > 10_000:
            raise ValueError(f"{col} has more than 10000 values: too many for one-hot columns")
        categories = [row[0] for row in found]
    names = sorted(categories)[1 if drop_first else 0:]
    flags = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in names]
    kept = [F.col(f"`{c}`") for c in df.columns if c != col]
    return df.select(*kept, *flags)


def age_bucket_names(col: str, cuts: Sequence[int]) -> list[str]:
    return [f"{col}_{c}" for c in cuts] + [f"{col}_>{cuts[-1]}"]


def age_buckets(df: DataFrame, col: str = "age_init", cuts: Sequence[int] = (29, 46)) -> DataFrame:
    """Replace an age column, in place, by one 0/1 column per bucket (<= cut, ..., > last cut)."""
    age = F.col(col)
    flags = []
    lower = None
    for cut, name in zip(cuts, age_bucket_names(col, cuts)):
        test = age <= cut if lower is None else (age > lower) & (age <= cut)
        flags.append(F.when(test, 1).otherwise(0).alias(name))
        lower = cut
    # an unknown age compares false with every cut, so it falls in the last bucket
    flags.append(F.when(age <= cuts[-1], 0).otherwise(1).alias(age_bucket_names(col, cuts)[-1]))
    out = []
    for c in df.columns:
        out.extend(flags if c == col else [F.col(f"`{c}`")])
    return df.select(*out)


def treatment_indicators(df: DataFrame, col: str, drugs: Sequence[str]) -> DataFrame:
    """One 0.0/1.0 column per drug; a null drug gives zeros everywhere."""
    return df.withColumns({d: F.when(F.col(col) == d, 1.0).otherwise(0.0) for d in drugs})


def min_max(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column gives null. The bounds are a scalar subquery."""
    bounds = df.agg(
        F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("b")
    ).scalar()
    span = F.nullif(bounds["hi"] - bounds["lo"], F.lit(0.0))
    return df.withColumn(out or col, (F.col(col) - bounds["lo"]) / span)


def z_score(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std per column; all statistics come from one scalar subquery."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    stats = df.agg(F.struct(*parts).alias("s")).scalar()
    return df.withColumns({
        c: (F.col(c) - stats[f"m{i}"]) / F.nullif(stats[f"s{i}"], F.lit(0.0)) for i, c in enumerate(cols)
    })


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970-01-01 with fraction, for a timestamp taken as UTC."""
    return F.unix_micros(F.to_utc_timestamp(_col(ts).cast("timestamp"), "UTC")).cast("double") / 1e6


def relu(c: Column | str) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))
