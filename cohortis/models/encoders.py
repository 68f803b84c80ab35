"""Encoders that learn from one cohort and apply to others: ``pyspark.ml`` estimators whose models can be saved.

The functions of ``cohortis.functions.encode`` take categories, bounds and moments from the frame they get. Here they
come from the training cohort alone, stay in the model and go with it into a saved pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A stage over named columns. Every parameter has a default, so a saved stage can be made empty and filled."""

    def __init__(self, inputCols: Sequence[str] | None = None, **values):
        super().__init__()
        if inputCols is not None:
            values["inputCols"] = list(inputCols)
        self._set(**values)


class _OneHotParams(Params):
    dropFirst = Param(Params._dummy(), "dropFirst", "leave the first category out", TypeConverters.toBoolean)
    maxCategories = Param(Params._dummy(), "maxCategories", "most categories of a column", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(dropFirst=False, maxCategories=1000)


class OneHotColumns(_Stage, _OneHotParams, Estimator):
    """Learns the values (null left out) that each column has in the training frame, in order."""

    def _fit(self, dataset: DataFrame) -> OneHotColumnsModel:
        names, most = self.getInputCols(), self.getOrDefault(self.maxCategories)
        # The estimate is a few percent off, so the exact bound is checked on the values found.
        sizes = dataset.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in names]).first()
        kinds = dict(dataset.dtypes)
        values: dict[str, list[str]] = {c: [] for c in names}
        if max(sizes) <= 2 * most:
            pairs = F.explode(F.array(*[
                F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
            found = dataset.select(pairs.alias("p")).where("p.value is not null").select("p.*").distinct()
            for name, value in found.collect():
                values[name].append(value)
        large = [c for c, n in zip(names, sizes) if n > 2 * most or len(values[c]) > most]
        if large:
            raise ValueError(f"more than {most} categories: {', '.join(large)}")
        categories = [sorted(values[c], key=float if kinds[c].startswith(NUMBERS) else None) for c in names]
        return OneHotColumnsModel(names, categories=categories, dropFirst=self.getOrDefault(self.dropFirst))


class OneHotColumnsModel(_Stage, _OneHotParams, Model):
    """Replaces each column by 0/1 columns ``<column>_<category>``; null and unseen values give zeros."""

    categories = Param(Params._dummy(), "categories", "categories of each column", TypeConverters.identity)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, skipped = self.getInputCols(), int(self.getOrDefault(self.dropFirst))
        flags = [
            F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
            for c, values in zip(names, self.getOrDefault(self.categories)) for v in values[skipped:]]
        return dataset.select(*[F.col(f"`{c}`") for c in dataset.columns if c not in names], *flags)


class _LinearModel(_Stage, Model):
    """x -> (x - shift) / scale in place; a scale of 0, or none (no training value), gives null."""

    shifts = Param(Params._dummy(), "shifts", "what is taken off each column", TypeConverters.identity)
    scales = Param(Params._dummy(), "scales", "what each column is divided by", TypeConverters.identity)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def moved(name: str, shift: float | None, scale: float | None) -> Column:
            if not scale:
                return F.lit(None).cast("double")
            return (F.col(f"`{name}`").cast("double") - F.lit(shift)) / F.lit(scale)

        learned = zip(self.getInputCols(), self.getOrDefault(self.shifts), self.getOrDefault(self.scales))
        return dataset.withColumns({name: moved(name, shift, scale) for name, shift, scale in learned})


class MinMaxColumnsModel(_LinearModel):
    """Columns scaled by the training cohort's bounds; values beyond them leave [0, 1]."""


class ZScoreColumnsModel(_LinearModel):
    """Columns in the training cohort's population standard deviations from its mean."""


class MinMaxColumns(_Stage, Estimator):
    """Learns each column's least and greatest value."""

    def _fit(self, dataset: DataFrame) -> MinMaxColumnsModel:
        names = self.getInputCols()
        row = dataset.agg(*[f(F.col(f"`{c}`")).cast("double") for c in names for f in (F.min, F.max)]).first()
        lows, highs = row[::2], row[1::2]
        return MinMaxColumnsModel(names, shifts=list(lows), scales=[
            None if lo is None else hi - lo for lo, hi in zip(lows, highs)])


class ZScoreColumns(_Stage, Estimator):
    """Learns each column's mean and population standard deviation."""

    def _fit(self, dataset: DataFrame) -> ZScoreColumnsModel:
        names = self.getInputCols()
        row = dataset.agg(*[f(F.col(f"`{c}`")) for c in names for f in (F.avg, F.stddev_pop)]).first()
        return ZScoreColumnsModel(names, shifts=list(row[::2]), scales=list(row[1::2]))
