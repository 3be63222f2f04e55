"""A tensor stream: a DataFrame in long form and its spec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.complex import Pair
from .spec import TensorSpec


class TensorFrame:
    """Long-form rows with the axes of ``spec``; ``keys`` tell sequences apart.

    Operators are functions ``TensorFrame -> TensorFrame``, so a chain of them
    is one lazy plan: ``tf.then(split_axis, "time", 4).then(reduce, ...)``.
    """

    def __init__(self, df: DataFrame, spec: TensorSpec, keys: tuple[str, ...] = ()):
        need = [*keys, *spec.labels, *self.values_of(spec)]
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing} in {df.columns}")
        self.df, self.spec, self.keys = df.select(*need), spec, tuple(keys)

    @staticmethod
    def values_of(spec: TensorSpec) -> list[str]:
        return ["re", "im"] if spec.dtype.is_complex else ["value"]

    @property
    def values(self) -> list[str]:
        return self.values_of(self.spec)

    @property
    def index(self) -> list[str]:
        return [*self.keys, *self.spec.labels]

    @property
    def pair(self) -> Pair:
        """The element as an expression."""
        return Pair(F.col("re"), F.col("im")) if self.spec.dtype.is_complex else Pair(F.col("value"))

    def then(self, operator: Callable, *args, **options) -> TensorFrame:
        return operator(self, *args, **options)

    def over(self, *axes: int | str) -> list[str]:
        """All index columns but those of ``axes``."""
        gone = {self.spec.axis(a).label for a in axes}
        return [c for c in self.index if c not in gone]

    def reindexed(self, axis: int | str, place: Column) -> DataFrame:
        """The rows with another place on one axis."""
        return self.df.withColumn(self.spec.axis(axis).label, place.cast("bigint"))

    def with_values(self, value: Pair | Column, dtype: str) -> TensorFrame:
        """New elements in the same places."""
        value, spec = Pair.of(value), self.spec.with_dtype(dtype)
        new = [value.re.alias("re"), value.imag.alias("im")] if spec.dtype.is_complex else [value.re.alias("value")]
        return TensorFrame(self.df.select(*self.index, *new), spec, self.keys)
