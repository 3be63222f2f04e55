"""Jones calculus: vectors and 2 by 2 matrices of complex columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import TensorFrame
from .complex import Pair


@dataclass(frozen=True)
class Vector:
    """Both polarisations of a wave."""

    x: Pair
    y: Pair

    @classmethod
    def column(cls, x: str, y: str) -> Vector:
        """Of struct columns with ``re`` and ``im``."""
        return cls(*[Pair(F.col(c)["re"], F.col(c)["im"]) for c in (x, y)])

    def conj(self) -> Vector:
        return Vector(self.x.conj(), self.y.conj())

    def __neg__(self) -> Vector:
        return Vector(-self.x, -self.y)

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.x + other.x, self.y + other.y)

    def __sub__(self, other: Vector) -> Vector:
        return self + -other

    def __mul__(self, by) -> Vector:
        return Vector(self.x * by, self.y * by)

    def mag2(self) -> Pair:
        return self.x.mag2() + self.y.mag2()

    def inner(self, other: Vector) -> Pair:
        """``self^H other``."""
        return self.x.conj() * other.x + self.y.conj() * other.y

    def outer(self, other: Vector | None = None) -> Jones:
        """``self other^H``; of the vector itself, its coherency."""
        o = (other or self).conj()
        return Jones(self.x * o.x, self.x * o.y, self.y * o.x, self.y * o.y)


@dataclass(frozen=True)
class Jones:
    """A matrix ``[[xx, xy], [yx, yy]]``."""

    xx: Pair
    xy: Pair
    yx: Pair
    yy: Pair

    @classmethod
    def of(cls, xx, xy, yx, yy) -> Jones:
        return cls(*[Pair.of(v if isinstance(v, Pair | Column) else complex(v)) for v in (xx, xy, yx, yy)])

    def transpose(self) -> Jones:
        return Jones(self.xx, self.yx, self.xy, self.yy)

    def conj(self) -> Jones:
        return Jones(self.xx.conj(), self.xy.conj(), self.yx.conj(), self.yy.conj())

    def adjoint(self) -> Jones:
        return self.transpose().conj()

    def trace(self) -> Pair:
        return self.xx + self.yy

    def det(self) -> Pair:
        return self.xx * self.yy - self.xy * self.yx

    def mag2(self) -> Pair:
        return self.xx.mag2() + self.xy.mag2() + self.yx.mag2() + self.yy.mag2()

    def inverse(self) -> Jones:
        """Null where the matrix has none."""
        d = self.det()
        by = d.conj() * Pair(F.try_divide(F.lit(1.0), d.mag2().re))
        return Jones(self.yy * by, -self.xy * by, -self.yx * by, self.xx * by)

    def __neg__(self) -> Jones:
        return Jones(-self.xx, -self.xy, -self.yx, -self.yy)

    def __add__(self, other: Jones) -> Jones:
        return Jones(self.xx + other.xx, self.xy + other.xy, self.yx + other.yx, self.yy + other.yy)

    def __sub__(self, other: Jones) -> Jones:
        return self + -other

    def __mul__(self, by) -> Jones:
        return Jones(self.xx * by, self.xy * by, self.yx * by, self.yy * by)

    def __matmul__(self, other: Jones | Vector) -> Jones | Vector:
        if isinstance(other, Vector):
            return Vector(self.xx * other.x + self.xy * other.y, self.yx * other.x + self.yy * other.y)
        a = self @ Vector(other.xx, other.yx)
        b = self @ Vector(other.xy, other.yy)
        return Jones(a.x, b.x, a.y, b.y)


def vectors(tf: TensorFrame, pol: str = "pol") -> DataFrame:
    """A row for each place, with the structs ``x`` and ``y`` of its two polarisations."""
    if tf.spec.axis(pol).size != 2:
        raise ValueError(f"axis {pol!r} has size {tf.spec.axis(pol).size}, not 2")
    pick = lambda k: F.max(F.when(F.col(pol) == k, F.struct(tf.pair.re.alias("re"), tf.pair.imag.alias("im"))))
    return tf.df.groupBy(*tf.over(pol)).agg(pick(0).alias("x"), pick(1).alias("y"))


def apply(matrix: Jones, tf: TensorFrame, pol: str = "pol") -> TensorFrame:
    """``matrix`` times the two polarisations of each place."""
    out = matrix @ Vector.column("x", "y")
    parts = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), v.re.cast("double").alias("re"), v.imag.cast("double").alias("im")) for k, v in enumerate((out.x, out.y))])
    rows = vectors(tf, pol).withColumn("__p", F.explode(parts))
    df = rows.select(*tf.over(pol), F.col("__p.k").alias(pol), F.col("__p.re").alias("re"), F.col("__p.im").alias("im"))
    return TensorFrame(df, replace(tf.spec.with_dtype("cf64")), tf.keys)
