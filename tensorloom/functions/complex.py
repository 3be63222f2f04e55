"""Complex numbers as pairs of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pair:
    """Real and imaginary part; a real number has no ``im``."""

    re: Column
    im: Column | None = None

    @classmethod
    def of(cls, x) -> Pair:
        if isinstance(x, Pair):
            return x
        if isinstance(x, complex):
            return cls(F.lit(x.real), F.lit(x.imag))
        return cls(x if isinstance(x, Column) else F.lit(x))

    @property
    def imag(self) -> Column:
        return F.lit(0.0) if self.im is None else self.im

    def conj(self) -> Pair:
        return self if self.im is None else Pair(self.re, -self.im)

    def mag2(self) -> Pair:
        return Pair(self.re * self.re if self.im is None else self.re * self.re + self.im * self.im)

    def mag(self) -> Pair:
        return Pair(F.abs(self.re) if self.im is None else F.sqrt(self.mag2().re))

    def phase(self) -> Pair:
        return Pair(F.atan2(self.imag, self.re))

    def __neg__(self) -> Pair:
        return Pair(-self.re, None if self.im is None else -self.im)

    def __add__(self, other) -> Pair:
        o = Pair.of(other)
        return Pair(self.re + o.re, None if self.im is None and o.im is None else self.imag + o.imag)

    def __sub__(self, other) -> Pair:
        return self + -Pair.of(other)

    def __mul__(self, other) -> Pair:
        o = Pair.of(other)
        if self.im is None and o.im is None:
            return Pair(self.re * o.re)
        if o.im is None:
            return Pair(self.re * o.re, self.im * o.re)
        if self.im is None:
            return Pair(self.re * o.re, self.re * o.im)
        return Pair(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, other) -> Pair:
        o = Pair.of(other)
        if o.im is None:
            return Pair(self.re / o.re, None if self.im is None else self.im / o.re)
        up, down = self * o.conj(), o.mag2().re
        return Pair(up.re / down, up.imag / down)

    def exp(self) -> Pair:
        if self.im is None:
            return Pair(F.exp(self.re))
        return Pair(F.exp(self.re) * F.cos(self.im), F.exp(self.re) * F.sin(self.im))
