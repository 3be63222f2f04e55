"""What a tensor stream is: element type, labelled axes, header.

A tensor stream is a table in long form: one integer column for each axis and
``value``, or ``re`` and ``im``.  Exactly one axis, of size -1, is the stream.
A :class:`TensorSpec` is kept by the driver and checked before any plan is
made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .functions.units import convert

_DTYPE = re.compile(r"(cf|ci|i|u|f)(\d+)$")


@dataclass(frozen=True)
class DType:
    """Kind (``i u f ci cf``) and bits of a real component."""

    kind: str
    nbit: int

    @classmethod
    def of(cls, name: str | DType) -> DType:
        if isinstance(name, DType):
            return name
        m = _DTYPE.match(name)
        sizes = {"i": (1, 2, 4, 8, 16, 32, 64), "u": (1, 2, 4, 8, 16, 32, 64), "f": (16, 32, 64)}
        if not m or int(m[2]) not in sizes[m[1][-1]]:
            raise ValueError(f"unknown element type {name!r}")
        return cls(m[1], int(m[2]))

    def __str__(self) -> str:
        return f"{self.kind}{self.nbit}"

    @property
    def is_complex(self) -> bool:
        return self.kind[0] == "c"

    @property
    def is_floating(self) -> bool:
        return self.kind[-1] == "f"

    @property
    def is_signed(self) -> bool:
        return self.kind[-1] != "u"

    @property
    def itemsize_bits(self) -> int:
        return self.nbit * (1 + self.is_complex)

    def as_real(self) -> DType:
        return replace(self, kind=self.kind[-1])

    def as_complex(self) -> DType:
        return replace(self, kind="c" + ("i" if self.kind == "u" else self.kind[-1]))

    def as_nbit(self, nbit: int) -> DType:
        return replace(self, nbit=nbit)

    def as_integer(self, nbit: int | None = None) -> DType:
        return DType(self.kind.replace("f", "i"), nbit or self.nbit)

    def as_floating_point(self) -> DType:
        """32 bits where they hold all values, 64 otherwise."""
        if self.is_floating:
            return self
        return DType("cf" if self.is_complex else "f", 32 if self.nbit <= 24 else 64)

    def bounds(self) -> tuple[int, int]:
        """Least and greatest value that quantising gives; symmetric if signed."""
        top = 2 ** (self.nbit - self.is_signed) - 1
        return (-top if self.is_signed else 0), top

    def sql(self) -> str:
        """Spark's type of a component; unsigned integers are one step wider."""
        if self.is_floating:
            return "float" if self.nbit <= 32 else "double"
        steps = ["tinyint", "smallint", "int", "bigint", "decimal(20,0)"]
        at = {8: 0, 16: 1, 32: 2, 64: 3}.get(max(8, self.nbit))
        return steps[at + (not self.is_signed and self.nbit >= 8)]


@dataclass(frozen=True)
class Axis:
    """A labelled axis; ``size`` -1 is the stream, ``start + k * step`` its scale."""

    label: str
    size: int
    start: float = 0.0
    step: float = 1.0
    unit: str | None = None
    categories: tuple[str, ...] | None = None

    @property
    def is_frame(self) -> bool:
        return self.size == -1


@dataclass(frozen=True)
class TensorSpec:
    dtype: DType
    axes: tuple[Axis, ...]
    header: dict = field(default_factory=dict)

    @classmethod
    def of(cls, dtype: str, *axes: Axis, **header) -> TensorSpec:
        out = cls(DType.of(dtype), tuple(axes), header)
        labels = out.labels
        if sum(a.is_frame for a in axes) != 1:
            raise ValueError("exactly one axis must have size -1")
        if len(set(labels)) != len(labels):
            raise ValueError(f"labels repeat: {labels}")
        return out

    @property
    def labels(self) -> list[str]:
        return [a.label for a in self.axes]

    @property
    def frame(self) -> Axis:
        return next(a for a in self.axes if a.is_frame)

    @property
    def gulp_nframe(self) -> int:
        return self.header.get("gulp_nframe", 1)

    def index(self, axis: int | str) -> int:
        """Place of an axis given by place (negative from the end) or label."""
        if isinstance(axis, str):
            if axis not in self.labels:
                raise KeyError(axis)
            return self.labels.index(axis)
        if not -len(self.axes) <= axis < len(self.axes):
            raise IndexError(axis)
        return axis % len(self.axes)

    def axis(self, axis: int | str) -> Axis:
        return self.axes[self.index(axis)]

    def with_axis(self, axis: int | str, *new: Axis) -> TensorSpec:
        """The axis replaced by none, one or more."""
        k = self.index(axis)
        return replace(self, axes=self.axes[:k] + new + self.axes[k + 1 :])

    def with_dtype(self, dtype: str | DType) -> TensorSpec:
        return replace(self, dtype=DType.of(dtype))

    def with_header(self, **header) -> TensorSpec:
        return replace(self, header=self.header | header)

    def same_scale(self, a: Axis, b: Axis, factor: float = 1.0) -> bool:
        """Whether a step of ``a`` is ``factor`` steps of ``b``."""
        step = convert(b.step, b.unit, a.unit) if a.unit and b.unit else b.step
        return abs(a.step - factor * step) <= 1e-9 * max(abs(a.step), 1e-300)

    def pretty(self) -> str:
        """The header as text, an axis a line."""
        lines = [f"{self.header.get('name', 'tensor')}: {self.dtype}"]
        lines += [f"  {a.label}: size {'stream' if a.is_frame else a.size}, start {a.start}, step {a.step}" + (f" {a.unit}" if a.unit else "") for a in self.axes]
        return "\n".join(lines + [f"  {k} = {v}" for k, v in sorted(self.header.items()) if k != "name"])

    def to_json(self) -> dict:
        scales = [None if a.categories else [a.start, a.step] for a in self.axes]
        units = [list(a.categories) if a.categories else a.unit for a in self.axes]
        return self.header | {"_tensor": {"dtype": str(self.dtype), "shape": [a.size for a in self.axes], "labels": self.labels, "scales": scales, "units": units}}

    @classmethod
    def from_json(cls, header: dict) -> TensorSpec:
        t = header["_tensor"]
        axes = []
        for label, size, scale, unit in zip(t["labels"], t["shape"], t["scales"], t["units"], strict=True):
            start, step = scale or (0.0, 1.0)
            named = isinstance(unit, list | tuple)
            axes.append(Axis(label, size, start, step, None if named else unit, tuple(unit) if named else None))
        return cls.of(t["dtype"], *axes, **{k: v for k, v in header.items() if k != "_tensor"})
