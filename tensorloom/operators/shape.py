"""Moving elements: transpose, reversal, shifts, slices, constructors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import TensorSpec


def copy(tf: TensorFrame, persist: bool = False) -> TensorFrame:
    """The same stream; kept in memory and on disk for several readers if asked."""
    return TensorFrame(tf.df.persist() if persist else tf.df, tf.spec, tf.keys)


def transpose(tf: TensorFrame, axes: list[int | str]) -> TensorFrame:
    """Axes in another order: in long form only the spec changes."""
    order = [tf.spec.index(a) for a in axes]
    if sorted(order) != list(range(len(tf.spec.axes))):
        raise ValueError(f"{axes} does not name each axis once")
    return TensorFrame(tf.df, replace(tf.spec, axes=tuple(tf.spec.axes[k] for k in order)), tf.keys)


def _fixed(tf: TensorFrame, axis: int | str):
    found = tf.spec.axis(axis)
    if found.is_frame:
        raise KeyError(f"{found.label!r} is the stream")
    return found


def reverse(tf: TensorFrame, axes: list[int | str], circular: bool = True) -> TensorFrame:
    """``b[i] = a[-i]``: place 0 stays, or with ``circular`` false the order turns round."""
    for a in axes:
        axis = _fixed(tf, a)
        k, n = F.col(axis.label), axis.size
        df = tf.reindexed(axis.label, F.pmod(-k, F.lit(n)) if circular else n - 1 - k)
        start = axis.start + (n if circular else n - 1) * axis.step
        tf = TensorFrame(df, tf.spec.with_axis(axis.label, replace(axis, start=start, step=-axis.step)), tf.keys)
    return tf


def fftshift(tf: TensorFrame, axes: list[int | str], inverse: bool = False) -> TensorFrame:
    """The zero place to the middle, or back."""
    for a in axes:
        axis = _fixed(tf, a)
        by = axis.size - axis.size // 2 if inverse else axis.size // 2
        df = tf.reindexed(axis.label, F.pmod(F.col(axis.label) + by, F.lit(axis.size)))
        start = axis.start + (1 if inverse else -1) * (axis.size // 2) * axis.step
        tf = TensorFrame(df, tf.spec.with_axis(axis.label, replace(axis, start=start)), tf.keys)
    return tf


def slice_axis(tf: TensorFrame, axis: int | str, start: int, stop: int, step: int = 1) -> TensorFrame:
    """Places ``start`` to ``stop`` (exclusive), each ``step``-th: a pushed filter."""
    old = tf.spec.axis(axis)
    k = F.col(old.label)
    rows = tf.df.where((k >= start) & (k < stop))
    if step > 1:
        rows = rows.where((k - start) % step == 0)
    df = rows.withColumn(old.label, F.expr(f"(`{old.label}` - {start}) div {step}"))
    size = -1 if old.is_frame else len(range(start, min(stop, old.size), step))
    return TensorFrame(df, tf.spec.with_axis(axis, replace(old, size=size, start=old.start + start * old.step, step=old.step * step)), tf.keys)


def split(tf: TensorFrame, axis: int | str, *parts: list[int]) -> list[TensorFrame]:
    """One stream for each list of places, numbered anew."""
    old, out = tf.spec.axis(axis), []
    for places in parts:
        new = F.create_map(*[F.lit(x).cast("bigint") for pair in zip(places, range(len(places)), strict=True) for x in pair])
        df = tf.df.where(F.col(old.label).isin(places)).withColumn(old.label, new[F.col(old.label)])
        out.append(TensorFrame(df, tf.spec.with_axis(axis, replace(old, size=len(places))), tf.keys))
    return out


def filled(spark: SparkSession, spec: TensorSpec, nframe: int, value: float = 0.0) -> TensorFrame:
    """``nframe`` frames of one value."""
    sizes = [nframe if a.is_frame else a.size for a in spec.axes]
    total = 1
    for n in sizes:
        total *= n
    df, below = spark.range(total), total
    for axis, n in zip(spec.axes, sizes, strict=True):
        below //= n
        df = df.withColumn(axis.label, F.expr(f"(id div {max(1, below)}) % {n}"))
    for c in TensorFrame.values_of(spec):
        df = df.withColumn(c, F.lit(value if c != "im" else 0.0).cast(spec.dtype.sql()))
    return TensorFrame(df, spec)


def conj(tf: TensorFrame) -> TensorFrame:
    return tf.with_values(tf.pair.conj(), tf.spec.dtype) if tf.spec.dtype.is_complex else tf


def byteswap(tf: TensorFrame) -> TensorFrame:
    """Integer elements with their bytes in the other order."""
    d = tf.spec.dtype
    if d.is_floating or d.nbit not in (8, 16, 32):
        raise ValueError(f"cannot swap the bytes of {d}")

    def swapped(c: str) -> Column:
        word = F.pmod(F.col(c).cast("bigint"), F.lit(2**d.nbit))
        parts = [F.shiftright(word, 8 * k).bitwiseAND(255) * 2 ** (d.nbit - 8 - 8 * k) for k in range(d.nbit // 8)]
        whole = parts[0]
        for x in parts[1:]:
            whole = whole + x
        return (F.when(whole >= 2 ** (d.nbit - 1), whole - 2**d.nbit).otherwise(whole) if d.is_signed else whole).cast(d.sql())

    return TensorFrame(tf.df.withColumns({c: swapped(c) for c in tf.values}), tf.spec, tf.keys)


def cast(tf: TensorFrame, dtype: str) -> TensorFrame:
    """Elements as another type: the real part alone, or with a zero imaginary part."""
    new = TensorFrame.values_of(tf.spec.with_dtype(dtype))
    value = tf.pair
    out = tf.with_values(value if len(new) == 2 else value.re, dtype)
    kind = out.spec.dtype.sql()
    return TensorFrame(out.df.withColumns({c: F.col(c).cast(kind) for c in new}), out.spec, out.keys)
