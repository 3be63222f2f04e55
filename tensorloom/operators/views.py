"""Views: new labels, scales and shapes; at most index arithmetic on the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import Axis, DType, TensorSpec


def custom(tf: TensorFrame, change: Callable[[TensorSpec], TensorSpec]) -> TensorFrame:
    """A spec that ``change`` makes of the present one; labels and kind stay."""
    return TensorFrame(tf.df, change(tf.spec), tf.keys)


def rename_axis(tf: TensorFrame, old: int | str, new: str) -> TensorFrame:
    axis = tf.spec.axis(old)
    return TensorFrame(tf.df.withColumnRenamed(axis.label, new), tf.spec.with_axis(old, replace(axis, label=new)), tf.keys)


def reinterpret_axis(tf: TensorFrame, axis: int | str, label: str, start: float = 0.0, step: float = 1.0, unit: str | None = None) -> TensorFrame:
    old = tf.spec.axis(axis)
    return TensorFrame(tf.df.withColumnRenamed(old.label, label), tf.spec.with_axis(axis, Axis(label, old.size, start, step, unit)), tf.keys)


def reverse_scale(tf: TensorFrame, axis: int | str) -> TensorFrame:
    """The axis counts down; places stay.  Labels and numbers mean the same."""
    old = tf.spec.axis(axis)
    return TensorFrame(tf.df, tf.spec.with_axis(axis, replace(old, step=-old.step)), tf.keys)


def add_axis(tf: TensorFrame, at: int | str, label: str, start: float = 0.0, step: float = 1.0, unit: str | None = None) -> TensorFrame:
    """An axis of size 1, before place ``at`` or after the axis of that label."""
    k = tf.spec.index(at) + 1 if isinstance(at, str) else at + (len(tf.spec.axes) + 1) * (at < 0)
    if not 0 <= k <= len(tf.spec.axes):
        raise IndexError(at)
    spec = replace(tf.spec, axes=tf.spec.axes[:k] + (Axis(label, 1, start, step, unit),) + tf.spec.axes[k:])
    return TensorFrame(tf.df.withColumn(label, F.lit(0).cast("bigint")), spec, tf.keys)


def delete_axis(tf: TensorFrame, axis: int | str) -> TensorFrame:
    if tf.spec.axis(axis).size != 1:
        raise ValueError(f"axis {axis!r} has size {tf.spec.axis(axis).size}, not 1")
    return TensorFrame(tf.df, tf.spec.with_axis(axis), tf.keys)


def astype(tf: TensorFrame, dtype: str) -> TensorFrame:
    """Integer elements of the same memory as another integer type.

    The last axis grows or shrinks as the bytes say (little-endian).
    """
    old, new, last = tf.spec.dtype, DType.of(dtype), tf.spec.axes[-1]
    if old.is_complex or new.is_complex or old.is_floating or new.is_floating or min(old.nbit, new.nbit) < 8 or max(old.nbit, new.nbit) > 32:
        raise ValueError(f"cannot see {old} as {new}")
    col, label = F.col("value").cast("bigint"), last.label
    word = F.when(col < 0, col + 2**old.nbit).otherwise(col)  # as unsigned

    def signed(x):
        return F.when(x >= 2 ** (new.nbit - 1), x - 2**new.nbit).otherwise(x) if new.is_signed else x

    n = old.nbit // new.nbit
    if n >= 1:
        parts = F.array(*[F.struct(F.lit(i).alias("i"), signed(F.shiftright(word, i * new.nbit).bitwiseAND(2**new.nbit - 1)).alias("v")) for i in range(n)])
        df = tf.df.withColumn("__p", F.explode(parts)).withColumn(label, F.col(label) * n + F.col("__p.i")).withColumn("value", F.col("__p.v"))
        size = last.size * n if last.size > 0 else -1
    else:
        n = new.nbit // old.nbit
        if last.size > 0 and last.size % n:
            raise ValueError(f"axis {label!r} of size {last.size} is not a multiple of {n}")
        place = F.shiftleft(F.lit(1).cast("bigint"), (F.col(label) % n * old.nbit).cast("int"))
        df = tf.df.withColumn("__w", word * place).groupBy(*tf.over(label), F.expr(f"`{label}` div {n}").alias(label)).agg(signed(F.sum("__w")).alias("value"))
        size = last.size // n if last.size > 0 else -1
    return TensorFrame(df, tf.spec.with_axis(label, replace(last, size=size)).with_dtype(new), tf.keys)


def split_axis(tf: TensorFrame, axis: int | str, n: int, label: str | None = None) -> TensorFrame:
    """``k`` becomes ``k div n`` and ``k mod n``."""
    old = tf.spec.axis(axis)
    label = label or f"{old.label}_split"
    if not old.is_frame and old.size % n:
        raise ValueError(f"{n} does not divide axis {old.label!r} of size {old.size}")
    outer = replace(old, size=-1 if old.is_frame else old.size // n, step=old.step * n)
    k = F.col(old.label)
    df = tf.df.withColumns({old.label: F.expr(f"`{old.label}` div {n}"), label: F.pmod(k, F.lit(n))})
    spec = tf.spec.with_axis(axis, outer, Axis(label, n, 0.0, old.step, old.unit))
    if old.is_frame:
        spec = spec.with_header(gulp_nframe=-(-spec.gulp_nframe // n))
    return TensorFrame(df, spec, tf.keys)


def merge_axes(tf: TensorFrame, first: int | str, second: int | str, label: str | None = None) -> TensorFrame:
    """Neighbouring axes as one, ``k1 * n + k2``; their scales must fit."""
    i, j = tf.spec.index(first), tf.spec.index(second)
    a, b = tf.spec.axes[i], tf.spec.axes[j]
    if j != i + 1:
        raise ValueError("only neighbouring axes can be merged")
    if b.is_frame:
        raise ValueError("the stream can only be the first of the two")
    if not tf.spec.same_scale(a, b, b.size):
        raise ValueError(f"step {a.step} of {a.label!r} is not {b.size} steps of {b.label!r}")
    new = Axis(label or a.label, -1 if a.is_frame else a.size * b.size, a.start, b.step, b.unit)
    df = tf.df.withColumn("__k", F.col(a.label) * b.size + F.col(b.label)).drop(a.label, b.label).withColumnRenamed("__k", new.label)
    spec = tf.spec.with_axis(j).with_axis(i, new)
    return TensorFrame(df, spec.with_header(gulp_nframe=spec.gulp_nframe * b.size) if a.is_frame else spec, tf.keys)
