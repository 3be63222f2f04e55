"""Reductions by groups of places, integrations, folding, scans.

All are aggregations with a partial step before the shuffle; the key keeps the
group number of the reduced axis, so one long sequence is many groups.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import TensorFrame
from .blocks import BLOCK, apply, column, frames_of_block, samples, schema_of, table

OPS = ("sum", "mean", "min", "max", "stderr")


def _aggregate(op: str, x: Column) -> Column:
    """``stderr`` is the sum over the root of the count."""
    return {"sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "stderr": F.sum(x) / F.sqrt(F.count(x))}[op].cast("double")


def reduce(tf: TensorFrame, axis: int | str, factor: int | None = None, op: str = "sum") -> TensorFrame:
    """Each ``factor`` neighbours on an axis as one (None: all of them).

    ``op`` is one of :data:`OPS`, with ``pwr`` before it of the squared
    magnitude.  Complex elements have no order.
    """
    old = tf.spec.axis(axis)
    power, name = op.startswith("pwr"), op.removeprefix("pwr")
    if name not in OPS:
        raise ValueError(f"unknown operation {op!r}")
    if old.is_frame and factor is None:
        raise ValueError("a stream has no whole to reduce; give a factor")
    factor = factor or old.size
    if old.is_frame and tf.spec.gulp_nframe % factor and factor % tf.spec.gulp_nframe:
        raise ValueError(f"{factor} and the gulp of {tf.spec.gulp_nframe} frames do not fit")
    if not old.is_frame and old.size % factor:
        raise ValueError(f"{factor} does not divide axis {old.label!r} of size {old.size}")
    value = tf.pair.mag2() if power else tf.pair
    if value.im is not None and name in ("min", "max"):
        raise ValueError(f"{op!r} of complex elements")
    parts = {"value": value.re} if value.im is None else {"re": value.re, "im": value.im}
    df = tf.df.groupBy(*tf.over(axis), F.expr(f"`{old.label}` div {factor}").alias(old.label)).agg(*[_aggregate(name, x).alias(c) for c, x in parts.items()])
    new = replace(old, size=-1 if old.is_frame else old.size // factor, step=old.step * factor)
    return TensorFrame(df, tf.spec.with_axis(axis, new).with_dtype("f32" if value.im is None else "cf32"), tf.keys)


def reduce_to(tf: TensorFrame, sizes: dict[str, int], op: str = "sum") -> TensorFrame:
    """Axes as small as ``sizes`` says, their groups as one: the factors follow from the shapes.

    For the stream the number is that of its gulp of frames.
    """
    power, name = op.startswith("pwr"), op.removeprefix("pwr")
    if name not in OPS:
        raise ValueError(f"unknown operation {op!r}")
    value, spec, group = tf.pair.mag2() if power else tf.pair, tf.spec, {}
    if value.im is not None and name in ("min", "max"):
        raise ValueError(f"{op!r} of complex elements")
    for label, size in sizes.items():
        old = tf.spec.axis(label)
        whole = tf.spec.gulp_nframe if old.is_frame else old.size
        if size < 1 or whole % size:
            raise ValueError(f"axis {label!r} of size {whole} does not become {size}")
        factor = whole // size
        group[label] = F.expr(f"`{label}` div {factor}").alias(label)
        spec = spec.with_axis(label, replace(old, size=-1 if old.is_frame else size, step=old.step * factor))
        if old.is_frame:
            spec = spec.with_header(gulp_nframe=size)
    values = {"value": value.re} if value.im is None else {"re": value.re, "im": value.im}
    df = tf.df.groupBy(*tf.over(*sizes), *group.values()).agg(*[_aggregate(name, x).alias(c) for c, x in values.items()])
    return TensorFrame(df, spec.with_dtype("f32" if value.im is None else "cf32"), tf.keys)


def accumulate(tf: TensorFrame, nframe: int, keep_partial: bool = False) -> TensorFrame:
    """Sums of ``nframe`` frames; an unfinished one at the end is dropped."""
    return _integrate(tf, nframe, F.sum, keep_partial)


def scrunch(tf: TensorFrame, nframe: int, keep_partial: bool = False) -> TensorFrame:
    """Means of ``nframe`` frames."""
    return _integrate(tf, nframe, F.avg, keep_partial)


def _integrate(tf: TensorFrame, nframe: int, how, keep_partial: bool) -> TensorFrame:
    frame = tf.spec.frame
    group = tf.df.groupBy(*tf.over(frame.label), F.expr(f"`{frame.label}` div {nframe}").alias(frame.label))
    df = group.agg(*[how(c).alias(c) for c in tf.values], F.count("*").alias("__n"))
    if not keep_partial:
        df = df.where(F.col("__n") == nframe)
    spec = tf.spec.with_axis(frame.label, replace(frame, step=frame.step * nframe)).with_header(gulp_nframe=1)
    return TensorFrame(df, spec, tf.keys)


def prefix_scan(tf: TensorFrame, axis: int | str, op: str = "sum", reverse: bool = False) -> TensorFrame:
    """Running sum, product, min or max along an axis of fixed size.

    On the stream itself a scan needs all rows of a lane in order; use
    :func:`tensorloom.streaming.stateful.running` for that.
    """
    label = tf.spec.axis(axis).label
    how = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[op]
    order = F.desc(label) if reverse else F.asc(label)
    w = Window.partitionBy(*tf.over(axis)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return TensorFrame(tf.df.withColumns({c: how(c).over(w) for c in tf.values}), tf.spec, tf.keys)


def correlate(tf: TensorFrame, nframe: int, full: bool = False) -> TensorFrame:
    """Visibilities ``sum_t conj(x[i, p]) x[j, q]`` of ``nframe`` frames.

    Axes are time (the stream), freq, station and pol; the result has station_i,
    pol_i, station_j and pol_j, of which the lower triangle ``(i, p) >= (j, q)``
    is given, or all with ``full``.  An integration of a channel is multiplied
    as arrays, a block of frames at a time, and the blocks are summed;
    incomplete ones are dropped.
    """
    t, f, s, p = tf.spec.labels
    if not tf.spec.axes[0].is_frame:
        raise ValueError("the first axis must be the stream")
    time, freq, station, pol = tf.spec.axes
    n = station.size * pol.size
    size = min(nframe, frames_of_block([station, pol]))
    sides = [f"{s}_i", f"{p}_i", f"{s}_j", f"{p}_j"]
    index = [*tf.keys, t, f, *sides]
    plain, keys = schema_of(tf, index, True), tf.keys

    def run(group: pa.Table) -> pa.Table:
        k, c = column(group, t), column(group, s) * pol.size + column(group, p)
        own = k // nframe
        k = k - k.min()
        x = np.zeros((int(k.max()) + 1, n), np.complex128)
        have = np.zeros(x.shape)
        x[k, c], have[k, c] = samples(group), 1
        sums, counts = x.conj().T @ x, have.T @ have
        a, b = np.nonzero(counts)
        if not full:
            a, b = a[a >= b], b[a >= b]
        where = {s_: v for s_, v in zip(sides, (a // pol.size, a % pol.size, b // pol.size, b % pol.size), strict=True)}
        out = table({**{x: group.column(x)[0].as_py() for x in keys}, t: int(own[0]), f: group.column(f)[0].as_py()}, where, sums[a, b], plain)
        return out.append_column("n", pa.array(counts[a, b].astype(np.int64)))

    rows = tf.df.withColumns({BLOCK: F.expr(f"`{t}` div {nframe}"), "__part": F.expr(f"`{t}` % {nframe} div {size}")})
    df = apply(rows, [*tf.keys, f, BLOCK, "__part"], run, plain + ", n bigint")
    if size < nframe:
        df = df.groupBy(*index).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n"))
    axes = (replace(time, step=time.step * nframe), freq, *[replace(x, label=name) for name, x in zip(sides, (station, pol, station, pol), strict=True)])
    spec = replace(tf.spec.with_dtype("cf32"), axes=axes)
    return TensorFrame(df.where(F.col("n") == nframe), spec, tf.keys)


def fold(tf: TensorFrame, bins: int, period: float, dm: float = 0.0, freq: str | None = None) -> TensorFrame:
    """Mean by phase of a period, after the delay of each channel is taken off.

    Time and period are in the stream's unit; the delay of frequency ``f`` MHz
    is ``4.15e-3 dm ((f0/1000)^-2 - (f/1000)^-2)`` seconds, ``f0`` the first.
    """
    frame = tf.spec.frame
    time = frame.start + F.col(frame.label) * frame.step
    if freq is not None:
        axis = tf.spec.axis(freq)
        f = axis.start + F.col(axis.label) * axis.step
        time = time - 4.15e-3 * dm * (F.pow(F.lit(axis.start / 1000), -2.0) - F.pow(f / 1000, -2.0))
    phase = F.floor(F.pmod(time, F.lit(float(period))) / float(period) * bins)
    place = F.least(phase, F.lit(bins - 1)).cast("bigint").alias("phase")
    df = tf.df.withColumn("__phase", place).groupBy(*tf.over(frame.label), F.col("__phase").alias("phase")).agg(F.avg("value").alias("value"))
    df = df.withColumn(frame.label, F.lit(0).cast("bigint"))
    at = tf.spec.index(frame.label)
    spec = replace(tf.spec, axes=tf.spec.axes[: at + 1] + (replace(frame, label="phase", size=bins, start=0.0, step=1.0 / bins, unit=None),) + tf.spec.axes[at + 1 :])
    return TensorFrame(df, spec.with_dtype("f64"), tf.keys)


def kurtosis_mask(tf: TensorFrame, gulp: int, limit: float = 0.1) -> TensorFrame:
    """Channels of a gulp whose spectral kurtosis leaves 0.5 by over ``limit`` become 0."""
    frame = tf.spec.frame
    gulped = tf.df.withColumn("__g", F.expr(f"`{frame.label}` div {gulp}"))
    keys = [*tf.over(frame.label), "__g"]
    x, m = F.col("value").cast("double"), F.count("*").cast("double")
    v2 = F.try_divide(m, m - 1) * (F.try_divide(m * F.sum(x * x), F.sum(x) * F.sum(x)) - 1)
    bad = gulped.groupBy(*keys).agg(F.coalesce(F.abs(0.5 - v2) > limit, F.lit(True)).alias("__bad"))  # no power: no kurtosis
    df = gulped.join(bad, keys).withColumn("value", F.when(F.col("__bad"), 0).otherwise(F.col("value")))
    return TensorFrame(df, tf.spec, tf.keys)
