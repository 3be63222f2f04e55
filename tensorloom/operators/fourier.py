"""Fourier transforms over axes of fixed size, not normalised.

Two forms: ``dft`` joins the elements with a table of twiddle factors and sums,
which is plain SQL and fits short axes; ``fft`` gathers blocks of frames with all
their lanes, the places of one axis with all others fixed, and transforms them
as arrays.  A lane has the length of the axis, so a block stays small however
long the stream is.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.units import inverse as inverse_unit
from ..spec import Axis
from .blocks import BLOCK, apply, column, frames_of_block, in_blocks, places, samples, schema_of, table
from .shape import fftshift

#: The twiddle table of a ``dft`` has the square of this many rows at most.
LONGEST_DFT = 1024


def int_scale(tf: TensorFrame) -> float:
    """Integers are read as fractions of their range: 8 bits over 128, and so on."""
    d = tf.spec.dtype
    return 1.0 if d.is_floating else 1.0 / 2 ** (d.nbit - d.is_signed)


def _out_axis(axis: Axis, size: int, label: str | None) -> Axis:
    length = axis.size if axis.size > 0 else size
    return replace(axis, label=label or axis.label, size=size, start=0.0, step=1 / (axis.step * length), unit=inverse_unit(axis.unit))


def dft(tf: TensorFrame, axis: int | str, inverse: bool = False, half: bool = False, label: str | None = None) -> TensorFrame:
    """One axis by a join with its twiddle factors; ``half``: the first N/2+1 places."""
    old = tf.spec.axis(axis)
    if old.is_frame or old.size > LONGEST_DFT:
        raise ValueError(f"axis {old.label!r} is the stream or longer than {LONGEST_DFT}")
    n, spark = old.size, tf.df.sparkSession
    m = n // 2 + 1 if half else n
    angle = F.lit((2 if inverse else -2) * math.pi / n) * F.expr(f"(__k * __j) % {n}")
    table = spark.range(n * m).select(F.expr(f"id div {m}").alias("__k"), F.expr(f"id % {m}").alias("__j")).select("__k", "__j", F.cos(angle).alias("__c"), F.sin(angle).alias("__s"))
    x, scale = tf.pair, int_scale(tf)
    re, im = x.re.cast("double") * scale, x.imag.cast("double") * scale
    # the table has at most LONGEST_DFT squared rows, whatever the stream
    rows = tf.df.join(F.broadcast(table), F.col(old.label) == F.col("__k"))
    c, s = F.col("__c"), F.col("__s")
    df = rows.groupBy(*tf.over(axis), F.col("__j").alias(label or old.label)).agg(F.sum(re * c - im * s).alias("re"), F.sum(re * s + im * c).alias("im"))
    return TensorFrame(df, tf.spec.with_axis(axis, _out_axis(old, m, label)).with_dtype("cf64"), tf.keys)


def fft(tf: TensorFrame, axes: list[int | str], inverse: bool = False, real_output: bool = False, labels: list[str] | None = None, apply_fftshift: bool = False) -> TensorFrame:
    """Transform of one or more axes of fixed size.

    Real input gives N/2+1 places on the last of ``axes`` (forward);
    ``real_output`` takes that back to 2 (N - 1) real ones.  Shifted output of
    a forward transform has the zero in the middle; shifted input of an
    inverse one is taken to have it there.
    """
    if apply_fftshift and inverse:
        tf = fftshift(tf, axes, inverse=True)
    names = [tf.spec.axis(a).label for a in axes]
    real_input = not tf.spec.dtype.is_complex
    for k, name in reversed(list(enumerate(names))):
        last = k == len(names) - 1
        mode = "rfft" if last and real_input else "ifft" if inverse else "fft"
        if not last or not real_output:
            tf = _lanes(tf, name, mode)
    if real_output:  # the halved axis comes last
        tf = _lanes(tf, names[-1], "irfft" if inverse or not real_input else "rfft")
    if apply_fftshift and not inverse:
        tf = fftshift(tf, axes)
    for name, label in zip(names, labels or names, strict=True):
        if label != name:
            tf = TensorFrame(tf.df.withColumnRenamed(name, label), tf.spec.with_axis(name, replace(tf.spec.axis(name), label=label)), tf.keys)
    return tf


def _lanes(tf: TensorFrame, label: str, mode: str) -> TensorFrame:
    axis = tf.spec.axis(label)
    if axis.is_frame:
        raise KeyError(f"{label!r} is the stream")
    n = axis.size
    m = {"rfft": n // 2 + 1, "irfft": 2 * (n - 1)}.get(mode, n)
    scale = int_scale(tf)
    real = mode == "irfft"

    lanes = [a for a in tf.spec.axes if not a.is_frame and a.label != label]
    frame, shape, keys = tf.spec.frame.label, tuple(a.size for a in lanes), tf.keys
    size = frames_of_block([axis, *lanes])
    schema = schema_of(tf, tf.index, not real)

    def run(group: pa.Table) -> pa.Table:
        block = group.column(BLOCK)[0].as_py()
        t = column(group, frame) - block * size
        lane = np.ravel_multi_index(places(group, lanes), shape) if lanes else np.zeros(len(t), np.int64)
        count = int(np.prod(shape, dtype=np.int64))
        own, row = np.unique(t * count + lane, return_inverse=True)  # the lanes that are there
        x = np.zeros((len(own), n), complex)
        x[row, column(group, label)] = samples(group)
        y = {"fft": np.fft.fft, "ifft": lambda v: np.fft.ifft(v, norm="forward"), "rfft": lambda v: np.fft.rfft(v.real), "irfft": lambda v: np.fft.irfft(v, m, norm="forward")}[mode](x * scale)
        where = {frame: np.repeat(own // count + block * size, m), label: np.tile(np.arange(m), len(own))}
        if lanes:
            where |= {a.label: np.repeat(v, m) for a, v in zip(lanes, np.unravel_index(own % count, shape), strict=True)}
        return table({k: group.column(k)[0].as_py() for k in keys}, where, y.ravel(), schema)

    df = apply(in_blocks(tf, size), [*keys, BLOCK], run, schema)
    return TensorFrame(df, tf.spec.with_axis(label, _out_axis(axis, m, None)).with_dtype("f64" if real else "cf64"), keys)


def power_spectrum(tf: TensorFrame, axis: int | str) -> TensorFrame:
    """Squared magnitude of the transform of one axis."""
    out = fft(tf, [axis])
    return out.with_values(out.pair.mag2(), "f64")
