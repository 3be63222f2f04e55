"""Dispersion: shifts of channels, and the fast dispersion measure transform.

The transform is a tree.  It starts with running means of each channel over
``d + 1`` samples, and each step joins neighbouring bands: the row of delay
``d`` of the joint band is the lower band's row of the delay up to its last
channel, plus the upper band's row of what is left from its first channel on,
as many samples earlier.  The whole tree of a block of frames, with the frames
before it that its delays reach, is computed in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.units import convert
from ..spec import Axis
from .blocks import BLOCK, apply, column, frames_of_block, samples, schema_of, table, with_halo

# fixed value: dispersion constant in MHz^2 s per (pc cm^-3)
KDM = 4.148741601e3


def max_delay_of(max_dm: float, f0: float, df: float, nchan: int, dt: float) -> int:
    """Samples by which the band's lowest frequency lags at a dispersion measure."""
    return math.ceil(abs(KDM / dt * max_dm * (f0**-2 - (f0 + nchan * df) ** -2)))


@dataclass(frozen=True)
class Band:
    """Neighbouring channels and the number of their delays."""

    first: int
    size: int
    rows: int


@dataclass(frozen=True)
class Step:
    """One step of the tree, by output row: rows of the step before (-1: none) and samples by which the upper one is shifted."""

    bands: list[Band]
    lower: np.ndarray
    upper: np.ndarray
    shift: np.ndarray


def _nearest(x: np.ndarray) -> np.ndarray:
    """Whole numbers; halves go up."""
    return np.floor(x + 0.5).astype(np.int64)


def plan(nchan: int, max_delay: int, f0: float, df: float, exponent: float = -2.0) -> list[Step]:
    """The steps of an ascending band whose first channel is centred at ``f0``.

    The first step has the channels, each from edge to edge; a joint band runs
    from the centre of its first channel to that of its last.
    """
    lag = lambda c: (f0 + df * c) ** exponent
    whole = lag(0) - lag(nchan - 1)
    count = lambda a, b: int(np.ceil((lag(a) - lag(b)) / whole * (max_delay - 1) if nchan > 1 else 0)) + 1
    bands = [Band(c, 1, count(c - 0.5, c + 0.5)) for c in range(nchan)]
    none = np.zeros(0, np.int64)
    steps = [Step(bands, none, none, none)]
    while len(bands) > 1:
        # of an odd number one band stays alone: the last one and the first one by turns
        alone = len(bands) % 2
        head = bands[:1] if alone and len(steps) % 2 == 0 else []
        rest = bands[len(head) :]
        groups = [head] * bool(head) + [rest[k : k + 2] for k in range(0, len(rest), 2)]
        begins = dict(zip([b.first for b in bands], np.cumsum([0, *[b.rows for b in bands]]).tolist(), strict=False))
        joint, lower, upper, shift = [], [], [], []
        for group in groups:
            first, last = group[0], group[-1]
            size = sum(b.size for b in group)
            band = Band(first.first, size, count(first.first, first.first + size - 1))
            d = np.arange(band.rows)
            if len(group) == 1:
                at, other, late = d, np.full(len(d), -1 - begins[first.first]), np.zeros(len(d), np.int64)
            else:
                span = lag(band.first) - lag(band.first + size - 1)
                at = _nearest(d * ((lag(band.first) - lag(last.first - 1)) / span))
                late = _nearest(d * ((lag(band.first) - lag(last.first)) / span))
                other = np.minimum(d - late, last.rows - 1)
            joint.append(band)
            lower.append(at + begins[first.first])
            upper.append(other + begins[last.first])
            shift.append(late)
        steps.append(Step(joint, *[np.concatenate(x) for x in (lower, upper, shift)]))
        bands = joint
    return steps


def transform(x: np.ndarray, steps: list[Step]) -> np.ndarray:
    """Rows by delay from channels by time; what would need unknown samples (NaN) is NaN."""
    parts = []
    for band in steps[0].bands:
        total = np.zeros(x.shape[1])
        for d in range(band.rows):
            moved = np.full(x.shape[1], np.nan)
            moved[d:] = x[band.first, : x.shape[1] - d]
            total = total + moved
            parts.append(total / (d + 1))
    state = np.stack(parts)
    for step in steps[1:]:
        new = state[step.lower]
        for r in np.flatnonzero(step.upper >= 0):
            late = int(step.shift[r])
            new[r, late:] += state[step.upper[r], : x.shape[1] - late]
            new[r, :late] = np.nan
        state = new
    return state


def fdmt(tf: TensorFrame, freq: int | str, max_delay: int, exponent: float = -2.0, negative_delays: bool = False, dm_step: float = 1.0, refdm: float = 0.0) -> TensorFrame:
    """Dedispersed sums for ``max_delay`` delays, on an axis ``dispersion`` in place of ``freq``.

    Row ``r`` at time ``t`` sums the band along the curve that passes the
    highest frequency at ``t - r`` and the lowest at ``t``; with
    ``negative_delays`` the highest at ``t + r``.  The band may ascend or
    descend.  Places that would need samples that are not there have no row.
    """
    axis, frame = tf.spec.axis(freq), tf.spec.frame
    nchan = axis.size
    start, width = (axis.start, axis.step) if axis.step > 0 else (axis.start + (nchan - 1) * axis.step, -axis.step)
    steps = plan(nchan, max_delay, start, width, exponent)
    others = [a for a in tf.spec.axes if not a.is_frame and a.label != axis.label]
    t, turned, falling = frame.label, negative_delays, axis.step < 0
    # time runs backwards for negative delays
    source = TensorFrame(tf.df.withColumn(t, -F.col(t)), tf.spec, tf.keys) if turned else tf
    size = frames_of_block([axis], max_delay)
    before = max_delay - 1
    out = Axis("dispersion", max_delay, refdm, -dm_step if turned else dm_step, "pc cm^-3")
    spec = tf.spec.with_axis(freq, out).with_dtype("f64")
    schema, same = schema_of(tf, [*tf.keys, *spec.labels], False), [*tf.keys, *[a.label for a in others]]

    def run(group: pa.Table) -> pa.Table:
        block = group.column(BLOCK)[0].as_py()
        at, c = column(group, t) - (block * size - before), column(group, axis.label)
        x = np.full((nchan, size + before), np.nan)
        x[nchan - 1 - c if falling else c, at] = samples(group)
        y = transform(x, steps)[:max_delay, before:]
        row, k = np.nonzero(~np.isnan(y))
        time = k + block * size
        keys = {name: group.column(name)[0].as_py() for name in same}
        return table(keys, {"dispersion": row, t: -time if turned else time}, y[row, k], schema)

    df = apply(with_halo(source, size, before), [*same, BLOCK], run, schema)
    return TensorFrame(df, spec, tf.keys)


def fdmt_block(tf: TensorFrame, max_dm: float | None = None, max_delay: int | None = None, max_diagonal: float | None = None, exponent: float = -2.0, negative_delays: bool = False) -> TensorFrame:
    """:func:`fdmt` of a stream ``[..., freq, time]`` as far as one of three limits says.

    ``max_dm`` in pc cm^-3, ``max_delay`` in samples, ``max_diagonal`` in
    samples for each channel.  The axis ``dispersion`` is in pc cm^-3; the
    header gets ``max_dm``, centre frequency and bandwidth.
    """
    if sum(m is not None for m in (max_dm, max_delay, max_diagonal)) != 1:
        raise ValueError("exactly one of max_dm, max_delay and max_diagonal")
    if tf.spec.labels[-2:] != ["freq", "time"]:
        raise KeyError(f"expected axes [..., 'freq', 'time'], got {tf.spec.labels}")
    axis, time = tf.spec.axes[-2:]
    f0, df = convert(axis.start, axis.unit, "MHz"), convert(axis.step, axis.unit, "MHz")
    dt = convert(time.step, time.unit, "s")
    if max_dm is not None:
        max_delay = max_delay_of(max_dm, f0, df, axis.size, dt)
    else:
        max_delay = math.ceil(axis.size * max_diagonal) if max_diagonal is not None else max_delay
        max_dm = max_delay * dt / (KDM * abs(f0**-2 - (f0 + axis.size * df) ** -2))
    header = tf.spec.header
    refdm = convert(header["refdm"], header["refdm_units"], "pc cm^-3") if "refdm" in header else 0.0
    scaled = TensorFrame(tf.df, tf.spec.with_axis("freq", replace(axis, start=f0, step=df, unit="MHz")), tf.keys)
    out = fdmt(scaled, "freq", max_delay, exponent, negative_delays, max_dm / max_delay, refdm)
    more = {"max_dm": -max_dm if negative_delays else max_dm, "max_dm_units": "pc cm^-3", "cfreq": axis.start + 0.5 * (axis.size - 1) * axis.step, "cfreq_units": axis.unit, "bw": axis.size * axis.step, "bw_units": axis.unit}
    return TensorFrame(out.df, out.spec.with_header(**more), out.keys)


def channel_delays(axis: Axis, dm: float, dt: float) -> list[int]:
    """Samples by which each channel lags behind the highest frequency."""
    freqs = [axis.start + k * axis.step for k in range(axis.size)]
    top = max(freqs)
    return [round(KDM * dm * (f**-2 - top**-2) / dt) for f in freqs]


def dedisperse(tf: TensorFrame, freq: int | str, dm: float) -> TensorFrame:
    """Channels shifted back by their delay and summed; incomplete sums are dropped."""
    axis, frame = tf.spec.axis(freq), tf.spec.frame
    delays = F.array(*[F.lit(d).cast("bigint") for d in channel_delays(axis, dm, frame.step)])
    at = F.col(frame.label) - F.get(delays, F.col(axis.label).cast("int"))
    rows = tf.df.withColumn(frame.label, at).groupBy(*tf.over(freq)).agg(F.sum("value").alias("value"), F.count("*").alias("__n"))
    return TensorFrame(rows.where(F.col("__n") == axis.size), tf.spec.with_axis(freq).with_dtype("f64"), tf.keys)
