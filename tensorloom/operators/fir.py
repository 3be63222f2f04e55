"""FIR filters along the stream.

``y[t] = sum_c x[t - n + c + 1] h[c]``: taps apply in stored order, and what
came before the first frame is zero.  Each block of frames is filtered with
the ``n - 1`` frames before it, all lanes together; sequences are apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa

from ..frame import TensorFrame
from .blocks import BLOCK, apply, column, frames_of_block, places, samples, schema_of, table, with_halo


def fir(tf: TensorFrame, taps: Sequence, decim: int = 1) -> TensorFrame:
    """Filter all lanes with ``taps`` and keep each ``decim``-th output.

    ``taps`` is one list for all lanes, or an array with the taps first and
    then the sizes of the lanes' axes: each lane has its own.  Outputs stand
    where a lane has a sample; samples it lacks count as zero.
    """
    frame = tf.spec.frame
    lanes = [a for a in tf.spec.axes if not a.is_frame]
    shape = tuple(a.size for a in lanes)
    h = np.asarray(taps, np.float64)
    if h.ndim > 1 and h.shape[1:] != shape:
        raise ValueError(f"taps of shape {h.shape} for lanes of shape {shape}")
    h = np.broadcast_to(h.reshape(len(h), -1) if h.ndim > 1 else h[:, None], (len(h), int(np.prod(shape, dtype=np.int64))))
    n = len(h)
    size = frames_of_block(lanes, n)
    schema, keys = schema_of(tf, tf.index, tf.spec.dtype.is_complex), tf.keys

    def run(group: pa.Table) -> pa.Table:
        t, x = column(group, frame.label), samples(group)
        block = group.column(BLOCK)[0].as_py()
        lane = np.ravel_multi_index(places(group, lanes), shape) if lanes else np.zeros(len(t), np.int64)
        held = np.zeros((size + n - 1, h.shape[1]), x.dtype)
        at = t - (block * size - (n - 1))
        held[at, lane] = x
        out = np.zeros((size, h.shape[1]), x.dtype)
        for c in range(n):
            out += held[c : c + size] * h[c]
        own = (at >= n - 1) & (t % decim == 0)
        same = {k: group.column(k)[0].as_py() for k in keys}
        where = {a.label: column(group, a.label)[own] for a in lanes}
        return table(same, {frame.label: t[own] // decim, **where}, out[at[own] - (n - 1), lane[own]], schema)

    df = apply(with_halo(tf, size, n - 1), [*tf.keys, BLOCK], run, schema)
    dtype = "cf64" if tf.spec.dtype.is_complex else "f64"
    return TensorFrame(df, tf.spec.with_axis(frame.label, replace(frame, step=frame.step * decim)).with_dtype(dtype), tf.keys)
