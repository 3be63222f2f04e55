"""The user's own array functions, arrays as sources, tables as pictures."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import Axis, TensorSpec


def from_array(spark: SparkSession, x: np.ndarray, spec: TensorSpec) -> TensorFrame:
    """A stream of a small array that the driver holds."""
    if x.ndim != len(spec.axes):
        raise ValueError(f"an array of {x.ndim} axes for {spec.labels}")
    columns = dict(zip(spec.labels, np.indices(x.shape).reshape(x.ndim, -1), strict=True))
    flat = x.ravel()
    columns |= {"re": flat.real, "im": flat.imag} if spec.dtype.is_complex else {"value": flat}
    return TensorFrame(spark.createDataFrame(pd.DataFrame(columns)), spec)


def apply_arrays(tf: TensorFrame, gulp: int, function: Callable[[np.ndarray], np.ndarray], spec: TensorSpec) -> TensorFrame:
    """``function`` of each gulp's array, frames first, as a stream of ``spec``.

    A gulp is a group of its own, of ``gulp`` frames, so memory is bounded and
    gulps run everywhere; ``function`` must give as many frames as it gets.
    The last gulp may be short; places without a row are 0.
    """
    frame = tf.spec.frame.label
    others = [a for a in tf.spec.axes if not a.is_frame]
    inner = [a.label for a in others]
    outer = [a for a in spec.axes if not a.is_frame]
    names, tags, pairs = TensorFrame.values_of(spec), tf.keys, tf.spec.dtype.is_complex  # what goes to the tasks

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * gulp
        n = int(rows[frame].max()) - first + 1
        x = np.zeros((n, *[a.size for a in others]), complex if pairs else float)
        at = (rows[frame].to_numpy() - first, *[rows[c].to_numpy() for c in inner])
        x[at] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy() if pairs else rows["value"].to_numpy()
        y = function(x)
        if y.shape != (n, *[a.size for a in outer]):
            raise ValueError(f"the function gave {y.shape}")
        places = np.indices(y.shape).reshape(y.ndim, -1)
        out = {k: [v] * y.size for k, v in zip(tags, key, strict=False)}
        out |= {frame: places[0] + first} | {a.label: p for a, p in zip(outer, places[1:], strict=True)}
        flat = y.ravel()
        return pd.DataFrame(out | ({"re": flat.real, "im": flat.imag} if len(names) == 2 else {"value": flat.real}))

    keys = ", ".join(f"`{k}` {tf.df.schema[k].dataType.simpleString()}" for k in tf.keys)
    schema = ", ".join([*([keys] if keys else []), f"`{frame}` long", *[f"`{a.label}` long" for a in outer], *[f"{c} double" for c in names]])
    grouped = tf.df.withColumn("__gulp", F.expr(f"`{frame}` div {gulp}")).groupBy(*tf.keys, "__gulp")
    return TensorFrame(grouped.applyInPandas(run, schema), spec, tf.keys)


def apply_many(frames: list[TensorFrame], gulp: int, function: Callable[[list[np.ndarray]], list[np.ndarray]], specs: list[TensorSpec]) -> list[TensorFrame]:
    """``function`` of the arrays of a gulp of several streams, as streams of ``specs``.

    The streams have the same keys and the same stream axis, which comes first
    in the arrays; a gulp has as many frames as the longest of them there, and
    so must the results.  Places without a row are 0.
    """
    first = frames[0]
    frame, keys = first.spec.frame.label, first.keys
    if any(tf.spec.frame.label != frame or tf.keys != keys for tf in frames) or any(s.frame.label != frame for s in specs):
        raise ValueError("streams of different keys or stream axes")
    ins = [([a for a in tf.spec.axes if not a.is_frame], tf.spec.dtype.is_complex) for tf in frames]
    outs = [([a for a in s.axes if not a.is_frame], s.dtype.is_complex) for s in specs]
    rows = None
    for k, (tf, (axes, _)) in enumerate(zip(frames, ins, strict=True)):
        place = F.lit(0).cast("bigint")
        for a in axes:
            place = place * a.size + F.col(a.label)
        x = tf.pair
        new = tf.df.select(*keys, F.col(frame).alias("__t"), F.lit(k).alias("__n"), place.alias("__place"), x.re.cast("double").alias("re"), x.imag.cast("double").alias("im"))
        rows = new if rows is None else rows.unionByName(new)
    names = ", ".join([*[f"`{k}` {first.df.schema[k].dataType.simpleString()}" for k in keys], "__t bigint, __n int, __place bigint, re double, im double"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        begin = int(key[-1]) * gulp
        n = int(group["__t"].max()) - begin + 1
        arrays = []
        for k, (axes, complex_) in enumerate(ins):
            own = group[group["__n"] == k]
            flat = np.zeros((n, int(np.prod([a.size for a in axes], dtype=np.int64))), complex if complex_ else float)
            flat[own["__t"].to_numpy() - begin, own["__place"].to_numpy()] = own["re"].to_numpy() + 1j * own["im"].to_numpy() if complex_ else own["re"].to_numpy()
            arrays.append(flat.reshape(n, *[a.size for a in axes]))
        made = []
        for k, (y, (axes, _)) in enumerate(zip(function(arrays), outs, strict=True)):
            if y.shape != (n, *[a.size for a in axes]):
                raise ValueError(f"the function gave {y.shape}")
            flat = y.reshape(n, -1)
            t, at = np.indices(flat.shape).reshape(2, -1)
            made.append(pd.DataFrame({**{c: [v] * t.size for c, v in zip(keys, key, strict=False)}, "__t": t + begin, "__n": np.int32(k), "__place": at, "re": flat.ravel().real, "im": flat.ravel().imag}))
        return pd.concat(made)

    done = rows.withColumn("__gulp", F.expr(f"__t div {gulp}")).groupBy(*keys, "__gulp").applyInPandas(run, names)
    out = []
    for k, (spec, (axes, complex_)) in enumerate(zip(specs, outs, strict=True)):
        columns, left = {frame: F.col("__t")}, F.col("__place")
        for a in reversed(axes):
            columns[a.label], left = left % a.size, F.call_function("div", left, F.lit(a.size))
        values = [F.col("re"), F.col("im")] if complex_ else [F.col("re").alias("value")]
        out.append(TensorFrame(done.where(F.col("__n") == k).select(*keys, *[c.alias(x) for x, c in columns.items()], *values), spec, keys))
    return out


def waterfall(tf: TensorFrame, across: int | str) -> DataFrame:
    """A row for each frame and a column for each place of one axis."""
    axis = tf.spec.axis(across)
    return tf.df.groupBy(*tf.over(across)).pivot(axis.label, list(range(axis.size))).agg(F.first("value"))


def spliced(*parts: TensorFrame) -> TensorFrame:
    """Streams one after another, as sequences ``seq`` 0, 1, ..."""
    first = parts[0]
    if any(p.spec.labels != first.spec.labels or p.spec.dtype != first.spec.dtype for p in parts):
        raise ValueError("streams of different axes or types")
    rows = None
    for k, p in enumerate(parts):
        new = p.df.select(F.lit(k).cast("bigint").alias("seq"), *p.spec.labels, *p.values)
        rows = new if rows is None else rows.unionByName(new)
    return TensorFrame(rows, first.spec.with_axis(0, Axis(**first.spec.axes[0].__dict__)), ("seq",))
