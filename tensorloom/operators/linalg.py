"""Matrix products, beams and gridding.

The operands of a product meet in blocks (a stretch of the summed axis, or of
the stream) and are multiplied as arrays there; partial products are summed by
Spark.  Only where both operands have places of an open number does each pair
of elements become a row.  Keys tell sequences apart: they are batch axes.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.complex import Pair
from ..spec import Axis
from .blocks import BLOCK, apply, column, frames_of_block, places, samples, table

#: Places of a kernel that all points share, at most.
SUPPORT = 4096
#: Elements of a matrix that goes to every task, at most.
SMALL = 4_000_000


def _side(tf: TensorFrame, tag: str, names: dict[str, str]) -> DataFrame:
    x = tf.pair
    cols = [F.col(c).alias(names.get(c, c)) for c in tf.index]
    return tf.df.select(*cols, x.re.cast("double").alias(f"{tag}r"), x.imag.cast("double").alias(f"{tag}i"))


def _finished(df: DataFrame, spec, index: list[str], keys: tuple[str, ...], kind: str, beta: float, c: TensorFrame | None) -> TensorFrame:
    """Adds ``beta c`` and gives the elements their columns."""
    if c is not None and beta:
        old = _side(c, "c", {})
        df = df.join(old, index, "full").select(*index, *[(F.coalesce(n, F.lit(0.0)) + beta * F.coalesce(f"c{n[0]}", F.lit(0.0))).alias(n) for n in ("re", "im")])
        kind = "cf64" if c.spec.dtype.is_complex else kind
    if kind == "f64":
        df = df.withColumnRenamed("re", "value")
    return TensorFrame(df, spec.with_dtype(kind), keys)


def matmul(a: TensorFrame, b: TensorFrame, inner: str, alpha: float = 1.0, beta: float = 0.0, c: TensorFrame | None = None) -> TensorFrame:
    """``alpha a b + beta c``, summed over the shared axis ``inner``.

    Other axes that both have, and shared keys, are batch axes; the rest are
    the result's.  The sides meet on batch and inner places, and Spark picks
    the join.
    """
    shared = [x for x in a.spec.labels if x in b.spec.labels]
    if inner not in shared or a.spec.axis(inner).size != b.spec.axis(inner).size:
        raise ValueError(f"{inner!r} is not an axis of one size of both")
    keys = (*a.keys, *[k for k in b.keys if k not in a.keys])
    out = [x for x in a.spec.axes if x.label != inner] + [x for x in b.spec.axes if x.label not in shared]
    index = [*keys, *[x.label for x in out]]
    both = _side(a, "a", {}).join(_side(b, "b", {}), [*[k for k in a.keys if k in b.keys], *shared])
    re, im = F.expr("ar * br - ai * bi"), F.expr("ar * bi + ai * br")
    df = both.groupBy(*index).agg((alpha * F.sum(re)).alias("re"), (alpha * F.sum(im)).alias("im"))
    kind = "cf64" if a.spec.dtype.is_complex or b.spec.dtype.is_complex else "f64"
    return _finished(df, replace(a.spec, axes=tuple(out)), index, keys, kind, beta, c)


def _gram(a: TensorFrame, row: str, inner: str, conjugate_first: bool, alpha: float, beta: float, c: TensorFrame | None) -> TensorFrame:
    """Sums over ``inner`` of products of all pairs of rows, one of them conjugated: the lower triangle."""
    i, j, axis, summed = f"{row}_i", f"{row}_j", a.spec.axis(row), a.spec.axis(inner)
    if axis.is_frame:
        raise ValueError(f"the rows {row!r} are a stream; only fixed axes have a triangle")
    batch = [x for x in a.spec.axes if x.label not in (row, inner)]
    held = [*a.keys, *[x.label for x in batch]]
    size = frames_of_block([axis]) if summed.is_frame else max(summed.size, 1)
    types = {f.name: f.dataType.simpleString() for f in a.df.schema.fields}
    schema = ", ".join([f"`{x}` {types[x] if x in a.keys else 'bigint'}" for x in held] + [f"`{i}` bigint", f"`{j}` bigint", "re double", "im double"])

    def run(group: pa.Table) -> pa.Table:
        k, r = column(group, inner), column(group, row)
        k = k - k.min()
        x = np.zeros((axis.size, int(k.max()) + 1), np.complex128)
        x[r, k] = samples(group)
        full = x.conj() @ x.T if conjugate_first else x @ x.conj().T
        seen = np.zeros(axis.size, bool)
        seen[r] = True
        p, q = np.tril_indices(axis.size)
        own = seen[p] & seen[q]
        p, q = p[own], q[own]
        return table({x: group.column(x)[0].as_py() for x in held}, {i: p, j: q}, full[p, q], schema)

    rows = a.df.withColumn(BLOCK, F.floor(F.col(inner) / size).cast("bigint"))
    part = apply(rows, [*held, BLOCK], run, schema)
    df = part.groupBy(*held, i, j).agg((alpha * F.sum("re")).alias("re"), (alpha * F.sum("im")).alias("im"))
    spec = a.spec.with_axis(row, replace(axis, label=i), replace(axis, label=j, size=axis.size)).with_axis(inner)
    kind = "cf64" if a.spec.dtype.is_complex else "f64"
    return _finished(df, spec, [*held, i, j], a.keys, kind, beta, c)


def matmul_aah(a: TensorFrame, row: str, inner: str, alpha: float = 1.0, beta: float = 0.0, c: TensorFrame | None = None) -> TensorFrame:
    """``alpha a a^H + beta c``: the lower triangle, on the axes ``row_i`` and ``row_j``."""
    return _gram(a, row, inner, False, alpha, beta, c)


def matmul_bhb(b: TensorFrame, row: str, inner: str, alpha: float = 1.0, beta: float = 0.0, c: TensorFrame | None = None) -> TensorFrame:
    """``alpha b^H b + beta c``: of the columns ``row``, the lower triangle."""
    return _gram(b, row, inner, True, alpha, beta, c)


def beamform(weights: TensorFrame, voltages: TensorFrame, station: str = "station") -> TensorFrame:
    """Beams: weights ``[beam, station]`` times voltages ``[station, time, ...]``.

    Weights of at most ``SMALL`` elements, by their axes, go to every task as
    an array; the voltages meet by blocks of frames, a beam for each place.
    """
    beams = [x for x in weights.spec.axes if x.label != station and not x.is_frame]
    out = [*[x for x in voltages.spec.axes if x.label != station], *beams]
    index = [*voltages.keys, *[x.label for x in out]]
    spec = replace(voltages.spec.with_dtype("cf64"), axes=tuple(out))
    axis, frame = voltages.spec.axis(station), voltages.spec.frame
    w = _side(weights, "a", {}).drop(*[x.label for x in weights.spec.axes if x.is_frame and x.label != station])
    nbeam = int(np.prod([b.size for b in beams], dtype=np.int64))
    if axis.is_frame or nbeam * axis.size > SMALL:
        both = _side(voltages, "b", {}).join(w, station)
        df = both.groupBy(*index).agg(F.sum(F.expr("ar * br - ai * bi")).alias("re"), F.sum(F.expr("ar * bi + ai * br")).alias("im"))
        return TensorFrame(df, spec, voltages.keys)
    matrix = np.zeros((nbeam, axis.size), np.complex128)
    for r in w.collect():  # at most SMALL elements
        at = np.ravel_multi_index([r[b.label] for b in beams], [b.size for b in beams]) if beams else 0
        matrix[at, r[station]] += complex(r["ar"], r["ai"])
    lanes = [x for x in voltages.spec.axes if x.label not in (station, frame.label)]
    shape, same = tuple(x.size for x in lanes), voltages.keys
    size = frames_of_block([axis, *lanes, Axis("beam", nbeam)])
    types = {f.name: f.dataType.simpleString() for f in voltages.df.schema.fields}
    schema = ", ".join([f"`{x}` {types[x] if x in voltages.keys else 'bigint'}" for x in index] + ["re double", "im double"])

    def run(group: pa.Table) -> pa.Table:
        block = group.column(BLOCK)[0].as_py()
        t = column(group, frame.label) - block * size
        lane = np.ravel_multi_index(places(group, lanes), shape) if lanes else np.zeros(len(t), np.int64)
        st = column(group, station)
        x = np.zeros((size, int(np.prod(shape, dtype=np.int64)), axis.size), np.complex128)
        x[t, lane, st] = samples(group)
        seen = np.zeros(x.shape[:2], bool)
        seen[t, lane] = True
        y = x @ matrix.T
        a, b = np.nonzero(seen)
        n = matrix.shape[0]
        where = {x.label: v for x, v in zip(lanes, np.unravel_index(np.repeat(b, n), shape), strict=True)} if lanes else {}
        where |= {x.label: v for x, v in zip(beams, np.unravel_index(np.tile(np.arange(n), len(a)), [x.size for x in beams]), strict=True)} if beams else {}
        keys = {k: group.column(k)[0].as_py() for k in same}
        return table(keys, {frame.label: np.repeat(a, n) + block * size, **where}, y[a, b].ravel(), schema)

    rows = voltages.df.withColumn(BLOCK, F.floor(F.col(frame.label) / size).cast("bigint"))
    return TensorFrame(apply(rows, [*voltages.keys, BLOCK], run, schema), spec, voltages.keys)


def grid(points: DataFrame, kernels: DataFrame, ngrid: int, keys: list[str] | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Convolutional gridding: each point adds ``conj(kernel) value`` to its support.

    ``points`` has ``x``, ``y``, ``re``, ``im`` and the ``keys``; ``kernels``
    ``u``, ``v``, ``re``, ``im`` and those of the keys it depends on.  What
    falls off the grid is dropped; ``onto`` (``x``, ``y``, ``re``, ``im``,
    keys) is added to.
    """
    keys = keys or []
    shared = [k for k in keys if k in kernels.columns]
    k = kernels.select(*shared, "u", "v", F.col("re").alias("kr"), F.col("im").alias("ki"))
    if shared:
        rows = points.join(k, shared)
    else:  # one kernel for all points: its places are an array of each point, if they are few
        support = k.collect() if k.limit(SUPPORT + 1).count() <= SUPPORT else None
        if support is None:
            raise ValueError(f"a kernel of more than {SUPPORT} places")
        cells = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("u", "v", "kr", "ki")]) for r in support])
        rows = points.withColumn("__k", F.explode(cells)).select("*", "__k.*")
    value = Pair(F.col("kr"), F.col("ki")).conj() * Pair(F.col("re"), F.col("im"))
    rows = rows.select(*keys, (F.col("x") + F.col("u")).alias("x"), (F.col("y") + F.col("v")).alias("y"), value.re.alias("re"), value.im.alias("im"))
    rows = rows.where(F.col("x").between(0, ngrid - 1) & F.col("y").between(0, ngrid - 1))
    if onto is not None:
        rows = rows.unionByName(onto.select(rows.columns))
    return rows.groupBy(*keys, "y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
