"""Dense blocks of a stream: groups of rows that become numpy arrays in a task.

Sums over products of places (correlation, products, filters, the dispersion
transform) would make many rows for each sample.  Here the samples of a block,
a stretch of frames with all that must meet in it, are shuffled once; a task
makes an array of them and gives the block's results.  A block has about
``ROWS`` samples whatever the length of the stream, and the key has its number,
so a stream is many groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import Axis

#: Samples of a block, about.
ROWS = 500_000
BLOCK = "__block"


def frames_of_block(other: Iterable[Axis], least: int = 1, rows: int | None = None) -> int:
    """So many frames that a block has about ``rows`` samples, at least ``least``."""
    size = 1
    for a in other:
        size *= max(a.size, 1)
    return max(least, (rows or ROWS) // max(size, 1), 1)


def column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


def places(group: pa.Table, axes: list[Axis]) -> tuple[np.ndarray, ...]:
    return tuple(column(group, a.label).astype(np.int64) for a in axes)


def samples(group: pa.Table) -> np.ndarray:
    """The elements: ``re`` and ``im`` as complex numbers, or ``value``."""
    if "re" in group.column_names:
        return column(group, "re").astype(np.float64) + 1j * column(group, "im").astype(np.float64)
    return column(group, "value").astype(np.float64)


def table(keys: dict[str, object], places: dict[str, np.ndarray], values: np.ndarray, schema: str) -> pa.Table:
    """Rows of one block: constant keys, places and elements, in the order of ``schema``."""
    n = len(values)
    cols = {k: pa.array([v], type=None).take(pa.array(np.zeros(n, np.int64))) for k, v in keys.items()}
    cols |= {k: pa.array(v) for k, v in places.items()}
    cols |= {"re": pa.array(values.real.copy()), "im": pa.array(values.imag.copy())} if np.iscomplexobj(values) else {"value": pa.array(values)}
    return pa.table({c.split()[0].strip("`"): cols[c.split()[0].strip("`")] for c in schema.split(", ")})


def apply(df: DataFrame, by: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy(*by).applyInArrow(f, schema)


def schema_of(tf: TensorFrame, index: list[str], complex_: bool) -> str:
    """Spark's schema of the result: index columns as they are, or ``bigint``, and the elements."""
    types = {f.name: f.dataType.simpleString() for f in tf.df.schema.fields}
    cols = [f"`{c}` {types[c] if c in tf.keys else 'bigint'}" for c in index]
    return ", ".join(cols + (["re double", "im double"] if complex_ else ["value double"]))


def with_halo(tf: TensorFrame, size: int, before: int) -> DataFrame:
    """Rows with the number of their block of ``size`` frames; the last ``before`` of a block are in the next as well.

    ``before`` is at most ``size``, so no row is in more than two.
    """
    t = F.col(tf.spec.frame.label)
    own = F.floor(t / size).cast("bigint")
    both = F.when(F.pmod(t, F.lit(size)) >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    return tf.df.withColumn(BLOCK, F.explode(both))


def in_blocks(tf: TensorFrame, size: int) -> DataFrame:
    return tf.df.withColumn(BLOCK, F.floor(F.col(tf.spec.frame.label) / size).cast("bigint"))
