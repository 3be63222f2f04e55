"""One query for each operator on the star-schema tables, with the SQL that says the same.

Tensors made of the tables: ``E`` embeddings as (time, k) quantised to
integers, ``V`` the same as voltages (time, freq, station, pol), ``X`` events
as (frame, lane).  Integers keep sums exact whatever their order; values that
are not are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import TensorFrame
from .functions import jones
from .functions.jones import Jones
from .operators import codec, custom, dispersion, elementwise, fir, fourier, linalg, reduce, shape, views
from .sources import files, packets
from .sources.headers import make_dada
from .spec import Axis, TensorSpec
from .plans.pipeline import Chain
from .streaming import gulps, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

E_SQL = "E AS (SELECT vec_id AS time, k, CAST(round_even(CAST(v AS DOUBLE) * 127, 0) AS BIGINT) AS q FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings))"
V_SQL = E_SQL + ", V AS (SELECT time, k // 16 AS freq, (k // 4) % 4 AS station, (k // 2) % 2 AS pol, max(q) FILTER (k % 2 = 0) AS re, max(q) FILTER (k % 2 = 1) AS im FROM E GROUP BY ALL)"
X_SQL = "X AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, CAST(round_even(value * 100, 0) AS BIGINT) AS q FROM events)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tensor_e(spark: SparkSession, sf_dir: str) -> TensorFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time"), F.posexplode("embedding").alias("k", "v"))
    df = rows.select("time", F.col("k").cast("bigint"), F.rint(F.col("v").cast("double") * 127).cast("bigint").alias("value"))
    return TensorFrame(df, TensorSpec.of("i8", Axis("time", -1, 0.0, 0.001, "s"), Axis("k", 64, 1000.0, 1.0, "MHz")))


def tensor_v(spark: SparkSession, sf_dir: str) -> TensorFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time"), "embedding")
    q = lambda i: F.rint(F.get("embedding", i).cast("double") * 127).cast("bigint")
    c = e.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(31))))
    df = c.select("time", F.expr("cast(c div 8 as bigint)").alias("freq"), F.expr("cast((c div 2) % 4 as bigint)").alias("station"), (F.col("c") % 2).cast("bigint").alias("pol"), q(2 * F.col("c")).alias("re"), q(2 * F.col("c") + 1).alias("im"))
    return TensorFrame(df, TensorSpec.of("ci8", Axis("time", -1), Axis("freq", 4), Axis("station", 4), Axis("pol", 2)))


def tensor_x(spark: SparkSession, sf_dir: str) -> TensorFrame:
    df = read(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("frame"), (F.col("event_id") % 8).alias("lane"), F.rint(F.col("value") * 100).cast("bigint").alias("value"))
    return TensorFrame(df, TensorSpec.of("i64", Axis("frame", -1), Axis("lane", 8)))


def rounded(tf: TensorFrame, digits: int = 7) -> DataFrame:
    return tf.df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in tf.values})


def as_double(tf: TensorFrame) -> DataFrame:
    return tf.df.withColumns({c: F.col(c).cast("double") for c in tf.values})


# ---- reductions

_HOW = {"sum": "sum({x})", "mean": "avg({x})", "min": "min({x})", "max": "max({x})", "stderr": "sum({x}) / sqrt(count(*))"}
for _op, _sql in _HOW.items():
    for _pwr, _x in (("", "q"), ("pwr", "q * q")):
        _value = f"round(CAST({_sql.format(x=_x)} AS DOUBLE), 6) + 0.0"
        query(f"reduce_{_pwr}{_op}", f"WITH {E_SQL} SELECT time, k // 4 AS k, {_value} AS value FROM E GROUP BY ALL")(
            lambda s, d, op=_pwr + _op: rounded(reduce.reduce(tensor_e(s, d), "k", 4, op), 6)
        )


@query("reduce_frames", f"WITH {X_SQL} SELECT frame // 5 AS frame, lane, CAST(sum(q) AS DOUBLE) AS value FROM X GROUP BY ALL")
def _(s, d):
    return reduce.reduce(tensor_x(s, d), "frame", 5).df


@query("reduce_complex_sum", f"WITH {V_SQL} SELECT time, freq, 0::BIGINT AS station, pol, CAST(sum(re) AS DOUBLE) AS re, CAST(sum(im) AS DOUBLE) AS im FROM V GROUP BY ALL")
def _(s, d):
    return reduce.reduce(tensor_v(s, d), "station").df


@query("reduce_complex_pwrsum", f"WITH {V_SQL} SELECT time, freq, station // 2 AS station, pol, CAST(sum(re * re + im * im) AS DOUBLE) AS value FROM V GROUP BY ALL")
def _(s, d):
    return reduce.reduce(tensor_v(s, d), "station", 2, "pwrsum").df


@query("accumulate", f"WITH {X_SQL} SELECT frame // 10 AS frame, lane, CAST(sum(q) AS BIGINT) AS value FROM X GROUP BY ALL HAVING count(*) = 10")
def _(s, d):
    return reduce.accumulate(tensor_x(s, d), 10).df


@query("scrunch", f"WITH {X_SQL} SELECT frame // 10 AS frame, lane, round(avg(q), 6) AS value FROM X GROUP BY ALL HAVING count(*) = 10")
def _(s, d):
    return rounded(reduce.scrunch(tensor_x(s, d), 10), 6)


@query("prefix_scan", f"WITH {E_SQL} SELECT time, k, CAST(sum(q) OVER (PARTITION BY time ORDER BY k) AS BIGINT) AS value FROM E")
def _(s, d):
    return reduce.prefix_scan(tensor_e(s, d), "k").df


@query("fold", f"WITH {X_SQL} SELECT 0::BIGINT AS frame, CAST(least(floor(fmod(CAST(frame AS DOUBLE), 7.3) / 7.3 * 10), 9) AS BIGINT) AS phase, lane, round(avg(q), 6) AS value FROM X GROUP BY ALL")
def _(s, d):
    return rounded(reduce.fold(tensor_x(s, d), 10, 7.3), 6)


@query("kurtosis_mask", f"""WITH {E_SQL}, P AS (SELECT time, k, q * q AS p, time // 50 AS g FROM E),
    B AS (SELECT k, g, abs(0.5 - m / (m - 1) * (m * s2 / (s1 * s1) - 1)) > 2.0 AS bad FROM (SELECT k, g, CAST(count(*) AS DOUBLE) AS m, CAST(sum(p) AS DOUBLE) AS s1, CAST(sum(p * p) AS DOUBLE) AS s2 FROM P GROUP BY ALL))
    SELECT time, k, CAST(CASE WHEN bad THEN 0 ELSE p END AS DOUBLE) AS value FROM P JOIN B USING (k, g)""")
def _(s, d):
    e = tensor_e(s, d)
    return as_double(reduce.kurtosis_mask(e.with_values(e.pair.mag2(), "i32"), 50, 2.0))


# ---- views and shapes

@query("view_split", f"WITH {E_SQL} SELECT time, k // 16 AS k, k % 16 AS fine, q AS value FROM E")
def _(s, d):
    return views.split_axis(tensor_e(s, d), "k", 16, "fine").df


@query("view_split_frames", f"WITH {X_SQL} SELECT frame // 4 AS frame, frame % 4 AS frame_split, lane, q AS value FROM X")
def _(s, d):
    return views.split_axis(tensor_x(s, d), "frame", 4).df


@query("view_merge", f"WITH {E_SQL} SELECT time, k, q AS value FROM E")
def _(s, d):
    return views.merge_axes(views.split_axis(tensor_e(s, d), "k", 8), "k", "k_split", "k").df


@query("view_rename", f"WITH {E_SQL} SELECT time, k AS channel, q AS value FROM E")
def _(s, d):
    return views.rename_axis(tensor_e(s, d), "k", "channel").df


@query("view_reinterpret", f"WITH {E_SQL} SELECT time, k AS lag, q AS value FROM E")
def _(s, d):
    return views.reinterpret_axis(tensor_e(s, d), "k", "lag", 0.0, 2.0, "us").df


@query("view_add_axis", f"WITH {E_SQL} SELECT time, 0::BIGINT AS beam, k, q AS value FROM E")
def _(s, d):
    return views.add_axis(tensor_e(s, d), "time", "beam").df


@query("view_delete_axis", f"WITH {E_SQL} SELECT time, k, q AS value FROM E")
def _(s, d):
    return views.delete_axis(views.add_axis(tensor_e(s, d), -1, "beam"), "beam").df


@query("view_astype", "SELECT event_id AS frame, b AS k, CAST((event_id * 2654435 % 2147483648 // CAST(power(256, b) AS BIGINT)) % 256 AS BIGINT) AS value FROM (SELECT event_id, unnest(range(0, 4)) AS b FROM (SELECT event_id FROM events))")
def _(s, d):
    df = read(s, d, "events").select(F.col("event_id").alias("frame"), F.lit(0).cast("bigint").alias("k"), (F.col("event_id") * 2654435 % 2147483648).alias("value"))
    return views.astype(TensorFrame(df, TensorSpec.of("i32", Axis("frame", -1), Axis("k", 1))), "u8").df


@query("transpose", f"WITH {E_SQL} SELECT k, time, q AS value FROM E")
def _(s, d):
    return shape.transpose(tensor_e(s, d), ["k", "time"]).df


@query("reverse", f"WITH {E_SQL} SELECT time, (64 - k) % 64 AS k, q AS value FROM E")
def _(s, d):
    return shape.reverse(tensor_e(s, d), ["k"]).df


@query("fftshift", f"WITH {E_SQL} SELECT time, (k + 32) % 64 AS k, q AS value FROM E")
def _(s, d):
    return shape.fftshift(tensor_e(s, d), ["k"]).df


@query("ifftshift", f"WITH {V_SQL} SELECT time, (freq + 2) % 4 AS freq, station, pol, re, im FROM V")
def _(s, d):
    return shape.fftshift(tensor_v(s, d), ["freq"], inverse=True).df


@query("slice_axis", f"WITH {E_SQL} SELECT time, (k - 10) // 3 AS k, q AS value FROM E WHERE k >= 10 AND k < 40 AND (k - 10) % 3 = 0")
def _(s, d):
    return shape.slice_axis(tensor_e(s, d), "k", 10, 40, 3).df


@query("split_streams", f"WITH {E_SQL} SELECT time, k - 4 AS k, q AS value FROM E WHERE k BETWEEN 4 AND 7")
def _(s, d):
    return shape.split(tensor_e(s, d), "k", [0, 1, 2, 3], [4, 5, 6, 7])[1].df


@query("filled", "SELECT t AS time, k, CAST(2.5 AS DOUBLE) AS value FROM range(0, 20) a(t), range(0, 3) b(k)")
def _(s, d):
    return shape.filled(s, TensorSpec.of("f64", Axis("time", -1), Axis("k", 3)), 20, 2.5).df


@query("conjugate", f"WITH {V_SQL} SELECT time, freq, station, pol, re, -im AS im FROM V")
def _(s, d):
    return shape.conj(tensor_v(s, d)).df


@query("cast_real", f"WITH {V_SQL} SELECT time, freq, station, pol, CAST(re AS DOUBLE) AS value FROM V")
def _(s, d):
    return shape.cast(tensor_v(s, d), "f64").df


# ---- element-wise

@query("quantize_i8", "SELECT vec_id AS time, k, CAST(round_even(greatest(least(CAST(v AS DOUBLE) * 500, 127), -127), 0) AS BIGINT) AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings)")
def _(s, d):
    return _whole(codec.quantize(_raw(s, d), "i8", 500.0))


@query("quantize_u8", "SELECT vec_id AS time, k, CAST(round_even(greatest(least(CAST(v AS DOUBLE) * 500, 255), 0), 0) AS BIGINT) AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings)")
def _(s, d):
    return _whole(codec.quantize(_raw(s, d), "u8", 500.0))


@query("quantize_i4_packed", """WITH Q AS (SELECT vec_id AS time, k, CAST(round_even(greatest(least(CAST(v AS DOUBLE) * 20, 7), -7), 0) AS BIGINT) AS q FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings))
    SELECT time, k // 2 AS k, CAST(sum(((q + 16) % 16) * CASE WHEN k % 2 = 0 THEN 16 ELSE 1 END) AS BIGINT) AS value FROM Q GROUP BY ALL""")
def _(s, d):
    return _whole(codec.pack(codec.quantize(_raw(s, d), "i4", 20.0)))


def _raw(s: SparkSession, d: str) -> TensorFrame:
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("time"), F.posexplode("embedding").alias("k", "v"))
    return TensorFrame(rows.select("time", F.col("k").cast("bigint"), F.col("v").cast("double").alias("value")), TensorSpec.of("f32", Axis("time", -1), Axis("k", 64)))


def _whole(tf: TensorFrame) -> DataFrame:
    return tf.df.withColumns({c: F.col(c).cast("bigint") for c in tf.values})


def _bytes(s: SparkSession, d: str) -> TensorFrame:
    df = read(s, d, "events").select(F.expr("event_id div 4").alias("frame"), (F.col("event_id") % 4).alias("k"), (F.col("event_id") * 37 % 256).alias("value"))
    return TensorFrame(df, TensorSpec.of("u8", Axis("frame", -1), Axis("k", 4)))


def _unpack_sql(bits: int, signed: bool, msb: bool) -> str:
    n, top = 8 // bits, 2**bits
    place = f"{n - 1} - i" if msb else "i"
    word = f"((b // CAST(power({top}, {place}) AS BIGINT)) % {top})"
    value = f"CASE WHEN {word} >= {top // 2} THEN {word} - {top} ELSE {word} END" if signed else word
    return f"SELECT frame, k * {n} + i AS k, CAST({value} AS BIGINT) AS value FROM (SELECT event_id // 4 AS frame, event_id % 4 AS k, event_id * 37 % 256 AS b, unnest(range(0, {n})) AS i FROM events)"


for _name, _bits, _signed, _order in (("unpack_i4", 4, True, "lsb"), ("unpack_i4_msb", 4, True, "msb"), ("unpack_u2", 2, False, "lsb"), ("unpack_i2", 2, True, "lsb"), ("unpack_u1", 1, False, "lsb")):
    query(_name, _unpack_sql(_bits, _signed, _order == "msb"))(lambda s, d, t=_name.split("_")[1], o=_order: _whole(codec.unpack(_bytes(s, d), t, o)))


@query("unpack_ci4", "SELECT frame, k, CAST(CASE WHEN b % 16 >= 8 THEN b % 16 - 16 ELSE b % 16 END AS BIGINT) AS re, CAST(CASE WHEN b // 16 >= 8 THEN b // 16 - 16 ELSE b // 16 END AS BIGINT) AS im FROM (SELECT event_id // 4 AS frame, event_id % 4 AS k, event_id * 37 % 256 AS b FROM events)")
def _(s, d):
    return _whole(codec.unpack(_bytes(s, d), "ci4"))


_POLS = V_SQL + ", D AS (SELECT time, freq, station, max(re) FILTER (pol = 0) AS xr, max(im) FILTER (pol = 0) AS xi, max(re) FILTER (pol = 1) AS yr, max(im) FILTER (pol = 1) AS yi FROM V GROUP BY ALL)"


def _detect_sql(*values: str) -> str:
    return f"WITH {_POLS} " + " UNION ALL ".join(f"SELECT time, freq, station, {k}::BIGINT AS pol, CAST({v} AS DOUBLE) AS value FROM D" for k, v in enumerate(values))


_XX, _YY = "(xr * xr + xi * xi)", "(yr * yr + yi * yi)"
query("detect_scalar", f"WITH {V_SQL} SELECT time, freq, station, pol, CAST(re * re + im * im AS DOUBLE) AS value FROM V")(lambda s, d: elementwise.detect(tensor_v(s, d), "scalar").df)
query("detect_stokes", _detect_sql(f"{_XX} + {_YY}", f"{_XX} - {_YY}", "2 * (xr * yr + xi * yi)", "-2 * (xi * yr - xr * yi)"))(lambda s, d: _positive_zero(elementwise.detect(tensor_v(s, d), "stokes").df))
query("detect_stokes_i", _detect_sql(f"{_XX} + {_YY}"))(lambda s, d: elementwise.detect(tensor_v(s, d), "stokes_i").df)
query("detect_coherence", _detect_sql(_XX, _YY, "xr * yr + xi * yi", "xr * yi - xi * yr"))(lambda s, d: _positive_zero(elementwise.detect(tensor_v(s, d), "coherence").df))
query("detect_jones", f"WITH {_POLS} SELECT time, freq, station, 0::BIGINT AS pol, CAST({_XX} AS DOUBLE) AS re, CAST({_YY} AS DOUBLE) AS im FROM D UNION ALL SELECT time, freq, station, 1::BIGINT, CAST(xr * yr + xi * yi AS DOUBLE), CAST(xi * yr - xr * yi AS DOUBLE) FROM D")(
    lambda s, d: _positive_zero(elementwise.detect(tensor_v(s, d), "jones").df)
)


@query("map_broadcast", f"WITH {E_SQL} SELECT time, k, CAST(q + (k * k) % 7 AS DOUBLE) AS value FROM E")
def _(s, d):
    b = s.range(64).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("t"), (F.col("id") * F.col("id") % 7).alias("value"))
    vector = TensorFrame(b, TensorSpec.of("i64", Axis("t", -1), Axis("k", 64)))
    return elementwise.map_expression("c = a + b", {"a": tensor_e(s, d), "b": _one_axis(vector)}).df


def _one_axis(tf: TensorFrame) -> TensorFrame:
    """A vector: its stream axis, of one frame, is taken as an axis of size 1."""
    return TensorFrame(tf.df, replace(tf.spec, axes=tuple(replace(a, size=1) if a.is_frame else a for a in tf.spec.axes)))


@query("map_outer", f"WITH {X_SQL} SELECT a.frame, a.lane AS i, b.lane AS j, CAST(a.q * b.q AS DOUBLE) AS value FROM X a JOIN X b USING (frame)")
def _(s, d):
    return elementwise.map_expression("c(frame, i, j) = a(frame, i) * a(frame, j)", {"a": tensor_x(s, d)}).df


@query("map_shift", f"WITH {E_SQL} SELECT time, k, CAST(q - coalesce(lag(q) OVER w, last_value(q) OVER u) AS DOUBLE) AS value FROM E WINDOW w AS (PARTITION BY time ORDER BY k), u AS (PARTITION BY time ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(s, d):
    return elementwise.map_expression("c(time, k) = a(time, k) - a(time, k - 1)", {"a": tensor_e(s, d)}).df


@query("map_complex", f"WITH {V_SQL} SELECT time, freq, station, pol, CAST(re * 3 + im * 2 AS DOUBLE) AS re, CAST(re * 2 - im * 3 AS DOUBLE) AS im FROM V")
def _(s, d):
    return elementwise.map_expression("c = a.conj() * w", {"a": tensor_v(s, d)}, {"w": 3 + 2j}).df


@query("map_condition", f"WITH {E_SQL} SELECT time, k, CAST(CASE WHEN q > 5 THEN q ELSE abs(q) // 2 END AS DOUBLE) AS value FROM E")
def _(s, d):
    return elementwise.map_expression("c = a if a > 5 else abs(a) // 2", {"a": tensor_e(s, d)}).df


@query("multi_add", f"WITH {X_SQL}, Y AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, user_id AS u FROM events) SELECT frame, lane, q + u AS value FROM X JOIN Y USING (frame, lane)")
def _(s, d):
    return elementwise.multi_add(tensor_x(s, d), _users(s, d)).df


def _users(s: SparkSession, d: str) -> TensorFrame:
    df = read(s, d, "events").select(F.expr("event_id div 8").alias("frame"), (F.col("event_id") % 8).alias("lane"), F.col("user_id").alias("value"))
    return TensorFrame(df, TensorSpec.of("i64", Axis("frame", -1), Axis("lane", 8)))


@query("zip_streams", f"WITH {X_SQL}, Y AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, user_id AS u FROM events) SELECT frame, lane, q AS value_0, u AS value_1 FROM X JOIN Y USING (frame, lane)")
def _(s, d):
    return elementwise.zip_streams(tensor_x(s, d), _users(s, d))


# ---- correlation, products, gridding

_CORR = V_SQL + """, L AS (SELECT a.time // 50 AS time, a.freq, a.station AS station_i, a.pol AS pol_i, b.station AS station_j, b.pol AS pol_j, CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.re * b.im - a.im * b.re) AS DOUBLE) AS im
    FROM V a JOIN V b USING (time, freq) WHERE a.station * 2 + a.pol >= b.station * 2 + b.pol GROUP BY ALL HAVING count(*) = 50)"""
_FULL = _CORR + ", M AS (SELECT * FROM L UNION ALL SELECT time, freq, station_j, pol_j, station_i, pol_i, re, -im + 0.0 FROM L WHERE station_i * 2 + pol_i > station_j * 2 + pol_j)"


def _correlated(s: SparkSession, d: str) -> TensorFrame:
    return reduce.correlate(tensor_v(s, d), 50)


def _positive_zero(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in ("re", "im", "value") if c in df.columns})


query("correlate", f"WITH {_CORR} SELECT * FROM L")(lambda s, d: _positive_zero(_correlated(s, d).df))
query("visibilities_full", f"WITH {_FULL} SELECT * FROM M")(lambda s, d: _positive_zero(elementwise.matrix_fill(_correlated(s, d)).df))
query("visibilities_roundtrip", f"WITH {_FULL} SELECT * FROM M")(lambda s, d: _positive_zero(elementwise.from_storage(elementwise.to_storage(elementwise.matrix_fill(_correlated(s, d)))).df))


def _stokes_sql() -> str:
    pick = ", ".join(f"max({c}) FILTER (pol_i = {a} AND pol_j = {b}) AS {c}{a}{b}" for a in (0, 1) for b in (0, 1) for c in ("re", "im"))
    base = f"S AS (SELECT time, freq, station_i * (station_i + 1) // 2 + station_j AS baseline, {pick} FROM M WHERE station_i >= station_j GROUP BY ALL)"
    parts = [("re00 + re11", "im00 + im11"), ("re00 - re11", "im00 - im11"), ("re01 + re10", "im01 + im10"), ("-(im01 - im10)", "re01 - re10")]
    return f"WITH {_FULL}, {base} " + " UNION ALL ".join(f"SELECT time, baseline, freq, {k}::BIGINT AS stokes, {re} + 0.0 AS re, {im} + 0.0 AS im FROM S" for k, (re, im) in enumerate(parts))


query("visibilities_storage", _stokes_sql())(lambda s, d: _positive_zero(elementwise.to_storage(elementwise.matrix_fill(_correlated(s, d))).df))


@query("matmul_ab", f"WITH {E_SQL}, B AS (SELECT k, j, (k * (j + 1)) % 7 - 3 AS b FROM range(0, 64) x(k), range(0, 5) y(j)) SELECT time, j, CAST(2 * sum(q * b) AS DOUBLE) AS value FROM E JOIN B USING (k) GROUP BY ALL")
def _(s, d):
    return linalg.matmul(tensor_e(s, d), _matrix(s), "k", alpha=2.0).df


@query("matmul_accumulate", f"WITH {E_SQL}, B AS (SELECT k, j, (k * (j + 1)) % 7 - 3 AS b FROM range(0, 64) x(k), range(0, 5) y(j)), C AS (SELECT time, k AS j, q AS c FROM E WHERE k < 5) SELECT time, j, CAST(2 * sum(q * b) + 3 * any_value(c) AS DOUBLE) AS value FROM E JOIN B USING (k) JOIN C USING (time, j) GROUP BY ALL")
def _(s, d):
    old = views.rename_axis(shape.slice_axis(tensor_e(s, d), "k", 0, 5), "k", "j")
    return linalg.matmul(tensor_e(s, d), _matrix(s), "k", alpha=2.0, beta=3.0, c=old).df


@query("matmul_bhb", f"WITH {V_SQL} SELECT a.freq, a.pol, a.station AS station_i, b.station AS station_j, CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.re * b.im - a.im * b.re) AS DOUBLE) + 0.0 AS im FROM V a JOIN V b USING (time, freq, pol) WHERE a.station >= b.station GROUP BY ALL")
def _(s, d):
    return _positive_zero(linalg.matmul_bhb(tensor_v(s, d), "station", "time").df)


@query("matmul_aah", f"WITH {V_SQL} SELECT a.freq, a.pol, a.station AS station_i, b.station AS station_j, CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS DOUBLE) + 0.0 AS im FROM V a JOIN V b USING (time, freq, pol) WHERE a.station >= b.station GROUP BY ALL")
def _(s, d):
    return _positive_zero(linalg.matmul_aah(tensor_v(s, d), "station", "time").df)


@query("beamform", f"""WITH {V_SQL}, W AS (SELECT b AS beam, st AS station, (st * (b + 1)) % 7 - 3 AS wr, (st + b) % 5 - 2 AS wi FROM range(0, 3) x(b), range(0, 4) y(st))
    SELECT time, freq, pol, beam, CAST(sum(wr * re - wi * im) AS DOUBLE) AS re, CAST(sum(wr * im + wi * re) AS DOUBLE) AS im FROM V JOIN W USING (station) GROUP BY ALL""")
def _(s, d):
    w = s.range(12).select(F.expr("id div 4").alias("beam"), (F.col("id") % 4).alias("station"))
    b, st = F.col("beam"), F.col("station")
    w = w.select("beam", "station", ((st * (b + 1)) % 7 - 3).alias("re"), ((st + b) % 5 - 2).alias("im"))
    weights = TensorFrame(w, replace(TensorSpec.of("ci8", Axis("beam", -1), Axis("station", 4)), axes=(Axis("beam", 3), Axis("station", -1))))
    return linalg.beamform(weights, tensor_v(s, d)).df


@query("grid", """WITH P AS (SELECT event_type AS lane, event_id % 32 AS x, (event_id // 32) % 32 AS y, CAST(round_even(value * 100, 0) AS BIGINT) AS re, -(event_id % 5) AS im FROM events),
    K AS (SELECT u, v, u + 2 * v + 1 AS kr, u - v AS ki FROM range(0, 3) a(u), range(0, 3) b(v))
    SELECT lane, y + v AS y, x + u AS x, CAST(sum(kr * re + ki * im) AS DOUBLE) AS re, CAST(sum(kr * im - ki * re) AS DOUBLE) AS im FROM P, K WHERE x + u < 32 AND y + v < 32 GROUP BY ALL""")
def _(s, d):
    p = read(s, d, "events").select(F.col("event_type").alias("lane"), (F.col("event_id") % 32).alias("x"), (F.expr("event_id div 32") % 32).alias("y"), F.rint(F.col("value") * 100).cast("bigint").alias("re"), (-(F.col("event_id") % 5)).alias("im"))
    k = s.range(9).select((F.col("id") % 3).alias("u"), F.expr("id div 3").alias("v"))
    k = k.select("u", "v", F.expr("u + 2 * v + 1").alias("re"), F.expr("u - v").alias("im"))
    return linalg.grid(p, k, 32, ["lane"]).withColumns({"re": F.col("re").cast("double"), "im": F.col("im").cast("double")})


# ---- transforms, filters, dispersion

def _dft_sql(n_out: int, sign: int, shift: int = 0, scale: float = 1 / 128) -> str:
    angle = f"({2 * sign} * pi() / 64 * ((k * j) % 64))"
    return f"""WITH {E_SQL} SELECT time, (j + {shift}) % {64} AS k, round(sum(q * {scale} * cos({angle})), 7) + 0.0 AS re, round(sum(q * {scale} * sin({angle})), 7) + 0.0 AS im
        FROM E, range(0, {n_out}) r(j) GROUP BY ALL"""


def _complex_e(s: SparkSession, d: str) -> TensorFrame:
    e = tensor_e(s, d)
    return TensorFrame(e.with_values(elementwise.Pair(F.col("value"), F.lit(0).cast("bigint")), "ci8").df, e.spec.with_dtype("ci8"))


query("dft", _dft_sql(64, -1))(lambda s, d: rounded(fourier.dft(tensor_e(s, d), "k")))
query("fft", _dft_sql(64, -1))(lambda s, d: rounded(fourier.fft(_complex_e(s, d), ["k"])))
query("rfft", _dft_sql(33, -1))(lambda s, d: rounded(fourier.fft(tensor_e(s, d), ["k"])))
query("ifft", _dft_sql(64, 1))(lambda s, d: rounded(fourier.fft(_complex_e(s, d), ["k"], inverse=True)))
query("fft_shifted", _dft_sql(64, -1, 32))(lambda s, d: rounded(fourier.fft(_complex_e(s, d), ["k"], apply_fftshift=True)))


@query("fft_roundtrip", f"WITH {E_SQL} SELECT time, k, round(q * 64 / 128.0, 7) + 0.0 AS value FROM E")
def _(s, d):
    return rounded(fourier.fft(fourier.fft(tensor_e(s, d), ["k"]), ["k"], inverse=True, real_output=True))


@query("power_spectrum", _dft_sql(33, -1).replace("SELECT time, (j", "SELECT time, k, round(re0 * re0 + im0 * im0 + 0.000001, 5) + 0.0 AS value FROM (SELECT time, (j", 1).replace("round(sum(q", "(sum(q").replace(", 7) + 0.0 AS re", ") AS re0").replace(", 7) + 0.0 AS im", ") AS im0") + ")")
def _(s, d):
    out = fourier.power_spectrum(tensor_e(s, d), "k")
    return rounded(out.with_values(out.pair + 1e-6, "f64"), 5)  # exact halves would be rounded by their noise


_TAPS = [1.0, -2.0, 4.0, 3.0, 0.5]


def _fir_sql(decim: int) -> str:
    terms = " + ".join(f"{h} * coalesce(lag(q, {len(_TAPS) - 1 - c}) OVER w, 0)" if c < len(_TAPS) - 1 else f"{h} * q" for c, h in enumerate(_TAPS))
    return f"WITH {X_SQL} SELECT frame // {decim} AS frame, lane, CAST(y AS DOUBLE) AS value FROM (SELECT frame, lane, {terms} AS y FROM X WINDOW w AS (PARTITION BY lane ORDER BY frame)) WHERE frame % {decim} = 0"


query("fir", _fir_sql(1))(lambda s, d: fir.fir(tensor_x(s, d), _TAPS).df)
query("fir_decimated", _fir_sql(2))(lambda s, d: fir.fir(tensor_x(s, d), _TAPS, 2).df)


def _band(s: SparkSession, d: str, step: float = 50.0) -> TensorFrame:
    """The embeddings as [freq, time]; with a negative step the band descends."""
    start = 1000.0 if step > 0 else 1000.0 - 63 * step
    return views.rename_axis(tensor_e(s, d), "k", "freq").then(views.reinterpret_axis, "freq", "freq", start, step, "MHz")


def _fdmt_sql(max_delay: int = 6, channel: str = "k", time: str = "time") -> str:
    """The tree of 64 channels from 1000 MHz on, 50 MHz apart, from its formula."""
    lag = lambda c: f"power(1000 + 50 * ({c}), -2)"
    rows = lambda lo, hi: f"CAST(ceil(({lag(lo)} - {lag(hi)}) / ({lag('0')} - {lag('63')}) * {max_delay - 1}) AS BIGINT) + 1"
    ctes = [
        E_SQL,
        f"A AS (SELECT {channel} AS c, {time} AS t, CAST(q AS DOUBLE) AS q FROM E)",
        f"W AS (SELECT c, unnest(range(0, {rows('c - 0.5', 'c + 0.5')})) AS d FROM range(0, 64) r(c))",
        "S0 AS (SELECT k, d, t, avg(v) AS v FROM (SELECT A.c AS k, W.d, unnest(range(A.t, A.t + W.d + 1)) AS t, q AS v FROM A JOIN W ON A.c = W.c) GROUP BY ALL HAVING count(*) = d + 1)",
    ]
    for n in range(1, 7):
        m = 2**n
        part = lambda to: f"CAST(floor(d * (({lag('k * ' + str(m))} - {lag(to)}) / ({lag('k * ' + str(m))} - {lag(f'k * {m} + {m - 1}')})) + 0.5) AS BIGINT)"  # noqa: B023, E731
        own, upper = rows(f"k * {m}", f"k * {m} + {m - 1}"), rows("k * {0} + {1}".format(m, m // 2), f"k * {m} + {m - 1}") if n > 1 else rows("2 * k + 0.5", "2 * k + 1.5")
        ctes.append(f"P{n} AS (SELECT k, d, {part(f'k * {m} + {m // 2 - 1}')} AS lo, {part(f'k * {m} + {m // 2}')} AS late, {upper} AS most FROM (SELECT k, unnest(range(0, {own})) AS d FROM range(0, {64 // m}) r(k)))")
        ctes.append(f"S{n} AS (SELECT p.k, p.d, l.t, l.v + u.v AS v FROM P{n} p JOIN S{n - 1} l ON l.k = 2 * p.k AND l.d = p.lo JOIN S{n - 1} u ON u.k = 2 * p.k + 1 AND u.d = least(p.d - p.late, p.most - 1) AND u.t = l.t - p.late)")
    return f"WITH {', '.join(ctes)} SELECT d::BIGINT AS dispersion, t AS time, round(v, 7) + 0.0 AS value FROM S6"


query("fdmt", _fdmt_sql())(lambda s, d: rounded(dispersion.fdmt(_band(s, d), "freq", 6)))
query("fdmt_descending", _fdmt_sql(9, "63 - k"))(lambda s, d: rounded(dispersion.fdmt(_band(s, d, -50.0), "freq", 9)))
query("fdmt_negative_delays", _fdmt_sql(6, "k", "-time").replace("t AS time", "-t AS time"))(lambda s, d: rounded(dispersion.fdmt(_band(s, d), "freq", 6, negative_delays=True)))


@query("fdmt_block", _fdmt_sql(8))
def _(s, d):
    band = shape.transpose(_band(s, d), ["freq", "time"])
    return rounded(dispersion.fdmt_block(band, max_diagonal=8 / 64))


_DELAYS = dispersion.channel_delays(Axis("freq", 64, 1000.0, 50.0, "MHz"), 2.0, 0.001)
query("dedisperse", f"WITH {E_SQL} SELECT time - (CASE k {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_DELAYS))} END) AS time, CAST(sum(q) AS DOUBLE) AS value FROM E GROUP BY ALL HAVING count(*) = 64")(
    lambda s, d: as_double(dispersion.dedisperse(_band(s, d), "freq", 2.0))
)


# ---- sequences side by side: two of different length, told apart by a key

S_SQL = E_SQL + ", Q AS (SELECT CASE WHEN time % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS seq, CASE time % 3 WHEN 1 THEN time // 3 WHEN 0 THEN 2 * (time // 3) ELSE 2 * (time // 3) + 1 END AS frame, k, q FROM E)"


def tensor_s(s: SparkSession, d: str) -> TensorFrame:
    third, n = F.col("time") % 3, F.expr("time div 3")
    frame = F.when(third == 1, n).when(third == 0, 2 * n).otherwise(2 * n + 1)
    df = tensor_e(s, d).df.select(F.when(third == 1, 1).otherwise(0).cast("bigint").alias("seq"), frame.alias("frame"), "k", "value")
    return TensorFrame(df, TensorSpec.of("i8", Axis("frame", -1), Axis("k", 64, 1000.0, 50.0, "MHz")), ("seq",))


query("map_sequences", f"WITH {S_SQL} SELECT a.seq, a.frame, a.k, CAST(a.q * b.q AS DOUBLE) AS value FROM Q a JOIN Q b ON a.seq = b.seq AND a.frame = b.frame AND (a.k + 1) % 64 = b.k")(
    lambda s, d: elementwise.map_expression("c(frame, k) = a(frame, k) * a(frame, k + 1)", {"a": tensor_s(s, d)}).df
)
query("fir_sequences", f"WITH {S_SQL} SELECT seq, frame, k, CAST({' + '.join(f'{h} * coalesce(lag(q, {len(_TAPS) - 1 - c}) OVER w, 0)' if c < len(_TAPS) - 1 else f'{h} * q' for c, h in enumerate(_TAPS))} AS DOUBLE) AS value FROM Q WINDOW w AS (PARTITION BY seq, k ORDER BY frame)")(
    lambda s, d: fir.fir(tensor_s(s, d), _TAPS).df
)
query("fir_taps_by_lane", f"WITH {S_SQL} SELECT seq, frame, k, CAST((k % 5 + 1) * q - (k % 3) * coalesce(lag(q) OVER w, 0) AS DOUBLE) AS value FROM Q WINDOW w AS (PARTITION BY seq, k ORDER BY frame)")(
    lambda s, d: fir.fir(tensor_s(s, d), [[-float(k % 3) for k in range(64)], [k % 5 + 1.0 for k in range(64)]]).df
)
_B_SQL = "B AS (SELECT k, j, (k * (j + 1)) % 7 - 3 AS b FROM range(0, 64) x(k), range(0, 5) y(j))"
query("matmul_sequences", f"WITH {S_SQL}, {_B_SQL} SELECT seq, frame, j, CAST(sum(q * b) AS DOUBLE) AS value FROM Q JOIN B USING (k) GROUP BY ALL")(lambda s, d: linalg.matmul(tensor_s(s, d), _matrix(s), "k").df)
query("beamform_sequences", f"WITH {S_SQL}, {_B_SQL} SELECT seq, frame, j AS beam, CAST(sum(q * b) AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM Q JOIN B USING (k) GROUP BY ALL")(
    lambda s, d: _positive_zero(linalg.beamform(views.rename_axis(_matrix(s), "j", "beam"), tensor_s(s, d), "k").df)
)
query("gram_sequences", f"WITH {S_SQL} SELECT seq, a.k AS k_i, b.k AS k_j, CAST(sum(a.q * b.q) AS DOUBLE) AS value FROM Q a JOIN Q b USING (seq, frame) WHERE a.k >= b.k GROUP BY ALL")(lambda s, d: linalg.matmul_aah(tensor_s(s, d), "k", "frame").df)
query("accumulate_sequences", f"WITH {S_SQL} SELECT seq, frame // 7 AS frame, k, CAST(sum(q) AS BIGINT) AS value FROM Q GROUP BY ALL HAVING count(*) = 7")(lambda s, d: reduce.accumulate(tensor_s(s, d), 7).df)
def _matrix(s: SparkSession) -> TensorFrame:
    """A matrix of 64 by 5; its stream axis is the columns."""
    k, j = F.col("k"), F.col("j")
    df = s.range(320).select(F.expr("id div 5").alias("k"), (F.col("id") % 5).alias("j")).select("k", "j", ((k * (j + 1)) % 7 - 3).alias("value"))
    return TensorFrame(df, replace(TensorSpec.of("i64", Axis("k", 64), Axis("j", -1)), axes=(Axis("k", 64), Axis("j", 5))))


# ---- gulps, gaps, packets

@query("gulp_overlap", f"WITH {X_SQL} SELECT lane, gulp, CAST(sum(q) AS BIGINT) AS total, count(*) AS n FROM (SELECT *, unnest(range(greatest(0, (frame - 16 + 12) // 12), frame // 12 + 1)) AS gulp FROM X) GROUP BY ALL")
def _(s, d):
    return gulps.overlapping_gulps(tensor_x(s, d).df, "frame", 16, 12).groupBy("lane", "gulp").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("skip_fill", f"WITH {X_SQL}, Y AS (SELECT * FROM X WHERE frame % 11 <> 5), R AS (SELECT lane, unnest(range(min(frame), max(frame) + 1)) AS frame FROM Y GROUP BY lane) SELECT lane, frame, coalesce(q, 0) AS value FROM R LEFT JOIN Y USING (lane, frame)")
def _(s, d):
    return gulps.fill_skipped(tensor_x(s, d).df.where("frame % 11 <> 5"), "frame", ["value"], 64, ["lane"])


_PACKETS = "P AS (SELECT event_id AS arrival, event_id % 4 AS src, event_id // 1024 AS block, (event_id // 4) + (event_id * 7919) % 41 AS seq FROM events)"


def _packets(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return read(s, d, "events").select(i.alias("arrival"), (i % 4).alias("src"), F.expr("event_id div 1024").alias("block"), (F.expr("event_id div 4") + i * 7919 % 41).alias("seq"))


@query("late_drop", f"WITH {_PACKETS}, J AS (SELECT *, coalesce(seq // 8 + 2 <= max(seq // 8) OVER (PARTITION BY src, block ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM P) SELECT arrival, src, block, seq FROM J WHERE NOT late")
def _(s, d):
    return gulps.drop_late(_packets(s, d), "arrival", "seq", ["src"], 8, "block")[0]


@query("blank_missing", "WITH P AS (SELECT event_id // 64 AS gulp, event_id % 4 AS src, event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events WHERE event_id % 4 <> 1 OR event_id % 3 = 0) SELECT gulp, src, event_id, CASE WHEN 16 - n > n THEN 0 ELSE v END AS v FROM (SELECT *, count(*) OVER (PARTITION BY gulp, src) AS n FROM P)")
def _(s, d):
    i = F.col("event_id")
    rows = read(s, d, "events").where("event_id % 4 <> 1 OR event_id % 3 = 0").select(F.expr("event_id div 64").alias("gulp"), (i % 4).alias("src"), "event_id", F.rint(F.col("value") * 100).cast("bigint").alias("v"))
    return gulps.blank_missing(rows, "gulp", "src", ["v"], 16)


_CHANS = "C AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, (event_id // 8 // 7) % 3 AS chan0 FROM events)"


def _chans(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.expr("event_id div 8").alias("frame"), (F.col("event_id") % 8).alias("lane"), (F.expr("event_id div 8 div 7") % 3).alias("chan0"))


query("sequence_change", f"WITH {_CHANS} SELECT frame, lane, chan0 FROM (SELECT *, lag(chan0) OVER (PARTITION BY lane ORDER BY frame) AS b FROM C) WHERE b IS NULL OR b <> chan0")(
    lambda s, d: gulps.sequence_starts(_chans(s, d), "frame", ["chan0"], ["lane"], 64).select("frame", "lane", "chan0")
)
query("capture_status", f"WITH {_CHANS} SELECT frame, lane, chan0, CASE WHEN b IS NULL THEN 'STARTED' WHEN b <> chan0 THEN 'CHANGED' ELSE 'CONTINUED' END AS status FROM (SELECT *, lag(chan0) OVER (PARTITION BY lane ORDER BY frame) AS b FROM C)")(
    lambda s, d: gulps.capture_status(_chans(s, d), "frame", ["chan0"], ["lane"]).select("frame", "lane", "chan0", "status")
)


_TAGS = "S AS (SELECT user_id, event_id AS tag, event_id * 10 AS seq FROM events WHERE event_id % 10 = 0), R AS (SELECT user_id, event_id FROM events WHERE event_id % 10 <> 0)"
_AT = {
    "at": f"WITH {_TAGS} SELECT R.user_id, R.event_id, coalesce(S.seq, -1) AS seq FROM R ASOF LEFT JOIN S ON R.user_id = S.user_id AND R.event_id >= S.tag",
    "next": f"WITH {_TAGS} SELECT R.user_id, R.event_id, coalesce(S.seq, -1) AS seq FROM R ASOF LEFT JOIN S ON R.user_id = S.user_id AND R.event_id < S.tag",
    "earliest": f"WITH {_TAGS} SELECT user_id, event_id, coalesce(s, -1) AS seq FROM R LEFT JOIN (SELECT user_id, min(seq) AS s FROM S GROUP BY ALL) USING (user_id)",
    "latest": f"WITH {_TAGS} SELECT user_id, event_id, coalesce(s, -1) AS seq FROM R LEFT JOIN (SELECT user_id, max(seq) AS s FROM S GROUP BY ALL) USING (user_id)",
}


def _sequence_at(s: SparkSession, d: str, which: str) -> DataFrame:
    """A tenth of the events are sequences, the rest requests."""
    e = read(s, d, "events").select("user_id", "event_id")
    tagged = e.where("event_id % 10 = 0").select("user_id", F.col("event_id").alias("tag"), (F.col("event_id") * 10).alias("seq"))
    found = gulps.sequence_at(e.where("event_id % 10 <> 0"), tagged, "event_id", "tag", ["user_id"], which, 256)
    return found.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("bigint")))


for _which, _sql in _AT.items():
    query("sequence_at" if _which == "at" else f"sequence_{_which}", _sql)(lambda s, d, w=_which: _sequence_at(s, d, w))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltages to Stokes parameters, stations merged, integrated in time."""
    tf = elementwise.detect(tensor_v(spark, sf_dir), "stokes")
    return reduce.accumulate(reduce.reduce(tf, "station"), 10).df


query("spectrometer", f"WITH {_POLS}, T AS ({_detect_sql(f'{_XX} + {_YY}', f'{_XX} - {_YY}', '2 * (xr * yr + xi * yi)', '-2 * (xi * yr - xr * yi)').split('GROUP BY ALL) ', 1)[1].split('GROUP BY ALL) ', 1)[-1]}) SELECT time // 10 AS time, freq, 0::BIGINT AS station, pol, sum(value) AS value FROM T GROUP BY ALL HAVING count(*) = 40")(flagship)


# ---- files and packets: written, read back and compared with the tables


def _folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, as a path."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.removeprefix('file:').rstrip('/')}/tensor-{what}-{uuid.uuid4().hex}"


def _written(rows: DataFrame) -> list[str]:
    """The files of a write, in order."""
    return sorted((r["file"] for r in rows.select("file").collect()), key=lambda f: (len(f), f))


def _joined(tf: TensorFrame, frames: int) -> DataFrame:
    """Files of ``frames`` frames as one stream."""
    t = tf.spec.frame.label
    return tf.df.withColumn(t, F.col("seq") * frames + F.col(t)).drop("seq").select(*tf.spec.labels, F.col("value").cast("bigint"))


def _filterbank(s: SparkSession, d: str, dtype: str = "i8", top: int = 0) -> TensorFrame:
    """The embeddings as (time, pol, freq)."""
    e = tensor_e(s, d)
    value = F.pmod(F.col("value"), F.lit(top)) if top else F.col("value")
    df = e.df.select("time", F.expr("k div 32").alias("pol"), (F.col("k") % 32).alias("freq"), value.alias("value"))
    return TensorFrame(df, TensorSpec.of(dtype, Axis("time", -1, 0.0, 0.001, "s"), Axis("pol", 2), Axis("freq", 32, 1000.0, 1.0, "MHz")))


_FIL = "SELECT time, k // 32 AS pol, k % 32 AS freq, {v}::BIGINT AS value FROM E"


@query("file_sigproc", f"WITH {E_SQL} {_FIL.format(v='q')}")
def _(s, d):
    return _joined(files.read_sigproc(s, _written(files.write_sigproc(_filterbank(s, d), _folder(s, "fil"), "obs", 300))), 300)


for _bits in (1, 2, 4):
    query(f"file_sigproc_{_bits}bit", f"WITH {E_SQL} {_FIL.format(v=f'((q + 128) % {2**_bits})')}")(
        lambda s, d, b=_bits: _joined(files.read_sigproc(s, _written(files.write_sigproc(_filterbank(s, d, f"u{b}", 2**b), _folder(s, "fil"), "obs", 300))), 300)
    )


@query("file_sigproc_beams", f"WITH {E_SQL} SELECT time, k // 32 AS beam, (k // 16) % 2 AS pol, k % 16 AS freq, q AS value FROM E")
def _(s, d):
    df = tensor_e(s, d).df.select("time", F.expr("k div 32").alias("beam"), F.expr("(k div 16) % 2").alias("pol"), (F.col("k") % 16).alias("freq"), "value")
    tf = TensorFrame(df, TensorSpec.of("i8", Axis("time", -1), Axis("beam", 2), Axis("pol", 2), Axis("freq", 16)))
    out = [_joined(files.read_sigproc(s, _written(rows)), 500).withColumn("beam", F.lit(k).cast("bigint")) for k, rows in files.write_beams(tf, _folder(s, "beams"), "obs", 500).items()]
    return out[0].unionByName(out[1])


@query("file_time_series", f"WITH {E_SQL} SELECT time, k AS pol, 0::BIGINT AS freq, q AS value FROM E")
def _(s, d):
    tf = views.rename_axis(tensor_e(s, d), "k", "pol")
    return _joined(files.read_sigproc(s, _written(files.write_time_series(tf, _folder(s, "tim"), "obs", 26.0, 300))), 300)


@query("file_wav", f"WITH {E_SQL} SELECT time, k AS pol, q * 100 AS value FROM E")
def _(s, d):
    e = views.rename_axis(tensor_e(s, d), "k", "pol")
    return _joined(files.read_wav(s, _written(files.write_wav(e.with_values(e.pair.re * 100, "i16"), _folder(s, "wav"), "obs", 300))), 300)


@query("file_binary", f"WITH {E_SQL} SELECT time AS streamed, k AS gulped, q AS value FROM E")
def _(s, d):
    return _joined(files.read_binary(s, _written(files.write_binary(tensor_e(s, d), _folder(s, "bin"), "obs", 300)), 64, "i8"), 300)


@query("file_baseband", f"WITH {E_SQL} SELECT time, k, q AS value FROM E")
def _(s, d):
    tf = tensor_e(s, d)
    rows = files.write_frames(tf, _folder(s, "dada"), "obs", lambda first, nbyte: make_dada({"NCHAN": 64, "NBIT": 8, "OBS_OFFSET": first * 64}), "<i1", 300, "dada")
    return _joined(files.read_dada(s, _written(rows), lambda h: TensorSpec.of(f"i{h['NBIT']}", Axis("time", -1), Axis("k", h["NCHAN"]))), 300)


@query("file_voltages", f"WITH {V_SQL} SELECT time // 5 AS time, freq, time % 5 * 4 + station AS fine_time, pol, re, im FROM V WHERE time < (SELECT max(time) + 1 FROM V) // 5 * 5")
def _(s, d):
    v = tensor_v(s, d)
    last = ((v.df.agg(F.max("time")).head()[0] or -1) + 1) // 5 * 5  # whole blocks
    df = v.df.where(F.col("time") < F.lit(int(last))).select(F.expr("time div 5").alias("time"), "freq", (F.col("time") % 5 * 4 + F.col("station")).alias("fine_time"), "pol", "re", "im")
    tf = TensorFrame(df, TensorSpec.of("ci8", Axis("time", -1), Axis("freq", 4, 1000.0, 1.0, "MHz"), Axis("fine_time", 20, 0.0, 1e-6, "s"), Axis("pol", 2)))
    got = files.read_guppi(s, _written(files.write_guppi(tf, _folder(s, "raw"), "obs", 1000)))
    return got.df.withColumn("time", F.col("seq") * 1000 + F.col("time")).drop("seq")


@query("file_serialized", f"WITH {V_SQL} SELECT * FROM V")
def _(s, d):
    path = _folder(s, "serialized")
    files.serialize(tensor_v(s, d), path)
    return files.deserialize(s, path).df


_P_SQL = "P AS (SELECT event_id AS n, event_id // 4 AS g, event_id % 4 AS c, user_id AS u FROM events)"
# by format: header values made of g (group), c (one of four) and u; the sources; and what decoding says of them
_PACKET_FORMATS: dict[str, tuple[dict[str, str], int, str, str]] = {
    "simple": ({"seq": "g"}, 1, "g", "0"),
    "chips": ({"roach": "c + 1", "nchan": "2", "seq": "g + 1"}, 4, "g", "c"),
    "ibeam": ({"server": "c + 1", "nchan": "2", "nbeam": "1", "nserver": "4", "seq": "g + 1"}, 4, "g", "c"),
    "pbeam": ({"server": "c % 2 + 1", "beam": "c div 2", "nchan": "2", "nserver": "2", "navg": "5", "seq": "g * 5"}, 4, "g", "c"),
    "snap2": ({"seq": "g", "npol": "2", "npol_tot": "4", "nchan": "8", "nchan_tot": "16", "chan_block_id": "c div 2", "pol0": "c % 2 * 2"}, 4, "g", "c"),
    "tbn": ({"tbn_id": "c + 1", "time_tag": "g * 512"}, 4, "g", "c"),
    "drx": ({"frame_count_word": "(c div 2 + 1) * 134217728 + c % 2 * 2147483648", "decimation": "10", "time_offset": "7", "time_tag": "g * 40960 + 7"}, 4, "g", "c"),
    "cor": ({"frame_count_word": "257", "navg": "100", "stand0": "IF(c > 1, 2, 1)", "stand1": "IF(c = 0, 1, 2)", "time_tag": "g * 196000000"}, 3, "g", "IF(c > 1, 3, c + 1)"),
}
_PACKET_FORMATS["drx8"] = _PACKET_FORMATS["drx"]


def _packet_rows(s: SparkSession, d: str, fmt: str) -> DataFrame:
    """A packet for each event, with its number as payload."""
    values, *_ = _PACKET_FORMATS[fmt]
    rows = read(s, d, "events").select(F.col("event_id").alias("n"), F.expr("event_id div 4").alias("g"), (F.col("event_id") % 4).alias("c"), F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("payload"))
    return packets.encode(rows, fmt, {k: F.expr(v).cast("bigint") for k, v in values.items()})


def _duck(expression: str) -> str:
    return expression.replace(" div ", " // ").replace("IF(", "if(")


for _fmt, (_values, _nsrc, _seq, _src) in _PACKET_FORMATS.items():
    query(f"packets_{_fmt}", f"WITH {_P_SQL} SELECT n, ({_duck(_seq)})::BIGINT AS seq, ({_duck(_src)})::BIGINT AS src, ({_duck(_src)}) < {_nsrc} AS valid, n AS payload FROM P")(
        lambda s, d, f=_fmt, k=_nsrc: packets.decode(_packet_rows(s, d, f).select("n", "packet"), f, k).select("n", "seq", "src", "valid", F.conv(F.hex("payload"), 16, 10).cast("bigint").alias("payload"))
    )


@query("packets_recorded", "SELECT event_id AS number, event_id AS payload FROM events")
def _(s, d):
    rows = _packet_rows(s, d, "simple")
    written = _written(files.write_packets(rows, _folder(s, "packets"), "port", "n", 1000))
    got = files.read_packets(s, written, packets.header_bytes("simple") + 8)
    return packets.decode(got, "simple", 1).select((F.col("file") * 1000 + F.col("number")).alias("number"), F.conv(F.hex("payload"), 16, 10).cast("bigint").alias("payload"))


@query("packets_numbered", f"WITH {_P_SQL} SELECT n, 100 + g * 3 AS seq, 10 + c * 2 AS src FROM P")
def _(s, d):
    rows = read(s, d, "events").select(F.col("event_id").alias("n"))
    return packets.numbered(rows, F.col("n"), 4, 100, 3, 10, 2)


_SAMPLE_SQL = "SELECT event_id // 4 AS seq, event_id % 4 AS src, i AS sample, ((event_id + i) % 16 - CASE WHEN (event_id + i) % 16 >= 8 THEN 16 ELSE 0 END)::BIGINT AS re, ((event_id * 3 + i) % 16 - CASE WHEN (event_id * 3 + i) % 16 >= 8 THEN 16 ELSE 0 END)::BIGINT AS im, i // 32 AS chan, i % 32 AS input FROM (SELECT event_id, unnest(range(0, 64)) AS i FROM events)"


@query("packets_payload_chips", _SAMPLE_SQL)
def _(s, d):
    values, nsrc, *_ = _PACKET_FORMATS["chips"]
    nibble = lambda x: F.hex(F.pmod(x, F.lit(16)))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(nibble(F.col("event_id") + i), nibble(F.col("event_id") * 3 + i))), "")
    rows = read(s, d, "events").select(F.expr("event_id div 4").alias("g"), (F.col("event_id") % 4).alias("c"), F.unhex(body).alias("payload"))
    packed = packets.encode(rows, "chips", {k: F.expr(v).cast("bigint") for k, v in values.items()})
    return packets.samples(packets.decode(packed, "chips", nsrc), "chips")


# ---- Jones matrices, statements in a row, assignment into part

_J_SQL = V_SQL + """, J AS (SELECT time, freq, station, max(re) FILTER (pol = 0) AS xr, max(im) FILTER (pol = 0) AS xi, max(re) FILTER (pol = 1) AS yr, max(im) FILTER (pol = 1) AS yi FROM V GROUP BY ALL)"""


@query("jones_apply", f"WITH {_J_SQL} SELECT time, freq, station, 0::BIGINT AS pol, CAST(2 * xr - yi AS DOUBLE) AS re, CAST(2 * xi + yr AS DOUBLE) AS im FROM J UNION ALL SELECT time, freq, station, 1::BIGINT, CAST(-xr - xi + 3 * yr AS DOUBLE), CAST(xr - xi + 3 * yi AS DOUBLE) FROM J")
def _(s, d):
    return _positive_zero(jones.apply(Jones.of(2, 1j, -1 + 1j, 3), tensor_v(s, d)).df)


@query("jones_coherency", f"WITH {_J_SQL} SELECT time, freq, station, CAST(xr * xr + xi * xi + yr * yr + yi * yi AS DOUBLE) AS trace, CAST(0 AS DOUBLE) AS det FROM J")
def _(s, d):
    """The coherency of a wave: its trace is the power, its determinant is zero."""
    v = jones.vectors(tensor_v(s, d))
    c = jones.Vector.column("x", "y").outer()
    return v.select("time", "freq", "station", c.trace().re.cast("double").alias("trace"), (F.round(c.det().re.cast("double"), 3) + F.lit(0.0)).alias("det"))


@query("map_statements", f"WITH {E_SQL} SELECT time, k, CAST((q + 3) * (q + 3) - q AS DOUBLE) AS value FROM E")
def _(s, d):
    return elementwise.map_statements("b = a + 3; c = b * b - a", {"a": tensor_e(s, d)})["c"].df


@query("map_part", f"WITH {E_SQL} SELECT time, k, CAST(CASE WHEN k >= 60 THEN 2 * lag(q, 60) OVER (PARTITION BY time ORDER BY k) ELSE q END AS DOUBLE) AS value FROM E")
def _(s, d):
    e = tensor_e(s, d)
    return elementwise.assign_part("a(time, k + 60) = b(time, k) * 2", e, {"b": shape.slice_axis(e, "k", 0, 4)}).df


# ---- shapes that say the factors, few bits, bytes turned round, captures that end

query("reduce_to_shape", f"WITH {V_SQL} SELECT time, freq // 2 AS freq, station // 4 AS station, pol, CAST(sum(re * re + im * im) / sqrt(count(*)) AS DOUBLE) AS value FROM V GROUP BY ALL")(
    lambda s, d: reduce.reduce_to(tensor_v(s, d), {"freq": 2, "station": 1}, "pwrstderr").df
)
query("byteswap", "SELECT event_id AS frame, ((event_id * 7919 % 65536) % 256 * 256 + (event_id * 7919 % 65536) // 256)::BIGINT AS value FROM events")(
    lambda s, d: _whole(shape.byteswap(TensorFrame(read(s, d, "events").select(F.col("event_id").alias("frame"), (F.col("event_id") * 7919 % 65536).alias("value")), TensorSpec.of("u16", Axis("frame", -1)))))
)
query("quantize_u1", "SELECT vec_id AS time, k, CASE WHEN CAST(v AS DOUBLE) >= 0 THEN 1 ELSE 0 END::BIGINT AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings)")(
    lambda s, d: _whole(codec.quantize(_raw(s, d), "u1", 20.0))
)
for _name, _low, _high in (("i2", -1, 1), ("u2", 0, 3)):
    query(f"quantize_{_name}", f"SELECT vec_id AS time, k, CAST(round_even(greatest(least(CAST(v AS DOUBLE) * 20, {_high}), {_low}), 0) AS BIGINT) AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings)")(
        lambda s, d, t=_name: _whole(codec.quantize(_raw(s, d), t, 20.0))
    )
_ACTIVE = "A AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, (event_id // 8 // 7) % 3 AS chan0, (event_id // 8) % 5 < 3 AS up FROM events)"
query("capture_ends", f"WITH {_ACTIVE} SELECT frame, lane, CASE WHEN NOT up AND was THEN 'ENDED' WHEN NOT up THEN 'NO_DATA' WHEN NOT was THEN 'STARTED' WHEN b <> chan0 THEN 'CHANGED' ELSE 'CONTINUED' END AS status FROM (SELECT *, lag(chan0) OVER w AS b, coalesce(lag(up) OVER w, false) AS was FROM A WINDOW w AS (PARTITION BY lane ORDER BY frame))")(
    lambda s, d: gulps.capture_status(_chans(s, d).withColumn("on", F.col("frame") % 5 < 3), "frame", ["chan0"], ["lane"], "on").select("frame", "lane", "status")
)


# ---- array functions, pictures, chains, text


@query("array_function", f"WITH {X_SQL} SELECT frame, lane, CAST(q - sum(q) OVER (PARTITION BY frame // 16, lane) AS DOUBLE) AS value FROM X")
def _(s, d):
    return custom.apply_arrays(tensor_x(s, d), 16, lambda x: x - x.sum(axis=0), TensorSpec.of("f64", Axis("frame", -1), Axis("lane", 8))).df


@query("array_functions", f"WITH {X_SQL}, Y AS (SELECT event_id // 8 AS frame, event_id % 8 AS lane, user_id AS u FROM events) SELECT frame, lane, CAST(q + u AS DOUBLE) AS both, CAST(t AS DOUBLE) AS total FROM X JOIN Y USING (frame, lane) JOIN (SELECT frame, sum(u) AS t FROM Y GROUP BY ALL) USING (frame)")
def _(s, d):
    """Two streams in, two out."""
    spec = TensorSpec.of("f64", Axis("frame", -1), Axis("lane", 8))
    both, total = custom.apply_many([tensor_x(s, d), _users(s, d)], 32, lambda x: [x[0] + x[1], x[1].sum(axis=1)], [spec, TensorSpec.of("f64", Axis("frame", -1))])
    return both.df.withColumnRenamed("value", "both").join(total.df.withColumnRenamed("value", "total"), "frame")


@query("waterfall", f"WITH {X_SQL} SELECT frame, " + ", ".join(f'max(q) FILTER (lane = {k}) AS "{k}"' for k in range(8)) + " FROM X GROUP BY ALL")
def _(s, d):
    return custom.waterfall(tensor_x(s, d), "lane")


@query("spliced", f"WITH {X_SQL} SELECT 0::BIGINT AS seq, frame, lane, q AS value FROM X UNION ALL SELECT 1::BIGINT, frame, lane, 2 * q FROM X")
def _(s, d):
    x = tensor_x(s, d)
    return custom.spliced(x, x.with_values(x.pair.re * 2, "i64")).df


@query("array_source", "SELECT t AS frame, k, CAST(t * 10 + k AS DOUBLE) AS value FROM range(0, 30) a(t), range(0, 7) b(k)")
def _(s, d):
    return custom.from_array(s, np.arange(30.0)[:, None] * 10 + np.arange(7.0), TensorSpec.of("f64", Axis("frame", -1), Axis("k", 7))).df


@query("chain", f"WITH {E_SQL} SELECT time // 5 AS time, k // 8 AS k, CAST(sum(q) AS DOUBLE) AS value FROM E GROUP BY ALL HAVING count(*) = 40")
def _(s, d):
    return Chain(tensor_e(s, d)).reduce("k", 8).accumulate(5).frame.df


@query("file_text", f"WITH {X_SQL} SELECT frame, lane, q AS value FROM X")
def _(s, d):
    path = _folder(s, "text")
    files.write_text(tensor_x(s, d), path)
    return s.read.schema("frame bigint, lane bigint, value bigint").csv(f"{path}/data", header=True)


# ---- the same operators on Structured Streaming, with their state


def _streamed(s: SparkSession, d: str, operator) -> DataFrame:
    """The events as a stream of files, through ``operator`` and into a table."""
    schema = read(s, d, "events").schema
    rows = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select(F.expr("event_id div 8").alias("frame"), (F.col("event_id") % 8).alias("lane"), F.rint(F.col("value") * 100).alias("value"))
    made, path = operator(rows), _folder(s, "stream")
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(f"{path}/rows")


query("stream_accumulate", f"WITH {X_SQL} SELECT lane, frame // 10 AS frame, CAST(sum(q) AS DOUBLE) AS value FROM X GROUP BY ALL HAVING count(*) = 10")(lambda s, d: _streamed(s, d, lambda r: stateful.accumulate_stream(r, 10, horizon=1 << 40)))
query("stream_fir", _fir_sql(1).replace("SELECT frame // 1 AS frame", "SELECT frame"))(lambda s, d: _streamed(s, d, lambda r: stateful.fir_stream(r, _TAPS)))
query("stream_running", f"WITH {X_SQL} SELECT lane, frame, CAST(sum(q) OVER (PARTITION BY lane ORDER BY frame) AS DOUBLE) AS value FROM X")(lambda s, d: _streamed(s, d, stateful.running))
