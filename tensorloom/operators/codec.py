"""Quantising to integers and unpacking of packed ones.

Deviations from common backends are plain: 4-bit values are rounded half to
even like all others (``rounding='trunc'`` truncates), and 1-bit values are
packed from the top bit down.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import DType


def quantized(x: Column, dtype: DType, scale: float = 1.0, rounding: str = "even") -> Column:
    low, high = dtype.bounds()
    scaled = x.cast("double") * scale
    if dtype.nbit == 1:
        return F.when(scaled >= 0, 1).otherwise(0)
    clipped = F.greatest(F.least(scaled, F.lit(float(high))), F.lit(float(low)))
    return clipped.cast("bigint") if rounding == "trunc" else F.rint(clipped).cast("bigint")


def quantize(tf: TensorFrame, dtype: str, scale: float = 1.0, rounding: str = "even") -> TensorFrame:
    """Scaled, clipped to the type's symmetric range and rounded, half to even."""
    new = DType.of(dtype)
    if new.is_floating or new.is_complex != tf.spec.dtype.is_complex:
        raise ValueError(f"cannot quantise {tf.spec.dtype} to {new}")
    out = tf.df.withColumns({c: quantized(F.col(c), new, scale, rounding).cast(new.sql()) for c in tf.values})
    return TensorFrame(out, tf.spec.with_dtype(new), tf.keys)


def pack(tf: TensorFrame, bit_order: str = "msb") -> TensorFrame:
    """Values of 1, 2 or 4 bits on the last axis as bytes (type ``u8``)."""
    dtype, last = tf.spec.dtype, tf.spec.axes[-1]
    n = 8 // dtype.nbit
    if dtype.is_complex or dtype.nbit not in (1, 2, 4) or last.is_frame or last.size % n:
        raise ValueError(f"cannot pack {dtype} along {last.label!r}")
    k = F.pmod(F.col(last.label), F.lit(n))
    place = (n - 1 - k if bit_order == "msb" else k) * dtype.nbit
    low = F.col("value").cast("int").bitwiseAND(2**dtype.nbit - 1) * F.pow(F.lit(2), place).cast("int")
    df = tf.df.groupBy(*tf.over(last.label), F.expr(f"`{last.label}` div {n}").alias(last.label)).agg(F.sum(low).cast("smallint").alias("value"))
    return TensorFrame(df, tf.spec.with_axis(last.label, replace(last, size=last.size // n)).with_dtype("u8"), tf.keys)


def unpack(tf: TensorFrame, dtype: str, bit_order: str = "lsb", align_msb: bool = False, conjugate: bool = False) -> TensorFrame:
    """Bytes (``u8``) as values of 1, 2 or 4 bits, sign-extended.

    For complex types each pair of values is (re, im).  ``align_msb`` leaves a
    value in the high bits of its byte.
    """
    packed, last = DType.of(dtype), tf.spec.axes[-1]
    bits, n = packed.nbit, 8 // packed.nbit
    if bits not in (1, 2, 4) or tf.spec.dtype.nbit != 8:
        raise ValueError(f"cannot unpack {tf.spec.dtype} to {packed}")
    byte = F.pmod(F.col("value").cast("int"), F.lit(256))

    def part(i: int) -> Column:
        word = F.shiftright(byte, bits * (i if bit_order == "lsb" else n - 1 - i)).bitwiseAND(2**bits - 1)
        if packed.is_signed:
            word = F.when(word >= 2 ** (bits - 1), word - 2**bits).otherwise(word)
        return word * 2 ** (8 - bits) if align_msb else word

    parts = [part(i) for i in range(n)]
    if packed.is_complex:
        if bits == 1:
            raise ValueError("complex values of one bit have no sign")
        pairs = [F.struct(F.lit(i // 2).alias("i"), parts[i].cast("smallint").alias("re"), (-parts[i + 1] if conjugate else parts[i + 1]).cast("smallint").alias("im")) for i in range(0, n, 2)]
        n //= 2
        new = {"re": F.col("__p.re"), "im": F.col("__p.im")}
        kind = "ci8"
    else:
        pairs = [F.struct(F.lit(i).alias("i"), p.cast("smallint").alias("value")) for i, p in enumerate(parts)]
        new, kind = {"value": F.col("__p.value")}, f"{packed.kind}8"
    df = tf.df.withColumn("__p", F.explode(F.array(*pairs))).withColumn(last.label, F.col(last.label) * n + F.col("__p.i")).withColumns(new)
    size = -1 if last.is_frame else last.size * n
    return TensorFrame(df, tf.spec.with_axis(last.label, replace(last, size=size)).with_dtype(kind), tf.keys)
