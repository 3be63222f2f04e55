"""Element-wise operators: detection, visibilities, sums of streams, map expressions."""

from __future__ import annotations

import ast
import re
from dataclasses import replace
from functools import reduce as fold_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..functions.complex import Pair
from ..spec import Axis

MODES = {"scalar": 1, "stokes": 4, "stokes_i": 1, "coherence": 4, "jones": 2}


def detect(tf: TensorFrame, mode: str, axis: int | str | None = None) -> TensorFrame:
    """Power of complex voltages: ``scalar``, or of two polarisations.

    ``stokes`` gives I, Q, U, V; ``stokes_i`` I; ``coherence`` xx, yy and the
    parts of conj(x) y; ``jones`` the complex pair (xx + i yy, x conj(y)).
    Without a polarisation axis of size 2 the power of each element.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if not tf.spec.dtype.is_complex:
        raise ValueError("only complex streams can be detected")
    if axis is None and "pol" in tf.spec.labels:
        axis = "pol"
    if mode == "scalar" or axis is None or tf.spec.axis(axis).size == 1:
        return tf.with_values(Pair(*[F.col(c).cast("double") for c in tf.values]).mag2(), "f32")
    pol = tf.spec.axis(axis)
    if pol.size != 2:
        raise ValueError(f"axis {pol.label!r} has size {pol.size}, not 2")

    def of(k: int) -> list[Column]:
        return [F.max(F.when(F.col(pol.label) == k, F.col(c).cast("double"))).alias(f"{c}{k}") for c in tf.values]

    both = tf.df.groupBy(*tf.over(axis)).agg(*of(0), *of(1))
    x, y = Pair(F.col("re0"), F.col("im0")), Pair(F.col("re1"), F.col("im1"))
    xx, yy, xy = x.mag2().re, y.mag2().re, x * y.conj()
    out = {
        "stokes": [Pair(xx + yy), Pair(xx - yy), Pair(2 * xy.re), Pair(-2 * xy.im)],
        "stokes_i": [Pair(xx + yy)],
        "coherence": [Pair(xx), Pair(yy), Pair(xy.re), Pair(-xy.im)],
        "jones": [Pair(xx, yy), xy],
    }[mode]
    made = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), p.re.alias("re"), p.imag.alias("im")) for k, p in enumerate(out)])
    rows = both.withColumn("__d", F.explode(made)).withColumn(pol.label, F.col("__d.k"))
    names = tuple("IQUV"[: len(out)]) if mode.startswith("stokes") else None
    spec = tf.spec.with_axis(axis, Axis(pol.label, len(out), categories=names))
    if mode == "jones":
        return TensorFrame(rows.withColumns({"re": F.col("__d.re"), "im": F.col("__d.im")}), spec.with_dtype("cf32"), tf.keys)
    return TensorFrame(rows.withColumn("value", F.col("__d.re")), spec.with_dtype("f32"), tf.keys)


def matrix_fill(tf: TensorFrame, i: str = "station_i", p: str = "pol_i", j: str = "station_j", q: str = "pol_j") -> TensorFrame:
    """All visibilities from the lower triangle: the rest is its conjugate."""
    n = tf.spec.axis(p).size
    row, col = F.col(i) * n + F.col(p), F.col(j) * n + F.col(q)
    lower = tf.df.where(row >= col)
    other = lower.where(row > col).withColumns({i: F.col(j), p: F.col(q), j: F.col(i), q: F.col(p), "im": -F.col("im")})
    return TensorFrame(lower.unionByName(other), tf.spec, tf.keys)


def to_storage(tf: TensorFrame, i: str = "station_i", p: str = "pol_i", j: str = "station_j", q: str = "pol_j") -> TensorFrame:
    """Filled visibilities as baselines ``i (i + 1) / 2 + j`` with Stokes I, Q, U, V."""
    keys = tf.over(i, p, j, q)

    def of(a: int, b: int) -> list[Column]:
        return [F.max(F.when((F.col(p) == a) & (F.col(q) == b), F.col(c))).alias(f"{c}{a}{b}") for c in ("re", "im")]

    base = (F.expr(f"`{i}` * (`{i}` + 1) div 2") + F.col(j)).alias("baseline")
    rows = tf.df.where(F.col(i) >= F.col(j)).groupBy(*keys, base).agg(*of(0, 0), *of(0, 1), *of(1, 0), *of(1, 1))
    xx, xy, yx, yy = (Pair(F.col(f"re{a}"), F.col(f"im{a}")) for a in ("00", "01", "10", "11"))
    d = xy - yx
    made = [xx + yy, xx - yy, xy + yx, Pair(-d.im, d.re)]
    stokes = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), v.re.alias("re"), v.im.alias("im")) for k, v in enumerate(made)]))
    df = rows.withColumn("__s", stokes).withColumns({"stokes": F.col("__s.k"), "re": F.col("__s.re"), "im": F.col("__s.im")})
    n = tf.spec.axis(i).size
    kept = tuple(a for a in tf.spec.axes if a.label not in (i, p, j, q))
    axes = (*kept[:1], Axis("baseline", n * (n + 1) // 2), *kept[1:], Axis("stokes", 4, categories=tuple("IQUV")))
    return TensorFrame(df, replace(tf.spec, axes=axes), tf.keys)


def from_storage(tf: TensorFrame) -> TensorFrame:
    """Baselines with Stokes parameters as filled visibilities."""
    keys = tf.over("baseline", "stokes")

    def of(k: int) -> list[Column]:
        return [F.max(F.when(F.col("stokes") == k, F.col(c))).alias(f"{c}{k}") for c in ("re", "im")]

    rows = tf.df.groupBy(*keys, "baseline").agg(*of(0), *of(1), *of(2), *of(3))
    # the row of a baseline number, made exact where the root was rounded
    guess = F.floor((F.sqrt(8.0 * F.col("baseline") + 1) - 1) / 2).cast("bigint")
    rows = rows.withColumn("__i", guess)
    rows = rows.withColumn("__i", F.when(F.expr("(__i + 1) * (__i + 2) div 2 <= baseline"), F.col("__i") + 1).when(F.expr("__i * (__i + 1) div 2 > baseline"), F.col("__i") - 1).otherwise(F.col("__i")))
    rows = rows.withColumn("__j", F.expr("baseline - __i * (__i + 1) div 2"))
    s = [Pair(F.col(f"re{k}"), F.col(f"im{k}")) for k in range(4)]
    half, i_v = F.lit(0.5), Pair(-s[3].im, s[3].re)
    made = [(0, 0, (s[0] + s[1]) * half), (0, 1, (s[2] - i_v) * half), (1, 0, (s[2] + i_v) * half), (1, 1, (s[0] - s[1]) * half)]
    cells = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("p"), F.lit(b).cast("bigint").alias("q"), v.re.alias("re"), v.im.alias("im")) for a, b, v in made]))
    low = rows.withColumn("__c", cells).select(*keys, F.col("__i").alias("station_i"), F.col("__c.p").alias("pol_i"), F.col("__j").alias("station_j"), F.col("__c.q").alias("pol_j"), F.col("__c.re").alias("re"), F.col("__c.im").alias("im"))
    n = int(((8 * tf.spec.axis("baseline").size + 1) ** 0.5 - 1) / 2 + 0.5)
    kept = [a for a in tf.spec.axes if a.label not in ("baseline", "stokes")]
    axes = (*kept, Axis("station_i", n), Axis("pol_i", 2), Axis("station_j", n), Axis("pol_j", 2))
    return matrix_fill(TensorFrame(low, replace(tf.spec, axes=axes), tf.keys))


def zip_streams(*frames: TensorFrame) -> DataFrame:
    """Streams side by side, place by place; where one ends, all end.

    The value columns of stream ``n`` get the suffix ``_n``.
    """
    index = frames[0].index
    out = [tf.df.select(*index, *[F.col(c).alias(f"{c}_{n}") for c in tf.values]) for n, tf in enumerate(frames)]
    return fold_left(lambda a, b: a.join(b, index), out)


def multi_add(*frames: TensorFrame) -> TensorFrame:
    """The sum of streams of one shape."""
    first = frames[0]
    if any(tf.spec.labels != first.spec.labels or tf.spec.dtype.is_complex != first.spec.dtype.is_complex for tf in frames):
        raise ValueError("streams of different axes or kinds")
    rows = zip_streams(*frames)
    sums = {c: fold_left(lambda a, b: a + b, [F.col(f"{c}_{n}") for n in range(len(frames))]) for c in first.values}
    return TensorFrame(rows.withColumns(sums), first.spec, first.keys)


_STATEMENT = re.compile(r"^\s*(\w+)\s*(?:\(([^)]*)\))?\s*=(?!=)(.*)$", re.S)
_CALLS = {"abs": F.abs, "sqrt": F.sqrt, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "rintf": F.rint}
_METHODS = {"conj": Pair.conj, "mag2": Pair.mag2, "mag": Pair.mag, "phase": Pair.phase, "exp": Pair.exp}


def map_expression(statement: str, frames: dict[str, TensorFrame], scalars: dict[str, float | complex] | None = None) -> TensorFrame:
    """A statement such as ``c = a + b`` or ``c(i, j) = a(i) * b(j - 1)``.

    Without places, streams are aligned at their last axes and axes of size 1
    are spread.  With places, a place is an axis name of the result, with a
    constant added or negated; negative places count from the end.  Operators,
    comparisons, ``?:`` as ``x if y else z``, the methods conj, mag2, mag,
    phase and exp, ``.real`` and ``.imag`` and usual functions are expressions
    that Spark compiles; different references are joined on shared axes.
    """
    m = _STATEMENT.match(statement)
    if not m:
        raise ValueError(f"not a statement: {statement!r}")
    _, places, right = m.groups()
    tree = ast.parse(right.strip(), mode="eval").body
    scalars = scalars or {}
    explicit = [x.strip() for x in places.split(",")] if places else None
    widest = max(frames.values(), key=lambda tf: len(tf.spec.axes))
    sides: dict[tuple, DataFrame] = {}
    sizes: dict[str, Axis] = {}

    def reference(name: str, args: list[ast.expr] | None) -> Pair:
        tf = frames[name]
        axes = tf.spec.axes
        if args is None:
            names = widest.spec.labels[len(widest.spec.axes) - len(axes) :]
            spots = [(n, 1, 0) if a.size != 1 or widest.spec.axis(n).size == 1 else None for n, a in zip(names, axes, strict=True)]
        else:
            spots = [_spot(a) for a in args]
        key = (name, *spots)
        tag = f"__{len(sides)}" if key not in sides else next(f"__{k}" for k, x in enumerate(sides) if x == key)
        if key not in sides:
            select = []
            for axis, spot in zip(axes, spots, strict=True):
                if spot is None:
                    continue
                label, sign, shift = spot
                k = F.col(axis.label) - shift if sign > 0 else shift - F.col(axis.label)
                select.append((k if axis.is_frame else F.pmod(k, F.lit(axis.size))).cast("bigint").alias(label))
                sizes.setdefault(label, replace(axis, label=label))
            sides[key] = tf.df.select(*tf.keys, *select, *[F.col(c).alias(f"{tag}_{c}") for c in tf.values])
        return Pair(*[F.col(f"{tag}_{c}") for c in tf.values])

    def value(node: ast.expr) -> Pair:
        if isinstance(node, ast.Constant):
            return Pair.of(node.value)
        if isinstance(node, ast.Name):
            return reference(node.id, None) if node.id in frames else Pair.of(scalars[node.id])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Mod):
                return Pair(a.re % b.re)
            if isinstance(node.op, ast.FloorDiv):  # truncates towards zero
                return Pair(F.call_function("div", a.re, b.re))
            return {ast.Add: a.__add__, ast.Sub: a.__sub__, ast.Mult: a.__mul__, ast.Div: a.__truediv__}[type(node.op)](b)
        if isinstance(node, ast.Compare):
            a, b = value(node.left), value(node.comparators[0])
            test = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}[type(node.ops[0])]
            return Pair(getattr(a.re, f"__{test}__")(b.re))
        if isinstance(node, ast.IfExp):
            test, a, b = value(node.test).re, value(node.body), value(node.orelse)
            im = None if a.im is None and b.im is None else F.when(test, a.imag).otherwise(b.imag)
            return Pair(F.when(test, a.re).otherwise(b.re), im)
        if isinstance(node, ast.Attribute):
            found = value(node.value)
            return Pair(found.re if node.attr == "real" else found.imag)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            return _METHODS[node.func.attr](value(node.func.value))
        if isinstance(node, ast.Call):
            name = node.func.id
            if name in frames:
                return reference(name, node.args)
            args = [value(a) for a in node.args]
            if name in _METHODS:
                return _METHODS[name](args[0])
            if name in ("pow", "atan2", "min", "max"):
                return Pair({"pow": F.pow, "atan2": F.atan2, "min": F.least, "max": F.greatest}[name](args[0].re, args[1].re))
            return Pair(_CALLS[name](args[0].re))
        raise ValueError(f"cannot map {ast.unparse(node)!r}")

    result = value(tree)
    labels = explicit or widest.spec.labels
    keys = tuple(dict.fromkeys(k for name, *_ in sides for k in frames[name].keys))
    rows = None
    for side in sorted(sides.values(), key=lambda d: -len(d.columns)):
        shared = [c for c in [*keys, *labels] if rows is not None and c in rows.columns and c in side.columns]
        rows = side if rows is None else rows.join(side, shared) if shared else rows.crossJoin(side)
    dtype = "f64" if result.im is None else "cf64"
    values = {"value": result.re} if result.im is None else {"re": result.re, "im": result.im}
    spec = replace(widest.spec.with_dtype(dtype), axes=tuple(sizes[n] for n in labels))
    return TensorFrame(rows.select(*keys, *labels, *[x.cast("double").alias(c) for c, x in values.items()]), spec, keys)


def map_statements(text: str, frames: dict[str, TensorFrame], scalars: dict[str, float | complex] | None = None) -> dict[str, TensorFrame]:
    """Statements separated by ``;`` or lines; each may use what those before it made."""
    known = dict(frames)
    for statement in re.split(r"[;\n]", text):
        if statement.strip():
            name = _STATEMENT.match(statement)
            if not name:
                raise ValueError(f"not a statement: {statement!r}")
            known[name[1]] = map_expression(statement, known, scalars)
    return {k: v for k, v in known.items() if k not in frames or v is not frames[k]}


def assign_part(statement: str, target: TensorFrame, frames: dict[str, TensorFrame], scalars: dict[str, float | complex] | None = None) -> TensorFrame:
    """``target`` after a statement such as ``a(i, k + 4) = b(i, k)``: places that it does not name keep their elements.

    On the left a place is an axis name of the target, with a constant added.
    """
    m = _STATEMENT.match(statement)
    if not m or not m[2]:
        raise ValueError(f"not a statement with places: {statement!r}")
    spots = [_spot(ast.parse(x.strip(), mode="eval").body) for x in m[2].split(",")]
    if any(sign < 0 for _, sign, _ in spots) or [n for n, *_ in spots] != target.spec.labels:
        raise ValueError(f"places on the left are {target.spec.labels}, moved by constants")
    made = map_expression(f"{m[1]}({', '.join(n for n, *_ in spots)}) = {m[3]}", frames, scalars)
    if made.spec.dtype.is_complex != target.spec.dtype.is_complex:
        raise ValueError("real and complex elements")
    new = made.df.withColumns({n: F.col(n) + shift for n, _, shift in spots})
    for axis in target.spec.axes:  # nothing is written beyond the target
        if not axis.is_frame:
            new = new.where(F.col(axis.label).between(0, axis.size - 1))
    moved = new.withColumnsRenamed({c: f"__{c}" for c in target.values})
    both = target.df.join(moved, target.index, "left").withColumn("__new", F.col(f"__{target.values[0]}").isNotNull())
    df = both.select(*target.index, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c).cast("double")).alias(c) for c in target.values])
    return TensorFrame(df, target.spec.with_dtype("cf64" if target.spec.dtype.is_complex else "f64"), target.keys)


def _spot(node: ast.expr) -> tuple[str, int, int]:
    """Axis, sign and constant of a place."""
    if isinstance(node, ast.Name):
        return node.id, 1, 0
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Name):
        return node.operand.id, -1, 0
    if isinstance(node, ast.BinOp) and isinstance(node.right, ast.Constant) and isinstance(node.op, ast.Add | ast.Sub):
        name, sign, shift = _spot(node.left)
        return name, sign, shift + (node.right.value if isinstance(node.op, ast.Add) else -node.right.value)
    raise ValueError(f"not a place: {ast.unparse(node)!r}")
