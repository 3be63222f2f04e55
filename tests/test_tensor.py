"""Tensor operators against numpy, headers, files, packets and streams."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.frame import TensorFrame
from tensorloom.functions.units import convert, inverse
from tensorloom.operators import codec, custom, dispersion, elementwise, fir, fourier, linalg, reduce, shape, views
from tensorloom.plans.pipeline import Block, Chain, Pipeline, PipelineInitError, scope, setting
from tensorloom.sources import files, headers, packets
from tensorloom.spec import Axis, DType, TensorSpec
from tensorloom.streaming import gulps, stateful


def frame_of(spark, x, labels, stream=0, dtype=None):
    """A tensor frame of an array."""
    where = np.indices(x.shape).reshape(x.ndim, -1)
    flat = x.ravel()
    parts = [flat.real, flat.imag] if np.iscomplexobj(x) else [flat]
    rows = [tuple(int(v) for v in place) + tuple(float(v) for v in values) for *place, in zip(*where, strict=True) for values in [()]]
    rows = [r + tuple(float(p[i]) for p in parts) for i, r in enumerate(rows)]
    names = ["re", "im"] if np.iscomplexobj(x) else ["value"]
    df = spark.createDataFrame(rows, ", ".join([f"{n} long" for n in labels] + [f"{n} double" for n in names]))
    axes = [Axis(n, -1 if k == stream else x.shape[k]) for k, n in enumerate(labels)]
    return TensorFrame(df, TensorSpec.of(dtype or ("cf64" if np.iscomplexobj(x) else "f64"), *axes))


def array_of(tf, shape_):
    rows = tf.df.toPandas()
    out = np.full(shape_, np.nan, complex if "re" in rows else float)
    out[tuple(rows[n].to_numpy() for n in tf.spec.labels)] = rows["re"] + 1j * rows["im"] if "re" in rows else rows["value"]
    return out


RNG = np.random.default_rng(1234)


def test_types_and_specs():
    assert str(DType.of("ci8").as_floating_point()) == "cf32" and str(DType.of("i32").as_floating_point()) == "f64"
    assert DType.of("i4").bounds() == (-7, 7) and DType.of("u8").bounds() == (0, 255) and DType.of("u16").sql() == "int"
    for bad in ("i3", "x8", "f8"):
        with pytest.raises(ValueError):
            DType.of(bad)
    with pytest.raises(ValueError):
        TensorSpec.of("f32", Axis("a", 3))
    spec = TensorSpec.of("f32", Axis("time", -1, 5.0, 0.1, "s"), Axis("pol", 2, categories=("X", "Y")), name="obs")
    assert TensorSpec.from_json(spec.to_json()) == spec and "stream" in spec.pretty()
    assert convert(1.5, "GHz", "MHz") == 1500 and inverse("s") == "Hz" and inverse("m") == "m^-1"
    with pytest.raises(ValueError):
        convert(1, "s", "Hz")


def test_views(spark):
    x = RNG.normal(size=(4, 6, 10))
    tf = frame_of(spark, x, ["t", "a", "b"])
    split = views.split_axis(tf, "b", 5)
    assert np.array_equal(array_of(split, (4, 6, 2, 5)), x.reshape(4, 6, 2, 5)) and split.spec.axis("b").step == 5
    assert np.array_equal(array_of(views.merge_axes(split, "b", "b_split"), (4, 6, 10)), x)
    with pytest.raises(ValueError):
        views.split_axis(tf, "b", 3)
    with pytest.raises(ValueError):
        views.merge_axes(tf, "t", "b")
    added = views.add_axis(tf, "a", "beam")
    assert added.spec.labels == ["t", "a", "beam", "b"]
    assert views.add_axis(tf, -1, "beam").spec.labels == ["t", "a", "b", "beam"]
    assert views.delete_axis(added, "beam").spec.labels == tf.spec.labels
    with pytest.raises(ValueError):
        views.delete_axis(tf, "a")
    assert views.reverse_scale(tf, 1).spec.axes[1].step == views.reverse_scale(tf, "a").spec.axes[1].step == -1


def test_shape(spark):
    x = RNG.normal(size=(3, 5, 8))
    tf = frame_of(spark, x, ["t", "a", "b"])
    assert np.array_equal(array_of(shape.transpose(tf, ["b", "t", "a"]), (8, 3, 5)), x.transpose(2, 0, 1))
    for axes in (["a"], ["b"], ["a", "b"]):
        places = [1 + "ab".index(a) for a in axes]
        assert np.array_equal(array_of(shape.fftshift(tf, axes), x.shape), np.fft.fftshift(x, places))
        assert np.array_equal(array_of(shape.fftshift(shape.fftshift(tf, axes), axes, inverse=True), x.shape), x)
    assert np.array_equal(array_of(shape.reverse(tf, ["b"]), x.shape), np.roll(x[..., ::-1], 1, 2))
    assert np.array_equal(array_of(shape.reverse(tf, ["b"], circular=False), x.shape), x[..., ::-1])
    assert np.array_equal(array_of(shape.slice_axis(tf, "b", 1, 8, 3), (3, 5, 3)), x[..., 1:8:3])
    with pytest.raises(KeyError):
        shape.reverse(tf, ["t"])


@pytest.mark.parametrize("op", ["sum", "mean", "min", "max", "stderr", "pwrsum", "pwrmean", "pwrmin", "pwrmax", "pwrstderr"])
def test_reduce(spark, op):
    x = RNG.integers(-126, 127, (3, 6, 20)).astype(float)
    power, name = op.startswith("pwr"), op.removeprefix("pwr")
    how = {"sum": np.sum, "mean": np.mean, "min": np.min, "max": np.max, "stderr": lambda v, axis: v.sum(axis=axis) / np.sqrt(v.shape[axis])}[name]
    y = x**2 if power else x
    assert np.allclose(array_of(reduce.reduce(frame_of(spark, x, ["t", "a", "b"]), "b", 5, op), (3, 6, 4)), how(y.reshape(3, 6, 4, 5), axis=3))
    z = x + 1j * x[::-1]
    tf = frame_of(spark, z, ["t", "a", "b"])
    if not power and name in ("min", "max"):
        with pytest.raises(ValueError):
            reduce.reduce(tf, "b", 5, op)
    else:
        y = np.abs(z) ** 2 if power else z
        assert np.allclose(array_of(reduce.reduce(tf, "a", None, op), (3, 1, 20))[:, 0], how(y, axis=1))


def test_integrations(spark):
    x = RNG.normal(size=(23, 3))
    tf = frame_of(spark, x, ["t", "a"])
    assert np.allclose(array_of(reduce.accumulate(tf, 5), (4, 3)), x[:20].reshape(4, 5, 3).sum(1))
    assert np.allclose(array_of(reduce.scrunch(tf, 5, keep_partial=True), (5, 3))[4], x[20:].mean(0))
    assert np.allclose(array_of(reduce.prefix_scan(tf, "a"), x.shape), x.cumsum(1))
    with pytest.raises(ValueError):
        reduce.reduce(tf, "a", 2)


def test_quantize_and_pack(spark):
    values = np.array([[0.4, 0.5, 1.5, 2.5, -0.5, -1.5, 300.0, -300.0]])
    out = array_of(codec.quantize(frame_of(spark, values, ["t", "k"]), "i8"), values.shape)
    assert out.tolist() == [[0, 0, 2, 2, 0, -2, 127, -127]]
    for dtype, order in (("i4", "msb"), ("i2", "lsb"), ("u1", "msb"), ("u4", "lsb")):
        d = DType.of(dtype)
        low, high = (-(2 ** (d.nbit - 1)) if d.is_signed else 0), 2 ** (d.nbit - d.is_signed) - 1
        x = RNG.integers(low, high + 1, (5, 16)).astype(float)
        packed = codec.pack(frame_of(spark, x, ["t", "k"], dtype=dtype), order)
        assert np.array_equal(array_of(codec.unpack(packed, dtype, order), x.shape), x)


def test_detect(spark):
    z = RNG.normal(size=(4, 3, 2)) + 1j * RNG.normal(size=(4, 3, 2))
    tf, x, y = frame_of(spark, z, ["t", "f", "pol"]), z[..., 0], z[..., 1]
    gold = {
        "stokes": [abs(x) ** 2 + abs(y) ** 2, abs(x) ** 2 - abs(y) ** 2, 2 * (x * y.conj()).real, -2 * (x * y.conj()).imag],
        "stokes_i": [abs(x) ** 2 + abs(y) ** 2],
        "coherence": [abs(x) ** 2, abs(y) ** 2, (x.conj() * y).real, (x.conj() * y).imag],
        "jones": [abs(x) ** 2 + 1j * abs(y) ** 2, x * y.conj()],
    }
    for mode, parts in gold.items():
        assert np.allclose(array_of(elementwise.detect(tf, mode), (4, 3, len(parts))), np.stack(parts, -1))
    assert np.allclose(array_of(elementwise.detect(tf, "scalar"), z.shape), abs(z) ** 2)
    with pytest.raises(ValueError):
        elementwise.detect(tf, "other")


def test_map(spark):
    a, b = RNG.normal(size=(4, 5)), RNG.normal(size=(4, 5))
    fa, fb = frame_of(spark, a, ["t", "k"]), frame_of(spark, b, ["t", "k"])
    m = elementwise.map_expression
    assert np.allclose(array_of(m("c = (a + 2 * b) / (1 + abs(b))", {"a": fa, "b": fb}), a.shape), (a + 2 * b) / (1 + abs(b)))
    assert np.allclose(array_of(m("c(t, k) = a(t, k + 1) - a(t, -k)", {"a": fa}), a.shape), np.roll(a, -1, 1) - np.roll(a[:, ::-1], 1, 1))
    z = a + 1j * b
    fz = frame_of(spark, z, ["t", "k"])
    assert np.allclose(array_of(m("c = a.conj() * a / (2 + a.mag())", {"a": fz}), a.shape), z.conj() * z / (2 + abs(z)))
    assert np.allclose(array_of(m("c = exp(a) * w", {"a": fz}, {"w": 1 - 2j}), a.shape), np.exp(z) * (1 - 2j))
    assert np.allclose(array_of(m("c = a.phase()", {"a": fz}), a.shape), np.angle(z))


@pytest.mark.parametrize("n", [1, 5, 8, 33])
def test_fft(spark, n):
    x = RNG.normal(size=(3, n))
    z = x + 1j * RNG.normal(size=(3, n))
    fx, fz = frame_of(spark, x, ["t", "k"]), frame_of(spark, z, ["t", "k"])
    assert np.allclose(array_of(fourier.fft(fz, ["k"]), z.shape), np.fft.fft(z))
    assert np.allclose(array_of(fourier.dft(fz, "k"), z.shape), np.fft.fft(z))
    assert np.allclose(array_of(fourier.fft(fz, ["k"], inverse=True), z.shape), np.fft.ifft(z) * n)
    assert np.allclose(array_of(fourier.fft(fx, ["k"]), (3, n // 2 + 1)), np.fft.rfft(x))
    assert np.allclose(array_of(fourier.fft(fz, ["k"], apply_fftshift=True), z.shape), np.fft.fftshift(np.fft.fft(z), 1))


def test_fft_axes_and_scale(spark):
    z = RNG.normal(size=(2, 4, 6)) + 1j * RNG.normal(size=(2, 4, 6))
    assert np.allclose(array_of(fourier.fft(frame_of(spark, z, ["t", "a", "b"]), ["a", "b"]), z.shape), np.fft.fftn(z, axes=(1, 2)))
    x = RNG.integers(-127, 128, (2, 8)).astype(float)
    assert np.allclose(array_of(fourier.fft(frame_of(spark, x, ["t", "k"], dtype="i8"), ["k"]), (2, 5)), np.fft.rfft(x / 128))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.integers(1, 3))
def test_fir(spark, taps, decim):
    x = RNG.normal(size=(20, 2))
    gold = np.stack([np.correlate(np.concatenate((np.zeros(len(taps) - 1), x[:, k])), taps, "valid") for k in range(2)], 1)
    got = array_of(fir.fir(frame_of(spark, x, ["t", "k"]), taps, decim), (-(-20 // decim), 2))
    assert np.allclose(got, gold[::decim])


def test_fdmt_finds_a_pulse(spark):
    nchan, delay, at = 16, 12, 20
    axis = Axis("freq", nchan, 1000.0, 25.0, "MHz")
    x = np.zeros((48, nchan))
    top = 1000.0 + nchan * 25.0
    for c in range(nchan):  # the pulse arrives later at lower frequencies
        f = 1000.0 + (c + 0.5) * 25
        x[at + round((delay - 1) * (f**-2 - top**-2) / (1000.0**-2 - top**-2)), c] = 1
    tf = frame_of(spark, x, ["time", "freq"])
    tf = TensorFrame(tf.df, tf.spec.with_axis("freq", axis))
    out = dispersion.fdmt(tf, "freq", delay).df.toPandas()
    best = out.loc[out["value"].idxmax()]
    assert best["dispersion"] >= delay - 3 and best["value"] > 3 * out[out.dispersion == 0]["value"].max()
    flat = dispersion.fdmt(TensorFrame(tf.df.withColumn("value", F.lit(1.0)), tf.spec), "freq", delay).df
    assert np.allclose(flat.toPandas()["value"], nchan)


def test_products(spark):
    a, b = (RNG.normal(size=s) + 1j * RNG.normal(size=s) for s in ((4, 7), (7, 3)))
    fa, fb = frame_of(spark, a, ["i", "k"], 0), frame_of(spark, b, ["k", "j"], 1)
    fb = TensorFrame(fb.df, fb.spec)
    assert np.allclose(array_of(linalg.matmul(fa, fb, "k", 2.0), (4, 3)), 2 * a @ b)
    low = array_of(linalg.matmul_aah(frame_of(spark, a, ["i", "k"], 1), "i", "k"), (4, 4))
    i, j = np.tril_indices(4)
    assert np.allclose(low[i, j], (a @ a.conj().T)[i, j])


def test_grid(spark):
    rng = random.Random(0)
    pts = [(rng.randrange(12), rng.randrange(12), rng.random(), rng.random()) for _ in range(60)]
    k = RNG.normal(size=(3, 3)) + 1j * RNG.normal(size=(3, 3))
    gold = np.zeros((12, 12), complex)
    for x, y, re, im in pts:
        for v in range(3):
            for u in range(3):
                if x + u < 12 and y + v < 12:
                    gold[y + v, x + u] += np.conj(k[v, u]) * (re + 1j * im)
    kernel = spark.createDataFrame([(u, v, float(k[v, u].real), float(k[v, u].imag)) for u in range(3) for v in range(3)], "u long, v long, re double, im double")
    got = np.zeros((12, 12), complex)
    for r in linalg.grid(spark.createDataFrame(pts, "x long, y long, re double, im double"), kernel, 12).collect():
        got[r.y, r.x] = r.re + 1j * r.im
    assert np.allclose(got, gold)


def test_correlate(spark):
    z = RNG.integers(-20, 20, (6, 2, 3, 2)) + 1j * RNG.integers(-20, 20, (6, 2, 3, 2))
    out = elementwise.matrix_fill(reduce.correlate(frame_of(spark, z, ["time", "freq", "station", "pol"]), 3))
    gold = np.einsum("tnfip,tnfjq->tfipjq", z.conj().reshape(2, 3, 2, 3, 2), z.reshape(2, 3, 2, 3, 2))
    assert np.allclose(array_of(out, gold.shape), gold)
    assert np.allclose(array_of(elementwise.from_storage(elementwise.to_storage(out)), gold.shape), gold)


@pytest.mark.parametrize("dtype", ["u8", "i16", "f32"])
def test_sigproc_files(spark, tmp_path, dtype):
    x = RNG.integers(0, 100, (50, 2, 4)).astype(float)
    tf = frame_of(spark, x, ["time", "pol", "freq"], dtype=dtype)
    spec = tf.spec.with_axis("time", Axis("time", -1, 1.5e9, 1e-3, "s")).with_axis("freq", Axis("freq", 4, 400.0, -0.5, "MHz"))
    written = files.write_sigproc(TensorFrame(tf.df, spec), str(tmp_path), "obs", 20).collect()
    assert len(written) == 3
    back = files.read_sigproc(spark, sorted(r.file for r in written), chunk=64)
    assert back.spec.axis("freq").step == -0.5 and back.spec.dtype == DType.of(dtype)
    one = TensorFrame(back.df.withColumn("time", F.col("time") + 20 * F.col("seq")), back.spec)
    assert np.array_equal(array_of(one, x.shape), x)


def test_other_files(spark, tmp_path):
    x = RNG.integers(-100, 100, (30, 2)).astype(float)
    tf = frame_of(spark, x, ["time", "pol"], dtype="i16")
    tf = TensorFrame(tf.df, tf.spec.with_axis("time", Axis("time", -1, 0.0, 1 / 8000, "s")))
    path = files.write_wav(tf, str(tmp_path), "sound").collect()[0].file
    back = files.read_wav(spark, [path])
    assert np.array_equal(array_of(TensorFrame(back.df, back.spec), x.shape), x) and back.spec.header["frame_rate"] == 8000
    path = files.write_binary(tf, str(tmp_path), "raw").collect()[0].file
    assert np.array_equal(array_of(TensorFrame(files.read_binary(spark, [path], 2, "i16").df, TensorSpec.of("i16", Axis("streamed", -1), Axis("gulped", 2))), x.shape), x)
    files.serialize(tf, str(tmp_path / "kept"))
    again = files.deserialize(spark, str(tmp_path / "kept"))
    assert again.spec == tf.spec and np.array_equal(array_of(again, x.shape), x)


def test_guppi(spark, tmp_path):
    x = RNG.integers(-100, 100, (3, 4, 8, 2, 2)).astype("i1")
    cards = {"OBSNCHAN": 4, "NPOL": 4, "NBITS": 8, "BLOCSIZE": x[0].nbytes, "TBIN": 1e-6, "OBSFREQ": 1400.0, "OBSBW": 4.0}
    head = "".join(f"{k:<8}= {v!r:>20}".ljust(80) for k, v in cards.items()).encode() + b"END".ljust(80)
    path = tmp_path / "v.raw"
    path.write_bytes(b"".join(head + b.tobytes() for b in x))
    tf = files.read_guppi(spark, [str(path)])
    got = array_of(TensorFrame(tf.df, tf.spec), (3, 4, 8, 2))
    assert np.array_equal(got, x[..., 0] + 1j * x[..., 1])


def test_voltage_files_of_many_blocks(spark, tmp_path):
    """Blocks share files, files share tasks, and long files are cut."""
    z = RNG.integers(-100, 100, (90, 2, 4, 2)) + 1j * RNG.integers(-100, 100, (90, 2, 4, 2))
    tf = frame_of(spark, z, ["time", "freq", "fine_time", "pol"], dtype="ci8")
    written = sorted(r.file for r in files.write_guppi(tf, str(tmp_path / "two"), "obs", 2).collect())
    assert len(written) == 45 > files.FEW
    back = files.read_guppi(spark, written)
    assert back.df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    one = TensorFrame(back.df.withColumn("time", F.col("time") + 2 * F.col("seq")), back.spec)
    assert np.array_equal(array_of(one, z.shape), z) and back.df.count() == z.size
    [whole] = [r.file for r in files.write_guppi(tf, str(tmp_path / "all"), "obs").collect()]
    back = files.read_guppi(spark, [whole], chunk=10_000)
    assert back.df.rdd.getNumPartitions() > 1
    assert np.array_equal(array_of(TensorFrame(back.df, back.spec), z.shape), z) and back.df.count() == z.size
    odd = tmp_path / "odd.raw"
    odd.write_bytes(open(whole, "rb").read().replace(b"NBITS   =                    8", b"NBITS   =                   16", 1))
    with pytest.raises(ValueError):
        files.read_guppi(spark, [whole, str(odd)])


def test_many_short_files_share_tasks(spark, tmp_path):
    x = RNG.integers(0, 100, (80, 2, 4)).astype(float)
    tf = frame_of(spark, x, ["time", "pol", "freq"], dtype="u8")
    back = files.read_sigproc(spark, sorted(r.file for r in files.write_sigproc(tf, str(tmp_path / "fil"), "obs", 2).collect()))
    assert back.df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    one = TensorFrame(back.df.withColumn("time", F.col("time") + 2 * F.col("seq")), back.spec)
    assert np.array_equal(array_of(one, x.shape), x)
    rows = spark.range(200).select("id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("packet"))
    paths = sorted(r.file for r in files.write_packets(rows, str(tmp_path / "pkt"), "p", "id", 4).collect())
    got = files.read_packets(spark, paths, 8)
    assert len(paths) == 50 and got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((r.file * 4 + r.number, int.from_bytes(r.packet, "big")) for r in got.collect()) == [(k, k) for k in range(200)]


def test_baseband_packets_and_text(spark, tmp_path):
    x = RNG.integers(-50, 50, (20, 3)).astype("i2")
    path = tmp_path / "b.dada"
    path.write_bytes(headers.make_dada({"NCHAN": 3}) + x.tobytes())
    tf = files.read_dada(spark, [str(path)], lambda h: TensorSpec.of("i16", Axis("time", -1), Axis("chan", h["NCHAN"])), chunk=12)
    assert np.array_equal(array_of(TensorFrame(tf.df, tf.spec), x.shape), x)
    path.write_bytes(bytes(range(100)) + b"tail")
    rows = files.read_packets(spark, [str(path)], 10, chunk=30).orderBy("number").collect()
    assert [bytes(r.packet) for r in rows] == [bytes(range(k, k + 10)) for k in range(0, 100, 10)]
    files.write_text(TensorFrame(tf.df.limit(0), tf.spec), str(tmp_path / "text"))


def test_custom(spark):
    x = RNG.normal(size=(11, 4))
    tf = custom.from_array(spark, x, TensorSpec.of("f64", Axis("t", -1), Axis("k", 4)))
    out = custom.apply_arrays(tf, 4, lambda a: a[:, ::2] * 2, TensorSpec.of("f64", Axis("t", -1), Axis("h", 2)))
    assert np.allclose(array_of(out, (11, 2)), x[:, ::2] * 2)
    table = custom.waterfall(tf, "k").orderBy("t").toPandas()
    assert np.allclose(table[["0", "1", "2", "3"]].to_numpy(), x)
    both = custom.spliced(tf, tf)
    assert both.keys == ("seq",) and both.df.count() == 88
    with pytest.raises(ValueError):
        custom.from_array(spark, x, TensorSpec.of("f64", Axis("t", -1)))


def test_headers():
    h = {"nchans": 4, "nifs": 1, "nbits": 8, "fch1": 400.0, "foff": -1.0, "tstart": 58000.0, "tsamp": 1e-3, "source_name": "B0329"}
    data = headers.make_sigproc(h)
    assert headers.parse_sigproc(data + b"xx") == (h, len(data)) and headers.header_is_standard(h)
    assert not headers.header_is_standard(h | {"nchans": 0}) and not headers.header_is_standard({})
    dada = headers.make_dada({"FREQ": 1.5, "NCHAN": 4, "SOURCE": "X"})
    assert len(dada) == 4096 and headers.parse_dada(dada) == {"HDR_SIZE": 4096, "FREQ": 1.5, "NCHAN": 4, "SOURCE": "X"}


@pytest.mark.parametrize("fmt", ["simple", "chips", "ibeam", "pbeam", "snap2", "tbn", "drx", "drx8"])
def test_packets(spark, fmt):
    rows = spark.range(20).select(F.col("id"), F.concat(F.lit(b"\x12\xf0"), F.lit(b"\x7f\x81")).alias("payload"))
    i = F.col("id")
    values = {
        "simple": {"seq": i}, "chips": {"seq": i + 1, "roach": i % 4 + 1}, "ibeam": {"seq": i + 1, "server": i % 4 + 1},
        "pbeam": {"seq": i * 24, "navg": 24, "beam": 0, "server": i % 4 + 1, "nserver": 4}, "snap2": {"seq": i, "npol": 32, "npol_tot": 64, "nchan": 8, "nchan_tot": 16, "pol0": (i % 2) * 32, "chan_block_id": F.call_function("div", i % 4, F.lit(2))},
        "tbn": {"time_tag": i * 512, "tbn_id": i % 4 + 1}, "drx": {"time_tag": i * 40960 + 5, "time_offset": 5, "decimation": 10, "frame_count_word": ((i % 2) * 128 + (F.call_function("div", i % 4, F.lit(2)) + 1) * 8 + 1) * 2**24},
    }
    made = packets.encode(rows, fmt, values[fmt.replace("drx8", "drx")])
    got = packets.decode(made, fmt, 4).orderBy("id").collect()
    assert [r.seq for r in got] == list(range(20)) and all(r.valid for r in got)
    assert [r.src for r in got] == [0 if fmt == "simple" else k % 4 for k in range(20)]
    assert bytes(got[0].payload) == b"\x12\xf0\x7f\x81"
    assert packets.decode(made, fmt, 2).where("valid").count() == {"simple": 20, "snap2": 0}.get(fmt, 10)
    assert not packets.decode(spark.createDataFrame([(bytearray(b"x"),)], "packet binary"), fmt, 4).head().valid
    if fmt in ("tbn", "drx", "drx8"):
        cells = packets.samples(packets.decode(made, fmt, 4), fmt).where("seq = 0").orderBy("sample").collect()
        assert [(c.re, c.im) for c in cells] == ([(1, 2), (-1, 0), (7, -1), (-8, 1)] if fmt == "drx" else [(18, -16), (127, -127)])


def test_baseline_and_word_packets(spark):
    pairs = [(a, b) for a in range(4) for b in range(a, 4)]
    rows = spark.createDataFrame([(k, a + 1, b + 1, bytearray(b"xy")) for k, (a, b) in enumerate(pairs)], "id long, a long, b long, payload binary")
    made = packets.encode(rows, "cor", {"stand0": F.col("a"), "stand1": F.col("b"), "navg": 100, "time_tag": F.col("id") * 196_000_000, "frame_count_word": F.lit(1 * 256 + 1)})
    got = packets.decode(made, "cor", len(pairs), 1).orderBy("id").collect()
    assert [(r.seq, r.src, r.valid) for r in got] == [(k, k, True) for k in range(len(pairs))]
    words = [(5 | 0 << 30, 7 | 3 << 24, 4 | 1 << 24, 9 | 2 << 16 | 7 << 26), (5 | 1 << 31, 0, 0, 0)]
    frames = [(k, bytearray(b"".join(w.to_bytes(4, "little") for w in ws) + bytes(16) + b"data")) for k, ws in enumerate(words)]
    got = packets.decode(spark.createDataFrame(frames, "id long, packet binary"), "vdif", 4, decimation=100).orderBy("id").collect()
    assert (got[0].seq, got[0].src, got[0].valid, bytes(got[0].payload)) == (507, 2, True, b"data") and not got[1].valid


def test_gulps(spark):
    rows = spark.range(50).select(F.col("id").alias("frame"))
    got = {(r.frame, r.gulp) for r in gulps.overlapping_gulps(rows, "frame", 10, 6).collect()}
    assert got == {(f, g) for f in range(50) for g in range(20) if 6 * g <= f < 6 * g + 10}
    with pytest.raises(ValueError):
        gulps.overlapping_gulps(rows, "frame", 4, 6)


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(lane, frame, float(rng.randrange(100))) for lane in range(3) for frame in range(40)]
    for k in range(4):
        part = [r for r in rows if r[1] // 10 == k]
        spark.createDataFrame(part, "lane long, frame long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, "lane long, frame long, value double")
    tf = TensorFrame(batch, TensorSpec.of("f64", Axis("frame", -1), Axis("lane", 3)))
    taps = [1.0, -1.0, 2.0]
    gold = {
        "acc": reduce.accumulate(tf, 7).df, "fir": fir.fir(tf, taps).df,
    }
    for name, op in {"acc": lambda s: stateful.accumulate_stream(s, 7), "fir": lambda s: stateful.fir_stream(s, taps), "run": stateful.running}.items():
        stream = spark.readStream.schema("lane long, frame long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = op(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r.lane, r.frame, r.value) for r in spark.table(name).collect())
        if name == "run":
            total = {k: 0.0 for k in range(3)}
            want = []
            for lane, frame, v in sorted(rows):
                total[lane] += v
                want.append((lane, frame, total[lane]))
        else:
            want = sorted((r.lane, r.frame, r.value) for r in gold[name].collect())
        assert got == want


def test_pipeline(spark):
    x = RNG.normal(size=(12, 8))
    p = Pipeline()
    a = p.source(frame_of(spark, x, ["t", "k"]))
    b = p.block(views.split_axis, a, n=4, axis="k", label="fine")
    c = p.block(reduce.reduce, b, axis="fine")

    class Twice(Block):
        def on_data(self, tf):
            return tf.with_values(tf.pair * 2, "f64")

    d = p.add(Twice("twice", (c,)))
    p.sink(d, lambda tf: array_of(tf, (12, 2, 1)))
    assert np.allclose(p.run()[0][..., 0], 2 * x.reshape(12, 2, 4).sum(2)) and "b2 -> b3" in p.dot_graph()
    p.block(reduce.reduce, a, axis="k", factor=3)
    with pytest.raises(PipelineInitError):
        p.check()
    with scope(gulp=5), scope(core=1):
        assert setting("gulp") == 5
    assert setting("gulp") is None
    assert np.allclose(array_of(Chain(frame_of(spark, x, ["t", "k"])).reduce("k").frame, (12, 1))[:, 0], x.sum(1))


def test_every_query_has_an_oracle():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert [n for n in queries if n not in oracles and not n.startswith("op") and n != "pipeline"] == []


def fdmt_gold(x, f0, df, max_delay):
    """By the definition, top down: a row is its lower part plus its upper part, shifted."""
    nchan, ntime = x.shape
    lag = lambda c: (f0 + df * c) ** -2.0
    whole = lag(0) - lag(nchan - 1)
    half_up = lambda v: int(np.floor(v + 0.5))
    levels = [[(c, 1) for c in range(nchan)]]  # first channel and size of the bands of each step
    while len(levels[-1]) > 1:
        own, n = levels[-1], len(levels)
        lead = own[:1] if len(own) % 2 and n % 2 == 0 else []
        rest = own[len(lead) :]
        levels.append(lead + [(rest[k][0], sum(s for _, s in rest[k : k + 2])) for k in range(0, len(rest), 2)])

    def rows(level, first, size):
        a, b = (first - 0.5, first + 0.5) if level == 0 else (first, first + size - 1)
        return int(np.ceil((lag(a) - lag(b)) / whole * (max_delay - 1))) + 1

    def value(level, band, d, t):
        if t < 0:
            return np.nan
        first, size = levels[level][band]
        if level == 0:
            return x[first, t - d : t + 1].mean() if t >= d else np.nan
        parts = [k for k, (f, s) in enumerate(levels[level - 1]) if first <= f < first + size]
        if len(parts) == 1:
            return value(level - 1, parts[0], d, t)
        below, above = (levels[level - 1][k] for k in parts)
        span = lag(first) - lag(first + size - 1)
        lo = half_up(d * (lag(first) - lag(above[0] - 1)) / span)
        late = half_up(d * (lag(first) - lag(above[0])) / span)
        hi = min(d - late, rows(level - 1, *above) - 1)
        return value(level - 1, parts[0], lo, t) + value(level - 1, parts[1], hi, t - late)

    return np.array([[value(len(levels) - 1, 0, d, t) if t >= d else np.nan for t in range(ntime)] for d in range(max_delay)])


@pytest.mark.parametrize(("nchan", "max_delay"), [(2, 9), (5, 7), (7, 12), (8, 1), (33, 20), (6, 2)])
def test_fdmt_against_the_definition(nchan, max_delay):
    x = RNG.normal(size=(nchan, 40))
    got = dispersion.transform(x, dispersion.plan(nchan, max_delay, 1000.0, 400.0 / nchan))[:max_delay]
    gold = fdmt_gold(x, 1000.0, 400.0 / nchan, max_delay)
    assert np.allclose(np.where(np.isnan(gold), 0, got), np.where(np.isnan(gold), 0, gold))
    assert np.array_equal(np.isnan(got), np.isnan(gold))


def two_sequences(spark, lengths=(3, 9), lanes=4):
    """Sequences of different length, their frames beginning at 0."""
    xs = [RNG.integers(-20, 20, (n, lanes)).astype(float) for n in lengths]
    rows = [(s, t, k, float(x[t, k])) for s, x in enumerate(xs) for t in range(len(x)) for k in range(lanes)]
    df = spark.createDataFrame(rows, "seq long, time long, freq long, value double")
    return xs, TensorFrame(df, TensorSpec.of("f64", Axis("time", -1, 0.0, 0.001, "s"), Axis("freq", lanes, 1000.0, 100.0, "MHz")), ("seq",))


def parts(tf, shape_of):
    out = []
    for s, x in enumerate(shape_of):
        one = tf.df.where(F.col("seq") == s).drop("seq")
        out.append(array_of(TensorFrame(one, tf.spec), x))
    return out


def test_sequences_stay_apart(spark, monkeypatch):
    """Small blocks, and sequences that end at different frames."""
    from tensorloom.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 16)
    xs, tf = two_sequences(spark)
    taps = [[0.5, -1.0, 2.0, 1.0], [1.0, 2.0, 0.0, -3.0], [3.0, 1.0, 1.0, 1.0]]
    for x, got in zip(xs, parts(fir.fir(tf, taps), [x.shape for x in xs]), strict=True):
        held = np.concatenate((np.zeros((2, 4)), x))
        assert np.allclose(got, sum(held[c : c + len(x)] * np.array(taps[c]) for c in range(3)))
    assert fir.fir(tf, taps).df.count() == sum(x.size for x in xs)
    for x, got in zip(xs, parts(elementwise.map_expression("c = a + b", {"a": tf, "b": tf}), [x.shape for x in xs]), strict=True):
        assert np.allclose(got, 2 * x)
    out = dispersion.fdmt(tf, "freq", 3)
    for s, x in enumerate(xs):
        gold = fdmt_gold(x.T, 1000.0, 100.0, 3)
        got = {(r.dispersion, r.time): r.value for r in out.df.where(F.col("seq") == s).collect()}
        assert got.keys() == {(d, t) for d, t in np.argwhere(~np.isnan(gold)).tolist()}
        assert all(np.isclose(v, gold[k]) for k, v in got.items())
    gram = linalg.matmul_aah(tf, "freq", "time").df
    for s, x in enumerate(xs):
        got = {(r.freq_i, r.freq_j): r.value for r in gram.where(F.col("seq") == s).collect()}
        assert all(np.isclose(got[i, j], (x.T @ x)[i, j]) for i in range(4) for j in range(i + 1))
    later = tf.spec.header  # nothing of a stream's header is lost
    assert out.spec.header == later


def test_fdmt_block_limits(spark):
    _, tf = two_sequences(spark)
    turned = shape.transpose(tf, ["freq", "time"])
    with pytest.raises(ValueError):
        dispersion.fdmt_block(turned, max_dm=1.0, max_delay=3)
    with pytest.raises(KeyError):
        dispersion.fdmt_block(tf, max_delay=3)
    out = dispersion.fdmt_block(turned, max_delay=3, negative_delays=True)
    assert out.spec.axis("dispersion").size == 3 and out.spec.axis("dispersion").step < 0
    assert np.isclose(out.spec.axis("dispersion").step * 3, out.spec.header["max_dm"])
    by_dm = dispersion.fdmt_block(turned, max_dm=-out.spec.header["max_dm"])
    assert by_dm.spec.axis("dispersion").size in (3, 4)


def test_jones():
    from pyspark.sql import SparkSession

    from tensorloom.functions.jones import Jones

    spark = SparkSession.getActiveSession()
    a, b = (RNG.normal(size=(2, 2)) + 1j * RNG.normal(size=(2, 2)) for _ in range(2))
    ja, jb = Jones.of(*a.ravel()), Jones.of(*b.ravel())
    made = {"product": (ja @ jb, a @ b), "inverse": (ja.inverse(), np.linalg.inv(a)), "adjoint": (ja.adjoint(), a.conj().T), "sum": (ja + jb, a + b), "less": (ja - jb, a - b), "turned": (ja.transpose(), a.T)}
    for name, (got, gold) in made.items():
        row = spark.range(1).select(*[x for p in (got.xx, got.xy, got.yx, got.yy) for x in (p.re, p.imag)]).head()
        assert np.allclose(np.array(row[0::2]) + 1j * np.array(row[1::2]), gold.ravel()), name
