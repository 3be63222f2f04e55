"""Files of fixed-size frames, read by ranges of frames and written by files.

A long file becomes as many partitions as it has chunks of about 32 MB of whole
frames, so one recording is read by the whole cluster; many short files share
partitions, and tasks read their headers.  A path is on a file
system that driver and executors mount, or a URI (``hdfs://``, ``s3://``, ...) that
Arrow's file systems open.  Samples of less than 8 bits are packed with the first in
the lowest bits.  Writing rolls over to a new file
every ``frames_per_file`` frames; a file is one group, of that bounded size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..spec import Axis, TensorSpec
from .headers import Layout, make_sigproc, make_wav, parse_cards, parse_dada, sigproc_layout, wav_layout

CHUNK = 32 << 20
FEW = 32  # files whose headers the driver reads itself
SAMPLES = 1 << 20  # of voltages: in a batch, and about as many in a file


def _open(path: str):
    """A readable file at a path or URI."""
    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
        return system.open_input_file(path)
    return open(path.removeprefix("file:"), "rb")


def _size(path: str) -> int:
    with _open(path) as f:
        return f.seek(0, os.SEEK_END)


def _jobs(spark: SparkSession, paths: list[str], look: Callable[[int, str], list[tuple]]) -> list[tuple]:
    """What ``look`` makes of each file and its number: a job for each chunk."""
    if len(paths) <= FEW:
        return [job for seq, path in enumerate(paths) for job in look(seq, path)]
    sc = spark.sparkContext
    return sc.parallelize(list(enumerate(paths)), max(sc.defaultParallelism, len(paths) // 256)).flatMap(lambda x: look(*x)).collect()


def _dealt(spark: SparkSession, jobs: list[tuple], schema: str, nbyte: int) -> DataFrame:
    """The jobs, dealt to tasks: one in each, or if they are short about a megabyte."""
    parts = min(len(jobs), max(spark.sparkContext.defaultParallelism, nbyte >> 20))
    return spark.createDataFrame(jobs, schema).repartition(max(1, parts))


def unpacked(data: bytes, dtype: str, bits: int) -> np.ndarray:
    """Samples of ``bits`` bits; of less than 8 the first is in the lowest bits."""
    if bits >= 8:
        return np.frombuffer(data, dtype)
    raw = np.frombuffer(data, np.uint8)
    cut = (raw[:, None] >> np.arange(0, 8, bits, dtype=np.uint8) & np.uint8(2**bits - 1)).ravel()
    if dtype[1] != "i":
        return cut
    return np.where(cut >= 2 ** (bits - 1), cut.astype(np.int8) - np.int8(2**bits - 1) - np.int8(1), cut.astype(np.int8))


def packed(values: np.ndarray, dtype: str, bits: int) -> bytes:
    """The inverse of :func:`unpacked`."""
    if bits >= 8:
        return values.astype(dtype).tobytes()
    low = (values.astype(np.int64) & (2**bits - 1)).astype(np.uint8).reshape(-1, 8 // bits)
    return np.bitwise_or.reduce(low << np.arange(0, 8, bits, dtype=np.uint8), axis=1).tobytes()


def read_frames(spark: SparkSession, paths: list[str], layout_of: Callable[[bytes], Layout], chunk: int = CHUNK) -> TensorFrame:
    """Frames of one or more files, each a sequence ``seq``; short tails are dropped.

    Tasks read ranges of frames; of many files also the headers.
    """
    def look(seq: int, path: str) -> list[tuple]:
        with _open(path) as f:
            layout = layout_of(f.read(1 << 16))
            frames = (f.seek(0, os.SEEK_END) - layout.offset) // layout.frame_bytes
        step = max(1, chunk // layout.frame_bytes)
        return [(seq, path, a, min(a + step, frames), layout.offset, layout.frame_bytes, layout.dtype, layout.spec.dtype.nbit, list(layout.shape)) for a in range(0, frames, step)]

    with _open(paths[0]) as f:
        spec = layout_of(f.read(1 << 16)).spec
    jobs = _jobs(spark, paths, look)
    labels = [a.label for a in spec.axes]
    kind = "double" if spec.dtype.is_floating else "bigint"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                n, shape = job["stop"] - job["start"], job["shape"]
                with _open(job["path"]) as f:
                    f.seek(job["offset"] + job["start"] * job["frame_bytes"])
                    x = unpacked(f.read(n * job["frame_bytes"]), job["dtype"], job["bits"]).reshape(n, *shape)
                places = np.indices(x.shape).reshape(x.ndim, -1)
                places[0] += job["start"]
                columns = [np.full(x.size, job["seq"]), *places, x.ravel().astype("f8" if kind == "double" else "i8")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seq", *labels, "value"])

    schema = "seq long, path string, start long, stop long, offset long, frame_bytes long, dtype string, bits int, shape array<long>"
    table = _dealt(spark, jobs, schema, sum((job[3] - job[2]) * job[5] for job in jobs))
    rows = table.mapInArrow(load, f"seq long, {', '.join(f'`{c}` long' for c in labels)}, value {kind}")
    return TensorFrame(rows, spec, ("seq",))


def read_sigproc(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> TensorFrame:
    """Filterbank files as (time, pol, freq)."""
    return read_frames(spark, paths, sigproc_layout, chunk)


def read_wav(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> TensorFrame:
    """PCM wave files as (time, pol)."""
    return read_frames(spark, paths, wav_layout, chunk)


def read_binary(spark: SparkSession, paths: list[str], width: int, dtype: str = "f32", chunk: int = CHUNK) -> TensorFrame:
    """Raw elements as (streamed, gulped), ``width`` in a frame."""
    spec = TensorSpec.of(dtype, Axis("streamed", -1), Axis("gulped", width))
    np_type = f"<{spec.dtype.kind}{spec.dtype.nbit // 8}"
    return read_frames(spark, paths, lambda _: Layout(0, width * spec.dtype.nbit // 8, np_type, (width,), spec), chunk)


def read_dada(spark: SparkSession, paths: list[str], spec_of: Callable[[dict], TensorSpec], chunk: int = CHUNK) -> TensorFrame:
    """Baseband files; ``spec_of`` makes the spec of real samples from the text header."""

    def layout(data: bytes) -> Layout:
        h = parse_dada(data[:4096])
        spec = spec_of(h)
        shape = tuple(a.size for a in spec.axes if not a.is_frame)
        d = spec.dtype
        return Layout(h.get("HDR_SIZE", 4096), int(np.prod(shape)) * d.nbit // 8, f"<{d.kind}{d.nbit // 8}", shape, spec)

    return read_frames(spark, paths, layout, chunk)


def read_packets(spark: SparkSession, paths: list[str], packet_bytes: int, chunk: int = CHUNK) -> DataFrame:
    """Recorded packets of one size: ``file``, ``number`` and ``packet``."""
    step = max(1, chunk // packet_bytes)

    def look(k: int, path: str) -> list[tuple]:
        n = _size(path) // packet_bytes
        return [(k, path, a, min(a + step, n)) for a in range(0, n, step)]

    jobs = _jobs(spark, paths, look)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                with _open(job["path"]) as f:
                    f.seek(job["start"] * packet_bytes)
                    held = [f.read(packet_bytes) for _ in range(job["stop"] - job["start"])]
                yield pa.RecordBatch.from_arrays([pa.array([job["file"]] * len(held), pa.int64()), pa.array(range(job["start"], job["stop"]), pa.int64()), pa.array(held, pa.binary())], ["file", "number", "packet"])

    table = _dealt(spark, jobs, "file long, path string, start long, stop long", packet_bytes * sum(job[3] - job[2] for job in jobs))
    return table.mapInArrow(load, "file long, number long, packet binary")


def write_text(tf: TensorFrame, path: str) -> None:
    """Places and values as comma-separated text, and the header as a comment file."""
    tf.df.write.mode("overwrite").csv(f"{path}/data", header=True)
    tf.df.sparkSession.createDataFrame([(tf.spec.pretty(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_guppi(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> TensorFrame:
    """Voltage files as (time, freq, fine_time, pol): a block is a frame.

    Blocks are found by their headers, in tasks if there are many files; a task
    reads a chunk of blocks.
    """
    with _open(paths[0]) as f:
        first = parse_cards(f.read(1 << 15))[0]
    geometry = {k: first.get(k) for k in ("OBSNCHAN", "NPOL", "NBITS", "BLOCSIZE")}

    def look(seq: int, path: str) -> list[tuple]:
        out, n, begin = [], 0, 0  # (seq, path, first block, its place, blocks, bytes)
        with _open(path) as f:
            at, size = 0, f.seek(0, os.SEEK_END)
            while at < size:
                f.seek(at)
                h, length = parse_cards(f.read(1 << 15))
                if any(h.get(k) != v for k, v in geometry.items()):
                    raise ValueError(f"blocks of different geometry in {path!r}; read them apart")
                if not out or at + length + h["BLOCSIZE"] - begin > chunk:
                    begin = at
                    out.append((seq, path, n, at, 0, 0))
                at, n = at + length + h["BLOCSIZE"], n + 1
                out[-1] = (*out[-1][:4], n - out[-1][2], at - begin)
        return out

    jobs = _jobs(spark, paths, look)
    npol = 1 if first.get("NPOL", 2) == 1 else 2
    nchan, nbits = first["OBSNCHAN"], first["NBITS"]
    fine = first["BLOCSIZE"] * 8 // (nchan * npol * 2 * nbits)
    width = first.get("OBSBW", nchan) / nchan
    spec = TensorSpec.of(f"ci{nbits}", Axis("time", -1, 0.0, fine * first.get("TBIN", 1.0), "s"), Axis("freq", nchan, first.get("OBSFREQ", 0.0) - width * (nchan - 1) / 2, width, "MHz"), Axis("fine_time", fine, 0.0, first.get("TBIN", 1.0), "s"), Axis("pol", npol))
    if nbits not in (8, 16):
        raise ValueError(f"{nbits} bits")

    together = max(1, SAMPLES // (nchan * fine * npol))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                with _open(job["path"]) as f:
                    at = job["at"]
                    for start in range(0, job["blocks"], together):
                        data = []
                        for _ in range(min(together, job["blocks"] - start)):
                            f.seek(at)
                            at += parse_cards(f.read(1 << 15))[1]
                            f.seek(at)
                            data.append(f.read(first["BLOCSIZE"]))
                            at += first["BLOCSIZE"]
                        x = np.frombuffer(b"".join(data), f"<i{nbits // 8}").reshape(len(data), nchan, fine, npol, 2)
                        places = np.indices(x.shape[:4]).reshape(4, -1)
                        places[0] += job["first"] + start
                        flat = x.reshape(-1, 2).astype("i8")
                        columns = [np.full(len(flat), job["seq"]), *places, flat[:, 0], flat[:, 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seq", "time", "freq", "fine_time", "pol", "re", "im"])

    table = _dealt(spark, jobs, "seq long, path string, first long, at long, blocks long, nbyte long", sum(job[5] for job in jobs))
    return TensorFrame(table.mapInArrow(load, "seq long, time long, freq long, fine_time long, pol long, re long, im long"), spec, ("seq",))


def write_frames(tf: TensorFrame, folder: str, name: str, header_of: Callable[[int, int], bytes], dtype: str, frames_per_file: int, ext: str, blocks: bool = False) -> DataFrame:
    """Files ``name.NNNNNN.ext``, each of at most ``frames_per_file`` frames.

    ``header_of(first_frame, nbyte)`` gives a file's header, or with ``blocks``
    the header of each frame in it.  A file is written
    under another name and then renamed, so a task that is run twice does no
    harm.  Rows: file and bytes.
    """
    os.makedirs(folder, exist_ok=True)
    bits, columns = tf.spec.dtype.nbit, list(tf.values)
    frame, others = tf.spec.frame.label, [a.label for a in tf.spec.axes if not a.is_frame]

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, *others])
        times, values = rows[frame].to_numpy(), rows[columns].to_numpy()
        cuts = np.flatnonzero(np.diff(times)) + 1 if blocks else []
        firsts = times[[0, *cuts]] if blocks else [int(key[0]) * frames_per_file]
        nbyte, path = 0, f"{folder}/{name}.{key[0]:06d}.{ext}"
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            for first, part in zip(firsts, np.split(values, cuts), strict=True):
                data = packed(part.ravel(), dtype, bits)
                f.write(header_of(int(first), len(data)) + data)
                nbyte += len(data)
        os.replace(f.name, path)
        return pd.DataFrame({"file": [path], "nbyte": [nbyte]})

    rows = tf.df.withColumn("__file", F.expr(f"`{frame}` div {frames_per_file}"))
    return rows.groupBy("__file").applyInPandas(write, "file string, nbyte long")


def write_sigproc(tf: TensorFrame, folder: str, name: str, frames_per_file: int = 1 << 20, more: dict | None = None) -> DataFrame:
    """(time, pol, freq) as filterbank files; ``more`` are further header values."""
    time, pol, freq = tf.spec.axes
    d = tf.spec.dtype

    def header(first: int, _: int) -> bytes:
        start = (time.start + first * time.step) / 86400 + 40587
        return make_sigproc({"data_type": 1, "nbits": d.nbit, "nifs": pol.size, "nchans": freq.size, "fch1": freq.start, "foff": freq.step, "tstart": start, "tsamp": time.step, "signed": int(d.is_signed)} | (more or {}))

    return write_frames(tf, folder, name, header, f"<{d.kind}{max(d.nbit, 8) // 8}", frames_per_file, "fil")


def write_beams(tf: TensorFrame, folder: str, name: str, frames_per_file: int = 1 << 20) -> dict[int, DataFrame]:
    """(beam, time, pol, freq) or (time, beam, pol, freq) as filterbank files of each beam, as the header's ``nbeams`` and ``ibeam`` say."""
    beams, spec = tf.spec.axis("beam"), tf.spec.with_axis("beam")
    out = {}
    for k in range(beams.size):  # as many as the axis has
        one = TensorFrame(tf.df.where(F.col("beam") == k), spec, tf.keys)
        out[k] = write_sigproc(one, folder, f"{name}.beam{k:03d}", frames_per_file, {"nbeams": beams.size, "ibeam": k + 1})
    return out


def write_time_series(tf: TensorFrame, folder: str, name: str, dm: float = 0.0, frames_per_file: int = 1 << 24) -> DataFrame:
    """(time, pol) as time-series files (data type 2), dedispersed at ``dm``."""
    time, pol = tf.spec.axes
    d = tf.spec.dtype

    def header(first: int, _: int) -> bytes:
        start = (time.start + first * time.step) / 86400 + 40587
        return make_sigproc({"data_type": 2, "nbits": d.nbit, "nifs": pol.size, "nchans": 1, "tstart": start, "tsamp": time.step, "refdm": dm, "signed": int(d.is_signed)})

    return write_frames(tf, folder, name, header, f"<{d.kind}{max(d.nbit, 8) // 8}", frames_per_file, "tim")


def write_dispersion(tf: TensorFrame, folder: str, name: str, frames_per_file: int = 1 << 24) -> dict[int, DataFrame]:
    """(dispersion, time) or (time, dispersion) as a time-series file of each dispersion measure."""
    axis, spec = tf.spec.axis("dispersion"), tf.spec.with_axis("dispersion")
    time = spec.frame
    out = {}
    for k in range(axis.size):  # as many as the axis has
        rows = tf.df.where(F.col("dispersion") == k).withColumn("pol", F.lit(0).cast("bigint"))
        one = TensorFrame(rows, replace(spec, axes=(time, Axis("pol", 1))), tf.keys)
        dm = axis.start + k * axis.step
        out[k] = write_time_series(one, folder, f"{name}.{dm:08.2f}", dm, frames_per_file)
    return out


def write_guppi(tf: TensorFrame, folder: str, name: str, blocks_per_file: int | None = None) -> DataFrame:
    """(time, freq, fine_time, pol) voltages as files of blocks, a frame each; by default of about a million samples."""
    time, freq, fine, pol = tf.spec.axes
    d = tf.spec.dtype

    def header(_: int, nbyte: int) -> bytes:
        cards = {"BLOCSIZE": nbyte, "OBSNCHAN": freq.size, "NPOL": 4 if pol.size == 2 else 1, "NBITS": d.nbit, "TBIN": fine.step, "OBSFREQ": freq.start + freq.step * (freq.size - 1) / 2, "OBSBW": freq.step * freq.size}
        return b"".join(f"{k:<8}= {v!r:>20}".ljust(80).encode() for k, v in cards.items()) + b"END".ljust(80)

    return write_frames(tf, folder, name, header, f"<i{d.nbit // 8}", blocks_per_file or max(1, SAMPLES // (freq.size * fine.size * pol.size)), "raw", blocks=True)


def write_packets(packets: DataFrame, folder: str, name: str, order: str, packets_per_file: int = 1 << 18, packet: str = "packet") -> DataFrame:
    """Packets one after another in files of at most ``packets_per_file``; ``order`` counts them densely from 0."""
    os.makedirs(folder, exist_ok=True)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(rows.sort_values("n")["packet"])
        path = f"{folder}/{name}.{key[0]:06d}.pkt"
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(f.name, path)
        return pd.DataFrame({"file": [path], "nbyte": [len(data)]})

    rows = packets.select(F.expr(f"`{order}` div {packets_per_file}").alias("__file"), F.col(order).alias("n"), F.col(packet).alias("packet"))
    return rows.groupBy("__file").applyInPandas(write, "file string, nbyte long")


def write_wav(tf: TensorFrame, folder: str, name: str, frames_per_file: int = 1 << 24) -> DataFrame:
    """(time, pol) as PCM wave files."""
    time, pol = tf.spec.axes
    d = tf.spec.dtype
    return write_frames(tf, folder, name, lambda _, nbyte: make_wav(pol.size, round(1 / time.step), d.nbit, nbyte), f"<{d.kind}{d.nbit // 8}", frames_per_file, "wav")


def write_binary(tf: TensorFrame, folder: str, name: str, frames_per_file: int = 1 << 20) -> DataFrame:
    """Raw elements in frame order."""
    d = tf.spec.dtype
    return write_frames(tf, folder, name, lambda *_: b"", f"<{d.kind}{d.nbit // 8}", frames_per_file, "out")


def serialize(tf: TensorFrame, path: str, max_rows_per_file: int = 0) -> None:
    """Parquet with the header beside it; any number of axes and files."""
    tf.df.write.option("maxRecordsPerFile", max_rows_per_file).mode("overwrite").parquet(f"{path}/data")
    header = [(json.dumps({"spec": tf.spec.to_json(), "keys": list(tf.keys)}),)]
    tf.df.sparkSession.createDataFrame(header, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def deserialize(spark: SparkSession, path: str) -> TensorFrame:
    header = json.loads(spark.read.text(f"{path}/header").head()[0])
    return TensorFrame(spark.read.parquet(f"{path}/data"), TensorSpec.from_json(header["spec"]), tuple(header["keys"]))
