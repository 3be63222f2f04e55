"""Packets: headers taken apart and put together in SQL, payloads in numpy.

A packet is a row with a binary ``packet``.  Decoding gives ``seq``, ``src``,
``time_tag``, ``valid`` and ``payload``; :mod:`tensorloom.streaming.gulps` then
drops late ones, finds changes and blanks sources that lack data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: header fields by format, in order, with their bytes (big-endian)
FORMATS = {
    "simple": [("seq", 8)],
    "chips": [("roach", 1), ("gbe", 1), ("nchan", 1), ("nsubband", 1), ("subband", 1), ("nroach", 1), ("chan0", 2), ("seq", 8)],
    "ibeam": [("server", 1), ("gbe", 1), ("nchan", 1), ("nbeam", 1), ("nserver", 1), ("chan0", 2), ("seq", 8)],
    "pbeam": [("server", 1), ("beam", 1), ("gbe", 1), ("nchan", 1), ("nbeam", 1), ("nserver", 1), ("navg", 2), ("chan0", 2), ("seq", 8)],
    "snap2": [("seq", 8), ("sync_time", 4), ("npol", 2), ("npol_tot", 2), ("nchan", 2), ("nchan_tot", 2), ("chan_block_id", 4), ("chan0", 4), ("pol0", 4)],
    "tbn": [("sync_word", 4), ("frame_count_word", 4), ("tuning_word", 4), ("tbn_id", 2), ("gain", 2), ("time_tag", 8)],
    "tbf": [("sync_word", 4), ("frame_count_word", 4), ("seconds_count", 4), ("first_chan", 2), ("nstand", 2), ("time_tag", 8)],
    "drx": [("sync_word", 4), ("frame_count_word", 4), ("seconds_count", 4), ("decimation", 2), ("time_offset", 2), ("time_tag", 8), ("tuning_word", 4), ("flags", 4)],
    "cor": [("sync_word", 4), ("frame_count_word", 4), ("second_count", 4), ("first_chan", 2), ("gain", 2), ("time_tag", 8), ("navg", 4), ("stand0", 2), ("stand1", 2)],
}
FORMATS["drx8"] = FORMATS["drx"]
FORMATS["vbeam"] = [("sync_word", 8), ("sync_time", 8), ("time_tag", 8), ("bw_hz", 8), ("sfreq", 8), ("nchan", 4), ("chan0", 4), ("npol", 4)]
#: A header of 32-bit little-endian words, each cut into fields of these bits, lowest first.
VDIF = [[("seconds", 30), ("legacy", 1), ("invalid", 1)], [("frame", 24), ("epoch", 6), ("_", 2)], [("length", 24), ("log2_nchan", 5), ("version", 3)], [("station", 16), ("thread", 10), ("bits_less_one", 5), ("complex", 1)]]
#: Ticks of the sampling clock in a second.
CLOCK = 196_000_000
#: Samples of the payload: bits of a component (floating if 32), components of one, and samples of a channel (0: no channels).
PAYLOAD = {"tbn": (8, 2, 0), "drx": (4, 2, 0), "drx8": (8, 2, 0), "simple": (16, 2, 1), "chips": (4, 2, 32), "snap2": (4, 2, 64), "ibeam": (32, 2, 2), "pbeam": (32, 1, 4), "cor": (32, 2, 4), "vdif": (8, 2, 0)}


def header_bytes(fmt: str) -> int:
    return sum(n for _, n in FORMATS[fmt])


def fields(packet: Column, fmt: str) -> dict[str, Column]:
    """The header fields of a packet as numbers."""
    out, at = {}, 1
    for name, n in FORMATS[fmt]:
        out[name] = F.conv(F.hex(F.substring(packet, at, n)), 16, 10).cast("bigint")
        at += n
    return out


def vdif_fields(packet: Column) -> dict[str, Column]:
    """The fields of a header in little-endian words."""
    out = {}
    for k, word in enumerate(VDIF):
        byte = lambda i, k=k: F.conv(F.hex(F.substring(packet, 4 * k + i + 1, 1)), 16, 10).cast("bigint")
        whole = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
        low = 0
        for name, bits in word:
            out[name] = F.shiftright(whole, low).bitwiseAND(2**bits - 1)
            low += bits
    return out


def _vdif(packets: DataFrame, nsrc: int, src0: int, frames_per_second: int, packet: str) -> DataFrame:
    h = vdif_fields(F.col(packet))
    seq, src = h["seconds"] * frames_per_second + h["frame"], h["thread"] - src0
    size = F.when(h["legacy"] == 1, 16).otherwise(32)
    known = F.coalesce((F.octet_length(packet) > size) & (h["invalid"] == 0) & (src >= 0) & (src < nsrc), F.lit(False))
    rest = F.substr(F.col(packet), size + 1, F.octet_length(packet))
    return packets.withColumns({"seq": seq, "src": src.cast("bigint"), "time_tag": seq, "valid": known, "payload": rest})


def decode(packets: DataFrame, fmt: str, nsrc: int, src0: int = 0, decimation: int = 1, packet: str = "packet", nbeam: int | None = None) -> DataFrame:
    """Packets with ``seq``, ``src``, ``time_tag``, ``valid`` and ``payload``.

    A packet that is too short or whose source is out of range is not valid;
    nor are those of ``ibeam`` with other than ``nbeam`` beams, if that is
    given, and of ``snap2`` whose blocks are not ``nsrc`` in all.
    ``decimation`` is the raw samples of one (for ``vdif`` frames in a second).
    """
    if fmt == "vdif":
        return _vdif(packets, nsrc, src0, decimation, packet)
    h = fields(F.col(packet), fmt)
    tag = h.get("time_tag", h.get("seq"))
    div = lambda a, b: F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
    if fmt == "simple":
        seq, src = h["seq"], F.lit(0)
    elif fmt == "chips":
        seq, src = h["seq"] - 1, h["roach"] - 1 - src0
    elif fmt == "ibeam":
        seq, src = h["seq"] - 1, h["server"] - 1 - src0
    elif fmt == "pbeam":
        seq, src = div(h["seq"], F.greatest(h["navg"], F.lit(1))), (h["beam"] - src0) * h["nserver"] + h["server"] - 1
    elif fmt == "snap2":
        npol = F.greatest(h["npol"], F.lit(1))
        seq, src = h["seq"], div(h["pol0"], npol) + h["chan_block_id"] * div(h["npol_tot"], npol)
    elif fmt == "tbn":
        seq, src = div(tag, 512 * decimation), h["tbn_id"].bitwiseAND(1023) - 1 - src0
    elif fmt in ("drx", "drx8"):
        tag = tag - h["time_offset"]
        which = F.shiftright(h["frame_count_word"], 24)  # beam, tuning and polarisation share the first byte
        tuning, pol = F.shiftright(which, 3).bitwiseAND(7) - 1, F.shiftright(which, 7).bitwiseAND(1)
        seq, src = div(tag, F.greatest(h["decimation"], F.lit(1)) * 4096), tuning * 2 + pol - src0
    elif fmt == "cor":
        # sources are baselines a <= b of the stands, row by row, times servers
        word = h["frame_count_word"]
        nserver, server = F.greatest(F.shiftright(word, 8).bitwiseAND(255), F.lit(1)), word.bitwiseAND(255)
        a, b = h["stand0"] - 1, h["stand1"] - 1
        nstand = F.floor((F.sqrt(8 * nsrc / nserver + 1) - 1) / 2)
        before = div(a * (2 * nstand - 1 - a), F.lit(2))
        seq = div(div(tag, CLOCK), F.greatest(div(h["navg"], 100), F.lit(1)))
        src = (before + b + 1 - src0) * nserver + server - 1
    else:
        raise ValueError(f"packets of format {fmt!r} are only written")
    size = header_bytes(fmt)
    whole = F.octet_length(packet) > size
    if fmt == "ibeam" and nbeam is not None:
        whole &= h["nbeam"] == nbeam
    if fmt == "snap2":
        whole &= div(h["npol_tot"], F.greatest(h["npol"], F.lit(1))) * div(h["nchan_tot"], F.greatest(h["nchan"], F.lit(1))) == nsrc
    known = F.coalesce(whole & (seq >= 0) & (src >= 0) & (src < nsrc), F.lit(False))
    return packets.withColumns({"seq": seq, "src": src.cast("bigint"), "time_tag": tag, "valid": known, "payload": F.expr(f"substring(`{packet}`, {size + 1})")})


def encode(rows: DataFrame, fmt: str, values: dict[str, Column | int], payload: str = "payload", out: str = "packet") -> DataFrame:
    """Rows with the packet of their payload; header fields not given are 0."""
    parts = []
    for name, n in FORMATS[fmt]:
        x = values.get(name, 0)
        x = x if isinstance(x, Column) else F.lit(x)
        parts.append(F.unhex(F.substring(F.lpad(F.hex(x.cast("bigint")), 16, "0"), 17 - 2 * n, 2 * n)))
    return rows.withColumn(out, F.concat(*parts, F.col(payload)))


def samples(decoded: DataFrame, fmt: str, by_channel: int | None = None) -> DataFrame:
    """Valid packets' payloads as rows ``seq``, ``src``, ``sample``, ``re``, ``im``.

    Formats with channels (``by_channel`` samples in each, where it is not the
    usual number: beams times polarisations, inputs) also have ``chan`` and
    ``input``.  Packed components are high and low half of a byte.
    """
    bits, components, per = PAYLOAD[fmt]
    per = by_channel or per
    kind = "double" if bits == 32 else "bigint"

    @F.arrow_udf(f"struct<re:array<{kind}>,im:array<{kind}>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pa.list_(pa.float64() if bits == 32 else pa.int64())
        for payloads in batches:
            re, im = [], []
            for p in payloads:
                data = p.as_py()
                if bits == 4:
                    x = np.frombuffer(data, np.int8)
                    a, b = x >> 4, (x << 4).astype(np.int8) >> 4
                else:
                    x = np.frombuffer(data, "<f4" if bits == 32 else f"<i{bits // 8}", len(data) // (bits // 8))
                    a, b = (x[0::2], x[1::2]) if components == 2 else (x, np.zeros(len(x)))
                re.append(a.astype(own.value_type.to_pandas_dtype()))
                im.append(b[: len(a)].astype(own.value_type.to_pandas_dtype()))
            yield pa.StructArray.from_arrays([pa.array(re, own), pa.array(im, own)], ["re", "im"])

    rows = decoded.where("valid").select("seq", "src", split("payload").alias("__s"))
    rows = rows.select("seq", "src", F.posexplode(F.arrays_zip("__s.re", "__s.im")).alias("sample", "__v"))
    out = rows.select("seq", "src", F.col("sample").cast("bigint"), F.col("__v.re").alias("re"), F.col("__v.im").alias("im"))
    if not per:
        return out
    return out.withColumns({"chan": F.expr(f"sample div {per}"), "input": F.col("sample") % per})


def numbered(rows: DataFrame, place: Column, nsrc: int, seq0: int = 0, seq_step: int = 1, src0: int = 0, src_step: int = 1) -> DataFrame:
    """Rows with ``seq`` and ``src`` of a sender's packets: ``nsrc`` sources of each sequence number, by their dense ``place``."""
    n = F.call_function("div", place, F.lit(nsrc))
    return rows.withColumns({"seq": F.lit(seq0) + n * seq_step, "src": F.lit(src0) + place % nsrc * src_step})
