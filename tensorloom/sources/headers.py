"""Headers of the file formats, as pure functions of bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..spec import Axis, TensorSpec

# fixed values: keywords of the filterbank format by type
_INTS = ("telescope_id", "machine_id", "data_type", "barycentric", "pulsarcentric", "nbits", "nsamples", "nchans", "nifs", "nbeams", "ibeam")
_DOUBLES = ("az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "fch1", "foff", "refdm", "period")
_STRINGS = ("source_name", "rawdatafile")


@dataclass(frozen=True)
class Layout:
    """Where frames lie in a file: after ``offset`` bytes, ``frame_bytes`` each."""

    offset: int
    frame_bytes: int
    dtype: str  # numpy's
    shape: tuple[int, ...]  # of a frame
    spec: TensorSpec


def parse_sigproc(data: bytes) -> tuple[dict, int]:
    """Header values and length of a filterbank file."""
    at, out = 0, {}

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<i", data, at)
        if not 0 < n < 256:
            raise ValueError("not a filterbank header")
        at += 4 + n
        return data[at - n : at].decode("latin-1")

    if text() != "HEADER_START":
        raise ValueError("not a filterbank header")
    while (key := text()) != "HEADER_END":
        if key in _STRINGS:
            out[key] = text()
        elif key in _DOUBLES:
            (out[key],) = struct.unpack_from("<d", data, at)
            at += 8
        elif key == "signed":
            (out[key],) = struct.unpack_from("<b", data, at)
            at += 1
        elif key in _INTS:
            (out[key],) = struct.unpack_from("<i", data, at)
            at += 4
        else:
            raise ValueError(f"unknown keyword {key!r}")
    return out, at


def make_sigproc(header: dict) -> bytes:
    """The bytes of a filterbank header; values of other keys are left out."""
    word = lambda s: struct.pack("<i", len(s)) + s.encode("latin-1")
    out = [word("HEADER_START")]
    for key, value in header.items():
        if key in _STRINGS:
            out.append(word(key) + word(str(value)))
        elif key in _DOUBLES:
            out.append(word(key) + struct.pack("<d", value))
        elif key == "signed":
            out.append(word(key) + struct.pack("<b", value))
        elif key in _INTS:
            out.append(word(key) + struct.pack("<i", value))
    return b"".join([*out, word("HEADER_END")])


def unix_of_mjd(mjd: float) -> float:
    return (mjd - 40587) * 86400


def sigproc_layout(data: bytes) -> Layout:
    h, offset = parse_sigproc(data)
    nbits, nifs, nchans = h["nbits"], h.get("nifs", 1), h.get("nchans", 1)
    if nbits < 8 and nifs * nchans * nbits % 8:
        raise ValueError(f"a frame of {nifs * nchans} samples of {nbits} bits is no whole number of bytes")
    kind = "f" if nbits >= 32 else "i" if h.get("signed") else "u"  # wide samples are floats
    start = unix_of_mjd(h.get("tstart", 40587.0))
    spec = TensorSpec.of(
        f"{kind}{nbits}",
        Axis("time", -1, start, h.get("tsamp", 1.0), "s"),
        Axis("pol", nifs),
        Axis("freq", nchans, h.get("fch1", 0.0), h.get("foff", 1.0), "MHz"),
        time_tag=round(start * 2**32),
        **{k: h[k] for k in ("source_name", "telescope_id", "machine_id") if k in h},
    )
    return Layout(offset, nifs * nchans * nbits // 8, f"<{kind}{max(nbits, 8) // 8}", (nifs, nchans), spec)


def wav_layout(data: bytes) -> Layout:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data":
            break
        at += 8 + size + size % 2
    if form is None or form[0] != 1:
        raise ValueError("only PCM is read")
    _, channels, rate, _, _, bits = form
    kind = "u" if bits == 8 else "i"
    spec = TensorSpec.of(f"{kind}{bits}", Axis("time", -1, 0.0, 1 / rate, "s"), Axis("pol", channels), frame_rate=rate)
    return Layout(at + 8, channels * bits // 8, f"<{kind}{bits // 8}", (channels,), spec)


def make_wav(channels: int, rate: int, bits: int, nbyte: int) -> bytes:
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + nbyte) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", nbyte)


def parse_cards(data: bytes) -> tuple[dict, int]:
    """FITS-like cards of 80 characters up to END, as voltage files have them."""
    out, at = {}, 0
    while at + 80 <= len(data):
        card = data[at : at + 80].decode("latin-1")
        at += 80
        if card[:3] == "END" and not card[3:].strip():
            if out.get("DIRECTIO"):
                at = -(-at // 512) * 512
            return out, at
        key, _, value = card.partition("=")
        value = value.strip()
        if value.startswith("'"):
            out[key.strip()] = value[1:].split("'")[0].strip()
        else:
            value = value.split("/")[0].strip()
            try:
                out[key.strip()] = int(value)
            except ValueError:
                try:
                    out[key.strip()] = float(value)
                except ValueError:
                    out[key.strip()] = value
    raise ValueError("no END card")


def parse_dada(data: bytes) -> dict:
    """The text header of a baseband file: a key and a value on each line."""
    out = {}
    for line in data.split(b"\0")[0].decode("latin-1").splitlines():
        parts = line.split("#")[0].split(None, 1)
        if len(parts) == 2:
            value = parts[1].strip()
            try:
                out[parts[0]] = int(value)
            except ValueError:
                try:
                    out[parts[0]] = float(value)
                except ValueError:
                    out[parts[0]] = value
    return out


def make_dada(header: dict, size: int = 4096) -> bytes:
    text = "".join(f"{k} {v}\n" for k, v in ({"HDR_SIZE": size} | header).items()).encode("latin-1")
    if len(text) > size:
        raise ValueError(f"the header is longer than {size} bytes")
    return text.ljust(size, b"\0")


def header_is_standard(header: dict) -> bool:
    """Whether the usual filterbank values are there, of their types and ranges."""
    rules = {"nchans": (int, 1), "nifs": (int, 1), "nbits": (int, 1), "fch1": (float, 0), "foff": (float, None), "tstart": (float, 0), "tsamp": (float, 0)}
    for key, (kind, least) in rules.items():
        value = header.get(key)
        if not isinstance(value, kind | int if kind is float else kind) or isinstance(value, bool):
            return False
        if least is not None and value < least:
            return False
    return True
