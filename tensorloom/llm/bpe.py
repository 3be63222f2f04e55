"""Byte-level BPE as a lazily determinised finite-state transducer.

The merge table is compiled into a transducer over bytes.  A state keeps what
the future can still depend on: the last token that was emitted and for each
*live* position (one from which some vocabulary entry could still reach past
the bytes read) how far into the entries it is, and the tokens that lead there.  Two facts
make this exact: every prefix of a BPE encoding is the encoding of its own
bytes, and an encoding is valid iff each neighbouring pair of tokens is.  So
the token that ends at a position is the one that starts at a live position
and forms a valid pair with the token ending there.  What all live positions
agree on is emitted; the lookahead is bounded by the longest entry.  States
and arcs are made when first met.  When ``max_states`` are held those of rare
pieces are dropped, and made again as they are met, so memory is bounded and
every piece is encoded by the transducer.

Decoding is the inverse: a table look-up per token and an incremental UTF-8
machine that holds back at most three bytes of an unfinished character.

Nulls are encoded as empty texts.  Empty texts give no tokens.  Texts are
encoded whole; very long ones cost memory in proportion to themselves only.
Repeated rows give repeated results.  Other columns pass through unchanged,
whatever their names; an existing column with an output's name is replaced.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import held, small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    """All that the future depends on.

    ``ways`` has the last token (-2 where nothing is asked of it) and then, for
    each live position, the entries' trie node after the bytes since it, and
    the tokens not yet emitted that lead to it.  Most states have one arc, kept
    in ``byte``, ``out`` and ``next``; further ones are in ``arcs``.
    """

    __slots__ = ("arcs", "byte", "final", "next", "out", "ways")

    def __init__(self, ways: tuple):
        self.byte, self.out, self.next = -1, b"", None
        self.arcs: dict[int, tuple[bytes, _State]] | None = None
        self.final: bytes | None = None
        self.ways = ways


def _pack(tokens) -> bytes:
    return b"".join([t.to_bytes(4, "little") for t in tokens])


class _Pieces(dict):
    """Packed ids by pre-token; a miss runs the transducer.

    When ``most`` are held they become the older generation, from which those
    still in use return, and the generation before is forgotten.
    """

    def __init__(self, run, most: int):
        self.run, self.most, self.older = run, most, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        if out is None:
            out = self.run(piece.encode())
        if len(piece) < 64:
            self[piece] = out
        return out


class ByteBpe:
    """Encoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = 120_000, max_pieces: int = 250_000):
        self.ranks = ranks
        self.table = {i: t for t, i in ranks.items()}
        # a trie of the entries: child by node and byte, entry (or -1) and whether it goes on by node
        self.child, self.entry, self.inner = {}, [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                if (at := self.child.get(node << 8 | byte)) is None:
                    at = self.child[node << 8 | byte] = len(self.entry)
                    self.entry.append(-1)
                    self.inner.append(False)
                node = at
            self.entry[node] = rank
        # Rust's \s is the White_Space property; Python's has four controls more.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.max_states = max_states
        self.valid: dict[int, bool] = {}  # by the two ids
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = _Pieces(self.encode_piece, max_pieces)
        self.states: dict[tuple, _State] = {}
        self.root = self._state((-1, 0, ()))

    @classmethod
    def load(cls, path: str, pattern: str, **sizes: int) -> "ByteBpe":
        """The encoder of this worker: its tasks share the states."""
        return held(("bpe", path, pattern, *sorted(sizes.items())), lambda: cls(read_ranks(path), pattern, **sizes))

    def _state(self, ways: tuple) -> _State:
        if (known := self.states.get(ways)) is None:
            known = self.states[ways] = _State(ways)
        return known

    def _forget(self, s: _State) -> _State:
        """Drop the states that end in one way only, which rare pieces made, or all if too few are so.

        The state ``s``, from which the run goes on, and the first one stay.
        """
        kept = {ways: old for ways, old in self.states.items() if old.arcs}
        if len(kept) > self.max_states // 2:
            kept = {}
        kept[self.root.ways], kept[s.ways] = self.root, s
        for old in self.states.values():
            arcs = (old.arcs or {}) | ({old.byte: (old.out, old.next)} if old.next else {})
            old.byte, old.out, old.next, old.arcs = -1, b"", None, None  # states form rings, which would outlive their last use
            if old.ways in kept:
                arcs = {byte: arc for byte, arc in arcs.items() if arc[1].ways in kept}
                if arcs:
                    old.byte, (old.out, old.next) = arcs.popitem()
                old.arcs = arcs or None
        self.states = kept
        return s

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merge by rank until nothing merges, or ``until`` parts are left: the definition of BPE.

        Used on one vocabulary entry at a time.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` was merged from; None for a byte.  (-1, -1) if merging does not make it."""
        data = self.table[token]
        parts = self.merge(data, 2) if len(data) > 1 else []
        made = len(parts) == 2 and self.merge(data) == [data]
        halves = self.halves[token] = tuple(self.ranks[p] for p in parts) if made else (-1, -1) if len(data) > 1 else None
        return halves

    def _follows(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand after ``before`` (-1: at the start).

        Merges are undone from the latest on, on the side whose token is of
        the higher rank.  What stands at the border must not have merged across
        it before the merge that was undone last: of equal ranks the left one
        comes first.
        """
        if len(self.valid) >= 300_000:
            self.valid.clear()
        known = self.valid[before << 32 | token] = self._apart(before, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        table, ranks, halves = self.table, self.ranks, self.halves
        for token in (left, right):
            if token >= 0 and (halves[token] if token in halves else self._halves(token)) == (-1, -1):
                return False
        if left < 0:
            return True
        limit = 1 << 60  # a merge across of a lower rank would have come first
        while True:
            across = ranks.get(table[left] + table[right])
            if across is not None and across < limit:
                return False
            a = halves[left] if left in halves else self._halves(left)
            b = halves[right] if right in halves else self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _arc(self, s: _State, byte: int) -> tuple[bytes, _State]:
        child, entry, inner, valid, here = self.child, self.entry, self.inner, self.valid, None
        ways, last, live = s.ways, s.ways[0], []
        for k in range(1, len(ways), 2):
            node, chain = child.get(ways[k] << 8 | byte), ways[k + 1]
            if node is None:
                continue
            if here is None and (token := entry[node]) >= 0:
                before = chain[-1] if chain else last
                follows = valid.get(before << 32 | token)
                if self._follows(before, token) if follows is None else follows:
                    here = (*chain, token)
            if inner[node]:
                live += (node, chain)
        live += (0, here)
        # what all live positions agree on can be emitted
        same = 0
        if live[1]:
            chains = live[1::2]
            most = min(map(len, chains))
            while same < most and all([c[same] == here[same] for c in chains]):
                same += 1
            if same:
                last = here[same - 1]
                live[1::2] = [c[same:] for c in chains]
        # where every way has a token after it, nothing will be asked of the last one
        arc = _pack(here[:same]) if same else b"", self._state((-2 if live[1] else last, *live))
        if s.byte < 0:
            s.byte, (s.out, s.next) = byte, arc
        else:
            if s.arcs is None:
                s.arcs = {}
            s.arcs[byte] = arc
        return arc

    def encode_piece(self, data: bytes) -> bytes:
        """Packed ids (little-endian, 32 bits each) of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return whole.to_bytes(4, "little")
        out, s = [], self.root
        for byte in data:
            if s.byte == byte:
                emitted, s = s.out, s.next
            else:
                arc = s.arcs.get(byte) if s.arcs else None
                if arc is None:
                    if len(self.states) >= self.max_states:
                        s = self._forget(s)
                    arc = self._arc(s, byte)
                emitted, s = arc
            if emitted:
                out.append(emitted)
        if s.final is None:
            s.final = _pack(s.ways[-1])
        out.append(s.final)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))


class ByteDecoder:
    """Decoder for one table of ranks."""

    def __init__(self, table: dict[int, bytes]):
        self.table = table

    @classmethod
    def load(cls, path: str) -> "ByteDecoder":
        return held(("bytes", path), lambda: cls({i: t for t, i in read_ranks(path).items()}))

    def decode(self, packed: bytes, step: int = 8192) -> str:
        """The text of packed ids, decoded ``step`` tokens at a time."""
        ids, machine, out = memoryview(packed).cast("I"), Utf8Machine(), []
        for i in range(0, len(ids), step):
            out.append(machine.feed(b"".join(map(self.table.__getitem__, ids[i : i + step].tolist()))))
        out.append(machine.close())
        return "".join(out)


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions, gives whole characters.

    The state is the unfinished character, three bytes at most.  Malformed
    bytes become U+FFFD, as in a whole decode.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                return k if k < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        k = self._unfinished(data)
        self.held = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def encode_column(text: Column | str, vocab: str, pattern: str) -> Column:
    """Token ids of ``text`` as packed little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteBpe.load(vocab, pattern)
        for texts in batches:
            gc.disable()  # the states are many and live long; walking them again and again finds nothing
            try:
                out = pa.array([codec.encode(t.as_py() or "") for t in texts], pa.binary())
            finally:
                gc.enable()
            yield out

    return encode(text)


def decode_column(packed: Column | str, vocab: str) -> Column:
    """The text of packed token ids; null for null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteDecoder.load(vocab)
        for ids in batches:
            yield pa.array([None if p is None else codec.decode(p) for p in ids.to_pylist()], pa.string())

    return decode(packed)


def round_trip_column(text: Column | str, vocab: str, pattern: str, **sizes: int) -> Column:
    """A struct of ``token_ids`` and what they decode to, ``decoded``."""

    @F.arrow_udf("struct<token_ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ByteBpe.load(vocab, pattern, **sizes)
        decoder = ByteDecoder(encoder.table)
        for texts in batches:
            gc.disable()
            try:
                ids = [encoder.encode(t.as_py() or "") for t in texts]
            finally:
                gc.enable()
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(decoder.decode, ids), pa.string())], ["token_ids", "decoded"])

    return both(text)


def bpe_round_trip(docs: DataFrame, vocab: str, pattern: str, text: str = "text", out: str = "bpe", **sizes: int) -> DataFrame:
    """``docs`` with the struct ``out``: encoded and decoded in one pass.

    ``sizes`` are ``max_states`` and ``max_pieces`` of :class:`ByteBpe`, what a worker holds.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, round_trip_column(F.col(f"`{text}`"), vocab, pattern, **sizes))


def bpe_encode(docs: DataFrame, vocab: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the packed ids of ``text`` in ``out`` (never null)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, encode_column(F.col(f"`{text}`"), vocab, pattern))


def bpe_decode(docs: DataFrame, vocab: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the packed ids in ``out``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, decode_column(F.col(f"`{ids}`"), vocab))
