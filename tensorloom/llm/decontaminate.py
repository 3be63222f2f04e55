"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words, weighed by TF-IDF over hashed terms;
document frequencies are counted over the whole corpus.  A randomised SVD of
the benchmark's passages ``A`` gives the latent basis: the range of ``(A'A)^q``
applied to random vectors.  The products are made by the executors and summed
by term.

All passages of all documents that have a term of the benchmark are then
projected; other terms count for nothing, so what stands beside an item does
not hide it.  A passage is a candidate for a passage of an item if it holds
``HOLDS`` of it, that is their product by the item's own square (less of
passages shorter than ``WINDOW``), or if it is as
long as ``OF_ITEM`` of it and their cosine reaches ``cosine``.  A verbatim item of
at most ``WINDOW`` words has half of its square in one of the windows over it,
wherever they begin.  Before a window is projected its products are bounded:
each term adds at most the largest product it has with any passage of a group
of ``_GROUP``, so a window whose terms' bounds do not add up to the least share
in any group has no candidate.  The bound loses nothing.  A candidate is
checked in the words around it: the longest common subsequence with the whole
item must cover ``covers`` of the item's words, or, for paraphrases,
``answer_covers`` of them and in the neighbourhood most of the item's answer,
that is the rarest words of its last sentence.  Of an item of less than ``SHORT``
words the subsequence must lie within its own length and two words more.

Items are dealt with in blocks of about ``block`` rows, so what goes to the
executors is bounded however large the benchmark is; each block is one pass.
Documents are not shuffled.  A null text is an empty one; empty documents and
items match nothing; empty tables give no rows.  For an item without a key a
hash of its text stands; items that share a key are each looked for.  Repeated
documents give repeated results, one row for each item they hold (of several
places the one with the largest share).  Very long texts are searched whole, a
stretch at a time.  Columns beside key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import release, small_batches
from .words import word_hashes

TERMS, RANK, WINDOW, STRIDE = 1 << 18, 256, 24, 12
#: Shares of the item's passage: of its square in the product with it, of its length beside the cosine.
HOLDS, OF_ITEM = 0.4, 0.45
SHORT = 12
_CHUNK = 512  # windows that are projected at once
_GROUP = 48  # passages whose bounds are kept together
_SPAN = STRIDE << 12  # words whose bounds are added at once


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).view(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text", pieces: int = 64) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents.

    Each task counts its own documents; its counts, packed in ``pieces`` rows,
    are added in two steps, so that no group holds those of all tasks.
    """
    width = TERMS // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total[np.unique(_terms(word_hashes(t.as_py())))] += 1
                n += 1
        if n:
            rows = [total[k * width : (k + 1) * width].tobytes() for k in range(pieces)] + [np.array([n]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces + 1), pa.int64()), pa.array(rows, pa.binary())], ["piece", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum([np.frombuffer(c.as_py(), np.int64) for c in group["counts"]])
        return pa.table({"piece": group["piece"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(count, "piece long, counts binary").withColumn("some", F.spark_partition_id() % 200)
    rows = rows.groupBy("piece", "some").applyInArrow(add, "piece long, counts binary").groupBy("piece").applyInArrow(add, "piece long, counts binary")
    found = {r["piece"]: np.frombuffer(r["counts"], np.int64) for r in rows.collect()}  # as many rows as pieces
    if not found:
        return np.zeros(TERMS, np.int64), 0
    return np.concatenate([found[k] for k in range(pieces)]), int(found[pieces][0])


def windows(n: int, width: int, stride: int) -> list[tuple[int, int]]:
    """Windows that cover ``n`` words; the last ends with them."""
    if n <= width:
        return [(0, n)] if n else []
    starts = list(range(0, n - width, stride)) + [n - width]
    return [(a, a + width) for a in starts]


def _weights(passage: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a passage and their TF-IDF, of unit length."""
    ids, counts = np.unique(passage, return_counts=True)
    w = counts * idf[ids]
    return ids, w / max(float(np.sqrt((w * w).sum())), 1e-9)


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular space of TF-IDF passages.

    ``passages`` has a column ``words`` of word hashes.  Gives the terms that
    occur and an orthonormal basis with a row for each.  Each round multiplies
    by ``A'A``: rows of the product are made by task and summed by term, so
    the driver gets as many rows as the passages have terms.
    """
    names = [f"z{k}" for k in range(rank)]
    terms, q = np.zeros(0, np.int64), None
    for _ in range(rounds):

        def product(batches: Iterator[pa.RecordBatch], terms: np.ndarray = terms, q: np.ndarray | None = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [_weights(_terms(np.array(words.as_py(), np.int64).view(np.uint64)), idf) for words in batch.column(0)]
                at = np.unique(np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in own]]))
                # the random vectors of a term depend on the term only
                rows = np.stack([np.random.default_rng((seed, int(t))).standard_normal(rank) for t in at]) if q is None and len(at) else q[np.searchsorted(terms, at)] if len(at) else np.zeros((0, rank))
                total = np.zeros((len(at), rank))
                for ids, w in own:
                    k = np.searchsorted(at, ids)
                    total[k] += w[:, None] * (w @ rows[k])
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[:, k]) for k in range(rank)]], ["term", *names])

        rows = passages.select("words").mapInArrow(product, "term long, " + ", ".join(f"{n} double" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).orderBy("term").toArrow()
        if not rows.num_rows:
            return terms, np.zeros((0, rank))
        terms = rows["term"].to_numpy()
        q = np.linalg.qr(np.stack([rows[n].to_numpy() for n in names], axis=1))[0]
        q = np.pad(q, ((0, 0), (0, rank - q.shape[1])))  # fewer terms than dimensions
    return terms, q


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        if m := places.get(x, 0):
            u = row & m
            row = ((row + u) | (row - u)) & whole
    return len(a) - row.bit_count()


@dataclass
class Item:
    key: int
    words: list[int]
    answer: set[int]


def _answer(text: str, idf: np.ndarray, most: int = 6) -> set[int]:
    """The rarest words of the last sentence."""
    last = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if s.strip()][-1:]
    h = word_hashes(last[0] if last else "")
    order = np.argsort(-idf[_terms(h)], kind="stable")[:most]
    return set(h[order].tolist())


class Index:
    """Items of one block with the projected passages they are found by."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, terms: np.ndarray, basis: np.ndarray):
        self.row = np.zeros(TERMS, np.int32)  # of the table, by term; row 0 is empty
        self.row[terms] = np.arange(1, len(terms) + 1)
        basis = np.vstack([np.zeros((1, basis.shape[1])), basis])
        self.items, owner, found, sizes = [], [], [], []
        for key, text in items:
            h = word_hashes(text)
            for a, b in windows(len(h), WINDOW, STRIDE // 2):
                owner.append(len(self.items))
                sizes.append(b - a)
                t = _terms(h[a:b])
                found.append(idf[t] @ basis[self.row[t]])
            if len(h):
                self.items.append(Item(key, h.tolist(), _answer(text, idf)))
        self.owner = np.array(owner, np.int64)
        found = np.array(found).reshape(len(owner), basis.shape[1])
        self.energy = np.sqrt((found * found).sum(axis=1)).astype(np.float32)  # what the basis keeps of the passage's length
        self.vectors = (found / np.maximum(self.energy, 1e-9)[:, None]).T.astype(np.float32).copy()
        # what must be held of: less of few words, whose part the rest of a window may take away
        self.held = self.energy * (0.3 + 0.7 * np.minimum(np.array(sizes) / WINDOW, 1)).astype(np.float32)
        self.table = basis.astype(np.float32)
        self.table[1:] *= idf[terms][:, None]
        own = (self.vectors / np.maximum(self.held, np.float32(1e-9))).T  # products as shares of the passage's own
        cuts = range(0, len(own), _GROUP)
        self.bounds = np.zeros((len(self.table), len(cuts)), np.float32)
        for k, a in enumerate(cuts):
            for r in range(0, len(self.table), 4096):
                self.bounds[r : r + 4096, k] = np.maximum((self.table[r : r + 4096] @ own[a : a + _GROUP].T).max(axis=1), 0)

    def _open(self, row: np.ndarray, least: float) -> np.ndarray:
        """The numbers of the windows of which some product may be as large as ``least``."""
        sums = np.concatenate([np.add.reduceat(self.bounds[row[a : a + _SPAN]], np.arange(0, min(_SPAN, len(row) - a), STRIDE), axis=0) for a in range(0, len(row), _SPAN)])
        if len(sums) > 1:  # a window is two strides
            sums = sums[:-1] + sums[1:]
        return np.flatnonzero((sums >= least * 0.999).any(axis=1))

    def search(self, h: np.ndarray, cosine: float, covers: float, answer_covers: float) -> dict[int, tuple[float, float, float]]:
        """By item number: cosine, share of common subsequence, share of answer."""
        found: dict[int, tuple[float, float, float]] = {}
        n = len(h)
        if not n or not self.items:
            return found
        row = self.row[_terms(h)]
        at = self._open(row, min(HOLDS, OF_ITEM * cosine))
        row = np.append(row, np.zeros(2 * WINDOW, row.dtype))  # beyond the last word is nothing
        for r, c, score in self._candidates(row, at, cosine):
            k = int(self.owner[c])
            best = found.get(k, (0, 0, 0))[1]
            if best == 1:
                continue
            item = self.items[k]
            m, start = len(item.words), r * STRIDE
            near = h[max(0, start - m) : start + WINDOW + m].tolist()
            if m < SHORT:
                share = max(common_subsequence(item.words, near[j : j + m + 2]) for j in range(max(1, len(near) - m - 1))) / m
            else:
                share = common_subsequence(item.words, near) / m
            answer = len(item.answer & set(near)) / max(1, len(item.answer))
            if share > best and (share >= covers or share >= answer_covers and answer >= 0.6):
                found[k] = (score, share, answer)
        return found

    def _candidates(self, row: np.ndarray, at: np.ndarray, cosine: float) -> Iterator[tuple[int, int, float]]:
        """Number of the window, of the item's passage, and cosine."""
        strides = row[: len(row) // STRIDE * STRIDE].reshape(-1, STRIDE)
        for first in range(0, len(at), _CHUNK):
            some = at[first : first + _CHUNK]
            own = np.union1d(some, some + 1)
            sums = np.stack([np.add.reduce(self.table[r]) for r in strides[own]])
            k = np.searchsorted(own, some)
            parts = sums[k] + sums[k + 1]
            length = np.maximum(np.sqrt(np.einsum("ij,ij->i", parts, parts)), np.float32(1e-9))
            product = parts @ self.vectors
            r, c = np.nonzero(product >= min(HOLDS, OF_ITEM * cosine) * self.held)  # so much in either case
            product, score = product[r, c], product[r, c] / length[r]
            found = (product >= HOLDS * self.held[c]) | (score >= cosine) & (length[r] >= OF_ITEM * self.energy[c])
            yield from zip(some[r[found]].tolist(), c[found].tolist(), score[found].tolist(), strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = 500, cosine: float = 0.5, covers: float = 0.75, answer_covers: float = 0.5) -> DataFrame:
    """One row for each document and benchmark item that it holds.

    Columns: key, item, ``cosine``, ``share`` (of the item's words in the
    common subsequence) and ``answer_share``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    df, size = document_frequencies(docs, text)
    idf = np.log((1 + size) / (1 + df)).astype(np.float32) + np.float32(0.1)
    schema = "doc_key long, item_key long, cosine double, share double, answer_share double"
    names = {"doc_key": key, "item_key": item}
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col(f"`{item}`").cast("long"), F.xxhash64("text")).alias("item_key"), "text")
    out = spark.createDataFrame([], schema)
    seen = None
    while True:
        rows = items if seen is None else items.where(F.col("item_key") > seen)
        held = sorted((r["item_key"], r["text"]) for r in rows.orderBy("item_key").limit(block).collect())
        if not held:
            break
        seen = held[-1][0]
        held += [(r["item_key"], r["text"]) for r in items.where(F.col("item_key") == seen).collect() if (r["item_key"], r["text"]) not in held]  # rows that share the last key
        texts = spark.createDataFrame([(t,) for _, t in held], "text string")
        index = Index(held, idf, *randomised_svd(_passages(texts), idf))
        out = out.unionByName(_search(docs.select(F.col(f"`{key}`").cast("long").alias("doc_key"), F.col(f"`{text}`").alias("text")), index, schema, cosine, covers, answer_covers))
        if len(held) < block:
            break
    return out.withColumnsRenamed(names)


def _passages(texts: DataFrame) -> DataFrame:
    """Word hashes of the windows of texts, half a window apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0):
                h = word_hashes(t.as_py()).view(np.int64)
                out += [h[a:b] for a, b in windows(len(h), WINDOW, STRIDE)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["words"])

    return texts.mapInArrow(cut, "words array<long>")


def _search(docs: DataFrame, index: Index, schema: str, cosine: float, covers: float, answer_covers: float) -> DataFrame:
    """Leaks of one block of items.  The index has at most ``block`` items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (c, s, a) in own.search(word_hashes(text.as_py()), cosine, covers, answer_covers).items():
                    out.append({"doc_key": key, "item_key": own.items[k].key, "cosine": c, "share": s, "answer_share": a})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_key", pa.int64()), ("item_key", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer_share", pa.float64())]))

    return docs.mapInArrow(search, schema)
