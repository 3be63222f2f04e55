"""Stupid-backoff language-model scores of documents.

Words are split at white space in lower case.  The score of a word after its
context is ``c(context word) / c(context)`` where the n-gram occurs at least
``min_count`` times in the corpus; else ``alpha`` times its score after the
context without the first word; at last ``c(word) / N``.  A document's score
is the sum of the logarithms.  Counts are of all documents, the scored one
included, so with ``min_count`` 2 an n-gram must also occur elsewhere.

The counts are a table partitioned by hash.  A row for each n-gram of each
document would be many times the corpus, so the exploded n-grams travel
packed: documents are dealt into batches of about ``batch_bytes`` of text by
hash, compressed by the task that reads them; a batch sends each partition of the table its distinct n-grams with
their counts, sorted, as differences, in one binary row; the partition sums them over batches
and answers each row with the totals in the same order; the answers are joined
to the batch's documents and summed by document.  A frequent n-gram is one
entry in each batch, so no partition is hot, and the numbers of batches and
partitions follow the size of the corpus, so no group outgrows a task.

Nulls are empty texts.  Documents without words have score 0.  Repeated rows
are counted, and scored, as often as they occur; rows of one key and one text
share a batch.  A very long text makes its batch longer.  Columns beside key
and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, stored
from .words import mix, word_hashes

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2


def ngrams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length from 1 to ``order`` the hashes of the n-grams, in order of their ends."""
    out = [mix(words + np.uint64(1))]
    for k in range(2, order + 1):
        if len(words) < k:
            break
        out.append(mix(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[k - 1 :] + np.uint64(k)))
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small, as bytes; those from 255 on in full after them."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return len(low).to_bytes(4, "little") + zlib.compress(low.tobytes() + counts[low == 255].astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    n, raw = int.from_bytes(data[:4], "little"), zlib.decompress(data[4:])
    out = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n)
    return out


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Ascending hashes as the first one and differences, in as many bytes each as the widest needs."""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + hashes[:1].tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked_hashes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _blob(rows: pa.Table) -> bytes:
    """Keys and texts, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows(blobs: pa.ChunkedArray) -> pa.Table:
    """The rows of several blobs, in order of key and text, whatever order those came in."""
    held = pa.concat_tables([pa.ipc.open_stream(b.as_py()).read_all() for b in blobs])
    return held.sort_by([("key", "ascending"), ("text", "ascending")])


def _dealt(batches: Iterator[pa.RecordBatch], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows ``batch``, ``key``, ``text`` as blobs by batch, of about ``most`` bytes of a task at a time."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("batch")
        ids = rows["batch"].to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        blobs = [_blob(rows.slice(a, b - a).select(["key", "text"])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]]), pa.array(blobs, pa.binary())], ["batch", "blob"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield out(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield out(held)


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[list[int]], np.ndarray]:
    """How many n-grams of each length each text has, and all their hashes in that order."""
    own = [ngrams(word_hashes(t.as_py()), order) for t in texts]
    return [[len(g) for g in grams] for grams in own], np.concatenate([np.zeros(0, np.uint64), *[g for grams in own for g in grams]])


def _cuts(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's share of the ascending hashes begins, and the end."""
    edges = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, edges), [len(distinct)]))


def scores(count: list[np.ndarray], alpha: float, min_count: int, order: int) -> tuple[float, int, int]:
    """Of one text: sum of logarithms without ``-log N``, words at the last level, words.

    ``count`` has for each length the counts of its n-grams in the corpus.
    """
    n = len(count[0])
    if not n:
        return 0.0, 0, 0
    logs = [np.log(c) for c in count]
    value, open_ = logs[0].copy(), np.ones(n, bool)
    value += math.log(alpha) * np.minimum(np.arange(n), order - 1)
    for k in range(2, len(count) + 1):  # the longest is asked last and so decides
        ends = np.arange(k - 1, n)
        seen = count[k - 1] >= min_count
        better = logs[k - 1] - logs[k - 2][:-1] + math.log(alpha) * (np.minimum(ends, order - 1) - (k - 1))
        value[ends[seen]] = better[seen]
        open_[ends[seen]] = False
    return float(value.sum()), int(open_.sum()), n


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, batch_bytes: int = 6_000_000, part_ngrams: int = 1_500_000) -> DataFrame:
    """One row for each row of ``docs``: key, ``n_words``, ``n_unseen`` (words scored by themselves) and ``log_score``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    batches, parts = max(1, size // batch_bytes), max(1, order * size // 6 // part_ngrams)
    rows = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(batches)).alias("batch"), "key", "text").mapInArrow(_dealt, "batch long, blob binary")

    def request(group: pa.Table) -> pa.Table:
        distinct, counts = np.unique(_grams(_rows(group["blob"])["text"], order)[1], return_counts=True)
        cuts = _cuts(distinct, parts)
        used = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "part": pa.array(used, pa.int64()),
            "batch": pa.array(np.full(len(used), group["batch"][0].as_py()), pa.int64()),
            "hashes": pa.array([_packed_hashes(distinct[cuts[p] : cuts[p + 1]]) for p in used], pa.binary()),
            "counts": pa.array([_packed(counts[cuts[p] : cuts[p + 1]]) for p in used], pa.binary()),
        })

    def total(group: pa.Table) -> pa.Table:
        hashes = [_unpacked_hashes(h.as_py()) for h in group["hashes"]]
        counts = np.concatenate([_unpacked(c.as_py()) for c in group["counts"]])
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(distinct))[at]
        ends = np.cumsum([0, *map(len, hashes)])
        # a count beyond 32 bits would need more than 4e9 occurrences of one n-gram; it stays at the limit
        answers = [_packed(np.minimum(sums[a:b], 2**32 - 1)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"batch": group["batch"], "part": group["part"], "totals": pa.array(answers, pa.binary())})

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(group["blob"])
        sizes, grams = _grams(rows["text"], order)
        at = np.unique(grams, return_inverse=True)[1]
        found = sorted(zip(answers["part"].to_pylist(), answers["totals"].to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.uint32), *[_unpacked(t) for _, t in found]])[at].astype(np.float64)
        values, begin = [], 0
        for own in sizes:
            ends = np.cumsum([begin, *own]).tolist()
            values.append(scores([counts[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], alpha, min_count, order))
            begin = ends[-1]
        return pa.table({
            "key": rows["key"],
            "value": pa.array([v[0] for v in values], pa.float64()),
            "n_unseen": pa.array([v[1] for v in values], pa.int64()),
            "n_words": pa.array([v[2] for v in values], pa.int64()),
        })

    asked = rows.groupBy("batch").applyInArrow(request, "part long, batch long, hashes binary, counts binary")
    table = asked.groupBy("part").applyInArrow(total, "batch long, part long, totals binary")
    found = rows.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(score, "key long, value double, n_unseen long, n_words long")
    found = stored(found, "scores")
    words = found.agg(F.sum("n_words")).head()[0] or 1
    return found.select(F.col("key").alias(key), "n_words", "n_unseen", (F.col("value") - F.col("n_unseen") * math.log(max(1, words))).alias("log_score"))
