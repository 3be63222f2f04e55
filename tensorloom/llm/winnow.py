"""Document fingerprints by winnowing.

Every run of ``gram`` characters is hashed with a rolling polynomial; of each
``window`` neighbouring hashes the least is chosen, the rightmost one among
equals, and kept with its position.  Two texts that share a passage of
``gram + window - 1`` characters share a fingerprint (:func:`guarantee`).

A fingerprint is written as ``position:hash`` pairs (hash in eight hex
digits), joined by commas.  A text shorter than ``gram`` has one pair, of the
whole text; an empty or null text has an empty fingerprint.  Likeness is the
Jaccard index of the sets of hashes; of two empty ones it is 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import release, small_batches

GRAM, WINDOW = 10, 24
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
_CHUNK = 1 << 19


def guarantee(gram: int = GRAM, window: int = WINDOW) -> int:
    """The length of a shared passage that is always found."""
    return gram + window - 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(points: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of every run of ``gram`` characters.

    Runs are doubled in length, then joined as the bits of ``gram`` say.
    """
    power, size, h = _BASE, 1, points.astype(np.uint64)
    out, length = None, 0
    while True:
        if gram & size:
            if out is None:
                out, length = h, size
            else:
                n = len(points) - length - size + 1
                out, length = h[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + out[size : size + n], length + size
        if 2 * size > gram:
            break
        n = len(points) - 2 * size + 1
        h = h[:n] * np.uint64(power) + h[size : size + n]
        power, size = power * power & _WRAP, 2 * size
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _choose(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, rightmost among equals."""
    window = min(window, len(h))
    low, at, size = h, np.arange(len(h)), 1

    def join(step: int, low: np.ndarray, at: np.ndarray):
        a, b = low[:-step], low[step:]
        right = b <= a
        return np.where(right, b, a), np.where(right, at[step:], at[:-step])

    while 2 * size <= window:
        low, at = join(size, low, at)
        size *= 2
    if size < window:
        low, at = join(window - size, low, at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the fingerprint."""
    points = _points(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    gram = min(gram, len(points))
    places, hashes = [], []
    grams = len(points) - gram + 1
    for start in range(0, max(1, grams - window + 1), _CHUNK):
        stop = min(grams, start + _CHUNK + window - 1)
        h = rolling(points[start : stop + gram - 1], gram)
        at = _choose(h, window)
        places.append(at + start)
        hashes.append((h[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def spell(places: np.ndarray, hashes: np.ndarray) -> str:
    return ",".join([f"{p}:{h:08x}" for p, h in zip(places.tolist(), hashes.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with the fingerprint of ``text``; other columns pass through."""

    @F.arrow_udf("string")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([spell(*winnow(t.as_py() or "", gram, window)) for t in texts], pa.string())

    return docs.withColumn(out, spelled(F.col(f"`{text}`")))


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    places = F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(bounds)) & (F.get(places, at + by - 1) < key), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows dealt and sorted so that each stands before its follower.

    The order is by ``key`` descending, nulls last, repeated keys by text
    hash; the follower of the last row is the first.  The keys are cut into
    blocks at approximate quantiles, and a key (or null) that many rows have
    into stretches of the text hash.  A block is sorted in one partition, and
    after its last row comes a guest (``guest`` true): the first row of the
    next block, of which there is one for each block, however large the table.
    So nothing but the blocks' borders passes through the driver, and each
    text is shuffled once.  Equal rows share a block.
    """
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(4 * wide, 4000)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    shares = [(i + 1) / blocks for i in range(blocks - 1)]
    bounds = rows.agg(F.percentile_approx("key", shares, 20 * blocks)).head()[0] or []
    bounds = sorted({int(b) for b in bounds})
    block = F.when(F.col("key").isNull(), F.lit(-1)).otherwise(_rank(F.col("key"), bounds))
    # rows of the block's highest possible key, which may be many; those without a key are such rows
    top = F.col("key").isNull() | F.coalesce(F.col("key") == F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("block")), F.lit(False))
    rows = rows.withColumn("block", block).withColumn("top", top)
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("top").cast("int")).alias("top")).collect()  # as many rows as there are blocks
    if not sizes:
        return rows.withColumn("guest", F.lit(False)), "block"
    fair = -(-sum(r["n"] for r in sizes) // blocks)
    cut = {r["block"]: -(-r["top"] // fair) for r in sizes if r["top"] > 4 * fair}
    stretch = F.lit(0)
    for k, n in sorted(cut.items()):  # at most a quarter of the blocks
        part = F.when(F.col("top"), F.floor((F.shiftright("hash", 32) + (1 << 31)) * n / (1 << 32)).cast("int")).otherwise(n)
        stretch = F.when(F.col("block") == k, part).otherwise(stretch)
    rows = rows.withColumn("stretch", stretch).drop("top")
    # of each stretch the row that comes first: the highest key, the least hash
    firsts = rows.groupBy("block", "stretch").agg(F.max(F.struct("key", F.bitwise_not(F.col("hash")).alias("flip"))).alias("head")).collect()  # at most twice as many as blocks
    heads = sorted(((r["block"], -r["stretch"], r["head"]["key"], ~r["head"]["flip"]) for r in firsts), key=lambda h: h[:2])
    place = {(b, -s): i for i, (b, s, *_) in enumerate(heads)}
    # the head of each stretch visits the one before it in the order, the very first one the last
    visits = [(k, h, (i + 1) % len(heads)) for i, (_, _, k, h) in enumerate(heads)]
    small = spark.createDataFrame(visits, "head long, head_hash long, host int")  # as many rows as there are stretches
    names = spark.createDataFrame([(b, s, i) for (b, s), i in place.items()], "block int, stretch int, place int")
    own = rows.join(F.broadcast(names), ["block", "stretch"]).select("key", "text", "hash", F.col("place").alias("block"))
    guests = rows.join(F.broadcast(small), F.col("key").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash"))).select("key", "text", "hash", F.col("host").alias("block"), F.lit(True).alias("guest"))
    dealt = (
        own.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .repartition(wide, "block")
        .sortWithinPartitions("block", "guest", F.desc_nulls_last("key"), "hash")
    )
    return dealt, "block"


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint each text, its edited form and the likeness of its follower.

    The edited text replaces the last half of the characters by as many of
    the follower's first ones, or all.  Rows stream through each partition;
    two texts are held at a time.
    """
    small_batches(docs.sparkSession)
    dealt, _ = with_following(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = None  # block, key, text and fingerprint of the row that waits for its follower
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("block", "key", "text", "guest")]
            for block, k, body, guest in zip(*columns, strict=True):
                if guest and (held is None or held[0] != block):
                    continue  # a repeated guest
                own = winnow(body, gram, window)
                if held is not None and held[0] == block:
                    out.append(_compared(*held[1:], body, own[1], gram, window))
                held = None if guest else (block, k, body, own)
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(key, body: str, own, after: str, after_hashes: np.ndarray, gram: int, window: int) -> dict:
    half = math.floor(len(body) / 2)
    edited = body[: len(body) - half] + after[:half]
    other = winnow(edited, gram, window)
    return {
        "doc_id": key,
        "n_chars": len(body),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": spell(*own),
        "edited_fingerprint": spell(*other),
        "near_edited": likeness(own[1], other[1]),
        "near_next": likeness(own[1], after_hashes),
    }
