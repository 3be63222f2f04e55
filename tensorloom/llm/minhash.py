"""Near-duplicates by ProbMinHash over weighted word shingles.

A text's elements are its distinct shingles of ``ngram`` words (lower case,
split at white space), weighing ``1 + ln(count)``.  The probability Jaccard
index of two texts is the sum over shared elements ``i`` of
``1 / sum_j max(x_j / x_i, y_j / y_i)``; for equal weights it is the Jaccard
index.  The signature estimates it: each element has a Poisson process of its
weight's rate; each arrival falls into a random slot, which keeps the first
element to arrive; elements stop as soon as their next arrival is later than
the latest slot.

Texts are first collapsed to distinct contents, by SHA-256.  Texts that agree
in a band of the signature share a bucket, and pairs of a bucket are verified
exactly.  Not all pairs of a bucket are made: members are first compared with
the bucket's pivot, the member that shares most buckets with others, and
linked ones become one component.  Only buckets whose members are in different
components go on, with more pivots each round, until all have been, against
members of other components.  Three tests are part of that join, so that few
pairs are made: the bucket is the first of those the two share; one minus the
index is a metric, so the members' likeness to the pivot differs by at most
``1 - threshold``; and of the ``SLOTS`` slots of a longer signature, made for
these members only and kept as four bits each, not so few agree that a link is
four standard deviations away.  So
a bucket of a thousand copies costs little more than a thousand comparisons.
Of pairs at 0.8 that join two components, the bands (4 rows, 18 bands) miss a
share of 8e-5 and the slots one of 3e-5.

A null text is an empty one; texts without words equal only their exact
copies.  What is compared are contents, whatever their keys: different texts
with one key, or none, stay apart, and repeated rows share their class.
Columns beside key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import release, small_batches, stored
from .words import mix, weighted_shingles

NGRAM, THRESHOLD, BANDS, ROWS, SLOTS, BITS = 5, 0.8, 18, 4, 256, 4


def prob_minhash(ids: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """The signature; zeros if there are no elements."""
    first, held = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    time, live, step = np.zeros(len(ids)), np.arange(len(ids)), 0
    while len(live):
        step += 1
        r = mix(ids[live] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        slot = (mix(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(slots)).astype(np.int64)
        t = time[live]
        early = np.flatnonzero(t < first[slot])
        early = early[np.argsort(-t[early], kind="stable")]  # of several in one slot the first is written last
        first[slot[early]] = t[early]
        held[slot[early]] = ids[live][early]
        live = live[t < first.max()]
    return held


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact index of two weighted sets; ids ascending."""
    ids = np.union1d(x[0], y[0])
    a, b = np.zeros(len(ids)), np.zeros(len(ids))
    a[np.searchsorted(ids, x[0])] = x[1]
    b[np.searchsorted(ids, y[0])] = y[1]
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(a)))
    above = b.sum() - np.concatenate(([0.0], np.cumsum(b)))
    both = np.flatnonzero((a > 0) & (b > 0))
    upto = np.searchsorted(ratio, ratio[both], side="right")
    return float((1 / (below[upto] / a[both] + above[upto] / b[both])).sum())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def bands_column(text: Column, ngram: int, bands: int, rows: int) -> Column:
    """A hash for each band of the signature; none for a text without words."""

    def hashed(text: str | None) -> np.ndarray:
        ids, weights = weighted_shingles(text or "", ngram)
        if not len(ids):
            return np.zeros(0, np.int64)
        held = prob_minhash(ids, weights, bands * rows).reshape(bands, rows)
        h = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + held[:, k])
        return h.view(np.int64)

    @F.arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for texts in batches:
            yield _lists([hashed(t.as_py()) for t in texts])

    return of(text)


def planes_column(text: Column, ngram: int) -> Column:
    """``BITS`` bits of each of ``SLOTS`` slots: words of the lowest bits, of the next, and so on."""
    shifts = np.arange(64, dtype=np.uint64)

    def packed(text: str) -> np.ndarray:
        held = mix(prob_minhash(*weighted_shingles(text, ngram), SLOTS))
        planes = [((held >> np.uint64(k) & np.uint64(1)).reshape(-1, 64) << shifts).sum(axis=1, dtype=np.uint64) for k in range(BITS)]
        return np.concatenate(planes).view(np.int64)

    @F.arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists([packed(t.as_py()) for t in texts])

    return of(text)


def _may_link(threshold: float) -> Column:
    """Whether enough slots agree; columns ``planes`` and ``other_planes``."""
    words = SLOTS // 64
    differ = F.lit(0)
    for w in range(words):
        unlike = [F.get("planes", k * words + w).bitwiseXOR(F.get("other_planes", k * words + w)) for k in range(BITS)]
        any_bit = unlike[0]
        for x in unlike[1:]:
            any_bit = any_bit.bitwiseOR(x)
        differ = differ + F.bit_count(any_bit)
    agree = threshold + (1 - threshold) / 2**BITS  # by chance equal bits agree too
    least = SLOTS * agree - 4 * (SLOTS * agree * (1 - agree)) ** 0.5
    return differ <= SLOTS - int(least)


def compared(pairs: DataFrame, texts: DataFrame, ngram: int) -> DataFrame:
    """The pairs ``a``, ``b`` with the likeness ``near`` of their texts (``id``, ``body``)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def of(key: int, body: str) -> tuple:
            if key not in known:
                if len(known) > 300:
                    known.clear()
                known[key] = weighted_shingles(body, ngram)
            return known[key]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            near = [probability_jaccard(of(i, t), of(j, u)) for i, j, t, u in zip(a, b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], ["a", "b", "near"])

    a, b = texts.select(F.col("id").alias("a"), F.col("body").alias("x")), texts.select(F.col("id").alias("b"), F.col("body").alias("y"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long, near double")


def content_id(text: Column) -> Column:
    """What a text is known by: the SHA-256 of it (null: of the empty one)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _numbered(contents: DataFrame) -> DataFrame:
    """``contents`` (``content``, ``low``, others) with a number ``node`` that no two share.

    The number is the least key; a hash where there is none, or where other
    contents have that key too.
    """
    nodes = contents.withColumn("node", F.coalesce("low", F.xxhash64("content")))
    for salt in range(1, 64):
        shared = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
        if shared.isEmpty():
            return nodes
        first = nodes.join(shared, "node").groupBy("node").agg(F.min("content").alias("first"))
        again = (F.col("content") != F.col("first")) & F.col("first").isNotNull()
        nodes = nodes.join(first, "node", "left").withColumn("node", F.when(again, F.xxhash64("content", F.lit(salt))).otherwise(F.col("node")))
        nodes = stored(nodes.drop("first"), "nodes")
    raise RuntimeError("no distinct numbers")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: key, ``content``, ``node`` and ``class_id``.

    ``content`` is the :func:`content_id` of the text and ``node`` the number
    of that content: the least key of its rows, or a hash where that is
    missing or other contents have it too.  ``class_id`` is the least node of
    the class.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), content_id(body).alias("content"), body.alias("body"))
    signed = source.withColumn("bands", bands_column(F.col("body"), ngram, bands, rows))
    nodes = _numbered(stored(signed.groupBy("content").agg(F.min("key").alias("low"), F.first("bands").alias("bands")), "contents"))
    labels = _labels(nodes, source, ngram, threshold)
    classes = nodes.select("content", "node")
    if labels is None:
        classes = classes.withColumn("class_id", F.col("node"))
    else:
        classes = stored(classes.join(labels, classes["node"] == labels["id"], "left").select("content", "node", F.coalesce("label", "node").alias("class_id")), "classes")
    return source.select("key", "content").join(classes, "content").select(F.col("key").alias(key), "content", "node", "class_id")


def _labels(nodes: DataFrame, source: DataFrame, ngram: int, threshold: float) -> DataFrame | None:
    """``id`` and ``label`` of the nodes that have links; None if none has."""
    least = threshold - 1e-12
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = stored(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(spread.join(sizes, "bucket").select("bucket", "n", "node"), "members")
    most = members.agg(F.max("n")).head()[0]
    if not most:
        return None
    central = stored(members.groupBy("node").agg(F.sum("n").alias("shared")), "central")
    at = members.join(central, "node").select("bucket", "node", "shared")
    pivots = stored(at.groupBy("bucket").agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("pivot")), "pivots")
    members = stored(members.join(pivots, "bucket").select("bucket", "n", "pivot", "node"), "members")
    # the text of one row of each content, found by its key too: a hot content is many keys
    wanted = central.join(nodes.select("node", "content", "low"), "node").select(F.col("node").alias("id"), F.col("content").alias("own"), "low").hint("shuffle_hash")
    texts = source.join(wanted, (F.col("content") == F.col("own")) & F.col("key").eqNullSafe(F.col("low"))).select("id", "body")
    texts = stored(texts.dropDuplicates(["id"]), "texts")
    pairs = stored(members.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "pairs")
    tested = stored(compared(pairs, texts, ngram), "tested")
    links = tested.where(F.col("near") >= least)
    if links.isEmpty():
        labels = nodes.select(F.col("node").alias("id"), F.col("node").alias("label")).limit(0)
    else:
        labels = components(links)
    # of a bucket of two the one pair is tested; of others the likeness to the pivot is kept
    members = members.where("n > 2").withColumns({"a": F.least("pivot", "node"), "b": F.greatest("pivot", "node")})
    members = stored(members.join(tested, ["a", "b"], "left").select("bucket", "n", "node", F.coalesce("near", F.lit(1.0)).alias("near")), "members")
    tested, signatures, low, wide, done = tested.select("a", "b"), None, 0, 8, False
    while not done:
        done = wide >= most
        at = stored(members.join(labels, members["node"] == labels["id"], "left").select("bucket", "n", "node", "near", F.coalesce("label", "node").alias("label")), "at")
        split = stored(at.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "split")
        if split.isEmpty():
            break
        at = stored(at.join(split, "bucket"), "open")
        if signatures is None:  # later rounds need fewer
            some = texts.join(at.select(F.col("node").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi")
            some = some.select(F.col("id").alias("node"), planes_column(F.col("body"), ngram).alias("planes"))
            signatures = stored(some.join(nodes.select("node", "bands"), "node"), "signatures")
        at = stored(at.join(signatures, "node").withColumn("at", F.array_position("bands", F.col("bucket"))), "signed")
        # a member is a pivot in the round that its turn falls into; a pair is made when the first of the two is
        at = at.withColumn("turn", F.pmod(F.xxhash64("node"), F.col("n"))).where(F.col("turn") >= low)
        some = at.where(F.col("turn") < wide).select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("node", "label", "near", "bands", "planes")])
        # a bucket of an earlier band that both are in has made the pair
        first = ~F.exists(F.arrays_zip(F.slice("bands", F.lit(1), F.col("at") - 1).alias("x"), F.slice("other_bands", F.lit(1), F.col("at") - 1).alias("y")), lambda z: z["x"] == z["y"])
        met = (F.col("label") != F.col("other_label")) & ((F.col("turn") >= wide) | (F.col("node") < F.col("other_node"))) & (F.abs(F.col("near") - F.col("other_near")) <= 1 - least)
        pairs = at.join(some, (at["bucket"] == some["bucket"]) & met & _may_link(threshold) & first).withColumnRenamed("other_node", "other")
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = stored(compared(pairs, texts, ngram).where(F.col("near") >= least), "links")
            if not links.isEmpty():
                labels = _merged(labels, links)
        low, wide = wide, wide * 8
    return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the further ``links``."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    ends = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    ends = stored(ends.distinct(), "ends")
    if ends.isEmpty():
        return labels
    more = components(ends)
    up = more.select(F.col("id").alias("over"), F.col("label").alias("top"))
    old = labels.join(up, labels["label"] == up["over"], "left").select("id", F.coalesce("top", "label").alias("label"))
    return stored(old.unionByName(more.join(labels.select("id"), "id", "left_anti")), "labels")
