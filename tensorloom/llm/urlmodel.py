"""URL filter: host rules first, else a ratio of two character models.

Two variable-order Markov models over the characters of a URL, one of accepted
and one of rejected URLs, are smoothed by interpolation: the estimate of each
order leans on that of the order below the more, the rarer its context was
(Witten-Bell).  Contexts are hashed into tables of fixed size.  A URL is
blocked when its log-likelihood difference by character exceeds a threshold,
the least one, not below 0, at which at most ``false_block`` of the accepted
URLs are blocked by models that never saw their hosts.

Labels begin with a few seed words of hosts (``SEEDS``) that mark rejected
URLs; the rest begin as accepted.  The models then correct that: hosts are
dealt into folds, the URLs of a fold are scored by models of the other folds,
which never saw those hosts, and become rejected if they look more like the
rejected ones; after ``rounds`` of that the models are trained on all.  So
hosts without a seed word are rejected if they are built like rejected ones.
It takes some dozens of URLs with seed words; of fewer little is learned.  URLs that a rule decides are left out: rules state a
policy.  Counts, scores and the threshold are of all other distinct URLs: tasks
count slots, Spark adds them up, and only tables of fixed size are broadcast.

A null URL, or one without ``://``, has an empty host and path and fits no
rule; the model judges it as the text it is, and accepts null and empty ones.
Repeated rows get equal results; other columns pass through, but for those
named ``host``, ``path``, ``rule``, ``verdict`` and ``score``, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

# fixed values: (verdict, host and path of the rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# fixed values: words of hosts that are first taken to mark rejected URLs
SEEDS = ("ads", "casino", "spam")

ORDER, BUCKETS = 5, 1 << 18
PIECE = 1 << 18  # characters that a task holds slots of at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: len(r[1])):  # the longest comes last and so is asked first
        domain, slash, rest = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _codes(url: str) -> np.ndarray:
    raw = np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate((np.ones(ORDER, np.uint8), raw, np.full(1, 2, np.uint8)))


def _slots(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order (rows) and character of all URLs: the slots of context and of context and character; where URLs begin."""
    codes = [_codes(u) for u in urls]
    starts = np.cumsum([0, *[len(c) - ORDER for c in codes]])
    joined = np.concatenate(codes).astype(np.uint64)
    at = np.arange(starts[-1]) + ORDER * (np.repeat(np.arange(len(codes)), np.diff(starts)) + 1)  # places of the characters to be told
    context, contexts, full = np.zeros(len(at), np.uint64), [], []
    for k in range(ORDER + 1):
        if k:
            context = (context + joined[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = context ^ (context >> np.uint64(29)) ^ np.uint64(k)
        both = (mixed + joined[at] + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
        contexts.append((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(46))
        full.append((both ^ (both >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(46))
    return np.array(contexts).astype(np.int64) % BUCKETS, np.array(full).astype(np.int64) % BUCKETS, starts[:-1]


def _pieces(urls: list[str]) -> Iterator[slice]:
    """Stretches of about ``PIECE`` characters."""
    first = held = 0
    for i, url in enumerate(urls):
        held += len(url)
        if held >= PIECE or i + 1 == len(urls):
            yield slice(first, i + 1)
            first, held = i + 1, 0


class MarkovModel:
    """Counts by order, and the interpolated log-likelihood.  The tables travel compressed."""

    def __init__(self, packed: dict[int, bytes], characters: int):
        self.packed, self.characters = packed, characters

    @cached_property
    def tables(self) -> np.ndarray:
        """For each order: how often each slot of context and character, and of context, occurs, and after how many kinds of characters."""
        out = np.zeros((ORDER + 1, 3, BUCKETS), np.float32)
        for k, data in self.packed.items():
            out[k] = np.frombuffer(zlib.decompress(data), "<f4").reshape(3, BUCKETS)
        return out

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "characters": self.characters}

    def log_likelihood(self, contexts: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Of each character."""
        p = np.full(contexts.shape[1], 1 / 256)
        for k, (count, total_of, kinds_of) in enumerate(self.tables):
            total, kinds = total_of[contexts[k]], np.maximum(kinds_of[contexts[k]], 1)
            p = (count[full[k]] + kinds * p) / (total + kinds)
        return np.log(p)


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float = 0.0

    def scores(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood as rejected less that as accepted, by character; 0 for an empty URL."""
        out = np.zeros(len(urls))
        own = np.array([i for i, u in enumerate(urls) if u], np.int64)
        kept = [urls[i] for i in own]
        for cut in _pieces(kept):
            contexts, full, starts = _slots(kept[cut])
            more = self.rejected.log_likelihood(contexts, full) - self.accepted.log_likelihood(contexts, full)
            out[own[cut]] = np.add.reduceat(more, starts) / np.diff(np.append(starts, len(more)))
        return out


def _counts(urls: DataFrame) -> DataFrame:
    """How often each slot occurs in each cell (fold, label and order); contexts follow the slots with a character, which name a context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["url"].to_pylist()
            group = batch["fold"].to_numpy().astype(np.int64) * 2 + batch["bad"].to_numpy(zero_copy_only=False)
            for cut in _pieces(texts):
                contexts, full, starts = _slots(texts[cut])
                of = np.repeat(group[cut], np.diff(np.append(starts, full.shape[1])))
                for k in range(ORDER + 1):
                    key, n = np.unique((of * BUCKETS + full[k]) * BUCKETS + contexts[k], return_counts=True)
                    slots, first = np.unique(key // BUCKETS, return_index=True)
                    alone, m = np.unique(of * BUCKETS + contexts[k], return_counts=True)
                    columns = [
                        np.concatenate((slots // BUCKETS, alone // BUCKETS)) * (ORDER + 1) + k,
                        np.concatenate((slots % BUCKETS, alone % BUCKETS + BUCKETS)),
                        np.concatenate((np.add.reduceat(n, first), m)),
                        np.concatenate((key[first] % BUCKETS, alone % BUCKETS)),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cell", "slot", "n", "context"])

    rows = urls.select("url", "fold", "bad").mapInArrow(count, "cell long, slot long, n long, context long")
    return rows.groupBy("cell", "slot").agg(F.sum("n").alias("n"), F.min("context").alias("context"))


def _models(urls: DataFrame, folds: int, apart: bool) -> dict[int, UrlModel]:
    """Models of all URLs as they are labelled: for each fold of the other folds, or one (-1) of all.

    A group is the tables of an order and a label, of fixed size; so is what comes to the driver.
    """

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        cell, slot, n, context = (rows[c].to_numpy() for c in ("cell", "slot", "n", "context"))
        counts, context_of = np.zeros((folds, 2 * BUCKETS), np.int64), np.full((folds, 2 * BUCKETS), BUCKETS)
        at = (cell // (2 * (ORDER + 1)), slot)
        counts[at], context_of[at] = n, context
        out = []
        for k in range(folds) if apart else [-1]:
            rest = np.arange(folds) != k
            count, total = counts[rest].sum(axis=0).reshape(2, BUCKETS)
            kinds = np.bincount(context_of[rest, :BUCKETS].min(axis=0)[count > 0], minlength=BUCKETS)
            out.append({"part": key[0].as_py(), "fold": k, "characters": int(total.sum()), "packed": zlib.compress(np.stack((count, total, kinds)).astype("<f4").tobytes(), 1)})
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("fold", pa.int64()), ("characters", pa.int64()), ("packed", pa.binary())]))

    rows = _counts(urls).withColumn("part", F.col("cell") % (2 * (ORDER + 1)))
    made = rows.groupBy("part").applyInArrow(pack, "part long, fold long, characters long, packed binary").collect()

    def model(fold: int, bad: int) -> MarkovModel:
        own = {r.part % (ORDER + 1): r for r in made if r.fold == fold and r.part // (ORDER + 1) == bad}
        return MarkovModel({k: bytes(r.packed) for k, r in own.items()}, own[0].characters if own else 0)

    return {k: UrlModel(model(k, 0), model(k, 1)) for k in (range(folds) if apart else [-1])}


def _rescored(urls: DataFrame, folds: int) -> DataFrame:
    """``urls`` scored by models that did not see a URL's host; ``was`` is the label before, ``bad`` that after the correction."""
    shared = urls.sparkSession.sparkContext.broadcast(_models(urls, folds, True))  # tables of fixed size

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, fold, bad in batches:
            texts, fold = urls.to_pylist(), fold.to_numpy()
            out = np.where(bad.to_numpy(zero_copy_only=False), 1.0, -1.0)
            for k, model in shared.value.items():
                own = np.flatnonzero(fold == k)
                if model.rejected.characters and len(own):
                    out[own] = model.scores([texts[i] for i in own])
            yield pa.array(out, pa.float64())

    made = urls.select("url", "fold", F.col("bad").alias("was"), scored("url", "fold", "bad").alias("score"))
    made = stored(made.withColumn("bad", F.col("was") | (F.col("score") > 0)), "urls")
    shared.destroy()
    return made


def _threshold(urls: DataFrame, false_block: float) -> float:
    """The least number of thousandths, from 0, above which at most ``false_block`` of the URLs are that the models took as accepted."""
    bins = urls.where(~F.col("was")).groupBy(F.greatest(F.ceil(F.col("score") * 1000), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    found = sorted(((r.bin, r.n) for r in bins.collect()), reverse=True)  # a bounded range of scores
    left = false_block * sum(n for _, n in found)
    for place, n in found:
        left -= n
        if left < 0:
            return place / 1000
    return 0.0


def fit(pages: DataFrame, url: str = "url", rules=RULES, rounds: int = 3, folds: int = 5, false_block: float = 0.005) -> UrlModel:
    """Train on all distinct URLs of ``pages`` that no rule decides."""
    spark, at = pages.sparkSession, F.col(f"`{url}`")
    host, path = host_of(at), path_of(at)
    seeded = F.regexp_like(host, F.lit(r"(^|[.-])(" + "|".join(SEEDS) + r")([.-]|$)"))
    rows = pages.where(at.isNotNull() & rule_of(host, path, rules)[0].isNull()).select(at.alias("url"), (F.crc32(host) % folds).alias("fold"), seeded.alias("bad")).dropDuplicates()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), pages.count() // 8000 + 1)  # tasks of seconds, not of MB
    urls = stored(rows.repartition(parts, "url"), "urls")
    for _ in range(rounds):
        urls = _rescored(urls, folds)
        if urls.where("bad and not was").isEmpty():
            break  # further rounds would change nothing
    model = _models(urls, folds, False)[-1]
    model.threshold = _threshold(urls, false_block) if model.rejected.characters else float("inf")  # of no rejected URLs nothing is learned
    return model


def judge(pages: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""

    shared = pages.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array(shared.value.scores(urls.to_pylist()), pa.float64())

    at = F.col(f"`{url}`")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return pages.withColumns({"host": host_of(at), "path": path_of(at), "score": scored(at)}).withColumns(
        {"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") > model.threshold, "block").otherwise("allow"))}
    )
