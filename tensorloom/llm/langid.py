"""Language identification from averaged hashed subword embeddings.

A text is its lower-cased characters with every run of other ASCII signs as
one space; its 1-, 2- and 3-grams are hashed into a table of embeddings, whose
mean goes through a linear softmax.  Embeddings and softmax are trained by
stochastic gradient descent in numpy.  One part of the labelled sample is kept
back: on short pieces of it, where errors do occur, a temperature is fitted,
and the score below which at most ``reject_rate`` of the correctly labelled
pieces fall becomes the rejection threshold.  A softmax divides the vote among
the known labels even if it is none of them, so there is a second threshold,
for the share of n-grams never met: at most ``reject_rate`` of the pieces of
all texts of the sample have more that no other text has.  ``_DOUBT`` more
n-grams are counted as met, as a few unmet ones say little of a short text.

The fit uses a bounded sample: up to about ``per_label`` rows of each label (fewer
where all labels together would have more than ``most_rows``), picked by a hash
of their id, and of each an excerpt of at most ``excerpt`` characters
at a hashed place.  Prediction reads whole texts.

A null text, or one without letters, is ``und`` with score 0 and rejected; so
is every text when there is nothing to learn from.  Rows are judged one by
one: repeated rows get equal results, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import release, small_batches

_LETTER = regex.compile(r"\p{L}")
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)
_CHUNK = 1 << 18
_DOUBT = 60


def _hashes(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the 1-, 2- and 3-grams, a chunk of the text at a time."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, max(1, len(points)), _CHUNK):
        c = points[at : at + _CHUNK + 2]
        c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))] if len(c) else c
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:] if len(c) > 1 else one[:0]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:] if len(c) > 2 else one[:0]
        for h in (one, two + np.uint32(0x9E3779B9), three + np.uint32(0x7F4A7C15)):
            h = h ^ (h >> np.uint32(16))
            yield ((h * np.uint32(2246822519)) >> np.uint32(8)) % np.uint32(buckets)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # embedding times softmax weights, by bucket
    bias: np.ndarray
    met: np.ndarray  # texts of the sample with an n-gram of the bucket
    temperature: float = 1.0
    threshold: float = 0.0
    most_unmet: float = 1.0

    def measure(self, text: str, others: int = 1) -> tuple[np.ndarray, float]:
        """Logits, and the share of n-grams that fewer than ``others`` texts have."""
        total, n, unmet = np.zeros(len(self.labels)), 0, 0
        for h in _hashes(text, len(self.table)):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
            unmet += len(h) - int(np.count_nonzero(self.met[h] >= others))
        return total / max(n, 1) + self.bias, unmet / (n + _DOUBT)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, score from 0 to 1, and whether it is rejected."""
        if not text or not self.labels or not _LETTER.search(text):
            return "und", 0.0, True
        z, unmet = self.measure(text)
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k])), bool(p[k] < self.threshold or unmet > self.most_unmet)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, reject_rate: float = 0.001, seed: int = 7) -> LanguageModel:
    """SGD on ``texts``; every fifth is kept for the calibration."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0), np.zeros(1, np.int32))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim))
    w, b = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    order = {n: i for i, n in enumerate(names)}
    own = [i for i in range(len(texts)) if i % 5 != 4 or len(texts) < 10]
    kept = [i for i in range(len(texts)) if i % 5 == 4] or own
    steps, step = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            text = texts[i]
            if rng.random() < 0.5:  # short texts are learned too
                n = int(rng.integers(15, 150))
                at = int(rng.integers(0, max(1, len(text) - n)))
                text = text[at : at + n]
            h = np.concatenate(list(_hashes(text, buckets)))
            if not len(h):
                continue
            ids, counts = np.unique(h, return_counts=True)
            share = (counts / len(h))[:, None]
            mean = (emb[ids] * share).sum(axis=0)
            g = _softmax(mean @ w + b)
            g[order[labels[i]]] -= 1
            lr = rate * (1 - step / steps)
            back = w @ g
            w -= lr * np.outer(mean, g)
            b -= lr * g
            emb[ids] -= lr * 20 * share * back
            step += 1
    met = np.zeros(buckets, np.int32)
    for t in texts:
        met[np.unique(np.concatenate(list(_hashes(t, buckets))))] += 1
    model = LanguageModel(names, (emb @ w).astype(np.float32), b, met)

    def cut(some: list[int]) -> list[tuple[str, int]]:
        return [(t[a : a + n], order[labels[i]]) for i in some for t in [texts[i]] for n in (20, 40, 80, len(t)) for a in [int(rng.integers(0, max(1, len(t) - n)))]]

    pieces = cut(kept)
    z = np.array([model.measure(t)[0] for t, _ in pieces])
    y = np.array([k for _, k in pieces])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    model.temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
    s = np.array([_softmax(x / model.temperature) for x in z])
    right = s.max(axis=1)[s.argmax(axis=1) == y]
    if len(right):
        model.threshold = float(np.quantile(right, reject_rate))
    if len(texts) > 1:
        model.most_unmet = float(np.quantile([model.measure(t, 2)[1] for t, _ in cut(list(range(len(texts))))], 1 - reject_rate))
    return model


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 800, excerpt: int = 1500, most_rows: int = 100_000, **options) -> LanguageModel:
    """Train on a bounded sample of the labelled rows of ``docs``."""
    body, name, at = F.col(f"`{text}`"), F.col(f"`{label}`"), F.xxhash64(F.col(f"`{key}`").cast("string"))
    rows = docs.where(name.isNotNull() & body.isNotNull())
    sizes = rows.groupBy(name.alias("label")).count().orderBy("label").collect()  # as many rows as there are languages
    if not sizes:
        return train([], [])
    per_label = max(1, min(per_label, most_rows // len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], min(1.0, per_label / r["count"]))])[name]
    sample = (
        rows.where(F.pmod(at, F.lit(1_000_003)) < share * 1_000_003)
        .select(at.alias("at"), name.alias("label"), F.substr(body, (1 + F.pmod(at, F.greatest(F.lit(1), F.length(body) - excerpt))).cast("int"), F.lit(excerpt)).alias("piece"))
        .orderBy("at", "piece", "label")
        .limit(2 * per_label * len(sizes))
        .collect()
    )
    return train([r["piece"] for r in sample], [r["label"] for r in sample], **options)


def language_column(text: Column | str, model: LanguageModel) -> Column:
    """A struct of ``lang``, ``score`` and ``rejected``."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["lang", "score", "rejected"])

    return judge(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct ``out``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, language_column(F.col(f"`{text}`"), model))


def held_out(key: Column | str = "doc_id") -> Column:
    """Rows that are never learned from: one third, by CRC-32 of the id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
