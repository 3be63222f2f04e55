"""The registered queries over whole tables, against brute force that shares no code with the operators."""

import collections
import hashlib
import html.parser
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from tensorloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf):
    return sorted((r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def rows_of(spark, sf, name, key="doc_id"):
    rows = QUERIES[name](spark, sf).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op2(spark, sf, documents):
    counts = collections.Counter()
    words = {k: t.lower().split() for k, t, _ in documents}
    for w in words.values():
        for n in (1, 2, 3):
            counts.update(zip(*[w[i:] for i in range(n)], strict=False))
    total = sum(map(len, words.values()))
    got = rows_of(spark, sf, "op2_backoff")
    assert got.keys() == words.keys()
    for k, w in words.items():
        score = unseen = 0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                gram = tuple(w[i + 1 - n : i + 1])
                if n == 1 or counts[gram] >= 2:
                    score += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + (min(3, i + 1) - n) * math.log(0.4)
                    unseen += n == 1
                    break
        assert (got[k].n_words, got[k].n_unseen) == (len(w), unseen) and got[k].log_score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_op3(spark, sf, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    gold = tiktoken.Encoding("gold", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(spark, sf, "op3_bpe")
    for k, t, _ in documents:
        ids = gold.encode_ordinary(t)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op4(spark, sf, documents):
    """Digests and lengths exactly; the choice of each window by looking at every one of its hashes."""
    from tensorloom.llm import winnow

    got = rows_of(spark, sf, "op4_winnowing")
    order = documents[::-1]

    def spelled(text):
        if not text:
            return "", set()
        points = np.array([ord(c) for c in text], np.uint32)
        gram = min(winnow.GRAM, len(text))
        h = winnow.rolling(points, gram).tolist()
        window = min(winnow.WINDOW, len(h))
        picks = sorted({max(range(s, s + window), key=lambda i: (-h[i], i)) for s in range(len(h) - window + 1)})
        return ",".join(f"{i}:{h[i] & 0xFFFFFFFF:08x}" for i in picks), {h[i] & 0xFFFFFFFF for i in picks}

    rng = random.Random(1)
    some = set(rng.sample(range(len(order)), 60))  # the digests of all, the windows of these
    for at, (k, text, _) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if at in some:
            (own, a), (other, b), (_, c) = spelled(text), spelled(edited), spelled(after)
            assert (r.fingerprint, r.edited_fingerprint) == (own, other)
            assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0) and r.near_next == (len(a & c) / len(a | c) if a | c else 1.0)
    by_text = collections.defaultdict(set)
    for k, text, _ in documents:
        by_text[text].add(got[k].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


class Article(html.parser.HTMLParser):
    """All text of the article: what these pages keep."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "a", "i", "em", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "a", "i", "em", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op5(spark, sf, size):
    """Pages that the field never saw: their markup says which text is the article's."""
    sf = sf.replace("sf0.001", size)
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows_of(spark, sf, "op5_main_text", "page_id")
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        reader = Article()
        reader.feed(page.html or "")
        reader.close()
        assert got[k].text == " ".join("".join(reader.parts).split())
        assert got[k].n_chars == len(got[k].text) and got[k].url == page.url


def test_op6(spark, sf, documents):
    from test_pairs import brute_classes

    got = rows_of(spark, sf, "op6_near_duplicates")
    assert {k: r.class_id for k, r in got.items()} == brute_classes([(k, t) for k, t, _ in documents])


def test_op7(spark, sf):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows_of(spark, sf, "op7_urls", "page_id")
    for k, url in pages.items():
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(d + p), d + p, say) for say, d, p in rules if ("." + host).endswith("." + d) and path.startswith(p)]
        assert (got[k].host, got[k].path) == (host, path)
        if fits:
            assert (got[k].rule, got[k].verdict) == max(fits)[1:]
        else:
            assert got[k].rule is None and got[k].verdict in ("allow", "block")


def test_op10(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    table = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(spark, sf, "op10_language")
    held = right = 0
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not regex.search(r"\p{L}", table[k].text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and table[k].lang is not None:
            held += 1
            right += r.lang_pred == table[k].lang
    assert held > 200 and right >= 0.98 * held
