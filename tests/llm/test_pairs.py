"""Near-duplicates, leaks, and the pipeline, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate, minhash
from tensorloom.llm.components import components
from tensorloom.llm.words import weighted_shingles, word_hashes

SCHEMA = "doc_id long, text string, node string, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA)


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def brute_classes(rows, threshold=0.8):
    sets = {k: weighted_shingles(t or "", 5) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, t) in enumerate(rows):
        for b, u in rows[i + 1 :]:
            same = (t or "") == (u or "")
            if same or len(sets[a][0]) and len(sets[b][0]) and minhash.probability_jaccard(sets[a], sets[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_index_and_estimate():
    rng = np.random.default_rng(0)
    x = (np.arange(1, 201, dtype=np.uint64) * np.uint64(7919), rng.uniform(1, 4, 200))
    y = (np.arange(60, 261, dtype=np.uint64) * np.uint64(7919), rng.uniform(1, 4, 201))
    a, b = dict(zip(*x, strict=True)), dict(zip(*y, strict=True))
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
    assert abs(minhash.probability_jaccard(x, y) - exact) < 1e-9
    from tensorloom.llm.words import mix

    shuffled = lambda s: (np.sort(mix(s[0])), s[1][np.argsort(mix(s[0]))])
    x, y = shuffled(x), shuffled(y)
    agree = np.mean(minhash.prob_minhash(*x, 4096) == minhash.prob_minhash(*y, 4096))
    assert abs(agree - minhash.probability_jaccard(x, y)) < 0.04


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "  "), (5, "a b c d"), (6, "A  b c D")]
    for _ in range(12):  # families: exact copies, near copies, chains of edits
        base = words(rng, 120)
        family = [base, base]
        for _ in range(rng.randint(1, 14)):
            w = list(rng.choice(family))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            family.append(w)
        rows += [(10 + len(rows) + i, " ".join(w)) for i, w in enumerate(family)]
    rows += [(5000, rows[-1][1])]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_classes(rows)


def test_edited_chains_need_rounds(spark):
    """A large bucket with members that do not link to its pivot."""
    rng = random.Random(8)
    base = words(rng, 100)
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((k, " ".join(w)))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_classes(rows)


def test_odd_tables(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    got = minhash.near_duplicates(docs(spark, [(1, "x y z")] * 3 + [(None, "x y z"), (None, "other words")])).collect()
    assert len(got) == 5 and [r.class_id for r in got].count(1) == 4


def test_one_key_of_many_texts(spark):
    """Contents are told apart whatever their keys; near ones are still found."""
    rng = random.Random(15)
    base = [words(rng, 80) for _ in range(12)]
    near = [[*w[:-1], "changed"] for w in base]
    rows = [(7, " ".join(w)) for w in base] + [(None, " ".join(w)) for w in near] + [(7, " ".join(base[0])), (3, " ".join(base[1]))]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and len({r.class_id for r in got}) == 12 and len({r.node for r in got}) == 24
    assert {r.node: bytes(r.content) for r in got} == {r.node: bytes(r.content) for r in reversed(got)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_leaks(spark):
    rng = random.Random(6)
    common = words(rng, 300)
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]
    items = [(i, text(rng.randint(15, 60))) for i in range(30)]
    rows, leaks = [], set()
    for k in range(120):
        body = text(rng.randint(30, 400))
        if k % 3 == 0:
            i, item = rng.choice(items)
            put = list(item)
            if k % 2:  # another wording: a fifth of the words replaced
                for at in rng.sample(range(len(put)), len(put) // 5):
                    put[at] = words(rng, 1)[0]
            at = rng.randrange(len(body))
            body[at:at] = put
            leaks.add((k, i))
        rows.append((k, " ".join(body)))
    rows += [(900, None), (901, ""), (902, "short")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "")], "item_id long, text string")
    for block in (500, 16):
        found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench, block=block).collect()}
        assert found - leaks == set() and len(found) >= 0.97 * len(leaks)
        assert {p for p in leaks if p[0] % 2 == 0} <= found
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_leaks_beside_rare_tokens(spark):
    """Short items among tokens that are much rarer than their own words, as those of a large corpus are."""
    rng = random.Random(12)
    common = words(rng, 300)
    text = lambda n: [rng.choice(common) for _ in range(n)]
    items = [(i, text(rng.randint(6, 24))) for i in range(40)]
    rare = lambda n: ["".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(n)]
    rows, leaks = [(10_000 + k, " ".join(text(60))) for k in range(400)], set()
    for k, (i, item) in enumerate(items * 6):
        n = (0, 2, 4, 8, 16, 40)[k // len(items)]
        rows.append((k, " ".join(text(rng.randint(0, 30)) + rare(n) + item + rare(n) + text(rng.randint(0, 30)))))
        leaks.add((k, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert leaks <= {p for p, share in found.items() if share == 1}


def test_bounds_lose_nothing(spark, sf, monkeypatch):
    """All leaks of a whole table, with the bounds on the products and without."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "the of and"), (5001, "with the of in")], "item_id long, text string"))
    df, size = decontaminate.document_frequencies(table)
    texts = [r.text or "" for r in table.collect()]
    seen = np.zeros(decontaminate.TERMS, np.int64)
    for t in texts:
        seen[np.unique(decontaminate._terms(word_hashes(t)))] += 1
    assert size == len(texts) and (df == seen).all()
    idf = np.log((1 + size) / (1 + df)).astype(np.float32) + np.float32(0.1)
    items = [(k, r.text) for k, r in enumerate(bench.collect())]
    index = decontaminate.Index(items, idf, *decontaminate.randomised_svd(decontaminate._passages(bench.select("text")), idf))
    found = [index.search(word_hashes(t), 0.5, 0.75, 0.5) for t in texts]
    assert sum(map(len, found)) > 0
    monkeypatch.setattr(decontaminate.Index, "_open", lambda self, row, least: np.arange(max(1, -(-len(row) // decontaminate.STRIDE) - 1)))
    assert found == [index.search(word_hashes(t), 0.5, 0.75, 0.5) for t in texts]


def test_op9_finds_every_verbatim_item(spark, sf):
    from tensorloom.llm.queries import QUERIES

    rows = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    verbatim = {(d, i) for d, t in rows.items() for i, x in items.items() if f" {x} " in f" {t} "}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_leaks"](spark, sf).collect()}
    assert verbatim and verbatim <= found


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    held = {r.doc_id: r for r in out.collect()}
    classes = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = {k for k, c in classes.items() if k == c}
    clean = {r.doc_id for r in docs.collect() if r.doc_id in first and not any(b in r.text for b in bench)}
    assert set(held) == clean
    assert all("@mail" not in r.text and r.n_chars == len(r.text) for r in held.values())
    assert out.where(F.octet_length("token_ids") != 4 * F.col("n_tokens")).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name


def test_pipeline_missing_and_repeated_ids(spark, tmp_path):
    """Rows that share a key, or have none, are judged each for itself."""
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join(words(rng, n))
    items = [text(20), text(30)]
    leaking = [f"{text(40)} {item} {text(40)}" for item in items for _ in range(2)]
    clean = [text(100) for _ in range(12)]
    keys = [None, 7] * 6
    rows = list(zip(keys, clean, strict=True)) + list(zip([None, 7, 7, None], leaking, strict=True))
    rows += [(7, clean[0]), (3, clean[1]), (None, clean[2]), (7, clean[3])]  # copies: an id is better than none, 3 than 7
    spark.createDataFrame([(1, items[0]), (None, items[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs(spark, rows), "").na.fill(-1).collect())
    ids = [7, 3, *keys[2:]]
    assert one == sorted((-1 if k is None else k, t) for k, t in [*zip(ids, clean, strict=True), *zip([None, 7, 7, None], leaking, strict=True)])
    left = corpus_pipeline.decontaminated(spark, docs(spark, rows), str(tmp_path)).collect()
    assert sorted(r.text for r in left) == sorted([*clean, *clean[:4]])
