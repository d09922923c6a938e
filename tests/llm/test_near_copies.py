import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyweave.llm import components, embeddings, queries, simhash, suffixes


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def smallest_reachable(names, linked):
    root = dict(zip(names, names))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "Word", "two Words", "a b c", "É é x y", *[" ".join(rng.choice("abcdef") for _ in range(n)) for n in (5, 50, 400)]]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("AB c D") == simhash.fingerprint("ab  C\td")


def test_gray_order_and_linked_pairs():
    rng = np.random.default_rng(3)
    assert (np.argsort(simhash.gray_rank(np.arange(16, dtype=np.uint64) ^ (np.arange(16, dtype=np.uint64) >> np.uint64(1)))) == np.arange(16)).all()
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.array([1 << int(k) for k in rng.integers(0, 64, 600)], np.uint64)
    fp = np.unique(np.concatenate([base, base[rng.integers(0, 40, 300)] ^ flips[:300], base[rng.integers(0, 40, 300)] ^ flips[:300] ^ flips[300:]]))
    node = np.sort(rng.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), node))
    fp, node = fp[order], node[order]
    got = set(zip(*[x.tolist() for x in simhash.linked_pairs(fp, node)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    want = {(i, j) for i, j in zip(*np.nonzero(near & (node[:, None] == node[None, :]))) if i < j}
    assert got == want


@pytest.mark.parametrize("node", [512, 4])
def test_links_join_what_brute_force_joins(spark, node):
    """Small nodes are cut again and again."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (40, 2))]]))
    signed = fp.view(np.int64).tolist()
    reps = spark.createDataFrame(list(zip(range(len(fp)), signed)), "rep long, fp long")
    edges = [(r.a, r.b) for r in simhash.link(reps, 2, node).collect()]
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    assert edges and all(0 <= min(a, b) and a != b for a, b in edges)
    assert smallest_reachable(range(len(fp)), edges) == smallest_reachable(range(len(fp)), zip(*np.nonzero(np.triu(near, 1))))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    names = {x for e in edges for x in e}
    want = {n: r for n, r in smallest_reachable(names, edges).items() if n != r}
    assert {r.node: r.component for r in components.components(df, "a", "b").collect()} == want
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_op2_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op2_gray_simhash(spark, sf).toPandas().set_index("doc_id")
    fp = np.array([slow_fingerprint(t) for t in docs.text], np.uint64)
    assert got.fingerprint.to_dict() == {d: f"{int(f):016x}" for d, f in zip(docs.doc_id, fp)}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2, 1))
    assert got.component_id.to_dict() == smallest_reachable(docs.doc_id.tolist(), zip(docs.doc_id[i], docs.doc_id[j]))


def test_near_copies_of_odd_tables(spark):
    text = "one two three four five six"
    rows = [(3, text, 1), (2, text.upper(), 2), (5, None, 3), (4, "", 4), (9, " ", 5), (None, text, 6), (3, text, 7), (8, "other words than those before", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((r.doc_id or -1, r.component or -1) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    assert got == [(-1, -1), (2, 2), (3, 2), (3, 2), (4, 4), (5, 4), (8, 8), (9, 4)]
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 4, 8]
    twice = spark.createDataFrame([(1, text, 1), (1, text, 2)], df.schema)
    assert simhash.keep_one(twice, "doc_id", "text").count() == 1
    assert simhash.keep_one(df.limit(0), "doc_id", "text").count() == 0


def brute(texts, match):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + match] for t in data for i in range(len(t) - match + 1))
    return [{x for i in range(len(t) - match + 1) if count[t[i : i + match]] > 1 for x in range(i, i + match)} for t in data]


def repeats(spark, texts, match, gram, classes):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    names = {bytes(r.rid): r.i for r in df.select("i", F.xxhash64("i", "t").cast("string").cast("binary").alias("rid")).collect()}
    got = [set() for _ in texts]
    for r in suffixes.repeated_spans(df.select(F.xxhash64("i", "t").cast("string").cast("binary").alias("rid"), F.col("t").alias("text")), match, gram, classes).collect():
        got[names[bytes(r.rid)]] |= set(range(r.begin, r.end))
    return got


@pytest.mark.parametrize("alphabet, classes", [("ab", 512), ("ab", 3), ("abcdefgh \x00é", 512), ("abcdefgh \x00é", 3)])
def test_suffixes_against_brute_force(spark, alphabet, classes):
    rng = random.Random(len(alphabet) + classes)
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base = [some(rng.randrange(5, 80)) for _ in range(10)]
    texts = ["".join(rng.choice([*base, some(rng.randrange(30))]) for _ in range(rng.randrange(5))) for _ in range(80)]
    texts += ["a" * 100, "ab" * 60, "a" * 50 + "b" + "a" * 50, None, ""]
    assert repeats(spark, texts, 24, 8, classes) == brute(texts, 24)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc ") for _ in range(700))
    text += text[100:400]
    hasher = suffixes.Hasher(4000)
    one = {(int(g), int(c)) for data, parts in suffixes._pieces([(1, text)], 60, 20) for g, c in zip(*suffixes.gaps(hasher, data, np.array([0]), np.array([len(data)]), [p[4] for p in parts], 60, 20)[:2])}
    monkeypatch.setattr(suffixes, "SLAB", 128)
    seen, windows = set(), 0
    for data, parts in suffixes._pieces([(1, text)], 60, 20):
        g, c, p, n, q = suffixes.gaps(hasher, data, np.array([0]), np.array([len(data)]), [x[4] for x in parts], 60, 20)
        seen |= set(zip(g.tolist(), c.tolist()))
        windows += int(n.sum())
    assert windows == len(text) - 59 and {g for g, _ in seen} == {g for g, _ in one}


def test_op10_against_brute_force(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op10_induced_suffixes(spark, sf).toPandas().set_index("doc_id")
    for doc_id, text, gone in zip(docs.doc_id, docs.text, brute(docs.text, 200)):
        data = text.encode()
        mask = np.zeros(len(data) + 1, int)
        mask[list(gone)] = 1
        r = got.loc[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), len(gone), int((np.diff(np.r_[0, mask]) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(bytes(b for k, b in enumerate(data) if not mask[k])).hexdigest()


def test_removal_from_odd_tables(spark):
    long = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(300)) + "é"
    df = spark.createDataFrame([(1, long, "a"), (2, "x" + long, "b"), (3, None, "c"), (4, "", None), (5, "short", "e"), (7, "unlike" * 3, "f"), (7, "unlike" * 3, "f")], "doc_id long, text string, n_bytes string").withColumnRenamed("n_bytes", "other")
    got = {(r.doc_id, r.other): (r.n_bytes, r.n_removed, r.kept) for r in suffixes.remove_repeats(df, "doc_id", "text", as_text=True).collect()}
    assert got[1, "a"] == (302, 302, "") and got[2, "b"] == (303, 302, "x") and got[3, "c"] == (0, 0, "") and got[4, None] == (0, 0, "") and got[5, "e"][2] == "short"
    assert suffixes.remove_repeats(df.limit(0), "doc_id", "text").count() == 0


def test_removal_of_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"word{i * i % 977}" for i in range(700))
    other = "start " + text[100:900] + " end"
    rows = [(1, text, 7)] * 40 + [(2, text, 7), (3, other, 8), (4, "x" * 150, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long").selectExpr("*", "1 AS kept", "2 AS rid", "3 AS spans", "4 AS __spans", "5 AS g")
    got = suffixes.remove_repeats(df, "doc_id", "text").collect()
    assert len(got) == 43 and sorted({(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got}) == [(1, len(text), len(text), 1), (2, len(text), len(text), 1), (3, len(other), 800, 1), (4, 150, 0, 0)]
    assert {bytes(r.kept) for r in got if r.doc_id == 3} == {b"start  end"} and {(r.rid, r.spans, r.g) for r in got} == {(2, 3, 5)}


@pytest.mark.parametrize("match", [1, 7, 50, 330])
def test_removal_of_other_lengths(spark, match):
    rng = random.Random(match)
    base = ["".join(rng.choice("abcde") for _ in range(500)) for _ in range(3)]
    texts = [b[: rng.randrange(1, 500)] + "-" + rng.choice(base)[rng.randrange(250) :] for b in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n_removed for r in suffixes.remove_repeats(df, "i", "t", match).collect()}
    assert got == {i: len(x) for i, x in enumerate(brute(texts, match))}
    with pytest.raises(ValueError):
        suffixes.gram_of(0)


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 60, 200)] + rng.normal(scale=0.06, size=(200, 16))
    return [*base.tolist(), *near.tolist(), *[base[0].tolist()] * 30, (base[0] * 3).tolist()]


@pytest.mark.parametrize("cells", [1, 6, 25])
def test_embeddings_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    x = vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    rows = [(i, v, "extra") for i, v in enumerate([*x, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = embeddings.near_duplicates(df, "vec_id", "embedding", 0.95, cells).toPandas().set_index("vec_id").sort_index()
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95 - 1e-15
    np.fill_diagonal(linked, False)
    n = len(x)
    assert got.n_links.tolist() == [*linked.sum(axis=1).tolist(), *[0] * len(odd)]
    root = smallest_reachable(range(n + len(odd)), zip(*np.nonzero(linked)))
    assert got.component_id.to_dict() == root and (got.kept == (got.component_id == got.index)).all()


def test_embeddings_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df, "vec_id", "embedding").count() == 0
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(none, "vec_id", "embedding").collect()] == [(1, 0, 1, True)]


def test_op9_against_brute_force(spark, sf):
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(pdf.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = queries.op9_kmeans_embeddings(spark, sf).toPandas().set_index("vec_id")
    assert got.n_links.to_dict() == dict(zip(pdf.vec_id, (x @ x.T >= 0.95).sum(axis=1) - 1))
