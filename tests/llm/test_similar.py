import itertools
import random

import corpus_pipeline
from skyweave.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def groups(texts):
    """Smallest key that pairs of 5-word Jaccard >= 0.8 lead to, by comparing all pairs of sets of words."""

    def cut(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, least = {k: cut(t.lower()) for k, t in texts.items()}, {k: k for k in texts}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def lightly_edited():
    rng, texts = random.Random(4), {}
    for k in range(0, 60, 3):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts[k] = " ".join(words)
        for copy in (1, 2):
            other = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 30)):
                other[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
            texts[k + copy] = " ".join(other)
    common = [f"c{i}" for i in range(50)]
    for k in range(100, 130):
        texts[k] = " ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))])
    return texts


def test_near_copies_stage_equals_pairwise_jaccard(spark, sf):
    texts = lightly_edited()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], SCHEMA)
    want = groups(texts)
    found = {r.doc_id: r.component for r in similar.near_copies(docs, "doc_id", "text").collect()}
    assert found == want
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()} == set(want.values())
    # what 2 bits of 3-word shingles leave
    assert simhash.keep_one(docs, "doc_id", "text").count() > len(set(want.values())) + 10


def test_near_copies_of_the_test_table_equal_pairwise_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component for r in similar.near_copies(docs, "doc_id", "text").collect()} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "a b"), (5, "A b"), (6, "p q"), (6, "a b")], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component) for r in similar.near_copies(docs, "doc_id", "text").collect())
    assert found == [(-1, None), (1, 1), (2, 1), (4, 4), (5, 4), (6, 4), (6, 4)]
    assert similar.near_copies(docs.limit(0), "doc_id", "text").count() == 0
