from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from skyweave.llm import language

from .test_near_copies import brute
from .test_similar import groups


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        f(spark, docs, sf).write.mode("overwrite").parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["language", "near copies", "repeats", "mix", "tokens"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and [t for _, t in after.dtypes] == [t for _, t in before.dtypes]


def words_of(r):
    return len((r.text or "").encode().split())


def test_each_stage_against_brute_force(spark, stages):
    (_, docs, spoken), (_, _, single), (_, _, cut), (_, _, mixed), (_, _, ids) = stages
    profiles = language.fit(docs, "doc_id", "text", "lang")
    bounds = corpus_pipeline.LEAST_SCORES

    def stays(r):
        name, score, n = profiles.measure(r.text)
        return name != "und" and score >= np.interp(n, [x for x, _ in bounds], [y for _, y in bounds])

    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect() if stays(r)}
    # near copies: all pairs of sets of five words
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups({r.doc_id: r.text for r in spoken.collect()}).values()))
    # repeats: all strings of 200 bytes
    rows = single.collect()
    left = {}
    for r, gone in zip(rows, brute([r.text for r in rows], 200)):
        left[r.doc_id] = bytes(b for k, b in enumerate((r.text or "").encode()) if k not in gone).decode(errors="ignore")
    assert {r.doc_id: r.text for r in cut.collect()} == left and all(r.n_chars == len(r.text) for r in cut.collect())
    # the mix: shares by weight, of three times a source's size at most; each row that share, rounded down or up
    rows, copies = cut.collect(), Counter(r.doc_id for r in mixed.collect())
    size = Counter()
    for r in rows:
        size[r.source] += words_of(r)
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(size.values()))
    while open_:
        share = {x: rest * weight[x] / sum(weight[y] for y in open_) for x in open_}
        over = [x for x in open_ if share[x] > 3 * size[x]]
        for x in over or list(open_):
            target[x] = 3.0 * size[x] if over else share[x]
            open_.discard(x)
            rest -= target[x]
    taken = Counter()
    for r in rows:
        taken[r.source] += words_of(r) * copies[r.doc_id]
        ratio = target[r.source] / size[r.source]
        assert not words_of(r) or copies[r.doc_id] in (int(ratio), int(ratio) + 1), (r.doc_id, ratio)
    assert all(abs(taken[x] - target[x]) <= max(words_of(r) for r in rows if r.source == x) for x in names)
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= set(left.items())
    # tokens: the library's ids
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    rows = ids.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in mixed.collect())
    assert all(library.encode(r.text) == r.ids and r.n_ids == len(r.ids) for r in rows)


def test_run(spark, sf, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_ids) for r in got.collect()) == sorted((r.doc_id, r.n_ids) for r in stages[-1][2].collect())


def test_odd_tables(spark, sf):
    same, near = "the cat and the house", " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "the cat and the dog", "en", "a", 19), (3, same, "en", "b", 21), (3, same, "en", "b", 21), (7, same.upper(), "en", "b", 21), (4, "12 34", None, None, 5), (5, near, "en", "a", 0), (6, near + " end", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS `size`", "'y' AS ids", "'z' AS component")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert ids(stage["language"](spark, docs, sf)) == [0, 3, 3, 5, 6, 7]  # those with letters
    assert ids(stage["near copies"](spark, docs, sf)) == [0, 1, 3, 4, 5]  # a null key stays, empty and null texts are equal
    cut = {r.doc_id: r for r in stage["repeats"](spark, docs, sf).collect()}
    assert len(cut) == 8 and cut[1].text == cut[2].text == "" and cut[6].text == " end" and cut[5].text == "" and cut[6].n_chars == 4
    assert set(ids(stage["mix"](spark, docs, sf))) <= {0, 1, 2, 3, 4, 5, 6, 7}
    tokens = {r.doc_id: r for r in stage["tokens"](spark, docs, sf).collect()}
    assert tokens[1].ids == [] and tokens[6].text == near + " end"
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), sf)
        assert empty.count() == 0 and (name == "tokens" or empty.columns == docs.columns)
