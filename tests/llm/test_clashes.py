"""Clashing names, empty tables, long texts, ties and repeated rows, for operators that add columns to a table."""

import numpy as np
import pytest

from skyweave.llm import chat, language, licences, media, queries, sentencepieces, sharding, simhash, similar, suffixes

TEXT = "the quick cat and the slow dog went to the old house by the sea"
MIT = next(t for t in licences.TEMPLATES["MIT"])
NAMES = "row text2 lang_pred score distinct shard slot part n at before n_paragraphs findings media payload feature ids decoded n_bytes n_removed n_spans kept rid spans fp component key".split()


@pytest.fixture(scope="module")
def table(spark):
    """Two equal rows, a long text, a null and an empty one, and a column of each name that operators use."""
    rows = [(1, TEXT), (1, TEXT), (2, f"{TEXT} {MIT}\n" * 4000), (3, None), (4, ""), (None, "12 34")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'old' AS {n}" for n in NAMES])


@pytest.fixture(scope="module")
def operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(100)
    profiles, model, scanner = language.fit(docs, "doc_id", "text", "lang"), sentencepieces.load(queries.MODEL), licences.fit(docs, "doc_id", "text")
    return {
        "language": (lambda d: language.identify(d, "text", profiles), ["lang_pred", "score"]),
        "language, kept": (lambda d: language.identify(d, "text", profiles, keep=True, distinct="n"), ["text", "lang_pred", "score", "n"]),
        "shards": (lambda d: sharding.assign(d, "doc_id", [1.0, 2.0, 0.0]).drop("text"), ["shard"]),
        "slots": (lambda d: sharding.with_slots(sharding.assign(d, "doc_id", [1.0] * 3), "doc_id", ["n"], 3).drop("text"), ["shard", "slot"]),
        "licences": (lambda d: licences.scan(d, "text", scanner), ["n_paragraphs", "findings"]),
        "media": (lambda d: media.with_media(d, "text"), ["media", "payload", "feature"]),
        "pieces": (lambda d: sentencepieces.encode(d, "text", model, decoded="decoded"), ["ids", "decoded"]),
        "pieces back": (lambda d: sentencepieces.decode(sentencepieces.encode(d, "text", model), "ids", model, "row"), ["ids", "row"]),
        "suffixes": (lambda d: suffixes.remove_repeats(d, "doc_id", "text"), ["n_bytes", "n_removed", "n_spans", "kept"]),
    }


@pytest.mark.parametrize("name", ["language", "language, kept", "shards", "slots", "licences", "media", "pieces", "pieces back", "suffixes"])
def test_added_columns_replace_those_of_their_names(spark, table, operators, name):
    run, added = operators[name]
    out = run(table)
    passed = [c for c in table.columns if c != "text" and c not in added]
    assert sorted(out.columns) == sorted([*passed, *added])
    rows = out.collect()
    assert len(rows) == 6 and all(r[c] == "old" for r in rows for c in passed if c != "doc_id") and not any(r[c] == "old" for r in rows for c in added)
    one = [tuple(r[c] for c in added if c != "slot") for r in rows if r.doc_id == 1]
    assert one[0] == one[1]  # equal rows, equal results
    by = {r.doc_id: r for r in rows}
    if name == "slots":
        assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(3) for k in range(sum(r.shard == s for r in rows))]
    if name == "language":
        assert by[3].lang_pred == by[4].lang_pred == by[None].lang_pred == "und" and by[2].lang_pred != "und"
    if name == "licences":
        assert by[3].n_paragraphs == by[4].n_paragraphs == 0 and by[2].n_paragraphs == 4000 and sum(f.family == "MIT" and f.confirmed for f in by[2].findings) >= 4000
    if name == "media":
        assert bytes(by[3].payload) == bytes(by[4].payload) == b" " * 192 and bytes(by[2].payload).rstrip(b" ") == f"{TEXT} {MIT}\n".encode() * 4000
    if name == "pieces":
        assert by[2].decoded == f"{TEXT} {MIT}\n" * 4000 and by[3].ids == by[4].ids == []
    empty = run(table.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_components_do_not_read_other_columns(table):
    for find in (simhash.near_duplicates, similar.near_copies):
        got = sorted((r.doc_id or 0, r.component or 0) for r in find(table, "doc_id", "text").collect())
        assert got == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 3), (4, 3)] and find(table.limit(0), "doc_id", "text").count() == 0
    kept = simhash.keep_one(table, "doc_id", "text")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == table.columns


def test_loss_spans_of_equal_rows(spark):
    said = "<turn - user>hi</turn>\n<turn + assistant>yo there</turn>\n<turn + assistant>é</turn>\n"
    df = spark.createDataFrame([(1, said, 5), (1, said, 5), (2, None, 6), (3, "", 7)], "id long, formatted string, start long")
    got = [(r.id, said[r.start : r.start + r.length]) for r in chat.loss_spans(df).collect()]
    assert sorted(got) == sorted([(1, "yo there"), (1, "é")] * 2)


def test_layouts_are_told_by_nested_paths(spark):
    records = ['{"messages":"hi","role":"a","content":"b"}', '{"messages":[{"role":"a","content":"b"}]}', '{"prompt":"x","completion":{"text":"y"}}', '{"a":{"b":[{"c":1,"d":{"e":"x"}}],"f":2}}', "no json", None, "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, record string")
    paths = {r.id: r.p for r in df.select("id", chat.json_paths(df.record).alias("p")).collect()}
    assert [paths[i] for i in range(4)] == [["content", "messages", "role"], ["messages[].content", "messages[].role"], ["completion.text", "prompt"], ["a.b[].c", "a.b[].d.e", "a.f"]]
    out = {r.id: r for r in chat.format_json(df, "record").collect()}
    assert out[0].layout != out[1].layout == chat.fingerprint(["messages[].role", "messages[].content"])
    assert [out[i].formatted is None for i in range(7)] == [True, False, True, True, True, True, True]


def test_bad_images():
    good = media.encode_png(bytes(range(192)) * 3)
    assert media.decode_png(good).tobytes() == bytes(range(192)) * 3
    head = good[8:33]
    short = media._chunk(b"IHDR", head[8:20])
    bomb = media._chunk(b"IDAT", __import__("zlib").compress(bytes(1 << 24)))
    for bad in (good[:8] + short + good[33:], good[:8] + good[33:-12] + head + good[-12:], good[:33] + bomb + good[-12:], good[:33] + head + good[33:], good[:-20], b"", good[:40] + b"\0" + good[41:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_each_row_filter():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 192), dtype=np.uint8)
    rows[5:15] = rows[4]
    rows[20:25] = np.tile(rows[20, :3], 64)
    kinds, made = media.filtered(rows)
    assert set(kinds.tolist()) == {0, 1, 2} and (media.unfilter(kinds, made, 3) == rows).all()
