import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import chat, language, licences, media, mixing, queries, sentencepieces, sharding

from ..conftest import rows_of

MODEL = queries.MODEL


def test_language_held_out_accuracy(spark, sf):
    got = queries.op1_rank_order_language(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]
    assert got.held_out.tolist() == held and got.score.between(0, 1).all()
    right = got.lang_pred.to_numpy() == docs.loc[got.doc_id].lang.to_numpy()
    assert right[np.array(held)].mean() > 0.95


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog of the house", "en") for i in range(20)] + [(100 + i, "el gato y el perro de la casa", "es") for i in range(20)]
    odd = [(500, None, "en"), (501, "", None), (502, "123 ... 456", "es"), (503, "the dog " * 200_000, None), (None, "la casa", None), (504, "漢字かな", None), (505, "x" * 3_000_000, None)]
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, *odd]], "doc_id long, text string, lang string, score string").withColumnRenamed("score", "other")
    profiles = language.fit(df, "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df.select("doc_id", "text", "other"), "text", profiles).collect()}
    assert [got[k][0] for k in (500, 501, 502)] == ["und"] * 3 and got[503][0] == "en" and got[None][0] == "es" and got[504][0] in ("en", "es")
    none = language.fit(df.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(df.select("text"), "text", none).collect()} == {"und"}
    assert language.identify(df.limit(0).select("text"), "text", profiles).count() == 0


def test_language_counts_words_in_pieces(monkeypatch):
    text = "der Hund, die Katze und das Haus " * 20
    whole = language.word_counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert language.word_counts(text) == whole


def test_sharding(spark):
    df = spark.createDataFrame([(i, "x") for i in [*range(4000), 7, 7, None]], "doc_id long, slot string").withColumnRenamed("slot", "other")
    out = sharding.assign(sharding.assign(df, "doc_id", [1.0] * 24), "doc_id", [1.0] * 25, "grown")
    pdf = sharding.with_slots(out, "doc_id", [], 24).toPandas()
    assert len(pdf) == 4003 and (pdf.grown[pdf.grown != pdf.shard] == 24).all() and pdf.shard[pdf.doc_id == 7].nunique() == 1
    for _, g in pdf.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert pdf.shard.value_counts().between(110, 230).all() and 80 < (pdf.grown == 24).sum() < 250
    heavy = sharding.assign(df, "doc_id", [1.0, 3.0, 0.0]).toPandas().shard.value_counts()
    assert set(heavy.index) == {0, 1} and 2.5 < heavy[1] / heavy[0] < 3.6
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", [0.0])


def test_op3_sizes_and_checksums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    got = queries.op3_rendezvous_sharding(spark, sf).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        data = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and r.grown_shard in (r.shard, 24)


def filled(sizes, weights, ratio):
    """Targets by resharing the excess again and again."""
    total, capped, target = sum(sizes), set(), {}
    while True:
        left = total - sum(ratio * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        target = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if target[i] > ratio * sizes[i] + 1e-9]
        if not over:
            return [float(ratio * sizes[i]) if i in capped else target[i] for i in range(len(sizes))]
        capped |= set(over)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3])}", rng.randrange(1, 60)) for i in range(3000)]
    rows += [(5000, "tiny", 3), (5001, None, 40), (5002, None, 7), (5003, "s0", 0), (6000, "s1", 9), (6000, "s1", 9), (6000, "s1", 9), (None, "s2", 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, words long, target string").withColumnRenamed("target", "other")
    pdf = mixing.mix(df, "doc_id", "source", F.col("words")).toPandas()
    again = mixing.mix(df.repartition(7), "doc_id", "source", F.col("words")).toPandas()
    key = lambda d: sorted(map(repr, zip(d.id, d.source, d["size"], d.copies)))
    assert key(pdf) == key(again) and len(pdf) == len(rows) and pdf.copies.between(0, 3).all()
    names = sorted({r[1] for r in rows if r[1]}, key=str.encode) + [None]
    sizes = [sum(r[2] for r in rows if r[1] == n) for n in names]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for n, size, goal in zip(names, sizes, want):
        g = pdf[pdf.source.isna()] if n is None else pdf[pdf.source == n]
        assert g.target.iloc[0] == pytest.approx(goal) and (g.source_size == size).all()
        assert abs((g.copies * g["size"]).sum() - goal) <= g["size"].max()
    assert mixing.mix(df.limit(0), "doc_id", "source", F.col("words")).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, words long")
    assert [r.copies for r in mixing.mix(nothing, "doc_id", "source", F.col("words")).collect()] == [0]


def test_pivotal_keeps_expected_values(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b", 10 + i % 7) for i in range(80)], "doc_id long, source string, words long")
    runs = [mixing.mix(df, "doc_id", "source", F.col("words"), (3, 1), seed=s).toPandas().set_index("id").copies.sort_index() for s in range(25)]
    mean = sum(runs) / len(runs)
    assert mean[:40].mean() == pytest.approx(1.5, abs=0.05) and mean[40:].mean() == pytest.approx(0.5, abs=0.05)
    assert mean[:40].std() < 0.2 and mean[40:].std() < 0.2 and len({tuple(r) for r in runs}) == 25


def test_op6(spark, sf):
    pdf = queries.op6_pivotal_mixing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(pdf.doc_id) == sorted(docs.doc_id) and (pdf.taken <= 3 * pdf["size"]).all()
    assert pdf.set_index("doc_id")["size"].to_dict() == {d: len(t.encode().split()) for d, t in zip(docs.doc_id, docs.text)}
    for _, g in pdf.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1


def test_op5_equals_its_sql(spark, sf, duck):
    assert rows_of(queries.op5_chat_formatting(spark, sf).toPandas()) == rows_of(duck.execute(queries.OP5_SQL).df())


def test_chat_escapes(spark):
    texts = ["", "\\", "<", "\\l", "\\b\\", "</turn>\n", "<turn + user>", "\\### Assistant: </turn> ok", "a\nb", None, "\\\\<<>>\\g"]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "<x>", None] * 3, texts))], "conv_id long, turn long, role string, text string")
    out = chat.format_rows(df, chat.select_mapping(df.schema))
    turns = out.select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [(r or "", t or "") for r, t in zip(["user", "assistant", "<x>", None] * 3, texts)]
    text = out.first().formatted
    spans = sorted((r.start, r.length) for r in chat.loss_spans(out).collect())
    assert [text[a : a + n] for a, n in spans] == [t for t in text.split("</turn>\n") if t.startswith("<turn + ")] or [text[a : a + n] for a, n in spans] == [t.split(">", 1)[1] for t in text.split("</turn>\n") if t.startswith("<turn + ")]
    assert chat.format_rows(df.limit(0), chat.select_mapping(df.schema)).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"instruction": "hi", "output": "yo"},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"question": "hi", "answer": "yo"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([*records, {"other": 1}])] + [(99, "no json"), (100, None)], "id long, record string")
    got = {r.id: r.formatted for r in chat.format_json(df, "record").collect()}
    want = "<turn - user>hi</turn>\n<turn + assistant>yo</turn>\n"
    assert [got[i] for i in range(len(records))] == [want] * len(records) and got[len(records)] is None and got[99] is None and got[100] is None
    one = spark.createDataFrame([("hi", "yo", 3)], "prompt string, response string, n int")
    assert chat.format_records(one).first().formatted == want
    with pytest.raises(ValueError):
        chat.format_records(spark.createDataFrame([(1,)], "n int"))


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows, kinds, bpp):
    """The five row filters, byte by byte."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds):
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind, *line])
        above = row
    return out


def test_png():
    rng = np.random.default_rng(1)
    for colour, bpp in media.CHANNELS.items():
        pixels = rng.integers(0, 256, (12, 5, bpp), dtype=np.uint8)
        raw = filtered([r.tobytes() for r in pixels], [0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 0], bpp)
        data = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 12, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", zlib.compress(raw)[:9]) + chunk(b"IDAT", zlib.compress(raw)[9:]) + chunk(b"IEND", b"")
        assert (media.decode_png(data) == pixels).all()
    for payload in (b" " * 192, bytes(range(192)) * 40, media.pad(b"x" * 100_001)):
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload and media.encode_png(payload) == media.encode_png(payload)
    good = media.encode_png(b"a" * 192)
    for bad in (b"", good[:-5], good[:30] + b"\x00" + good[31:], good[1:], media.SIGNATURE + chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    with pytest.raises(ValueError):
        media.encode_png(b"a")


def test_cosine_hashes_of_like_images():
    rng = np.random.default_rng(2)
    a = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))[:, :, None].repeat(3, axis=2).astype(np.uint8)
    noisy = np.clip(a + rng.normal(scale=4, size=a.shape), 0, 255).astype(np.uint8)
    other = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))[:, :, None].repeat(3, axis=2).astype(np.uint8)
    differ = lambda x, y: sum(bin(p ^ q).count("1") for p, q in zip(media.cosine_hash(x), media.cosine_hash(y)))
    assert differ(a, noisy) <= 4 < differ(a, other) and len(media.cosine_hash(a[:1])) == 8


def test_op7(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    for r in queries.op7_png_media(spark, sf).toPandas().itertuples():
        data = docs.text[r.doc_id].encode()
        load = media.pad(data)
        file = media.encode_png(load)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted(len(r.payload) for r in media.with_media(odd, "text").collect()) == [192] * 3
    assert media.with_media(odd.limit(0), "text").count() == 0


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    own, lib = sentencepieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = ["", " ", "a", "  a  b ", "<s> <unk> <0x0A>", "▁x", "\x00\n\t", "漢字 😀 é́", "x" * 5000, "      " * 9]
    texts += ["".join(rng.choice(" abcdeinort▁\n<é梦😀th") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += spark.read.parquet(f"{sf}/documents.parquet").toPandas().text.head(60).tolist()
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t) and own.decode(ids) == lib.decode(lib.encode(t))
        assert own.decode(ids) == t.replace("▁", " ")


def test_unigram_paths_are_shortest():
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -2.0, 1), ("b", -3.0, 1), ("ab", -4.5, 1), ("▁a", -3.0, 1), ("ba", -4.0, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    model += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, b"")
    m = sentencepieces.Transducer(model)
    scores = {p: s for p, s, _ in pieces}

    def best(text):
        if not text:
            return 0.0
        return min([-scores[text[:n]] + best(text[n:]) for n in (1, 2) if text[:n] in scores and text[:n] != "<unk>"])

    for t in ("abab", "baba", "a", "bbaabb"):
        ids = m.encode(t)
        assert -sum(m.scores[i] for i in ids) == pytest.approx(best("▁" + t)) and m.decode(ids) == t
    assert m.encode("zz").tolist() == [1, 0]
    with pytest.raises(ValueError):
        sentencepieces.Transducer(b"\xff\xff\xff")


def test_op8_round_trip(spark, sf):
    assert queries.op8_transducer_pieces(spark, sf).where("NOT round_trip OR n_ids != size(ids)").count() == 0
    odd = spark.createDataFrame([(1, None, 2), (None, "", 3)], "doc_id long, text string, ids2 int")
    m = sentencepieces.load(MODEL)
    assert [r.text for r in sentencepieces.decode(sentencepieces.encode(odd, "text", m), "ids", m).collect()] == ["", ""]
    assert sentencepieces.encode(odd.limit(0), "text", m).count() == 0


def test_licences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = licences.fit(docs, "doc_id", "text")
    found = lambda t: [(f["family"], f["confirmed"]) for f in model.scan(t)[1]]
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            assert (family, True) in found(t), t
            assert (family, True) in found("some words before " + t + " and after it\nanother line"), t
    for t in licences.NO_NOTICES:
        assert not any(sure for _, sure in found(t))
    assert found("this file is licensed under the Apache license of our tribe, version two") in ([("Apache", False)], [])
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    got = queries.op4_licence_classifier(spark, sf).toPandas().set_index("doc_id").families
    for d, t in docs.select("doc_id", "text").collect():
        assert got[d] == ",".join(sorted({f for line, f in lines.items() if line in t}))
    assert model.scan("")[0] == 0 and model.scan("\n\n")[0] == 0
    long = " ".join(["word"] * 5000) + " Released under the MIT License. " + " ".join(["word"] * 5000)
    assert ("MIT", True) in found(long)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y")], "doc_id long, text string, family string")
    assert [r.n_paragraphs for r in licences.scan(odd, "text", model).collect()] == [0, 0]
