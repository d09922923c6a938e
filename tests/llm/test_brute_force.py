"""Results of whole queries against plain versions of what they compute."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyweave.llm import embeddings, language, media, queries

from .test_near_copies import smallest_reachable


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_op1_predictions(spark, sf):
    docs = documents(spark, sf)
    profiles = language.fit(docs.where(~language.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in queries.op1_rank_order_language(spark, sf).collect()}
    place = {name: {g: k for k, g in enumerate(p[: profiles.size])} for name, p in profiles.profiles.items()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        counts = Counter()
        for w, n in language.word_counts(r.text).items():
            for g in language.grams(w, profiles.length):
                counts[g] += n
        values = sorted(counts.values(), reverse=True)
        least = values[profiles.size - 1] if len(values) > profiles.size else 0
        used = {g: n for g, n in counts.items() if n >= least}
        better = {n: sum(v > n for v in used.values()) for n in set(used.values())}
        far = {name: sum(abs(p[g] - min(better[n], profiles.size)) if g in p else profiles.size for g, n in used.items()) for name, p in place.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 - far[best] / (profiles.size * len(used)))
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op3_shards(spark, sf):
    def shard(key, shards):
        first = xxhash.xxh64_intdigest(str(key).encode(), 42)
        u = [((xxhash.xxh64_intdigest(struct.pack("<i", i), first) >> 12) + 0.5) / 2**52 for i in range(shards)]
        return max(range(shards), key=lambda i: -1.0 / np.log(u[i]))

    rows = queries.op3_rendezvous_sharding(spark, sf).collect()
    assert all((r.shard, r.grown_shard) == (shard(r.doc_id, 24), shard(r.doc_id, 25)) for r in rows)
    for k in range(24):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_op6_targets(spark, sf):
    docs = documents(spark, sf).collect()
    own = Counter()
    for r in docs:
        own[r.source] += len((r.text or "").encode().split())
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(own.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * own[s]]
        for s in over or list(open_):
            target[s] = 3.0 * own[s] if over else share[s]
            open_.discard(s)
            rest -= target[s]
    got = queries.op6_pivotal_mixing(spark, sf).collect()
    assert len(got) == len(docs) and all(r.source_size == own[r.source] and r.target == pytest.approx(target[r.source]) for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        ratio = target[r.source] / own[r.source]
        assert r.size == 0 or r.taken // r.size in (int(ratio), int(ratio) + 1)
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s) for s in names)


def plain_png(data):
    """Samples by the letter of the format, byte by byte."""
    at, stream = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data, at + 8)
        if kind == b"IDAT":
            stream += data[at + 8 : at + 8 + n]
        at += 12 + n
    raw, line, out = zlib.decompress(stream), width * 3, []
    for y in range(height):
        kind, row = raw[y * (line + 1)], bytearray(raw[y * (line + 1) + 1 : (y + 1) * (line + 1)])
        for x in range(line):
            row[x] = (row[x] + (0, row[x - 3] if x >= 3 else 0, out[-1][x] if out else 0)[kind]) % 256
        out.append(row)
    return b"".join(out), {raw[y * (line + 1)] for y in range(height)}


def plain_hash(samples):
    grey = samples.astype(float).sum(axis=2)
    side = [np.array_split(np.arange(n), 32) if n >= 32 else [[int(k * n / 32)] for k in range(32)] for n in grey.shape]
    cut = lambda n: [np.arange(k * n // 32, (k + 1) * n // 32) if n >= 32 else np.array([k * n // 32]) for k in range(32)]
    side = [cut(n) for n in grey.shape]
    small = np.array([[grey[np.ix_(a, b)].mean() for b in side[1]] for a in side[0]])
    wave = lambda k, x: np.cos(np.pi * k * (2 * x + 1) / 64)
    low = [sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    return low


def test_op7_files_and_features(spark, sf):
    import hashlib

    texts = {r.doc_id: (r.text or "").encode() for r in documents(spark, sf).collect()}
    made = media.with_media(documents(spark, sf).select("doc_id", "text"), "text").collect()
    got = {r.doc_id: r for r in queries.op7_png_media(spark, sf).collect()}
    kinds = set()
    for k, r in enumerate(made):
        data = texts[r.doc_id]
        want = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        back, used = plain_png(bytes(r.media)) if k < 60 else (want, set())
        kinds |= used
        q = got[r.doc_id]
        assert back == want == bytes(r.payload) and q.payload_sha256 == hashlib.sha256(want).hexdigest() and q.tail_crc32 == zlib.crc32(want[-16:])
        assert (q.media_sha256, q.media_bytes, q.n_bytes, q.payload_bytes) == (hashlib.sha256(bytes(r.media)).hexdigest(), len(r.media), len(data), len(want))
        if k < 4:
            low = np.array(plain_hash(np.frombuffer(want, np.uint8).reshape(-1, 64, 3)))
            bits, middle = np.unpackbits(np.frombuffer(bytes.fromhex(q.feature), np.uint8)).astype(bool), np.median(low[1:])
            clear = np.abs(low - middle) > 1e-6 * np.abs(low).max()
            assert (bits == (low > middle))[clear].all()
    assert len(kinds) > 1  # rows are filtered


def test_op9_all_columns(spark, sf):
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(pdf.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = pdf.vec_id.tolist()
    root = smallest_reachable(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j])
    got = queries.op9_kmeans_embeddings(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((v, int(near[k].sum()), root[v], root[v] == v) for k, v in enumerate(ids))


def test_op9_widths_and_string_keys(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 1.0, 1.0]), ("e", [2.0, 2.0, 2.0]), ("f", None), ("e", [0.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted(((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in embeddings.near_duplicates(df, "vec_id", "embedding").collect()))
    # e comes with a vector of each width, which joins c to d
    assert got == [("", 0, "", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), ("d", 1, "c", False), ("e", 1, "c", False), ("e", 1, "c", False), ("f", 0, "f", True)]
