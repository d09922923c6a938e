import random

from skyweave.llm import similar

from .test_similar import groups, lightly_edited


def copies():
    rng, texts = random.Random(8), dict(lightly_edited())
    words = [f"h{i}" for i in range(300)]
    for k in range(1000, 1150):
        other = list(words)
        for _ in range(rng.randrange(1, 12)):
            other[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts[k] = " ".join(other)
    return texts


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component for r in similar.near_copies(docs, "doc_id", "text").collect()}


def test_hot_nodes_and_blocks_of_crowds_change_nothing(spark, monkeypatch):
    texts = copies()
    want = groups(texts)
    assert found(spark, texts) == want
    monkeypatch.setattr(similar, "HOT", 20)  # nodes are peeled on the driver's plan
    assert found(spark, texts) == want


def test_peeled_rows_are_led_or_left(spark):
    rows = [(1, k, 0, 0) for k in range(10)] + [(1, 100 + k, -1, -1) for k in range(3)] + [(2, 7, 5, 5)]
    placed = spark.createDataFrame(rows, "node long, fp long, s0 long, s1 long")
    hot = similar.HOT
    similar.HOT = 4
    try:
        left, stars = similar._peeled(placed, 10)
    finally:
        similar.HOT = hot
    assert sorted((r.x, r.y, r.star) for r in stars.collect()) == [(0, k, True) for k in range(1, 10)]
    assert sorted((r.node, r.fp) for r in left.collect()) == [(1, 100), (1, 101), (1, 102), (2, 7)]


def test_crowds_meet_in_blocks(spark, monkeypatch):
    """Blocks are small here, set in the plan; workers get them by rows."""
    monkeypatch.setattr(similar, "BLOCK", 4)
    code = bytes(8 * (similar.WORDS + similar.SKETCH))
    from pyspark.sql import functions as F

    rows = [(1, 10 if k < 20 else 20 + k % 3, k, bytearray(code)) for k in range(33)]
    parts = spark.createDataFrame(rows, "crowd long, g long, fp long, code binary")
    parts = parts.withColumn("of", F.struct(F.lit(10).cast("long").alias("main"), F.lit(20).cast("long").alias("inside"), F.lit(13).cast("long").alias("outside")))
    part = {k: g for _, g, k, _ in rows}
    every = {(a, b) for a in part for b in part if a < b and part[a] != part[b]}
    assert {(r.x, r.y) for r in similar._reunited(parts, 0.8, True).collect()} == every
    one = {(r.x, r.y) for r in similar._reunited(parts, 0.8, False).collect()}
    assert one == {(0, k) for k in range(20, 33)}
