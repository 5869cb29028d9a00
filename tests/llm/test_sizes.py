"""Packing and mixing: bounds, exact counts, caps."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgweave.llm import mixing as M
from orgweave.llm import packing as P
from orgweave.llm import tokens as T


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 40))
def test_best_fill(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    fill = P.best_fill(counts, sorted(counts, reverse=True), room)
    assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= room)
    assert all(k <= counts[n] for n, k in fill.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plan(counts):
    used = Counter()
    for fill, times in P.plan_windows(dict(counts), 50):
        assert times > 0 and sum(n * k for n, k in fill.items()) <= 50
        for n, k in fill.items():
            used[n] += k * times
    assert used == Counter(counts)


def test_pack(spark):
    r = random.Random(5)
    sizes = [r.randint(1, 90) for _ in range(400)] + [250, 100, 200, 0]
    items = [(i, s) for i, s in enumerate(sizes)] + [(1000, None)]
    df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").withColumn("container", F.lit("clash"))
    packs = spark.createDataFrame([("a", 100), ("b", 64)], "pack_name string, capacity_tokens int")
    rows = P.pack(df, packs, "doc_id", "tokens").collect()
    for name, cap in (("a", 100), ("b", 64)):
        fill, total, pieces = Counter(), Counter(), Counter()
        for x in rows:
            if x.pack_name == name:
                fill[x.container] += x.tokens
                total[x.doc_id] += x.tokens
                pieces[x.doc_id] += 1
        assert max(fill.values()) <= cap and total == Counter({i: s for i, s in items if s})
        assert all(pieces[i] == -(-s // cap) for i, s in items if s)
        assert len(fill) <= sum(sizes) / cap * 1.02 + 1
    assert P.pack(df.limit(0), packs, "doc_id", "tokens").count() == 0


def test_pivot():
    for seed in range(30):
        r = random.Random(seed)
        docs = [[i, r.randint(1, 60), r.random()] for i in range(r.randint(0, 50))]
        mass = sum(d[1] * d[2] for d in docs)
        left = M.pivot(docs, r)
        assert len(left) <= 1 and sum(d[2] not in (0.0, 1.0) for d in docs) == len(left)
        assert sum(d[1] * d[2] for d in docs) == pytest.approx(mass, abs=1e-6)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    monkeypatch.setattr(M, "FAN", 2)
    r = random.Random(2)
    docs = [(i, "big", r.randint(5, 50)) for i in range(900)] + [(2000 + i, "small", r.randint(5, 50)) for i in range(60)] + [(9000, None, 5), (9001, "big", None), (9002, "other", 7)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("p", "big", 0.8, 1), ("p", "small", 0.15, 4), ("p", "none", 0.05, 2)], "plan_name string, source string, target_share double, max_repeats int")
    mixed = M.mix(df, targets, "doc_id", "source", "tokens").cache()
    rows = {x.doc_id: x for x in mixed.collect()}
    assert len(rows) == 960 and max(x.copies for x in rows.values() if x.source == "big") <= 1
    assert max(x.copies for x in rows.values() if x.source == "small") <= 4
    sh = {x.source: x.share for x in M.shares(mixed, targets).collect()}
    assert sh["none"] == 0 and sh["big"] / sh["small"] == pytest.approx(0.8 / 0.15, rel=0.02)
    assert M.mix(df.limit(0), targets, "doc_id", "source", "tokens").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "word " * 5000)], "id bigint, text string")
    got = {r.id: r.tokens for r in T.with_tokens(df).collect()}
    enc = T.encoder()
    assert got == {1: 2, 2: 0, 3: None, 4: len(enc.encode_ordinary("word " * 5000))}
    assert enc.decode(enc.encode_ordinary("Grüße, 世界!")) == "Grüße, 世界!"
