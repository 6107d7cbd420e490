"""Importance resampling against a brute-force draw, and radix selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexforge.llm import importance as I
from tests.conftest import SMALL
from tests.llm.test_corpus_ops import documents, key, odd_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, target):
    raw, aim = [0] * 10_000, [0] * 10_000
    found = [[zlib.crc32(w.encode()) % 10_000 for w in WORD.findall(low(t))] for _, t in rows]
    for words in found:
        for b in words:
            raw[b] += 1
    for t in target:
        for w in WORD.findall(low(t)):
            aim[zlib.crc32(w.encode()) % 10_000] += 1
    s, t = sum(raw), sum(aim)
    gain = [math.floor(1000 * math.log((y + 1) * (s + 10_000) / ((x + 1) * (t + 10_000)))) for x, y in zip(raw, aim, strict=True)]
    out = []
    for (d, _), words in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in words)
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r) for r in out]


def test_documents(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = [tuple(r) for r in I.importance_resample(spark.read.parquet(f"{SMALL}/documents.parquet"), bench).collect()]
    want = brute(documents(spark), [r.text for r in bench.collect()])
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("times", [1, 12])
def test_odd_rows(spark, times):
    """Nulls, empty texts, repeated rows (of which the draw's end may take some) and clashing names."""
    rows = odd_rows() * times
    target = [None, "", "w1x1 W2X4 changed", "é" * 5]
    df = spark.createDataFrame([(d, t, 1, "x", 7, 8) for d, t in rows], "doc_id long, text string, score int, code string, rank int, at int").repartition(4)
    got = [tuple(r) for r in I.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, target), key=key)


@pytest.mark.parametrize("digit", [3, 13])
def test_radix_selection(spark, monkeypatch, digit):
    monkeypatch.setattr(I, "DIGIT", digit)
    rng = random.Random(digit)
    rows = [(rng.choice([-5, 0, 3, 2**40, -(2**63), 2**63 - 1]), rng.randrange(-(2**63), 2**63), i) for i in range(300)]
    rows += [(3, 7, 300 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    keys = [F.col("a"), F.col("b"), F.col("c")]
    for k in (1, 2, 150, 399, 400):
        bound = I.kth(df, keys, k)
        assert sorted(map(tuple, df.filter(I.up_to(keys, bound)).collect())) == sorted(rows)[:k]


def test_nobody_to_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.importance_resample(none, none).count() == 0
    few = spark.createDataFrame([(i, "a " * 30) for i in range(9)] + [(9, "short")], "doc_id long, text string")
    assert [r.rank for r in I.importance_resample(few, none).collect()] == [None] * 10
