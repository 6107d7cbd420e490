"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from lexforge.llm import simhash as S
from tests.llm.test_corpus_ops import documents, key, odd_rows

MANY = 2**63


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=4):
    """Index of the first row of each row's class."""
    label = list(range(len(prints)))
    x = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= radius) for v in x]
    moved = True
    while moved:
        moved = False
        for i, n in enumerate(near):
            low = min(label[j] for j in n)
            if low < label[i]:
                label[i], moved = low, True
    return label


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_simhash(spark, which):
    rows = odd_rows() if which == "odd" else documents(spark)
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, print long, key string, band string").repartition(4)
    got = S.simhash(df).collect()
    prints = [brute_print(t) for _, t in rows]
    label = brute_classes(prints)
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, MANY), MANY if d is None else d)
    want = [(d, f"{p:016x}", None if least[c] == MANY else least[c]) for (d, _), p, c in zip(rows, prints, label, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def planted(seed, n, balls):
    """Random prints, chains of four bits a step and dense balls within a few bits."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)} | {0, 2**64 - 1}
    for size in balls:
        at = rng.getrandbits(64)
        for _ in range(size):
            out.add(at ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    at = rng.getrandbits(64)
    for _ in range(30):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        out.add(at)
    return sorted(out)


@pytest.mark.parametrize("group,slab", [(8192, 2048), (40, 16), (3, 2)])
def test_links_of_any_group_size(spark, monkeypatch, group, slab):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "SLAB", slab)
    prints = planted(group, 1200, [300, 100, 5])
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    found = [(r.a % 2**64, r.b % 2**64) for r in S.links(df).collect()]
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    label = brute_classes(prints)
    assert {p: prints[c] for p, c in zip(prints, label, strict=True)} == {p: top(p) for p in prints}


def test_bands_cover_all_bits_once():
    masks = S._bands(list(range(64)))
    assert sum(masks) == 2**64 - 1 and len(masks) == 5


def test_empty(spark):
    assert S.simhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0
