"""Greedy ingest of figures against taking them one by one."""

import random

import pytest

from lexforge.operators import figures as Fig

SCHEMA = "id long, paper_id string, image_hash string, phash string, complexity_score double, filesize_bytes long, width_height_ratio double"


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def one_by_one(figures, known, cap):
    held = [(p, h, x) for p, h, x in known]
    out, paper, mine = {}, None, []

    def close():
        best = sorted(mine, key=lambda m: (-m[4], m[0]))
        for m in best[cap:]:
            out[m[0]] = "capped"
            held.remove((m[1], m[2], m[3]))
        mine.clear()

    for i, p, h, x, c, size, ratio in sorted(figures, key=lambda r: (r[1], r[0])):
        if p != paper:
            close()
            paper = p
        if ratio is not None and (ratio > 5 or ratio < 0.2):
            out[i] = "logo"
        elif c is None or c < 0.2:
            out[i] = "simple"
        elif size is None or size < 5000:
            out[i] = "small"
        elif h is not None and any(h == k for _, k, _ in held):
            out[i] = "copy"
        elif x and any(q == p and y and bits(x, y) < 8 for q, _, y in held):
            out[i] = "near copy"
        else:
            out[i] = "kept"
            held.append((p, h, x or ""))
            mine.append((i, p, h, x or "", c))
    close()
    return out


def ingest(spark, figures, known, cap=3):
    got = Fig.ingest(spark.createDataFrame(figures, SCHEMA).repartition(3), spark.createDataFrame(known, "paper_id string, image_hash string, phash string"), per_paper=cap)
    return {r.id: r.outcome for r in got.collect()}


def row(i, paper, h, x, c=0.5, size=9000, ratio=1.0):
    return (i, paper, h, x, c, size, ratio)


def test_chain(spark):
    """b is near to a and goes; c is near to b only and stays."""
    a, b, c = "0" * 16, "0" * 15 + "f", "0" * 14 + "ff"
    assert bits(a, b) < 8 and bits(b, c) < 8 and bits(a, c) == 8
    figures = [row(1, "p", "a", a), row(2, "p", "b", b), row(3, "p", "c", c), row(4, "q", "b", b), row(5, "q", "a", b), row(6, "q", None, ""), row(7, "q", None, None, 0.9), row(8, "r", "b", c, 0.1)]
    assert ingest(spark, figures, []) == {1: "kept", 2: "near copy", 3: "kept", 4: "kept", 5: "copy", 6: "kept", 7: "kept", 8: "simple"}
    # a picture that was capped in one paper is new to the next
    figures = [row(1, "p", "x", "", 0.9), row(2, "p", "y", "", 0.5), row(3, "q", "y", "", 0.5), row(4, "r", "y", "", 0.9)]
    assert ingest(spark, figures, [("z", "w", "")], 1) == {1: "kept", 2: "capped", 3: "kept", 4: "copy"}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    hash_of = lambda: f"{sum(1 << b for b in range(rng.randrange(64))):016x}"
    some = lambda x: None if rng.random() < 0.05 else x
    figures = [row(i, rng.choice("pqrst"), some(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("ab")), some(rng.choice([hash_of(), ""])), some(rng.random()), some(rng.randrange(4500, 9000)), some(rng.choice([1.0, 6.0, 0.5, 2.0]))) for i in range(160)]
    known = [("p", "aa", hash_of()), ("q", "bb", ""), ("t", None, hash_of())]
    assert ingest(spark, figures, known) == one_by_one(figures, known, 3)


def test_empty(spark):
    assert ingest(spark, [], []) == {}
