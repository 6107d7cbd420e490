"""The filter audit against every order played through document by document."""

import re
from itertools import permutations

import pytest

from lexforge.llm import filter_audit as A
from tests.conftest import SMALL
from tests.llm.test_corpus_ops import odd_rows, sentence

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, labels):
    """rows of (doc_id, text, lang), labels of (doc_id, quality, toxic)."""
    least, good, bad = {}, {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    seen = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        seen.append((lang or "", d, {f for f, bad_ in fails.items() if bad_}))
    out, shapley = {}, {}
    for part in {p for p, _, _ in seen}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in seen if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                unique = sum(f == {letter} for p, _, f in seen if p == part)
                out[part, order, step] = [len(left), len(removed), sum(letter in f for _, f in gone), unique, sum(d in good for d, _ in removed), sum(d in bad for d, _ in removed)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
                gone += removed
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = [tuple(r) for r in A.filter_audit(docs, labels).collect()]
    assert sorted(got) == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


@pytest.mark.parametrize("partitions", ["1", "4", "17"])
def test_odd_rows_and_runs_over_many_ranges(spark, partitions):
    """Copies that fill several ranges, rows without a doc_id, repeated rows and labels, clashing names."""
    rows = [(d, t, [None, "en", "de"][i % 3]) for i, (d, t) in enumerate(odd_rows())]
    rows += [(1000 + i % 90, sentence(40, 120), "en") for i in range(150)] + [(None, sentence(40, 120), "de")] * 3
    rows += [(2000 - i, "", "de") for i in range(60)] + [(None, "lost", "en"), (None, "lost", "en"), (7, "LOUD " * 120, "en"), (8, "LOUD " * 120, None)]
    labels = [(d, int(d % 2 == 0), d % 3 if d % 5 else None) for d in range(0, 1100)] + [(1001, 1, None), (None, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id long, text string, lang string, mask int, digest string, quality int").repartition(3)
        got = [tuple(r) for r in A.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == brute(rows, labels)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
