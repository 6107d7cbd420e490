"""Operators 5, 6, 9 and 10 against brute force on small tables, odd rows included."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.conftest import SMALL

WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHA = [f"w{i}x{i * i % 97}" for i in range(400)]


def sentence(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(ALPHA[x // 7 % len(ALPHA)])
    return " ".join(out)


def odd_rows():
    base = sentence(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = sentence(9, 40)
    rows = [
        (0, base), (1, base), (2, near), (3, near.upper()), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one  TWO"), (9, "one two three four five"),
        (10, sentence(2, 80) + " " + passage + " " + sentence(3, 80)), (11, sentence(4, 70) + " " + passage), (11, sentence(4, 70) + " " + passage),
        (12, "a\n" * 40 + sentence(5, 60)), (13, "x " * 300), (14, "é" * 120 + sentence(6, 60)), (15, "é" * 119 + sentence(6, 60)), (16, passage), (None, base), (None, sentence(7, 60)),
        (17, sentence(8, 4000)), (18, sentence(8, 4000)[300:]), (19, "\0" * 130), (20, "\0" * 70 + "b"), (21, "### $$$ <b>|& " * 20),
    ]
    return rows + [(100 + i, " ".join([*words[:i], f"new{i}", *words[i + 1 :]])) for i in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame([(d, t, "en", 7, "y", "z") for d, t in rows], "doc_id long, text string, lang string, n long, row string, part string").repartition(5)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def brute_suffix(rows):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            seen[k] = min(seen.get(k, 2**63 - 1), 2**63 - 1 if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < (2**63 - 1 if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_suffix_dedup(spark, odd, which):
    from lexforge.llm.suffix_dedup import suffix_dedup

    rows = odd_rows() if which == "odd" else documents(spark)
    df = odd if which == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(brute_suffix(rows), key=key)


def test_loser_trees_never_compare_known_prefixes():
    import numpy as np

    from lexforge.llm.suffix_dedup import WIDTH, LoserTrees, shared_prefix

    rng = random.Random(2)
    groups = [[sorted({f"{g:03d}common-prefix-{rng.randrange(900):05d}".encode().ljust(WIDTH, b"\0") for _ in range(rng.randrange(1, 40))}) for _ in range(4)] for g in range(30)]
    flat = [k for runs in groups for keys in runs for k in keys]
    words = np.frombuffer(b"".join(flat), ">u8").reshape(-1, WIDTH // 8).astype(np.uint64)
    same = np.concatenate([[0], shared_prefix(words[1:], words[:-1])])
    size = np.array([[len(keys) for keys in runs] for runs in groups])
    end = np.cumsum(size.reshape(-1)).reshape(size.shape)
    trees = LoserTrees(words, same, end - size, end)
    out = {g: [] for g in range(30)}
    for g, record, shared in trees:
        for x, r, n in zip(g.tolist(), record.tolist(), shared.tolist(), strict=True):
            out[x].append((flat[r], n))
    for g, runs in enumerate(groups):
        assert [k for k, _ in out[g]] == sorted(k for keys in runs for k in keys)
        for (a, _), (b, n) in zip(out[g], out[g][1:], strict=False):
            assert n == WIDTH if a == b else a[:n] == b[:n] and a[n] != b[n]
    # a record's prefix is read once or little more, not once a match
    assert trees.compared < 1.6 * sum(len(k.rstrip(b"\0")) + (WIDTH if k in seen else 0) for seen, k in (({*flat[:i]}, k) for i, k in enumerate(flat)))


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            over = len(a & sets[j])
            if over and 100 * over >= 75 * (len(a) + len(sets[j]) - over):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return out


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_ngram_join(spark, odd, which):
    from lexforge.llm.ngram_join import ngram_join

    rows = odd_rows() if which == "odd" else documents(spark)
    df = odd if which == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join(df).collect()]
    assert sorted(got, key=key) == sorted(brute_join(rows), key=key)


def test_ngram_join_by_blocks(spark, monkeypatch):
    from lexforge.llm import ngram_join

    for k, v in (("ROUNDS", 1), ("COLD", 1), ("BLOCK", 7)):
        monkeypatch.setattr(ngram_join, k, v)
    words = sentence(1, 90).split()
    rows = [(i, " ".join([*words[: i % 80], f"new{i}", *words[i % 80 + 1 :]])) for i in range(40)]
    rows += [(50 + i, " ".join([*words[:i], f"a{i}", *words[i + 1 : i + 15], f"b{i}", *words[i + 16 : i + 30], f"c{i}", *words[i + 31 :]])) for i in range(30)]
    got = [tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_join(rows))


def brute_rules(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(three)
        inside = {i + j for i, g in enumerate(three) if n[g] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed))
    return out


def test_merged_classes_equal_classes_of_all_links(spark):
    import random

    from lexforge.llm._spark import components, merged

    draw = random.Random(3)
    links = [(draw.randrange(150), draw.randrange(150)) for _ in range(110)] + [(40, 40), (149, 0), (149, 0)]
    links = [(a, b) for a, b in links if a != b]
    of = lambda ls: spark.createDataFrame(ls, "a long, b long")
    roots = None
    for part in (links[:40], links[40:80], [], links[60:]):
        roots = merged(roots, of(part))
    want = sorted(map(tuple, components(of(links)).select("node", "root").collect()))
    assert sorted(map(tuple, roots.select("node", "root").collect())) == want


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_quality_rules(spark, odd, which):
    from lexforge.llm.quality_rules import quality_rules

    rows = odd_rows() if which == "odd" else documents(spark)
    df = odd if which == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules(df)
    base = [tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(base, key=key) == sorted(brute_rules(rows), key=key)
    assert not got.filter("base_failed and kept").count()
    if which == "odd":
        assert {r.doc_id: r.kept for r in got.collect()}[17]


def test_quality_classifier(spark):
    from lexforge.llm.quality_classifier import quality_classifier

    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_quality_classifier_odd_rows(spark, odd):
    from lexforge.llm.quality_classifier import quality_classifier

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier(odd, none).toPandas()
    assert len(got) == len(odd_rows()) and set(got.score) == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier(odd, some).toPandas()
    assert len(got) == len(odd_rows()) and got.score.between(0, 1).all()


def test_empty_tables(spark):
    from lexforge.llm import ngram_join, quality_classifier, quality_rules, suffix_dedup

    none = spark.createDataFrame([], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ngram_join.ngram_join(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_classifier.quality_classifier(none, labels).count() == 0
