"""Decontamination: recall against brute force, planted leaks and paraphrases, odd rows."""

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_corpus_ops import sentence


def test_finds_what_brute_force_finds(spark):
    from lexforge.llm.decontaminate import contaminated

    docs, bench = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    d, b = docs.collect(), bench.collect()
    whole = {(x.doc_id, i.item_id) for x in d for i in b if i.text in x.text}
    assert len(whole) > 10 and len(whole & got) >= 0.98 * len(whole)
    # what else is found has most of the item
    for doc, item in got - whole:
        words = next(i.text for i in b if i.item_id == item).lower().split()
        text = set(next(x.text for x in d if x.doc_id == doc).lower().split())
        assert sum(w in text for w in words) >= 0.45 * len(words)


def test_candidate_search_recall(spark):
    """Latent candidates against exact TF-IDF cosines of every window."""
    import pyarrow as pa

    from lexforge.llm import _text as tx
    from lexforge.llm import decontaminate as dc

    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text") for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    idf = dc.weights(docs)
    basis = dc.latent_basis(docs, bench, idf)
    table = (basis * idf[:, None]).astype(np.float32)
    exact = (np.eye(dc.FEATURES) * idf[:, None]).astype(np.float32)
    rows = bench.collect()
    near, full = dc.Items(rows, idf, table), dc.Items(rows, idf, exact)
    hits = wanted = 0
    for _, _, data, offsets in tx.slices(pa.array([r.text for r in docs.limit(60).collect()]), most=20_000):
        w = dc.tokens(data, offsets)
        a = {(x, q) for x, _, q, _ in zip(*dc.candidates(w, idf, table, near.queries), strict=True)}
        b = {(x, q) for x, _, q, c in zip(*dc.candidates(w, idf, exact, full.queries), strict=True) if c >= 0.5}
        hits, wanted = hits + len(a & b), wanted + len(b)
    assert wanted and hits >= 0.9 * wanted


def test_planted(spark):
    from lexforge.llm.decontaminate import contaminated

    item = sentence(5, 40)
    words = item.split()
    changed = [w if i % 6 else f"other{i}" for i, w in enumerate(words)]
    rows = [
        (1, sentence(2, 300) + " " + item + " " + sentence(3, 200)), (2, item), (3, sentence(2, 50) + "\n" + item.upper().replace(" ", ",  ") + "\n" + sentence(4, 90)), (4, sentence(6, 200) + " " + " ".join(changed) + " " + sentence(7, 90)),
        (5, sentence(8, 400)), (6, None), (7, ""), (None, item), (2, item), (8, "?!"), (9, " ".join(words[:12]) + " " + sentence(9, 100)), (10, sentence(11, 20_000) + " " + item),
    ]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, item_id int, reason string")
    bench = spark.createDataFrame([(1, item), (2, sentence(77, 30)), (3, None), (4, ""), (5, "tiny one"), (None, sentence(78, 30))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (2, 1), (10, 1)], key=str)
    asked = spark.createDataFrame([(1, item, words[-1])], "item_id long, text string, answer string")
    assert {r.doc_id for r in contaminated(docs, asked).collect()} >= {1, 2, 3, 10}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,n", [("a b c d", "b x d", 2), ("a a a", "a a", 2), ("a b", "c", 0), ("a b c", "c b a", 1)])
def test_common_subsequence(a, b, n):
    from collections import namedtuple

    from lexforge.llm import decontaminate as dc

    row = namedtuple("row", "item_id text")
    row.__fields__ = row._fields
    idf = np.ones(dc.FEATURES)
    table = np.zeros((dc.FEATURES, 2), np.float32)
    x, y = (dc.Items([row(0, t)], idf, table) for t in (a, b))
    assert x.common(0, y.words[0]) == n


def test_exact_copies_of_a_large_benchmark():
    """No exact copy falls below SIMILAR when the benchmark has thousands of items."""
    from collections import namedtuple

    import pyarrow as pa

    from lexforge.llm import _text as tx
    from lexforge.llm import decontaminate as dc

    row = namedtuple("row", "item_id text")
    row.__fields__ = row._fields
    r = np.random.default_rng(3)
    vocabulary = [f"w{x}" for x in range(20_000)]
    items = [row(i, " ".join(vocabulary[min(int(x), 19_999)] for x in r.zipf(1.3, 40))) for i in range(3000)]
    idf = np.log(1 + 1000 / (1 + np.bincount(np.concatenate([p for i in items for p in dc._item_passages(i.text)]), minlength=dc.FEATURES))) + 0.05
    found = set()
    for table, block in dc.item_blocks(items, idf):
        for _, _, data, offsets in tx.slices(pa.array([i.text for i in items], pa.string())):
            found |= {(d, block.ids[t]) for d, t, *_ in dc.matches(dc.tokens(data, offsets), idf, table, block) if d == block.ids[t]}
    assert len(found) == len(items)


def test_short_items_in_long_texts(spark):
    from lexforge.llm.decontaminate import contaminated

    # one copy each at many places of a text whose words all weigh more than the items'
    items = {k: " ".join(f"usual{k}x{j}" for j in range(k)) for k in (1, 2, 3, 4, 5, 7, 8, 12, 20)}
    filler = [(100 + i, " ".join(items.values())) for i in range(40)]
    at = {}
    for k, item in items.items():
        for place in (0, 9, 31, 50, 120):
            words = [f"rare{k}y{place}y{j}" for j in range(150)]
            at[1000 * k + place] = (k, " ".join(words[:place] + item.split() + words[place:]))
    apart = (7, "usual2x0 " + " ".join(f"between{j}" for j in range(9)) + " usual2x1 " + " ".join(f"after{j}" for j in range(90)))
    docs = spark.createDataFrame([(d, t) for d, (_, t) in at.items()] + filler + [apart], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.common_share, r.reason) for r in contaminated(docs, bench).collect() if r.doc_id not in range(100, 140)}
    assert got == {(d, k, 1.0, "leak") for d, (k, _) in at.items()}


@pytest.mark.parametrize("replaced,least", [(0.2, 0.95), (0.35, 0.9), (0.5, 0.6)])
def test_recall_of_paraphrases(spark, replaced, least):
    """Items with words replaced at random, inside long texts of the corpus; and the same texts without them."""
    import random

    from lexforge.llm.decontaminate import contaminated

    docs, bench = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(int(100 * replaced))
    hosts = [r.text for r in docs.collect() if len(r.text or "") > 2000]
    known = {r.doc_id for r in contaminated(docs, bench).collect()}
    hosts = [r.text for r in docs.collect() if len(r.text or "") > 2000 and r.doc_id not in known]
    vocabulary = [w for h in hosts for w in h.split()]
    rows = []
    for n, item in enumerate(bench.orderBy("item_id").collect()):
        for again in range(3):
            words = [w if rng.random() >= replaced else rng.choice(vocabulary) for w in item.text.split()]
            host = hosts[(3 * n + again) % len(hosts)].split()
            at = rng.randrange(len(host))
            rows.append((10**6 + len(rows), " ".join(host[:at] + words + host[at:]), item.item_id))
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in contaminated(mixed, bench).filter("doc_id >= 1000000").collect()}
    want = {(d, i) for d, _, i in rows}
    print(replaced, len(got & want) / len(want), len(got - want))
    assert len(got & want) >= least * len(want)
    assert len(got - want) <= 0.02 * len(want)
