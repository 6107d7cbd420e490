"""The pipeline's stages against what each should keep."""

from tests.conftest import SMALL
from tests.llm.test_corpus_ops import brute_join
from tests.llm.test_native_ops import MODEL, brute_lines


def test_stages(spark):
    import sentencepiece

    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(cp.stored(stage(spark, steps[-1], SMALL), "step"))
        if name != cp.STAGES[-1][0]:
            assert steps[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    clean = [d for d in rows[0] if labels.get(d) == 1]
    assert sum(d in rows[1] for d in clean) >= 0.97 * len(clean)
    want = {d: t for d, t, n, k in brute_lines([(r.doc_id, r.text) for r in rows[1].values()]) if not k or (t or "").strip(" \t\n\v\f\r")}
    assert {d: r.text for d, r in rows[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    assert set(rows[3]) == {d for d, _, c in brute_join([(r.doc_id, r.text) for r in rows[2].values()]) if d == c}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {d for d, r in rows[3].items() if any(i in r.text for i in items)}
    assert not held & set(rows[4]) and len(rows[4]) >= 0.85 * (len(rows[3]) - len(held))
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert set(rows[5]) == set(rows[4])
    assert all(r.ids == lib.encode(rows[4][d].text) and r.round_trip and r.n_ids == len(r.ids) for d, r in rows[5].items())


def test_empty(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_one_document_of_each_class_stays(spark):
    import corpus_pipeline as cp

    body = " ".join(f"w{i}" for i in range(60))
    near, other = body.replace("w59", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(3, body, "b"), (3, body, "a"), (3, body, "a"), (5, near, "c"), (5, other, "c"), (7, other, None), (None, near, "d"), (None, body.upper(), "d"), (None, "one two", "e"), (None, "one two", "e"), (9, None, "f"), (9, None, "f"), (9, "", "f"), (10, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string")
    kept = cp.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = [(3, body, "a"), (5, other, "c"), (None, "one two", "e"), (9, None, "f"), (9, None, "f"), (9, "", "f"), (10, " ", None)]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
