"""The stored collection of vectors: writes, reads, exact search and measured recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators.search import vector_topk
from lexforge.sources import vectors as V
from tests.conftest import SMALL


def embedded(spark, sf="sf0.01"):
    v = spark.read.parquet(f"{SMALL}/../{sf}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), "vec_id").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding")


def asked(rows):
    return rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def test_writes_and_reads(spark, tmp_path):
    c, rows = V.Collection(spark, f"file://{tmp_path}/c"), embedded(spark, "sf0.001")
    n = rows.count()
    assert c.manifest() == (-1, []) and c.count() == 0
    c.upsert(rows)
    assert c.count() == n and c.get({"label": "1"}).count() == rows.filter("metadata['label'] = '1'").count()
    c.upsert(rows.filter("id < 5").withColumn("content", F.lit("new")).union(rows.filter("id < 5").withColumn("content", F.lit("later"))))
    c.delete(spark.createDataFrame([(2,), (7,), (7,), (10**9,)], "id long"))
    assert c.count() == n - 2 and {(r.id, r.content) for r in c.rows().filter("id < 8").collect()} == {(0, "new"), (1, "new"), (3, "new"), (4, "new"), (5, "text 5"), (6, "text 6")}
    c.upsert(rows.filter("id = 7"))
    before = {(r.id, r.content) for r in c.rows().collect()}
    c.compact()
    assert len(c.manifest()[1]) == 1 and {(r.id, r.content) for r in c.rows().collect()} == before
    with pytest.raises(RuntimeError, match="another"):
        c._commit(c.manifest()[0], [])
    c.clear()
    assert c.count() == 0 and c.search(asked(rows)).count() == 0
    c.upsert(rows.limit(3))
    assert c.count() == 3


def test_search_is_exact_over_all_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "QUERIES", 3)
    c, rows = V.Collection(spark, f"file://{tmp_path}/c"), embedded(spark)
    c.upsert(rows)
    got = sorted(map(tuple, c.search(asked(rows), 5, exact=True).collect()))
    want = vector_topk(rows.select(F.col("id").alias("vec_id"), "embedding"), asked(rows), 5)
    assert got == sorted(map(tuple, want.collect()))
    some = c.search(asked(rows), 3, exact=True, equal={"label": "2"})
    labels = {r.id: r.metadata["label"] for r in rows.collect()}
    assert {labels[r.id] for r in some.collect()} == {"2"} and some.count() == 3 * asked(rows).count()


def test_recall(spark, tmp_path):
    """Recall at 5 against brute force, with the lists that a search probes by default."""
    c, rows = V.Collection(spark, f"file://{tmp_path}/c"), embedded(spark, "sf0.1")
    c.upsert(rows)
    asking = asked(rows)
    got = {(r.query_id, r.id) for r in c.search(asking).collect()}
    want = {(r.query_id, r.id) for r in c.search(asking, 5, exact=True).collect()}
    centres, probes = c.lists()
    print("recall", len(got & want) / len(want), "with", probes, "of", len(centres), "lists")
    assert probes < len(centres)
    assert len(want) == 5 * asking.count() and len(got & want) >= 0.9 * len(want)
    sizes = [r["count"] for r in c.rows().groupBy("list").count().collect()]
    assert sum(sizes) == rows.count() and np.isfinite(centres).all()


def test_each_query_filters_for_itself(spark, tmp_path):
    c, rows = V.Collection(spark, f"file://{tmp_path}/c"), embedded(spark)
    c.upsert(rows)
    labels = {r.id: r.metadata["label"] for r in rows.collect()}
    queries = asked(rows).withColumn("label", F.when(F.col("query_id") % 100 == 0, "").when(F.col("query_id") % 150 == 0, None).otherwise("1"))
    got = c.search(queries, 4, exact=True, same="label").collect()
    assert {labels[r.id] for r in got if r.query_id % 100 and r.query_id % 150} == {"1"}
    free = {(r.query_id, r.id) for r in c.search(asked(rows), 4, exact=True).collect() if r.query_id % 100 == 0 or r.query_id % 150 == 0}
    assert {(r.query_id, r.id) for r in got if r.query_id % 100 == 0 or r.query_id % 150 == 0} == free


def test_contexts_come_from_cache_and_from_documents(spark):
    from lexforge.plans.queries import contexts

    rows = contexts(spark, f"{SMALL}/../sf0.01").collect()
    assert {r.from_cache for r in rows} == {True, False} and all(r.context for r in rows)


def test_topk_in_blocks(spark, monkeypatch):
    from pyspark.sql import Window

    from lexforge.operators import search as S

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40]]) for i in range(120)]
    rows += [(200, [0.0] * 6), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 4 = 0 or vec_id > 200").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = df.crossJoin(asked).filter("vec_id <> query_id").withColumn("score", S.cosine(F.col("embedding"), F.col("q")))
    every = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter("rank <= 5")
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "QUERIES", 8)
    got = vector_topk(df, asked, 5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect()) == sorted(tuple(r) for r in every.select("query_id", "rank", "vec_id").collect())
    # no pair of rows is a row of the plan
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
