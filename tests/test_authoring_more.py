"""Caption lines, rejected pictures, repeated rows of transitions, fallback classes."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import authoring as Au
from lexforge.operators import figures as Fig
from lexforge.operators import relational as Rel
from lexforge.operators import search as S
from lexforge.operators import transitions as Tr


@pytest.mark.parametrize("line,want", [
    ("Figure 3: results", "3"), ("Fig. 2.1b Results", "2.1b"), ("as shown in Figure 4", None), ("see, figure 5 here", None), ("see, figure 5: : here", "5"), ("x" * 31 + "A Figure 6", None), ("TABLE Figure 7", "7"),
    ("no number: Figure", None), ("", None), (None, None), ("FIG 8", "8"), ("É Figure 9", "9"), ("é Figure 9", None), ("End. Figure 1", None),
])
def test_caption_lines(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(T.caption_figure(F.col("l"))).first()[0] == want


def test_rejects(spark):
    rows = [(100.0, 100.0, 40, 900.0, 2.0), (600.0, 100.0, 40, 900.0, 2.0), (300.0, 200.0, 4, 29.0, 2.0), (300.0, 200.0, 40, 1999.0, 5.1), (300.0, 200.0, 40, 2000.0, 90.0), (300.0, 200.0, 40, 199.0, 0.0), (None, None, None, None, None), (0.0, 5.0, 9, 500.0, 1.0)]
    got = Fig.rejects(spark.createDataFrame(rows, "width double, height double, n_colors int, gray_variance double, transitions double")).collect()
    assert [(r.banner, r.logo, r.text_only) for r in got] == [(False, True, False), (True, False, False), (True, True, True), (False, False, True), (False, False, False), (False, False, True), (True, True, False), (True, False, False)]


def test_repeated_rows_do_not_hang_on_their_order(spark):
    rows = [(1, "a", None), (1, "b", "x"), (1, "b", None), (2, None, None), (None, "c", "y")]
    for parts in (1, 3, 5):
        got = Au.one_each(spark.createDataFrame(rows, "id long, status string, notes string").repartition(parts), "id").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, "b", None), (2, None, None), (None, "c", "y")], key=str) or sorted(map(tuple, got), key=str) == sorted([(1, "b", "x"), (2, None, None), (None, "c", "y")], key=str)
    firsts = {tuple(map(tuple, sorted(Au.one_each(spark.createDataFrame(rows[::step], "id long, status string, notes string").repartition(3), "id").collect(), key=str))) for step in (1, -1)}
    assert len(firsts) == 1


def test_classes_without_prototypes_or_embeddings(spark):
    figures = spark.createDataFrame([(1, [1.0, 0.0], 7, 0.4), (2, None, 8, 0.6), (3, [-1.0, 0.0], 9, 0.2), (4, [0.0, 0.0], 5, 0.1)], "vec_id long, embedding array<double>, heuristic int, heuristic_confidence double")
    near = spark.createDataFrame([(0, [2.0, 0.0]), (0, [4.0, 0.0]), (1, [0.0, -1.0])], "label int, p array<double>")
    got = {r.vec_id: tuple(r)[1:] for r in S.classify(figures, near).collect()}
    assert got == {1: (0, 1.0, "cnn"), 2: (8, 0.6, "heuristic"), 3: (9, 0.0, "cnn"), 4: (5, 0.0, "cnn")}
    got = {r.vec_id: tuple(r)[1:] for r in S.classify(figures, near.limit(0)).collect()}
    assert got == {1: (7, 0.4, "heuristic"), 2: (8, 0.6, "heuristic"), 3: (9, 0.2, "heuristic"), 4: (5, 0.1, "heuristic")}


@pytest.mark.parametrize("held,join", [(4, "BroadcastHashJoin"), (3, "BroadcastHashJoin"), (2, "ShuffledHashJoin")])
def test_what_stays_is_not_sorted(spark, monkeypatch, held, join):
    monkeypatch.setattr(Rel, "BROADCAST_ROWS", held, raising=False)
    children = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, 10), (5, 12), (5, 12), (6, 13)], "id long, task_id long")
    left = Tr.delete_cascade(children, spark.createDataFrame([(10,), (10,), (None,), (13,)], "id long"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "Sort" not in plan
    assert sorted(left.select("id", "task_id").collect(), key=str) == [(2, None), (3, 11), (5, 12), (5, 12)]
    assert Tr.delete_cascade(children.select("id"), children.filter("id > 2"), "id").count() == 2
