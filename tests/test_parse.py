"""The response scanner against trying every brace, and its targets."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lexforge.functions import parse as P


def every_brace(text, fits):
    for at, c in enumerate(text):
        if c == "{":
            try:
                got, _ = P.READER.raw_decode(text, at)
            except (json.JSONDecodeError, RecursionError):
                continue
            if fits(got):
                return got
    return None


PIECES = ["{", "}", '"', "\\", ",", ":", "[", "]", '"k"', '"k": 1', '{"k": 2}', '{"j": {"k": 3}}', '{"j": "{', '"a": ', "x", "\n", '{"a": {"b": {"k": "}"}}, ', '\\"', "1", "{}", "null", '{"s": "use {"k": 4}']


@pytest.mark.parametrize("seed", range(8))
def test_scan_equals_trying_every_brace(seed):
    rng = random.Random(seed)
    hits = 0
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 18)))
        want = every_brace(text, lambda o: "k" in o)
        assert P.first_object(text, lambda o: "k" in o) == want, text
        hits += want is not None
    assert hits > 500


@pytest.mark.parametrize("unit", ["{", '{"a":', '{"a":{"b":1},', '{"a":"{', '{"', '{"a":1}{', "{}", '"{', '{"a": "x" '])
def test_a_megabyte_is_one_pass(unit):
    text = (unit * (1_000_000 // len(unit)))[:1_000_000]
    start = time.time()
    assert P.first_object(text, lambda o: "k" in o) is None
    assert time.time() - start < 4


def test_megabyte_of_braces_in_under_a_second():
    start = time.time()
    assert not P.draft_of("{" * 1_000_000)[-1]
    assert time.time() - start < 1


def test_drafts():
    good = {"question": "How many?", "answer": 5}
    assert P.draft_of(json.dumps(good)) == ("How many?", "5", "number", "chart", "", True)
    assert P.draft_of("<think>hm {\"question\": \"no\"}</think>\n```json\n" + json.dumps(good | {"task_type": "spatial"}) + "\n```") == ("How many?", "5", "number", "spatial", 'hm {"question": "no"}', True)
    assert P.draft_of("<think>so " + json.dumps(good))[:2] == ("How many?", "5")
    assert P.draft_of('{"question": " ", "answer": 1} then {"question": "Q", "answer": "a } b"}')[:2] == ("Q", "a } b")
    assert P.draft_of("word " * 9000 + json.dumps(good))[-1]
    for bad in (None, "", "no json", "{}", '{"question": "q"}', "[1, 2]", '{"question": null, "answer": 1}'):
        assert P.draft_of(bad)[:2] == ("", "") and not P.draft_of(bad)[-1]


def test_other_targets():
    assert P.critique_of('x {"score": "4.0", "rewrite_answer": 12}') == (4, "", "12", "", True)
    assert P.critique_of('{"score": "high"}')[0] == 0 and not P.critique_of("{")[-1]
    assert P.answer_of('{"answer": ""} {"reasoning": " r ", "answer": 0} {"w": {"answer": " 7 "}}') == ("7", "", True)
    assert P.fact_check_of('{"verdict": "x"} {"claims": [{"claim": "c", "verdict": "SUPPORTED"}, 3], "verdict": "pass"}') == ("pass", [{"claim": "c", "verdict": "SUPPORTED", "evidence": ""}], True)
    assert P.fact_check_of('{"verdict": 1, "claims": null}') == ("1", [], True)


def test_columns(spark):
    rows = [('{"question": "q", "answer": "a"}',), ("this is a text-only model {\"question\": \"q\", \"answer\": \"a\"}",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.p.found for r in df.select(P.parse_draft(F.col("t")).alias("p")).collect()] == [True, False, False]
    assert [r.p.claims for r in df.select(P.parse_fact_check(F.col("t")).alias("p")).collect()] == [[], [], []]
    assert [r.p.found for r in df.select(P.parse_answer(F.col("t")).alias("p")).collect()] == [True, True, False]
    assert [r.p.score for r in df.select(P.parse_critique(F.col("t")).alias("p")).collect()] == [0, 0, 0]
