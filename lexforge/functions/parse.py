"""Model responses to columns: the part that regular expressions cannot say.

A response holds an object somewhere in prose, fences or thinking. It is read in one pass:
from each open brace a JSON object is decoded in place; where that fails at some
character, no brace that the failed object opened before it can do better, so only the
objects that were complete by then, and braces inside its strings, are looked at before
the scan goes on from that character. Each target has its own fields and its own idea of
when an object will do. Malformed, empty and null responses give a row of defaults,
never an error; so do objects nested deeper than the JSON reader goes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .guards import refuses_image

Fits = Callable[[dict], bool]

FIELDS = "question string, answer string, answer_format string, score int, verdict string, found boolean"
DRAFT = "question string, answer string, answer_format string, task_type string, reasoning string, found boolean"
CRITIQUE = "score int, rewrite_question string, rewrite_answer string, reasoning string, found boolean"
ANSWER = "answer string, reasoning string, found boolean"
FACT_CHECK = "verdict string, claims array<struct<claim: string, verdict: string, evidence: string>>, found boolean"

FENCE = re.compile(r"```(?:json)?|```", re.I)
THINK = re.compile(r"(?s)<think>(.*?)</think>")
#: What an object begins with, and how far the scan goes before the text behind it is let go: an error counts the lines before it.
START = re.compile(r'\{[ \t\n\r]*["}]')
STEP = 16_384
TOKEN = re.compile(r'(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}]')


class _Object(dict):
    """An object that still knows the values of keys it holds twice."""

    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        super().__init__(pairs)
        self.every = [v for _, v in pairs]


READER = json.JSONDecoder(object_pairs_hook=_Object)


def _inside(value: object) -> Iterator[dict]:
    """The objects of a decoded value, outer ones before those in them, in the order they stand."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, _Object):
            yield v
            stack.extend(reversed(v.every))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _begun(text: str, at: int, stop: int) -> list[tuple[int, bool]]:
    """Places worth a try in what a failed object had read: (start, whether a complete object stands there)."""
    open_, whole, quoted = [], [], []
    for token in TOKEN.finditer(text, at + 1, stop):
        if token[0] == "{":
            open_.append(token.start())
        elif token[0] == "}":
            start = open_.pop()
            while whole and whole[-1] > start:  # it holds those
                whole.pop()
            whole.append(start)
        else:
            quoted += [token.start() + i for i, c in enumerate(token[0]) if c == "{"]
    return sorted([(s, True) for s in whole] + [(s, False) for s in quoted])


def first_object(text: str, fits: Fits) -> dict | None:
    """The first JSON object in the text, by where it starts, that fits."""
    tried, end, step = -1, 0, max(STEP, len(text) // 256)
    while begin := START.search(text, end):
        at = begin.start()
        if at > step:
            text, tried, at = text[at:], tried - at, 0
        try:
            value, end = READER.raw_decode(text, at)
        except json.JSONDecodeError as e:
            for start, whole in _begun(text, at, e.pos):
                if whole or start > tried:
                    try:
                        value, _ = READER.raw_decode(text, start)
                    except json.JSONDecodeError:
                        continue
                    if hit := next(filter(fits, _inside(value)), None):
                        return hit
            tried, end = max(tried, e.pos), max(e.pos, at + 1)
        except RecursionError:
            return None
        else:
            if hit := next(filter(fits, _inside(value)), None):
                return hit
    return None


def _said(text: str | None) -> tuple[str, str]:
    """(the response without fences and thinking, the thinking); all of it where nothing else is left."""
    bare = FENCE.sub("", text or "")
    thought = "\n".join(THINK.findall(bare)).strip()
    rest = THINK.sub("", bare)
    if not thought and rest.strip().startswith("<think>"):
        thought, rest = rest.strip()[7:].strip(), ""
    return (rest if rest.strip() else bare), thought


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _whole(value: object) -> int:
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return 0


def _found(text: str | None, fits: Fits) -> tuple[dict | None, str]:
    """The first fitting object of what was said, else of what was thought, and the thinking."""
    rest, thought = _said(text)
    return first_object(rest, fits) or (first_object(thought, fits) if thought else None), thought


def parse_one(text: str | None, key: str) -> tuple:
    rest = FENCE.sub("", THINK.sub("", text or ""))
    got = first_object(rest, lambda o: key in o)
    if got is None:
        return ("", "", "", 0, "", False)
    return (str(got.get("question", "")), str(got.get("answer", "")), str(got.get("answer_format", "")), _whole(got.get("score", 0)), str(got.get("verdict", "")), True)


def draft_of(text: str | None) -> tuple:
    """A question and an answer, neither blank; numbers become text."""
    got, thought = _found(text, lambda o: bool(_text(o.get("question")).strip() and _text(o.get("answer")).strip()))
    return (*(_text(got.get(k, d)) for k, d in (("question", ""), ("answer", ""), ("answer_format", "number"), ("task_type", "chart"))), thought, True) if got else ("", "", "", "", thought, False)


def critique_of(text: str | None) -> tuple:
    """A score and perhaps a rewritten question and answer; a score that is no number is 0."""
    got, thought = _found(text, lambda o: "score" in o)
    return (_whole(got["score"]), _text(got.get("rewrite_question")), _text(got.get("rewrite_answer")), thought, True) if got else (0, "", "", thought, False)


def answer_of(text: str | None) -> tuple:
    """An answer that is not empty, zero or false, and the reasoning beside it."""
    got = first_object(FENCE.sub("", text or ""), lambda o: bool(o.get("answer")))
    return (_text(got["answer"]).strip(), _text(got.get("reasoning")).strip(), True) if got else ("", "", False)


def fact_check_of(text: str | None) -> tuple:
    """A verdict over claims; claims that are no objects are left out."""
    got = first_object(FENCE.sub("", text or ""), lambda o: "verdict" in o and "claims" in o)
    if not got:
        return ("", [], False)
    claims = got["claims"] if isinstance(got["claims"], list) else []
    return (_text(got["verdict"]), [{k: _text(c.get(k)) for k in ("claim", "verdict", "evidence")} for c in claims if isinstance(c, dict)], True)


def _column(text: Column, one: Callable[[str | None], tuple], fields: str) -> Column:
    kind = _parse_datatype_string(fields)
    assert isinstance(kind, StructType)

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=kind.names)

    return run(text)


def parse_response(text: Column, key: str) -> Column:
    """Struct FIELDS of the object with `key` in each response."""
    return _column(text, lambda t: parse_one(t, key), FIELDS)


def parse_draft(text: Column) -> Column:
    """Struct DRAFT; a response that says that it cannot see the image holds none."""
    return _column(F.when(~refuses_image(text), text), draft_of, DRAFT)


def parse_critique(text: Column) -> Column:
    return _column(text, critique_of, CRITIQUE)


def parse_answer(text: Column) -> Column:
    return _column(text, answer_of, ANSWER)


def parse_fact_check(text: Column) -> Column:
    return _column(text, fact_check_of, FACT_CHECK)
