"""Text guards, guardrails and response tests as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .rules import any_match, any_word, lowered, plain, words


def input_risk(text: Column) -> Column:
    """'blocked' for injections and secrets, 'suspicious' for great length, else 'safe'."""
    low = lowered(F.coalesce(text, F.lit("")))
    return F.when(any_match(low, P.INJECTION) | any_match(low, P.SENSITIVE), "blocked").when(F.length(text) > 5000, "suspicious").otherwise("safe")


def input_reason(text: Column) -> Column:
    """Number of the first injection (1-9) or secret (10-12) pattern; null for none."""
    low = lowered(F.coalesce(text, F.lit("")))
    out = None
    for i, p in enumerate([*P.INJECTION, *P.SENSITIVE], 1):
        out = F.when(any_match(low, [p]), i) if out is None else out.when(any_match(low, [p]), i)
    return out


def pii_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(plain(p)), name) for name, p in P.PII)))


def redacted(text: Column) -> Column:
    """text with personal data replaced; null if there is none."""
    out = text
    for _, p in P.PII:
        out = F.regexp_replace(out, plain(p), "[REDACTED]")
    return F.when((F.size(pii_kinds(text)) > 0) | toxic(text), out)


def toxic(text: Column) -> Column:
    return lowered(text).rlike(plain(P.TOXIC_WORDS))


def leaks(text: Column) -> Column:
    """Numbers of the leakage patterns that occur."""
    low = lowered(text)
    return F.array_compact(F.array(*(F.when(any_match(low, [p]), i) for i, p in enumerate(P.LEAKAGE, 1))))


def plausible(d: dict[str, Column]) -> Column:
    a = F.lower(F.trim(F.coalesce(d["answer"], F.lit(""))))
    return (a != "") & ~a.isin(P.TRIVIAL_ANSWERS)


def moderate(d: dict[str, Column]) -> Column:
    a = F.trim(F.coalesce(d["answer"], F.lit("")))
    value = F.regexp_replace(a, "[,%]", "").try_cast("double")
    odd = ((value == 0) & (d["answer_format"] != "percent")) | (F.abs(value) > 1_000_000)
    return ~(d["answer_format"].isin("number", "integer", "percent") & F.coalesce(odd, F.lit(False)))


def fits_format(d: dict[str, Column]) -> Column:
    a, fmt = F.trim(F.coalesce(d["answer"], F.lit(""))), F.coalesce(d["answer_format"], F.lit(""))
    bare, n = F.replace(a, F.lit(","), F.lit("")), F.size(words(a))
    ok = F.when(fmt == "number", bare.rlike(r"^-?\d+(\.\d+)?$")).when(fmt == "integer", bare.rlike(r"^-?\d+$")).when(fmt == "percent", bare.rlike(r"^-?\d+(\.\d+)?%?$")).when(fmt == "word", n <= 4).when(fmt == "phrase", n <= 6).otherwise(True)
    return (a == "") | ok


def diverse(d: dict[str, Column]) -> Column:
    q, p = F.lower(F.trim(d["question"])), F.lower(F.trim(F.coalesce(d["previous_question"], F.lit(""))))
    a, b = F.array_distinct(words(q)), F.array_distinct(words(p))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return (p == "") | ~((q == p) | ((F.size(a) > 0) & (F.size(b) > 0) & (share > 0.85)))


def good_enough(d: dict[str, Column], least: float = 40) -> Column:
    return ~((d["quality"] > 0) & (d["quality"] < least))


#: The guardrails that run, by name; callers may add functions of a dict of Columns.
GUARDRAILS: dict[str, Callable[[dict[str, Column]], Column]] = {"plausible": plausible, "moderate": moderate, "fits_format": fits_format, "diverse": diverse}


def failed_guardrails(d: dict[str, Column], rails: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(f(d), F.lit(True)), name) for name, f in (rails or GUARDRAILS).items())))


def refuses_image(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~any_word(low, P.IMAGE_EVIDENCE) & any_word(low, P.IMAGE_REFUSALS)


def thinking(text: Column) -> Column:
    """What stands in <think> blocks, else after one that is not closed; null for none."""
    closed = F.regexp_extract_all(text, F.lit("(?s)<think>(.*?)</think>"), F.lit(1))
    open_ = F.regexp_extract(text, "(?s)<think>(.*)$", 1)
    return F.when(F.size(closed) > 0, F.trim(F.array_join(closed, "\n"))).when(text.contains("<think>"), F.trim(open_))
