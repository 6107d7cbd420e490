"""Scalar functions over questions, answers, models and verdicts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .rules import any_match, any_word, words


def half_up(value: Column, digits: int) -> Column:
    """Round half up by floor, alike in every engine; null stays null."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def strategy(question: Column) -> Column:
    """First class whose pattern occurs; 'other' for none or an empty question."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    out = F.when(q == "", F.lit("other"))
    for name, pattern in P.STRATEGIES:
        out = out.when(any_match(q, [pattern]), name)
    return out.otherwise("other")


def coverage_strategy(question: Column) -> Column:
    """The coverage matrix's own, word-list based classes."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for name, first, second in P.COVERAGE_STRATEGIES:
        hit = any_word(q, first) & (any_word(q, second) if second else F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def difficulty_of(qwen: Column, gemini: Column) -> Column:
    return F.when(qwen > 0, "easy").when(gemini > 0, "challenging").otherwise("hardest")


LEVELS = ["easy", "challenging", "hardest"]


def shift_difficulty(difficulty: Column, delta: Column) -> Column:
    """Move by delta levels, clamped; a value that is no level stays."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), difficulty).cast("int")
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(1), F.least(F.lit(3), at + delta)).cast("int"))).otherwise(difficulty)


def token_costs(model: Column) -> tuple[Column, Column]:
    low = F.lower(model)
    cost = [None, None]
    for part, *usd in P.TOKEN_COSTS:
        for k in (0, 1):
            cost[k] = F.when(low.contains(part), usd[k]) if cost[k] is None else cost[k].when(low.contains(part), usd[k])
    return cost[0].otherwise(P.DEFAULT_COST[0]), cost[1].otherwise(P.DEFAULT_COST[1])


def estimate_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    per_in, per_out = token_costs(model)
    return tokens_in / 1000 * per_in + tokens_out / 1000 * per_out


def format_cost(usd: Column) -> Column:
    shown = lambda digits: F.format_string(f"$%.{digits}f", half_up(usd, digits))
    return F.when(usd < 0.01, shown(4)).when(usd < 1, shown(3)).otherwise(shown(2))


def normalize_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^0-9.\-]", "").try_cast("double")


def matches_golden(answer: Column, golden: Column, answer_format: Column) -> Column:
    """Numbers within half a percent or 0.01, other answers equal but for case and outer spaces; empty ones never."""
    x, y = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(golden, F.lit("")))
    a, b = normalize_number(x), normalize_number(y)
    near = F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.01), 0.005 * F.abs(b)), F.lit(False))
    return F.when((x == "") | (y == ""), False).when(answer_format == "number", near).otherwise(F.lower(x) == F.lower(y))


def content_id(name: Column, text: Column, digits: int = 12) -> Column:
    return F.concat(name, F.lit("@"), F.substring(F.sha2(text, 256), 1, digits))


def keyword_overlap(query: Column, content: Column) -> Column:
    q, c = F.array_distinct(words(F.lower(query))), F.array_distinct(words(F.lower(content)))
    return F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))


def verdict(text: Column) -> Column:
    up = F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(up.startswith("NOT_"), "NOT_SUPPORTED").when(up.startswith("UNVERIFI") | up.startswith("CANNOT") | up.startswith("CAN'T"), "UNVERIFIABLE").otherwise("SUPPORTED")


def suitability(complexity: Column, dense: Column, chart: Column) -> Column:
    band = lambda c, i: complexity >= F.when(chart, c).otherwise(i)
    return F.when(band(0.85, 0.75) & dense, "HARDEST").when(band(0.55, 0.45), "CHALLENGING").otherwise("EASY")


def consensus_score(quality: Column, valid: Column) -> Column:
    return quality + F.when(valid, 50).otherwise(0) + F.when(quality >= 80, 10).otherwise(0)


def route(difficulty: Column, complexity: Column) -> Column:
    """struct(pipeline, use_rag, use_consensus, use_self_critique, n_attempts, max_rounds)."""
    row = lambda p, rag, cons, crit, n, r: F.struct(F.lit(p).alias("pipeline"), F.lit(rag).alias("use_rag"), F.lit(cons).alias("use_consensus"), F.lit(crit).alias("use_self_critique"), F.lit(n).cast("int").alias("n_attempts"), F.lit(r).cast("int").alias("max_rounds"))
    return (
        F.when(difficulty == "easy", row("simple", False, False, False, None, None))
        .when(difficulty == "hardest", row("self_critique", True, True, True, 3, 2))
        .when(complexity >= 0.7, row("rag_enhanced", True, False, True, None, 1))
        .otherwise(row("rag_enhanced", True, False, False, None, None))
    )


def issue_hints(reason: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", reason, description))
    return F.array_compact(F.array(*(F.when(any_word(text, keys) | (reason == hint), hint) for hint, keys in P.ISSUE_HINTS)))


def format_only_error(context: Column) -> Column:
    """Does every listed error name a formatting matter?"""
    part = F.replace(F.split_part(F.split_part(context, F.lit(" | "), F.lit(1)), F.lit("Warnings:"), F.lit(1)), F.lit("Errors: "), F.lit(""))
    each = F.transform(F.split(part, ";"), F.trim)
    return F.when(F.trim(F.coalesce(part, F.lit(""))) == "", False).otherwise(F.forall(each, lambda e: any_word(e, P.FORMAT_ONLY_ERRORS)))


def figure_text(caption: Column, paper: Column, kind: Column, question: Column) -> Column:
    labelled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" | ", caption, labelled("Paper: ", paper), labelled("Type: ", kind), labelled("Question: ", question))


def figure_number(caption: Column) -> Column:
    return F.regexp_extract(F.lower(caption), r"(?:fig(?:ure)?\.?\s*)(\d+(?:\.\d+)?[a-z]?)", 1)


def reviewer_score(quality: Column, question: Column, answer: Column, scale: float = 1.0) -> Column:
    """Bands of quality (in units of scale), less one each for a very short answer and one that the question gives away; 1 at least."""
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    base = F.when(quality >= 0.9 * scale, 5).when(quality >= 0.7 * scale, 4).when(quality >= 0.5 * scale, 3).otherwise(2)
    short = (F.length(a) < 2).cast("int")
    given = F.lower(q).contains(F.lower(a)).cast("int")
    return F.when((q == "") | (a == ""), 1).otherwise(F.greatest(base - short - given, F.lit(1)))


def escaped(term: str) -> str:
    """A literal as a regular expression, in Java's syntax and RE2's alike."""
    return "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in term)


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    """The first `most` characters, with a mark where there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def caption_figure(line: Column) -> Column:
    """The figure number of a caption line; null where the line has none or only refers to a figure.

    A line refers to it where a lower-case letter, full stop, comma or semicolon stands
    before the word, or more than 30 characters do, unless another colon follows the number
    and the mark after it.
    """
    found = F.regexp_extract(line, r"(?is)^(.*?)fig(?:ure)?\.?\s*\d+(?:\.\d+)?[a-z]?\s*[:.]?\s*(.*)$", 1)
    rest = F.regexp_extract(line, r"(?is)^.*?fig(?:ure)?\.?\s*\d+(?:\.\d+)?[a-z]?\s*[:.]?\s*(.*)$", 1)
    number = F.regexp_extract(line, r"(?i)fig(?:ure)?\.?\s*(\d+(?:\.\d+)?[a-z]?)", 1)
    refers = (F.trim(found).rlike(r"[\p{Ll}.,;]$") | (F.length(found) > 30)) & ~rest.startswith(":")
    return F.when((number != "") & ~refers, number)


def prompt_template(difficulty: Column, figure_type: Column, feedback: Column) -> Column:
    """Name of the prompt for a request."""
    base = F.when(feedback != "", "REGEN_PROMPT").when(difficulty == "hardest", "HARDEST_PROMPT").when(difficulty == "challenging", "CHALLENGING_PROMPT")
    return F.when(figure_type.eqNullSafe(F.lit("general_image")), F.concat(F.lit("SPATIAL_"), F.coalesce(base, F.lit("DRAFT_PROMPT")))).otherwise(F.coalesce(base, F.when(difficulty == "easy", "EASY_PROMPT"), F.lit("DRAFT_PROMPT")))
