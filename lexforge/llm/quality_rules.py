"""Repetition coverage: characters inside duplicated n-grams and lines, by rolling hashes.

A text's words are `[^\\x20\\x09-\\x0D]+`. For each n in `NGRAMS` the share of the text's
word characters that lie in an n-word window seen before in the same text is measured
(overlaps count once), and likewise the share in repeated lines. A text is kept when it
passes the base rule and every share is within its limit.

Nulls and empty texts have no words, so they fail the base rule. Extra columns are
dropped; repeated rows give repeated results; an empty table gives an empty result.
A text is processed whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx

#: n -> largest share of word characters in n-word windows that repeat an earlier one.
NGRAMS = {2: 0.40, 3: 0.35, 5: 0.30, 8: 0.25, 10: 0.25}
LINE_SHARE = 0.30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_share double, " + "".join(f"dup_{n}gram_share double, " for n in NGRAMS) + "kept boolean"

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once; is it a later occurrence."""
    order = np.argsort(key)
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(k)))
    many = np.zeros(len(k), bool)
    many[order] = np.repeat(size > 1, size)
    later = np.ones(len(k), bool)
    later[np.minimum.reduceat(order, new) if len(k) else new] = False
    return many, later


def _covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the windows that start at `first`."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of a slice of texts, one value a text."""
    docs = len(offsets) - 1
    prefix = tx.prefix_hash(data)
    w = tx.words(data, offsets, prefix=prefix)
    n_words = w.per_doc.astype(np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[w.end] - points[w.start]
    of_doc = lambda weight, doc: np.bincount(doc, weights=weight, minlength=docs)
    word_chars = of_doc(chars, w.doc).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    newline = np.zeros(256, bool)
    newline[10] = True
    a, b = tx.bounds(data, offsets, newline)
    at = np.searchsorted(w.start, a)
    held = np.searchsorted(w.start, b) - at
    a, b, at, held = (x[held > 0] for x in (a, b, at, held))
    line_doc = np.searchsorted(offsets, a, side="right") - 1
    _, later = _repeats(tx.keyed(line_doc, tx.span_hash(prefix, a, b)))
    out["n_dup_lines"] = of_doc(later, line_doc).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(chars)])
    whole = np.maximum(word_chars, 1)
    out["dup_line_share"] = of_doc((ends[at + held] - ends[at]) * later, line_doc) / whole

    first, h = tx.grams(w, 3)
    many, _ = _repeats(tx.keyed(w.doc[first], h))
    out["n_repeat_words"] = of_doc(_covered(first[many], 3, len(w.hash)), w.doc).astype(np.int64)
    for n in NGRAMS:
        first, h = tx.grams(w, n)
        _, later = _repeats(tx.keyed(w.doc[first], h))
        out[f"dup_{n}gram_share"] = of_doc(_covered(first[later], n, len(w.hash)) * chars, w.doc) / whole
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    kept = ~out["base_failed"] & (out["dup_line_share"] <= LINE_SHARE)
    for n, most in NGRAMS.items():
        kept &= out[f"dup_{n}gram_share"] <= most
    return out | {"kept": kept}


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    for batch in batches:
        for i, j, data, offsets in tx.slices(batch.column(1)):
            got = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[n]) for n in names)], names=["doc_id", *names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text) with the measures of SCHEMA and the verdict `kept`. No shuffle."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_map, SCHEMA)
