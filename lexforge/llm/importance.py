"""Target-distribution importance resampling: which documents look like a target corpus.

1. Words of all documents and of the target are counted by bucket (crc32 modulo BUCKETS);
   a task adds up an array of counts, so BUCKETS rows a task are shuffled.
2. The log ratio of the two smoothed distributions gives each bucket a gain; a document's
   weight is the sum over its words, looked up in that array. A sha256 of the doc_id gives
   Gumbel noise, so the highest weight-plus-noise scores are a draw without replacement.
3. The draw's last key (score from high to low, then doc_id, then the text's hash, then the
   row's place) is found by radix selection: the rows that share the digits found so far
   are counted by their next digit, until one row is left. A round returns at most
   2 ** DIGIT counts.
4. Only the rows up to that key are range-sorted and ranked.

Null, empty and wordless texts have no features, weight 0 and are never drawn. Rows
without a doc_id get no noise: score and rank are null, and they are not counted. Rows of
one doc_id have the same noise; of equal score they go by text hash, and rows equal
throughout take each rank once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.ranks import placed
from lexforge.storage import stored

from ._spark import frugal

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Bits of a radix digit, and texts counted at once.
DIGIT, SLICE = 13, 100
#: ASCII letters lower-cased, other ASCII but digits a space, bytes of other characters kept.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def buckets_of(text: str | None) -> np.ndarray:
    """Bucket of each word of a text, in order."""
    found = (text or "").encode().translate(WORD_BYTES).split()
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % BUCKETS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.column("text").slice(at, SLICE).drop_null().to_pylist()
            total += np.bincount(buckets_of(" ".join(some)), minlength=BUCKETS)  # no word crosses the space between texts
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; BUCKETS numbers, whatever the input."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(_counts), "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of target over raw share of each bucket, with one added to every count."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = ((target + 1.0) * s) / ((raw + 1.0) * t)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def noise(doc_id: int) -> int:
    """1000 times the standard Gumbel number of a doc_id."""
    h = int(hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                found = buckets_of(text.as_py())
                size[i], weight[i] = len(found), gains[found].sum()
            score = [None if d is None else w + noise(d) for d, w in zip(batch.column("doc_id").to_pylist(), weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("code"), pa.array(size), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "code", "n_features", "weight", "score"])

    return run


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, code (of the text), n_features, weight and score of every row of docs(doc_id, text), as a written table."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("code"), text.alias("text"))
    out = rows.mapInArrow(frugal(_scored(gains)), "doc_id long, code long, n_features long, weight long, score long")
    return stored(out.withColumn("at", F.monotonically_increasing_id()), "scored")


def halves(key: list[Column]) -> list[Column]:
    """Each signed 64-bit key as its upper and its lower half, which order as the key does."""
    return [h for c in key for h in (F.shiftright(c, 32), c.bitwiseAND(0xFFFFFFFF))]


def kth(rows: DataFrame, key: list[Column], k: int) -> list[int]:
    """The halves of the k-th least key (k from 1) of rows, by radix selection; shorter where fewer halves decide."""
    parts = halves(key)
    ends = rows.agg(*(f(c) for c in parts for f in (F.min, F.max))).first()
    left, prefix = rows, []
    for i, c in enumerate(parts):
        low, high = ends[2 * i], ends[2 * i + 1]
        width = (high - low).bit_length()
        while width:
            width = max(0, width - DIGIT)
            digit = F.shiftright(c - low, width)
            counts = dict(left.groupBy(digit.alias("digit")).count().collect())
            for d in sorted(counts):
                if k <= counts[d]:
                    break
                k -= counts[d]
            left, low = left.filter(digit == d), low + (d << width)
            if counts[d] == k:  # all of them are drawn: what follows the digits does not matter
                return [*prefix, low + (1 << width) - 1]
        prefix.append(low)
    return prefix


def up_to(key: list[Column], bound: list[int]) -> Column:
    """Whether the key's halves are at most the bound, in lexicographic order."""
    parts, out = halves(key), F.lit(True)
    for c, b in reversed(list(zip(parts, bound, strict=False))):
        out = (c < b) | ((c == b) & out)
    return out


def importance_resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; target(text) is the corpus to look like."""
    rows = scored(docs, target)
    able = (F.col("n_features") >= LEAST_WORDS) & F.col("doc_id").isNotNull()
    pool = rows.filter(able)
    n = PERCENT * pool.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not n:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    key = [-F.col("score"), F.col("doc_id"), F.col("code"), F.col("at")]
    drawn = able & up_to(key, kth(pool, key, n))
    ranked = placed(rows.filter(drawn), key, "rank")
    rest = rows.filter(~F.coalesce(drawn, F.lit(False))).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, "rank").union(rest)
