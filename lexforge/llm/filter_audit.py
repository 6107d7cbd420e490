"""What each filter of a chain removes, for every order of the chain.

1. Texts are range-sorted by (fingerprint, digest, text, doc_id), so copies stand
   together whatever their number, and one text that a third of all rows hold is dealt to
   as many tasks as it fills.
2. Each task compares a row's whole text with its predecessor's and marks what a smaller
   doc_id holds (E); the other filters are marked from the text in the same pass. A run
   of copies that goes on from the range before is settled afterwards: one boundary row a
   range tells its first and last digest and where its last run begins.
3. Masks of failed filters are counted by part, 32 counters a part at most. All orders are
   read off the counters: an order's first filter that a mask holds removes its documents.

Null texts are empty, null parts the empty string. Rows without a doc_id are no copies and
make none; equal rows of one doc_id are no copies of each other. A doc_id that labels
repeats counts once, with the greater of its marks; one without a doc_id marks none. An empty table has no parts. Other
columns of docs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.storage import stored

from ._spark import frugal

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SCHEMA = "task int, doc_id long, part string, mask int, open boolean, first string, last string, tail long, whole boolean"


def own_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII spaces only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    return few | same << 1 | (100 * capitals > MOST_CAPITALS * len(text)) << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range -> a row each, and at the end one of the range's boundaries."""
    text = first = last = tail = task = None
    runs = 0
    schema = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("open", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("tail", pa.int64()), ("whole", pa.bool_())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        texts, ids = b.column("text"), b.column("doc_id").to_pylist()
        new = np.ones(n, bool)
        new[0] = texts[0].as_py() != text
        if n > 1:
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        run = runs + np.cumsum(new)
        masks = []
        for fresh, d, t in zip(new.tolist(), ids, texts, strict=True):
            tail = d if fresh else tail
            masks.append(own_mask(t.as_py()) | (COPY if d is not None and tail is not None and d > tail else 0))
        first = b.column("digest")[0].as_py() if first is None else first
        text, last, task, runs = texts[n - 1].as_py(), b.column("digest")[n - 1].as_py(), b.column("task")[0].as_py(), int(run[-1])
        none = [pa.nulls(n, f.type) for f in list(schema)[5:]]
        yield pa.RecordBatch.from_arrays([b.column("task"), b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(run == 1), *none], schema=schema)
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([task, None, None, None, None, first, last, tail, runs == 1], schema, strict=True)], schema=schema)


def _starts(edges: DataFrame) -> DataFrame:
    """(task, start): the doc_id at which the run that goes on into a range begins; one row a range, so one small window."""
    w = Window.orderBy("task")
    goes_on = F.coalesce(F.col("first") == F.lag("last").over(w), F.lit(False))
    held = edges.withColumn("goes_on", goes_on)
    begins = F.when(~(F.col("goes_on") & F.col("whole")), F.struct("tail"))  # null where the last run itself came from before
    before = F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("start", F.when(F.col("goes_on"), before["tail"])).select("task", "start")


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and mask of failed filters (bit 0 is A) of every row of docs(doc_id, text, part)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("print"), F.sha2(text, 256).alias("digest"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    order = [F.col("print"), F.col("digest"), F.asc_nulls_last("doc_id")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order[:2], F.col("text"), order[2]).withColumn("task", F.spark_partition_id())
    marked = stored(ranged.select("task", "doc_id", "part", "digest", "text").mapInArrow(frugal(_audited), SCHEMA), "marked")
    starts = _starts(marked.filter("whole is not null").select("task", "first", "last", "tail", "whole"))
    # one row a range
    joined = marked.filter("whole is null").join(F.broadcast(starts), "task")
    copy = F.col("open") & F.coalesce(F.col("doc_id") > F.col("start"), F.lit(False))
    return joined.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones of each (part, mask): additive, so parts of a corpus can be audited apart and summed."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    joined = failed.join(marks, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("bad"))


def every_order(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters."""
    fails = lambda letter: F.col("mask").bitwiseAND(F.element_at(F.create_map(*(x for i, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << i)))), letter)) != 0
    ordered = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    letters = F.split("filter_order", "")
    at = F.array_position(F.transform(letters, fails), True)
    stepped = ordered.withColumn("gone", F.when(F.col("mask") == 0, len(FILTERS) + 1).otherwise(at)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    failed = fails(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    removed = F.col("gone") == F.col("step")
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    # each failed filter comes first of a mask's in an equal share of the orders
    share = F.expr(f"n * {len(ORDERS)} div bit_count(mask)")
    sums: dict[str, Column] = {
        "kept": total(F.col("gone") > F.col("step"), "n"), "removed": total(removed, "n"), "redundant": total(failed & (F.col("gone") < F.col("step")), "n"), "unique_fails": total(failed & (F.bit_count("mask") == 1), "n"),
        "good_lost": total(removed, "good"), "toxic_lost": total(removed, "bad"), "shapley": F.sum(F.when(failed, share).otherwise(0)).cast("long"),
    }
    return stepped.groupBy("part", "filter_order", "step").agg(*(c.alias(k) for k, c in sums.items()))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return every_order(stored(counters(failures(docs, part), labels), "counters"))
