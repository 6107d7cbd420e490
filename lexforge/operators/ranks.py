"""Places and runs in a total order without a task that holds all rows.

Rows are dealt by ranges of the order and sorted within each; a row's place is its place
in its range after the rows of the ranges before. Only one count a range leaves the
executors.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.storage import stored

#: monotonically_increasing_id holds the partition above this bit and the row's place in it below.
PART_BIT = 33


def _ranges(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """(row, part, at): a written table of df's rows in ranges of the order, `at` counting up within each."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.xxhash64(*df.columns)]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return stored(ranged.select(F.struct(*df.columns).alias("row"), F.shiftright(at, PART_BIT).cast("int").alias("part"), at.bitwiseAND((1 << PART_BIT) - 1).alias("at")), "ranges")


def _before(held: DataFrame, counted: Column) -> DataFrame:
    """(part, before): the sum of `counted` over the ranges before each; one row a range."""
    counts = {r.part: r.n for r in held.groupBy("part").agg(counted.alias("n")).collect()}
    sums = zip(sorted(counts), accumulate([0, *(counts[p] for p in sorted(counts))]), strict=False)
    return F.broadcast(held.sparkSession.createDataFrame(list(sums), "part int, before long"))


def placed(df: DataFrame, order: list[Column], place: str = "place", parts: int | None = None) -> DataFrame:
    """df with `place` (long): 1, 2, 3 ... in `order`.

    Rows equal in `order` go by a hash of all their columns, and so may be dealt to several
    tasks; rows that are equal throughout take each other's places. `order` should tell
    rows apart, or equal ones are sorted in one task.
    """
    held = _ranges(df, order, parts)
    return held.join(_before(held, F.count("*")), "part").select("row.*", (F.col("before") + F.col("at") + 1).alias(place))


def runs(df: DataFrame, order: list[Column], begins: Callable[[Column, Column], Column], run: str = "run", parts: int | None = None) -> DataFrame:
    """df with `run` (long): the runs of rows in `order`, numbered from 1.

    begins(before, row), of the structs of two rows that follow each other, says whether a
    new run begins; null is no. The last row of each range stands before the next range, so
    a run may go through many.
    """
    held = _ranges(df, order, parts)
    w = Window.partitionBy("part").orderBy("at")  # a range each
    edges = held.groupBy("part").agg(F.max_by("row", "at").alias("last")).select("part", F.lag("last").over(Window.orderBy("part")).alias("edge"))  # one row a range
    before = F.coalesce(F.lag("row").over(w), F.col("edge"))
    seen = held.join(F.broadcast(edges), "part").withColumn("prior", before)
    fresh = (F.col("prior").isNull() | F.coalesce(begins(F.col("prior"), F.col("row")), F.lit(False))).cast("long")
    flagged = stored(seen.select("row", "part", "at", fresh.alias("fresh")), "runs")
    return flagged.join(_before(flagged, F.sum("fresh")), "part").select("row.*", (F.col("before") + F.sum("fresh").over(w)).alias(run))


def tallied(df: DataFrame, order: list[Column], value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with `out` (long): the sum of column `value` over the rows up to and with each, in `order`."""
    held = _ranges(df, order, parts)
    own = F.sum(f"row.{value}")
    w = Window.partitionBy("part").orderBy("at")  # a range each
    return held.join(_before(held, own), "part").select("row.*", (F.col("before") + own.over(w)).cast("long").alias(out))
