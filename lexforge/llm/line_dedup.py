"""Line dedup across a corpus by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped when an earlier line of the corpus is equal to it or, both lines being
of at least `NEAR_LEAST` characters, within one edit (a character replaced, put in or
left out). Earlier means by (doc_id, place in the text); a line counts by its first
occurrence, whether or not that one is dropped itself.
Lines without a character other than white space are never dropped.

1. Lines become 128-bit digests, and equal lines one row with their first place.
2. Of two lines within one edit a half is untouched. Lines that share neither half with
   another have no neighbour and go no further.
3. The deletion neighbourhood of the others is emitted by blocks, so that a long line
   costs its length and not its square: each key leaves one of `BLOCKS` blocks out, lines
   that share a key differ in that block only, and the block is what is left of them.
   Blocks of more than `SHORT` characters are cut again. Of a short one all variants
   with a character left out are emitted as hashed keys.
4. Equal keys are pre-aggregated to the earliest line, so a group of n neighbours gives n
   rows and not its pairs. Each line and its earliest partner are verified, their block
   with levenshtein(), and the texts get their lines filtered.

A place in the corpus is one decimal: doc_id, 30 bits of the text's hash, place in the
text; for rows without a doc_id, which come last, 63 bits of the hash stand for it. Two
texts that repeat a doc_id and agree in those bits would be taken for one.

Null and empty texts have no lines and stay as they are. Rows that repeat doc_id and text
are one document and keep the same lines. Extra columns stay; `n_lines` and `n_dropped`
are replaced if there. Any text length; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored

NEAR_LEAST = 20
#: Blocks that a long line or block is cut into, and the length up to which every character is left out in turn.
BLOCKS, SHORT = 16, 32
#: Rows of one key each, of some 30 bytes, that are sent to every executor at most.
BROADCAST_ROWS = 100_000
#: White space at which a line counts as blank, as the words of the other operators have it.
INK = "[^\\x20\\x09-\\x0D]"
#: First place of a document: 2^31 places for each of 2^30 hashes for each doc_id.
BASE = """
cast(case when doc_id is not null then cast(cast(doc_id as bigint) as decimal(20,0)) + 9223372036854775808BD
     else 18446744073709551616BD + cast(shiftrightunsigned(xxhash64({text}), 1) as decimal(20,0)) end as decimal(20,0)) * 2305843009213693952BD
+ cast(xxhash64({text}) & 1073741823 as decimal(10,0)) * 2147483648BD"""


def _few(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _halves(line: Column, size: Column) -> list[Column]:
    """Keys of both halves, cut so that lines of nearly equal length have one in common."""
    out = []
    for drop in (0, 2):
        half = (F.floor(size / 4) * 2 - drop).cast("int")
        ok = (size >= NEAR_LEAST) if drop == 0 else (size >= NEAR_LEAST) & (size % 4 == 0)
        out += [F.when(ok, F.xxhash64(F.lit(0), half, F.substring(line, F.lit(1), half))), F.when(ok, F.xxhash64(F.lit(1), half, F.substring(line, size - half + 1, half)))]
    return out


def _blocks(rest: DataFrame, parts: int) -> DataFrame:
    """rest(key, pos, start, size, s) with s cut down to one block, where other rows share all but the block.

    `size` is that of the shorter line of a pair, by which both are cut; s is as long or
    one longer. Pairs of two longer ones are found by their own size.
    """
    cut = lambda k: F.floor(F.col("size") * k / BLOCKS).cast("int")
    each = rest.repartition(parts, "pos").select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("k")).select("*", cut(F.col("k")).alias("a"), cut(F.col("k") + 1).alias("b"))
    tail = F.col("size") - F.col("b")
    key = F.xxhash64("key", "k", F.substring(F.col("s"), F.lit(1), F.col("a")), F.substring(F.col("s"), F.length("s") - tail + 1, tail))
    left = F.substring(F.col("s"), F.col("a") + 1, F.length("s") - tail - F.col("a"))
    made = stored(each.select(key.alias("key"), "pos", (F.col("start") + F.col("a")).alias("start"), (F.col("b") - F.col("a")).alias("size"), left.alias("s")), "blocks")
    shared = stored(made.groupBy("key").agg(F.count("*").alias("n"), F.min(F.length("s") - F.col("size")).alias("longer")).filter("n > 1 and longer = 0").select("key"), "shared")
    return stored(made.join(_few(shared), "key", "left_semi"), "rest")


def _partners(lines: DataFrame) -> DataFrame:
    """Each of lines(pos, line) and an earlier one, `first`, that its deletion neighbourhood meets, with the block in which they may differ."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.length("line")
    most = lines.agg(F.max(size)).first()[0] or 0
    rest = lines.select("pos", "line", F.explode(F.array(size, size - 1)).alias("size")).select(F.xxhash64("size").alias("key"), "pos", F.lit(0).alias("start"), "size", F.col("line").alias("s"))
    done = [rest.filter(F.col("size") <= SHORT)]
    while most > SHORT:
        rest, most = _blocks(rest.filter(F.col("size") > SHORT), parts), -(-most // BLOCKS)
        done.append(rest.filter(F.col("size") <= SHORT))
    # side 0: a character replaced; 1 and 2: the shorter and the longer of a pair
    every = reduce(DataFrame.union, done).repartition(parts, "pos").select("*", F.length("s").alias("n"))
    spots = every.select("*", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("i")).filter("i >= 0 or n = size")
    variant = F.when(F.col("i") < 0, F.col("s")).otherwise(F.concat(F.substring(F.col("s"), F.lit(1), F.col("i")), F.substring(F.col("s"), F.col("i") + 2, F.col("n"))))
    side = F.when(F.col("n") > F.col("size"), 2).when(F.col("i") < 0, 1).otherwise(0)
    spread = stored(spots.select("*", side.alias("side")).select(F.xxhash64("key", F.when(F.col("side") == 0, F.col("i")).otherwise(-1), variant).alias("key"), "pos", "start", "size", "side"), "spread")
    met = stored(spread.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("side") < 2, F.col("pos"))).alias("lo"), F.min(F.when(F.col("side") == 2, F.col("pos"))).alias("hi")).filter("n > 1").drop("n"), "met")
    return spread.join(_few(met), "key").select("pos", "start", "size", F.when(F.col("side") == 1, F.col("hi")).otherwise(F.col("lo")).alias("first")).filter("first < pos").distinct()


def _within_one() -> Column:
    """Are `line` and `other` within one edit, which lies in the block of `size` characters of the shorter one after `start`?

    Whole long lines are compared for equality only, in time that grows with their length.
    """
    line, other, start = F.col("line"), F.col("other"), F.col("start")
    after = F.least(F.length(line), F.length(other)) - start - F.col("size")
    head = lambda s: F.substring(s, F.lit(1), start)
    tail = lambda s: F.substring(s, F.length(s) - after + 1, after)
    block = lambda s: F.substring(s, start + 1, F.length(s) - after - start)
    return (head(line) == head(other)) & (tail(line) == tail(other)) & F.levenshtein(block(line), block(other), 1).between(0, 1)


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text rewritten without the dropped lines, and n_lines and n_dropped appended."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the caller's columns stand in one struct, so that no name of theirs meets one of ours
    keyed = docs.select(F.expr(BASE.format(text="coalesce(cast(text as string), '')")).cast("decimal(38,0)").alias("base"), F.struct(*names).alias("row"))
    place = (F.col("base") + F.col("place")).cast("decimal(38,0)")
    lines = keyed.select("base", F.posexplode(F.split("row.text", "\n")).alias("place", "line")).filter(F.col("line").rlike(INK)).select(place.alias("pos"), "line")
    size = F.length("line")
    halves = [f"h{k}" for k in range(4)]
    seen = stored(lines.select("pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(17), "line").alias("b"), *(h.alias(n) for h, n in zip(_halves(F.col("line"), size), halves, strict=True))), "lines")

    # equal lines: the first place, and the halves, which are the same for all of them
    distinct = stored(seen.groupBy("a", "b").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), *(F.min(h).alias(h) for h in halves)), "distinct")
    each = distinct.select("pos", F.explode(F.array_compact(F.array(*halves))).alias("key"))
    shared = stored(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    near = stored(each.join(_few(shared), "key", "left_semi").select("pos").distinct(), "near")
    # their texts: by broadcast of the places while those are few, else by a join that moves all lines
    found = stored(lines.join(_few(near), "pos", "left_semi").groupBy("pos").agg(F.min("line").alias("line")), "found")

    other = found.select(F.col("pos").alias("first"), F.col("line").alias("other"))
    verified = _partners(found).join(found, "pos").join(other, "first").filter(_within_one())
    edited = stored(verified.select("pos").distinct(), "edited").withColumn("edited", F.lit(True))

    firsts = distinct.join(edited, "pos", "left").filter("n > 1 or edited").select("a", "b", F.col("pos").alias("first"), "edited")
    masks = seen.join(firsts, ["a", "b"]).filter("edited or pos > first").select("pos", F.expr("cast(pos % 2147483648BD as int)").alias("place"))
    masks = masks.select((F.col("pos") - F.col("place")).cast("decimal(38,0)").alias("base"), "place")
    masks = masks.groupBy("base", F.expr("place div 63").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 63))").alias("mask"))
    # a document's own lines, 63 to a number, are all that is collected in a group
    gone = masks.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("gone"), F.max("word").alias("most"), F.sum(F.bit_count("mask")).alias("n_dropped"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("most").cast("long")), lambda w: F.coalesce(F.try_element_at("gone", w), F.lit(0).cast("long")))
    joined = keyed.join(gone.select("base", "n_dropped", dense.alias("gone")), "base", "left").withColumn("parts", F.split("row.text", "\n"))
    bit = lambda i: F.coalesce(F.get("gone", F.floor(i / 63).cast("int")).bitwiseAND(F.pow(F.lit(2.0), i % 63).cast("long")), F.lit(0))
    kept = F.filter("parts", lambda x, i: bit(i) == 0)
    text = F.when(F.col("n_dropped") > 0, F.concat_ws("\n", kept)).otherwise(F.col("row.text"))
    some = F.length(F.coalesce("row.text", F.lit(""))) > 0
    return joined.select(*(text.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names), F.when(some, F.size("parts")).otherwise(0).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
