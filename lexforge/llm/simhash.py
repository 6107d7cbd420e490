"""SimHash near-duplicate classes by tiled exact comparison of all fingerprints.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have
it. Two fingerprints link at RADIUS differing bits or fewer, exactly: nothing is capped.

1. Distinct fingerprints carry on, each with its least doc_id, so exact copies are one.
2. Cut in five bands, two fingerprints within four bits agree on a whole band. A
   fingerprint so meets those of its five (band, value) groups only. Groups of more than
   GROUP rows are cut again by five bands of the other bits, and what is still larger
   (many texts within a few bits) is cut into tiles by population count: each pair of
   tiles whose counts are within the radius is one group of its own. No task holds more
   than some thousand rows of a group, however large it is.
3. Rows sorted by group and population count are compared in tiles of TILE rows: a pair of
   tiles is one numpy exclusive-or and bit count, and is skipped where their groups do not
   meet or their population counts differ beyond the radius. Of the links only a spanning
   forest leaves the task.
4. Connected components give each fingerprint its class.

Null, empty and wordless texts have fingerprint zero, linked like any other; fewer words
than a shingle are one shingle. Repeated rows repeat their result. Rows without a doc_id
get the least doc_id of their class, null if it has none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.storage import stored

from ._spark import components, frugal

WORDS, SEED, RADIUS = 4, 42, 4
#: Rows of a group beyond which it is cut further, rows of a tile of such a group, and of a tile compared at once.
GROUP, SLAB, TILE = 8192, 2048, 64
#: Rows compared in one go, and pairs of tiles in one numpy call.
WINDOW, BATCH = 40_000, 192
BITS = 64


def text_hashes(text: str | None) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return []
    joined = memoryview(b" ".join(found))
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(len(found) - WORDS + 1, 1)
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[min(WORDS, len(found)) - 1 :].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The 64 bits that over half of the hashes have; zero of no hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [majority(text_hashes(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long, `print`) of every row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(frugal(_fingerprints), "doc_id long, print long")


def _bands(bits: list[int]) -> list[int]:
    """Masks of RADIUS + 1 bands of the given bit places: prints within the radius agree on one of them."""
    edges = [round(i * len(bits) / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [reduce(int.__or__, (1 << b for b in bits[i:j])) for i, j in pairwise(edges)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cut(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """rows(print, band) -> (print, band, key): one row for each mask below its band, key standing for the band's value."""
    keys: Column | None = None
    for band, below in masks.items():
        each = F.array(*(F.struct(F.lit(_signed(m)).alias("band"), F.xxhash64(F.lit(_signed(m)), F.col("print").bitwiseAND(F.lit(_signed(m)))).alias("key")) for m in below))
        keys = F.when(F.col("band") == _signed(band), each) if keys is None else keys.when(F.col("band") == _signed(band), each)
    return rows.select("print", F.explode(keys).alias("at")).select("print", "at.band", "at.key")


def _tiles(big: DataFrame) -> DataFrame:
    """(print, key) of groups beyond GROUP -> (print, key) once for each pair of tiles that the print's tile is in."""
    pop = F.bit_count("print")
    sizes = big.groupBy("key", pop.alias("pop")).agg(F.ceil(F.count("*") / SLAB).cast("int").alias("tiles"))
    table = sizes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pop", "tiles"))).alias("tiles"))  # 65 entries at most
    own = F.struct(F.col("pop").alias("pop"), F.pmod(F.xxhash64("print"), F.col("tiles")[F.col("pop")]).cast("int").alias("tile"))
    near = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("pop")) <= RADIUS)
    others = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda t: F.struct(e["key"].alias("pop"), t.alias("tile")))))
    dealt = big.withColumn("pop", pop).join(table, "key").withColumn("own", own).withColumn("with", F.explode(others))
    return dealt.select("print", F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("key"))


def _groups(prints: DataFrame) -> DataFrame:
    """(print, key): prints within the radius share a key, no key has more than GROUP rows or a pair of tiles."""
    first = _bands(list(range(BITS)))
    below = {m: [m | s for s in _bands([b for b in range(BITS) if not m >> b & 1])] for m in first}
    top = _cut(prints.select("print", F.lit(0).alias("band")), {0: first})
    # at most 5 * 2 ** 13 (band, value) groups exist, whatever the input: 1 MB
    sizes = F.broadcast(top.groupBy("key").count().filter("count > 1"))
    sized = top.join(sizes, "key")
    small = sized.filter(F.col("count") <= GROUP).select("print", "key")
    under = _cut(sized.filter(F.col("count") > GROUP).select("print", "band"), below)
    counted = stored(under.join(under.groupBy("key").count().filter("count > 1"), "key").select("print", "key", "count"), "groups")
    big = counted.filter(F.col("count") > GROUP).select("print", "key")
    return small.union(counted.filter(F.col("count") <= GROUP).select("print", "key")).union(_tiles(big))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each row's least known companion) after further links a-b."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (step := label[label]).tobytes() != label.tobytes():
            label = step


def spanning_links(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within equal keys; rows sorted by key and population count."""
    n, tiles = len(prints), -(-len(prints) // TILE)
    pad = np.minimum(np.arange(tiles * TILE), n - 1)
    x, k, pop = prints[pad].reshape(tiles, TILE), key[pad].reshape(tiles, TILE), np.bitwise_count(prints[pad]).astype(int).reshape(tiles, TILE)
    place = pad.reshape(tiles, TILE)
    label = np.arange(n)
    left, lag = np.arange(tiles), 0
    while len(left):
        for i in (left[at : at + BATCH] for at in range(0, len(left), BATCH)):
            near = np.bitwise_count(x[i][:, :, None] ^ x[i + lag][:, None, :]) <= RADIUS
            t, p, q = np.nonzero(near)
            label = _joined(label, place[i[t], p], place[i[t] + lag, q])
        lag += 1
        left = left[left + lag < tiles]
        # groups meet where the first tile's last row and the other's first row are of one; counts rise within a group
        left = left[k[left, -1] == k[left + lag, 0]]
        alone = k[left, 0] == k[left + lag, -1]
        left = left[~(alone & (pop[left + lag, 0] - pop[left, -1] > RADIUS))]
    some = np.flatnonzero(label != np.arange(n))
    return prints[some], prints[label[some]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; a window ends where a key ends."""

    def found(rows: list[tuple[np.ndarray, np.ndarray]], last: bool) -> Iterator[pa.RecordBatch]:
        key, prints = (np.concatenate(x) for x in zip(*rows, strict=True))
        cut = len(key) if last else int(np.searchsorted(key, key[-1]))
        rows[:] = [(key[cut:], prints[cut:])]
        if cut:
            a, b = spanning_links(key[:cut], prints[:cut].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("key").to_numpy(), batch.column("print").to_numpy()))
        if sum(len(k) for k, _ in held) >= WINDOW:
            yield from found(held, False)
    if held:
        yield from found(held, True)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct prints(print) whose components are those of all links."""
    groups = _groups(prints).repartition("key").sortWithinPartitions("key", F.bit_count("print"))
    return groups.select("key", "print").mapInArrow(frugal(_compared), "a long, b long")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs(doc_id, text)."""
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(stored(links(prints).distinct(), "links"))
    rooted = prints.join(roots, prints.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
