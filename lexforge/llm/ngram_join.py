"""Near-duplicate classes by an n-gram Jaccard join, as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct sets of 5-word shingles (texts with the
same set are one row), columns are shingles. Two rows link when
100 * overlap >= 75 * union.

1. Every row is dealt by column block: packed postings (shingle, row) meet in the block's
   task, which counts the rows of each column and drops columns of one row, since they
   add to no overlap.
2. What is left of a row comes back to it. A row of n shingles links only with an overlap
   of ceil(0.75 n) or more, so rows with fewer shared columns go, whatever their size.
3. A row's columns are ordered by (rows of the column, hash), rare ones first. By its
   size bound, a linked pair shares one of the first shared - ceil(0.75 n) + 1 columns of
   either row, so only these are multiplied.
4. Overlaps are accumulated on the rows' shared columns, first in rounds between classes
   (see `_merge_classes`), which join the many copies of one text without their pairs;
   then, among rows that no link has joined yet, for every pair that shares a column and
   whose sizes allow it.

Links are exact up to equal 64-bit hashes of different sets (rows) or 52-bit hashes of
different shingles; two texts of 500 shingles meet a false shared shingle in about one of
10^10 pairs. Rows without a doc_id get the least doc_id of their class, null if it has
none; a repeated row repeats its result; null and empty texts have n_shingles 0 and
only their own doc_id as class. Extra columns are ignored. Texts of fewer than 5 words are one
shingle. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import components, frugal, merged, pack, parts_of, stored, unpack

WORDS, PERCENT = 5, 75
#: Rounds in which classes merge before the remaining pairs are multiplied.
ROUNDS = 2
#: Rows of a column up to which its pairs are tried one by one, and rows of a block beyond that.
COLD, BLOCK = 32, 1000
#: Postings a map task holds before it writes its packed columns.
HOLD = 600_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys: text number over 52 bits of hash, size of each set, hash of each set)."""
    docs = len(offsets) - 1
    w = tx.words(tx.LOWER[data], offsets)
    first, h = tx.grams(w, n)
    doc = w.doc[first]
    few = np.flatnonzero((w.per_doc > 0) & (w.per_doc < n))
    if len(few):  # the whole sequence is the one shingle
        alone = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            more = w.per_doc[few] > j
            at = np.minimum(w.first[few] + j, len(w.hash) - 1)
            alone = np.where(more, alone * np.uint64(0x9E3779B97F4A7C15) + w.hash[at], alone)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, tx.mix(alone + w.per_doc[few].astype(np.uint64))])
    key = np.sort(tx.keyed(doc, h))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(52)).astype(np.int64)
    size = np.bincount(owner, minlength=docs)
    parts = tx.mix(key & np.uint64((1 << 52) - 1))
    upto = np.zeros(len(parts) + 1, np.uint64)
    np.cumsum(parts, out=upto[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    return key, size, tx.mix((upto[edge[1:]] - upto[edge[:-1]]) ^ tx.mix(size.astype(np.uint64) + np.uint64(1)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tx.slices(batch.column("text")):
            _, size, digest = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("code").slice(i, j - i), pa.array(size), pa.array(digest.view(np.int64))], names=["doc_id", "code", "n", "row"])


def _deal(parts: int):
    """Postings of each task's texts, packed by column block; rows with one set are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, seen = 0, set()

        def flush() -> pa.RecordBatch:
            rows = np.concatenate([x[1] for x in held])
            size = np.concatenate([x[2] for x in held])
            h = np.concatenate([x[0] for x in held])
            owner = np.repeat(np.arange(len(rows), dtype=np.uint32), size)
            held.clear()
            seen.clear()
            block = h % np.uint64(parts)
            order = np.lexsort((h, block))
            h, owner, block = h[order], owner[order], block[order]
            edge = np.searchsorted(block, np.arange(parts + 1, dtype=np.uint64))
            named, blobs = [], []
            for p in range(parts):
                a, b = edge[p], edge[p + 1]
                if a == b:
                    continue
                mine, local = np.unique(owner[a:b], return_inverse=True)
                step = np.diff(h[a:b], prepend=np.uint64(0))
                named.append(p)
                blobs.append(pack(step, local.astype(np.uint32), rows[mine], size[mine].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                key, size, digest = shingle_sets(data, offsets)
                fresh = np.zeros(len(size), bool)
                for k, d in enumerate(digest.tolist()):
                    if size[k] and d not in seen:
                        seen.add(d)
                        fresh[k] = True
                keep = np.repeat(fresh, size)
                held.append((key[keep] & np.uint64((1 << 52) - 1), digest[fresh], size[fresh]))
                count += int(keep.sum())
                if count >= HOLD:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    return run


def _shared(parts: int):
    """Column block -> postings of columns with two rows or more, packed by the row's block, with the column's row count."""

    def run(table: pa.Table) -> pa.Table:
        hs, rows, sizes = [], [], []
        for blob in table.column("blob").to_pylist():
            step, local, row, size = unpack(blob, np.uint64, np.uint32, np.uint64, np.uint32)
            hs.append(np.cumsum(step))
            rows.append(row[local])
            sizes.append(size[local])
        h, row, size = np.concatenate(hs), np.concatenate(rows), np.concatenate(sizes)
        order = np.lexsort((row, h))
        h, row, size = h[order], row[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row, size = h[new], row[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.diff(np.append(first, len(h)))
        df = np.repeat(many, many)
        some = df > 1
        h, row, size, df = h[some], row[some], size[some], df[some].astype(np.uint32)
        to = row % np.uint64(parts)
        order = np.lexsort((h, row, to))
        h, row, size, df, to = (x[order] for x in (h, row, size, df, to))
        edge = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
        named, blobs = [], []
        for p in range(parts):
            a, b = edge[p], edge[p + 1]
            if a < b:
                cut = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]])) + a
                named.append(p)
                blobs.append(pack(h[a:b], df[a:b], row[cut], size[cut], np.diff(np.append(cut, b)).astype(np.uint32)))
        return pa.table({"part": pa.array(named, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The overlap that a row of n shingles needs with any partner: ceil(0.75 n)."""
    return -(-PERCENT * n // 100)


def _rows(table: pa.Table) -> pa.Table:
    """Row block -> rows that may link: size, shared columns (rare first), and how many of them are multiplied."""
    hs, dfs, rows, sizes = [], [], [], []
    for blob in table.column("blob").to_pylist():
        h, df, row, size, run = unpack(blob, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
        hs.append(h)
        dfs.append(df)
        rows.append(np.repeat(row, run))
        sizes.append(np.repeat(size, run))
    h, df, row, size = (np.concatenate(x) for x in (hs, dfs, rows, sizes))
    order = np.lexsort((h, df, row))
    h, row, size = h[order], row[order], size[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    have = np.diff(np.append(cut, len(row)))
    need = least_overlap(size[cut])
    ok = np.flatnonzero(have >= need)
    return pa.table({
        "row": pa.array(row[cut[ok]].view(np.int64), pa.int64()), "n": pa.array(size[cut[ok]], pa.int64()), "first": pa.array(have[ok] - need[ok] + 1, pa.int64()),
        "cols": pa.array([h[cut[k] : cut[k] + have[k]].tobytes() for k in ok], pa.binary()),
    })


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiplied columns of each row, one posting a line."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            first = b.column("first").to_numpy()
            cols = [np.frombuffer(c, np.int64)[:k] for c, k in zip(b.column("cols").to_pylist(), first.tolist(), strict=True)]
            again = np.repeat(np.arange(b.num_rows), first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols), pa.int64()), b.column("row").take(pa.array(again)), b.column("n").take(pa.array(again))], names=["col", "row", "n"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both rows' columns -> the pairs that link."""
    for batch in batches:
        na, nb = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
        ok = []
        for k, (x, y) in enumerate(zip(batch.column("cols"), batch.column("cols2"), strict=True)):
            both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]))
            over = int((both[1:] == both[:-1]).sum())
            if 100 * over >= PERCENT * (int(na[k]) + int(nb[k]) - over):
                ok.append(k)
        pick = pa.array(ok, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pick), batch.column("row2").take(pick)], names=["a", "b"])


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(row, row2) whose sets link, as (a, b)."""
    one = pairs.join(rows.select("row", "n", "cols"), "row")
    both = one.join(rows.select(F.col("row").alias("row2"), F.col("n").alias("n2"), F.col("cols").alias("cols2")), "row2")
    return both.select("row", "n", "cols", "row2", "n2", "cols2").mapInArrow(frugal(_overlaps), "a long, b long")


def _rooted(columns: DataFrame, roots: DataFrame | None) -> DataFrame:
    """columns with the class of each row."""
    if roots is None:
        return columns.withColumn("root", F.col("row"))
    return columns.join(roots, columns.row == roots.node, "left").select("col", "row", "n", F.coalesce("root", "row").alias("root"))


def _mixed(at: DataFrame) -> DataFrame:
    """Postings of columns in which two classes meet."""
    mixed = at.groupBy("col").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("col")
    return at.join(mixed, "col", "left_semi")


def _block_products(hot: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between classes that meet in columns of many rows, as spanning links of each block product.

    Rows that such columns connect form a cluster, cut into blocks of about BLOCK rows.
    Every pair of blocks is one task's product, but for pairs within the cluster's
    largest class, whose rows are linked already.
    """
    least = hot.groupBy("col").agg(F.min("row").alias("b"))  # copies share it in most columns, so their many postings are few edges
    clusters = components(hot.join(least, "col").select(F.col("row").alias("a"), "b").distinct())
    owned = stored(hot.select("row", "root").distinct().join(clusters, F.col("row") == clusters.node).select("row", hot.root, clusters.root.alias("cluster")), "owned")
    sizes = owned.groupBy("cluster", "root").agg(F.count("*").alias("k"))
    top = sizes.groupBy("cluster").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("k"))
    cut = top.select("cluster", F.col("top.root").alias("top"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("nt"), F.ceil((F.col("k") - F.col("top.k")) / BLOCK).cast("int").alias("no")).filter("no > 0")
    own = F.when(F.col("root") == F.col("top"), F.pmod(F.xxhash64("row"), "nt")).otherwise(F.col("nt") + F.pmod(F.xxhash64("row"), "no")).cast("int")
    meets = F.sequence(F.when(F.col("root") == F.col("top"), F.col("nt")).otherwise(0), F.col("nt") + F.col("no") - 1)
    dealt = owned.join(cut, "cluster").select("row", "root", "cluster", own.alias("own"), F.explode(meets).alias("with"))
    blocks = dealt.join(rows.select("row", "n", "cols"), "row").withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")}).select("row", "root", "own", "n", "cols", "cluster", "lo", "hi")
    return blocks.groupBy("cluster", "lo", "hi").applyInArrow(_product, "a long, b long")


def _product(table: pa.Table) -> pa.Table:
    """Overlaps of the rows of one pair of blocks, accumulated by column: matrix products for columns of many rows, pair counts for the others."""
    row, root, own, n = (table.column(c).to_numpy() for c in ("row", "root", "own", "n"))
    lo, hi = own == own.min(), own == own.max()
    cols = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("cols").combine_chunks()] if table.num_rows else []
    size = np.array([len(c) for c in cols])
    col, r = np.concatenate(cols), np.repeat(np.arange(len(row)), size)
    order = np.argsort(col, kind="stable")
    col, r = col[order], r[order]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    many = np.diff(np.append(first, len(col)))
    number = np.repeat(np.arange(len(first)), many)
    over = np.zeros((len(row), len(row)), np.float32)
    dense = np.flatnonzero(many > 16)
    place = np.full(len(first), -1)
    place[dense] = np.arange(len(dense))
    for at in range(0, len(dense), 2048):
        here = (place[number] >= at) & (place[number] < at + 2048)
        m = np.zeros((len(row), min(2048, len(dense) - at)), np.float32)
        m[r[here], place[number[here]] - at] = 1
        over += m @ m.T
    for k in range(2, 17):
        at = first[many == k]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(over, (r[at + i], r[at + j]), 1)
                np.add.at(over, (r[at + j], r[at + i]), 1)
    union = n[:, None] + n[None, :] - over
    linked = (100 * over >= PERCENT * union) & (root[:, None] != root[None, :])
    linked &= (lo[:, None] & hi[None, :]) | (hi[:, None] & lo[None, :])
    label = np.arange(len(row))
    while True:  # spanning links: each row to the least row of its class in this product
        least = np.where(linked, label[None, :], len(row)).min(1) if len(row) else label
        step = np.minimum(label, least)
        step = step[step]
        if (step == label).all():
            break
        label = step
    some = label != np.arange(len(row))
    return pa.table({"a": row[some], "b": row[label[some]]})


def _merge_classes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Classes found by rounds in which each class tries one partner.

    In every column each class has its smallest row stand for it and meets the smallest
    row of the column; of the partners so met, a class tries the one met most often. A
    group of n copies so takes about n products in all and not its pairs. The number of
    rounds only decides how much is left for the exact step that follows.
    """
    roots, tried = None, None
    for _ in range(ROUNDS):
        heads = _rooted(columns, roots).groupBy("col", "root").agg(F.min(F.struct("n", "row")).alias("head"))
        tops = heads.groupBy("col").agg(F.min("head").alias("top"), F.count("*").alias("many")).filter("many > 1").select("col", "top")
        met = heads.join(tops, "col").filter(f"head.row <> top.row and 100 * top.n >= {PERCENT} * head.n")
        counted = met.groupBy("root", F.col("head.row").alias("row"), F.col("top.row").alias("row2")).agg(F.count("*").alias("times"))
        if tried is not None:
            counted = counted.join(tried, ["row", "row2"], "left_anti")
        best = counted.groupBy("root").agg(F.max(F.struct("times", "row", "row2")).alias("m"))
        pairs = stored(best.select("m.row", "m.row2"), "pairs")
        found = stored(_linked(pairs, rows), "links")
        tried = pairs if tried is None else tried.union(pairs)
        if roots is not None and found.isEmpty():
            break
        roots = merged(roots, found)
    return roots


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, code (of its text), n (shingles) and class of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    parts = parts_of(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _code(docs).alias("code"), F.col("text").cast("string").alias("text"))
    sets = stored(texts.mapInArrow(frugal(_sets), "doc_id long, code long, n long, row long"), "sets")
    postings = texts.select("text").mapInArrow(frugal(_deal(parts)), "part int, blob binary")
    shared = postings.groupBy("part").applyInArrow(_shared(parts), "part int, blob binary")
    rows = stored(shared.groupBy("part").applyInArrow(_rows, "row long, n long, first long, cols binary"), "rows")
    columns = stored(rows.mapInArrow(frugal(_columns), "col long, row long, n long"), "columns")

    roots = _merge_classes(columns, rows)
    # what is left apart, exactly: columns of few rows by their pairs, the others by blocks of rows
    many = columns.groupBy("col").agg(F.count("*").alias("many"))
    apart = stored(_mixed(_rooted(columns, roots)).join(many, "col"), "apart")
    cold = apart.filter(F.col("many") <= COLD)
    other = cold.select("col", F.col("row").alias("row2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    sized = (F.col("row") < F.col("row2")) & (F.col("root") != F.col("root2")) & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
    found = stored(_linked(cold.join(other, "col").filter(sized).select("row", "row2").distinct(), rows), "links")
    if not found.isEmpty():
        roots = merged(roots, found)
    hot = stored(_mixed(_rooted(apart.filter(F.col("many") > COLD).select("col", "row", "n"), roots)), "hot")
    if not hot.isEmpty():
        roots = merged(roots, stored(_block_products(hot, rows), "links"))

    return sets.join(roots, sets.row == roots.node, "left").select("doc_id", "code", "n", F.coalesce("root", "row").alias("class"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    classed = _classes(docs)
    names = classed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    empty = F.col("n") == 0
    out = classed.join(names, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns: that of least doc_id, and of least text hash among rows of that doc_id.

    Rows without a doc_id stand last. Of rows that repeat doc_id and text the one whose
    other columns are least as JSON stays. Rows without a word are linked with nothing, so
    all of them stay.
    """
    classed = stored(_classes(docs).filter("n > 0"), "classed")
    lead = classed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "code")).alias("lead"))
    copy = ~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("code") == F.col("lead.code")))
    copies = stored(classed.join(lead, "class").filter(copy).select("doc_id", "code").distinct(), "copies")
    twins = stored(classed.groupBy("doc_id", "code").agg(F.count("*").alias("many")).filter("many > 1").select("doc_id", "code"), "twins")

    def named(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (_code(rows) == keys["code"]), how)

    kept = named(docs, copies, "left_anti")
    if twins.isEmpty():
        return kept
    again = named(kept, twins, "left_semi")
    rest = [F.col(c) for c in docs.columns if c != "text"]
    once = again.groupBy(F.col("doc_id").cast("long").alias("id"), _code(again).alias("code")).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*rest))).alias("row"))
    return named(kept, twins, "left_anti").union(once.select("row.*"))


def _code(docs: DataFrame) -> Column:
    """Hash that stands for the text of a row."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
