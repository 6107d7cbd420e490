"""Benchmark decontamination by latent semantic retrieval.

1. Words (runs of letters, digits and non-ASCII characters, in lower case) are hashed to
   `FEATURES` features; their document counts over all texts give the weights (IDF).
2. The benchmark is read in blocks of at most `PASSAGES` passages (one longer item is a
   block of its own). An SVD of a block's TF-IDF passages gives its latent directions, as
   many as its passages need, so the rank grows with the benchmark and no item is outside.
3. Every text, whole, is cut into windows of two `BLOCK`-word blocks, each block in two
   windows; windows and benchmark passages are projected, and pairs with a cosine of at
   least `SIMILAR` are candidates. The cosine's norms are those of the whole TF-IDF
   vectors, and a block's basis spans its items, so the cosine is that of the vectors.
   Where a passage weighs less than a window its own norm stands for the window's in the
   cut: an exact copy, of which some window holds half the weight, is always a candidate.
   Runs of words that are a whole item of fewer than `SHORT` words are found by hash.
4. Around its candidate windows a text is compared with the item: the longest common
   subsequence of words, and how many of the item's answer words occur there. The answer
   is the column `answer` if the benchmark has one, else all words of the item by their
   weights, as a paraphrase replaces heavy words too, but another text of the language
   holds light ones only. A share of LEAK of the item in order is contamination, and so is
   one of PARAPHRASE (more for items of fewer than FEW words) with ANSWER of a given
   answer's words or WEIGHT of the item's.

Items are a query set: `TABLES` blocks at a time meet all texts; nothing of the texts is
collected but the counts (FEATURES numbers). Items with fewer than `SHORT` words count only when whole and in order: word
after word anywhere, with other words between only in a window that reaches SIMILAR by its
own norm. Items without words match nothing, nor do null and empty texts. Rows without an id keep a null
id; a repeated row repeats its result; extra columns are ignored, and empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import frugal

FEATURES = 8192
#: Passages of a block, the most directions of its basis; blocks of a pass over the texts.
PASSAGES, TABLES = 256, 8
BLOCK, ITEM_PASSAGE = 16, 48
SIMILAR, LEAK, PARAPHRASE, ANSWER, WEIGHT = 0.3, 0.7, 0.45, 0.8, 0.45
SHORT = 8
#: Another text of the language holds more of a short item by chance, so each word below FEW adds SHORTER to PARAPHRASE; at SHORT words it is LEAK nearly.
FEW, SHORTER = 24, 0.015
SCHEMA = "doc_id long, item_id long, similarity double, common_share double, answer_share double, reason string"
#: A slice is small here because a block of words gets a row of up to PASSAGES numbers.
SLICE = 400_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tx.Words:
    return tx.words(tx.LOWER[data], offsets, tx.LOOSE)


def feature(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(FEATURES)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each feature, and texts, of one task."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for i, j, data, offsets in tx.slices(batch.column(0)):
            w = tokens(data, offsets)
            pair = np.unique(w.doc * FEATURES + feature(w.hash))
            total[:FEATURES] += np.bincount(pair % FEATURES, minlength=FEATURES)
            total[FEATURES] += j - i
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})


def weights(docs: DataFrame) -> np.ndarray:
    """IDF of every feature over all texts; 64 partial sums of FEATURES numbers reach the driver."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(frugal(_counts), "counts binary")
    summed = parts.groupBy(F.pmod(F.xxhash64("counts"), F.lit(64)).alias("g")).applyInArrow(_sum_counts, "counts binary").collect()
    total = sum((np.frombuffer(r.counts, np.int64) for r in summed), np.zeros(FEATURES + 1, np.int64))
    return np.log((total[FEATURES] + 1) / (total[:FEATURES] + 1)) + 0.05


def row_space(passages: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """FEATURES x rank orthonormal directions that span the TF-IDF vectors of passages, given as features."""
    rows = np.zeros((len(passages), FEATURES), np.float32)
    for row, f in zip(rows, passages, strict=True):
        np.add.at(row, f, idf[f])
        row /= np.linalg.norm(row)
    values, turned = np.linalg.eigh((rows @ rows.T).astype(float))
    some = values > 1e-5  # what is left out is below 0.004 of a passage
    return (rows.T @ (turned[:, some] / np.sqrt(values[some]))).astype(np.float32)


def _passages(words: np.ndarray) -> list[np.ndarray]:
    return [feature(words[a : a + ITEM_PASSAGE]) for a in range(0, len(words), ITEM_PASSAGE)]


def _item_passages(text: str) -> list[np.ndarray]:
    return [p for _, _, data, offsets in tx.slices(pa.array([text], pa.string())) for p in _passages(tokens(data, offsets).hash)]


def latent_basis(docs: DataFrame, benchmark: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The directions of a benchmark of one block; the texts count by their weights only."""
    return row_space([p for r in benchmark.filter("text is not null").toLocalIterator() for p in _item_passages(r.text)], idf)


def project(w: tx.Words, idf: np.ndarray, table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of `size` words: latent sums, squared norms, first word, text."""
    rank = np.arange(len(w.hash)) - w.first[w.doc]
    head = np.flatnonzero(rank % size == 0)
    if not len(head):
        return np.zeros((0, table.shape[1]), np.float32), np.zeros(0), head, head
    f = feature(w.hash)
    length = np.diff(np.append(head, len(f)))
    latent = table[f[head]]
    for k in range(1, size):  # one word of every block at a time, so that no row per word is held
        on = np.flatnonzero(length > k)
        if len(on) == len(head):
            latent += table[f[head + k]]
        else:
            latent[on] += table[f[head[on] + k]]
    return latent, np.add.reduceat(idf[f] ** 2, head), head, w.doc[head]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return out


class Items:
    """A block of benchmark items, ready to be compared."""

    def __init__(self, rows: list, idf: np.ndarray, table: np.ndarray):
        col = pa.array([r.text for r in rows], pa.string())
        self.ids, self.words, self.answers, self.queries, self.of, self.own = [], [], [], [], [], []
        for i, j, data, offsets in tx.slices(col):
            w = tokens(data, offsets)
            latent, norm, head, doc = project(w, idf, table, ITEM_PASSAGE)
            self.queries.append(latent / np.sqrt(np.maximum(norm, 1e-9))[:, None])
            self.of.append(doc + i)
            # short items are found by runs, and the short last passage of a long item by its others
            n, rest = np.diff(w.first)[doc], w.first[doc + 1] - head
            self.own.append(np.where((n >= SHORT) & (rest >= np.minimum(n, ITEM_PASSAGE)), np.sqrt(norm), np.inf))
            for k in range(j - i):
                own = w.hash[w.first[k] : w.first[k + 1]]
                self.ids.append(rows[i + k].item_id)
                self.words.append(own.tolist())
                self.answers.append(dict(zip(own.tolist(), idf[feature(own)].tolist(), strict=True)))
        self.asked = [WEIGHT] * len(rows)
        self.queries = np.concatenate(self.queries).astype(np.float32) if rows else np.zeros((0, table.shape[1]), np.float32)
        self.of = np.concatenate(self.of) if rows else np.zeros(0, np.int64)
        self.own = np.concatenate(self.own).astype(np.float32) if rows else np.zeros(0, np.float32)
        if rows and "answer" in rows[0].__fields__:
            for i, j, data, offsets in tx.slices(pa.array([r.answer for r in rows], pa.string())):
                w = tokens(data, offsets)
                for k in range(j - i):
                    own = set(w.hash[w.first[k] : w.first[k + 1]].tolist())
                    if own:
                        self.answers[i + k], self.asked[i + k] = dict.fromkeys(own, 1.0), ANSWER
        self.bits = []
        for own in self.words:
            masks: dict[int, int] = {}
            for k, x in enumerate(own):
                masks[x] = masks.get(x, 0) | 1 << k
            self.bits.append(masks)
        #: Number of words -> hash of the run -> items that are this run.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, own in enumerate(self.words):
            if 0 < len(own) < SHORT:
                (run,) = runs(np.array(own, np.uint64), len(own)).tolist()
                self.short.setdefault(len(own), {}).setdefault(run, []).append(k)

    def common(self, item: int, text: list[int]) -> int:
        """Length of the longest common subsequence, a bit for each word of the item."""
        masks, full = self.bits[item], (1 << len(self.words[item])) - 1
        row = full
        for x in text:
            m = masks.get(x)
            if m:
                u = row & m
                row = (row + u | row - u) & full
        return len(self.words[item]) - row.bit_count()

    def judge(self, item: int, text: list[int]) -> tuple[float, float, str | None]:
        """(share of the item in order, share of its answer words or weight, verdict)."""
        n = len(self.words[item])
        share = self.common(item, text) / n
        answer = self.answers[item]
        found = sum(answer[x] for x in answer.keys() & set(text)) / sum(answer.values())
        if n < SHORT:
            return share, found, "leak" if share == 1 else None
        if share >= LEAK:
            return share, found, "leak"
        need = PARAPHRASE + SHORTER * max(0, FEW - n)
        return share, found, "paraphrase" if share >= need and found >= self.asked[item] else None


def candidates(w: tx.Words, idf: np.ndarray, table: np.ndarray, queries: np.ndarray, own: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the window, its end, query, cosine) of the pairs at or above SIMILAR, by the lesser of the window's norm and the query's `own`."""
    latent, norm, head, doc = project(w, idf, table, BLOCK)
    if not len(head):
        return head, head, head, np.zeros(0)
    two = np.zeros(len(head), bool)
    two[:-1] = doc[1:] == doc[:-1]
    wide, size = latent.copy(), norm.copy()
    wide[:-1] += latent[1:] * two[:-1, None]
    size[:-1] += norm[1:] * two[:-1]
    lone = np.ones(len(head), bool)  # a text's last block stands alone only if it is the first
    lone[1:] = two[1:] | (doc[1:] != doc[:-1])
    pick = np.flatnonzero(lone)
    norm = np.sqrt(np.maximum(size[pick], 1e-9))[:, None].astype(np.float32)
    cosine = (wide[pick] / norm) @ queries.T
    r, q = np.nonzero(cosine >= SIMILAR * np.minimum(1, own / norm))
    a = head[pick[r]]
    return a, np.minimum(a + 2 * BLOCK, w.first[doc[pick[r]] + 1]), q, cosine[r, q]


def matches(w: tx.Words, idf: np.ndarray, table: np.ndarray, items: Items) -> list[tuple]:
    """(text, item number, cosine, share in order, share of the answer, verdict) of each text of a slice and item that it holds."""
    a, e, q, cosine = candidates(w, idf, table, items.queries, items.own)
    item = items.of[q]
    order = np.lexsort((a, item))
    best: dict[tuple[int, int], tuple] = {}
    k = 0
    while k < len(order):  # windows of one item that meet, with the item's length around them, are one stretch
        x = order[k]
        doc, it = int(w.doc[a[x]]), int(item[x])
        around = len(items.words[it])
        start, end, top = int(a[x]), int(e[x]), float(cosine[x])
        while k + 1 < len(order) and item[order[k + 1]] == it and w.doc[a[order[k + 1]]] == doc and a[order[k + 1]] <= end + around:
            k += 1
            end, top = max(end, int(e[order[k]])), max(top, float(cosine[order[k]]))
        k += 1
        lo, hi = max(start - around, int(w.first[doc])), min(end + around, int(w.first[doc + 1]))
        share, found, verdict = items.judge(it, w.hash[lo:hi].tolist())
        if verdict and ((doc, it) not in best or (share, found) > best[doc, it][1:3]):
            best[doc, it] = (top, share, found, verdict)
    for size, known in items.short.items():
        run = runs(w.hash, size)
        at = np.flatnonzero(np.isin(run, np.array(list(known), np.uint64)))
        for x in at[w.doc[at] == w.doc[at + size - 1]].tolist():
            for it in known[int(run[x])]:
                text = w.hash[x : x + size].tolist()
                if text == items.words[it] and (int(w.doc[x]), it) not in best:
                    best[int(w.doc[x]), it] = (1.0, *items.judge(it, text))
    return [(d, t, *x) for (d, t), x in best.items()]


def _search(idf: np.ndarray, blocks: tuple):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in tx.slices(batch.column(1), most=SLICE):
                w = tokens(data, offsets)
                got = [(batch.column(0)[i + d].as_py(), items.ids[t], *x) for table, items in blocks for d, t, *x in matches(w, idf, table, items)]
                cols = list(zip(*got, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def item_blocks(rows: Iterable, idf: np.ndarray) -> Iterator[tuple[np.ndarray, Items]]:
    """Latent table and items of blocks of at most PASSAGES passages."""

    def block() -> tuple[np.ndarray, Items]:
        table = (row_space(passages, idf) * idf[:, None]).astype(np.float32)
        return table, Items(held, idf, table)

    held, passages = [], []
    for row in rows:
        own = _item_passages(row.text)
        if held and len(passages) + len(own) > PASSAGES:
            yield block()
            held, passages = [], []
        if own:
            held.append(row)
            passages += own
    if held:
        yield block()


def _fitted(docs: DataFrame, benchmark: DataFrame) -> tuple[np.ndarray, Iterator[tuple]]:
    """Weights, and the benchmark's blocks, TABLES at a time."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    wanted = ["cast(item_id as long) as item_id", "cast(text as string) as text"] + (["cast(answer as string) as answer"] if "answer" in benchmark.columns else [])
    items = benchmark.selectExpr(*wanted).filter("text is not null")
    idf = weights(texts)
    return idf, batched(item_blocks(items.orderBy("item_id", "text").toLocalIterator(), idf), TABLES)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text of docs(doc_id, text) and item of benchmark(item_id, text[, answer]) that it holds; see SCHEMA."""
    idf, passes = _fitted(docs, benchmark)
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for blocks in passes:
        out = out.union(texts.mapInArrow(frugal(_search(idf, blocks)), SCHEMA))
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item. No shuffle."""
    idf, passes = _fitted(docs, benchmark)

    def keep(blocks: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, offsets in tx.slices(batch.column("text"), most=SLICE):
                    w = tokens(data, offsets)
                    clean[[i + m[0] for table, items in blocks for m in matches(w, idf, table, items)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for blocks in passes:
        docs = docs.mapInArrow(frugal(keep(blocks)), docs.schema)
    return docs
