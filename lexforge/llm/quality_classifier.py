"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage is encoded
(shape statistics and hashed word counts through a learned tanh layer), a gated
attention tanh(Vh) * sigmoid(Uh) weighs the passages of a document against each other,
and a logistic unit scores the weighted passage representation. Only documents carry
labels; encoder, attention and output are fitted together on them.

Training reads a bounded sample, at most `MAX_TRAIN` labelled documents, the first by a
hash of doc_id, with at most `TRAIN_PASSAGES` passages of each, and never one with
crc32(doc_id) mod 5 = 0 (the held-out fold). Scoring is one pass without a shuffle over
whole texts. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts are one passage without words and get that passage's score. Rows
with a null doc_id are scored and not held out. A document labelled more than once
counts once, as 1 if any label says so; null labels are ignored. Without usable labels
every score is 0.5, and with labels of one class only it is that class's smoothed share.
Extra columns are ignored, repeated rows give repeated results, and an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import frugal

PASSAGE_WORDS = 64
HASHED = 24
#: Labelled texts that are learnt from, and passages of each, evenly spread over the whole of it; scores read all passages.
MAX_TRAIN, TRAIN_PASSAGES = 4000, 100
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE = 40, 64, 0.01

CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "high": [*range(128, 256)],
    "symbol": [ord(c) for c in "#*$%&|<>@^~=+_\\/{}[]"], "loud": [ord("!"), ord("?")], "stop": [ord("."), ord(","), ord(";"), ord(":")], "bar": [ord("|")],
}
WIDTH = len(CLASSES) + 5 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of a slice of texts, and the text of each passage; every text has one at least."""
    docs = len(offsets) - 1
    w = tx.words(data, offsets)
    rank = np.arange(len(w.start)) - w.first[w.doc]
    head = np.flatnonzero(rank % PASSAGE_WORDS == 0)
    tail = np.append(head[1:], len(rank)).astype(np.int64)
    n = len(head)
    size = np.maximum(tail - head, 1)
    a, b = w.start[head], w.end[tail - 1] if n else w.end[:0]
    x = np.zeros((n, WIDTH))
    for k, codes in enumerate(CLASSES.values()):
        of = np.zeros(256, np.int64)
        of[codes] = 1
        upto = np.concatenate([[0], np.cumsum(of[data])])
        x[:, k] = (upto[b] - upto[a]) / np.maximum(b - a, 1)
    k = len(CLASSES)
    owner = np.repeat(np.arange(n), tail - head)
    lengths = np.bincount(owner, weights=w.end - w.start, minlength=n)
    same = np.zeros(len(owner))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    x[:, k] = np.log1p(tail - head) / 4
    x[:, k + 1] = lengths / size / 10
    x[:, k + 2] = np.bincount(owner, weights=same, minlength=n) / size
    x[:, k + 3] = distinct / size
    x[:, k + 4] = size == 1
    slot = owner * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64)
    x[:, k + 5 :] = np.bincount(slot, minlength=n * HASHED).reshape(n, HASHED) / size[:, None]
    doc = w.doc[head]
    bare = np.flatnonzero(w.per_doc == 0)
    order = np.argsort(np.concatenate([doc, bare]), kind="stable")
    return np.concatenate([x, np.zeros((len(bare), WIDTH))])[order].astype(np.float32), np.concatenate([doc, bare])[order]


def forward(m: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """Activations for passages x sorted by their document number, which runs without gaps."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    bag = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    h = np.tanh((x - m["mean"]) / m["scale"] @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"first": first, "bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on the mean log loss of the documents; gradients by hand."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    m = {"mean": every.mean(0), "scale": every.std(0) + 1e-3}
    m |= {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) for k, shape in (("W", (WIDTH, HIDDEN)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("w", (GATE,)), ("c", (HIDDEN,)))}
    m |= {"b": np.zeros(HIDDEN), "d": np.zeros(1)}
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    mom, var, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
            f = forward(m, x, np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick]))
            h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
            err = (f["p"] - labels[pick]) / len(pick)
            dz = err[:, None] * m["c"]
            up = (h * dz[bag]).sum(1)
            de = a * (up - np.add.reduceat(a * up, f["first"])[bag])
            dg = de[:, None] * m["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
            grad = {"c": f["z"].T @ err, "d": np.array([err.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": ((x - m["mean"]) / m["scale"]).T @ dh, "b": dh.sum(0)}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in learned:
                g = grad[k] + 1e-4 * m[k]
                mom[k] = 0.9 * mom[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                m[k] = m[k] - rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tx.slices(batch.column(2)):
            x, doc = passages(data, offsets)
            edge = np.searchsorted(doc, np.arange(j - i + 1))
            spread = [np.unique(np.linspace(edge[k], edge[k + 1] - 1, min(edge[k + 1] - edge[k], TRAIN_PASSAGES)).astype(np.int64)) for k in range(j - i)]
            packed = [x[rows].tobytes() for rows in spread]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(packed, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit on the bounded sample of docs(doc_id, text) with labels(doc_id, quality) outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # `chosen` has max_train rows at most; a doc_id that repeats counts once, by its first text
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(frugal(_bags), "doc_id long, label int, x binary").collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.x))):
        first.setdefault(r.doc_id, r)
    y = np.array([r.label for r in first.values()], float)
    if len(set(y)) < 2:
        return {"constant": np.array([(y.sum() + 0.5) / (len(y) + 1)])}
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in first.values()], y, seed)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with a column score in [0, 1] appended; docs must have a column text, and none named score is kept."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    own = docs.drop("score")
    names = own.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tx.slices(batch.column(at)):
                if "constant" in model:
                    p = np.full(j - i, model["constant"][0])
                else:
                    p = forward(model, *passages(data, offsets))["p"]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(p)], names=[*names, "score"])

    return own.mapInArrow(frugal(run), StructType([*own.schema.fields, StructField("score", DoubleType())]))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
