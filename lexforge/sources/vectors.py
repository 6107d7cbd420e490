"""A stored collection of vectors: inverted lists under a manifest.

A collection is a folder. `centroids` holds the list centres, fitted once on at most
`SAMPLE` rows; every row is then in the list of its nearest centre. Each write is a folder
of rows of its own, appended or tombstones, which counts once the manifest names it, so a
write that fails leaves nothing behind that is read. Of rows of one id the newest write
wins. Manifests are numbered files that are made only if they are not there, so of two
writers at once one fails and loses nothing of the other's. `compact` writes what is alive
as one folder.

A search probes the lists nearest to each query and ranks their rows exactly. How many is
measured on the sample when the centres are fitted: as few as hold RECALL of its rows' true
nearest ones. Probing all lists is the exact way. Rows and queries of a list meet in blocks, which both a large list
and many queries are split into.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import half_up
from lexforge.operators.relational import latest

#: Rows that centres are fitted on, most centres, rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Rows and queries of a block.
BLOCK, QUERIES = 4096, 1024
#: Share of the true nearest rows that a search should find, and of how many rows of the sample.
RECALL, TRIED = 0.95, 512
LISTS = "list int, centre array<float>, probes int"
ROWS = "id long, content string, metadata map<string,string>, embedding array<float>"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; zero stays zero."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of spherical k-means from evenly spread rows; a centre without rows stays where it is."""
    x = unit(sample.astype(np.float32))
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=lists) > 0
        centres[some] = unit(sums[some])
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = 5) -> int:
    """The least number of lists that hold RECALL of the k nearest sample rows of some of them."""
    x = unit(sample.astype(np.float32))
    some = np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[some] @ centres.T), axis=1), axis=1)  # of each list in a row's order of probing
    at = np.take_along_axis(place, (x @ centres.T).argmax(1)[near], 1)
    return int(np.quantile(at, RECALL)) + 1 if at.size else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


class Collection:
    """A collection at a path; rows hold id, content, metadata and embedding, all of one length and none null."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> tuple[int, list[dict]]:
        """(number, writes) of the newest manifest; -1 and none where the collection is new."""
        if not self._files.exists(self._at("manifest")):
            return -1, []
        newest = max(int(s.getPath().getName()) for s in self._files.listStatus(self._at("manifest")))
        text = self.spark.read.text(f"{self.path}/manifest/{newest:08d}", wholetext=True).first()[0]
        return newest, json.loads(text)

    def _commit(self, number: int, writes: list[dict]) -> None:
        """Make manifest `number`; fails if another writer has made it."""
        try:
            out = self._files.create(self._at(f"manifest/{number:08d}"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"{self.path} was written by another at once, as of {number}; write again") from e
        out.write(bytearray(json.dumps(writes).encode()))
        out.close()

    def lists(self) -> tuple[np.ndarray, int]:
        """(centres, how many to probe); at most MOST_LISTS rows."""
        rows = self.spark.read.schema(LISTS).parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r.centre for r in rows], np.float32), rows[0].probes

    def _listed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """rows with the list of each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = (unit(_matrix(b.column("embedding"))) @ centres.T).argmax(1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=[*b.schema.names, "list"])

        return rows.selectExpr("cast(id as long) as id", "content", "metadata", "cast(embedding as array<float>) as embedding").mapInArrow(run, ROWS + ", list int")

    def _write(self, kind: str, rows: DataFrame, replace: bool = False) -> None:
        number, writes = self.manifest()
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        self._commit(number + 1, [*([] if replace else writes), {"kind": kind, "name": name, "number": number + 1}])

    def upsert(self, rows: DataFrame) -> None:
        """Add rows, in place of those of their ids; of one id in rows the one of greatest content."""
        one = rows.groupBy("id").agg(F.max_by(F.struct("content", "metadata", "embedding"), F.struct(F.col("content"), F.to_json("metadata"))).alias("r")).select("id", "r.*")
        if not self._files.exists(self._at("centroids/_SUCCESS")):
            some = one.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
            if some.empty:
                return
            lists = int(min(MOST_LISTS, max(1, len(some) ** 0.5)))
            sample = np.stack(some["embedding"])
            centres = fit(sample, lists)
            fitted = [(i, c.tolist(), probes_for(sample, centres)) for i, c in enumerate(centres)]
            self.spark.createDataFrame(fitted, LISTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        self._write("rows", self._listed(one, self.lists()[0]))

    def delete(self, ids: DataFrame) -> None:
        """Leave ids(id) out from now on."""
        self._write("gone", ids.selectExpr("cast(id as long) as id").distinct())

    def clear(self) -> None:
        number, _ = self.manifest()
        self._commit(number + 1, [])

    def rows(self) -> DataFrame:
        """What is alive: the newest row of each id that no later write takes away."""
        _, writes = self.manifest()
        none = self.spark.createDataFrame([], ROWS + ", list int")
        kept, gone = none.withColumn("number", F.lit(0)), self.spark.createDataFrame([], "id long, number int")
        for w in writes:
            part = self.spark.read.schema(none.schema if w["kind"] == "rows" else "id long").parquet(f"{self.path}/{w['kind']}/{w['name']}").withColumn("number", F.lit(w["number"]))
            kept, gone = (kept.union(part), gone) if w["kind"] == "rows" else (kept, gone.union(part))
        if len(writes) == 1 and writes[0]["kind"] == "rows":
            return kept.drop("number")
        last = kept.select("id", "number").union(gone).groupBy("id").agg(F.max("number").alias("number"))
        return kept.join(last, ["id", "number"]).drop("number")

    def count(self) -> int:
        return self.rows().count()

    def get(self, equal: dict[str, str]) -> DataFrame:
        """Rows whose metadata have these values."""
        out = self.rows()
        for k, v in equal.items():
            out = out.filter(F.try_element_at("metadata", F.lit(k)) == v)
        return out.drop("list")

    def compact(self) -> None:
        """Write what is alive as one folder; readers of older manifests still find theirs."""
        self._write("rows", self.rows(), replace=True)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, equal: dict[str, str] | None = None, same: str | None = None) -> DataFrame:
        """The k nearest rows by cosine of each of queries(query_id, q), its own id left out: (query_id, id, score, rank).

        `probes` lists are searched for each query, as many as the fit found good by default;
        `exact` searches all. `equal` filters by metadata before the ranking; so does `same`
        for each query by itself, to rows whose metadata of that name are the query's column
        of that name, where that is not empty or null. Ties go to the smaller id.
        """
        centres, usual = self.lists()
        probes = len(centres) if exact else min(probes or usual, len(centres))
        rows = self.rows()
        for key, v in (equal or {}).items():
            rows = rows.filter(F.try_element_at("metadata", F.lit(key)) == v)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = np.argsort(-(unit(_matrix(b.column("q"))) @ centres.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, probes), int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

        kind = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("kind")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<float>").alias("q"), kind(F.col(same) if same else F.lit("")))
        asked = asked.mapInArrow(near, "query_id long, q array<float>, kind string, lists array<int>").select("query_id", "q", "kind", F.explode("lists").alias("list"))
        rows = rows.select("id", "embedding", "list", kind(F.try_element_at("metadata", F.lit(same)) if same else F.lit("")))
        # a block is a share of a list's rows with a share of its queries; one row a list, MOST_LISTS at most
        cut = lambda df, most, name: F.broadcast(df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name)))
        shares, takes = cut(rows, BLOCK, "shares"), cut(asked, QUERIES, "takes")
        left = rows.join(shares, "list").join(takes, "list").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).withColumn("take", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)))
        right = asked.join(shares, "list").join(takes, "list").withColumn("take", F.pmod(F.xxhash64("query_id"), "takes").cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        keys = ["list", "share", "take"]

        def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or asked.empty:
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            ids, names = rows["id"].to_numpy(), asked["query_id"].to_numpy()
            x, q = (np.stack(v).astype(np.float64) for v in (rows["embedding"], asked["q"]))
            score = unit(q) @ unit(x).T
            score[names[:, None] == ids[None, :]] = -np.inf
            if same:
                only = asked["kind"].to_numpy()[:, None]
                score[(only != "") & (only != rows["kind"].to_numpy()[None, :])] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            out = pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "id": ids[order].reshape(-1), "score": np.take_along_axis(score, order, 1).reshape(-1)})
            return out[np.isfinite(out["score"])]

        met = left.select(*keys, "id", "embedding", "kind").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "kind").groupBy(*keys)).applyInPandas(best, "query_id long, id long, score double")
        top = latest(met, ["query_id"], [F.col("score").desc(), F.col("id")], k)
        return top.select("query_id", "id", half_up(F.col("score"), 4).alias("score"), "rank")
