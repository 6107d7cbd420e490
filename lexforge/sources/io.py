"""Readers and writers of logs, golden datasets, listings and vector collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = "ts string, model string, ok boolean, elapsed_s double, difficulty string, figure_type string, figure_path string, error string"
STRUCTURED_LOG = "ts string, level string, logger string, message string, trace_id string, span string, exc_type string"
GOLDEN = "examples array<struct<id string, figure_type string, difficulty string, task_type string, answer_format string, complexity double, question string, answer string, reasoning string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = TELEMETRY) -> DataFrame:
    """JSON lines by schema; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def log_drafts(drafts: DataFrame, path: str) -> None:
    """Append telemetry lines: errors cut to 100 characters, seconds to one digit."""
    from lexforge.functions.text import half_up

    drafts.withColumns({"error": F.substring("error", 1, 100), "elapsed_s": half_up(F.col("elapsed_s"), 1)}).write.mode("append").json(path)


#: Columns of an attempt that are cut, and to how many characters.
ATTEMPT_WIDTHS = {"prompt": 10_000, "raw_output": 10_000, "critique": 5_000, "reasoning": 2_000, "error": 500}


def attempt_rows(attempts: DataFrame) -> DataFrame:
    """Attempts as they are stored: cut by column, and none without both a figure and a task."""
    cut = {c: F.substring(c, 1, n) for c, n in ATTEMPT_WIDTHS.items() if c in attempts.columns}
    return attempts.filter("figure_id is not null or task_id is not null").withColumns(cut)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.explode("examples").alias("e")).select("e.*")


def read_index(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of all files that a manifest names."""
    named = [r.file for r in spark.read.schema("file string").option("multiLine", True).json(f"{folder}/manifest.json").collect()]
    return spark.read.schema(schema).option("multiLine", True).json([f"{folder}/{n}" for n in named])


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Paths and sizes below a folder in order of the paths, without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length").orderBy("path")


def log_tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines of a text source, in order."""
    return lines.withColumn("at", F.monotonically_increasing_id()).orderBy(F.col("at").desc()).limit(n).orderBy("at").drop("at")


def upsert_vectors(collection: DataFrame, new: DataFrame) -> DataFrame:
    """A collection(id, content, metadata, embedding) with new rows in place of those of equal id."""
    return new.unionByName(collection.join(new.select("id"), "id", "left_anti"))


def delete_vectors(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """A collection without the rows of ids(id); clearing it is limit(0), counting it count()."""
    return collection.join(ids.select("id").distinct(), "id", "left_anti")


def cache_entries(results: DataFrame, at: Column, ttl_s: int = 3600) -> DataFrame:
    """Rows (id, content, metadata, embedding) to be put in a semantic cache, from results(prompt, figure_id, question, answer, answer_format, task_type, embedding)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.substring(F.sha2("prompt", 256), 1, 16)
    named = [F.lit("prompt_hash"), digest, F.lit("cached_at"), F.unix_seconds(at.cast("timestamp")).cast("string"), F.lit("ttl"), F.lit(str(ttl_s))]
    for c in ("figure_id", "question", "answer", "answer_format", "task_type"):
        named += [F.lit(c), text(c)]
    return results.select(digest.alias("id"), F.col("prompt").alias("content"), F.create_map(*named).alias("metadata"), "embedding")


def write_log(entries: DataFrame, path: str) -> None:
    """Append structured log entries as JSON lines; fields without a value are left out."""
    entries.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_evaluation(results: DataFrame, path: str) -> None:
    """Replace a batch evaluation's JSON lines."""
    results.write.mode("overwrite").json(path)


def settings(spark: SparkSession, values: dict) -> DataFrame:
    """(key, value) of nested settings, such as a configuration file read by the driver; keys are dotted, lists are numbered."""

    def walk(prefix: str, value: object) -> list[tuple[str, str | None]]:
        if isinstance(value, dict | list) and value:
            items = value.items() if isinstance(value, dict) else enumerate(value)
            return [row for k, v in items for row in walk(f"{prefix}.{k}" if prefix else str(k), v)]
        return [(prefix, None if value is None else str(value))]

    return spark.createDataFrame([row for k, v in values.items() for row in walk(str(k), v)], "key string, value string")


def by_metadata(collection: DataFrame, equal: dict[str, str]) -> DataFrame:
    for k, v in equal.items():
        collection = collection.filter(F.element_at("metadata", k) == v)
    return collection


def public_fields(df: DataFrame) -> DataFrame:
    """Columns whose name does not start with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))
