"""JSON-line logs as streams: new files are read as they come, malformed lines are kept aside, each line is stored once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import half_up

RESCUED = "rescued"


def log_lines(spark: SparkSession, path: str, schema: str, **options: Any) -> DataFrame:
    """A stream of the fields of schema, and `rescued`: the line as it is, where it is no object of these fields, else null. Blank lines are left out."""
    lines = spark.readStream.options(**options).text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, {RESCUED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED})
    # a JSON value that is no object has no fields either
    fields = lines.select("value", parsed.alias("p"))
    none = F.trim("value").startswith("{")
    return fields.select("p.*", "value").withColumn(RESCUED, F.when(none, F.col(RESCUED)).otherwise(F.col("value"))).drop("value")


def telemetry(rows: DataFrame) -> DataFrame:
    """Draft telemetry as it is stored: errors cut to 100 characters, seconds to one digit."""
    return rows.withColumns({"error": F.substring("error", 1, 100), "elapsed_s": half_up(F.col("elapsed_s"), 1)})


def store_log(lines: DataFrame, path: str) -> Any:
    """A writer of a log stream to path/rows and path/rescued, a folder a micro-batch.

    A batch that is run again writes its own folders again, so every line is there once,
    whenever a driver or executor is lost. Start it with a checkpointLocation.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter(F.col(RESCUED).isNull()).drop(RESCUED).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.filter(F.col(RESCUED).isNotNull()).select(RESCUED).write.mode("overwrite").parquet(f"{path}/rescued/batch={number}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(put)


def stored_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rescued lines) of a log that store_log wrote."""
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows").drop("batch"), spark.read.schema(f"{RESCUED} string, batch long").parquet(f"{path}/rescued").drop("batch")
