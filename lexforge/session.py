"""Session defaults for local runs and tests; on a cluster the submitter's settings stay."""

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local[cores] session; `extra` keys use underscores for dots."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    conf |= {k.replace("_", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName("lexforge").config(map=conf).getOrCreate()
