"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources.domain import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tokenizer model of op8; any public SentencePiece model without rewrite rules will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import html_extract

    return html_extract(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_classifier

    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_fst import encode

    ids = encode(spread(_table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) as doc_id", "text")), MODEL, decoded="decoded")
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash

    return simhash(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resample

    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .oracles import FILTER_AUDIT, IMPORTANCE, LICENSE_SCAN, LINE_DEDUP

    return {"op1_line_dedup": LINE_DEDUP, "op7_license_scan": LICENSE_SCAN, "op12_importance": IMPORTANCE, "op13_filter_audit": FILTER_AUDIT}
