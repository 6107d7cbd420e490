"""State transitions as functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T

from .relational import best_per_key, without


def create_tasks(drafts: DataFrame, figures: DataFrame) -> DataFrame:
    """New tasks; an empty title or image comes from the figure."""
    own = figures.select(F.col("id").alias("figure_id"), F.col("caption").alias("_title"), F.col("image_path").alias("_path"))
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(d), F.lit(""))
    return drafts.join(own, "figure_id", "left").withColumns({"title": filled("title", "_title"), "image_path": filled("image_path", "_path"), "status": F.lit("draft")}).drop("_title", "_path")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every changed field, as strings."""
    joined = old.alias("o").join(new.alias("n"), key)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old_value"), F.col(f"n.{c}").cast("string").alias("new_value")) for c in columns)))
    return joined.select(key, each.alias("c")).select(key, "c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str = "task_id") -> DataFrame:
    """What of a child table stays when tasks go."""
    return without(children, deleted, key, "id")


def set_difficulty(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({"difficulty": T.difficulty_of(F.col("qwen_passes"), F.col("gemini_passes")), "total_runs": F.col("qwen_passes") + F.col("gemini_passes")})


def apply_verdicts(tasks: DataFrame, logs: DataFrame) -> DataFrame:
    """Difficulty moved a level down for a latest verdict of too_easy, up for too_hard."""
    last = best_per_key(logs, ["task_id"], F.struct("submitted_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["review_status"]).withColumnRenamed("task_id", "id")
    delta = F.when(F.col("review_status") == "too_easy", -1).when(F.col("review_status") == "too_hard", 1).otherwise(0)
    return tasks.join(last, "id", "left").withColumn("new_difficulty", T.shift_difficulty(F.col("difficulty"), delta))


def golden_suspect(tasks: DataFrame, checks: DataFrame) -> DataFrame:
    """Set by a check that fails without the golden answer being confirmed, cleared by one that matches; else kept."""
    one = checks.groupBy("task_id").agg(F.max(F.col("match").cast("int")).alias("match"), F.max(F.col("golden_correct").cast("int")).alias("confirmed")).withColumnRenamed("task_id", "id")
    flag = F.when(F.col("match") == 1, False).when((F.col("match") == 0) & (F.col("confirmed") == 0), True).otherwise(F.col("golden_suspect"))
    return tasks.join(one, "id", "left").withColumn("golden_suspect", flag).drop("match", "confirmed")


def next_versions(prompts: DataFrame, saved: DataFrame) -> DataFrame:
    """Append saved(name, text) as the successor of each name's last version."""
    top = prompts.groupBy("name").agg(F.max("version").alias("top"))
    return prompts.select("name", "version", "text").unionByName(saved.join(top, "name", "left").select("name", (F.coalesce("top", F.lit(0)) + 1).alias("version"), "text"))


def rollback(prompts: DataFrame, name: str, version: int) -> DataFrame:
    """Append an old version's text as the newest."""
    return next_versions(prompts, prompts.filter((F.col("name") == name) & (F.col("version") == version)).select("name", "text"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones of other keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def report_issues(reports: DataFrame) -> DataFrame:
    return reports.withColumns({"description": F.substring("description", 1, 500), "corrected_answer": F.substring("corrected_answer", 1, 100)})


def clean_library(figures: DataFrame, tasks: DataFrame, least_bytes: int = 5000) -> DataFrame:
    """Rows that stay: large enough, with a path, and of rows of one path those with tasks or else the first."""
    ok = figures.filter((F.col("filesize_bytes") >= least_bytes) & (F.coalesce("image_path", F.lit("")) != ""))
    used = ok.join(tasks.select(F.col("figure_id").alias("id")).distinct(), "id", "left_semi").withColumn("used", F.lit(True))
    marked = ok.join(used.select("id", "used"), "id", "left")
    per = marked.groupBy("image_path").agg(F.min(F.when(F.col("used"), F.col("id"))).alias("any_used"), F.min("id").alias("first"))
    return marked.join(per, "image_path").filter(F.coalesce("used", F.lit(False)) | (F.col("any_used").isNull() & (F.col("id") == F.col("first")))).drop("used", "any_used", "first")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job by its log: done and cancelled are final; a failure queues again while attempts are left."""
    fold = events.groupBy("job_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("last"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("max_attempts").alias("max_attempts"), F.max(F.col("status").isin("cancelled", "done").cast("int")).alias("final"), F.min_by("status", F.when(F.col("status").isin("cancelled", "done"), F.struct("created_at", "id"))).alias("final_status"))
    state = F.when(F.col("final") == 1, F.col("final_status")).when((F.col("last") == "failed") & (F.col("failures") < F.col("max_attempts")), "queued").otherwise(F.col("last"))
    return fold.select("job_id", state.alias("state"), "failures")


def stale_jobs(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Running jobs of workers that are not alive."""
    return without(jobs.filter("status = 'running'"), live, "worker_id", "worker_id")
