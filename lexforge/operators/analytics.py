"""Roll-ups over attempts, tasks, events and figures. One shuffle on the grouping key each, after partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T

from .relational import best_per_key, latest

DIFFICULTIES = ["easy", "challenging", "hardest"]
FIGURE_TYPES = ["chart_graph_text", "general_image"]
STRATEGIES = ["counting", "comparison", "single_lookup", "rank", "cross_panel_sum_diff", "spatial", "percentage_change", "other"]


def n_if(condition) -> F.Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def strategy_verdicts(tasks: DataFrame, logs: DataFrame, events: DataFrame) -> DataFrame:
    """Verdict counters of each strategy class, with the first task of the class as its order.

    Logs and events are reduced to one row a task before the join, so no task is looked up twice.
    """
    last = best_per_key(logs, ["task_id"], F.struct("submitted_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["review_status"])
    details = lambda path: F.get_json_object("details", path)
    kind, ok = F.col("event_type"), F.get_json_object("details", "$").isNotNull()
    reported = ok & (kind == "issue_report") & details("$.reason").isin("too_easy", "too_hard", "unclear", "wrong_answer")
    match, fixed = F.coalesce(details("$.match") == "true", F.lit(False)), F.coalesce(details("$.deterministic") == "true", F.lit(False))
    answered, ran = ok & (kind == "check_answer"), ok & (kind == "determinism_check")
    seen = events.groupBy("task_id").agg(
        n_if(reported).alias("issues"), n_if(answered & match).alias("right"), n_if(answered & ~match).alias("wrong"), n_if(ran & fixed).alias("fixed"), n_if(ran & ~fixed).alias("loose"),
    )
    all_ = tasks.withColumn("strategy", T.strategy(F.col("question"))).join(last.withColumnRenamed("task_id", "id"), "id", "left").join(seen.withColumnRenamed("task_id", "id"), "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    status = F.col("review_status")
    return all_.groupBy("strategy").agg(
        F.count("*").alias("n_tasks"), F.min("id").alias("first_task"), n_if(status == "too_easy").alias("realm_too_easy"), n_if(status == "too_hard").alias("realm_too_hard"), n_if(status == "approved").alias("realm_approved"),
        total("issues").alias("issue_reports"), total("fixed").alias("determinism_pass"), total("loose").alias("determinism_fail"), total(F.col("fixed") + F.col("loose")).alias("determinism_checked"),
        total("right").alias("check_answer_pass"), total("wrong").alias("check_answer_fail"), total(F.col("right") + F.col("wrong")).alias("check_answer_checked"),
        n_if(F.col("qwen_passes") > 0).alias("qwen_passes_any"), n_if(F.col("gemini_passes") > 0).alias("gemini_passes_any"), n_if(F.col("difficulty") == "hardest").alias("hardest"),
    )


def newest_successes(attempts: DataFrame, n: int = 500) -> DataFrame:
    return attempts.filter("success").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def model_performance(attempts: DataFrame, n: int = 500) -> DataFrame:
    """Average quality, samples and latency of each model among the newest successes."""
    rows = newest_successes(attempts, n).filter("quality > 0")
    return rows.groupBy(T.or_unknown(F.col("model_name")).alias("model")).agg(
        F.count("*").alias("samples"), T.half_up(F.avg("quality"), 1).alias("avg_quality"), T.half_up(F.coalesce(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))), F.lit(0.0)), 1).alias("avg_latency"),
    )


def error_histogram(attempts: DataFrame, width: int | None = 80, top: int = 10) -> DataFrame:
    """Most frequent entries of the JSON error lists, cut to width before counting if one is given."""
    each = attempts.select("id", F.explode(F.from_json("validation_errors", "array<string>")).alias("error"))
    key = F.substring("error", 1, width) if width else F.col("error")
    return each.groupBy(key.alias("error")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.col("n").desc(), "first_id", "error").limit(top)


def usage_cost(attempts: DataFrame) -> DataFrame:
    """Calls, tokens and USD of each model."""
    return attempts.groupBy("model_name").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).withColumn(
        "cost", T.half_up(T.estimate_cost(F.col("model_name"), F.col("input_tokens"), F.col("output_tokens")), 4)
    )


def latency_profile(attempts: DataFrame, key: str) -> DataFrame:
    """avg, min, max and the upper median (the n div 2-th in order, from 0) of positive times of each key.

    Equal times are counted before the exchange, so a key's window holds its distinct times only.
    """
    counted = attempts.filter("elapsed_ms > 0").groupBy(key, "elapsed_ms").agg(F.count("*").alias("k"))
    w = Window.partitionBy(key)
    ranked = counted.withColumns({"upto": F.sum("k").over(w.orderBy("elapsed_ms")), "n": F.sum("k").over(w)})
    median = F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("elapsed_ms"))).alias("p50_ms")
    return ranked.groupBy(key).agg(T.half_up(F.sum(F.col("elapsed_ms") * F.col("k")) / F.sum("k"), 1).alias("avg_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"), median)


def success_by(attempts: DataFrame, key: str) -> DataFrame:
    return attempts.groupBy(T.or_unknown(F.col(key)).alias("value")).agg(F.count("*").alias("total"), n_if(F.col("success")).alias("ok")).withColumn("rate", T.half_up(100 * F.col("ok") / F.greatest("total", F.lit(1)), 1))


def coverage_matrix(attempts: DataFrame) -> DataFrame:
    """Counts of every strategy x difficulty x figure type, zeros included; values outside the lists count as defaults."""
    spark = attempts.sparkSession
    cells = spark.createDataFrame([(s, d, f) for s in STRATEGIES for d in DIFFICULTIES for f in FIGURE_TYPES], "strategy string, difficulty string, figure_type string")
    known = lambda c, members, default: F.when(F.col(c).isin(members), F.col(c)).otherwise(default)
    counted = attempts.groupBy(T.coverage_strategy(F.col("question")).alias("strategy"), known("difficulty", DIFFICULTIES, "challenging").alias("difficulty"), known("figure_type", FIGURE_TYPES, "chart_graph_text").alias("figure_type")).agg(F.count("*").alias("n"))
    return cells.join(counted, ["strategy", "difficulty", "figure_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def best_groups(attempts: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Samples, average and greatest quality of groups of `least` usable attempts or more."""
    rows = attempts.filter(F.col("success") & (F.col("quality") > 0) & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.count("*").alias("samples"), T.half_up(F.avg("quality"), 1).alias("avg_quality"), F.max("quality").alias("max_quality")).filter(F.col("samples") >= least)


def best_model(attempts: DataFrame, default: str, least: int = 3, allowed: list[str] | None = None) -> DataFrame:
    """One row: the model of best average quality, or the default if there is too little to go by."""
    rows = attempts.filter("success and quality > 0 and model_name <> ''")
    enough = rows.agg((F.count("*") >= least).alias("enough"))
    groups = rows.groupBy("model_name").agg(F.count("*").alias("n"), F.avg("quality").alias("q")).filter(F.col("n") >= least)
    if allowed:
        groups = groups.filter(F.col("model_name").isin(allowed))
    best = groups.agg(F.max_by("model_name", F.struct("q", "n", "model_name")).alias("model_name"))
    return enough.crossJoin(best).select(F.when(F.col("enough"), F.coalesce("model_name", F.lit(default))).otherwise(default).alias("model_name"))


def quality_direction(attempts: DataFrame) -> DataFrame:
    """First and last quality of each task, direction, and band of the last."""
    rows = attempts.filter("quality > 0").groupBy("task_id").agg(F.min_by("quality", F.struct("created_at", "id")).alias("first"), F.max_by("quality", F.struct("created_at", "id")).alias("last"), F.count("*").alias("n"))
    way = F.when(F.col("last") > F.col("first"), "improving").when(F.col("last") < F.col("first"), "declining").otherwise("stable")
    return rows.withColumns({"direction": way, "band": F.when(F.col("last") >= 80, "good").when(F.col("last") >= 50, "fair").otherwise("poor")})


def failure_cap(attempts: DataFrame, edits: DataFrame, run: int = 3) -> DataFrame:
    """Tasks whose newest `run` attempts all failed and that were not edited since."""
    newest = latest(attempts, ["task_id"], [F.col("created_at").desc(), F.col("id").desc()], run)
    runs = newest.groupBy("task_id").agg(F.count("*").alias("n"), F.max(F.col("success").cast("int")).alias("any_ok"), F.max("created_at").alias("newest")).filter((F.col("n") >= run) & (F.col("any_ok") == 0))
    touched = edits.groupBy("task_id").agg(F.max("created_at").alias("edited"))
    return runs.join(touched, "task_id", "left").withColumn("blocked", ~F.coalesce(F.col("edited") > F.col("newest"), F.lit(False))).select("task_id", "newest", "blocked")


def determinism(reads: DataFrame) -> DataFrame:
    """Per task: reads with an answer, mismatches with the golden one, and whether all agree; see `diverging` for the answers."""
    match = T.matches_golden(F.col("model_answer"), F.col("golden"), F.col("answer_format"))
    some = F.trim("model_answer") != ""
    return reads.groupBy("task_id").agg(n_if(some).alias("answered"), n_if(some & ~match).alias("diverging")).withColumns({"checked": F.col("answered") > 0, "deterministic": (F.col("answered") > 0) & (F.col("diverging") == 0)})


def diverging(reads: DataFrame, most: int = 3) -> DataFrame:
    """Per task with mismatches: how many, and the first `most` diverging answers in order of the runs, as the log of a check shows them."""
    match = T.matches_golden(F.col("model_answer"), F.col("golden"), F.col("answer_format"))
    off = reads.filter(F.trim("model_answer") != "").filter(~match).select("task_id", "run", F.trim("model_answer").alias("answer"))
    first = latest(off, ["task_id"], [F.col("run"), F.col("answer")], most).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "answer"))).alias("a"))
    return off.groupBy("task_id").agg(F.count("*").alias("n")).join(first, "task_id").select("task_id", "n", F.transform("a", lambda x: x["answer"]).alias("answers"))


def library_health(figures: DataFrame) -> DataFrame:
    """Counts of one scan: all, small files, suitable share, and a histogram of complexity."""
    c = F.col("complexity_score")
    edges = [0, 0.2, 0.4, 0.6, 0.8, 1.01]
    bins = [n_if((c >= a) & (c < b)).alias(f"bin{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return figures.agg(F.count("*").alias("n"), n_if(F.col("filesize_bytes") < 5000).alias("small"), T.half_up(100 * n_if(F.col("is_suitable")) / F.greatest(F.count("*"), F.lit(1)), 1).alias("suitable_pct"), *bins)


def map_of(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Key/value rows as one map a key; of repeated names the greatest value stays."""
    once = df.groupBy(key, name).agg(F.max(value).alias(value))
    return once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("preferences"))
