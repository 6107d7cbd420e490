"""Histories, reviews and status changes of authored tasks, and the roll-ups shown beside them.

Every function takes DataFrames and gives DataFrames; what a group collects is one
figure's or one task's own lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as T

from .analytics import n_if
from .relational import best_per_key, latest
from .transitions import apply_verdicts

#: The steps that a prompt for the hardest level is split into.
CHART_STEPS = [
    "Identify all data panels and their labels",
    "For each panel, extract key data values (peaks, intersections, ratios)",
    "Cross-reference values across panels",
    "Formulate a multi-step question requiring at least 2 of the above",
]
OBJECT_STEPS = [
    "Catalog all visible objects and their positions",
    "Identify spatial relationships (left/right, above/below, depth)",
    "Classify objects by attributes (color, size, type)",
    "Formulate a question requiring multi-attribute reasoning",
]


def _given(value: Column, line: Column) -> Column:
    """line where value is a string with characters, else null."""
    return F.when(F.coalesce(value, F.lit("")) != "", line)


# ---- histories ----------------------------------------------------------------------
def issue_line(reason: Column, description: Column, corrected: Column) -> Column:
    """reason=..., with the description in brackets and the corrected answer, where there are any."""
    described = F.coalesce(_given(description, F.concat(F.lit(" ("), description, F.lit(")"))), F.lit(""))
    answer = F.coalesce(_given(corrected, F.concat(F.lit(" | CORRECTED ANSWER: "), corrected)), F.lit(""))
    return F.concat(F.lit("reason="), F.coalesce(reason, F.lit("")), described, answer)


def attempt_line(number: Column) -> Column:
    """An attempt's parts joined by ' | '; parts without a value and unreadable error lists are left out."""
    errors = F.slice(F.from_json("validation_errors", "array<string>"), 1, 3)
    runs = F.col("qwen_passes") + F.col("gemini_passes")
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    text = lambda label, c: _given(F.col(c), F.concat(F.lit(f"{label}="), F.col(c)))
    of = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"), F.lit("/"), runs.cast("string"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Attempt "), number.cast("string"), F.lit(": "), F.col("generation_type")),
        text("difficulty", "difficulty"),
        text("question", "question"),
        text("answer", "answer"),
        F.when(F.col("quality") > 0, F.concat(F.lit("quality="), whole(F.col("quality")))),
        F.when(F.size(errors) > 0, F.concat(F.lit("errors="), F.array_join(errors, "; "))),
        F.when(runs > 0, F.concat(F.lit("model_runs: "), of("Qwen", "qwen_passes"), F.lit(" "), of("Gemini", "gemini_passes"))),
    )


def issue_lines(issues: DataFrame, key: str) -> DataFrame:
    """Each distinct issue line of a key once, under the attempt that reported it first (null: none)."""
    line = issue_line(F.col("reason"), F.col("description"), F.col("corrected_answer"))
    rows = issues.select(key, "id", F.col("generation_attempt_id").alias("attempt_id"), line.alias("line"))
    return rows.groupBy(key, "line").agg(F.min("id").alias("id"), F.min_by("attempt_id", "id").alias("attempt_id"))


def history(attempts: DataFrame, issues: DataFrame, key: str, newest: int = 5) -> DataFrame:
    """(key, n_lines, history): the newest attempts of each key, oldest first, each followed by the issues
    reported on it, and then the issues reported on none of a key's attempts."""
    from pyspark.sql import Window

    last = attempts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc()))).filter(F.col("_r") <= newest)
    shown = F.array_sort(F.collect_list(F.struct("created_at", "id", "generation_type", "difficulty", "question", "answer", "quality", "validation_errors", "qwen_passes", "gemini_passes")))
    listed = last.groupBy(key).agg(shown.alias("rows")).select(key, F.posexplode("rows").alias("at", "row")).select(key, "at", "row.*")
    own = listed.select(key, F.col("id").alias("attempt_id"), F.col("at").cast("long").alias("at"), F.lit(-1).cast("long").alias("sub"), attempt_line(F.col("at") + 1).alias("line"))
    told = issue_lines(issues, key)
    on = told.filter("attempt_id is not null").join(own.select(key, "attempt_id", "at"), [key, "attempt_id"])
    on = on.select(key, "attempt_id", "at", F.col("id").alias("sub"), F.concat(F.lit("  USER FEEDBACK on this attempt: "), "line").alias("line"))
    general = told.filter("attempt_id is null").select(key, "attempt_id", F.lit(1 << 62).alias("at"), F.col("id").alias("sub"), F.concat(F.lit("  USER FEEDBACK: "), "line").alias("line"))
    every = own.unionByName(on).unionByName(general)
    # a key's own lines: `newest` attempts and the distinct issue texts
    lines = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "sub", "line"))).alias("lines"))
    return lines.select(key, F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


#: What the history of a task shows of an event, and of what its details say where they say it.
EVENT_TEXTS = ["generation_type", "difficulty", "model_name", "generated_question", "generated_answer", "generated_answer_format", "reason", "description", "corrected_answer", "old_question", "new_question", "old_answer", "new_answer", "old_difficulty", "new_difficulty", "rhea_notes"]
EVENT_NUMBERS = ["total_tokens", "input_tokens", "output_tokens", "qwen_passes", "gemini_passes"]
EVENT_LISTS = ["errors", "fact_check_errors", "determinism_errors", "changed_fields"]
EVENT_MAPS = ["old_values", "new_values"]


def event_details(events: DataFrame) -> DataFrame:
    """(task_id, id, key, value): a row for each key of an event's JSON details, whatever the key; text as it is, other values as JSON.

    Details that are empty, malformed or no object have no keys.
    """
    parsed = events.select("task_id", "id", F.try_parse_json("details").alias("v"))
    pairs = events.sparkSession.tvf.variant_explode(F.col("v").outer())
    rows = parsed.lateralJoin(pairs.alias("d")).filter(F.col("d.key").isNotNull())
    return rows.select("task_id", "id", F.col("d.key").alias("key"), F.try_variant_get(F.col("d.value"), "$", "string").alias("value"))


def task_history(attempts: DataFrame, events: DataFrame, newest: int = 50) -> DataFrame:
    """The newest attempts and events of every task in one shape, `newest` of each kind.

    What an event's details name is laid over the defaults, as text, number, list or map;
    a value of another type, and null, leaves the default. So do malformed details.
    """
    order = [F.col("created_at").desc(), F.col("id").desc()]
    a = latest(attempts, ["task_id"], order, newest)
    e = latest(events, ["task_id"], order, newest).withColumn("v", F.try_parse_json("details"))
    said = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    none = {k: F.lit("") for k in EVENT_TEXTS} | {k: F.lit(0).cast("long") for k in EVENT_NUMBERS} | {k: F.array().cast("array<string>") for k in EVENT_LISTS} | {k: F.create_map().cast("map<string,string>") for k in EVENT_MAPS} | {"rhea_passed": F.lit(False), "quality": F.lit(0.0)}
    kinds = dict.fromkeys(EVENT_TEXTS, "string") | dict.fromkeys(EVENT_NUMBERS, "long") | dict.fromkeys(EVENT_LISTS, "array<string>") | dict.fromkeys(EVENT_MAPS, "map<string,string>") | {"rhea_passed": "boolean", "quality": "double"}
    own = {"generation_type": "generation_type", "difficulty": "difficulty", "model_name": "model_name", "generated_question": "question", "generated_answer": "answer", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "quality": "quality"}
    errors = F.coalesce(F.from_json("validation_errors", "array<string>", {"mode": "PERMISSIVE"}), none["errors"])
    of_attempt = none | {k: F.coalesce(F.col(c).cast(kinds[k]), none[k]) for k, c in own.items()} | {"errors": errors, "total_tokens": F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0).cast("long"))}
    base = ["task_id", "id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("minute")]
    left = a.select(*base, F.lit("regeneration").alias("event_type"), *(c.alias(k) for k, c in of_attempt.items()))
    right = e.select(*base, F.coalesce(said("event_type", "string"), F.col("event_type")).alias("event_type"), *(F.coalesce(said(k, kinds[k]), none[k]).alias(k) for k in of_attempt))
    return left.unionByName(right)


# ---- roll-ups -----------------------------------------------------------------------
def recent(attempts: DataFrame, n: int = 50) -> DataFrame:
    return attempts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def recent_analytics(attempts: DataFrame, n: int = 50) -> DataFrame:
    """(section, value, n, ok, average) over the newest n attempts: by difficulty, model and figure type, the
    ten most frequent errors, the best configuration, and the first three of low quality.

    By difficulty n counts attempts; by model and type it counts those with a quality.
    """
    rows = recent(attempts, n)
    some = F.col("quality") > 0
    known = lambda c: T.or_unknown(F.col(c))
    average = T.half_up(F.coalesce(F.avg(F.when(some, F.col("quality"))), F.lit(0.0)), 1).alias("average")
    shape = lambda section, df: df.select(F.lit(section).alias("section"), "value", F.col("n").cast("long").alias("n"), F.col("ok").cast("long").alias("ok"), F.col("average").cast("double").alias("average"))
    none = F.lit(None)
    level = rows.groupBy(known("difficulty").alias("value")).agg(F.count("*").alias("n"), n_if(F.col("success")).alias("ok"), average)
    by = lambda c: rows.groupBy(known(c).alias("value")).agg(n_if(some).alias("n"), average).withColumn("ok", none)
    each = rows.select("id", F.explode(F.from_json("validation_errors", "array<string>")).alias("value"))
    errors = each.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("_f")).orderBy(F.col("n").desc(), "_f", "value").limit(10).withColumns({"ok": none, "average": none})
    any_ = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("any"))
    config = rows.filter(some).groupBy(F.concat_ws("/", any_("figure_type"), any_("difficulty"), any_("model_name")).alias("value")).agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    best = config.orderBy(F.col("q").desc(), "value").limit(1).select("value", "n", none.alias("ok"), T.half_up(F.col("q"), 1).alias("average"))
    low = rows.filter(some & (F.col("quality") < 60)).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(3).select(F.col("id").cast("string").alias("value"), none.alias("n"), none.alias("ok"), F.col("quality").alias("average"))
    sections = {"difficulty": level, "model": by("model_name"), "figure_type": by("figure_type"), "error": errors, "best": best, "low": low}
    return reduce(DataFrame.unionByName, (shape(k, df) for k, df in sections.items()))


def review_stats(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: reviewed, passed and failed tasks, and the most frequent issue reason (of equals the first reported)."""
    reviewed = tasks.agg(n_if(F.col("rhea_reviewed")).alias("total"), n_if(F.col("rhea_passed")).alias("passed")).withColumn("failed", F.col("total") - F.col("passed"))
    reasons = issues.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = reasons.agg(F.max_by("reason", F.struct("n", -F.col("first"))).alias("top_reason"), F.max("n").alias("top_count"))
    return reviewed.crossJoin(top).select("total", "passed", "failed", F.coalesce("top_reason", F.lit("")).alias("top_reason"), F.coalesce("top_count", F.lit(0)).alias("top_count"))


def usage_totals(attempts: DataFrame) -> DataFrame:
    """One row: calls, tokens and USD of all models, the cost to four digits and as shown."""
    each = attempts.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(T.estimate_cost(F.col("model_name"), F.col("input_tokens"), F.col("output_tokens"))).alias("usd"))
    return each.select("calls", "input_tokens", "output_tokens", T.half_up(F.col("usd"), 4).alias("cost"), T.format_cost(F.col("usd")).alias("shown"))


def success_rate(attempts: DataFrame, drafts: Column) -> DataFrame:
    """One row: 100 * successes of all kinds / drafts (1 at least); above 100 where checks succeed more often than drafts are made."""
    return attempts.agg(n_if(F.col("success")).alias("ok"), n_if(drafts).alias("drafts")).withColumn("rate", T.half_up(100 * F.col("ok") / F.greatest("drafts", F.lit(1)), 1))


def recommend(groups: DataFrame, key: str, fallback: str) -> DataFrame:
    """One row: the group of best average quality (of equals the least), or the fallback where none has any."""
    best = groups.filter("avg_quality > 0").agg(F.min_by(key, F.struct(-F.col("avg_quality"), F.col(key))).alias("best"))
    return best.select(F.coalesce("best", F.lit(fallback)).alias(key))


def broken_and_orphaned(figures: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """One row: figures whose file is missing, files that no figure names, files, figures."""
    here = files.select(path).distinct().withColumn("on_disk", F.lit(1))
    named = figures.groupBy(path).agg(F.count("*").alias("rows"))
    both = named.join(here, path, "full")
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("on_disk").isNull(), F.col("rows"))), F.lit(0)).alias("broken"),
        n_if(F.col("rows").isNull()).alias("orphans"),
        F.count("on_disk").alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("figures"),
    )


def evaluation_totals(validated: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: tasks, valid ones, tasks whose answers were checked, and those that passed."""
    v = validated.agg(F.count("*").alias("total"), n_if(F.col("is_valid")).alias("valid"))
    c = checks.agg(n_if(F.col("checked")).alias("checked"), n_if(F.col("deterministic")).alias("passed"))
    return v.crossJoin(c)


def fact_check(claims: DataFrame, key: str) -> DataFrame:
    """(key, n_claims, unsupported, verdict) of claims(key, at, claim, verdict): empty claims are left out, and one claim that is not supported fails all."""
    rows = claims.select(key, "at", F.trim(F.coalesce("claim", F.lit(""))).alias("claim"), T.verdict(F.col("verdict")).alias("v")).filter("claim <> ''")
    listed = F.array_sort(F.collect_list(F.when(F.col("v") != "SUPPORTED", F.struct("at", "claim"))))
    out = rows.groupBy(key).agg(F.count("*").alias("n_claims"), F.transform(listed, lambda x: x["claim"]).alias("unsupported"))
    return out.withColumn("verdict", F.when(F.size("unsupported") > 0, "fail").otherwise("pass"))


def worker_health(beats: DataFrame, as_of: Column | None = None, fresh_s: int = 60) -> DataFrame:
    """One row: workers whose last sign of life, beats(worker_id, ts), is younger than fresh_s, all of them, and 'ok' or 'error'; as of the newest beat by default."""
    last = beats.groupBy("worker_id").agg(F.max("ts").alias("ts"))
    if as_of is None:
        last, as_of = last.crossJoin(F.broadcast(beats.agg(F.max("ts").alias("now")))), F.col("now")  # one row
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return last.agg(n_if(age < fresh_s).alias("alive"), F.count("*").alias("total")).withColumn("status", F.when(F.col("alive") > 0, "ok").otherwise("error"))


def type_counts(figures: DataFrame) -> DataFrame:
    """Figures of each type, and how many of them are suitable."""
    return figures.groupBy("figure_type").agg(F.count("*").alias("n"), n_if(F.col("is_suitable")).alias("suitable"))


# ---- prompts and preferences --------------------------------------------------------
def split_prompt(requests: DataFrame) -> DataFrame:
    """requests(id, difficulty, figure_type, prompt) -> (id, step, description): the steps of the hardest level, else the prompt itself as step 0."""
    steps = lambda values: F.array(*map(F.lit, values))
    each = F.when(F.col("difficulty").eqNullSafe("hardest"), F.when(F.col("figure_type").eqNullSafe("chart_graph_text"), steps(CHART_STEPS)).otherwise(steps(OBJECT_STEPS))).otherwise(F.array("prompt"))
    return requests.select("id", F.posexplode(each).alias("step", "description"))


def prompt_block(steps: DataFrame) -> DataFrame:
    """(id, block): a lone step as it is, several as numbered lines."""
    rows = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "description"))).alias("s"))
    numbered = F.array_join(F.transform("s", lambda x: F.concat(F.lit("Step "), (x["step"] + 1).cast("string"), F.lit(": "), x["description"])), "\n")
    return rows.select("id", F.when(F.size("s") > 1, numbered).otherwise(F.element_at("s", 1)["description"]).alias("block"))


def with_preferences(configs: DataFrame, profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """configs(user_id, config map) with a user's set profile columns and `user_` preferences laid over; users without a profile keep theirs."""
    entry = lambda name, c: F.when(c, F.struct(F.lit(name).alias("key"), F.col(name).alias("value")))
    given = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    own = F.array_compact(F.array(entry("preferred_model", given("preferred_model")), entry("preferred_difficulty", given("preferred_difficulty")), entry("prompt_style", given("prompt_style") & (F.col("prompt_style") != "default"))))
    profile = profiles.select("user_id", F.map_from_entries(own).alias("_profile"))
    kept = F.transform_keys("preferences", lambda k, _: F.concat(F.lit("user_"), k))
    rows = configs.join(profile, "user_id", "left").join(preferences.select("user_id", kept.alias("_kept")), "user_id", "left")
    none = F.create_map().cast("map<string,string>")
    over = F.map_concat(F.col("_profile"), F.coalesce("_kept", none))
    base = F.map_filter("config", lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return rows.withColumn("config", F.when(F.col("_profile").isNull(), F.col("config")).otherwise(F.map_concat(base, over))).drop("_profile", "_kept")


# ---- transitions --------------------------------------------------------------------
def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: of rows that repeat it the one that is greatest as JSON, which does not hang on their order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest)).select(*df.columns)


def submit(tasks: DataFrame, attempts: DataFrame, chosen: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Submit chosen(id, platform_task_id): (tasks, attempts, new log rows, new events).

    Every attempt of a submitted task gets the task's review state as it stands.
    """
    picked = one_each(chosen.select("id", "platform_task_id"), "id").withColumn("_on", F.lit(True))
    done = tasks.drop("platform_task_id").join(picked, "id", "left")
    on = F.coalesce("_on", F.lit(False))
    earlier = F.col("submitted_at") if "submitted_at" in tasks.columns else F.lit(None).cast("timestamp")
    new = done.withColumns({"status": F.when(on, "submitted").otherwise(F.col("status")), "submitted_at": F.when(on, at).otherwise(earlier)}).drop("_on")
    stamp = done.filter("_on").select(F.col("id").alias("task_id"), F.col("rhea_passed").alias("_p"), F.substring("rhea_notes", 1, 500).alias("_n"), F.col("qwen_passes").alias("_q"), F.col("gemini_passes").alias("_g"), F.lit(True).alias("_on"))
    marked = attempts.join(stamp, "task_id", "left")
    over = {c: F.when(F.col("_on"), F.col(k)).otherwise(F.col(c) if c in attempts.columns else F.lit(None)) for c, k in (("rhea_passed", "_p"), ("rhea_notes", "_n"), ("qwen_passes", "_q"), ("gemini_passes", "_g"))}
    marked = marked.withColumns(over).drop("_p", "_n", "_q", "_g", "_on")
    logs = stamp.select("task_id", at.alias("submitted_at"), F.lit("").alias("review_status"))
    details = F.to_json(F.struct(F.col("_q").alias("qwen_passes"), F.col("_g").alias("gemini_passes"), (F.col("_q") + F.col("_g")).alias("total_runs")))
    return new, marked, logs, stamp.select("task_id", F.lit("submit").alias("event_type"), details.alias("details"), at.alias("created_at"))


def _newest(logs: DataFrame) -> DataFrame:
    return best_per_key(logs, ["task_id"], F.struct("submitted_at", "id"), ["id"]).select(F.col("id").alias("_newest"))


def mark_status(tasks: DataFrame, logs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marks(task_id, status, notes): (tasks, logs) with the status set, and on each task's newest log as well."""
    one = one_each(marks.select("task_id", "status", "notes"), "task_id")
    new = tasks.join(one.select(F.col("task_id").alias("id"), F.col("status").alias("_s")), "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    on = one.select("task_id", F.col("status").alias("_s"), F.col("notes").alias("_n"))
    touched = logs.join(on, "task_id", "left").join(_newest(logs), F.col("id") == F.col("_newest"), "left")
    hit = F.col("_newest").isNotNull() & F.col("_s").isNotNull()
    return new, touched.withColumns({"review_status": F.when(hit, F.col("_s")).otherwise(F.col("review_status")), "reviewer_notes": F.when(hit, F.col("_n")).otherwise(F.col("reviewer_notes"))}).drop("_s", "_n", "_newest")


def verdict_events(tasks: DataFrame, logs: DataFrame, at: Column) -> DataFrame:
    """An event for each task with a verdict: old and new difficulty as JSON, and a score of 0 for too_easy, else 1."""
    rows = apply_verdicts(tasks, logs).filter(F.col("review_status").isin("too_easy", "too_hard", "approved"))
    details = F.to_json(F.struct(F.col("review_status").alias("verdict"), F.col("difficulty").alias("old_difficulty"), F.col("new_difficulty"), (F.col("difficulty") != F.col("new_difficulty")).alias("difficulty_changed")))
    return rows.select(F.col("id").alias("task_id"), F.lit("realm_verdict").alias("event_type"), details.alias("details"), F.when(F.col("review_status") == "too_easy", 0.0).otherwise(1.0).alias("quality_score"), at.alias("created_at"))


def record_verdicts(logs: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """logs with verdicts(task_id, verdict, notes) on each task's newest row; a task without one gets a row."""
    one = one_each(verdicts.select("task_id", "verdict", "notes"), "task_id").select("task_id", F.col("verdict").alias("status"), F.substring("notes", 1, 2000).alias("notes"))
    none = logs.limit(0).select(F.col("task_id").alias("id"), F.lit("").alias("status"))
    _, touched = mark_status(none, logs, one)
    fresh = one.join(logs.select("task_id").distinct(), "task_id", "left_anti").select("task_id", at.alias("submitted_at"), F.col("status").alias("review_status"), F.col("notes").alias("reviewer_notes"))
    return touched.unionByName(fresh, allowMissingColumns=True)


def restore(tasks: DataFrame, attempts: DataFrame, wanted: DataFrame) -> DataFrame:
    """tasks with question and answer of wanted(task_id, attempt_id), and `restored`.

    An attempt of another task, or one whose question or answer is blank, changes nothing.
    """
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    usable = attempts.select(F.col("id").alias("attempt_id"), "task_id", q.alias("_q"), a.alias("_a")).filter("_q <> '' and _a <> ''")
    picked = one_each(wanted.select("task_id", "attempt_id"), "task_id").join(usable, ["task_id", "attempt_id"]).select(F.col("task_id").alias("id"), "_q", "_a")
    rows = tasks.join(picked, "id", "left")
    return rows.withColumns({"question": F.coalesce("_q", "question"), "answer": F.coalesce("_a", "answer"), "restored": F.col("_q").isNotNull()}).drop("_q", "_a")


def set_status(figures: DataFrame, changes: DataFrame) -> DataFrame:
    """figures with the status of changes(id, status), as in bulk rejection; ids that are not there change nothing."""
    new = one_each(changes.select("id", "status"), "id").select("id", F.col("status").alias("_s"))
    return figures.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def review(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """tasks with reviews(id, passed, notes, override): an override sets its own notes and the verdict, and leaves the review's notes."""
    new = one_each(reviews.select("id", "passed", "notes", "override"), "id").select("id", F.col("passed").alias("_p"), F.col("notes").alias("_n"), F.col("override").alias("_o"))
    on, over = F.col("_p").isNotNull(), F.coalesce("_o", F.lit(False))
    kept = lambda c, kind: F.col(c) if c in tasks.columns else F.lit(None).cast(kind)
    return tasks.join(new, "id", "left").withColumns({
        "rhea_reviewed": F.when(on & ~over, True).otherwise(kept("rhea_reviewed", "boolean")), "rhea_passed": F.when(on, F.col("_p")).otherwise(kept("rhea_passed", "boolean")),
        "rhea_notes": F.when(on & ~over, F.col("_n")).otherwise(kept("rhea_notes", "string")), "rhea_override_notes": F.when(on & over, F.col("_n")).otherwise(kept("rhea_override_notes", "string")),
    }).drop("_p", "_n", "_o")


# ---- verdict sources ----------------------------------------------------------------
#: Functions of a session that give (task_id, source, verdict); callers add their own.
VERDICT_SOURCES: list[Callable[[SparkSession], DataFrame]] = []


def all_verdicts(spark: SparkSession, sources: list[Callable[[SparkSession], DataFrame]] | None = None) -> DataFrame:
    frames = [f(spark).select("task_id", "source", "verdict") for f in (VERDICT_SOURCES if sources is None else sources)]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "task_id long, source string, verdict string")
