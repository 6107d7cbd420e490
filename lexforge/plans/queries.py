"""The library's registered queries over the driver's tables, each with independent DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import guards as G
from lexforge.functions import patterns as P
from lexforge.functions import rules as R
from lexforge.functions import text as T
from lexforge.functions.parse import parse_draft, parse_response
from lexforge.operators import analytics as A
from lexforge.operators import authoring as Au
from lexforge.operators import figures as Fig
from lexforge.operators import relational as Rel
from lexforge.operators import search as S
from lexforge.operators import transitions as Tr
from lexforge.sources import io as IO
from lexforge.sources import vectors as Vec
from lexforge.sources.domain import spread, table, view, view_sql
from lexforge.storage import run_folder
from lexforge.streaming import logs as Lo
from lexforge.streaming import queue as Qu
from lexforge.streaming import state as St

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function as a query, with DuckDB SQL over the named derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{v} as ({view_sql(v, 'duckdb')})" for v in views.split())
            body = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql.strip())
            start = next((w for w in ("with recursive ", "with ") if body.startswith(w)), "")
            ORACLES[f.__name__] = body if not head else f"{start or 'with '}{head}{', ' + body[len(start) :] if start else ' ' + body}"
        return f

    return add


def half(x: str, n: int) -> str:
    return f"floor(({x}) * {10.0**n} + 0.5) / {10.0**n}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, {quoted('|'.join(f'(?:{p})' for p in patterns))})"


def has_word(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def within(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(map(quoted, values))})"


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, "tasks")).withColumn("qwen_passes", F.col("qwen_raw"))


STRATEGY_SQL = "case when trim(question) = '' then 'other' " + " ".join(f"when regexp_matches(lower(trim(question)), {quoted(p)}) then '{n}'" for n, p in P.STRATEGIES) + " else 'other' end"
LATEST_SQL = "select task_id, review_status from submission_logs qualify row_number() over (partition by task_id order by submitted_at desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1"


# ---- relational reads -------------------------------------------------------------
@query("select id, figure_type, complexity_score from figures where complexity_score >= 0.4 and figure_type = 'chart_graph_text' and is_suitable", "figures")
def figures_filtered(spark, sf_dir):
    return Rel.filtered(view(spark, sf_dir, "figures"), {"figure_type": "chart_graph_text", "status": ""}, {"complexity_score": 0.4}, ["is_suitable"]).select("id", "figure_type", "complexity_score")


@query("select id, question, status from tasks where status = 'draft' and (question ilike '%pan_l%' or answer ilike '%pan_l%' or caption ilike '%pan_l%')", "tasks")
def task_search(spark, sf_dir):
    return Rel.text_search(view(spark, sf_dir, "tasks"), "pan_l", ["question", "answer", "caption"], {"status": "draft"}).select("id", "question", "status")


@query("select id, price, 3 as page, cast(ceil((select count(*) from tasks) / 50.0) as bigint) as pages, (select count(*) from tasks) as total from tasks order by price desc, id desc limit 50 offset 100", "tasks")
def tasks_page(spark, sf_dir):
    df = view(spark, sf_dir, "tasks").select("id", "price")
    return Rel.page(df, 3, 50, Rel.ordered(df, "price", "desc", ["price", "id"])).select("id", "price", F.col("page").cast("int").alias("page"), F.col("pages").cast("long").alias("pages"), F.col("total").cast("long").alias("total"))


@query("select o_orderkey as id, o_totalprice as price from orders where o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return Rel.filtered(table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as price"), {"id": 7})


@query(LATEST_SQL, "submission_logs")
def latest_verdict(spark, sf_dir):
    order = [F.col(c).desc() for c in ("submitted_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return Rel.latest(view(spark, sf_dir, "submission_logs"), ["task_id"], order).select("task_id", "review_status")


@query("select paper_id, id, rank from (select paper_id, id, row_number() over (partition by paper_id order by complexity_score desc, id) as rank from figures) where rank <= 3", "figures")
def top_figures_per_paper(spark, sf_dir):
    return Rel.latest(view(spark, sf_dir, "figures"), ["paper_id"], [F.col("complexity_score").desc(), F.col("id")], 3).select("paper_id", "id", F.col("rank").cast("long").alias("rank"))


@query("select task_id, id, rank from (select task_id, id, row_number() over (partition by task_id order by created_at desc, id desc) as rank from attempts) where rank <= 5", "attempts")
def last_attempts(spark, sf_dir):
    return Rel.latest(view(spark, sf_dir, "attempts"), ["task_id"], [F.col("created_at").desc(), F.col("id").desc()], 5).select("task_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"select id, {half('complexity_score * case when is_dense then 1.3 else 1.0 end * case when figure_type = ' + quoted('chart_graph_text') + ' then 1.1 else 1.0 end', 4)} as score from figures order by complexity_score * case when is_dense then 1.3 else 1.0 end * case when figure_type = 'chart_graph_text' then 1.1 else 1.0 end desc, id limit 25", "figures")
def rank_figures(spark, sf_dir):
    score = Fig.rank_score(F.col("complexity_score"), F.col("is_dense"), F.col("figure_type") == "chart_graph_text")
    return view(spark, sf_dir, "figures").withColumn("s", score).orderBy(F.col("s").desc(), "id").limit(25).select("id", T.half_up(F.col("s"), 4).alias("score"))


@query("select id, success from attempts where success and id not in (select generation_attempt_id from issue_reports where generation_attempt_id is not null)", "attempts issue_reports")
def unreported_attempts(spark, sf_dir):
    return Rel.without(view(spark, sf_dir, "attempts").filter("success"), view(spark, sf_dir, "issue_reports"), "id", "generation_attempt_id").select("id", "success")


@query("select id, priority from jobs where status in ('queued', 'running') and json_extract_string(payload, '$.task_id') = '5'", "jobs")
def jobs_of_task(spark, sf_dir):
    return view(spark, sf_dir, "jobs").filter(F.col("status").isin("queued", "running") & (F.get_json_object("payload", "$.task_id") == "5")).select("id", "priority")


@query("select id, priority from jobs where status = 'queued' order by priority desc, created_at, id limit 1", "jobs")
def queue_head(spark, sf_dir):
    return view(spark, sf_dir, "jobs").filter("status = 'queued'").orderBy(F.col("priority").desc(), "created_at", "id").limit(1).select("id", "priority")


@query("select id, row_number() over (order by id) as place, count(*) over () as n_queued from jobs where status = 'queued'", "jobs")
def queue_position(spark, sf_dir):
    return Rel.queue_order(view(spark, sf_dir, "jobs")).select("id", F.col("place").cast("long").alias("place"), "n_queued")


@query("select id, row_number() over (order by priority desc, created_at, id) as place, count(*) over () as n_queued from jobs where status = 'queued'", "jobs")
def queue_position_by_priority(spark, sf_dir):
    return Rel.queue_order(view(spark, sf_dir, "jobs"), "priority").select("id", F.col("place").cast("long").alias("place"), "n_queued")


@query("select id, row_number() over (order by price desc, id) as place, cast(ceil(row_number() over (order by price desc, id) / 50.0) as bigint) as page from tasks", "tasks")
def tasks_pages(spark, sf_dir):
    return Rel.page_numbers(view(spark, sf_dir, "tasks").select("id", "price"), 50, Rel.ordered(None, "price", "desc", ["price"])[:1] + [F.col("id")]).drop("price")


@query("""select image_path, 'disk' as side from (select distinct image_path from figures) where image_path not in (select image_path from tasks where image_path is not null)
union all select image_path, 'table' as side from (select distinct image_path from tasks where image_path <> '') where image_path not in (select image_path from figures where image_path is not null)""", "figures tasks")
def orphans(spark, sf_dir):
    return Fig.orphans(view(spark, sf_dir, "figures"), view(spark, sf_dir, "tasks"))


@query("select t.id, coalesce(f.caption, '') as title, coalesce(nullif(t.image_path, ''), f.image_path, '') as image_path from tasks t left join figures f on t.figure_id = f.id", "tasks figures")
def export_tasks(spark, sf_dir):
    f = view(spark, sf_dir, "figures").select(F.col("id").alias("figure_id"), "caption", F.col("image_path").alias("own"))
    t = view(spark, sf_dir, "tasks").select("id", "figure_id", "image_path").join(f, "figure_id", "left")
    return t.select("id", F.coalesce("caption", F.lit("")).alias("title"), F.coalesce(F.nullif("image_path", F.lit("")), "own", F.lit("")).alias("image_path"))


@query("select f.id, coalesce(f.caption, '') || case when coalesce(p.title, '') <> '' then ' | Paper: ' || p.title else '' end || case when f.figure_type <> '' then ' | Type: ' || f.figure_type else '' end as content from figures f left join papers p on p.id = f.id + 5", "figures papers")
def figure_documents(spark, sf_dir):
    p = view(spark, sf_dir, "papers").select((F.col("id") - 5).alias("id"), "title")
    return view(spark, sf_dir, "figures").join(p, "id", "left").select("id", T.figure_text(F.col("caption"), F.col("title"), F.col("figure_type"), F.lit("")).alias("content"))


@query("select id, 'attempt' as kind, quality, cast(null as varchar) as event_type, strftime(created_at, '%Y-%m-%d %H:%M') as minute from attempts where task_id = 3 union all select id, 'event', null, event_type, strftime(created_at, '%Y-%m-%d %H:%M') from task_events where task_id = 3", "attempts task_events")
def task_history(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").filter("task_id = 3").select("id", F.lit("attempt").alias("kind"), "quality", "created_at")
    e = view(spark, sf_dir, "task_events").filter("task_id = 3").select("id", F.lit("event").alias("kind"), "event_type", "created_at")
    return Rel.padded_union(a, e).withColumn("minute", F.date_format("created_at", "yyyy-MM-dd HH:mm")).orderBy(F.col("minute").desc(), "kind", "id").select("id", "kind", "quality", "event_type", "minute")


@query("select status, count(*) as n from tasks group by status", "tasks")
def stats_by_status(spark, sf_dir):
    return view(spark, sf_dir, "tasks").groupBy("status").agg(F.count("*").alias("n"))


@query("select difficulty, count(*) as n from tasks where difficulty <> '' group by difficulty", "tasks")
def stats_by_difficulty(spark, sf_dir):
    return view(spark, sf_dir, "tasks").filter("difficulty <> ''").groupBy("difficulty").agg(F.count("*").alias("n"))


@query("select image_path, count(*) as n from figures group by image_path having count(*) > 1", "figures")
def duplicate_paths(spark, sf_dir):
    return view(spark, sf_dir, "figures").groupBy("image_path").agg(F.count("*").alias("n")).filter("n > 1")


@query("select count(*) as n, count(*) filter (where id in (select figure_id from tasks)) as used from figures", "tasks figures")
def figures_used(spark, sf_dir):
    used = view(spark, sf_dir, "tasks").select(F.col("figure_id").alias("id")).distinct().withColumn("used", F.lit(True))
    return view(spark, sf_dir, "figures").join(used, "id", "left").agg(F.count("*").alias("n"), F.count("used").alias("used"))


@query(f"select chunk, n, average, {half('average - lag(average) over (order by chunk)', 1)} as trend from (select (rn - 1) // 20 as chunk, count(*) as n, {half('avg(quality)', 1)} as average from (select quality, row_number() over (order by created_at desc, id desc) as rn from (select * from attempts where success order by created_at desc, id desc limit 500) where quality > 0) group by 1) qualify chunk > max(chunk) over () - 10", "attempts")
def quality_chunks(spark, sf_dir):
    rows = A.newest_successes(view(spark, sf_dir, "attempts")).filter("quality > 0")
    return Rel.chunks(rows, 20, [F.col("created_at").desc(), F.col("id").desc()], "quality").select(F.col("chunk").cast("long").alias("chunk"), "n", "average", "trend")


# ---- analytics --------------------------------------------------------------------
@query(f"""with l as ({LATEST_SQL}),
e as (select task_id, try_cast(case when json_valid(details) then details end as json) as d, event_type from task_events),
c as (select task_id, count(*) filter (where event_type = 'issue_report' and json_extract_string(d, '$.reason') in ('too_easy', 'too_hard', 'unclear', 'wrong_answer')) as issues,
  count(*) filter (where d is not null and event_type = 'check_answer' and coalesce(json_extract_string(d, '$.match'), '') = 'true') as r, count(*) filter (where d is not null and event_type = 'check_answer' and coalesce(json_extract_string(d, '$.match'), '') <> 'true') as w,
  count(*) filter (where d is not null and event_type = 'determinism_check' and coalesce(json_extract_string(d, '$.deterministic'), '') = 'true') as f, count(*) filter (where d is not null and event_type = 'determinism_check' and coalesce(json_extract_string(d, '$.deterministic'), '') <> 'true') as u from e group by task_id)
select {STRATEGY_SQL} as strategy, count(*) as n_tasks, min(id) as first_task, count(*) filter (where review_status = 'too_easy') as realm_too_easy, count(*) filter (where review_status = 'too_hard') as realm_too_hard, count(*) filter (where review_status = 'approved') as realm_approved,
  cast(coalesce(sum(issues), 0) as bigint) as issue_reports, cast(coalesce(sum(f), 0) as bigint) as determinism_pass, cast(coalesce(sum(u), 0) as bigint) as determinism_fail, cast(coalesce(sum(f + u), 0) as bigint) as determinism_checked,
  cast(coalesce(sum(r), 0) as bigint) as check_answer_pass, cast(coalesce(sum(w), 0) as bigint) as check_answer_fail, cast(coalesce(sum(r + w), 0) as bigint) as check_answer_checked,
  count(*) filter (where qwen_raw > 0) as qwen_passes_any, count(*) filter (where gemini_passes > 0) as gemini_passes_any, count(*) filter (where difficulty = 'hardest') as hardest
from tasks left join l on l.task_id = tasks.id left join c on c.task_id = tasks.id group by 1""", "tasks submission_logs task_events")
def strategy_verdicts(spark, sf_dir):
    return A.strategy_verdicts(tasks_of(spark, sf_dir), view(spark, sf_dir, "submission_logs"), view(spark, sf_dir, "task_events"))


@query(f"select coalesce(nullif(model_name, ''), 'unknown') as model, count(*) as samples, {half('avg(quality)', 1)} as avg_quality, {half('coalesce(avg(elapsed_ms) filter (where elapsed_ms > 0), 0)', 1)} as avg_latency from (select * from attempts where success order by created_at desc, id desc limit 500) where quality > 0 group by 1", "attempts")
def model_performance(spark, sf_dir):
    return A.model_performance(view(spark, sf_dir, "attempts"))


def _errors_sql(key: str) -> str:
    return f"select {key} as error, count(*) as n, min(id) as first_id from (select id, unnest(cast(json_extract(validation_errors, '$[*]') as json[])) as e from attempts where json_valid(validation_errors) and json_type(validation_errors) = 'ARRAY') group by 1 order by n desc, first_id, error limit 10"


@query(_errors_sql("substring(json_extract_string(e, '$'), 1, 80)"), "attempts")
def error_histogram(spark, sf_dir):
    return A.error_histogram(view(spark, sf_dir, "attempts"))


COST_SQL = "(case " + " ".join(f"when contains(lower(model_name), '{p}') then input_tokens / 1000 * {i} + output_tokens / 1000 * {o}" for p, i, o in P.TOKEN_COSTS) + f" else input_tokens / 1000 * {P.DEFAULT_COST[0]} + output_tokens / 1000 * {P.DEFAULT_COST[1]} end)"


@query(f"select model_name, calls, input_tokens, output_tokens, {half(COST_SQL, 4)} as cost from (select model_name, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from attempts group by model_name)", "attempts")
def cost_by_model(spark, sf_dir):
    return A.usage_cost(view(spark, sf_dir, "attempts"))


@query(f"select id, {half(COST_SQL, 4)} as cost, case when {COST_SQL} < 0.01 then printf('$%.4f', {half(COST_SQL, 4)}) when {COST_SQL} < 1 then printf('$%.3f', {half(COST_SQL, 3)}) else printf('$%.2f', {half(COST_SQL, 2)}) end as shown from attempts", "attempts")
def attempt_costs(spark, sf_dir):
    usd = T.estimate_cost(F.col("model_name"), F.col("input_tokens"), F.col("output_tokens"))
    return view(spark, sf_dir, "attempts").select("id", T.half_up(usd, 4).alias("cost"), T.format_cost(usd).alias("shown"))


@query(f"select model_name, {half('avg(elapsed_ms)', 1)} as avg_ms, min(elapsed_ms) as min_ms, max(elapsed_ms) as max_ms, list_sort(list(elapsed_ms))[count(*) // 2 + 1] as p50_ms from attempts where elapsed_ms > 0 group by model_name", "attempts")
def latency_profile(spark, sf_dir):
    return A.latency_profile(view(spark, sf_dir, "attempts"), "model_name")


def _success_sql(key: str) -> str:
    return f"select coalesce(nullif({key}, ''), 'unknown') as value, count(*) as total, count(*) filter (where success) as ok, {half('100.0 * count(*) filter (where success) / count(*)', 1)} as rate from attempts group by 1"


@query(_success_sql("difficulty"), "attempts")
def success_by_difficulty(spark, sf_dir):
    return A.success_by(view(spark, sf_dir, "attempts"), "difficulty")


@query(_success_sql("figure_type"), "attempts")
def success_by_type(spark, sf_dir):
    return A.success_by(view(spark, sf_dir, "attempts"), "figure_type")


def _coverage_sql() -> str:
    low = "lower(question)"
    cases = " ".join(f"when {has_word(low, a)}{' and ' + has_word(low, b) if b else ''} then '{n}'" for n, a, b in P.COVERAGE_STRATEGIES)
    unnest = lambda values: f"(select unnest([{', '.join(map(quoted, values))}]) as v)"
    return f"""with g as (select case {cases} else 'other' end as s, case when {within('difficulty', A.DIFFICULTIES)} then difficulty else 'challenging' end as d, case when {within('figure_type', A.FIGURE_TYPES)} then figure_type else 'chart_graph_text' end as f from attempts)
select a.v as strategy, b.v as difficulty, c.v as figure_type, (select count(*) from g where s = a.v and d = b.v and f = c.v) as n from {unnest(A.STRATEGIES)} a, {unnest(A.DIFFICULTIES)} b, {unnest(A.FIGURE_TYPES)} c"""


@query(_coverage_sql(), "attempts")
def coverage_matrix(spark, sf_dir):
    return A.coverage_matrix(view(spark, sf_dir, "attempts"))


@query("select * from (" + _coverage_sql().replace("with g as", "with g as", 1) + ") where n < 20", "attempts")
def coverage_gaps(spark, sf_dir):
    return A.coverage_matrix(view(spark, sf_dir, "attempts")).filter("n < 20")


@query("select case when (select count(*) from attempts where success and quality > 0 and model_name <> '') >= 3 then coalesce((select model_name from (select model_name, count(*) as n, avg(quality) as q from attempts where success and quality > 0 and model_name <> '' group by 1 having count(*) >= 3) order by q desc, n desc, model_name desc limit 1), 'default') else 'default' end as model_name", "attempts")
def best_model(spark, sf_dir):
    return A.best_model(view(spark, sf_dir, "attempts"), "default")


@query(f"select generation_type, count(*) as samples, {half('avg(quality)', 1)} as avg_quality, max(quality) as max_quality from attempts where success and quality > 0 and generation_type <> '' group by 1 having count(*) >= 3", "attempts")
def pipeline_stats(spark, sf_dir):
    return A.best_groups(view(spark, sf_dir, "attempts"), "generation_type")


@query("select task_id, arg_min(quality, (created_at, id)) as first, arg_max(quality, (created_at, id)) as last, count(*) as n, case when last > first then 'improving' when last < first then 'declining' else 'stable' end as direction, case when last >= 80 then 'good' when last >= 50 then 'fair' else 'poor' end as band from attempts where quality > 0 group by task_id", "attempts")
def quality_direction(spark, sf_dir):
    return A.quality_direction(view(spark, sf_dir, "attempts"))


@query("""with r as (select task_id, count(*) as n, bool_or(success) as ok, max(created_at) as newest from (select *, row_number() over (partition by task_id order by created_at desc, id desc) as k from (select * replace (id % 3 = 0 as success) from attempts)) where k <= 3 group by task_id),
e as (select task_id, max(created_at) as edited from task_events where event_type = 'update' group by task_id)
select task_id, newest, not coalesce(edited > newest, false) as blocked from r left join e using (task_id) where n >= 3 and not ok""", "attempts task_events")
def failure_cap(spark, sf_dir):
    return A.failure_cap(view(spark, sf_dir, "attempts").withColumn("success", F.col("id") % 3 == 0), view(spark, sf_dir, "task_events").filter("event_type = 'update'"))


@query(f"select count(*) as n, count(*) filter (where filesize_bytes < 5000) as small, {half('100.0 * count(*) filter (where is_suitable) / count(*)', 1)} as suitable_pct, " + ", ".join(f"count(*) filter (where complexity_score >= {a} and complexity_score < {b}) as bin{i}" for i, (a, b) in enumerate(((0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01)))) + " from figures", "figures")
def library_health(spark, sf_dir):
    return A.library_health(view(spark, sf_dir, "figures"))


MATCH_SQL = "case when trim(model_answer) = '' or trim(golden) = '' then false when answer_format = 'number' then coalesce(abs(try_cast(regexp_replace(trim(model_answer), '[^0-9.\\-]', '', 'g') as double) - try_cast(regexp_replace(trim(golden), '[^0-9.\\-]', '', 'g') as double)) <= greatest(0.01, 0.005 * abs(try_cast(regexp_replace(trim(golden), '[^0-9.\\-]', '', 'g') as double))), false) else lower(trim(model_answer)) = lower(trim(golden)) end"


@query(f"select task_id, run, l_partkey, l_suppkey, model_answer, golden, {MATCH_SQL} as matches from answer_reads", "answer_reads")
def golden_match(spark, sf_dir):
    return view(spark, sf_dir, "answer_reads").select("task_id", "run", "l_partkey", "l_suppkey", "model_answer", "golden", T.matches_golden(F.col("model_answer"), F.col("golden"), F.col("answer_format")).alias("matches"))


@query(f"select task_id, count(*) filter (where trim(model_answer) <> '') as answered, count(*) filter (where trim(model_answer) <> '' and not {MATCH_SQL}) as diverging, answered > 0 as checked, answered > 0 and diverging = 0 as deterministic from answer_reads group by task_id", "answer_reads")
def determinism(spark, sf_dir):
    return A.determinism(view(spark, sf_dir, "answer_reads"))


# ---- text -------------------------------------------------------------------------
@query(f"select id, {STRATEGY_SQL} as strategy, case when qwen_raw > 0 then 'easy' when gemini_passes > 0 then 'challenging' else 'hardest' end as level, len(list_filter(string_split_regex(trim(question), '\\s+'), x -> x <> '')) as n_words, substring(sha256(question), 1, 12) as hash from tasks", "tasks")
def question_classes(spark, sf_dir):
    return tasks_of(spark, sf_dir).select("id", T.strategy(F.col("question")).alias("strategy"), T.difficulty_of(F.col("qwen_passes"), F.col("gemini_passes")).alias("level"), F.size(R.words(F.col("question"))).cast("long").alias("n_words"), F.substring(F.sha2("question", 256), 1, 12).alias("hash"))


def _guard_sql() -> str:
    each = " ".join(f"when {rx('lower(text)', [p])} then {i}" for i, p in enumerate([*P.INJECTION, *P.SENSITIVE], 1))
    return f"select doc_id, case when {rx('lower(text)', P.INJECTION + P.SENSITIVE)} then 'blocked' when length(text) > 5000 then 'suspicious' else 'safe' end as risk, case {each} end as reason from documents"


@query(_guard_sql())
def input_guard(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", G.input_risk(F.col("text")).alias("risk"), G.input_reason(F.col("text")).alias("reason"))


def _pii_sql() -> str:
    out = "text"
    for _, p in P.PII:
        out = f"regexp_replace({out}, {quoted(p)}, '[REDACTED]', 'g')"
    any_ = " or ".join(f"regexp_matches(text, {quoted(p)})" for _, p in P.PII)
    toxic = f"regexp_matches(lower(text), {quoted(P.TOXIC_WORDS)})"
    return f"select doc_id, {toxic} as toxic, {any_} as pii, case when {toxic} or {any_} then sha256({out}) end as redacted_sha256 from documents"


@query(_pii_sql())
def pii_redaction(spark, sf_dir):
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", G.toxic(t).alias("toxic"), (F.size(G.pii_kinds(t)) > 0).alias("pii"), F.sha2(G.redacted(t), 256).alias("redacted_sha256"))


@query("select conv_id, turn, " + " + ".join(f"cast({rx('lower(text)', [p])} as int)" for p in P.LEAKAGE) + " as n_leaks from conversations")
def leakage(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(G.leaks(F.col("text"))).alias("n_leaks"))


def _rails_sql() -> str:
    a, w = "trim(answer)", "list_filter(string_split_regex(trim(answer), '\\s+'), x -> x <> '')"
    bare, v = "replace(trim(answer), ',', '')", "try_cast(replace(replace(trim(answer), ',', ''), '%', '') as double)"
    q, p = (f"list_distinct(list_filter(string_split_regex(lower(trim({c})), '\\s+'), x -> x <> ''))" for c in ("question", "previous_question"))
    return f"""with t as (select *, coalesce(lag(question) over (partition by figure_id order by id), '') as previous_question from tasks)
select id, {a} <> '' and not {within(f'lower({a})', P.TRIVIAL_ANSWERS)} as plausible,
  not (answer_format in ('number', 'integer', 'percent') and coalesce(({v} = 0 and answer_format <> 'percent') or abs({v}) > 1000000, false)) as moderate,
  {a} = '' or case answer_format when 'number' then regexp_matches({bare}, '^-?\\d+(\\.\\d+)?$') when 'integer' then regexp_matches({bare}, '^-?\\d+$') when 'percent' then regexp_matches({bare}, '^-?\\d+(\\.\\d+)?%?$') when 'word' then len({w}) <= 4 when 'phrase' then len({w}) <= 6 else true end as fits_format,
  previous_question = '' or not (lower(trim(question)) = lower(trim(previous_question)) or (len({q}) > 0 and len({p}) > 0 and len(list_intersect({q}, {p})) / greatest(len({q}), len({p}), 1) > 0.85)) as diverse
from t"""


@query(_rails_sql(), "tasks")
def guardrails(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").withColumn("previous_question", F.coalesce(F.lag("question").over(Window.partitionBy("figure_id").orderBy("id")), F.lit("")))
    d = {c: F.col(c) for c in ("question", "answer", "answer_format", "previous_question")}
    return t.select("id", *(f(d).alias(n) for n, f in G.GUARDRAILS.items()))


RESPONSES = ["ERROR: this model does not support image input.", "The chart shows a peak. This model does not support image input.", "<think>Let me see</think>{\"question\": \"q\"}", "<think>never closed", "I can't view images", "plain"]


@query("select id, {e} as refused, case when regexp_matches(r, '(?s)<think>.*</think>') then trim(regexp_extract(r, '(?s)<think>(.*?)</think>', 1)) when contains(r, '<think>') then trim(regexp_extract(r, '(?s)<think>(.*)$', 1)) end as thinking from (select id, {r} as r from tasks)".format(
    e=f"(not {has_word('lower(r)', P.IMAGE_EVIDENCE)} and {has_word('lower(r)', P.IMAGE_REFUSALS)})", r=f"[{', '.join(map(quoted, RESPONSES))}][1 + id % {len(RESPONSES)}]"), "tasks")
def response_tests(spark, sf_dir):
    r = F.element_at(F.array(*map(F.lit, RESPONSES)), (1 + F.col("id") % len(RESPONSES)).cast("int"))
    return view(spark, sf_dir, "tasks").select("id", G.refuses_image(r).alias("refused"), G.thinking(r).alias("thinking"))


@query()
def parsed_responses(spark, sf_dir):
    text = F.concat(F.lit("Sure! {not json} ```json {\"question\": \""), F.replace("question", F.lit('"'), F.lit("")), F.lit("\", \"answer\": \"a {b}\", \"score\": \"7.5\"} ```"))
    return view(spark, sf_dir, "tasks").select("id", parse_response(text, "question").alias("p")).select("id", "p.*")


@query(f"select id, case when quality >= 90 then 5 when quality >= 70 then 4 when quality >= 50 then 3 else 2 end as base, case when trim(question) = '' or trim(answer) = '' then 1 else greatest(base - cast(length(trim(answer)) < 2 as int) - cast(contains(lower(trim(question)), lower(trim(answer))) as int), 1) end as score, {half('quality + case when validation_is_valid then 50 else 0 end + case when quality >= 80 then 10 else 0 end', 1)} as consensus from attempts", "attempts")
def reviews(spark, sf_dir):
    q = F.col("quality")
    base = F.when(q >= 90, 5).when(q >= 70, 4).when(q >= 50, 3).otherwise(2)
    return view(spark, sf_dir, "attempts").select("id", base.alias("base"), T.reviewer_score(q, F.col("question"), F.col("answer"), 100).alias("score"), T.half_up(T.consensus_score(q, F.col("validation_is_valid")), 1).alias("consensus"))


@query("select id, case when difficulty = 'easy' then 'simple' when difficulty = 'hardest' then 'self_critique' else 'rag_enhanced' end as pipeline, difficulty = 'hardest' or (difficulty <> 'easy' and complexity_score >= 0.7) as use_self_critique from attempts", "attempts")
def routes(spark, sf_dir):
    return view(spark, sf_dir, "attempts").withColumn("r", T.route(F.col("difficulty"), F.col("complexity_score"))).select("id", "r.pipeline", "r.use_self_critique")


@query("select id, " + " || ".join(f"case when {has_word(chr(108) + 'ower(reason || ' + quoted(' ') + ' || description)', k)} or reason = '{h}' then '{h};' else '' end" for h, k in P.ISSUE_HINTS) + " as hints from issue_reports", "issue_reports")
def issue_hints(spark, sf_dir):
    hints = T.issue_hints(F.col("reason"), F.col("description"))
    return view(spark, sf_dir, "issue_reports").select("id", F.array_join(F.transform(hints, lambda h: F.concat(h, F.lit(";"))), "").alias("hints"))


# ---- rule engine ------------------------------------------------------------------
def _rules_sql() -> dict[str, tuple[str, str, str]]:
    """Rule -> SQL of errors, warnings and passes (0 or 1, or a count), from the rules' wording."""
    q, a, low = "q", "a", "low"
    hard, hardest, chart = "difficulty in ('challenging', 'hardest')", "difficulty = 'hardest'", "(figure_type in ('chart_graph_text', 'chart') or task_type = 'chart')"
    n = lambda c: f"cast(coalesce({c}, false) as int)"
    e = lambda c: (n(c), "0", n(f"not coalesce({c}, false)"))
    w = lambda c: ("0", n(c), n(f"not coalesce({c}, false)"))
    es, ws = (lambda c: (n(c), "0", "0")), (lambda c: ("0", n(c), "0"))
    lookup, data = rx(low, P.SINGLE_LOOKUP), rx(low, P.CHART_DATA)
    depth = f"(not ({hard} and {lookup}) and {rx(low, P.REASONING)})"
    furniture = "(" + " + ".join(n(rx(low, [p])) for p in P.CHART_FURNITURE) + ")"
    visual, bare = has_word(low, P.VISUAL_WORDS), "rtrim(a, '.')"
    count = lambda c: f"len(list_filter(string_split_regex(trim({c}), '\\s+'), x -> x <> ''))"
    number, whole = "try_cast(replace(replace(replace(a, ',', ''), '%', ''), '^', '') as double)", "try_cast(replace(a, ',', '') as double)"
    is_int = f"coalesce({whole} = floor({whole}), false)"
    ans = "try_cast(a as double)"
    near = lambda x: f"abs({x} - {ans}) < 0.01 * abs({ans}) + 0.01"
    derived = f"len(list_filter(nums, x -> len(list_filter(nums, y -> (y <> 0 and {near('x / y')}) or {near('(x - y)')} or {near('(x + y)')})) > 0)) > 0"
    solvable = f"(length(caption) > 150 or regexp_matches(caption, '\\d+[.%]') or (q <> '' and regexp_matches({low}, '\\bcaption\\b')))"
    opts = "string_split(options_text, '|')"
    some = "options_text <> ''"
    tricky = f"case when {some} then len(list_filter({opts}, x -> {within('lower(trim(x))', P.TRICK_ANSWERS)})) else 0 end"
    mismatch, both = "((figure_type = 'general_image' and task_type = 'chart') or (figure_type = 'chart_graph_text' and task_type = 'spatial'))", "(figure_type <> '' and task_type <> '')"
    spaced, small = "contains(q, '  ')", "(lower(substring(q, 1, 1)) = substring(q, 1, 1) and upper(substring(q, 1, 1)) <> substring(q, 1, 1))"
    return {
        "R1": e(rx(low, P.BINARY_QUESTION)), "R2": e("answer_format = ''"), "R3": w(f"{count(a)} > 4"), "R4": es("length(a) > 50"), "R5": e(within(a, P.TRICK_ANSWERS)), "R6": e("length(q) - length(replace(q, '?', '')) > 1 or not regexp_matches(q, '[.!?]$')"),
        "R7": (n(f"sent >= 3 and {hard}"), n(f"(sent >= 3 and not {hard}) or (sent = 2 and {hard})"), n(f"sent < 2 or (sent = 2 and not {hard})")), "R8": e(rx(low, P.RESTRICTS_OPTIONS)), "R9": w(rx(low, P.JARGON)), "R10": w(f"not {visual}"),
        "R11": (n(f"answer_format = 'number' and {number} is null"), "0", n(f"answer_format = 'number' and {number} is not null")), "R12": (n(f"answer_format in ('integer', 'int') and not {is_int}"), "0", n(f"answer_format in ('integer', 'int') and {is_int}")),
        "R13": es("answer_format = 'percent' and not contains(a, '%')"), "R14": e(rx(low, P.EXPLANATION)), "R15": e(rx(low, P.INLINE_CHOICES)), "R16": es(f"{hardest} and {rx(f'regexp_replace(rtrim({low}, {quoted(chr(46))}), {quoted(P.WHEN_WORDS)}, {quoted(chr(32) + 'while ')}, {quoted(chr(103))})', P.TWO_QUESTIONS)}"),
        "R17": ws(f"{hardest} and not {has_word(low, P.CALCULATION_WORDS)}"), "R18": (n(f"not {depth} and {hard}"), n(f"not {depth} and not {hard}"), n(depth)), "R19": ws(f"{hard} and {lookup}"), "R20": ws(f"{hard} and not {rx(low, P.TWO_PANELS)} and not {has_word(low, P.COMPLEX_WORDS)}"),
        "R21": (f"case when {chart} and not {data} then {furniture} else 0 end", f"case when {chart} and {data} then {furniture} when {chart} and {furniture} = 0 then 1 else 0 end", n(f"{chart} and {furniture} = 0 and {data}")),
        "R22": es(rx(low, P.GENERIC_COUNT)), "R23": es(f"{hard} and {rx(low, P.MANUFACTURED)}"), "R24": es(f"{hard} and {within(bare, P.BINARY_ANSWERS)} and {rx(low, P.BINARY_CHOICE)}"),
        "R25": es(f"{hard} and {rx(low, P.MATCHMAKING)} and {count(bare)} <= 3 and not {rx(low, P.COMPARATIVE)}"), "R26": es(f"{chart} and {rx(low, P.MATH_OPERATION)} and {rx(low, P.INLINE_DATA)}"), "R27": ws(rx(low, P.ARITHMETIC)), "R28": w(within(a, P.GUESSABLE_ANSWERS)),
        "R29": ("0", f"{n(spaced)} + {n(small)}", n(f"not {spaced} and not {small}")), "R30": e(rx(low, P.EXTREME_SEEKING)), "R31": ("0", "0", n(rx(low, P.THRESHOLD))), "R32": ("0", "0", n(rx(low, P.MULTI_PANEL))),
        "R33": ("0", n(f"caption <> '' and {solvable}"), n(f"caption <> '' and not {solvable}")), "R34": ws(within(a, P.EXTREME_ANSWERS)), "R35": e(f"{rx(low, P.TEXT_HEAVY)} or not {visual}"), "R36": w(f"{within(a, P.SUBJECTIVE_ANSWERS)} or {count(a)} > 4"),
        "R37": es(f"{rx(low, P.ANSWER_IN_QUESTION)} and len(nums) >= 2 and {derived}"), "R38": w(rx(low, P.MATH_HEAVY)), "R39": e(rx(low, P.TEXT_HEAVY)), "R40": ws(rx(low, P.LONG_WINDED)), "R41": ws(rx(low, P.NOISE_CONDITION)),
        "R42": ws("len(list_filter(string_split_regex(a, ',|\\band\\b'), x -> trim(x) <> '')) > 3"), "R43": ("0", f"{n(f'{some} and len({opts}) < 8')} + {tricky}", n(f"{some} and len({opts}) >= 8 and {tricky} = 0")),
        "R44": ("0", " + ".join(n(f"contains(lower(image_path), '{x}')") for x in P.WATERMARKS), "0"), "R45": ("0", n(f"{both} and {mismatch}"), n(f"{both} and not {mismatch}")),
    }


_INPUT_SQL = "s as (select *, trim(question) as q, lower(trim(answer)) as a, lower(trim(question)) as low, len(list_filter(string_split_regex(trim(question), '[.!?]+'), x -> trim(x) <> '')) as sent, list_transform(regexp_extract_all(trim(question), '-?\\d+(?:\\.\\d+)?'), x -> cast(x as double)) as nums from tasks)"
_SUM = {k: " + ".join(v[k] for v in _rules_sql().values()) for k in (0, 1)}
_BONUS = " + ".join(_rules_sql()[r][2] for r in ("R18", "R31", "R32"))


def _validated(spark, sf_dir) -> DataFrame:
    t = view(spark, sf_dir, "tasks").select("id", "question", "answer", "answer_format", "image_path", "caption", "options_text", "figure_type", "task_type", "difficulty")
    return R.validate(spread(t).withColumn("options", F.when(F.col("options_text") != "", F.split("options_text", "[|]"))))


@query(f"with {_INPUT_SQL} select id, cast({_SUM[0]} as int) as n_errors, cast({_SUM[1]} as int) as n_warnings, cast(greatest(least(100 - 20 * ({_SUM[0]}) - 5 * ({_SUM[1]}) + 5 * ({_BONUS}), 100), 0) as int) as quality_score, ({_SUM[0]}) = 0 as is_valid from s", "tasks")
def rule_scores(spark, sf_dir):
    return _validated(spark, sf_dir).select("id", F.col("n_errors").cast("int").alias("n_errors"), F.col("n_warnings").cast("int").alias("n_warnings"), F.col("quality_score").cast("int").alias("quality_score"), "is_valid")


@query(f"with {_INPUT_SQL} " + " union all ".join(f"select '{r}' as rule, count(*) filter (where ({v[0]}) > 0) as errors, count(*) filter (where ({v[1]}) > 0) as warnings, count(*) filter (where ({v[2]}) > 0) as passed from s" for r, v in _rules_sql().items()), "tasks")
def rule_outcomes(spark, sf_dir):
    v = _validated(spark, sf_dir)
    named = lambda k, c: F.transform(c, lambda r: F.struct(r.alias("rule"), F.lit(k).alias("kind")))
    kinds = F.flatten(F.array(named(0, "errors"), named(1, "warnings"), named(2, "passed")))
    alike = v.groupBy("errors", "warnings", "passed").agg(F.count("*").alias("rows"))  # tasks of one outcome at once
    counted = alike.select("rows", F.explode(kinds).alias("o")).groupBy("o.rule").agg(*(F.sum(F.when(F.col("o.kind") == k, F.col("rows"))).alias(n) for k, n in enumerate(("errors", "warnings", "passed"))))
    every = spark.createDataFrame([(r,) for r in _rules_sql()], "rule string")
    return every.join(counted, "rule", "left").select("rule", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "passed")))


# ---- search and dedup -------------------------------------------------------------
@query(f"select id, title from papers where regexp_matches(lower(title), {quoted(S.term_pattern('neural network'))}) and len(list_filter(string_split_regex(categories, '\\s+'), c -> starts_with(lower(c), 'cs') or contains(lower(c), 'computer science') or starts_with(lower(c), 'computer science'))) > 0 order by id limit 20", "papers")
def term_search(spark, sf_dir):
    return S.search_papers(view(spark, sf_dir, "papers"), ["neural network"], "cs").select("id", "title")


_COS = "list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[]))"


@query(f"select query_id, vec_id, {half('score', 4)} as score, cast(rank as int) as rank from (select q.vec_id as query_id, v.vec_id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from embeddings v, embeddings q where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id) where rank <= 5")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return S.vector_topk(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


@query(f"""with v as (select vec_id, embedding from embeddings where vec_id % 11 <> 3 union all select vec_id, list_transform(embedding, x -> -x) from embeddings where vec_id % 11 = 3 and vec_id % 2 = 0),
n as (select q.vec_id as query_id, v.vec_id as id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from v, embeddings q where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)
select query_id, id, {half('score', 4)} as score, cast(rank as int) as rank from n where rank <= 5""")
def stored_vectors(spark, sf_dir):
    """All vectors stored, some turned round by a second write, some deleted by a third, and all lists searched."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding")
    c = Vec.Collection(spark, f"{run_folder(spark)}/vectors-{uuid.uuid4().hex}")
    odd = v.filter("id % 11 = 3")
    c.upsert(v)
    c.upsert(odd.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    c.delete(odd.filter("id % 2 = 1").select("id"))
    c.compact()
    return c.search(v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), exact=True)


@query(f"""with d as (select e.vec_id as id, cast(e.label as varchar) as kind, e.embedding, coalesce(substring(t.text, 1, 200), '') as content from embeddings e left join documents t on t.doc_id = e.vec_id),
q as (select *, case when id % 3 = 0 then '' else kind end as asked, id % 7 as owner from d where id % 50 = 0),
c as (select id, id % 7 as owner, embedding, 'seen before ' || id as context from d where id % 100 = 0 and (id * 37) % 5000 < 3600),
h as (select q.id as query_id, arg_max(c.context, (list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])), -c.id)) as held from q join c using (owner) where list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])) >= 0.95 group by q.id),
n as (select q.id as query_id, q.content as text, d.id, d.content, list_cosine_similarity(cast(d.embedding as double[]), cast(q.embedding as double[])) as s from q join d on q.asked in ('', d.kind) and q.id <> d.id where q.id not in (select query_id from h)),
m as (select *, row_number() over (partition by query_id order by s desc, id) as r from n qualify r <= 10),
w as (select *, list_distinct(list_filter(string_split_regex(trim(lower(text)), '\\s+'), x -> x <> '')) as a, list_distinct(list_filter(string_split_regex(trim(lower(content)), '\\s+'), x -> x <> '')) as b from m),
k as (select *, row_number() over (partition by query_id order by case when len(a) = 0 then 0 else len(list_intersect(a, b)) / len(a) end desc, id) as place from w qualify place <= 5),
t as (select query_id, 'Retrieved context:' || chr(10) || string_agg('- ' || content, chr(10) order by place) as told, string_agg(cast(id as varchar), ',' order by place) as sources from k group by query_id)
select q.id as query_id, held is not null as from_cache, coalesce(held, told, '') as context, case when held is not null then 'cache' else coalesce(sources, '') end as sources from q left join h on h.query_id = q.id left join t on t.query_id = q.id""")
def contexts(spark, sf_dir):
    """Every fiftieth vector asks with its document's words, in all lists; every hundredth has been asked before, some of them too long ago."""
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("content"))
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "embedding").join(text, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    store = Vec.Collection(spark, f"{run_folder(spark)}/contexts-{uuid.uuid4().hex}")
    store.upsert(d.withColumn("metadata", F.create_map(F.lit("kind"), "kind")))
    asked = d.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("content").alias("text"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("kind")).alias("kind"), (F.col("id") % 7).alias("owner"))
    cache = d.filter("id % 100 = 0").select(F.col("id").alias("cache_id"), (F.col("id") % 7).alias("owner"), "embedding", F.timestamp_seconds(10_000 - (F.col("id") * 37) % 5000).alias("created_at"), F.concat(F.lit("seen before "), "id").alias("context"))
    return S.contexts(asked, cache, store, F.timestamp_seconds(F.lit(10_000)), exact=True)


@query(f"with n as (select q.vec_id as query_id, v.vec_id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from embeddings v, embeddings q where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id) select query_id, arg_min(vec_id, rank) as vec_id, arg_min({half('score', 4)}, rank) as score from n where rank <= 3 and {half('score', 4)} >= 0.3 and (vec_id * 37) % 5000 < 3600 group by query_id")
def semantic_cache(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("created_at", F.timestamp_seconds(10_000 - (F.col("vec_id") * 37) % 5000))
    return S.semantic_cache(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.timestamp_seconds(F.lit(10_000)), 0.3)


@query("with p as (select label, embedding as e from embeddings where vec_id % 40 = 1), s as (select v.vec_id, p.label, avg(list_cosine_similarity(cast(v.embedding as double[]), cast(p.e as double[]))) as s from embeddings v, p group by 1, 2) select vec_id, cast(arg_max(label, (s, -label)) as int) as class from s group by vec_id")
def prototype_class(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return S.nearest_prototype(v, v.filter("vec_id % 40 = 1").select("label", F.col("embedding").alias("p"))).select("vec_id", F.col("class").cast("int").alias("class"))


@query(f"select doc_id, {half('r', 4)} as relevance, case when r >= 0.3 then 'relevant' when r >= 0.15 then 'ambiguous' else 'irrelevant' end as grade from (select doc_id, len(list_intersect(['the', 'nation', 'of', 'ouble'], list_distinct(list_filter(string_split_regex(trim(lower(text)), '\\s+'), x -> x <> '')))) / 4 as r from documents)")
def doc_grades(spark, sf_dir):
    d = S.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), "The nation of ouble", F.lit(0.0))
    return d.select("doc_id", T.half_up(F.col("relevance"), 4).alias("relevance"), "grade")


@query("""with g as (select * from attempts where success and validation_is_valid and quality >= 80 and question <> '' and id not in (select generation_attempt_id from issue_reports where generation_attempt_id is not null)),
o as (select *, row_number() over (order by abs(complexity_score - 0.5), rhea_passed desc, qwen_passes, gemini_passes desc, id) as k from g qualify k <= 10),
u as (select *, row_number() over (partition by lower(trim(question)) order by k) as r from o)
select id, question from u where r = 1 order by k limit 5""", "attempts issue_reports")
def few_shot(spark, sf_dir):
    return S.few_shot(view(spark, sf_dir, "attempts"), view(spark, sf_dir, "issue_reports"), "", "", 0.5, 5).select("id", "question")


@query("""with g as (select * from attempts where success and validation_is_valid and quality >= 80 and question <> '' and id not in (select generation_attempt_id from issue_reports where generation_attempt_id is not null)),
p as (select id, figure_type, difficulty, (id % 97) / 96.0 as x from tasks),
d as (select distinct figure_type, difficulty, x from p),
o as (select d.*, g.id as attempt_id, g.question, row_number() over (partition by d.figure_type, d.difficulty, d.x order by case when d.x > 0 then abs(g.complexity_score - d.x) else -g.quality end, case when d.difficulty = 'hardest' then 0 else -g.rhea_passed end, g.qwen_passes, case when d.difficulty = 'hardest' then g.gemini_passes else -g.gemini_passes end, g.id) as k
  from d join g on (d.figure_type = '' or d.figure_type = g.figure_type) and (d.difficulty = '' or d.difficulty = g.difficulty) qualify k <= 4),
u as (select * from o qualify row_number() over (partition by figure_type, difficulty, x, lower(trim(question)) order by k) = 1),
r as (select *, row_number() over (partition by figure_type, difficulty, x order by k) as rank from u qualify rank <= 2)
select p.id, rank, attempt_id, question from p join r using (figure_type, difficulty, x)""", "attempts issue_reports tasks")
def few_shot_all(spark, sf_dir):
    p = view(spark, sf_dir, "tasks").select("id", "figure_type", "difficulty", (F.col("id") % 97 / F.lit(96.0)).alias("complexity"))
    return S.few_shot_all(view(spark, sf_dir, "attempts"), view(spark, sf_dir, "issue_reports"), p)


@query("select d.doc_id, f.first from (select doc_id, sha256(text) as h from documents) d join (select sha256(text) as h, min(doc_id) as first from documents group by 1) f using (h) where d.doc_id > f.first")
def exact_dups(spark, sf_dir):
    return Fig.exact_copies(table(spark, sf_dir, "documents"), "text", "doc_id")


_PHASH_SQL = "h as (select doc_id as id, lang as group_id, substring(sha256(source), 1, 15) || substring('0123456789abcdef', 1 + doc_id % 16, 1) as phash from documents)"


@query(f"with {_PHASH_SQL}, b as (select id, group_id, cast('0x' || substring(phash, 1, 8) as bigint) as x, cast('0x' || substring(phash, 9, 8) as bigint) as y from h) select a.id, min(c.id) as first from b a join b c on a.group_id = c.group_id and c.id < a.id and bit_count(xor(a.x, c.x)) + bit_count(xor(a.y, c.y)) < 8 group by a.id")
def near_dups(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("group_id"), F.concat(F.substring(F.sha2("source", 256), 1, 15), F.substring(F.lit("0123456789abcdef"), (1 + F.col("doc_id") % 16).cast("int"), F.lit(1))).alias("phash"))
    return Fig.near_copies(h)


@query(f"select id, cast(flags as int) as flags, {half('greatest(1 - 0.5 * flags, 0)', 1)} as audit_quality from (select id, cast(width_height_ratio > 5 or width_height_ratio < 0.2 as int) + cast(complexity_score < 0.1 as int) + cast(filesize_bytes < 5000 as int) as flags from figures)", "figures")
def figure_audit(spark, sf_dir):
    return Fig.audit(view(spark, sf_dir, "figures")).select("id", "flags", T.half_up(F.col("audit_quality"), 1).alias("audit_quality"))


@query("""with recursive f as (select *, row_number() over (order by paper_id, id) as n from extracted where not known),
old as (select list(distinct image_hash) as hashes, list({'paper': paper_id, 'phash': phash}) filter (phash <> '') as prints from extracted where known),
-- figures one by one, with what is kept: of papers that are done their hashes, of the paper at hand whole rows
walk as (
  select cast(0 as bigint) as n, cast('' as varchar) as paper, cast([] as varchar[]) as hashes, cast([] as struct(c double, id bigint, h varchar, p varchar)[]) as mine, cast([] as struct(id bigint, o varchar)[]) as done, cast(0 as bigint) as id, cast('' as varchar) as outcome
  union all
  select n, paper, hashes, case when o = '' then list_append(mine, {'c': -complexity_score, 'id': id, 'h': image_hash, 'p': phash}) else mine end, done, id, o from (
    select f.n, f.paper_id as paper, f.id, f.complexity_score, f.image_hash, f.phash, b.hashes, b.mine, b.done,
      case when width_height_ratio > 5 or width_height_ratio < 0.2 then 'logo' when complexity_score < 0.2 then 'simple' when filesize_bytes < 5000 then 'small'
        when list_contains(old.hashes, f.image_hash) or list_contains(b.hashes, f.image_hash) or len(list_filter(b.mine, lambda m: m.h = f.image_hash)) > 0 then 'copy'
        when f.phash <> '' and len(list_filter(list_concat(list_transform(list_filter(old.prints, lambda m: m.paper = f.paper_id), lambda m: m.phash), list_transform(list_filter(b.mine, lambda m: m.p <> ''), lambda m: m.p)),
          lambda p: bit_count(xor(cast('0x' || p[1:8] as bigint), cast('0x' || f.phash[1:8] as bigint))) + bit_count(xor(cast('0x' || p[9:16] as bigint), cast('0x' || f.phash[9:16] as bigint))) < 8)) > 0 then 'near copy' else '' end as o
    from (select n, g.paper <> w.paper as turned, case when g.paper <> w.paper then list_concat(hashes, list_transform(list_sort(mine)[1:3], lambda m: m.h)) else hashes end as hashes, case when g.paper <> w.paper then [] else mine end as mine,
        case when g.paper <> w.paper then list_transform(list_sort(mine)[4:], lambda m: {'id': m.id, 'o': 'capped'}) else [] end as done from walk w join (select n - 1 as before, paper_id as paper from f) g on g.before = w.n) b
      join f on f.n = b.n + 1, old)),
gone as (select unnest(done, recursive := true) from walk union all select unnest(list_transform(list_sort(mine)[4:], lambda m: {'id': m.id, 'o': 'capped'}), recursive := true) from walk where n = (select max(n) from f))
select f.id, f.paper_id, case when w.outcome <> '' then w.outcome when gone.id is not null then 'capped' else 'kept' end as outcome from f join walk w on f.n = w.n left join gone on gone.id = f.id""", "extracted")
def ingested(spark, sf_dir):
    f = view(spark, sf_dir, "extracted")
    return Fig.ingest(f.filter("not known"), f.filter("known"))


@query("select id, case when complexity_score >= case when figure_type = 'chart_graph_text' then 0.85 else 0.75 end and is_dense then 'HARDEST' when complexity_score >= case when figure_type = 'chart_graph_text' then 0.55 else 0.45 end then 'CHALLENGING' else 'EASY' end as likelihood from figures", "figures")
def suitability(spark, sf_dir):
    return view(spark, sf_dir, "figures").select("id", T.suitability(F.col("complexity_score"), F.col("is_dense"), F.col("figure_type") == "chart_graph_text").alias("likelihood"))


# ---- histories and roll-ups of authoring --------------------------------------------
_ISSUE_LINE = "'reason=' || reason || case when description <> '' then ' (' || description || ')' else '' end || case when corrected_answer <> '' then ' | CORRECTED ANSWER: ' || corrected_answer else '' end"
_ATTEMPT_LINE = """concat_ws(' | ', 'Attempt ' || n || ': ' || generation_type, case when difficulty <> '' then 'difficulty=' || difficulty end, case when question <> '' then 'question=' || question end, case when answer <> '' then 'answer=' || answer end,
  case when quality > 0 then 'quality=' || cast(cast(round_even(quality, 0) as bigint) as varchar) end, case when json_valid(validation_errors) and json_type(validation_errors) = 'ARRAY' and json_array_length(validation_errors) > 0 then 'errors=' || array_to_string(list_slice(from_json(validation_errors, '["varchar"]'), 1, 3), '; ') end,
  case when qwen_passes + gemini_passes > 0 then 'model_runs: Qwen=' || qwen_passes || '/' || (qwen_passes + gemini_passes) || ' Gemini=' || gemini_passes || '/' || (qwen_passes + gemini_passes) end)"""


def _issues(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "issue_reports").withColumn("corrected_answer", F.when(F.col("id") % 2 == 0, "12").otherwise(""))


@query(f"""with a as (select *, row_number() over (partition by task_id order by created_at, id) as n from (select *, row_number() over (partition by task_id order by created_at desc, id desc) as r from attempts) where r <= 5),
i as (select task_id, l, min(id) as id, arg_min(coalesce(generation_attempt_id, -1), id) as attempt_id from (select *, {_ISSUE_LINE} as l from (select *, case when id % 2 = 0 then '12' else '' end as corrected_answer from issue_reports)) group by 1, 2),
e as (select task_id, n as "at", -1 as sub, {_ATTEMPT_LINE} as l from a
  union all select i.task_id, a.n, i.id, '  USER FEEDBACK on this attempt: ' || i.l from i join a on i.task_id = a.task_id and i.attempt_id = a.id
  union all select task_id, 1000000, id, '  USER FEEDBACK: ' || l from i where attempt_id = -1)
select task_id, count(*) as n_lines, array_to_string(list_transform(list_sort(list(struct_pack(place := "at", sub := sub, l := l))), x -> x.l), chr(10)) as history from e group by task_id""", "attempts issue_reports")
def attempt_history(spark, sf_dir):
    return Au.history(view(spark, sf_dir, "attempts"), _issues(spark, sf_dir), "task_id")


@query(f"""with r as (select * from attempts order by created_at desc, id desc limit 50),
e as (select json_extract_string(x, '$') as value, count(*) as n, min(id) as f from (select id, unnest(cast(json_extract(validation_errors, '$[*]') as json[])) as x from r where json_valid(validation_errors) and json_type(validation_errors) = 'ARRAY') group by 1 order by n desc, f, value limit 10),
c as (select coalesce(nullif(figure_type, ''), 'any') || '/' || coalesce(nullif(difficulty, ''), 'any') || '/' || coalesce(nullif(model_name, ''), 'any') as value, count(*) as n, avg(quality) as q from r where quality > 0 group by 1 order by q desc, value limit 1),
l as (select cast(id as varchar) as value, quality from r where quality > 0 and quality < 60 order by created_at desc, id desc limit 3)
select 'difficulty' as section, coalesce(nullif(difficulty, ''), 'unknown') as value, count(*) as n, count(*) filter (where success) as ok, {half('coalesce(avg(quality) filter (where quality > 0), 0)', 1)} as average from r group by 2
union all select 'model', coalesce(nullif(model_name, ''), 'unknown'), count(*) filter (where quality > 0), null, {half('coalesce(avg(quality) filter (where quality > 0), 0)', 1)} from r group by 2
union all select 'figure_type', coalesce(nullif(figure_type, ''), 'unknown'), count(*) filter (where quality > 0), null, {half('coalesce(avg(quality) filter (where quality > 0), 0)', 1)} from r group by 2
union all select 'error', value, n, null, null from e union all select 'best', value, n, null, {half('q', 1)} from c union all select 'low', value, null, null, quality from l""", "attempts")
def recent_analytics(spark, sf_dir):
    return Au.recent_analytics(view(spark, sf_dir, "attempts"))


@query("select total, passed, total - passed as failed, (select reason from issue_reports group by reason order by count(*) desc, min(id) limit 1) as top_reason, (select count(*) as n from issue_reports group by reason order by n desc limit 1) as top_count from (select count(*) filter (where id % 3 <> 0) as total, count(*) filter (where id % 6 = 1) as passed from tasks)", "tasks issue_reports")
def review_stats(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").withColumns({"rhea_reviewed": F.col("id") % 3 != 0, "rhea_passed": F.col("id") % 6 == 1})
    return Au.review_stats(t, view(spark, sf_dir, "issue_reports"))


@query("select count(*) as total, count(*) filter (where success) as ok, count(*) filter (where generation_type <> 'simple') as drafts, floor(1000.0 * ok / greatest(drafts, 1) + 0.5) / 10 as rate from attempts", "attempts")
def overall_success(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    return Au.success_rate(a, F.col("generation_type") != "simple").crossJoin(a.agg(F.count("*").alias("total")))


@query(f"select count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, {half(f'sum({COST_SQL})', 2)} as cost from attempts", "attempts")
def usage_totals(spark, sf_dir):
    return Au.usage_totals(view(spark, sf_dir, "attempts")).select("calls", "input_tokens", "output_tokens", T.half_up(F.col("cost"), 2).alias("cost"))


@query(f"select coalesce((select generation_type from (select generation_type, {half('avg(quality)', 1)} as q from attempts where success and quality > 0 and generation_type <> '' group by 1 having count(*) >= 3) where q > 0 order by q desc, generation_type limit 1), 'self_critique') as generation_type", "attempts")
def recommended_pipeline(spark, sf_dir):
    return Au.recommend(A.best_groups(view(spark, sf_dir, "attempts"), "generation_type"), "generation_type", "self_critique")


@query("select (select count(*) from figures where image_path not in (select image_path from tasks)) as broken, (select count(distinct image_path) from tasks where image_path not in (select image_path from figures)) as orphans, (select count(distinct image_path) from tasks) as files, (select count(*) from figures) as figures", "figures tasks")
def broken_and_orphaned(spark, sf_dir):
    return Au.broken_and_orphaned(view(spark, sf_dir, "figures"), view(spark, sf_dir, "tasks"))


@query("select figure_type, count(*) as n, count(*) filter (where is_suitable) as suitable from figures group by 1", "figures")
def type_counts(spark, sf_dir):
    return Au.type_counts(view(spark, sf_dir, "figures"))


_VERDICT_SQL = "case when starts_with(replace(upper(trim(v)), ' ', '_'), 'NOT_') then 'NOT_SUPPORTED' when starts_with(replace(upper(trim(v)), ' ', '_'), 'UNVERIFI') or starts_with(replace(upper(trim(v)), ' ', '_'), 'CANNOT') then 'UNVERIFIABLE' else 'SUPPORTED' end"


@query(f"with c as (select task_id, run, l_partkey, trim(model_answer) as claim, case l_partkey % 7 when 0 then 'not supported' when 1 then 'Unverifiable' when 2 then 'cannot tell' else 'supported' end as v from answer_reads) select task_id, count(*) as n_claims, coalesce(string_agg(claim, ';' order by run, l_partkey, claim) filter (where {_VERDICT_SQL} <> 'SUPPORTED'), '') as unsupported, case when bool_or({_VERDICT_SQL} <> 'SUPPORTED') then 'fail' else 'pass' end as verdict from c where claim <> '' group by task_id", "answer_reads")
def fact_checks(spark, sf_dir):
    said = F.when(F.col("l_partkey") % 7 == 0, "not supported").when(F.col("l_partkey") % 7 == 1, "Unverifiable").when(F.col("l_partkey") % 7 == 2, "cannot tell").otherwise("supported")
    claims = view(spark, sf_dir, "answer_reads").select("task_id", F.struct("run", "l_partkey").alias("at"), F.col("model_answer").alias("claim"), said.alias("verdict"))
    return Au.fact_check(claims, "task_id").withColumn("unsupported", F.array_join("unsupported", ";"))


@query("select count(*) filter (where age < 3600) as alive, count(*) as total, case when count(*) filter (where age < 3600) > 0 then 'ok' else 'error' end as status from (select worker_id, epoch((select max(created_at) from jobs)) - epoch(max(created_at)) as age from jobs group by 1)", "jobs")
def worker_health(spark, sf_dir):
    j = view(spark, sf_dir, "jobs")
    return Au.worker_health(j.select("worker_id", F.col("created_at").alias("ts")), fresh_s=3600)


@query("select id, cast(step as int) as step, description from (select id, unnest(range(len(d))) as step, unnest(d) as description from (select id, case when difficulty = 'hardest' then case when figure_type = 'chart_graph_text' then " + "[" + ", ".join(map(quoted, Au.CHART_STEPS)) + "] else [" + ", ".join(map(quoted, Au.OBJECT_STEPS)) + "] end else [question] end as d from tasks))", "tasks")
def prompt_steps(spark, sf_dir):
    return Au.split_prompt(view(spark, sf_dir, "tasks").select("id", "difficulty", "figure_type", F.col("question").alias("prompt")))


@query("select id, case when id % 4 = 0 and trim(q) <> '' and trim(a) <> '' then trim(q) else question end as question, case when id % 4 = 0 and trim(q) <> '' and trim(a) <> '' then trim(a) else answer end as answer, coalesce(id % 4 = 0 and trim(q) <> '' and trim(a) <> '', false) as restored from tasks left join (select task_id, arg_max(question, id) as q, arg_max(answer, id) as a from attempts group by 1) x on x.task_id = tasks.id", "tasks attempts")
def restored_tasks(spark, sf_dir):
    t, a = view(spark, sf_dir, "tasks").select("id", "question", "answer"), view(spark, sf_dir, "attempts")
    wanted = a.filter("task_id % 4 = 0").groupBy("task_id").agg(F.max("id").alias("attempt_id"))
    return Au.restore(t, a, wanted).select("id", "question", "answer", "restored")


@query("select id, case when id % 9 = 0 then 'rejected' else status end as status from figures", "figures")
def bulk_rejected(spark, sf_dir):
    f = view(spark, sf_dir, "figures").select("id", "status")
    return Au.set_status(f, f.filter("id % 9 = 0").select("id", F.lit("rejected").alias("status")))


@query("select a.id, a.task_id, case when t.id % 5 = 0 then t.qwen_raw else a.qwen_passes end as qwen_passes, case when t.id % 5 = 0 then t.gemini_passes else a.gemini_passes end as gemini_passes from attempts a left join tasks t on a.task_id = t.id", "attempts tasks")
def submitted_attempts(spark, sf_dir):
    t = tasks_of(spark, sf_dir).withColumns({"rhea_passed": F.lit(True), "rhea_notes": F.lit("ok")})
    chosen = t.filter("id % 5 = 0").select("id", F.lit("p").alias("platform_task_id"))
    _, attempts, _, _ = Au.submit(t, view(spark, sf_dir, "attempts").withColumn("rhea_notes", F.lit("")).withColumn("rhea_passed", F.col("rhea_passed") == 1), chosen, F.lit("2024-01-01").cast("timestamp"))
    return attempts.select("id", "task_id", F.col("qwen_passes").cast("long").alias("qwen_passes"), F.col("gemini_passes").cast("long").alias("gemini_passes"))


@query(f"with l as ({LATEST_SQL}), v as (select id, review_status, difficulty, case when review_status = 'too_easy' then case difficulty when 'hardest' then 'challenging' when 'challenging' then 'easy' else difficulty end when review_status = 'too_hard' then case difficulty when 'easy' then 'challenging' when 'challenging' then 'hardest' else difficulty end else difficulty end as d from tasks join l on l.task_id = tasks.id) select id as task_id, review_status as verdict, d as new_difficulty, d <> difficulty as changed, case when review_status = 'too_easy' then 0.0::double else 1.0::double end as quality_score from v where review_status in ('too_easy', 'too_hard', 'approved')", "tasks submission_logs")
def verdict_events(spark, sf_dir):
    e = Au.verdict_events(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "submission_logs"), F.lit("2024-01-01").cast("timestamp"))
    field = lambda n: F.get_json_object("details", f"$.{n}")
    return e.select("task_id", field("verdict").alias("verdict"), field("new_difficulty").alias("new_difficulty"), (field("difficulty_changed") == "true").alias("changed"), "quality_score")


_JSON = "try_cast(case when json_valid(details) then details end as json)"


@query(f"""select task_id, id, key, json_extract_string(d, '$."' || key || '"') as value
from (select *, unnest(json_keys(d)) as key from (select task_id, id, {_JSON} as d from task_events) where json_type(d) = 'OBJECT')""", "task_events")
def event_details(spark, sf_dir):
    return Au.event_details(view(spark, sf_dir, "task_events"))


@query(f"""with a as (select *, row_number() over (partition by task_id order by created_at desc, id desc) as r from attempts),
e as (select *, {_JSON} as d, row_number() over (partition by task_id order by created_at desc, id desc) as r from task_events)
select task_id, id, 'regeneration' as event_type, strftime(created_at, '%Y-%m-%d %H:%M') as minute, quality, difficulty, question as generated_question, '' as reason, '' as description, '' as old_answer, '' as new_answer, input_tokens + output_tokens as total_tokens,
  cast(0 as bigint) as qwen_passes, cast(0 as bigint) as gemini_passes, false as rhea_passed, case when json_valid(validation_errors) and json_type(validation_errors) = 'ARRAY' then array_to_string(from_json(validation_errors, '["varchar"]'), ';') else '' end as errors, '' as changed_fields, '' as old_values, '' as new_values
from a where r <= 50
union all select task_id, id, event_type, strftime(created_at, '%Y-%m-%d %H:%M'), coalesce(cast(json_extract_string(d, '$.quality') as double), 0), '', '', coalesce(json_extract_string(d, '$.reason'), ''), coalesce(json_extract_string(d, '$.description'), ''), coalesce(json_extract_string(d, '$.old_answer'), ''),
  coalesce(json_extract_string(d, '$.new_answer'), ''), 0, coalesce(cast(json_extract_string(d, '$.qwen_passes') as bigint), 0), coalesce(cast(json_extract_string(d, '$.gemini_passes') as bigint), 0), coalesce(cast(json_extract_string(d, '$.rhea_passed') as boolean), false), '',
  coalesce(array_to_string(from_json(json_extract(d, '$.changed_fields'), '["varchar"]'), ';'), ''), coalesce('answer=' || json_extract_string(d, '$.old_values.answer'), ''), coalesce('answer=' || json_extract_string(d, '$.new_values.answer') || ';question=' || json_extract_string(d, '$.new_values.question'), '')
from e where r <= 50""", "attempts task_events")
def task_histories(spark, sf_dir):
    """All tasks; the lists and maps as text."""
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias(c)
    h = Au.task_history(view(spark, sf_dir, "attempts"), view(spark, sf_dir, "task_events"))
    return h.select("task_id", "id", "event_type", "minute", "quality", "difficulty", "generated_question", "reason", "description", "old_answer", "new_answer", "total_tokens", "qwen_passes", "gemini_passes", "rhea_passed", *(F.array_join(c, ";").alias(c) for c in ("errors", "changed_fields")), pairs("old_values"), pairs("new_values"))


# each turn as a model might wrap it: plain, thought over first, after broken braces, as a number, not at all
_TURN = "replace(replace(replace(substring(text, 1, 80), chr(92), ' '), chr(34), ' '), chr(10), ' ')"
_RESPONSE = f"""case turn % 5 when 0 then 'Sure. ```json' || chr(10) || '{{"question": "' || {_TURN} || '", "answer": "' || role || '"}}```' when 1 then '<think>{{"question": "no", "answer": "no"}} ' || role || '</think> so {{"x": {{"question": "' || {_TURN} || '", "answer": "a }} b"}}}}'
  when 2 then text || ' {{not json {{"broken": "{{' || '"question" {{"question": "' || {_TURN} || '", "answer": 12, "task_type": "spatial"}} ' || text when 3 then text else '{{"question": " ", "answer": 1}} {{"question": "' || {_TURN} || '", "answer": 0.5, "answer_format": "word"}}' end"""


@query(f"""select conv_id, turn, case when turn % 5 = 3 then '' else {_TURN} end as question, case turn % 5 when 0 then role when 1 then 'a }} b' when 2 then '12' when 3 then '' else '0.5' end as answer,
  case turn % 5 when 3 then '' when 4 then 'word' else 'number' end as answer_format, case turn % 5 when 2 then 'spatial' when 3 then '' else 'chart' end as task_type, case when turn % 5 = 1 then '{{"question": "no", "answer": "no"}} ' || role else '' end as reasoning, turn % 5 <> 3 as found
from conversations""")
def drafts_in_responses(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", parse_draft(F.expr(_RESPONSE)).alias("p")).select("conv_id", "turn", "p.*")


# ---- transitions and state --------------------------------------------------------
@query(f"with l as ({LATEST_SQL}) select id, difficulty, case when review_status = 'too_easy' then case difficulty when 'hardest' then 'challenging' when 'challenging' then 'easy' else difficulty end when review_status = 'too_hard' then case difficulty when 'easy' then 'challenging' when 'challenging' then 'hardest' else difficulty end else difficulty end as new_difficulty from tasks left join l on l.task_id = tasks.id", "tasks submission_logs")
def verdict_shift(spark, sf_dir):
    return Tr.apply_verdicts(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "submission_logs")).select("id", "difficulty", "new_difficulty")


@query("select id, 'status' as field, status as old_value, 'archived' as new_value from tasks where id % 5 = 0 and status <> 'archived' union all select id, 'answer', answer, '12' from tasks where id % 5 = 0 and answer <> '12'", "tasks")
def change_capture(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").select("id", "status", "answer")
    return Tr.changes(t, t.filter("id % 5 = 0").withColumns({"status": F.lit("archived"), "answer": F.lit("12")}), "id", ["status", "answer"])


@query("select id, task_id from attempts where task_id not in (select id from tasks where id % 3 = 0)", "attempts tasks")
def delete_cascade(spark, sf_dir):
    return Tr.delete_cascade(view(spark, sf_dir, "attempts"), view(spark, sf_dir, "tasks").filter("id % 3 = 0")).select("id", "task_id")


_STATUS = "case when event_type = 'error' and user_id % 4 = 1 then 'cancelled' when event_type = 'purchase' and user_id % 4 = 2 then 'done' when event_type = 'click' then 'failed' else 'running' end"


@query(f"with e as (select user_id, ts, event_id, {_STATUS} as s from events) select user_id as job_id, case when bool_or(s in ('cancelled', 'done')) then arg_min(s, (ts, event_id)) filter (where s in ('cancelled', 'done')) when arg_max(s, (ts, event_id)) = 'failed' and count(*) filter (where s = 'failed') < 9 then 'queued' else arg_max(s, (ts, event_id)) end as state, count(*) filter (where s = 'failed') as failures from e group by user_id")
def job_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.expr(_STATUS)
    return Tr.job_states(e.select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.lit(9).alias("max_attempts")))


def _job_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.expr(_STATUS).alias("status"), F.lit(9).cast("long").alias("max_attempts"), F.col("ts").cast("timestamp").alias("ts"))


#: Log rows in a bucket of a stream's state.
_BUCKET = 4000
_SILENT_S, _AS_OF = 12 * 3600, "2025-01-01 00:00:00"
_TRANSITIONS_SQL = f"""with e as (select user_id as job_id, event_id as id, ts, {_STATUS} as status from events),
c as (select *, count(*) filter (where status = 'failed') over w as failures, first_value(case when status in ('done', 'cancelled') then status end ignore nulls) over w as ended, lead(ts) over (partition by job_id order by ts, id) as next
  from e window w as (partition by job_id order by ts, id rows unbounded preceding)),
s as (select *, case when ended is not null then ended when status = 'failed' and failures < 9 then 'queued' else status end as state, ts + interval {_SILENT_S} second as lost_at from c),
l as (select *, state = 'running' and case when next is null then lost_at <= timestamp '{_AS_OF}' else next > lost_at end as lost from s),
b as (select *, lag(case when lost then 'queued' else state end) over (partition by job_id order by ts, id) as before from l)
select job_id, ts, id, before as old_state, state as new_state, failures, false as silent from b where before is distinct from state
union all select job_id, lost_at, id, state, 'queued', failures, true from b where lost"""


@query(_TRANSITIONS_SQL)
def job_transitions(spark, sf_dir):
    return Qu.transitions(_job_log(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"), _SILENT_S)


@query(_TRANSITIONS_SQL)
def job_transition_stream(spark, sf_dir):
    """The same rows from a stream over the log in files of mixed times, stopped and started again from its checkpoint."""
    home = f"{run_folder(spark)}/job-stream-{uuid.uuid4().hex}"
    log = _job_log(spark, sf_dir)
    buckets = 1 + log.count() // _BUCKET
    # beyond all times, so that the watermark passes _AS_OF once the log is through
    end = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.col("id"), F.lit("queued").alias("status"), F.lit(1).cast("long").alias("max_attempts"), (F.lit(_AS_OF).cast("timestamp") + F.expr("interval 400 days")).alias("ts"))
    for part in (log.repartition(6, "id"), end):
        part.write.mode("append").parquet(f"{home}/log")
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/log")
        Qu.transition_stream(source, "400 days", _SILENT_S, buckets).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(Qu.TRANSITION).parquet(f"{home}/out")


@query("""with j as (select id, row_number() over (order by priority desc, created_at, id) as place from jobs where status = 'queued'),
p as (select event_id as poll_id, user_id % 6 as worker_id, row_number() over (order by ts, event_id) as place from events where event_type = 'purchase')
select id as job_id, worker_id, poll_id from j join p using (place)""", "jobs")
def assigned_jobs(spark, sf_dir):
    """Jobs given to polls that come in four micro-batches, the stream started anew for each."""
    home = f"{run_folder(spark)}/assign-{uuid.uuid4().hex}"
    polls = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("poll_id"), (F.col("user_id") % 6).alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    for quarter in range(4):
        polls.filter(F.least(F.floor((F.dayofyear("ts") - 1) / 8), F.lit(3)) == quarter).write.mode("append").parquet(f"{home}/polls")
        source = spark.readStream.schema(polls.schema).parquet(f"{home}/polls")
        Qu.assign_stream(source, view(spark, sf_dir, "jobs"), f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return Qu.assignments(spark, f"{home}/out").drop("batch")


@query("select id, worker_id from jobs where status = 'running' and worker_id not in (1, 3)", "jobs")
def stale_jobs(spark, sf_dir):
    return Tr.stale_jobs(view(spark, sf_dir, "jobs"), spark.createDataFrame([(1,), (3,)], "worker_id long")).select("id", "worker_id")


@query("with p as (select p_brand as name, cast(row_number() over (partition by p_brand order by p_partkey) as int) as version, p_name as text from part), r as (select name, max(version) + 1 as version, arg_min(text, version) as text from p where name in (select distinct p_brand from part where p_size > 48) group by name) select * from p union all select * from r")
def prompt_versions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("version"), F.col("p_name").alias("text"))
    big = table(spark, sf_dir, "part").filter("p_size > 48").select(F.col("p_brand").alias("name")).distinct()
    return Tr.next_versions(p, p.filter("version = 1").join(big, "name", "left_semi").select("name", "text"))


@query("select user_id, props from (select user_id, string_agg(event_type || '=' || v, ';' order by event_type) as props from (select user_id, event_type, max(cast(cast(floor(value) as bigint) as varchar)) as v from events group by 1, 2) group by user_id)")
def preferences_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.floor("value").cast("long").cast("string").alias("value"))
    m = A.map_of(e, "user_id", "key", "value")
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("preferences")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("props"))


@query("select id, image_path from (select f.*, bool_or(id in (select figure_id from tasks)) over (partition by image_path) as any_used, min(id) over (partition by image_path) as first from figures f where filesize_bytes >= 5000) where id in (select figure_id from tasks) or (not any_used and id = first)", "figures tasks")
def clean_library(spark, sf_dir):
    return Tr.clean_library(view(spark, sf_dir, "figures"), view(spark, sf_dir, "tasks")).select("id", "image_path")


@query("""with a as (select *, id % 17 = 5 as cut, id % 19 = 4 as odd from attempts)
select model_name as model, difficulty, success as ok, count(*) as n, round(sum(floor(elapsed_ms / 1000.0 * 10 + 0.5) / 10), 1) as seconds, cast(max(length(substring(validation_errors || question, 1, 100))) as int) as longest_error, false as broken from a where not cut and not odd group by 1, 2, 3
union all select '', '', null, count(*), null, null, true from a where cut or odd""", "attempts")
def stored_telemetry(spark, sf_dir):
    """All attempts as telemetry lines, some cut short and some of the wrong type, streamed into a store in several batches with a restart."""
    home = f"{run_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    a = view(spark, sf_dir, "attempts")
    fields = F.struct(F.col("created_at").cast("string").alias("ts"), F.col("model_name").alias("model"), F.col("success").alias("ok"), (F.col("elapsed_ms") / 1000.0).alias("elapsed_s"), "difficulty", "figure_type", F.concat("validation_errors", "question").alias("error"))
    line = F.to_json(fields)
    line = F.when(F.col("id") % 19 == 4, F.regexp_replace(line, r'"ok":(true|false)', '"ok":"maybe"')).otherwise(line)
    line = F.when(F.col("id") % 17 == 5, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    lines = a.select("id", F.explode(F.array(line, F.lit(" "))).alias("value"))
    for half_ in (0, 1):
        lines.filter(F.col("id") % 2 == half_).select("value").repartition(3).write.mode("append").text(f"{home}/log")
        Lo.store_log(Lo.telemetry(Lo.log_lines(spark, f"{home}/log", IO.TELEMETRY, maxFilesPerTrigger=2)), f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows, rescued = Lo.stored_log(spark, f"{home}/out", IO.TELEMETRY)
    good = rows.groupBy("model", "difficulty", "ok").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_s"), 1).alias("seconds"), F.max(F.length("error")).alias("longest_error")).withColumn("broken", F.lit(False))
    return good.union(rescued.agg(F.count("*").alias("n")).select(F.lit(""), F.lit(""), F.lit(None).cast("boolean"), "n", F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(True)))


_LIMIT_SQL = """with recursive h as (select user_id as key, event_id as id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
walk as (
  select key, n, id, [ts] as held, true as accepted from h where n = 1
  union all
  select key, n, id, case when len(live) <= 3 then list_append(live, ts) else live end, len(live) <= 3
  from (select h.*, list_filter(w.held, lambda t: h.ts - t < interval 24 hour) as live from walk w join h on h.key = w.key and h.n = w.n + 1))
select id, key, accepted from walk"""


def _hits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


@query(_LIMIT_SQL)
def rate_limit(spark, sf_dir):
    return St.rate_limit(_hits(spark, sf_dir), 24 * 3600, 3)


@query(_LIMIT_SQL)
def rate_limit_stream(spark, sf_dir):
    """The same rows from a stream over the hits in files of mixed times, stopped and started again from its checkpoint."""
    home = f"{run_folder(spark)}/limit-{uuid.uuid4().hex}"
    hits = _hits(spark, sf_dir)
    buckets = 1 + hits.count() // _BUCKET
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("key"), (F.lit(_AS_OF).cast("timestamp") + F.expr("interval 400 days")).alias("ts"))
    for part in (hits.repartition(6, "id"), end):
        part.write.mode("append").parquet(f"{home}/hits")
        source = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/hits")
        St.rate_limit_stream(source, 24 * 3600, 3, "400 days", buckets).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(St.LIMITED).parquet(f"{home}/out")


@query("""with r as (select user_id % 10 as worker_id, ts from events where event_type = 'error'),
g as (select *, sum(cast(coalesce(ts - before > interval 1800 second, true) as int)) over (partition by worker_id order by ts rows unbounded preceding) as run from (select *, lag(ts) over (partition by worker_id order by ts) as before from r)),
k as (select worker_id, run, count(*) as k from g group by all)
select worker_id, cast(sum(k) as bigint) as n, max(k) as longest, max(k) >= 5 as looped from k group by worker_id""")
def crash_loops(spark, sf_dir):
    r = table(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("user_id") % 10).alias("worker_id"), "ts")
    return St.crash_loops(r, 5, 1800)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def hourly_counts(spark, sf_dir):
    return St.windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with g as (select user_id, ts, sum(case when prev is null or ts - prev >= interval 12 hour then 1 else 0 end) over (partition by user_id order by ts) as s from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events)) select user_id, min(ts) as start, max(ts) + interval 12 hour as \"end\", count(*) as n from g group by user_id, s")
def user_sessions(spark, sf_dir):
    return St.sessions(table(spark, sf_dir, "events"), "12 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select n_name as nation, count(*) as n_orders, count(distinct o_custkey) as customers from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name")
def orders_by_nation(spark, sf_dir):
    """A three-way join for the star schema: the two dimension sides are left to Catalyst's size estimate."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("customers"))


from . import authoring_queries  # noqa: E402, F401  adds its queries to QUERIES
