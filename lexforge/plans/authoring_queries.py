"""Queries of authoring: transitions with all their results, projections, preferences, verdict sources, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.functions import text as T
from lexforge.operators import analytics as A
from lexforge.operators import authoring as Au
from lexforge.operators import figures as Fig
from lexforge.operators import relational as Rel
from lexforge.operators import search as S
from lexforge.operators import transitions as Tr
from lexforge.sources import io as IO
from lexforge.sources.domain import table, view

from .queries import half, query, quoted

AT = "2025-01-01 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp")


def _tagged(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Results of a transition below each other, as (part, id, value)."""
    frames = [df.select(F.lit(name).alias("part"), F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value")) for name, df in parts]
    return Rel.padded_union(*frames)


# ---- transitions --------------------------------------------------------------------
@query("""select t.id, case when t.id % 3 = 0 or t.q = '' then coalesce(f.caption, '') else t.q end as title, coalesce(nullif(t.image_path, ''), f.image_path, '') as image_path, 'draft' as status
from (select *, question as q from tasks) t left join figures f on f.id = t.figure_id""", "tasks figures")
def created_tasks(spark, sf_dir):
    drafts = view(spark, sf_dir, "tasks").select("id", "figure_id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("question")).alias("title"), "image_path")
    return Tr.create_tasks(drafts, view(spark, sf_dir, "figures")).select("id", "title", "image_path", "status")


@query("""select 'attempts' as part, id, cast(task_id as varchar) as value from attempts where task_id % 4 <> 1
union all select 'issues', id, cast(task_id as varchar) from issue_reports where task_id % 4 <> 1
union all select 'logs', task_id, cast(count(*) as varchar) from submission_logs where task_id % 4 <> 1 group by task_id
union all select 'events', task_id, cast(count(*) as varchar) from task_events group by task_id""", "attempts issue_reports submission_logs task_events")
def delete_cascades(spark, sf_dir):
    """Three child tables go with their tasks, events stay."""
    gone = view(spark, sf_dir, "attempts").select(F.col("task_id").alias("id")).union(view(spark, sf_dir, "submission_logs").select("task_id")).filter("id % 4 = 1")
    left = lambda name: Tr.delete_cascade(view(spark, sf_dir, name), gone)
    counted = lambda df: df.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("value"))
    return _tagged(("attempts", left("attempts").withColumn("value", F.col("task_id"))), ("issues", left("issue_reports").withColumn("value", F.col("task_id"))), ("logs", counted(left("submission_logs"))), ("events", counted(view(spark, sf_dir, "task_events"))))


@query(f"""with t as (select id, status, id % 2 = 0 as passed, substring('noted ' || caption, 1, 500) as notes, greatest(qwen_raw, 0) as q, gemini_passes as g, id % 5 = 2 as on_ from tasks)
select 'task' as part, id, case when on_ then 'submitted 2025-01-01' else status || ' ' end as value from t
union all select 'attempt', a.id, case when coalesce(on_, false) then passed || ' ' || notes || ' ' || q || ' ' || g else (a.rhea_passed = 1) || '  ' || a.qwen_passes || ' ' || a.gemini_passes end from attempts a left join t on t.id = a.task_id
union all select 'log', id, '2025-01-01 ' from t where on_
union all select 'event', id, 'submit {{"qwen_passes":' || q || ',"gemini_passes":' || g || ',"total_runs":' || (q + g) || '}}' from t where on_""", "tasks attempts")
def submitted(spark, sf_dir):
    """All four results of a submission."""
    t = view(spark, sf_dir, "tasks").select("id", "status", (F.col("id") % 2 == 0).alias("rhea_passed"), F.concat(F.lit("noted "), "caption").alias("rhea_notes"), F.greatest("qwen_raw", F.lit(0)).alias("qwen_passes"), "gemini_passes")
    a = view(spark, sf_dir, "attempts").select("id", "task_id", (F.col("rhea_passed") == 1).alias("rhea_passed"), F.lit("").alias("rhea_notes"), "qwen_passes", "gemini_passes")
    chosen = t.filter("id % 5 = 2").select("id", F.concat(F.lit("p"), "id").alias("platform_task_id"))
    tasks, attempts, logs, events = Au.submit(t, a, chosen, _at())
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return _tagged(
        ("task", tasks.withColumn("value", F.concat_ws(" ", "status", day("submitted_at")))), ("attempt", attempts.withColumn("value", F.concat_ws(" ", F.col("rhea_passed").cast("string"), "rhea_notes", F.col("qwen_passes").cast("string"), F.col("gemini_passes").cast("string")))),
        ("log", logs.select(F.col("task_id").alias("id"), F.concat_ws(" ", day("submitted_at"), "review_status").alias("value"))), ("event", events.select(F.col("task_id").alias("id"), F.concat_ws(" ", "event_type", "details").alias("value"))),
    )


@query("select id, case when q > 0 then 'easy' when g > 0 then 'challenging' else 'hardest' end as difficulty, q + g as total_runs from (select id, greatest(qwen_raw, 0) as q, gemini_passes as g from tasks)", "tasks")
def set_difficulties(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").select("id", F.greatest("qwen_raw", F.lit(0)).alias("qwen_passes"), "gemini_passes")
    return Tr.set_difficulty(t).select("id", "difficulty", "total_runs")


@query("select doc_id as id, substring(text, 1, 500) as description, substring(source || text, 1, 100) as corrected_answer from documents")
def reported_issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.concat("source", "text").alias("corrected_answer"))
    return Tr.report_issues(d)


@query("""with c as (select task_id as id, max((value > 12)::int) as match, max((event_type = 'update')::int) as confirmed from task_events where event_type in ('check_answer', 'update') group by 1)
select t.id, case when match = 1 then false when match = 0 and confirmed = 0 then true else t.id % 2 = 0 end as golden_suspect from tasks t left join c using (id)""", "tasks task_events")
def golden_suspects(spark, sf_dir):
    e = view(spark, sf_dir, "task_events").filter("event_type in ('check_answer', 'update')").select("task_id", (F.col("value") > 12).alias("match"), (F.col("event_type") == "update").alias("golden_correct"))
    return Tr.golden_suspect(view(spark, sf_dir, "tasks").select("id", (F.col("id") % 2 == 0).alias("golden_suspect")), e)


@query("""with r as (select id, id % 2 = 0 as passed, caption as notes, id % 3 = 0 as over from tasks where id % 5 < 3)
select t.id, case when r.id is not null and not over then true end as rhea_reviewed, r.passed as rhea_passed, case when not over then r.notes end as rhea_notes, case when over then r.notes end as rhea_override_notes from tasks t left join r using (id)""", "tasks")
def reviewed_tasks(spark, sf_dir):
    t = view(spark, sf_dir, "tasks")
    r = t.filter("id % 5 < 3").select("id", (F.col("id") % 2 == 0).alias("passed"), F.col("caption").alias("notes"), (F.col("id") % 3 == 0).alias("override"))
    return Au.review(t.select("id"), r)


@query("""with l as (select *, row_number() over (order by task_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as id from submission_logs),
m as (select id as task_id, case when id % 2 = 0 then 'approved' else 'rework' end as s, 'marked ' || id as n from tasks where id % 6 = 0),
w as (select *, row_number() over (partition by task_id order by submitted_at desc, id desc) = 1 as newest from l)
select 'task' as part, t.id, coalesce(m.s, t.status) as value from tasks t left join m on m.task_id = t.id
union all select 'log', w.id, coalesce(case when newest then s end, review_status) || ' ' || coalesce(case when newest then n end, '') from w left join m using (task_id)""", "tasks submission_logs")
def marked_statuses(spark, sf_dir):
    logs = Rel.placed(view(spark, sf_dir, "submission_logs"), [F.col(c) for c in ("task_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], "id").withColumn("reviewer_notes", F.lit(""))
    t = view(spark, sf_dir, "tasks").select("id", "status")
    marks = t.filter("id % 6 = 0").select(F.col("id").alias("task_id"), F.when(F.col("id") % 2 == 0, "approved").otherwise("rework").alias("status"), F.concat(F.lit("marked "), "id").alias("notes"))
    tasks, touched = Au.mark_status(t, logs, marks.union(marks))
    return _tagged(("task", tasks.withColumn("value", F.col("status"))), ("log", touched.withColumn("value", F.concat_ws(" ", "review_status", "reviewer_notes"))))


@query("""with o as (select user_id, event_type as key, cast(cast(floor(max(value)) as bigint) as varchar) as value from events where event_id % 3 <> 0 group by 1, 2),
n as (select user_id, event_type as key, 'new' as value from events where event_id % 3 = 0 group by 1, 2)
select * from n union all select * from o where (user_id, key) not in (select user_id, key from n)""")
def upserted_preferences(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "key")
    old = e.filter("event_id % 3 <> 0").groupBy("user_id", "key").agg(F.floor(F.max("value")).cast("long").cast("string").alias("value"))
    return Tr.upsert(old, e.filter("event_id % 3 = 0").select("user_id", "key").distinct().withColumn("value", F.lit("new")), ["user_id", "key"])


# ---- roll-ups -----------------------------------------------------------------------
@query("""with r as (select task_id, run, trim(model_answer) as answer, row_number() over (partition by task_id order by run, trim(model_answer)) as rank, count(*) over (partition by task_id) as n from answer_reads
  where trim(model_answer) <> '' and not (case when answer_format = 'word' then lower(trim(model_answer)) = lower(golden)
    else coalesce(try_cast(replace(replace(trim(model_answer), '%', ''), ',', '') as double) = try_cast(golden as double), lower(trim(model_answer)) = lower(golden)) end))
select task_id, any_value(n) as n, string_agg(answer, '|' order by rank) filter (rank <= 3) as answers from r group by task_id""", "answer_reads")
def diverging_answers(spark, sf_dir):
    return A.diverging(view(spark, sf_dir, "answer_reads")).withColumn("answers", F.array_join("answers", "|"))


@query("""select count(*) as total, count(*) filter (where validation_is_valid) as valid, any_value(c) as checked, any_value(p) as passed from attempts,
(select count(*) filter (where a > 0) as c, count(*) filter (where a > 0 and o = 0) as p from (select task_id, count(*) filter (where event_type <> 'signup') as a, count(*) filter (where event_type = 'error') as o from (select user_id as task_id, event_type from events) group by 1))""", "attempts")
def evaluation_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "signup").alias("a"), F.count_if(F.col("event_type") == "error").alias("o"))
    return Au.evaluation_totals(view(spark, sf_dir, "attempts").select(F.col("validation_is_valid").alias("is_valid")), e.select((F.col("a") > 0).alias("checked"), ((F.col("a") > 0) & (F.col("o") == 0)).alias("deterministic")))


@query("select task_id, 'logs' as source, review_status as verdict from submission_logs union all select task_id, 'events', case when value > 12 then 'pass' else 'fail' end from task_events where event_type = 'check_answer'", "submission_logs task_events")
def verdict_sources(spark, sf_dir):
    logs = lambda s: view(s, sf_dir, "submission_logs").select("task_id", F.lit("logs").alias("source"), F.col("review_status").alias("verdict"))
    checks = lambda s: view(s, sf_dir, "task_events").filter("event_type = 'check_answer'").select("task_id", F.lit("events").alias("source"), F.when(F.col("value") > 12, "pass").otherwise("fail").alias("verdict"))
    return Au.all_verdicts(spark, [logs, checks])


# ---- projections and texts ----------------------------------------------------------
@query("select id, case when length(question) > 30 then substring(question, 1, 30) || '...' else question end as title, substring(answer, 1, 5) as answer, case when length(caption) > 12 then substring(caption, 1, 12) || '…' else caption end as caption from tasks", "tasks")
def listed_tasks(spark, sf_dir):
    return view(spark, sf_dir, "tasks").select("id", T.shortened(F.col("question"), 30).alias("title"), T.shortened(F.col("answer"), 5, "").alias("answer"), T.shortened(F.col("caption"), 12, "…").alias("caption"))


_LINE = "case doc_id % 7 when 0 then 'Figure ' || doc_id || ': ' || source when 1 then 'as fig. ' || doc_id || 'b shows' when 2 then 'Fig ' || doc_id || '.5 ' || source when 3 then source || ' of the long and winding road, FIGURE ' || doc_id when 4 then 'see, figure ' || doc_id || ': : more' when 5 then 'X Figure.' || doc_id || 'a' else substring(text, 1, 60) end"


@query(f"""with l as (select doc_id, {_LINE} as line from documents),
m as (select doc_id, line, regexp_extract(line, '(?i)fig(?:ure)?\\.?\\s*(\\d+(?:\\.\\d+)?[a-z]?)', 1) as number, regexp_extract(line, '(?is)^(.*?)fig(?:ure)?\\.?\\s*\\d+(?:\\.\\d+)?[a-z]?\\s*[:.]?\\s*', 1) as head, regexp_extract(line, '(?is)^.*?fig(?:ure)?\\.?\\s*\\d+(?:\\.\\d+)?[a-z]?\\s*[:.]?\\s*(.*)$', 1) as rest from l)
select doc_id, case when number <> '' and not ((regexp_matches(trim(head), '[\\p{{Ll}}.,;]$') or length(head) > 30) and not starts_with(rest, ':')) then number end as caption_of, regexp_extract(lower(line), '(?:fig(?:ure)?\\.?\\s*)(\\d+(?:\\.\\d+)?[a-z]?)', 1) as figure_number,
  source || '@' || substring(sha256(coalesce(text, '')), 1, 12) as content_id from m join documents using (doc_id)""")
def caption_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("line", F.expr(_LINE))
    return d.select("doc_id", T.caption_figure(F.col("line")).alias("caption_of"), T.figure_number(F.col("line")).alias("figure_number"), T.content_id(F.col("source"), F.coalesce("text", F.lit(""))).alias("content_id"))


@query("""select id, case when difficulty = 'easy' then 'simple' when difficulty = 'hardest' then 'self_critique' else 'rag_enhanced' end as pipeline, difficulty <> 'easy' as use_rag, difficulty = 'hardest' as use_consensus, difficulty = 'hardest' or (difficulty <> 'easy' and complexity_score >= 0.7) as use_self_critique,
  case when difficulty = 'hardest' then 3 end as n_attempts, case when difficulty = 'hardest' then 2 when difficulty <> 'easy' and complexity_score >= 0.7 then 1 end as max_rounds,
  case when figure_type = 'general_image' then 'SPATIAL_' else '' end || case when id % 6 = 0 then 'REGEN_PROMPT' when difficulty = 'hardest' then 'HARDEST_PROMPT' when difficulty = 'challenging' then 'CHALLENGING_PROMPT' when difficulty = 'easy' and figure_type <> 'general_image' then 'EASY_PROMPT' else 'DRAFT_PROMPT' end as template
from attempts""", "attempts")
def route_fields(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").withColumn("r", T.route(F.col("difficulty"), F.col("complexity_score")))
    return a.select("id", "r.*", T.prompt_template(F.col("difficulty"), F.col("figure_type"), F.when(F.col("id") % 6 == 0, "again").otherwise("")).alias("template"))


_CONTEXT = "case when id % 4 = 0 then '' when id % 4 = 1 then 'Errors: ' || validation_errors || '; Trick answer | Warnings: bad image' when id % 4 = 2 then 'Errors: Trick answer; Answer too long' else 'Warnings: none' end"


@query(f"select id, case when trim(p) = '' then false else len(list_filter(string_split(p, ';'), x -> not ({' or '.join(f'contains(trim(x), {quoted(w)})' for w in P.FORMAT_ONLY_ERRORS)}))) = 0 end as format_only from (select id, replace(split_part(split_part({_CONTEXT}, ' | ', 1), 'Warnings:', 1), 'Errors: ', '') as p from attempts)", "attempts")
def format_only_errors(spark, sf_dir):
    return view(spark, sf_dir, "attempts").select("id", T.format_only_error(F.expr(_CONTEXT)).alias("format_only"))


# ---- preferences, collections, caches ----------------------------------------------
@query("""with u as (select user_id, max(event_type) as m, min(event_type) as d, max(event_id) % 2 = 0 as styled from events group by user_id)
select c_custkey as user_id, case when c_custkey % 2 = 0 and m is not null then 'preferred_difficulty=' || d || ';preferred_model=' || m || case when styled then ';prompt_style=terse' else '' end || ';tone=dry;user_unit=mm' else 'preferred_model=base;tone=dry' end as config
from customer left join u on u.user_id = c_custkey""")
def preferred_configs(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_type").alias("preferred_model"), F.min("event_type").alias("preferred_difficulty"), F.when(F.max("event_id") % 2 == 0, "terse").otherwise("default").alias("prompt_style")).filter("user_id % 2 = 0")
    configs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.create_map(F.lit("tone"), F.lit("dry"), F.lit("preferred_model"), F.lit("base")).alias("config"))
    preferences = users.select("user_id", F.create_map(F.lit("unit"), F.lit("mm")).alias("preferences"))
    out = Au.with_preferences(configs, users, preferences)
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("config"))


@query("""select d.doc_id as id, substring(sha256(coalesce(text, '')), 1, 16) as entry, '1735689600' as cached_at, lang as task_type, '' as question from documents d where lang = 'en' and doc_id not in (select doc_id from documents where doc_id % 8 = 1)""")
def cached_entries(spark, sf_dir):
    """Results put into a cache by their prompts' hashes, some taken out, then found by their metadata; internal columns stay inside."""
    d = table(spark, sf_dir, "documents")
    results = d.select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"), F.col("doc_id").alias("figure_id"), F.lit(None).cast("string").alias("question"), F.lit("1").alias("answer"), F.lit("").alias("answer_format"), F.col("lang").alias("task_type"), F.array(F.lit(1.0)).alias("embedding"))
    entries = IO.cache_entries(results, _at())
    taken = results.filter("doc_id % 8 = 1").select(F.col("doc_id").cast("string").alias("figure_id"))
    left = Rel.without(entries.withColumn("_figure", F.col("metadata")["figure_id"]), taken, "_figure", "figure_id")
    found = IO.by_metadata(left, {"task_type": "en"})
    return IO.public_fields(found.select(F.col("_figure"), F.col("_figure").cast("long").alias("id"), F.col("id").alias("entry"), *(F.col("metadata")[k].alias(k) for k in ("cached_at", "task_type", "question"))))


@query(f"""with p as (select label, embedding as e from embeddings where vec_id % 40 = 1 and label <> 2),
s as (select v.vec_id, p.label, avg(list_cosine_similarity(cast(v.embedding as double[]), cast(p.e as double[]))) as s from embeddings v, p where v.vec_id % 9 <> 4 group by 1, 2),
b as (select vec_id, arg_max(label, (s, -label)) as label, max(s) as s from s group by 1)
select v.vec_id, cast(case when b.s > 0 then b.label else v.vec_id % 3 end as int) as class, case when b.s > 0 then {half("b.s", 3)} when b.vec_id is not null then 0 else 0.25 end as confidence, case when b.vec_id is null then 'heuristic' else 'cnn' end as method from embeddings v left join b using (vec_id)""")
def classified(spark, sf_dir):
    """By prototypes of all classes but one; a ninth of the figures have no embedding."""
    v = table(spark, sf_dir, "embeddings")
    f = v.select("vec_id", F.when(F.col("vec_id") % 9 != 4, F.col("embedding")).alias("embedding"), (F.col("vec_id") % 3).cast("int").alias("heuristic"), F.lit(0.25).alias("heuristic_confidence"))
    return S.classify(f, v.filter("vec_id % 40 = 1 and label <> 2").select("label", F.col("embedding").alias("p"))).withColumn("class", F.col("class").cast("int"))


@query("""select id, w = 0 or h = 0 or greatest(w / h, h / w) > 5 or v < 30 as banner, (w = h and w < 200) or n < 5 as logo, v < 2000 and (t > 5 or v < 200) as text_only
from (select p_partkey as id, p_size * 20.0 as w, (p_partkey % 60) * 20.0 as h, p_partkey % 40 as n, (p_partkey * 31) % 3000 as v, (p_partkey % 90) / 10.0 as t from part)""")
def rejected_pictures(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_size * 20D as width", "(p_partkey % 60) * 20D as height", "p_partkey % 40 as n_colors", "(p_partkey * 31) % 3000 as gray_variance", "(p_partkey % 90) / 10D as transitions")
    return Fig.rejects(p).select("id", "banner", "logo", "text_only")


@query("""with d as (select doc_id as id, coalesce(text, '') as content, list_distinct(list_filter(string_split_regex(trim(lower(coalesce(text, ''))), '\\s+'), x -> x <> '')) as w from documents)
select id, len(list_intersect(['the', 'of', 'and', 'der'], w)) / 4 as rerank from d order by rerank desc, id limit 12""")
def reranked(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    return S.rerank(d, "the of and der", 12).select("id", "rerank")
