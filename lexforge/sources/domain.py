"""Authoring tables derived from the star schema, as one SQL text each.

The texts hold no operator of the library; they only make inputs. They are valid in
Spark SQL and DuckDB once the few marked places are rendered for the dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Questions that between them reach every strategy class and rule.
QUESTIONS = [
    "How many bars are visible in the chart?",
    "What is the value of the red line in panel (a) and panel (b)?",
    "Which panel has the higher peak compared with the left curve?",
    "By what percentage increase did the total of column A exceed column B?",
    "Rank the lines by the number of crossings above 40 in the figure.",
    "What is the difference between the maximum of the left panel and the minimum of the right panel?",
    "Is the blue line higher or lower than the red line?",
    "Explain how the gradient changes.",
    "What does this say",
    "Out of the 3 objects which is closest to the top left corner?",
    "Count the circles and squares then add the numbers.",
    "what is the sum of the x-axis value and the y-axis value  in the plot?",
    "Which one has the label? Which one has the title? Where is the legend?",
    "What is the hybridization of the carbon in the diagram?",
    "The axis covers from 0 to 10 and the axis covers from 5 to 20. What is the ratio of the axis ranges in the chart?",
    "The values are 10, 20 and 30 in the table. What is the sum of the values?",
    "Count the tick labels on the x axis of the chart.",
    "Which index has the largest decline and what is the percentage drop in the graph?",
    "How many positions does the second bar rise when ranked by height across all groups?",
    "Which panel shows fewer than 5 points between 3 nm and 9 nm?",
    "Choose between red or blue for the marked tile.",
    "What is written on the title?",
    "The one that is red and is above the line, how many?",
    "Identify the node that meets the threshold in the diagram.",
    "What is the name of the highlighted cell?",
    "Does the curve go up or down at x = 3 in figure 2?",
    "Average the top row and the bottom row of the grid.",
    "Which color is steeper, relative to the axis, in panel (c) versus panel (d)?",
    "",
]
ANSWERS = ["12", "1,204", "20%", "blue", "higher", "yes", "none", "a very long answer of more than four words", "3.5", "0", "2500000", "highest", "left", "varies", "red, green, blue and black", "unclear", "-3", "", "10", "5.0 ms", "an answer that goes on and on for rather longer than fifty characters in all"]
FORMATS = ["number", "integer", "percent", "word", "phrase", ""]
CAPTIONS = ["", "A bar chart of counts.", "Growth was 4.5 in the second year.", "This caption is very long and describes every value that can be seen in the figure, one after the other, in so much detail that nobody would need to look at the image itself at all to answer."]
OPTIONS = ["", "red|green|blue", "1|2|3|4|5|6|7|8", "a|b|c|d|e|f|g|none"]
PATHS = ["fig/a.png", "fig/shutterstock_watermark.png", "", "img/getty.jpg"]
TITLES = ["graph", "neural networks for image synthesis", "Deep learning survey", "graphs and networks", "quantum error correction", "Bayesian inference, at scale", "protein folding with attention", "vision transformers", "a note on p-adic graph theory", "economics of networks"]
CATEGORIES = ["cs.LG stat.ML", "math.NT", "q-bio.BM cs.CV", "econ.GN", "quant-ph", "cs.CV", "physics.optics astro-ph.GA", "stat.ME"]


def _pick(values: list[str], index: str) -> str:
    """SQL for the (index modulo size)-th of fixed values."""
    return f"split_part('{'~'.join(values)}', '~', cast(1 + ({index}) % {len(values)} as int))"


def _div(a: str, n: int) -> str:
    return f"cast(floor({a} / {n}.0) as bigint)"


JSON = "<json>"  # rendered as the dialect's access to $.k of props
VIEWS = {
    "attempts": f"""
select event_id as id, user_id as task_id, event_id % 500 as figure_id, ts as created_at, event_type <> 'error' as success,
  case when event_id % 11 = 0 then 0.0 when event_id % 11 = 1 then 80.0 + event_id % 20 else cast(floor(value * 2) / 10.0 as double) end as quality,
  case event_type when 'view' then 'minimax-m3' when 'click' then 'GPT-5-codex' when 'purchase' then 'claude-sonnet-4' when 'error' then 'gemini-2.5-flash' else '' end as model_name,
  {_pick(["simple", "rag_enhanced", "consensus", "self_critique", "rare"], "case when event_id % 997 = 0 then 4 else event_id % 4 end")} as generation_type,
  {_pick(["easy", "challenging", "hardest", ""], "event_id")} as difficulty, {_pick(["chart_graph_text", "general_image", ""], _div("event_id", 4))} as figure_type,
  {JSON} * 7 as input_tokens, {JSON} * 3 as output_tokens, case when event_id % 5 = 0 then 0 else {JSON} * 10 + event_id % 7 end as elapsed_ms,
  {_pick(['["Answer too long (60 chars)","Trick answer"]', "[]", "", "not json", '["Question must end with punctuation"]', '{"a":1}', '["Trick answer"]'], "event_id")} as validation_errors,
  {_pick(QUESTIONS, _div("event_id", 3))} as question, {_pick(ANSWERS, "event_id")} as answer,
  event_id % 3 as qwen_passes, {_div("event_id", 3)} % 2 as gemini_passes, event_id % 2 as rhea_passed, cast(event_id % 101 as double) / 100.0 as complexity_score, event_id % 13 <> 0 as validation_is_valid
from events""",
    "tasks": f"""
select o_orderkey as id, o_custkey as figure_id, {_pick(QUESTIONS, "o_orderkey")} as question, {_pick(ANSWERS, _div("o_orderkey", 2))} as answer, {_pick(FORMATS, _div("o_orderkey", 3))} as answer_format,
  {_pick(["chart", "spatial", "general", ""], _div("o_orderkey", 5))} as task_type, {_pick(["chart_graph_text", "general_image", ""], _div("o_orderkey", 7))} as figure_type,
  case substring(o_orderpriority, 1, 1) when '1' then 'hardest' when '2' then 'challenging' when '3' then 'challenging' when '4' then '' else 'easy' end as difficulty,
  case o_orderstatus when 'F' then 'submitted' when 'O' then 'draft' else 'approved' end as status, cast(o_orderkey % 4 - 1 as int) as qwen_raw, cast(o_orderkey % 3 as int) as gemini_passes,
  {_pick(CAPTIONS, _div("o_orderkey", 11))} as caption, {_pick(OPTIONS, _div("o_orderkey", 13))} as options_text, {_pick(PATHS, _div("o_orderkey", 17))} as image_path, o_orderdate as created_at, o_totalprice as price
from orders""",
    "submission_logs": "select l_orderkey as task_id, l_shipdate as submitted_at, case l_returnflag when 'A' then 'too_easy' when 'R' then 'too_hard' when 'N' then 'approved' else 'rework' end as review_status, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem",
    "task_events": f"""
select event_id as id, user_id as task_id, {_pick(["check_answer", "determinism_check", "issue_report", "update"], "event_id")} as event_type,
  case event_id % 4 when 0 then case when event_id % 8 = 0 then '{{"match": true, "vlm_answer": "12"}}' else '{{"match": false}}' end when 1 then case when event_id % 3 = 0 then '{{"deterministic": true}}' else '{{"runs": 3}}' end
    when 2 then case event_id % 5 when 0 then '{{"reason": "too_easy", "description": "single_step lookup"}}' when 1 then '{{"reason": "unclear"}}' when 2 then 'broken json' else '{{"reason": "other", "description": "ocr_misread in panel"}}' end
    else case event_id % 7 when 0 then '' when 1 then '["no", "object"]' when 2 then '{{"gemini_passes":2,"qwen_passes":"1","rhea_passed":true}}'
      else '{{"changed_fields":["question","answer"],"new_answer":"' || cast(event_id % 50 as varchar(20)) || '","new_values":{{"answer":' || cast(event_id % 50 as varchar(20)) || ',"question":"Why?"}},"old_answer":null,"old_values":{{"answer":"12"}},"quality":' || cast(event_id % 101 as varchar(20)) || '}}' end end as details,
  ts as created_at, value from events""",
    "issue_reports": f"select event_id as id, case when event_id % 9 = 0 then null else event_id - event_id % 7 end as generation_attempt_id, user_id as task_id, {_pick(['too_easy', 'wrong_answer', 'unclear', 'other', 'not_visual'], _div('event_id', 5))} as reason, {_pick(['', 'calculation_error seen', 'needs single_step only', 'text_only_question'], 'event_id')} as description from events where event_type = 'error'",
    "figures": f"""
select p_partkey as id, p_brand as paper_id, p_name as caption, cast(p_size as double) / 50.0 as complexity_score, case when p_type like '%{{0}}%' then 'chart_graph_text' else {_pick(["chart_graph_text", "general_image", ""], "p_partkey")} end as figure_type,
  p_partkey % 3 = 0 as is_dense, p_partkey % 4 <> 0 as is_suitable, cast(50 + p_partkey % 400 as double) / 100.0 as width_height_ratio, 3000 + (p_partkey * 37) % 9000 as filesize_bytes, case p_partkey % 3 when 0 then 'new' when 1 then 'used' else 'rejected' end as status, 'img/' || cast(p_partkey % 90 as varchar(20)) || '.png' as image_path, p_retailprice as price
from part""".replace("{0}", "STEEL"),
    # image and perceptual hashes stand for pictures: one of a few boxes, and as many low bits as the size says, so sizes near each other look alike
    "extracted": """
select id, paper_id, md5(box || kind || cast(size as varchar(20))) as image_hash, case when id % 23 = 0 then '' else substring(md5(box), 1, 8) || substring(lpad(substring('0137', cast(ones % 4 + 1 as int), 1) || repeat('f', cast(floor(ones / 4.0) as int)), 9, '0'), 2, 8) end as phash,
  cast(size as double) / 50.0 as complexity_score, filesize_bytes, ratio as width_height_ratio, id % 13 = 1 as known
from (select p_partkey as id, p_brand as paper_id, p_type as box, split_part(p_name, ' ', 2) as kind, p_size as size, cast(floor(p_size * 32 / 50.0) as bigint) as ones, 4000 + (p_partkey * 37) % 9000 as filesize_bytes, cast(15 + p_partkey % 500 as double) / 100.0 as ratio from part)""",
    "papers": f"select p_partkey as id, {_pick(TITLES, 'p_partkey')} as title, {_pick(CATEGORIES, _div('p_partkey', 3))} as categories, p_brand as source from part",
    "jobs": f"""
select event_id as id, {_pick(["generate_qa", "regenerate_task", "validate_batch", "rag_index"], "event_id")} as type, case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'cancelled' end as status,
  '{{"task_id": ' || cast(user_id as varchar(20)) || '}}' as payload, {JSON} % 5 as priority, ts as created_at, event_id % 4 as attempts, 3 as max_attempts, user_id % 6 as worker_id from events""",
    "answer_reads": f"""
select l_orderkey as task_id, l_linenumber as run, l_partkey, l_suppkey, l_extendedprice, {_pick(["12", "12.0", " 12 ", "12%", "twelve", "", "13", "Blue", "blue", "1,2"], "l_partkey + l_linenumber")} as model_answer, {_pick(["12", "blue", "13"], "l_orderkey")} as golden, case when l_orderkey % 3 = 1 then 'word' else 'number' end as answer_format from lineitem""",
}


def view_sql(name: str, dialect: str) -> str:
    """SQL of a derived table over the base tables, for 'spark' or 'duckdb'."""
    access = "cast(get_json_object(props, '$.k') as bigint)" if dialect == "spark" else "cast(json_extract_string(props, '$.k') as bigint)"
    return VIEWS[name].replace(JSON, access)


BASE = {"attempts": "events", "tasks": "orders", "submission_logs": "lineitem", "task_events": "events", "issue_reports": "events", "figures": "part", "extracted": "part", "papers": "part", "jobs": "events", "answer_reads": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; Catalyst prunes it to the base columns that are used."""
    base = BASE[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    sql = view_sql(name, "spark")
    head, _, tail = sql.rpartition(f"from {base}")
    return spark.sql(f"{head}from {{{base}}}{tail}".replace("{", "{{").replace("}", "}}").replace(f"{{{{{base}}}}}", f"{{{base}}}"), **{base: df})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all cores where its files give fewer partitions than that: for expressions that cost far more than moving a row.

    Tables of more files or splits than cores stay as they are, so nothing is shuffled at size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
