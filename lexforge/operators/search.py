"""Term search, exact vector top-k, semantic cache, prototypes and document grades."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.relational import latest
from lexforge.sources.vectors import Collection

#: Synonyms of search terms, and category keywords of domains.
SYNONYMS = {
    "detection": ["detection", "detecting", "detector", "yolo", "faster r-cnn"],
    "segmentation": ["segmentation", "segmenting", "mask", "u-net", "boundary"],
    "neural network": ["neural", "network", "deep learning", "cnn", "transformer"],
    "optical": ["optical", "photon", "photonic", "lens", "mirror", "microscopy"],
    "classification": ["classification", "classifier", "classify", "categorization"],
    "object detection": ["object detection", "detection", "localization", "yolo", "r-cnn"],
    "counting": ["counting", "count", "enumeration", "density estimation"],
    "lattice": ["lattice", "grid", "mesh", "array", "tiling"],
    "benchmark": ["benchmark", "leaderboard", "evaluation", "comparison"],
    "architecture": ["architecture", "backbone", "design", "diagram"],
}
DOMAINS = {
    "computer science": ["cs", "computer science"], "cs": ["cs", "computer science"], "math": ["math", "mathematics"], "mathematics": ["math", "mathematics"], "bio": ["q-bio", "biology", "quantitative biology"],
    "biology": ["q-bio", "biology", "quantitative biology"], "chemistry": ["chem-ph", "chemistry"], "finance": ["q-fin", "finance", "quantitative finance"], "physics": ["physics"], "statistics": ["stat", "statistics"],
    "medicine": ["med", "medicine"], "neuroscience": ["neuro", "neuroscience"], "economics": ["econ", "economics"], "engineering": ["engine", "engineering"],
}


def expand_terms(terms: list[str]) -> list[str]:
    """Each term's synonyms, six at most, in order and without repeats (case ignored)."""
    out: dict[str, str] = {}
    for term in terms:
        for s in SYNONYMS.get(term.lower(), [term])[:6]:
            out.setdefault(s.lower(), s)
    return list(out.values())


def term_pattern(term: str) -> str:
    return "(^|[^a-z0-9])(" + "|".join(T.escaped(s.lower()) for s in expand_terms([term])) + ")($|[^a-z0-9])"


def in_domain(categories: Column, domain: str) -> Column:
    """A category equals or starts with a keyword, or holds one of four letters or more."""
    keys = [k.lower() for k in DOMAINS.get(domain.lower().strip(), [domain.lower().strip()])]

    def hit(c: Column) -> Column:
        low, out = F.lower(c), F.lit(False)
        for k in keys:
            out = out | low.startswith(k) | (low.contains(k) if len(k) >= 4 else F.lit(False))
        return out

    return F.exists(F.split(categories, r"\s+"), lambda c: (c != "") & hit(c))


def search_papers(papers: DataFrame, terms: list[str], domain: str = "", source: str = "", limit: int = 20) -> DataFrame:
    """Titles that hold a synonym of each of the first three terms."""
    if source:
        papers = papers.filter(F.col("source") == source)
    for term in terms[:3]:
        papers = papers.filter(F.lower("title").rlike(term_pattern(term)))
    if domain:
        papers = papers.filter(in_domain(F.col("categories"), domain))
    return papers.orderBy("id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<float> columns in doubles; 0 if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Rows and queries that meet in one task, and scores held at once.
BLOCK, QUERIES, HELD = 65_536, 8192, 2_000_000
#: By how much a matrix product may differ from a sum in order.
ROUNDING = 1e-9


def _plain(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, length of each); a vector that is null or holds a null has length -1, and others are filled with zeros."""
    flat = column.combine_chunks()
    size = np.where(flat.is_null().to_numpy(zero_copy_only=False), -1, np.diff(flat.offsets.to_numpy()))
    if not flat.null_count and not flat.flatten().null_count and len(set(size.tolist())) == 1 and size[0]:
        return flat.flatten().to_numpy().astype(np.float64).reshape(len(size), -1), size
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    for i, v in enumerate(flat.to_pylist()):
        if v is not None and None in v:
            size[i] = -1
        elif v:
            out[i, : size[i]] = v
    return out, size


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first element to the last, as `cosine` does."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows and queries of a block -> the k nearest rows of each query.

    A matrix product tells which rows can be among them; those are scored again as `cosine`
    does, so equal vectors have equal scores and ties are seen.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = (np.asarray(t.column(c).to_pylist()) for t, c in ((rows, "vec_id"), (asked, "query_id")))
        x, x_size = _plain(rows.column("embedding"))
        q, q_size = _plain(asked.column("q"))
        wide = max(x.shape[1], q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, q))
        x_norm, q_norm = (np.sqrt(_in_order(m, m)) for m in (x, q))
        unit = lambda m, n: m / np.where(n > 0, n, 1.0)[:, None]
        x_unit, q_unit = unit(x, x_norm), unit(q, q_norm)
        place = np.unique(ids, return_inverse=True)[1]
        of, to, scores = [], [], []
        step = max(1, HELD // max(len(ids), 1))
        for at in range(0, len(names), step):
            here = slice(at, at + step)
            rough = q_unit[here] @ x_unit.T
            rough[q_size[here, None] != x_size[None, :]] = 0.0
            rough[np.isnan(rough)] = np.inf
            rough[names[here, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            for i, good in enumerate((rough >= least[:, None] - ROUNDING) & (rough > -np.inf), at):
                near = np.flatnonzero(good)
                norm = x_norm[near] * q_norm[i]
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(np.isnan(norm) | (norm > 0), _in_order(x[near], q[i][None, :]) / norm, 0.0)
                score = np.where((x_size[near] == q_size[i]) & (x_size[near] >= 0), score, 0.0)
                best = np.lexsort((place[near], -np.where(np.isnan(score), np.inf, score)))[:k]
                of.append(np.full(len(best), i))
                to.append(near[best])
                scores.append(score[best])
        take = lambda t, c, at: t.column(c).take(pa.array(np.concatenate(at) if at else [], pa.int64()))
        return pa.table({"query_id": take(asked, "query_id", of), "vec_id": take(rows, "vec_id", to), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, equal: dict | None = None) -> DataFrame:
    """The k nearest vectors of each query(query_id, q), exactly; a vector is no neighbour of its own id.

    Every query meets every vector, in tasks of at most about BLOCK vectors and QUERIES
    queries; each gives its own k best of a query.
    """
    for name, value in (equal or {}).items():
        vectors = vectors.filter(F.col(name) == value)
    rows, asked = vectors.select("vec_id", "embedding").filter("vec_id is not null"), queries.select("query_id", "q").filter("query_id is not null")
    n, m, tasks = rows.count(), asked.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism
    takes = max(1, -(-m // QUERIES))
    shares = max(1, -(-n // BLOCK), min(-(-tasks // takes), -(-n // 1024)))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select(part("vec_id", shares).alias("share"), every(takes).alias("take"), "vec_id", "embedding")
    right = asked.select(every(shares).alias("share"), part("query_id", takes).alias("take"), "query_id", "q")
    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    keys = ["share", "take"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, score double")
    ranked = latest(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", "vec_id", T.half_up(F.col("score"), 4).alias("score"), "rank")


def semantic_cache(cache: DataFrame, queries: DataFrame, as_of: Column, least: float = 0.95, ttl_s: int = 3600, top: int = 3) -> DataFrame:
    """For each query the first of its top entries that is similar and young enough."""
    near = vector_topk(cache, queries, top).join(cache.select("vec_id", "created_at"), "vec_id")
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    hits = near.filter((F.col("score") >= least) & (age < ttl_s))
    return hits.groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id"), F.min_by("score", "rank").alias("score"))


#: Classes up to which their mean prototypes, one vector each, are sent to all rows.
MOST_CLASSES = 10_000


def _class_scores(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(vec_id, class, s): average cosine of each vector to each class's prototypes.

    An average of cosines is the product with the mean of the unit prototypes, so a class
    is one vector, however many prototypes it has; a zero prototype counts as cosine 0.
    """
    size = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    each = prototypes.withColumn("size", size).select("label", "size", F.posexplode("p").alias("at", "x"))
    mean = each.groupBy("label", "at").agg(F.avg(F.when(F.col("size") > 0, F.col("x").cast("double") / F.col("size")).otherwise(0.0)).alias("x"))
    classes = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))  # one row a class, as long as a vector
    if classes.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: search a stored collection of their prototypes instead")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    own = vectors.select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    met = own.join(F.broadcast(classes))
    return met.select("vec_id", F.col("label").alias("class"), F.when(F.col("norm") > 0, dot(F.col("embedding"), F.col("mean")) / F.col("norm")).otherwise(0.0).alias("s"))


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Class of greatest average cosine to its prototypes(label, p), which are few by their nature; ties go to the least label."""
    return _class_scores(vectors, prototypes).groupBy("vec_id").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("class"))


def classify(figures: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(vec_id, class, confidence, method) of figures(vec_id, embedding, heuristic, heuristic_confidence).

    By prototypes where a figure has an embedding and some class is nearer than cosine 0;
    a figure that no class is near to keeps the heuristic's class with confidence 0. Without
    an embedding, or where there are no prototypes at all, the heuristic decides.
    """
    scored = _class_scores(figures.filter("embedding is not null"), prototypes)
    best = scored.groupBy("vec_id").agg(F.max_by(F.struct("class", "s"), F.struct("s", -F.col("class"))).alias("b"))
    rows = figures.select("vec_id", "heuristic", "heuristic_confidence").join(best, "vec_id", "left")
    near = F.col("b.s") > 0
    return rows.select(
        "vec_id", F.when(near, F.col("b.class")).otherwise(F.col("heuristic")).alias("class"),
        F.when(near, T.half_up(F.col("b.s"), 3)).when(F.col("b").isNotNull(), 0.0).otherwise(F.col("heuristic_confidence")).alias("confidence"), F.when(F.col("b").isNotNull(), "cnn").otherwise("heuristic").alias("method"),
    )


def grade(docs: DataFrame, query: str, score: Column, cut: float = 0.3) -> DataFrame:
    """Relevance of each text: the greater of its score and the query's word overlap, in bands at cut and half of it."""
    value = F.greatest(score, T.keyword_overlap(F.lit(query), F.col("text")))
    return docs.withColumn("relevance", value).withColumn("grade", F.when(F.col("relevance") >= cut, "relevant").when(F.col("relevance") >= cut / 2, "ambiguous").otherwise("irrelevant"))


def rerank(candidates: DataFrame, query: str, k: int, scorer=T.keyword_overlap) -> DataFrame:
    """The k candidates of greatest score by a pluggable Column function of (query, content)."""
    return candidates.withColumn("rerank", scorer(F.lit(query), F.col("content"))).orderBy(F.col("rerank").desc(), "id").limit(k)


def context(candidates: DataFrame, query: str, k: int) -> DataFrame:
    """One row: the reranked contents as bullets, and their ids."""
    top = rerank(candidates, query, k).groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("rerank")).alias("o"), "id", "content"))).alias("rows"))
    return top.select(F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["content"])), "\n").alias("context"), F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("sources"))


def contexts(questions: DataFrame, cache: DataFrame, documents: Collection, as_of: Column, k: int = 5, least: float = 0.95, ttl_s: int = 3600, exact: bool = False) -> DataFrame:
    """What a generator is told for each of questions(query_id, q, text, kind): (query_id, from_cache, context, sources).

    cache holds (cache_id, owner, embedding, created_at, context): a context of the
    question's owner (its own column `owner`) that is near and young enough answers it, the
    nearest one. The others take the 2 * k nearest of the stored documents, those of their
    kind where they name one, and of these the k that hold most of the question's words, as
    bullets, with their ids as sources. A question without documents has an empty context.
    """
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    young = cache.filter(age < ttl_s).select("cache_id", "owner", "embedding", F.col("context").alias("held"))
    near = questions.select("query_id", "q", "owner").join(young, "owner").withColumn("near", cosine(F.col("embedding"), F.col("q"))).filter(F.col("near") >= least)
    hits = near.groupBy("query_id").agg(F.max_by("held", F.struct("near", -F.col("cache_id"))).alias("held"))
    missed = questions.join(hits.select("query_id"), "query_id", "left_anti")
    found = documents.search(missed, 2 * k, exact=exact, same="kind").join(documents.rows().select("id", "content"), "id").join(missed.select("query_id", "text"), "query_id")
    first = F.struct((-T.keyword_overlap(F.coalesce("text", F.lit("")), F.coalesce("content", F.lit("")))).alias("overlap"), "id").alias("o")
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(first, "id", "content"))), 1, k).alias("rows"))  # 2 * k rows
    told = F.concat(F.lit("Retrieved context:\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), F.coalesce(r["content"], F.lit("")))), "\n"))
    missing = ranked.select("query_id", told.alias("told"), F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("sources"))
    joined = questions.select("query_id").join(hits, "query_id", "left").join(missing, "query_id", "left")
    cached = F.col("held").isNotNull()
    return joined.select("query_id", cached.alias("from_cache"), F.coalesce("held", "told", F.lit("")).alias("context"), F.when(cached, "cache").otherwise(F.coalesce("sources", F.lit(""))).alias("sources"))


def few_shot(attempts: DataFrame, issues: DataFrame, figure_type: str, difficulty: str, complexity: float, limit: int = 2) -> DataFrame:
    """Good attempts without reported issues, nearest in complexity first, then by the profile asked for; equal questions once."""
    from .relational import distinct_first, filtered, without

    rows = filtered(attempts.filter("success and validation_is_valid and quality >= 80 and question <> ''"), {"figure_type": figure_type, "difficulty": difficulty})
    rows = without(rows, issues, "id", "generation_attempt_id")
    order = [F.abs(F.col("complexity_score") - complexity) if complexity > 0 else F.col("quality").desc()]
    if difficulty == "hardest":
        order += [F.col("qwen_passes"), F.col("gemini_passes")]
    else:
        order += [F.col("rhea_passed").desc(), F.col("qwen_passes"), F.col("gemini_passes").desc()]
    order.append(F.col("id"))
    return distinct_first(rows.orderBy(*order).limit(2 * limit), "question", order, limit)


def few_shot_all(attempts: DataFrame, issues: DataFrame, profiles: DataFrame, limit: int = 2) -> DataFrame:
    """`few_shot` for every row of profiles(id, figure_type, difficulty, complexity): (id, rank, attempt_id, question).

    An empty type or difficulty stands for any, as a candidate of its own group; null is
    empty. In a group only the first 2 * limit candidates of one complexity can be wanted,
    so they become one node; nodes and profiles are counted through in order of complexity,
    which tells each profile how many nodes stand before it. It meets the 2 * limit nodes
    on either side by their numbers, whatever their distance, and no others. A profile
    without a complexity takes its group's best by quality. Equal profiles are one.
    """
    from .ranks import tallied
    from .relational import without

    most = 2 * limit
    good = without(attempts.filter("success and validation_is_valid and quality >= 80 and question <> ''"), issues, "id", "generation_attempt_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    any_of = lambda c: F.array_distinct(F.array(text(c), F.lit("")))
    c = F.col("complexity_score").cast("double")
    groups = good.select(F.col("id").alias("attempt_id"), "question", "quality", c.alias("at"), F.coalesce("rhea_passed", F.lit(0)).cast("int").alias("rhea"), "qwen_passes", "gemini_passes", F.explode(any_of("figure_type")).alias("kind"), "difficulty")
    groups = groups.withColumn("level", F.explode(any_of("difficulty"))).drop("difficulty")
    hard = F.col("level") == "hardest"
    # what decides between candidates of one distance: smaller is better
    tail = F.struct(F.when(hard, 0).otherwise(-F.col("rhea")).alias("a"), F.col("qwen_passes").alias("b"), F.when(hard, F.col("gemini_passes")).otherwise(-F.col("gemini_passes")).alias("c"), F.col("attempt_id").alias("d"))
    groups = groups.withColumn("tail", tail)
    asked = profiles.select("id", text("figure_type").alias("kind"), text("difficulty").alias("level"), F.coalesce(F.col("complexity").cast("double"), F.lit(0.0)).alias("x"))
    distinct = asked.select("kind", "level", "x").distinct()

    each = latest(groups.filter("at is not null"), ["kind", "level", "at"], [F.col("tail")], most)
    nodes = each.groupBy("kind", "level", "at").agg(F.collect_list(F.struct("tail", "attempt_id", "question")).alias("rows"))  # 2 * limit rows
    both = nodes.select("kind", "level", F.col("at").alias("x"), F.lit(1).alias("node"), "rows").unionByName(distinct.filter("x > 0").withColumn("node", F.lit(0)), allowMissingColumns=True)
    counted = tallied(both, [F.col("kind"), F.col("level"), F.col("x"), F.col("node").desc()], "node", "n")
    near = counted.filter("node = 0").select("kind", "level", "x", F.explode(F.sequence(F.col("n") - most + 1, F.col("n") + most)).alias("n"))
    held = counted.filter("node = 1").select("n", F.col("kind").alias("k"), F.col("level").alias("l"), F.col("x").alias("at"), "rows")
    met = near.join(held, "n").filter("kind = k and level = l").select("kind", "level", "x", F.abs(F.col("at") - F.col("x")).alias("far"), F.explode("rows").alias("r")).select("kind", "level", "x", "far", "r.*")

    best = latest(groups.withColumn("far", -F.col("quality")), ["kind", "level"], [F.col("far"), F.col("tail")], most)
    flat = distinct.filter("x <= 0").join(best, ["kind", "level"]).select("kind", "level", "x", "far", "tail", "attempt_id", "question")
    first = latest(met.union(flat).withColumn("far", F.struct("far", "tail")), ["kind", "level", "x"], [F.col("far")], most).withColumnRenamed("rank", "place")
    once = latest(first.withColumn("said", F.lower(F.trim("question"))), ["kind", "level", "x", "said"], [F.col("place")]).drop("rank")
    chosen = latest(once, ["kind", "level", "x"], [F.col("place")], limit)
    return asked.join(chosen, ["kind", "level", "x"]).select("id", F.col("rank").cast("long").alias("rank"), "attempt_id", "question")
