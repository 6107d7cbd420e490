"""Filters, top-k, paging, latest-per-key, set differences and other relational reads.

Every order is total: a unique key breaks ties. Rankings within a key use row_number
over the key, which Spark limits per partition before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed


def filtered(df: DataFrame, equal: dict | None = None, least: dict | None = None, true: list[str] | None = None) -> DataFrame:
    """Predicates whose argument is given (not empty, above zero); the others are left out."""
    for name, value in (equal or {}).items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    for name, value in (least or {}).items():
        if value and value > 0:
            df = df.filter(F.col(name) >= value)
    for name in true or []:
        df = df.filter(name)
    return df


def text_search(df: DataFrame, term: str, columns: list[str], equal: dict | None = None) -> DataFrame:
    """Rows in which a column holds the term, case ignored; % and _ in the term are wildcards."""
    df = filtered(df, equal)
    if not term:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{term}%")
    return df.filter(hit)


def ordered(df: DataFrame, sort: str, direction: str, allowed: list[str], key: str = "id") -> list[Column]:
    """Order by an allowed column, else by key descending; the key breaks ties."""
    if sort not in allowed or direction not in ("asc", "desc"):
        return [F.col(key).desc()]
    c = F.col(sort).desc_nulls_last() if direction == "desc" else F.col(sort).asc_nulls_last()
    return [c, F.col(key).desc()]


def page(df: DataFrame, number: int, per_page: int, order: list[Column]) -> DataFrame:
    """A page, its number clamped to those that exist; sizes other than 20 and 50 become 20."""
    per_page = per_page if per_page in (20, 50) else 20
    total = df.count()
    last = max(1, -(-total // per_page))
    number = min(max(number, 1), last)
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page).withColumns({"page": F.lit(number), "pages": F.lit(last), "total": F.lit(total)})


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def best_per_key(df: DataFrame, keys: list[str], by: Column, row: list[str]) -> DataFrame:
    """The row of greatest `by` of each key as an aggregate, which combines before the shuffle: for hot keys."""
    return df.groupBy(*keys).agg(F.max(F.struct(by.alias("_by"), *row)).alias("m")).select(*keys, *(F.col(f"m.{c}") for c in row))


#: Rows of keys up to which `without` sends them to all rows.
BROADCAST_ROWS = 20_000


def without(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key is in no row of other; null keys of other exclude nothing.

    Keys of other are held as hash tables, whole if they are few and else dealt by key: a
    task holds its share of distinct keys, and rows of df pass by without being sorted.
    """
    keys = other.select(F.col(other_key).alias(key)).filter(F.col(key).isNotNull())
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(keys.distinct().hint("broadcast" if few else "shuffle_hash"), key, "left_anti")


def queue_order(jobs: DataFrame, by: str = "id") -> DataFrame:
    """Queued jobs with their place and how many there are; by 'id' or by 'priority' (highest, then oldest).

    Places are counted by ranges of the whole order, so one priority that all jobs have is
    dealt to many tasks.
    """
    queued = jobs.filter("status = 'queued'")
    order = [F.col("id")] if by == "id" else [F.col("priority").desc(), F.col("created_at"), F.col("id")]
    ranked = placed(queued.select("id", "priority", "created_at"), order)
    return ranked.select("id", "place").crossJoin(F.broadcast(queued.agg(F.count("*").alias("n_queued"))))  # one row


def chunks(df: DataFrame, size: int, order: list[Column], value: str, last: int = 10) -> DataFrame:
    """Averages of runs of `size` rows in order, with the difference to the run before; the last runs.

    A run's values are summed in that order, so that its average does not hang on how rows
    are dealt: one decimal is often a half away from the next.
    """
    from lexforge.functions.text import half_up

    ranked = placed(df, order, "rn").withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    held = F.array_sort(F.collect_list(F.struct("rn", F.col(value).cast("double").alias("v"))))  # `size` rows
    known = F.filter(F.transform(held, lambda r: r["v"]), lambda v: v.isNotNull())
    total = F.aggregate("known", F.lit(0.0), lambda s, v: s + v)
    runs = ranked.groupBy("chunk").agg(F.count("*").alias("n"), known.alias("known"))
    out = runs.select("chunk", "n", half_up(total / F.nullif(F.size("known"), F.lit(0)), 1).alias("average"))
    before = out.select((F.col("chunk") + 1).alias("chunk"), F.col("average").alias("before"))
    label = F.concat(F.lit("#"), (F.col("chunk") * size + 1).cast("string"), F.lit("-"), (F.col("chunk") * size + F.col("n")).cast("string"))
    top = out.agg(F.max("chunk").alias("top"))
    out = out.join(before, "chunk", "left").withColumns({"trend": half_up(F.col("average") - F.col("before"), 1), "label": label}).drop("before")
    return out.crossJoin(F.broadcast(top)).filter(F.col("chunk") > F.col("top") - last).drop("top")  # one row


def page_numbers(df: DataFrame, per_page: int, order: list[Column]) -> DataFrame:
    """Every row with its place and the page it stands on."""
    return placed(df, order).withColumn("page", F.ceil(F.col("place") / per_page).cast("long"))


def distinct_first(df: DataFrame, text: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows after dropping later rows of equal text (case and outer spaces ignored)."""
    key = F.lower(F.trim(F.col(text)))
    once = df.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_r = 1")
    return once.orderBy(*order).limit(n).drop("_k", "_r")


def padded_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL of rows of different shape; what a side lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_defaults(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Schema evolution: add missing columns, and fill nulls of declared ones with their default."""
    for name, (kind, default) in schema.items():
        have = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(have.cast(kind), F.lit(default).cast(kind)))
    return df
