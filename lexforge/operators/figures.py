"""Figure ingestion, duplicates and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.storage import stored

from .relational import latest


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes, compared in halves."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def exact_copies(df: DataFrame, content: str, key: str) -> DataFrame:
    """Rows whose content an earlier row (by key) has, with that row's key."""
    digest = F.sha2(F.col(content), 256)
    rows = df.select(key, digest.alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min(key).alias("first")), "digest").filter(F.col(key) > F.col("first")).select(key, "first")


def near_copies(hashes: DataFrame, below: int = 8) -> DataFrame:
    """For each hash(id, group_id, phash) the least earlier id of its group within fewer than `below` bits.

    Equal hashes of a group are one with their least id. Two hashes that differ in fewer
    than 8 of 64 bits agree in one of 8 bytes, so distinct ones meet by (group, byte
    place, byte) and not by all pairs of a group.
    """
    one = hashes.groupBy("group_id", "phash").agg(F.min("id").alias("least"))
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.substring("phash", 2 * i + 1, 2).alias("byte")) for i in range(8)))).alias("band")
    left = one.select("group_id", "phash", bands)
    right = one.select("group_id", F.col("phash").alias("other"), F.col("least").alias("first"), bands)
    # a hash is near to itself, so each has the least id that is near to it
    near = left.join(right, ["group_id", "band"]).filter(hamming(F.col("phash"), F.col("other")) < below).groupBy("group_id", "phash").agg(F.min("first").alias("first"))
    return hashes.join(near, ["group_id", "phash"]).filter(F.col("first") < F.col("id")).select("id", "first")


def orphans(disk: DataFrame, rows: DataFrame, path: str = "image_path") -> DataFrame:
    """Paths on one side only."""
    a, b = disk.select(path).distinct(), rows.select(path).filter(F.coalesce(path, F.lit("")) != "").distinct()
    return a.join(b, path, "left_anti").withColumn("side", F.lit("disk")).union(b.join(a, path, "left_anti").withColumn("side", F.lit("table")))


def audit(figures: DataFrame) -> DataFrame:
    """Flags and quality (1 less one half a flag) of each figure."""
    banner = (F.col("width_height_ratio") > 5) | (F.col("width_height_ratio") < 0.2)
    plain = F.col("complexity_score") < 0.1
    flags = banner.cast("int") + plain.cast("int") + (F.col("filesize_bytes") < 5000).cast("int")
    return figures.withColumns({"flags": flags, "audit_quality": F.greatest(1 - 0.5 * flags, F.lit(0.0))})


def rejects(figures: DataFrame) -> DataFrame:
    """figures with the reasons to turn a picture down: `banner`, `logo` and `text_only`.

    They go by what was measured: width, height, n_colors (of the picture at 20 x 20),
    gray_variance and transitions (light to dark and back, a row, at 100 x 100). A picture
    that could not be measured is a banner and a logo, and no text.
    """
    wide = F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    banner = F.when(sized, (wide > 5) | (F.col("gray_variance") < 30)).otherwise(True)
    logo = ((F.col("width") == F.col("height")) & (F.col("width") < 200)) | (F.col("n_colors") < 5)
    text = (F.col("gray_variance") < 2000) & ((F.col("transitions") > 5) | (F.col("gray_variance") < 200))
    return figures.withColumns({"banner": F.coalesce(banner, F.lit(True)), "logo": F.coalesce(logo, F.lit(True)), "text_only": F.coalesce(text, F.lit(False))})


def rank_score(complexity: Column, dense: Column, chart: Column) -> Column:
    return complexity * F.when(dense, 1.3).otherwise(1.0) * F.when(chart, 1.1).otherwise(1.0)


def near_pairs(one: DataFrame, two: DataFrame, below: int = 8) -> DataFrame:
    """(group_id, phash, other): hashes of one and of two that are in one group and differ in fewer than `below` bits.

    Both sides hold (group_id, phash) once each, the empty hash left out; they meet by
    (group, byte place, byte), as fewer than 8 differing bits leave one of 8 bytes alike.
    """
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.substring("phash", 2 * i + 1, 2).alias("byte")) for i in range(8)))).alias("band")
    left = one.filter("phash <> ''").select("group_id", "phash", bands)
    right = two.filter("phash <> ''").select("group_id", F.col("phash").alias("other"), bands)
    return left.join(right, ["group_id", "band"]).filter(hamming(F.col("phash"), F.col("other")) < below).select("group_id", "phash", "other").distinct()


def ingest(figures: DataFrame, known: DataFrame, least_complexity: float = 0.2, least_bytes: int = 5000, per_paper: int = 3) -> DataFrame:
    """What becomes of each figure, taken in order of paper and id: (id, paper_id, outcome).

    figures hold id, paper_id, image_hash, phash, complexity_score, filesize_bytes and
    width_height_ratio; known, what the library holds already, paper_id, image_hash and
    phash. Outcomes, the first that applies: 'logo', 'simple', 'small'; 'copy' of a figure
    that is kept already, in any paper; 'near copy' of one that is kept already, in its own
    paper; 'capped', beyond the best per_paper of a paper once it is done; 'kept'.

    Whether a figure stays hangs on what stays before it: a figure near to one that went
    for being near to a third stays. Such a set is the one fixed point of its own rule, as
    each figure looks at earlier ones only. So all figures are decided at once by what the
    round before kept, until nothing changes; a figure is settled after as many rounds as
    the longest chain of figures that decide each other. Rows of one hash meet as one least
    row, so a picture in very many papers is no hot task. Null hashes are equal to none.
    """
    banner = (F.col("width_height_ratio") > 5) | (F.col("width_height_ratio") < 0.2)
    first = F.when(F.coalesce(banner, F.lit(False)), "logo").when(~F.coalesce(F.col("complexity_score") >= least_complexity, F.lit(False)), "simple").when(~F.coalesce(F.col("filesize_bytes") >= least_bytes, F.lit(False)), "small")
    rows = stored(figures.select("id", "paper_id", "image_hash", F.coalesce("phash", F.lit("")).alias("phash"), "complexity_score", first.alias("early")), "figures")
    group = F.col("paper_id").alias("group_id")
    held = known.select("image_hash").distinct().withColumn("held", F.lit(True))
    apart = rows.filter("early is null").select(group, "phash").distinct()
    near_held = near_pairs(apart, known.select(group, "phash").distinct()).select(F.col("group_id").alias("paper_id"), "phash").distinct().withColumn("near_held", F.lit(True))
    early = F.coalesce("early", F.when(F.col("held"), "copy"))
    judged = stored(rows.join(held, "image_hash", "left").join(near_held, ["paper_id", "phash"], "left").withColumns({"early": early, "near_held": F.coalesce("near_held", F.lit(False))}).drop("held"), "judged")
    open_ = judged.filter("early is null").drop("early")
    edges = stored(near_pairs(apart := open_.select(group, "phash").distinct(), apart), "edges").withColumnRenamed("group_id", "paper_id")

    state = open_.withColumns({"staying": F.lit(True), "kept": F.lit(False), "copy": F.lit(False)})
    while True:
        state = stored(_decided(state, edges, per_paper), "decided")
        if not state.filter("moved").limit(1).count():
            break
    late = F.when(F.col("kept"), "kept").when(F.col("staying"), "capped").when(F.col("copy"), "copy").otherwise("near copy")
    return judged.filter("early is not null").select("id", "paper_id", F.col("early").alias("outcome")).union(state.select("id", "paper_id", late.alias("outcome")))


def _decided(state: DataFrame, edges: DataFrame, per_paper: int) -> DataFrame:
    """One round: who stays in its paper, and is among its paper's best, by what the round before says of earlier figures."""
    papers = state.filter("kept").groupBy("image_hash").agg(F.min("paper_id").alias("held_by"))
    staying = state.filter("staying")
    twins = staying.groupBy("paper_id", "image_hash").agg(F.min("id").alias("twin"))
    alike = staying.groupBy("paper_id", F.col("phash").alias("other")).agg(F.min("id").alias("alike"))
    near = edges.join(alike, ["paper_id", "other"]).groupBy("paper_id", "phash").agg(F.min("alike").alias("alike"))
    seen = state.join(papers, "image_hash", "left").join(twins, ["paper_id", "image_hash"], "left").join(near, ["paper_id", "phash"], "left")
    before = lambda c, own: F.coalesce(F.col(c) < F.col(own), F.lit(False))
    copy = before("held_by", "paper_id") | before("twin", "id")
    marked = seen.select("id", "paper_id", "image_hash", "phash", "complexity_score", "near_held", "kept", F.col("staying").alias("was"), copy.alias("copy"), (~copy & ~F.col("near_held") & ~before("alike", "id")).alias("staying"))
    best = latest(marked.filter("staying").select("paper_id", "id", "complexity_score"), ["paper_id"], [F.col("complexity_score").desc(), F.col("id")], per_paper)
    joined = marked.join(best.select("id", F.lit(True).alias("best")), "id", "left").withColumn("best", F.coalesce("best", F.lit(False)))
    moved = (F.col("was") != F.col("staying")) | (F.col("kept") != F.col("best"))
    return joined.withColumn("moved", moved).drop("was", "kept").withColumnRenamed("best", "kept")


def quality_weights(color: Column, edge: Column, detail: Column, density: Column) -> Column:
    """Weighted complexity of pixel features in [0, 1], three digits."""
    from lexforge.functions.text import half_up

    return half_up(F.least(F.greatest(0.2 * color + 0.3 * edge + 0.2 * detail + 0.3 * density, F.lit(0.0)), F.lit(1.0)), 3)


def chart_likely(features: list[Column]) -> Column:
    """Weighted vote of four features against the cut."""
    return sum((w * f for w, f in zip((0.35, 0.25, 0.25, 0.15), features, strict=True)), F.lit(0.0)) >= 0.4
