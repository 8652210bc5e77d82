"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Two texts are equal when they are identical after deleting white space. The
normalised text is cut where its own content says so: after each run of sentence
marks, and after 256 code points without one, it falls into atoms; an atom whose
hash is divisible by ``CUT`` ends a chunk. A document's recipe is the ordered list
of its chunks' identifiers, and documents with equal recipes are equal.

An identifier is verified: it is the chunk's 64-bit hash and a rank among the
distinct contents that share this hash. Distinct (hash, content) rows are found
by a hash aggregate that combines on the map side, so that a chunk's bytes move
once per task that holds it, however many documents hold it. Contents that share
a hash get ranks 1, 2, ...; all other chunks have rank 0 and need no lookup. From
there on only identifiers move.

Defined cases. A null text counts as empty, has the empty recipe and is equal to
any text of white space only. Of equal rows the one with the most code points in
the original text stays, then the smallest doc_id (null last). Rows that repeat a
doc_id are rows of their own and count in group_size; of those that tie in length
and doc_id any one stays. An empty table gives an empty result. Other columns pass
through ``dedup``, whatever their names.

Scale. A hot group (a third of all rows) adds one row per task to each aggregate;
the join that gives each row its group is a plain equality join, whose hot key
adaptive execution splits, and carries no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: An atom ends a chunk if its hash is divisible by this: about 16 atoms, 1 to 2 thousand characters.
CUT = 16
ATOM = r"(?s)[^.,;:!?]{0,255}+[.,;:!?]{1,64}|.{1,256}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{c.SPACE}+", "")


def chunks(norm: Column) -> Column:
    """The normalised text cut into content-defined chunks, in order."""
    atoms = F.regexp_extract_all(norm, F.lit(ATOM), F.lit(0))
    # A normalised text has no white space, so that a newline can mark the cuts.
    marked = F.transform(atoms, lambda a: F.when(F.xxhash64(a) % CUT == 0, F.concat(a, F.lit("\n"))).otherwise(a))
    return F.filter(F.split(F.array_join(marked, ""), "\n"), lambda x: x != "")


def collisions(docs: DataFrame) -> DataFrame | None:
    """Chunks whose 64-bit hash another content shares, with their ranks; None if there are none."""
    chunk = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    distinct = chunk.select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    shared = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if not shared.count():  # nearly always; else they are found again
        return None
    apart = distinct.join(shared, "h").groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    return c.written(apart.select("h", F.posexplode("all").alias("rank", "chunk")).withColumn("rank", F.col("rank") + 1), "chunk-ranks")


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, text_sha256 and the recipe (hashes, and ranks unless all are 0) of each row."""
    base = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("norm"))
    base = base.select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    ranks = collisions(docs)
    hashes, none = F.transform("chunks", lambda x: F.xxhash64(x)), F.array().cast("array<int>")
    if ranks is None:
        return base.select("doc_id", "n_points", "text_sha256", F.struct(hashes.alias("h"), none.alias("rank")).alias("recipe"))
    keyed = c.written(base.withColumn("_at", F.monotonically_increasing_id()), "chunked")
    parts = keyed.select("_at", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk")).join(ranks, ["h", "chunk"])
    parts = parts.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    rank = F.when(F.col("ranks").isNull(), none).otherwise(F.transform("chunks", lambda x, i: F.coalesce(F.col("ranks")[i], F.lit(0))))
    return keyed.join(parts, "_at", "left").select("doc_id", "n_points", "text_sha256", F.struct(hashes.alias("h"), rank.alias("rank")).alias("recipe"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_points of each row, dropped ones too."""
    base = c.written(recipes(docs).withColumn("_at", F.monotonically_increasing_id()), "recipes")
    best = F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low"), (-F.col("_at")).alias("at"))
    group = c.written(base.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(best).alias("best")), "recipe-groups")
    return base.join(group, "recipe").select("doc_id", (-F.col("best.low")).alias("keep_id"), "group_size", (F.col("_at") == -F.col("best.at")).alias("kept"), "text_sha256", "n_points")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts."""
    names = docs.columns
    found = c.written(groups(docs), "groups")
    key = ("doc_id", "text_sha256", "n_points")
    again = found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    stay = found.where("kept").select(*(F.col(k).alias(f"_{k}") for k in key))
    text = F.col("text")
    row = docs.select(F.struct(*(F.col(f"`{k}`") for k in names)).alias("_row"), F.col("doc_id").alias("_id"), F.sha2(normalised(text).cast("binary"), 256).alias("_sha"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_n"))
    kept = row.join(stay, F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_sha") == F.col("_text_sha256")) & (F.col("_n") == F.col("_n_points")), "left_semi")
    if not again.isEmpty():  # rows that agree in all of the key: one of them stays
        kept = kept.dropDuplicates(["_id", "_sha", "_n"])
    return kept.select(*(F.col("_row").getField(k).alias(k) for k in names))
