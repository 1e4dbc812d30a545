"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its content says so; equal texts are cut alike. Chunks are named by two 64-bit hashes.
All distinct chunks are then compared by bytes, each moved once per task that has it, never once per copy: a name that
two different chunks share is found there, and such chunks are spelled out in full in the recipes. A recipe is the
ordered list of a document's chunk names. Documents are equal exactly if their recipes are, and recipes are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SPACE = r"[\x20\x09-\x0D]+"
#: A cut falls after such a pair of characters, at least SHORTEST and at most LONGEST characters after the last one.
ANCHOR, SHORTEST, LONGEST = r"(?:[a-z0-9][.,;:!?A-Z]|[^\x00-\x7F][a-m])", 768, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks_of(text: Column, anchor: str = ANCHOR, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text's content-defined chunks, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{shortest},{longest}}}?{anchor}|.{{1,{longest}}}"), F.lit(0))


def name_of(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(chunk, F.lit(1)).alias("b"))


def clashing_of(distinct: DataFrame) -> list:
    """Names that several rows of distinct chunks share; with 128 bits none is expected at any size."""
    return [
        r["name"] for r in distinct.groupBy("name").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").collect()
    ]


def spelled_name(chunk: Column, clashing: list, name=name_of) -> Column:
    """The chunk's name, and the chunk itself where its name clashes: equal exactly if the chunks are."""
    own, clash = name(chunk), F.lit(False)
    for x in clashing:
        clash = clash | ((own["a"] == x["a"]) & (own["b"] == x["b"]))
    return F.struct(own["a"].alias("a"), own["b"].alias("b"), F.when(clash, chunk).alias("chunk"))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunks=chunks_of, name=name_of, row: str | None = None
) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical without their white space ``[\\x20\\x09-\\x0D]``; null counts as empty, and all empty
    texts are equal. Of equal texts one row stays: that with the most code points in the original, then the smallest doc_id
    (null last), then the smallest hash of the original text, then the first as read. So a repeated id, or rows without one,
    keep one row of a group as well; keep_id is the id of the row that stays, null if it has none. Other columns are ignored;
    an empty table gives no rows. ``row`` names a column of unique numbers, which the result then has as ``row``.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    slim = docs.select(
        number.alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("hash"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("points"),
        normalised(F.col(f"`{text}`")).alias("own")
    )
    chunk = slim.select(
        F.explode(chunks(F.col("own"))).alias("chunk")
    ).select(name(F.col("chunk")).alias("name"), "chunk")
    clashing = clashing_of(chunk.groupBy("name", "chunk").agg(F.count(F.lit(1)).alias("n")))
    recipes = stored(
        slim.select(
            "row", "hash", "doc_id", "points", F.sha2(F.col("own").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("own")), lambda c: spelled_name(c, clashing, name)).alias("recipe")
        )
    )
    # The numbers are read from the written table, so a row has the same one wherever it is read.
    place = F.struct(
        (-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "row"
    )
    groups = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first"))
    # Read from a table, both sides of the join are freshly dealt, so that Spark can split the rows of a hot recipe.
    found = recipes.join(stored(groups.filter("group_size > 1")), "recipe", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        *([] if row is None else ["row"]), "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("first.row") == F.col("row")).alias("kept"), "text_sha256"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS own FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY own ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY own) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(own) AS text_sha256 FROM g
"""
