"""Merkle manifest of a table: one digest for all rows, and for every row the siblings that lead from it to that digest.

A row's leaf is the SHA-256 of its fields, each with its length before it. Leaves are put in order within their group
(here: a language), and every ``fanout`` consecutive nodes become one, level by level, until one is left; the groups'
digests are then leaves of one more such tree. A level is built by a slot pivot: one aggregation per level spreads a
parent's children into ``fanout`` columns by their place. All slots joined and hashed are the parent; all but a child's
own, left and right of it, are that child's siblings. So levels are joined with each other, from the root down, and the
rows only once. Digests travel as 32 bytes and are hashed as lowercase hex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_folder, stored, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, ``:`` and the text; so no two rows have one spelling."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, tree: str, order: list[Column], work: str) -> DataFrame:
    """rows with ``pos``, the place from 0 in its tree by ``order``, and ``size``, the tree's rows.

    Rows are dealt by ranges of (tree, order) and numbered where they are; a tree of any size is spread over ranges, and
    only the ranges' counts are summed up.
    """
    by = [F.col(tree).asc_nulls_first(), *order]
    placed = stored(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("n", F.monotonically_increasing_id()), work
    ).withColumn("part", F.shiftright("n", 33))
    runs = placed.groupBy(tree, "part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    within = Window.partitionBy(tree)
    before = within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(
        runs.select(
            F.col(tree).alias("of"), F.col("part").alias("at"), "first",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(within).alias("size")
        ),
        work
    )
    same = F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return placed.join(runs, same).withColumn("pos", F.col("n") - F.col("first") + F.col("before")).drop(
        "n", "part", "of", "at", "first", "before"
    )


def pivoted(nodes: DataFrame, held: list[str], fanout: int) -> DataFrame:
    """(tree, pos, size, s0, s1, ...) of the parents: each child's ``held`` columns in the slot of its place."""
    slot = F.col("pos") % fanout
    return nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("parent"), "size").agg(*[
        F.max(F.when(slot == k, F.struct(*held))).alias(f"s{k}") for k in range(fanout)
    ]).withColumnRenamed("parent", "pos")


def slots(fanout: int) -> list[Column]:
    return [F.coalesce(F.col(f"s{k}.digest"), F.lit(b"")) for k in range(fanout)]


def parents(pivot: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, size, digest) of a pivot's parents; a tree's only leaf is its root as it is."""
    whole = digest(as_text(F.concat(*slots(fanout))))
    return pivot.select(
        "tree", "pos", F.ceil(F.col("size") / fanout).alias("size"),
        F.when(F.col("size") > 1, whole).otherwise(F.col("s0.digest")).alias("digest")
    )


def climbed(
    leaves: DataFrame, held: list[str], fanout: int, work: str, lowest: str | None
) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and (tree, digest) of the roots. leaves: tree, pos, size, ``held``."""
    pivots = [stored(pivoted(leaves, held, fanout), lowest)]
    largest = pivots[0].agg(F.max("size")).first()[0] or 1
    nodes = parents(pivots[0], fanout)
    roots = nodes.filter("size = 1")
    for _ in range(1, max(1, math.ceil(math.log(largest, fanout) - 1e-9))):
        pivots.append(stored(pivoted(nodes.filter("size > 1"), ["digest"], fanout), work))
        nodes = parents(pivots[-1], fanout)
        roots = roots.unionByName(nodes.filter("size = 1"))
    return pivots, stored(roots.select("tree", "digest"), work)


def descended(pivot: DataFrame, above: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """The children of a pivot with ``path``: their (left, right) siblings, then those of their parents in ``above``.

    above: tree, pos, path and ``kept``, which the children take over.
    """
    own, child = slots(fanout), []
    for k in range(fanout):
        sides = F.struct(F.concat(F.lit(b""), *own[:k]).alias("left"), F.concat(F.lit(b""), *own[k + 1 :]).alias("right"))
        step = F.when(F.col("size") > 1, F.array(sides)).otherwise(F.slice(F.array(sides), 1, 0))
        child.append(F.when(
            F.col(f"s{k}").isNotNull(),
            F.struct((F.col("pos") * fanout + k).alias("pos"), F.col(f"s{k}").alias("own"), step.alias("step"))
        ))
    wide = pivot.select("tree", "pos", F.explode(F.array_compact(F.array(*child))).alias("c"))
    up = above.select(F.col("tree").alias("t"), F.col("pos").alias("p"), "path", *kept)
    return wide.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("pos") == F.col("p"))).select(
        "tree", F.col("c.pos").alias("pos"), F.col("c.own").alias("own"), F.concat("c.step", "path").alias("path"), *kept
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path of (left, right) siblings."""
    return F.aggregate(path, leaf, lambda at, s: digest(as_text(F.concat(s["left"], at, s["right"]))))


def siblings_text(path: Column) -> Column:
    """All siblings of a path as hex, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: as_text(F.concat(s["left"], s["right"]))), "")


def manifest(
    docs: DataFrame, leaf: Column, tree: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None,
    fanout: int = FANOUT
) -> DataFrame:
    """Per row: tree, key (as ``doc_id``), the columns of ``keep``, leaf, subroot, root (binary) and path.

    leaf: the row's digest, as ``leaf_of`` makes it. path: an array of (left, right) siblings up to the root, so that
    ``folded(leaf, path)`` is the root. Trees are in order of ``tree``, null first and then by bytes; a tree's rows go by
    key, null first; rows of one key by their leaves, so that only equal rows change places. Nulls are values of their
    own; an empty table has no rows and no root; other columns are ignored, whatever their names.
    """
    spark, work = docs.sparkSession, shared_folder(docs.sparkSession)
    keep = keep or {}
    rows = stored(
        docs.select(
            F.col(f"`{tree}`").alias("tree"), F.col(f"`{key}`").alias("doc_id"), leaf.alias("digest"),
            F.struct(*[c.alias(k) for k, c in keep.items()], F.lit(0).alias("_")).alias("keep")
        ), work
    )
    leaves = numbered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], work)
    low, subroots = climbed(leaves, ["digest", "doc_id", "keep"], fanout, work, None)
    # The groups' digests are the leaves of one tree more.
    tops = numbered(
        subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), "tree",
        [F.col("name").asc_nulls_first()], work
    )
    high, root = climbed(tops, ["digest", "name"], fanout, work, work)
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    above = root.select("tree", F.lit(0).cast("long").alias("pos"), none.alias("path"), F.col("digest").alias("root"))
    for pivot in reversed(high):
        above = stored(descended(pivot, above, fanout, ["root"]), work)
    crowns = stored(
        above.select(
            F.col("own.name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root",
            F.col("own.digest").alias("subroot")
        ), work
    )
    # A group's root is at the level where its nodes come down to one, so it joins the nodes above each level.
    above, kept = crowns, ["root", "subroot"]
    for pivot in reversed(low[1:]):
        ends = pivot.filter("pos = 0").select("tree", F.lit(True).alias("later"))
        under = stored(descended(pivot, above, fanout, kept).drop("own"), work)
        rest = crowns.join(ends, crowns["tree"].eqNullSafe(ends["tree"]), "left_anti")
        above = stored(under.unionByName(rest), work)
    # What is returned reads the lowest pivot and the paths above it.
    found = descended(low[0], stored(above), fanout, kept)
    discard(spark, work)
    return found.select(
        "tree", F.col("own.doc_id").alias("doc_id"), *[F.col(f"own.keep.{k}").alias(k) for k in keep],
        F.col("own.digest").alias("leaf"), "subroot", "root", "path"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by language; where 3 divides crc32(doc_id), the text's A-Z are lowered after the fact.

    A null doc_id has no crc32 and is not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf_of([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs, leaf_of([F.col(c) for c in FIELDS]), keep={"tampered": F.when(changed, lowered)})
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings_text(F.col("path")), 256).alias("proof_sha256"),
        again.alias("folded_root")
    ).select(
        "doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"), "proof_sha256", as_text(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


SQL = rf"""
WITH RECURSIVE
bits AS (
  SELECT range AS n, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295 AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, i + 1, xor(b.c, crc.c >> 8)
  FROM crc JOIN bits b ON b.k = 8 AND b.n = (xor(crc.c, ascii(substr(s, i + 1, 1))) & 255)
  WHERE i < length(s)
),
changed AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 3 = 0),
d AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM changed)
      THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_sql_leaf("text")} END AS tampered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS size
  FROM d
),
nodes AS (
  SELECT 0 AS level, lang, pos, size, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE size > 1 GROUP BY level, lang, pos // 8, size
),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM nodes WHERE size = 1
),
tops AS (
  SELECT 0 AS level, pos, size, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE size > 1 GROUP BY level, pos // 8, size
),
height AS (SELECT lang, max(level) AS levels FROM nodes GROUP BY lang),
sides AS (
  SELECT a.level, a.lang, a.pos,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b
    ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8
  WHERE a.size > 1 GROUP BY ALL
),
top_sides AS (
  SELECT a.level, a.pos,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.size > 1 GROUP BY ALL
),
steps AS (
  SELECT lang, level, pos, l, r, false AS top FROM sides
  UNION ALL
  SELECT s.lang, h.levels + t.level, t.pos, t.l, t.r, true
  FROM subroots s JOIN height h ON s.lang IS NOT DISTINCT FROM h.lang
  JOIN top_sides t ON t.pos = s.pos // power(8, t.level)::BIGINT
),
fold AS (
  SELECT doc_id, lang, leaf, pos, 0 AS level, tampered AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.pos, f.level + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM fold f JOIN steps s ON s.level = f.level AND s.lang IS NOT DISTINCT FROM f.lang
    AND (s.top OR s.pos = f.pos // power(8, f.level)::BIGINT)
),
ends AS (SELECT lang, max(level) + 1 AS levels FROM steps GROUP BY lang),
root AS (SELECT h AS root FROM tops WHERE size = 1)
SELECT f.doc_id, f.leaf, s.h AS subroot, root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM fold f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
LEFT JOIN ends e ON e.lang IS NOT DISTINCT FROM f.lang CROSS JOIN root
WHERE f.level = coalesce(e.levels, 0)
"""
