"""Hard negatives by inner product, with length buckets and pruning by coordinates.

All rows are dealt into buckets of similar length. A bucket holds, for every coordinate, its rows in order of that
coordinate of their unit vectors. An anchor that looks for scores of at least t in a bucket of greatest length m needs a
cosine of c = t / (length * m) or more there, so none if c > 1. Otherwise, with the angle between unit vectors at most
arccos(c), each coordinate of a row is within cos(arccos(a) +- arccos(c)) of the anchor's own coordinate a. These ranges
are cut out of the sorted lists for the anchor's ``FOCUS`` largest coordinates, and only rows in all of them are scored.

Anchors go in blocks of a stated size, each broadcast once for the positives and once for the negatives; every task keeps
the best so far, which is the threshold t of its next buckets. Scores are exact: components are whole numbers, and products
of lengths stay below 2^53.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shared_folder, stored, table

SCALE = 256
#: Rows in a bucket, anchors in a block, coordinates that prune.
BUCKET, ANCHORS, FOCUS = 2048, 4096, 4
#: Anchors compared with a bucket at a time.
STEP = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores from LOW to HIGH hundredths of its positive.
LOW, HIGH = 30, 90
_BUCKET_TYPE = "n int, d int, ids binary, known binary, asked binary, labels binary, rows binary, vectors binary, order binary"


def prepared(
    rows: DataFrame, key: str, vector: str, label: Column, anchors: Column, scale: int = SCALE
) -> DataFrame:
    """(id, label, v, length, asked) of the rows that take part: label, vector and all components are there and finite."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    kept = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asked"), (v.isNull() | bad).alias("out")
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return kept.filter("NOT out AND label IS NOT NULL").select("id", "label", "v", "asked", F.sqrt(square).alias("length"))


def padded(vectors: list, least: int = 1) -> np.ndarray:
    """Vectors as rows of one matrix; missing last components are zero."""
    d = max([least, *map(len, vectors)])
    if all(len(v) == d for v in vectors):
        return np.array(vectors, np.float64).reshape(len(vectors), d)
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((v * v).sum(1))
    return v / np.where(length > 0, length, 1)[:, None], length


def bucketed(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """The rows in buckets of about ``size`` rows of similar length, longest first in a task, with sorted coordinate lists."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, v = b.column(0), padded(b.column(2).to_pylist())
            unit, _ = units(v)
            small = np.abs(v).max(initial=0) < 1 << 15
            held = [
                np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_valid()).astype(np.uint8),
                np.asarray(b.column(4)).astype(np.uint8), b.column(1).to_numpy().astype("<i8"),
                b.column(3).to_numpy().astype("<i8"), v.astype("<i2" if small else "<f8"),
                np.argsort(unit, axis=0, kind="stable").T.astype("<u4" if len(v) > 1 << 16 else "<u2")
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()),
                 *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in held]],
                ["n", "d", "ids", "known", "asked", "labels", "rows", "vectors", "order"]
            )

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                yield bucket(batch.slice(a, size))

    # Equal lengths are dealt over ranges as well, by the row's hash.
    ranged = rows.withColumn("_h", F.xxhash64("id", "v"))
    by = [F.col("length").desc(), F.col("_h")]
    # The row's number tells rows of one id apart; it is read from the written buckets.
    numbered = ranged.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "id", "label", "v", F.monotonically_increasing_id().alias("row"), "asked"
    )
    return numbered.mapInArrow(fill, _BUCKET_TYPE)


class Bucket:
    """A bucket as it is read: whole-number vectors, their unit vectors and the rows in order of each coordinate."""

    def __init__(self, r: dict, d: int) -> None:
        n = r["n"]
        own = np.frombuffer(r["vectors"], "<i2" if len(r["vectors"]) == 2 * n * r["d"] else "<f8").reshape(n, r["d"])
        self.v = np.zeros((n, max(d, r["d"])))
        self.v[:, : r["d"]] = own
        self.ids, self.labels, self.rows = (np.frombuffer(r[k], "<i8") for k in ("ids", "labels", "rows"))
        self.known = np.frombuffer(r["known"], np.uint8).astype(bool)
        kind = "<u4" if len(r["order"]) == 4 * n * r["d"] else "<u2"
        self.order = np.frombuffer(r["order"], kind).reshape(r["d"], n)
        self.unit, length = units(self.v)
        self.least, self.most = float(length.min(initial=np.inf)), float(length.max(initial=0))


def scores(anchors: np.ndarray, least: np.ndarray, bucket: Bucket, focus: int = FOCUS) -> tuple[np.ndarray, int]:
    """Scores (anchors x rows) of the rows that may reach ``least``, -inf for those pruned; and how many were scored."""
    unit, length = units(anchors)
    if length.max(initial=0) * bucket.most >= 1 << 53:
        raise ArithmeticError("inner products of these vectors are beyond 2^53 and not exact")
    n, d = bucket.v.shape
    out = np.full((len(anchors), n), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = least / (length * np.where(least > 0, bucket.most, bucket.least))
    # Room for rounding; an anchor or a bucket of length zero prunes nothing by angle.
    cosine = np.where(np.isnan(cosine), -1, cosine) - 1e-9
    live = np.flatnonzero(cosine <= 1)
    if not len(live) or not n:
        return out, 0
    angle = np.arccos(np.clip(cosine[live], -1, 1))
    dims = np.argsort(-np.abs(unit[live, : len(bucket.order)]), axis=1)[:, :focus]
    own = np.arccos(np.clip(np.take_along_axis(unit[live], dims, 1), -1, 1))
    low = np.cos(np.minimum(np.pi, own + angle[:, None])) - 1e-9
    high = np.cos(np.maximum(0, own - angle[:, None])) + 1e-9
    begin, end = np.zeros(dims.shape, int), np.zeros(dims.shape, int)
    for f in np.unique(dims):
        at = dims == f
        values = bucket.unit[bucket.order[f], f]
        begin[at] = np.searchsorted(values, low[at], "left")
        end[at] = np.searchsorted(values, high[at], "right")
    narrow = np.argmin(end - begin, axis=1)
    reach = np.take_along_axis(end - begin, narrow[:, None], 1)[:, 0]
    wide = 2 * reach > n  # most rows are candidates: one product for all of these anchors
    out[live[wide]] = anchors[live[wide]] @ bucket.v.T
    scored = int(wide.sum()) * n
    for k in np.flatnonzero(~wide & (reach > 0)):
        j = narrow[k]
        near = bucket.order[dims[k, j], begin[k, j] : end[k, j]].astype(int)
        for m in range(dims.shape[1]):
            x = bucket.unit[near, dims[k, m]]
            near = near[(x >= low[k, m]) & (x <= high[k, m])]
        out[live[k], near] = bucket.v[near] @ anchors[live[k]]
        scored += len(near)
    return out, scored


class Best:
    """The first ``k`` rows of each list by score, then id with null last, then row."""

    def __init__(self, lists: int, k: int) -> None:
        self.k, self.kth = k, np.full(lists, -np.inf)
        self.held = {c: np.zeros(0, t) for c, t in (("of", int), ("score", float), ("none", bool), ("id", int), ("row", int))}

    def add(self, of: np.ndarray, score: np.ndarray, at: np.ndarray, bucket: Bucket) -> None:
        new = {"of": of, "score": score, "none": ~bucket.known[at], "id": bucket.ids[at], "row": bucket.rows[at]}
        h = {c: np.concatenate([self.held[c], new[c]]) for c in new}
        order = np.lexsort((h["row"], h["id"], h["none"], -h["score"], h["of"]))
        of = h["of"][order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        self.held = {c: x[order][place < self.k] for c, x in h.items()}
        full = place == self.k - 1
        self.kth[of[full]] = h["score"][order][full]

    def table(self) -> pa.RecordBatch:
        h = self.held
        ids = pa.array(h["id"], pa.int64(), mask=h["none"])
        return pa.RecordBatch.from_arrays(
            [pa.array(h["of"], pa.int64()), pa.array(h["score"].astype(np.int64)), ids, pa.array(h["row"])],
            ["of", "score", "id", "row"]
        )


def searched(buckets: DataFrame, spark: SparkSession, block: dict, k: int, bands: bool, focus: int = FOCUS) -> DataFrame:
    """(of, score, id, row): each task's first k rows of each list.

    block: vectors, labels and rows of the anchors, and lists: of which anchor, and with ``bands`` the least and greatest
    scores. Without bands, a list wants rows of its anchor's label other than the anchor; with bands, of another label.
    """
    sent = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        v, labels, rows, anchor = b["v"], b["labels"], b["rows"], b["anchor"]
        best = Best(len(anchor), k)
        first = np.searchsorted(anchor, np.arange(len(v) + 1))  # lists are in order of anchor
        for batch in batches:
            for r in batch.to_pylist():
                bucket = Bucket(r, v.shape[1])
                wide = np.pad(v, ((0, 0), (0, bucket.v.shape[1] - v.shape[1])))
                for a in range(0, len(v), STEP):
                    z = min(a + STEP, len(v))
                    lists = np.arange(first[a], first[z])
                    if not len(lists):
                        continue
                    floor = np.maximum(best.kth[lists], b["low"][lists]) if bands else best.kth[lists]
                    least = np.full(z - a, np.inf)
                    np.minimum.at(least, anchor[lists] - a, floor)
                    s, _ = scores(wide[a:z], least, bucket, focus)
                    same = labels[a:z, None] == bucket.labels[None, :]
                    s[same if bands else ~same] = -np.inf
                    if not bands:
                        s[rows[a:z, None] == bucket.rows[None, :]] = -np.inf
                    mine = s[anchor[lists] - a]
                    ok = (mine >= floor[:, None]) & (mine > -np.inf)
                    if bands:
                        ok &= mine <= b["high"][lists][:, None]
                    x, y = np.nonzero(ok)
                    if len(x):
                        best.add(lists[x], mine[x, y], y, bucket)
        yield best.table()

    return buckets.mapInArrow(search, "of long, score long, id long, row long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each list over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("of").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    high: int = HIGH, bucket: int = BUCKET, block: int = ANCHORS, focus: int = FOCUS
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Components become whole
    numbers, floor(256 x); of vectors of unequal length the missing last components are zero; a row's score is its inner
    product with the anchor. An anchor's positives are its first ``positives`` other rows of the same label, by falling
    score, then id (null last); its negatives for one of them are the first ``negatives`` rows of other labels whose score
    is from ``low`` to ``high`` hundredths of the positive's. Rows of one id are rows of their own. Vectors whose lengths
    multiply to 2^53 or more raise an error. Other columns are ignored; without anchors there are no rows.

    anchors: which rows are anchors, a condition on the columns; every hundredth key by default. They are taken in blocks of
    ``block``, one driver round each: only a block, its scores' bounds and its positives are ever on the driver.
    """
    spark, work = rows.sparkSession, shared_folder(rows.sparkSession)
    bounded_batches(spark)
    label = F.col("label") if label is None else label
    anchors = F.col(f"`{key}`") % 100 == 0 if anchors is None else anchors
    buckets = stored(bucketed(prepared(rows, key, vector, label, anchors), bucket), work)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b, asked = Bucket(r, 0), np.frombuffer(r["asked"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids[asked], mask=~b.known[asked]), pa.array(b.labels[asked]), pa.array(b.rows[asked]),
                        pa.array(list(b.v[asked]), pa.list_(pa.float64()))
                    ], ["id", "label", "row", "v"]
                )

    asked = stored(
        buckets.mapInArrow(chosen, "id long, label long, row long, v array<double>").withColumn(
            "n", F.monotonically_increasing_id()
        ), work
    )
    results = []
    for first, last in ranges_of(asked, block):
        held = asked.filter(F.col("n").between(first, last)).toArrow()
        one = {
            "v": padded(held["v"].to_pylist()), "labels": held["label"].to_numpy(), "rows": held["row"].to_numpy(),
            "anchor": np.arange(held.num_rows)
        }
        near = firsts(searched(buckets, spark, one, positives, False, focus), positives).toArrow().sort_by(
            [("of", "ascending"), ("rank", "ascending")]
        )
        score, of = near["score"].to_numpy(), near["of"].to_numpy()
        two = one | {"anchor": of, "low": np.ceil(low * score / 100 - 1e-9), "high": np.floor(high * score / 100 + 1e-9)}
        lists = spark.createDataFrame(pa.table({
            "of": np.arange(len(of)), "anchor_id": held["id"].take(pa.array(of)), "positive_id": near["id"],
            "positive_score": near["score"]
        }))
        found = firsts(searched(buckets, spark, two, negatives, True, focus), negatives)
        # lists has at most block * positives rows.
        results.append(stored(
            found.join(F.broadcast(lists), "of").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score")
            )
        ))
    discard(spark, work)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return functools.reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], kind)


def ranges_of(asked: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of ``n`` with ``block`` rows each, the last with fewer; n counts up from 0 in each partition."""
    parts = asked.groupBy(F.shiftright("n", 33).alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part")
    counts = [tuple(r) for r in parts.collect()]
    ends = np.cumsum([rows for _, rows in counts])

    def number(place: int) -> int:
        i = int(np.searchsorted(ends, place, "right"))
        return (counts[i][0] << 33) + place - int(ends[i] - counts[i][1])

    total = int(ends[-1]) if counts else 0
    return [(number(a), number(min(a + block, total) - 1)) for a in range(0, total, block)]


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score,
  s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
