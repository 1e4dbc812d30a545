"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words (hashed, A-Z lowered), the pairs of character classes that follow each other (64 x 64),
and two that stand for a word, or a line, that repeats the one before. Their damped counts, weighted by inverse document
frequency, are projected by a truncated SVD that is fitted in numpy on a bounded sample of labelled rows. The sample's
vectors and labels are broadcast; every document is compared with all of them in exact blocked matrix products, and the
nearest vote with weights that grow with their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, in_part, kept_columns, named, ordered_sample, plain_names, table, utf8

#: Labelled rows that are learned from, half of each label at most; the bound of what is broadcast.
SAMPLE = 3000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Weights are the cosine to this power.
SHARPNESS = 8
#: Weight of the labels' mean among the neighbours.
PRIOR_WEIGHT = 0.1
CLASSES = 64
#: Bytes of text that are turned to counts at a time.
CHUNK = 1 << 20


def class_table() -> np.ndarray:
    """Byte to class: a-z one each, A-Z, digits, space and line end one together, ASCII signs one each, the rest two."""
    to = np.zeros(256, np.int64)
    to[0x61:0x7B] = np.arange(26)
    to[0x41:0x5B], to[0x30:0x3A], to[0x20], to[[0x0A, 0x0D]] = 26, 27, 28, 29
    signs = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    to[signs] = 30 + np.arange(len(signs))
    to[0x80:0xC0], to[0xC0:] = 62, 63
    return to


CLASS_OF = class_table()
PAIRS, WORDS = CLASSES * CLASSES, 1 << 12
FEATURES = PAIRS + WORDS + 2
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_HASHED = np.random.default_rng(11).integers(1, 1 << 62, (2, 256), dtype=np.int64)


def word_values(data: np.ndarray, row: np.ndarray, place: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, their hashes, which are sums over their bytes, and the number of line ends before each.

    place: how many bytes of the first word came before; 0 if none.
    """
    gap = (data == 0x20) | (data == 0x0A) | (data == 0x0D) | (data == 0x09)
    first = ~gap
    first[1:] &= gap[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, starts
    at = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    if place and starts[0] == 0:
        at[: np.r_[starts, len(data)][1]] += place
    value = np.add.reduceat(np.where(gap, 0, _HASHED[0][_LOWER[data]] * (_HASHED[1][at & 255] | 1)), starts)
    return starts, value, np.cumsum(data == 0x0A)[starts]


def bucket_of(value: np.ndarray) -> np.ndarray:
    return ((value * -0x61C8864680B583EB) >> 40) & (WORDS - 1)


def word_terms(own: np.ndarray, value: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of all words, and of the words and the lines of a word or more that equal the one before in their row."""
    if not len(value):
        return own, own
    again = (value[1:] == value[:-1]) & (own[1:] == own[:-1])
    at = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (own[1:] != own[:-1])])
    step = np.arange(len(value)) - np.repeat(at, np.diff(np.r_[at, len(value)]))
    whole = np.add.reduceat(value * (_HASHED[1][step & 255] | 1), at)
    same = (whole[1:] == whole[:-1]) & (own[at][1:] == own[at][:-1])
    rows = [own, own[1:][again], own[at][1:][same]]
    return np.concatenate(rows), np.concatenate(
        [PAIRS + bucket_of(value), np.full(len(rows[1]), FEATURES - 2), np.full(len(rows[2]), FEATURES - 1)]
    )


def long_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of one long text and the number of line ends before each, read in pieces; a word that a piece's
    end cuts is one word."""
    values, lines, held, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        starts, value, line = word_values(part, np.zeros(len(part), np.int64), held)
        line = line + seen
        if held and len(starts) and starts[0] == 0:
            values[-1][-1:] += value[:1]
            value, line = value[1:], line[1:]
        if len(value):
            values.append(value), lines.append(line)
        seen += int((part == 0x0A).sum())
        gaps = np.flatnonzero((part == 0x20) | (part == 0x0A) | (part == 0x0D) | (part == 0x09))
        held = len(part) - 1 - int(gaps[-1]) if len(gaps) else held + len(part)
    return np.concatenate(values), np.concatenate(lines)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count), by row; a text longer than CHUNK is read piece by piece, with the same counts."""
    n, lo, hi = len(offsets) - 1, int(offsets[0]), int(offsets[-1])
    out = np.zeros(n * FEATURES, np.int64)
    for a in range(lo, max(hi - 1, lo), CHUNK):
        b = min(hi, a + CHUNK + 1)
        c = CLASS_OF[data[a:b]]
        row = np.repeat(np.arange(n), np.diff(np.clip(offsets, a, b - 1)))
        inside = np.arange(a + 1, b) < offsets[row + 1]
        out += np.bincount((row * FEATURES + c[:-1] * CLASSES + c[1:])[inside], minlength=n * FEATURES)
    if n == 1 and hi - lo > CHUNK:
        value, line = long_words(data[lo:hi])
        rows, terms = word_terms(np.zeros(len(value), np.int64), value, line)
    else:
        row = np.repeat(np.arange(n), np.diff(offsets))
        starts, value, line = word_values(data[lo:hi], row)
        rows, terms = word_terms(row[starts], value, line)
    out += np.bincount(rows * FEATURES + terms, minlength=n * FEATURES)
    found = np.flatnonzero(out)
    return found // FEATURES, found % FEATURES, out[found]


class Neighbours:
    """The fitted projection, the labelled vectors and their labels."""

    def __init__(
        self, sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float = 0.5,
        dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS
    ):
        """sample: terms and counts of each labelled row."""
        n = len(sample)
        rows = np.repeat(np.arange(n), [len(t) for t, _ in sample])
        terms = np.concatenate([t for t, _ in sample]).astype(np.int64) if n else np.zeros(0, np.int64)
        counts = np.concatenate([c for _, c in sample]) if n else np.zeros(0)
        self.weight = (np.log((1 + n) / (1 + np.bincount(terms, minlength=FEATURES))) + 1).astype(np.float32)
        x = self.damped(rows, terms, counts, n)
        cuts = np.searchsorted(rows, np.arange(0, n + 256, 256))

        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            """Dense blocks of 256 rows at a time."""
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                dense = np.zeros((min(256, n - 256 * k), FEATURES), np.float32)
                dense[rows[a:b] - 256 * k, terms[a:b]] = x[a:b]
                yield 256 * k, dense

        rng = np.random.default_rng(7)
        k = min(dimensions, n, FEATURES)
        q = rng.standard_normal((FEATURES, min(k + 16, n or 1))).astype(np.float32)
        for _ in range(3):  # power iterations of the randomised SVD
            y = np.zeros_like(q)
            for _, block in blocks():
                y += block.T @ (block @ q)
            q, _ = np.linalg.qr(y)
        if n:
            _, _, vt = np.linalg.svd(np.concatenate([block @ q for _, block in blocks()]), full_matrices=False)
            self.projection = (q @ vt[:k].T).astype(np.float32)
        else:
            self.projection = np.zeros((FEATURES, 1), np.float32)
        self.vectors = self.project(rows, terms, counts, n)
        self.labels = labels.astype(np.float32)
        self.k = min(neighbours, n)
        self.prior = prior

    def damped(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.weight[terms]
        return x / np.maximum(np.sqrt(np.bincount(rows, x * x, n)), 1e-9)[rows].astype(np.float32)

    def project(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        v = np.zeros((n, self.projection.shape[1]), np.float32)
        if len(rows):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            x = self.damped(rows, terms, counts, n)
            for a in range(0, len(starts), 64):  # so that the products stay small
                lo, hi = starts[a], starts[a + 64] if a + 64 < len(starts) else len(rows)
                v[rows[starts[a : a + 64]]] = np.add.reduceat(
                    self.projection[terms[lo:hi]] * x[lo:hi, None], starts[a : a + 64] - lo
                )
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)

    def scores(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by cosine, and a fixed small weight for the labels' mean: a text
        unlike all labelled ones, or without any term, gets about that. Of equally near rows, the first in the sample's
        order count."""
        if not self.k:
            return np.full(n, self.prior)
        cosine = self.project(rows, terms, counts, n) @ self.vectors.T
        last = -np.partition(-cosine, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        above = cosine > last
        tie = cosine == last
        near = above | tie & (np.cumsum(tie, 1) <= self.k - above.sum(1, keepdims=True))
        weight = np.where(near, np.maximum(cosine, 0).astype(np.float64) ** SHARPNESS, 0.0)
        return (weight @ self.labels + PRIOR_WEIGHT * self.prior) / (weight.sum(1) + PRIOR_WEIGHT)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(id, text, label) of documents with at most rows/2 ids of each label 0 and 1, those whose ids hash lowest.

    Labels of ids that carry both values, and null labels, are left out. The ids, bounded by rows, are broadcast; a repeated
    id gives all its rows.
    """
    clean = labels.filter(named(label).isin(0, 1)).groupBy(named(doc_id).alias("id")).agg(
        F.min(named(label)).alias("label"), F.max(named(label)).alias("other")
    ).filter("label = other")
    ids = None
    for value in (0, 1):
        own = ordered_sample(clean.filter(F.col("label") == value).select("id", "label"), "id", rows // 2)
        ids = own if ids is None else ids.unionByName(own)
    return docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    ).join(F.broadcast(ids), "id").select("id", "text", F.col("label").cast("int").alias("label"))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text",
    doc_id: str = "doc_id"
) -> Neighbours:
    """Learns from ``sample`` labelled documents at most, half of each label; of rows that repeat an id, one counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in batches_of(offsets, CHUNK, 128):
                rows, terms, n = term_counts(data, offsets[a : b + 1])
                at = np.searchsorted(rows, np.arange(b - a + 1))
                packed = [
                    np.stack([terms[i:j], n[i:j]]).astype("<i8").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(packed, pa.binary())],
                    ["id", "label", "terms"]
                )

    bounded_batches(docs.sparkSession)
    found = labelled_sample(docs, labels, label, sample, text, doc_id)
    kind = found.schema["id"].dataType.simpleString()
    found = found.mapInArrow(
        count, f"id {kind}, label int, terms binary"
    ).groupBy("id", "label").agg(F.min("terms").alias("terms"))
    got = found.select("label", "terms").toPandas().sort_values(["label", "terms"])  # the same order in every run
    rows = [tuple(np.frombuffer(x, "<i8").reshape(2, -1)) for x in got["terms"]]
    prior = labels.filter(named(label).isin(0, 1)).agg(F.avg(named(label))).first()[0]
    return Neighbours(rows, got["label"].to_numpy(np.float64), 0.5 if prior is None else float(prior))


def score(
    docs: DataFrame, model: Neighbours, text: str = "text", keep: list[str] | None = None, into: str = "score"
) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and the score of each row's whole text, between 0 and 1.

    A null or empty text has the mean label as score; without labels every text has 0.5. Rows are scored one by one, repeated
    ones alike; a column named as ``into`` is replaced; an empty table gives no rows.
    """
    keep = kept_columns(docs, keep, [into])
    plain = plain_names(keep)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            parts = [
                held.value.scores(*term_counts(data, offsets[a : b + 1]), b - a) for a,
                b in batches_of(offsets, CHUNK, 128)
            ]
            found = np.clip(np.concatenate(parts) if parts else np.zeros(0), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(plain))), pa.array(found)], [*plain, "\x01into"]
            )

    slim = docs.select(*[named(c).alias(p) for c, p in zip(keep, plain, strict=True)])
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema)
    both = docs.select(
        *[named(c).alias(p) for c, p in zip(keep, plain, strict=True)], named(text).cast("string").alias("\x01text")
    )
    return both.mapInArrow(run, f"{own}`\x01into` double").toDF(*keep, into)


THRESHOLD = 0.3


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every ``documents`` text; learns from labels whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~in_part(F.col("doc_id"), 5, 0)))
    out = score(docs, model, keep=["doc_id"])
    return out.select(
        "doc_id", in_part(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
