"""Multilingual mixture inference: each document is a mixture of languages over its n-grams.

Per language, hashed byte trigrams are counted over a sample of known documents. Expectation-maximisation then finds a
document's language proportions from the n-grams' likelihoods. Languages enter in the order of their proportions as long
as the likelihood grows by more than a penalty of half the logarithm of the number of n-grams for each (BIC).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, in_part, kept_columns, lower_table, named, plain_names, table, utf8

#: Documents learned from for each language, about: ids are taken whose hash lies below this share of the language's.
PER_LANGUAGE = 2000
BUCKETS = 1 << 14
ROUNDS = 10
CHUNK = 1 << 20
LOWER = lower_table()
LOWER[0x30:0x3A] = 0x20  # digits tell no language
#: Overlapping trigrams repeat each byte three times, so their likelihoods count a third.
OVERLAP = 3.0


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the trigrams of lowered letters, by row; runs of other bytes are one space.

    One text longer than CHUNK is read in pieces; the last two bytes kept of a piece stand before the next one's.
    """
    lo, hi, n = int(offsets[0]), int(offsets[-1]), len(offsets) - 1
    counted = np.zeros(n * BUCKETS, np.int64)
    step = CHUNK if n == 1 else max(1, hi - lo)
    before = np.zeros(0, np.int64)
    for a in range(lo, hi, step):
        b = min(hi, a + step)
        c = np.concatenate([before, LOWER[data[a:b]].astype(np.int64)])
        row = np.zeros(len(c), np.int64) if n == 1 else np.repeat(np.arange(n), np.diff(offsets))
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0x20) | (c[:-1] != 0x20) | (row[1:] != row[:-1])
        c, row = c[keep], row[keep]
        before = c[-2:] if n == 1 else before
        if len(c) < 3:
            continue
        code = (c[:-2] * 0x9E3779B1 ^ c[1:-1] * 0x85EBCA77 ^ c[2:] * 0xC2B2AE3D) * 0x27D4EB2F
        bucket = (code >> 20) & (BUCKETS - 1)
        inside = row[2:] == row[:-2]
        counted += np.bincount(row[:-2][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS)
    found = np.flatnonzero(counted)
    return found // BUCKETS, found % BUCKETS, counted[found]


class Languages:
    """names and log-likelihoods (BUCKETS, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.names = names
        self.likelihood = ((counts + smooth) / (counts.sum(0) + smooth * BUCKETS)).astype(np.float32)

    def mixture(
        self, row: np.ndarray, lik: np.ndarray, count: np.ndarray, n: int, allowed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (n, languages) by EM over the allowed languages, and log-likelihoods; rows are sorted."""
        share = allowed / allowed.sum(1, keepdims=True)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at = row[starts]
        total = np.add.reduceat(count, starts)
        for _ in range(ROUNDS):
            part = lik * share[row]
            part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
            share[at] = np.add.reduceat(part, starts, axis=0) / total[:, None]
        logs = np.zeros(n)
        logs[at] = np.add.reduceat(count * np.log(np.maximum((lik * share[row]).sum(1), 1e-30)), starts)
        return share, logs

    def infer(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """(n, languages) proportions of the language sets with the best penalised likelihood; equal shares without n-grams."""
        size = len(self.names)
        share = np.full((n, size), 1 / size, np.float32)
        if not len(row):
            return share
        lik, count = self.likelihood[bucket], count.astype(np.float32)
        full, _ = self.mixture(row, lik, count, n, np.ones((n, size), np.float32))
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        grams_of = np.bincount(row, count, n)
        penalty = 0.5 * np.log(np.maximum(grams_of, 2))
        share = (rank == 0).astype(np.float32)
        logs = np.bincount(row, count * np.log(np.take_along_axis(lik, order[row, :1], 1)[:, 0]), n)
        open_, sel = grams_of > 0, np.ones(len(row), bool)
        share[~open_] = 1 / size
        for k in range(1, size):
            sel = open_[row]
            if not sel.any():
                break
            more, more_logs = self.mixture(row[sel], lik[sel], count[sel], n, (rank <= k).astype(np.float32))
            open_ = open_ & ((more_logs - logs) / OVERLAP > penalty)
            share[open_], logs[open_] = more[open_], more_logs[open_]
        return share


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE
) -> Languages:
    """Counts trigrams over about per_language documents of each language (all, where it has fewer), summed in Spark."""
    bounded_batches(docs.sparkSession)
    known = docs.filter(named(lang).isNotNull()).select(
        named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"), named(lang).cast("string").alias("lang")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    taken = known.join(F.broadcast(sizes), "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) * F.col("n") < F.lit(1_000_003) * per_language
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            names, code = np.unique(
                np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True
            )
            for a, b in batches_of(offsets, CHUNK):
                row, bucket, n = grams(data, offsets[a : b + 1])
                total = np.bincount(code[a + row] * BUCKETS + bucket, n, len(names) * BUCKETS)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at // BUCKETS]), pa.array(at % BUCKETS), pa.array(total[at].astype(np.int64))],
                    ["lang", "bucket", "n"]
                )

    got = taken.select("text", "lang").mapInArrow(
        count, "lang string, bucket long, n long"
    ).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(names)))
    counts[got["bucket"].to_numpy(np.int64), np.searchsorted(names, got["lang"])] = got["n"]
    return Languages(list(names), counts)


def detect(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None), lang_pred, score (its proportion) and mixture (map of language to
    proportion, those of the chosen set).

    A null text, or one without any letter, is ``und`` with score 0 and an empty mixture; so is every text if nothing was
    learned. Letters that yield no trigram get equal proportions. Whole texts are read; columns named alike are replaced.
    """
    keep = kept_columns(docs, keep, ["lang_pred", "score", "mixture"])
    plain = plain_names(keep)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            letters = np.asarray(batch.column(len(keep) + 1).to_numpy(zero_copy_only=False), bool)
            names, scores, mixed = [], [], []
            for a, b in batches_of(offsets, CHUNK):
                share = m.infer(*grams(data, offsets[a : b + 1]), b - a) if m.names else np.zeros((b - a, 0))
                for own, ok in zip(share, letters[a:b], strict=True):
                    if not ok or not m.names:
                        names.append("und"), scores.append(0.0), mixed.append([])
                    else:
                        best = int(own.argmax())
                        names.append(m.names[best]), scores.append(min(1.0, float(own[best]))), mixed.append(
                            [(m.names[k], float(own[k])) for k in np.flatnonzero(own > 1e-4)]
                        )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))
                ],
                [*plain, "lang_pred", "score", "mixture"]
            )

    kept = docs.select(*[named(c).alias(p) for c, p in zip(keep, plain, strict=True)])
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    slim = docs.select(
        *[named(c).alias(p) for c, p in zip(keep, plain, strict=True)], named(text).cast("string").alias("\x01text"),
        F.coalesce(named(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("\x01letters")
    )
    found = slim.mapInArrow(run, own + "lang_pred string, score double, mixture map<string,double>")
    return found.toDF(*keep, "lang_pred", "score", "mixture")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole ``documents`` text, learned from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~in_part(F.col("doc_id"), 4, 2)))
    return detect(docs, model, keep=["doc_id"]).select(
        "doc_id", in_part(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "mixture"
    )
