"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams, ends included; its embedding is the mean of theirs, so an unseen spelling shares
the vectors of the n-grams it keeps. A window of WINDOW words in a row is the mean of its words, and goes through a linear
softmax; embeddings and softmax are trained jointly in numpy, from random vectors, on a bounded sample of labelled
documents. Labels are of documents, and a few words make a long text toxic: in training and in scoring alike, a text is as
toxic as the most toxic of its windows, and every window of every text is scored. Training begins with averages over
WIDEST words, where no window is picked by chance, and narrows them to WINDOW.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, in_part, kept_columns, lower_table, named, plain_names, table, utf8
from .quality import labelled_sample

#: Labelled rows that are learned from, half of each label at most, and the bytes of a text among them at most; longer
#: texts are scored, but not learned from.
SAMPLE, LONGEST = 3000, 1 << 16
ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 8
#: Words of a window in scoring, and in the first epoch of training; windows narrow over the first half of the epochs.
WINDOW, WIDEST = 2, 16
CHUNK = 1 << 20
LOWER = lower_table()
_TABLES = np.random.default_rng(5).integers(0, 1 << 32, (max(ORDERS), 256), dtype=np.uint32)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes of the rows, a space before each and one at the end; and the places of the rows' first spaces."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    at = offsets[:-1] - offsets[0] + np.arange(n)
    out = np.full(int(lengths.sum()) + n + 1, 0x20, np.uint8)
    out[np.arange(int(lengths.sum())) + np.repeat(np.arange(1, n + 1), lengths)] = LOWER[data[offsets[0] : offsets[-1]]]
    return out, at


def subwords(text: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams that begin at the first ``starts`` places, and whether one lies in a single
    word, the spaces around it included. The text holds max(ORDERS) - 1 bytes more, if it goes on."""
    space = text == 0x20
    free, h = np.ones(starts, bool), np.zeros(len(text), np.uint32)  # free: no space inside so far
    for k in range(max(ORDERS)):
        h = h[: len(text) - k] ^ _TABLES[k][text[k:]]
        m = min(starts, len(h))
        if k + 1 in ORDERS:
            yield h[:m] & (BUCKETS - 1), free[:m].copy()
        if k:
            free[:m] &= ~space[k : k + m]


def window_bests(value: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words that begin at starts: the mean of the best window, the first on ties, and the window's first word.

    A row of fewer words is one window. No row is empty.
    """
    size = np.diff(np.r_[starts, len(value)])
    row = np.repeat(np.arange(len(starts)), size)
    wide = np.minimum(size, window)[row]
    total = np.r_[0.0, np.cumsum(value, dtype=np.float64)]
    ends = np.arange(len(value)) + wide
    inside = ends <= (starts + size)[row]
    mean = np.where(inside, (total[np.minimum(ends, len(value))] - total[:-1]) / wide, -np.inf)
    best = np.maximum.reduceat(mean, starts)
    hits = np.flatnonzero(mean == best[row])
    return best, hits[np.searchsorted(row[hits], np.arange(len(starts)))]


class Toxicity:
    """The fitted n-gram vectors and softmax; without labels of both values every text has ``prior`` as score."""

    def __init__(
        self, words: list[bytes], rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, prior: float = 0.5,
        epochs: int = 60, rate: float = 0.05, window: int = WINDOW
    ):
        """words: distinct; rows, ids: the words' indexes in each document, in their order; labels: 0 or 1 of each document."""
        self.window = window
        self.embedding = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        self.softmax, self.bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        self.learned = len(ids) > 0 and len(np.unique(labels[np.unique(rows)])) == 2
        if self.learned:
            self.train(words, rows, ids, labels.astype(int), epochs, rate)
        self.toward = (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)
        self.offset = float(self.bias[1] - self.bias[0]) if self.learned else float(np.log(prior / (1 - prior)))

    def train(
        self, words: list[bytes], rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, epochs: int, rate: float
    ) -> None:
        word, gram = [], []
        text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        of = np.cumsum(text == 0x20) - 1  # the space before a word belongs to it
        for bucket, inside in subwords(text, len(text) - 1):
            at = np.flatnonzero(inside)
            word.append(of[at].astype(np.int32)), gram.append(bucket[at])
        word, gram = np.concatenate(word), np.concatenate(gram)
        order = np.argsort(word, kind="stable")
        word, gram = word[order], gram[order]
        used = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[used] = np.arange(len(used))
        gram = place[gram]
        size = np.bincount(word, minlength=len(words))
        firsts = np.r_[0, np.cumsum(size)]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        ends = np.r_[starts[1:], len(ids)]
        docs = rows[starts]
        y = np.eye(2, dtype=np.float32)[labels[docs]]
        rng = np.random.default_rng(3)
        e = (rng.standard_normal((len(used), DIMENSIONS)) * 0.1).astype(np.float32)
        softmax = (rng.standard_normal((DIMENSIONS, 2)) * 0.1).astype(np.float32)
        bias = np.array([1, -1], np.float32)
        steps = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, softmax, bias)]
        for epoch in range(epochs):
            width = max(self.window, int(WIDEST * (1 - 2 * epoch / epochs)))
            logit = np.add.reduceat((e @ (softmax[:, 1] - softmax[:, 0]))[gram], firsts[:-1]) / size
            _, best = window_bests(logit[ids], starts, width)
            # Only the best windows are moved: their words, one after the other.
            wide = np.minimum(ends - best, width)
            of_doc = np.repeat(np.arange(len(docs)), wide)
            own = ids[np.repeat(best, wide) + np.arange(len(of_doc)) - np.repeat(np.r_[0, np.cumsum(wide)[:-1]], wide)]
            n = size[own]
            grams = gram[np.repeat(firsts[own], n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)]
            weight = np.repeat(1 / (n * np.repeat(wide, wide)), n).astype(np.float32)
            of_gram = np.repeat(of_doc, n)
            pooled = np.add.reduceat(
                e[grams] * weight[:, None], np.flatnonzero(np.r_[True, of_gram[1:] != of_gram[:-1]])
            )
            z = pooled @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            d = p / p.sum(1, keepdims=True) - y
            dv = d @ softmax.T
            de = np.stack(
                [np.bincount(grams, dv[of_gram, j] * weight, len(used)) for j in range(DIMENSIONS)], 1
            ).astype(np.float32)
            for x, g, own in zip((e, softmax, bias), (de, pooled.T @ d, d.sum(0)), steps, strict=True):  # Adam
                own[0] = 0.9 * own[0] + 0.1 * g
                own[1] = 0.99 * own[1] + 0.01 * g * g
                x -= rate * own[0] / (np.sqrt(own[1]) + 0.01)
        self.embedding[used] = e  # n-grams that no sampled word has say nothing
        self.softmax, self.bias = softmax, bias

    def word_sums(self, text: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """At each of the first ``starts`` places the sum over n-grams that begin there and lie in one word; and their number."""
        total, number = np.zeros(starts), np.zeros(starts, np.int64)
        for bucket, inside in subwords(text, starts):
            total[: len(bucket)] += self.toward[bucket] * inside
            number[: len(bucket)] += inside
        return total, number

    def long_logit(self, data: np.ndarray) -> float:
        """The best window of one text, read in pieces; a word cut by a piece's end is summed over both."""
        text_size, more = len(data) + 1, max(ORDERS) - 1  # a space before; the one after begins no word
        sums, numbers = [], []
        for a in range(0, text_size, CHUNK):
            b = min(a + CHUNK, text_size)
            own = np.full(min(b + more, text_size + 1) - a, 0x20, np.uint8)
            lo = max(a - 1, 0)
            part = LOWER[data[lo : a + len(own) - 1]]
            own[lo + 1 - a : lo + 1 - a + len(part)] = part
            total, number = self.word_sums(own, b - a)
            first = np.flatnonzero(own[: b - a] == 0x20)
            if not len(first) or first[0] > 0:  # goes on with the last piece's word
                stop = int(first[0]) if len(first) else b - a
                sums[-1][-1] += total[:stop].sum()
                numbers[-1][-1] += number[:stop].sum()
            if len(first):
                sums.append(np.add.reduceat(total, first)), numbers.append(np.add.reduceat(number, first))
        s, n = np.concatenate(sums), np.concatenate(numbers)
        s, n = s[n > 0], n[n > 0]
        return float(window_bests(s / n, np.zeros(1, np.int64), self.window)[0][0]) if len(n) else -np.inf

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row the logit of its best window; -inf without a word of three bytes, its ends included."""
        n = len(offsets) - 1
        if n == 1 and offsets[1] - offsets[0] > CHUNK:
            return np.array([self.long_logit(data[offsets[0] : offsets[1]])])
        out = np.full(n, -np.inf)
        text, at = spaced(data, offsets)
        total, number = self.word_sums(text, len(text) - 1)
        spaces = np.flatnonzero(text[:-1] == 0x20)
        if not len(spaces):
            return out
        s, k = np.add.reduceat(total, spaces), np.add.reduceat(number, spaces)
        row = np.searchsorted(at, spaces, "right") - 1
        s, k, row = s[k > 0], k[k > 0], row[k > 0]
        if len(s):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[starts]] = window_bests(s / k, starts, self.window)[0]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(data, offsets) if self.learned else np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.offset, -40, 40)))


def learned_from(texts: list[bytes], labels: np.ndarray, prior: float = 0.5, **settings) -> Toxicity:
    """Fits lowered texts of words between spaces."""
    index: dict[bytes, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in t.split()], np.int64) for t in texts]
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return Toxicity(list(index), rows, np.concatenate(ids) if ids else np.zeros(0, np.int64), labels, prior, **settings)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST,
    text: str = "text", doc_id: str = "doc_id"
) -> Toxicity:
    """Learns from ``sample`` labelled documents at most, half of each label, of ``longest`` bytes at most; one text an id."""
    found = labelled_sample(docs, labels, label, sample, text, doc_id).filter(F.octet_length("text") <= longest)
    got = found.groupBy("id", "label").agg(
        F.min("text").alias("text")
    ).select("text", "label").toPandas().sort_values(["label", "text"])
    lower = bytes(LOWER)
    return learned_from([t.encode().translate(lower) for t in got["text"]], got["label"].to_numpy(np.int64))


def score(
    docs: DataFrame, model: Toxicity, text: str = "text", keep: list[str] | None = None, into: str = "score"
) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and each row's toxicity between 0 and 1, of its most toxic window.

    A null or empty text, or one without a word, has a score of about 0; if the model has seen no two labels, every text has
    0.5. Rows are scored one by one, repeated ones alike; a column named as ``into`` is replaced; an empty table gives no
    rows.
    """
    keep = kept_columns(docs, keep, [into])
    plain = plain_names(keep)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            parts = [held.value.scores(data, offsets[a : b + 1]) for a, b in batches_of(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))),
                    pa.array(np.concatenate(parts) if parts else np.zeros(0))
                ],
                [*plain, "\x01into"]
            )

    slim = docs.select(*[named(c).alias(p) for c, p in zip(keep, plain, strict=True)])
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema)
    both = docs.select(
        *[named(c).alias(p) for c, p in zip(keep, plain, strict=True)], named(text).cast("string").alias("\x01text")
    )
    return both.mapInArrow(run, f"{own}`\x01into` double").toDF(*keep, into)


THRESHOLD = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every ``documents`` text; learns from labels whose crc32(doc_id) mod 3 is not 1.

    A text without a word has a score of about 0; without labels of both values every text has 0.5.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~in_part(F.col("doc_id"), 3, 1)))
    out = score(docs, model, keep=["doc_id"])
    return out.select(
        "doc_id", in_part(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
