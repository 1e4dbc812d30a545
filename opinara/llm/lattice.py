"""Language-model scoring by a subword lattice.

The pieces of an existing vocabulary, with its scores as prior, weigh all segmentations of a word: a log-space forward
recursion over the word's places sums them to its marginal probability. Piece probabilities are re-estimated by
expectation-maximisation over the counts of all training words. A known word has one more arc, itself, with its count less
an absolute discount; what all known words give up so is the weight of the pieces, which new words share with them. The
discount is chosen by leaving each occurrence out. Words and the end are drawn independently, so a text's probability is
the product over them, and the sum over all texts is at most 1. So a word that training has not seen pays for its spelling,
which the count formula of ``base_score`` doesn't ask for: where many words are new, ``score`` lies below it.
``known_score`` is the part of ``score`` of known words and the end; ``lattice_score`` is what the pieces alone give.

Word counts are exact and held nowhere whole. Documents are read once and dealt into chunks of bounded size, as numbers in
the chunk's own dictionary. The dictionaries' words are summed to totals, each distinct word is walked once, and what it
weighs goes back to the chunks that hold it, by number. A word, however frequent, has one row for each chunk at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, in_part, shared_folder, stored, table, utf8

MARK = 0x2581  # the vocabulary's sign for the start of a word
#: Bytes of text that one chunk holds, about; a longer text is a chunk alone.
CHUNK_BYTES = 16_000_000
#: Tokens that the vocabulary's own scores count for beside the training tokens.
PRIOR_TOKENS = 5000.0
DISCOUNTS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
#: Words that are walked at a time, and characters of equally long ones among them.
WORDS_TOGETHER, LENGTHS_TOGETHER = 100_000, 400_000
#: Words of more places than this are walked place by place, in blocks of BLOCK; the result is the same.
PLACES, BLOCK = 300, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
IMPOSSIBLE = -1e300


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattice:
    """Pieces by 64-bit hashes in two tables, their log-probabilities, and the walks over words."""

    def __init__(self, pieces: list[str], prior: np.ndarray, byte_of: dict[int, int]):
        self.prior = prior / prior.sum()
        self.log_p = np.log(self.prior)
        self.byte_of = byte_of  # byte -> piece
        self.longest = max(len(p) for p in pieces if p)
        self.points = np.zeros((len(pieces), self.longest), np.uint32)
        for i, p in enumerate(pieces):
            self.points[i, : len(p)] = list(map(ord, p))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.hashes = self.hashed(self.points)[size, np.arange(len(pieces))]
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = _BASE
        np.multiply.accumulate(self.power, out=self.power)
        bits = max(4, (4 * len(pieces)).bit_length())
        while not self.placed(np.flatnonzero(size), bits):
            bits += 1
        # Most substrings are no piece; one byte tells so.
        self.seen_shift = np.uint64(64 - bits - 3)
        self.seen = np.zeros(1 << (bits + 3), bool)
        self.seen[self.hashes[size > 0] >> self.seen_shift] = True

    def placed(self, those: np.ndarray, bits: int) -> bool:
        """Fills two tables of 1 << bits places: a piece is in one of them, moved to its other place when a later one needs
        its own. False if that doesn't end."""
        self.mask, self.shifts = np.uint64((1 << bits) - 1), (np.uint64(64 - bits), np.uint64(24))
        self.keys, self.pieces = np.zeros((2, 1 << bits), np.uint64), np.full((2, 1 << bits), -1, np.int32)
        for i in those:
            key, piece, side = self.hashes[i], int(i), 0
            for _ in range(500):
                at = int((key >> self.shifts[side]) & self.mask)
                (self.keys[side, at], key), (self.pieces[side, at], piece) = (key, self.keys[side, at]), (
                    piece, int(self.pieces[side, at])
                )
                if piece < 0:
                    break
                side = 1 - side
            else:
                return False
        return True

    @staticmethod
    def hashed(points: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of code points; line j is that of the first j of each row."""
        out = np.zeros((points.shape[1] + 1, points.shape[0]), np.uint64)
        for j in range(points.shape[1]):
            out[j + 1] = (out[j] + points[:, j].astype(np.uint64) + np.uint64(1)) * _BASE
        return out

    def lookup(self, key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of points (one substring each, hashed to key) that are pieces, and the pieces."""
        maybe = np.flatnonzero(self.seen[key >> self.seen_shift])
        if not len(maybe):
            return maybe, maybe
        key = key[maybe]
        piece = np.full(len(maybe), -1, np.int64)
        for side in (0, 1):
            at = (key >> self.shifts[side]) & self.mask
            piece = np.where(self.keys[side][at] == key, self.pieces[side][at], piece)
        own = np.flatnonzero(piece >= 0)
        rows, piece = maybe[own], piece[own]
        own = (self.points[piece, : points.shape[1]] == points[rows]).all(1)  # the characters decide, not the hash
        return (rows, piece) if own.all() else (rows[own], piece[own])

    def found(self, key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As lookup; substrings of one place without a piece give -2 - code point: their bytes."""
        rows, pieces = self.lookup(key, points)
        if points.shape[1] == 1 and len(rows) < len(key):
            rest = np.ones(len(key), bool)
            rest[rows] = False
            rest = np.flatnonzero(rest)
            rows, pieces = np.concatenate([rows, rest]), np.concatenate([pieces, -2 - points[rest, 0].astype(np.int64)])
        return rows, pieces

    def arcs(self, points: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, rows, pieces) of words of one length, ordered by stop."""
        prefix = self.hashed(points)
        out = []
        for stop in range(1, points.shape[1] + 1):
            for start in range(max(0, stop - self.longest), stop):
                rows, pieces = self.found(
                    prefix[stop] - prefix[start] * self.power[stop - start], points[:, start:stop]
                )
                if len(rows):
                    out.append((start, stop, rows, pieces))
        return out

    def bytes_of(self, piece: int) -> list[int]:
        """The byte pieces of a code point, for -2 - code point."""
        return [self.byte_of[b] for b in chr(int(-2 - piece)).encode("utf-8", "surrogatepass")]

    def weight(self, piece: np.ndarray) -> np.ndarray:
        out = self.log_p[np.maximum(piece, 0)]
        low = piece < -1
        if low.any():
            points, which = np.unique(piece[low], return_inverse=True)
            out[low] = np.array([sum(self.log_p[k] for k in self.bytes_of(p)) for p in points])[which]
        return out

    def uses(self, pieces: np.ndarray, use: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected uses of pieces to into."""
        own = pieces >= 0
        into += np.bincount(pieces[own], use[own], len(into))
        if not own.all():
            points, which = np.unique(pieces[~own], return_inverse=True)
            for p, n in zip(points, np.bincount(which, use[~own]), strict=True):
                for k in self.bytes_of(p):
                    into[k] += n

    def walk(self, points: np.ndarray, times: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Log marginal of each row; with times, adds the expected uses of each piece to ``into``."""
        n, size = points.shape
        arcs = [(a, b, rows, pieces, self.weight(pieces)) for a, b, rows, pieces in self.arcs(points)]
        forward = np.full((size + 1, n), IMPOSSIBLE)
        forward[0] = 0.0
        for a, b, rows, _, w in arcs:
            forward[b, rows] = np.logaddexp(forward[b, rows], forward[a, rows] + w)
        if times is not None:
            backward = np.full((size + 1, n), IMPOSSIBLE)
            backward[size] = 0.0
            for a, b, rows, _, w in sorted(arcs, key=lambda x: -x[0]):
                backward[a, rows] = np.logaddexp(backward[a, rows], backward[b, rows] + w)
            for a, b, rows, pieces, w in arcs:
                self.uses(
                    pieces, np.exp(forward[a, rows] + w + backward[b, rows] - forward[size, rows]) * times[rows], into
                )
        return forward[size]

    def block_arcs(self, points: np.ndarray, a: int, b: int) -> list[list[tuple[int, int, float]]]:
        """For each place in (a, b] the arcs (start, piece, weight) that stop there, of one long word."""
        low = max(0, a - self.longest)
        own = points[low:b]
        prefix = np.zeros(len(own) + 1, np.uint64)
        h = 0
        for j, x in enumerate(own.tolist()):
            h = (h + x + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
            prefix[j + 1] = h
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(b - a)]
        for k in range(1, min(self.longest, b) + 1):
            starts = np.arange(max(a + 1 - k, low), b - k + 1)
            if len(starts):
                views = np.lib.stride_tricks.sliding_window_view(own, k)[starts - low]
                rows, pieces = self.found(prefix[starts - low + k] - prefix[starts - low] * self.power[k], views)
                for start, piece, w in zip(
                    starts[rows].tolist(), pieces.tolist(), self.weight(pieces).tolist(), strict=True
                ):
                    out[start + k - a - 1].append((start, piece, w))
        return out

    def long_walk(self, points: np.ndarray, times: float | None = None, into: np.ndarray | None = None) -> float:
        """As walk, for one long word: block by block, and for the uses back again, from the values kept at the blocks' ends."""
        size, keep = len(points), self.longest

        def forward(a: int, b: int, before: dict[int, float], arcs) -> dict[int, float]:
            value = dict(before)
            for stop in range(a + 1, b + 1):
                terms = [value[start] + w for start, _, w in arcs[stop - a - 1]]
                top = max(terms)
                value[stop] = top + math.log(sum([math.exp(t - top) for t in terms]))
            return value

        last = lambda value, b: {k: value[k] for k in range(max(0, b - keep), b + 1)}
        cuts = [*range(0, size, BLOCK), size]
        ends = [{0: 0.0}]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ends.append(last(forward(a, b, ends[-1], self.block_arcs(points, a, b)), b))
        total = ends[-1][size]
        if times is not None:
            pieces, use = [], []
            backward = {size: 0.0}
            for i in range(len(cuts) - 2, -1, -1):
                a, b = cuts[i], cuts[i + 1]
                arcs = self.block_arcs(points, a, b)
                value = forward(a, b, ends[i], arcs)
                for stop in range(b, a, -1):
                    after = backward.pop(stop)
                    for start, piece, w in arcs[stop - a - 1]:
                        own, old = after + w, backward.get(start, IMPOSSIBLE)
                        top = max(own, old)
                        backward[start] = top + math.log(math.exp(own - top) + math.exp(old - top))
                        pieces.append(piece), use.append(math.exp(value[start] + own - total) * times)
                self.uses(np.array(pieces), np.array(use), into)
                pieces, use = [], []
        return total

    def marginals(
        self, words: list[bytes], times: np.ndarray | None = None, into: np.ndarray | None = None
    ) -> np.ndarray:
        """Log marginal of every word, its start mark included; equally long words go together."""
        text = [x.decode("utf-8", "surrogatepass") for x in words]
        length = np.fromiter(map(len, text), np.int64, len(text))
        out = np.zeros(len(text))
        order = np.argsort(length, kind="stable")
        a = 0
        while a < len(order):
            size = int(length[order[a]])
            b = a + 1 if size > PLACES else min(
                int(np.searchsorted(length[order], size, "right")), a + max(1, LENGTHS_TOGETHER // (size + 1))
            )
            rows = order[a:b]
            flat = np.frombuffer(
                "".join([text[i] for i in rows]).encode("utf-32-le", "surrogatepass"), "<u4"
            ).reshape(len(rows), size)
            points = np.concatenate([np.full((len(rows), 1), MARK, np.uint32), flat], 1)
            if size > PLACES:
                out[rows] = self.long_walk(points[0], None if times is None else float(times[rows[0]]), into)
            else:
                out[rows] = self.walk(points, None if times is None else times[rows], into)
            a = b
        return out


def load(path: str | None = None) -> Lattice:
    """The vocabulary's pieces without control and many-word ones; prior 1 / (10 + rank), rank being the score's negative."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    n = model.get_piece_size()
    pieces, prior, byte_of = [], np.zeros(n), {}
    for i in range(n):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte_of[int(p[3:5], 16)] = i
            prior[i] = 1 / (10 + n)
            pieces.append("")
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or chr(MARK) in p[1:]:
            pieces.append("")
            prior[i] = 1e-12
        else:
            prior[i] = 1 / (10 - model.get_score(i))
            pieces.append(p)
    return Lattice(pieces, prior, byte_of)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered; bytes.split() cuts at \\x20 and \\x09-\\x0D, as the tokens ask."""
    return text.lower().split()


def numbered(docs: DataFrame, train: F.Column, text: str, doc_id: str) -> DataFrame:
    """Documents as (chunk, doc_id, train, tokens), tokens being 32-bit numbers in the chunk's dictionary, and dictionaries as
    (chunk, idx, word, n), n being how often the chunk's training documents have the word; in one table, written.

    A chunk is a run of rows of one partition, of CHUNK_BYTES about.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["chunk", "doc_id", "train", "tokens", "idx", "word", "n"]
    types = [pa.int64(), None, pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    def rows(size: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        own = [columns[c] if c in columns else pa.nulls(size, t or id_type) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(own, names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        index: dict[bytes, int] = {}
        seen: list[np.ndarray] = []
        id_type = None

        def dictionary() -> pa.RecordBatch:
            n = np.bincount(np.concatenate(seen) if seen else np.zeros(0, np.int32), minlength=len(index))
            numbers = pa.array(np.arange(len(index), dtype=np.int32))
            return rows(
                len(index), id_type, chunk=pa.array(np.full(len(index), chunk)), idx=numbers,
                word=pa.array(list(index), pa.binary()), n=pa.array(n)
            )

        for batch in batches:
            id_type = batch.column(0).type
            data, offsets = utf8(batch.column(1))
            raw, learned = memoryview(data), batch.column(2).to_pylist()
            tokens, chunks = [], []
            for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), learned, strict=True):
                if size and size + b - a > CHUNK_BYTES:
                    yield dictionary()
                    chunk, size, index, seen = chunk + 1, 0, {}, []
                size += b - a
                ids = np.array([index.setdefault(w, len(index)) for w in words_of(bytes(raw[a:b]))], np.int32)
                if own:
                    seen.append(ids)
                tokens.append(ids.astype("<i4").tobytes()), chunks.append(chunk)
            yield rows(
                len(tokens), id_type, chunk=pa.array(chunks, pa.int64()), doc_id=batch.column(0), train=batch.column(2),
                tokens=pa.array(tokens, pa.binary())
            )
        if index:
            yield dictionary()

    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train")
    )
    schema = f"chunk long, doc_id {kind}, train boolean, tokens binary, idx int, word binary, n long"
    return stored(slim.mapInArrow(deal, schema), compression="zstd")


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """WORDS_TOGETHER rows at a time, about."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= WORDS_TOGETHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def learn(words: DataFrame, lattice: Lattice, rounds: int = 3) -> tuple[Lattice, float]:
    """EM over all distinct training words (word, total); and the discount of the whole-word arcs, from the last round."""
    spark = words.sparkSession
    total, distinct = (float(x or 0) for x in words.agg(F.sum("total"), F.count(F.lit(1))).first())
    discount = 1.0
    for k in range(rounds if total else 0):
        held = spark.sparkContext.broadcast(lattice)
        tries = -np.arange(1, len(DISCOUNTS) + 1)

        def expect(batches: Iterator[pa.RecordBatch], held=held, last=k == rounds - 1) -> Iterator[pa.RecordBatch]:
            m = held.value
            used, logs = np.zeros(len(m.log_p)), np.zeros(len(DISCOUNTS))
            for batch in pooled(batches):
                times = np.asarray(batch.column(1)).astype(np.float64)
                marginal = m.marginals(batch.column(0).to_pylist(), times, used)
                if last:
                    # Each occurrence is left out of its word's count in turn.
                    whole = np.maximum(times - 1 - DISCOUNTS[:, None], 0)
                    rest = DISCOUNTS[:, None] * (distinct - (times == 1)) * np.exp(marginal)
                    mixed = (whole + rest) / total
                    logs += (np.log(np.maximum(mixed, 1e-300)) * times[None, :]).sum(1)
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[at, tries]), pa.array(np.r_[used[at], logs])], ["piece", "value"]
            )

        got = words.mapInArrow(  # as many rows as pieces
            expect, "piece long, value double"
        ).groupBy("piece").agg(F.sum("value").alias("value")).toPandas()
        piece, value = got["piece"].to_numpy(), got["value"].to_numpy()
        own = np.zeros(len(lattice.log_p))
        own[piece[piece >= 0]] = value[piece >= 0]
        lattice.log_p = np.log((own + PRIOR_TOKENS * lattice.prior) / (own.sum() + PRIOR_TOKENS))
        logs = np.zeros(len(DISCOUNTS))
        logs[-piece[piece < 0] - 1] = value[piece < 0]
        discount = float(DISCOUNTS[logs.argmax()])
    return lattice, discount


def weigh(words: DataFrame, lattice: Lattice, work: str) -> DataFrame:
    """(word, total, marginal), written: each distinct word is walked once."""
    held = words.sparkSession.sparkContext.broadcast(lattice)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in pooled(batches):
            yield from own.append_column(
                "marginal", pa.array(held.value.marginals(own["word"].to_pylist()))
            ).to_batches(10_000)

    return stored(words.select("word", "total").mapInArrow(walk, "word binary, total long, marginal double"), work)


def score(
    docs: DataFrame, train: F.Column | None = None, text: str = "text", doc_id: str = "doc_id",
    vocabulary: str | None = None
) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, known_score, lattice_score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z, then one end. ``train`` is a condition on docs' columns
    (all rows if None). base_score: sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))). score: log10 of the text's
    probability under the lattice model; known_score: the part of it of words that training has, and of the end; lattice_score:
    the score without the whole-word arcs. A null or empty text is the
    end alone. Repeated rows, and rows without an id, count and are scored each. Without training rows the vocabulary's
    scores alone weigh the pieces. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = shared_folder(spark)
    both = numbered(docs, F.lit(True) if train is None else train, text, doc_id)
    slim = both.filter("tokens IS NOT NULL").select("chunk", "doc_id", "tokens", "train")
    own = both.filter("word IS NOT NULL").select("chunk", "idx", "word", "n")
    totals = stored(own.groupBy("word").agg(F.sum("n").alias("total")), work)
    known = totals.filter("total > 0")
    n_words, distinct = known.agg(F.sum("total"), F.count(F.lit(1))).first()
    ends = slim.filter("train").count()
    n_words = int(n_words or 0)
    n, v = n_words + ends, distinct + (ends > 0)
    lattice, discount = learn(known, load(vocabulary))
    spared = discount * distinct / n_words if n_words else 1.0  # the pieces' weight
    words = weigh(totals, lattice, work)
    floor = np.log10(n + 0.5 * (v + 1))
    p_end = (ends + 0.5) / (n + 1.0)
    values = stored(own.join(words, "word").select("chunk", "idx", "total", "marginal"))
    discard(spark, work)
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "known_score", "lattice_score"]

    def judge(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        idx = np.asarray(dictionary["idx"])
        times, pieces = np.zeros(len(idx)), np.zeros(len(idx))
        times[idx] = np.asarray(dictionary["total"])
        pieces[idx] = np.asarray(dictionary["marginal"]) + np.log1p(-p_end)
        whole = np.maximum(times - discount, 0) / max(n_words, 1)
        with np.errstate(divide="ignore"):
            full = np.logaddexp(np.log(whole) + np.log1p(-p_end), pieces + np.log(spared))
        data, offsets = utf8(own["tokens"])
        size = np.diff(offsets) // 4
        ids, row = np.frombuffer(data.tobytes(), "<i4"), np.repeat(np.arange(len(size)), size)
        summed = lambda x: np.bincount(row, x[ids], len(size))
        base = summed(np.log10(times + 0.5) - floor) + np.log10(ends + 0.5) - floor
        parts = full, np.where(times > 0, full, 0), pieces
        log_probabilities = [summed(x) / np.log(10) + np.log10(p_end) for x in parts]
        counts = [size + 1, summed(times > 0).astype(np.int64) + (ends > 0), np.full(len(size), n)]
        arrays = [
            *(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.float64()) for x in (base, *log_probabilities))
        ]
        return pa.table([own["doc_id"], *arrays], names=names)

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double, lattice_score double"
    return slim.drop("train").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(judge, schema)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``; learns from those whose crc32(doc_id) mod 5 is not 1."""
    out = score(table(spark, sf_dir, "documents"), ~in_part(F.col("doc_id"), 5, 1))
    return out.select(
        "doc_id", in_part(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score", "known_score", "lattice_score"
    )
