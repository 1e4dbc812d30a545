"""Concatenate-and-cut packing: two passes of prefix sums, then fixed windows with boundary records.

Pass one tokenises every document once, in the partition that read it, and notes where its ids start within that
partition; the ids go to a table in the shared folder. The partitions' token totals (one row per partition) give each
partition its global offset. Pass two cuts every document at the multiples of the window that its global range meets.
No document is shuffled, so one very hot source or key is dealt out exactly as the input is.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

#: Texts of these characters are split alike by both libraries, whatever their Unicode version.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ſ]")
#: A single space before a character that is not white space always starts a new token.
RUNS = re.compile(r" [\s]")

#: Words kept per Python worker.
CACHED = 250_000
#: Ids that one Arrow batch of pieces holds at most, about.
BATCH_IDS = 4_000_000

_encoders: dict[tuple, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) -> bytes of native unsigned 16-bit ids (32-bit for large vocabularies), as the tokenizer file gives them.

    The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, so the spelling of a special
    token inside a text has that token's id. Where ``ranks`` names the same vocabulary as ranks, texts of plain characters
    without such a spelling take the faster equal path word by word; words seen are kept, up to a fixed number.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {}
        self.core = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.core = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )._core_bpe

    def word(self, w: str) -> bytes:
        out = self.words.get(w)
        if out is None:
            ids = self.core.encode_single_piece(
                (" " + w).encode()
            ) if w.isalpha() else self.core.encode_ordinary(" " + w)
            out = array.array(self.kind, ids).tobytes()
            if len(self.words) < CACHED and len(w) < 64:
                self.words[w] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.core is None or PLAIN.search(text) or any(x in text for x in self.special):
            return array.array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if RUNS.search(text):
            return array.array(self.kind, self.core.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        start = array.array(self.kind, self.core.encode_ordinary(first)).tobytes() if first else b""
        if text.endswith(" "):  # a last space has no word to go to
            rest.pop()
            return start + b"".join(map(self.word, rest)) + array.array(
                self.kind, self.core.encode_ordinary(" ")
            ).tobytes()
        return start + b"".join(map(self.word, rest))


def encoder(path: str, ranks: str | None) -> Encoder:
    """One per Python worker and vocabulary."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def token_table(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, ranks: str | None = None,
    end_id: int = 1
) -> DataFrame:
    """A row per document: doc_id, part, place (its ids before it in part), n_tokens (with end_id), ids (binary), written to the shared folder."""
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, enc = TaskContext.get().partitionId(), 0, encoder(path, ranks)
        end = array.array(enc.kind, [end_id]).tobytes()
        for batch in batches:
            ids = [enc.ids(x.as_py() or "") + end for x in batch.column(1)]
            n = np.fromiter((len(x) // len(end) for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(place + np.cumsum(n) - n),
                    pa.array(n), pa.array(ids, pa.binary())
                ],
                ["doc_id", "part", "place", "n_tokens", "ids"]
            )
            place += int(n.sum())

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(slim.mapInArrow(encode, f"doc_id {kind}, part long, place long, n_tokens long, ids binary"))


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2048, path: str | None = None,
    ranks: str | None = None, end_id: int = 1
) -> DataFrame:
    """Boundary records of the packed sequences, a row per piece.

    doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset (gapless from 0 in its
    sequence) and ids (binary, little-endian unsigned 32-bit). All sequences are full but the last, which pads itself.
    A null or empty text is the end id alone. Repeated rows and repeated ids are packed as often as they come; other
    columns of docs don't matter; an empty table has no pieces.
    """
    bounded_batches(docs.sparkSession)
    tokens = token_table(docs, doc_id, text, path, ranks, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per input partition, not per document: the driver schedules each of them, so they fit a broadcast.
    bases = totals.select(
        "part",
        (
            F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
        ).alias("base")
    )
    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("at"), "n_tokens", "ids"
    )
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (np.asarray(batch.column(k)) for k in (1, 2))
            row, start, length, ids, size = [], [], [], [], 0

            def out(batch=batch, at=at, n=n):
                r, s = np.array(row), np.array(start, np.int64)
                g = at[r] + s
                return pa.RecordBatch.from_arrays(
                    [
                        pc.take(batch.column(0), pa.array(r)), pa.array(s), pa.array(np.array(length, np.int64)),
                        pa.array(n[r]), pa.array(g // window), pa.array(g % window), pa.array(ids, pa.binary())
                    ],
                    names
                )

            for i, raw in enumerate(batch.column(3)):
                raw = raw.as_py()
                own = np.frombuffer(raw, np.dtype(f"<u{len(raw) // int(n[i])}"))
                cuts = [0, *range(int(window - at[i] % window), int(n[i]), window), int(n[i])]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    row.append(i), start.append(a), length.append(b - a), ids.append(own[a:b].astype("<u4").tobytes())
                    size += b - a
                    if size > BATCH_IDS:
                        yield out()
                        row, start, length, ids, size = [], [], [], [], 0
            if row:
                yield out()

    return placed.mapInArrow(cut, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs whole ``documents`` into sequences of at most 2048 ids; ids_crc32 is derived from each piece's ids."""
    pieces = pack(table(spark, sf_dir, "documents"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return digest(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
