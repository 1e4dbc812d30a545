"""Benchmark decontamination as a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``size`` consecutive words. A window's words are ordered by rarity (number of documents
that hold the word, counted over all of them); as all of a window must be in the document, its rarest word is the
necessary prefix. Documents are searched for those words; a find at place p of a word that stands at place k of a
window must begin at p - k >= 0 and end within the document (length and position bounds), and is then compared word by
word. Windows are broadcast in blocks of a fixed number, so what a task holds doesn't grow with the benchmark. With one
block documents are never shuffled; with several, the blocks' finds are merged by row number and meet the rows once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import bounded_batches, kept_columns, lower_table, named, plain_names, stored, table, utf8

#: A-Z lowered, word bytes kept, all else a space: bytes.split() then gives the words.
WORDS = bytes(lower_table())
SIZE = 10
#: Windows that are collected and broadcast at a time, about.
BLOCK = 200_000


def words_in(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    data, offsets = utf8(column)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(raw[a:b])


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item_id, window): the distinct windows of each item; a shorter item is one window, one without words has none."""
    kind = items.select(named(item_id)).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, own in enumerate(texts_of(batch.column(1))):
                w = words_in(own)
                distinct = sorted({b" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))}) if w else []
                rows += [i] * len(distinct)
                found += distinct
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], ["item_id", "window"]
            )

    return items.select(
        named(item_id).alias("item_id"), named(text).cast("string").alias("text")
    ).mapInArrow(cut, f"item_id {kind}, window binary").distinct()


def words_of_windows(windows: DataFrame) -> DataFrame:
    """(word): the distinct words of the windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sorted({x for w in texts_of(batch.column(0)) for x in w.split(b" ")}), pa.binary())], ["word"]
            )

    return windows.select("window").mapInArrow(cut, "word binary").distinct()


def rarity(docs: DataFrame, text: str, words: DataFrame, block: int) -> DataFrame:
    """(word, docs), written: in how many documents each word of the table stands, counted over all documents and summed in
    Spark; words that stand nowhere are left out. ``block`` words are broadcast at a time, about."""
    spark = docs.sparkSession
    words = stored(words)
    parts = max(1, -(-words.count() // block))
    out = None
    for k in range(parts):
        held = spark.sparkContext.broadcast(
            {bytes(r["word"]) for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).toLocalIterator()}
        )

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for own in texts_of(batch.column(0)):
                    total.update(held.value.intersection(words_in(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "docs"]
            )

        counted = docs.select(
            F.col(f"`{text}`").cast("string").alias("text")
        ).mapInArrow(count, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
        out = counted if out is None else out.unionByName(counted)
    return stored(out)


class WindowIndex:
    """Windows by their rarest word: where it stands in them, how long they are, and the items of each window."""

    def __init__(self, windows: dict[bytes, list], docs_with: dict[bytes, int]):
        self.items = windows
        self.prefix: dict[bytes, set[tuple[int, int]]] = {}
        for window in windows:
            w = window.split(b" ")
            _, _, k = min((docs_with.get(x, 0), x, k) for k, x in enumerate(w))
            self.prefix.setdefault(w[k], set()).add((k, len(w)))

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, stop) word spans of all windows in the words w, and the items they belong to."""
        rare = self.prefix.keys() & set(w)
        spans: list[list[int]] = []
        items: set = set()
        if rare:
            n, prefix, windows = len(w), self.prefix, self.items
            for p in [p for p, x in enumerate(w) if x in rare]:
                for k, size in prefix[w[p]]:
                    start = p - k
                    if start >= 0 and start + size <= n and (own := windows.get(b" ".join(w[start : start + size]))):
                        items.update(own)
                        spans.append([start, start + size])
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def find_windows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id",
    item_text: str = "text", size: int = SIZE, block: int = BLOCK, into: str = "found"
) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and ``into``: struct of n_words, spans (merged [start, stop) places of
    words inside any occurring window) and items (ids of items with occurring windows, sorted as strings).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. A null or empty text has no words and no finds.
    Rows are judged one by one, so repeated rows and ids don't matter; a column named as ``into`` is replaced. Without
    benchmark windows, or in an empty table, nothing is found.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = kept_columns(docs, keep, [into])
    windows = stored(windows_of(benchmark, item_id, item_text, size))
    blocks = max(1, -(-windows.count() // block))
    item_type = windows.schema["item_id"].dataType
    kind = item_type.simpleString()
    # As many words as windows at a time: a window's words repeat in the next one.
    counted = rarity(docs, text, words_of_windows(windows), block)

    def index_of(k: int) -> Broadcast:
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        own: dict[bytes, list] = {}
        for r in mine.toLocalIterator():
            own.setdefault(bytes(r["window"]), []).append(r["item_id"])
        docs_with = {
            bytes(r["word"]): r["docs"] for r in counted.join(
                words_of_windows(mine), "word", "left_semi"
            ).toLocalIterator()
        }
        return spark.sparkContext.broadcast(WindowIndex(own, docs_with))

    spans_type = "array<struct<start: bigint, stop: bigint>>"
    plain = plain_names(keep)
    slim = docs.select(
        *[named(c).alias(p) for c, p in zip(keep, plain, strict=True)], named(text).cast("string").alias(TEXT)
    )
    if blocks == 1:
        return slim.mapInArrow(
            searched(index_of(0), plain, FOUND, item_type),
            ", ".join(
                [
                    *(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != TEXT),
                    f"`{FOUND}` struct<n_words: bigint, spans: {spans_type}, items: array<{kind}>>"
                ]
            )
        ).toDF(*keep, into)
    # Several blocks: rows are numbered and written once, each block's search gives numbers and finds alone, and these are
    # merged before they meet the rows.
    slim = stored(slim.withColumn(ROW, F.monotonically_increasing_id()))
    found = None
    for k in range(blocks):  # one block's index is held at a time
        index = index_of(k)
        own = slim.select(ROW, TEXT).mapInArrow(
            searched(index, [ROW], "f", item_type),
            f"`{ROW}` bigint, f struct<n_words: bigint, spans: {spans_type}, items: array<{kind}>>"
        )
        own = stored(own if found is None else own.filter(F.size("f.items") > 0))  # the first one gives all rows' numbers of words
        index.unpersist()
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy(ROW).agg(  # a row per block at most
        F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.spans")).alias("spans"),
        F.flatten(F.collect_list("f.items")).alias("items")
    )
    # Spans in order; one that starts within or at the end of the last is joined to it.
    last = lambda a: F.get(a, F.size(a) - 1)

    def grown(a: Column, x: Column) -> Column:
        joined = F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["stop"], x["stop"]).alias("stop"))
        apart = F.coalesce(x["start"] > last(a)["stop"], F.lit(True))
        return F.when(apart, F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined)))

    spans = F.aggregate(F.array_sort("spans"), F.array().cast(spans_type), grown)
    items = F.transform(
        F.array_sort(
            F.transform(F.array_distinct("items"), lambda x: F.struct(x.cast("string").alias("s"), x.alias("x")))
        ),
        lambda p: p["x"]
    )
    light = stored(merged.select(ROW, F.struct("n_words", spans.alias("spans"), items.alias("items")).alias(FOUND)))
    return slim.join(light, ROW).select(*plain, FOUND).toDF(*keep, into)


#: Columns that no table of documents has.
TEXT, ROW, FOUND = "\x01text", "\x01row", "\x01found"


def searched(index, keep: list[str], into: str, kind: DataType):
    """Batches of ``keep`` and the text -> ``keep`` and the finds of one block's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_type = pa.list_(to_arrow_type(kind))
        finds = pa.struct(
            [
                ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ("items", items_type)
            ]
        )
        for batch in batches:
            out = []
            for own in texts_of(batch.column(len(keep))):
                w = words_in(own)
                spans, items = index.value.find(w)
                out.append(
                    {
                        "n_words": len(w), "spans": [{"start": a, "stop": b} for a, b in spans],
                        "items": sorted(items, key=str)
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in range(len(keep))), pa.array(out, finds)], [*keep, into]
            )

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole ``documents`` inside benchmark windows of ten words; the digest is derived from spans and items."""
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    items = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    rows = found.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256")
    )
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS own
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS own
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r.doc_id, r.i, r.size, win.item_id FROM runs r JOIN win ON win.own = r.own AND win.size = r.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
