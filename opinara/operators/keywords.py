"""Keyword search with an automaton: any number of keywords in one pass over a text.

A lexicon is a table (aspect, keyword), with or without a domain. Its keywords are dealt into blocks by aspect, each block
is broadcast, and every Python worker builds the block's automaton once. Keywords are substrings of the lower-cased text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that one automaton holds, about.
BLOCK = 200_000
#: Automata that a worker keeps at a time.
HELD = 8
_built: dict[str, Any] = {}


def automaton(block: str, held: Broadcast) -> Any:
    """The automaton of a broadcast list of (keyword, aspects), built once in each worker; block: the list's own name."""
    import ahocorasick  # only workers need it

    if block not in _built:
        while len(_built) >= HELD:
            _built.pop(next(iter(_built)))
        found = ahocorasick.Automaton()
        for keyword, aspects in held.value:
            found.add_word(keyword, aspects)
        if len(found):
            found.make_automaton()
        _built[block] = found
    return _built[block]


def lexicon_table(lexicon: DataFrame, domain: str | None = None) -> DataFrame:
    """(aspect, keyword), lower-cased, once each, of one domain if it is given; ValueError if there are none."""
    own = lexicon if domain is None else lexicon.filter(F.col("domain") == domain)
    own = own.select("aspect", F.lower("keyword").alias("keyword")).filter("keyword <> '' AND aspect IS NOT NULL").distinct()
    if own.isEmpty():
        raise ValueError("the lexicon has no keywords" if domain is None else f"no aspect lexicon for the domain {domain!r}")
    return own


def blocks_of(lexicon: DataFrame, block: int = BLOCK) -> Iterator[tuple[str, Broadcast]]:
    """Broadcast lists of (keyword, aspects) and a name for each; all keywords of an aspect are in one block."""
    parts = max(1, -(-lexicon.count() // block))
    for k in range(parts):
        mine = lexicon.filter(F.pmod(F.xxhash64("aspect"), F.lit(parts)) == k)
        rows = mine.groupBy("keyword").agg(F.sort_array(F.collect_list("aspect")).alias("aspects")).toLocalIterator()
        held = lexicon.sparkSession.sparkContext.broadcast([(r["keyword"], tuple(r["aspects"])) for r in rows])
        yield uuid.uuid4().hex, held


def sentence_aspects(
    cut: DataFrame, lexicon: DataFrame, key: str = "review_id", sentences: str = "s", block: int = BLOCK
) -> DataFrame:
    """(key, aspect, text, n_sentences) of rows (key, array of sentences): the sentences that hold a keyword of the aspect, in
    order, joined by a space. One pass for each block of keywords."""
    kind = cut.select(key).schema[0].dataType.simpleString()
    rows = cut.select(key, F.col(sentences).alias("s"), F.transform(sentences, F.lower).alias("low"))
    out = None
    for held in blocks_of(lexicon, block):

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = automaton(*held)
            for batch in batches:
                at, aspects, texts, sizes = [], [], [], []
                for i, (own, low) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found: dict[str, list[str]] = {}
                    for sentence, lowered in zip(own or [], low or [], strict=True):
                        hits = {a for _, names in search.iter(lowered) for a in names} if len(search) else ()
                        for a in hits:
                            found.setdefault(a, []).append(sentence)
                    for a in sorted(found):
                        at.append(i), aspects.append(a), texts.append(" ".join(found[a])), sizes.append(len(found[a]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())), pa.array(aspects, pa.string()),
                        pa.array(texts, pa.string()), pa.array(sizes, pa.int32())
                    ], ["key", "aspect", "text", "n_sentences"]
                )

        part = rows.mapInArrow(find, f"key {kind}, aspect string, text string, n_sentences int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def holds_keyword(df: DataFrame, lexicon: DataFrame, column: Column, into: str, block: int = BLOCK) -> DataFrame:
    """df with a boolean: whether the lower-cased text of the column holds any keyword; false for null."""
    found = F.lit(False)
    for held in blocks_of(lexicon, block):

        @F.pandas_udf("boolean")
        def any_of(texts, held=held):
            import pandas as pd

            search = automaton(*held)
            return pd.Series([t is not None and len(search) > 0 and next(search.iter(t), None) is not None for t in texts])

        found = found | any_of(F.lower(column))
    return df.withColumn(into, found)
