"""SimHash near-duplicates by anchor points.

The anchors are the words of a product code over the 64 bits: two blocks of 23 bits with the perfect binary Golay code
(every 23-bit value is within 3 bits of exactly one codeword), and a block of 18 bits with the zero word alone. So the
code covers all fingerprints with radius 3, 3 and 18 in its blocks. Two fingerprints at distance 3 have a point between
them that is within 2 bits of each; the anchor that covers this point is then within the covering radius plus 2, counted
over all blocks together, of both. So every fingerprint goes to all anchors within the covering radius plus half the
threshold, and any two that link meet at one; there are some 61 such anchors for a fingerprint, of 2^24.

At an anchor fingerprints are compared in numpy, bit by bit. A task gives no pairs, but for each fingerprint the least one
that it reaches among those compared together, which grows as its rows. Anchors with more than ``LIMIT`` fingerprints are
cut into blocks, and each two blocks are compared in a task of their own. Equal fingerprints are one from the start.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shared_folder, stored, table, utf8
from .near_dedup import LOWER, components

WORDS, DISTANCE, SEED = 3, 3, 42
#: Bytes of a text hashed at a time.
CHUNK = 1 << 20
#: Fingerprints compared together at one anchor.
LIMIT = 4096
#: The Golay code's length, its data bits, its generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, and its radius.
LENGTH, DATA, GENERATOR, RADIUS = 23, 12, 0b110001110101, 3


def fingerprint_of(counts: np.ndarray, total: int) -> int:
    """Bit k is set where it is in over half of the hashes; counts: of bit k, from the lowest."""
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def _spaced(data: bytes, tail: bytes) -> bytes:
    """tail and data as words with one space between; a space at the end if the last word is over."""
    c = LOWER[np.frombuffer(tail + data, np.uint8)]
    keep = c != 0x20
    keep[1:] |= c[:-1] != 0x20
    return c[keep].tobytes()


def text_fingerprint(data: np.ndarray, words: int = WORDS) -> int:
    """The fingerprint of a text's UTF-8 bytes, read in pieces of CHUNK bytes; 0 without a word."""
    counts, total, tail = np.zeros(64, np.int64), 0, b""
    for a in range(0, max(1, len(data)), CHUNK):
        last = a + CHUNK >= len(data)
        text = _spaced(data[a : a + CHUNK].tobytes(), tail).lstrip(b" ")
        if last:
            text = text.rstrip(b" ")
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        if last and text:
            ends = np.append(ends, len(text))
        starts = np.concatenate([[0], ends + 1]).astype(int)
        n = len(ends) - words + 1
        if n > 0:
            h = [
                xxhash.xxh64_intdigest(text[s:e], SEED)
                for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
            ]
            for b in range(0, n, 1 << 15):
                held = np.array(h[b : b + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(held, axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += n
        elif last and text and not total:
            return xxhash.xxh64_intdigest(text, SEED)
        # What is left for the next piece: the last words - 1 whole words and what follows them.
        tail = text[int(starts[n]) :] if n > 0 else text
    return fingerprint_of(counts, total)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(name, fp): the fingerprint as a signed long; docs: (name, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            found = np.array([text_fingerprint(data[at[i] : at[i + 1]], words) for i in range(len(at) - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["name", "fp"])

    return docs.select("name", "text").mapInArrow(sign, f"name {docs.schema['name'].dataType.simpleString()}, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit values by the generator; equal for a value and its error pattern."""
    out = np.array(words, np.int64)
    for k in range(LENGTH - 1, LENGTH - DATA, -1):
        out = np.where(out >> k & 1, out ^ (GENERATOR << (k - (LENGTH - DATA))), out)
    return np.where(out >> (LENGTH - DATA) & 1, out ^ GENERATOR, out)


@functools.cache
def error_patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of at most ``most`` bits in order of syndrome; where each syndrome's begin; how far each is beyond RADIUS."""
    found, weights = [], []
    for w in range(most + 1):
        held = [sum(1 << k for k in bits) for bits in itertools.combinations(range(LENGTH), w)]
        found += held
        weights += [max(0, w - RADIUS)] * len(held)
    pattern, beyond = np.array(found), np.array(weights)
    of = syndrome(pattern)
    order = np.lexsort((beyond, of))
    return pattern[order], np.searchsorted(of[order], np.arange((1 << (LENGTH - DATA)) + 1)), beyond[order]


def anchors_of(fp: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that together are within the covering radius plus ``beyond`` of each fingerprint: (index into fp, anchor)."""
    pattern, begin, far = error_patterns(RADIUS + beyond)

    def near(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = syndrome(block)
        count = begin[s + 1] - begin[s]
        row = np.repeat(np.arange(len(block)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[s], count)
        return row, (block[row] ^ pattern[at]) >> (LENGTH - DATA), far[at]

    u = fp.astype(np.uint64)
    mask = np.uint64((1 << LENGTH) - 1)
    row, high, cost = near((u & mask).astype(np.int64))
    row2, low, cost2 = near(((u >> np.uint64(LENGTH)) & mask).astype(np.int64))
    n2 = np.bincount(row2, minlength=len(fp))
    start2 = np.cumsum(n2) - n2
    count = n2[row]
    left = np.repeat(np.arange(len(row)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start2[row], count)
    keep = cost[left] + cost2[right] <= beyond
    left, right = left[keep], right[keep]
    return row[left], high[left] << DATA | low[right]


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For 0..n-1 the least number reachable over the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_among(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): fingerprints with the lesser one that they reach within groups; rows are in order of group.

    The pairs found are reduced to such links whenever a million are held, so dense groups need no more memory.
    """
    values, at = np.unique(fp, return_inverse=True)
    label, found, held = np.arange(len(values)), [], 0
    size = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]))
    follow = np.repeat(np.cumsum(size), size) - np.arange(len(group))  # rows from here to the group's end
    i, last = np.arange(len(group)), int(size.max()) - 1
    for lag in range(1, last + 1):
        i = i[follow[i] > lag]
        ok = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance]
        found.append((at[ok], at[ok + lag]))
        held += len(ok)
        if held and (held > 1 << 20 or lag == last):
            known = np.arange(len(values)), label
            a, b = (np.concatenate(x) for x in zip(*found, known, strict=True))
            label, found, held = least_reached(a, b, len(values)), [], 0
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def compared(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Links (a, b) between fingerprints that share the keys; a group's rows are together in one task and bounded."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(end: int) -> pa.RecordBatch:
            a, b = links_among(group[:end], fp[:end], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            end = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if end >= 1 << 16:  # whole groups; the last one may go on in the next batch
                yield out(end)
                group, fp = group[end:], fp[end:]
        if len(group):
            yield out(len(group))

    # A group's number is its keys' hash; if two groups share one, they are compared with each other for nothing.
    key = F.col(keys[0]).cast("long") if len(keys) == 1 else F.xxhash64(*keys)
    return rows.select(key.alias("group"), "fp").repartition("group").sortWithinPartitions("group").mapInArrow(
        compare, "a long, b long"
    )


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, limit: int = LIMIT, work: str | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``distance`` bits apart, directly or over others; distinct: (fp)."""
    beyond = (distance + 1) // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for a in range(0, len(fp), 4096):
                part = fp[a : a + 4096]
                row, anchor = anchors_of(part.view(np.uint64), beyond)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(part[row])], ["anchor", "fp"]
                )

    met = stored(distinct.select("fp").mapInArrow(spread, "anchor int, fp long"), work)
    held = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("held"))
    hot = stored(held.filter(F.col("held") > limit), work)
    if hot.isEmpty():
        return compared(met, ["anchor"], distance)
    # Block k of a hot anchor meets the blocks from k on: each two in a task of their own, whatever the anchor's size.
    some = met.join(hot, "anchor").withColumn("blocks", F.ceil(F.col("held") / limit).cast("int"))
    some = some.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).select(
        "anchor", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("anchor", "fp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    calm = compared(met.join(hot, "anchor", "left_anti"), ["anchor"], distance)
    return calm.unionByName(compared(some, ["anchor", "one", "two"], distance))


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE,
    limit: int = LIMIT
) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A text's words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered, make shingles of ``words`` words with a space between, repeats
    included; a shorter text is one shingle of all its words, and a null text or one without a word has fingerprint zero,
    which links as any other. Bit k of a fingerprint is set if it is in over half the shingles' XXH64 (seed 42).
    Fingerprints at most ``distance`` bits apart link; component_id is the least doc_id reachable. Rows without an id take
    that of their component, or null where no row has one; repeated rows and ids link by their own texts. Other columns
    are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    work = shared_folder(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").alias("name"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = stored(fingerprints(slim, words))
    classes = stored(signed.groupBy("fp").agg(F.min("name").alias("least")), work)
    labels = components(stored(fingerprint_links(classes, distance, limit, work).distinct(), work), work)
    linked = stored(
        classes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        ), work
    )
    first = stored(linked.groupBy("component").agg(F.min("least").alias("component_id")), work)
    named = stored(linked.join(first, "component").select("fp", "component_id"))
    discard(docs.sparkSession, work)
    return signed.join(named, "fp").select(
        F.col("name").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of ``documents``: shingles of three words, at most 3 of 64 bits apart."""
    return simhash_groups(table(spark, sf_dir, "documents"))
