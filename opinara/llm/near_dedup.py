"""Near-duplicate detection with min-max hashing.

A document's set of word shingles is hashed once per permutation; both the least and the greatest value are kept, so 80
permutations give a signature of 160 values, banded by 5 into 32 bands. Documents of equal sets are one class from the
start. Classes that share a band are candidates, and links are confirmed on full sets.

First every member of a band's bucket is held against the bucket's most central one: the member that shares most buckets
with others, so of a text and its copies the text they come from. That joins nearly all true groups with a number of pairs
that grows as their members. What is left are links between the components so found. They come from an
exact prefix-filter join of the candidates: shingles in one common order, rare ones first; two sets of a Jaccard
similarity t share one among the first n - ceil(2tn/(1+t)) + 1 of the smaller and n - ceil(tn) + 1 of the larger, at
places that leave room for enough others. Shingles met in one component alone are passed over, as a pair inside a
component adds nothing. So no link between different texts is lost, and no group is ever paired out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, discard, numbered, shared_folder, stored, table, utf8

WORDS, SIMILARITY = 5, 80
PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
CHUNK = 1 << 20
#: A column that no table of documents has.
ROW = "\x01row"
_RNG = np.random.default_rng(23)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A-Z lowered and white space \x20, \x09-\x0D made one; all else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some rows, and each row's place among them (n+1)."""
    c = LOWER[data[offsets[0] : offsets[-1]]]
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    gap = c == 0x20
    first = ~gap
    first[1:] &= gap[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    place = np.arange(len(c)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(c)]))
    power = np.ones(int(place.max()) + 1, np.uint64)
    power[1:] = _FACTOR
    np.multiply.accumulate(power, out=power)
    value = _BYTES[c] * power[place]
    value[gap] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(row[starts], np.arange(n + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; of a shorter text the one of all its words; empty without words."""
    for a, b in batches_of(offsets, CHUNK):
        h, at = word_hashes(data, offsets[a : b + 1])
        if len(h) >= words:
            run = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                run = run * _FACTOR + h[k : len(h) - words + 1 + k]
            run = mixed(run)
        for i in range(b - a):
            n = int(at[i + 1] - at[i])
            if n >= words:
                yield np.unique(run[at[i] : at[i + 1] - words + 1])
            elif n:
                total = np.uint64(n)
                for x in h[at[i] : at[i + 1]]:
                    total = np.uint64((int(total) * int(_FACTOR) + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield mixed(np.array([total]))
            else:
                yield np.zeros(0, np.uint64)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The signature: under each permutation the least value, then under each the greatest."""
    low, high = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(shingles), 4096):
        v = shingles[None, a : a + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _FACTOR + rows[:, k])
    return key.astype(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()),
        pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64))
    )


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, name, n, digest, bands): set size, a 128-bit digest of the sorted set, and the band keys (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            n, digest, bands = [], [], []
            for s in shingle_sets(data, offsets, words):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(min_max(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                    lists(bands)
                ],
                ["id", "name", "n", "digest", "bands"]
            )

    kind = docs.schema["name"].dataType.simpleString()
    return docs.select("id", "name", "text").mapInArrow(
        sign, f"id long, name {kind}, n long, digest binary, bands array<long>"
    )


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) with these ids. Both sides grow with the documents, so they meet by key at every size."""
    return docs.select("id", "text").join(ids.hint("merge"), "id", "left_semi")


def set_table(texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full sets as arrays of sorted 64-bit hashes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [s.view(np.int64) for s in shingle_sets(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(found)], ["id", "shingles"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(gather, f"id {kind}, shingles array<long>")


#: Members held against one copy of their centre's text.
TOGETHER = 200


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similarity * union.

    A text is sent once for each pair that it is b of, and once for each TOGETHER pairs that it is a of; the centre a comes
    first and its members pass by it one after the other, so a task holds two sets at a time.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: np.ndarray | None = None
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            first, ok = batch.column(1).to_numpy() == 0, np.zeros(batch.num_rows, bool)
            for i, own in enumerate(shingle_sets(data, offsets, words)):
                if first[i]:
                    centre = own
                else:
                    both = np.concatenate([centre, own])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * common >= similarity * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(ok))

    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select(
        F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role")
    )
    centres = sizes.select(
        F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role")
    )
    met = texts.join(members.unionByName(centres), "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "role", "id", "text").mapInArrow(check, f"a {kind}, b {kind}")


def components(links: DataFrame, work: str | None = None) -> DataFrame:
    """(id, component) of every id in the links (a, b): the least id it can be reached from.

    Labels go over links and are then looked up in themselves, which halves paths; each round ends in a written table.
    """
    links = links.filter("a <> b")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), work)
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select(
            "id", F.least("id", "b").alias("component")
        ),
        work
    )
    while True:
        near = both.join(
            labels.select(F.col("id").alias("b"), "component"), "b"
        ).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        step = stored(step, work)
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = stored(
            step.join(jump, "component").select("id", "was", F.least("component", "further").alias("component")), work
        )
        labels = new.select("id", "component")
        if new.filter("was <> component").isEmpty():
            return labels


def cross_pairs(sets: DataFrame, labels: DataFrame, similarity: int, work: str | None = None) -> DataFrame:
    """Pairs (a, b) of different components that pass the prefix, length and place bounds; labels: (id, component)."""
    own = sets.join(labels, "id").select(
        "id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("token")
    )
    # Any common order is right; with rare shingles first, few sets meet. A shingle of one component alone keeps its place.
    found = stored(
        own.groupBy("token").agg(
            F.count(F.lit(1)).alias("held"), (F.min("component") != F.max("component")).alias("crosses")
        ).filter("held > 1"),
        work
    )
    ranked = own.join(found, "token", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("held", F.lit(1)), "token"))
    )
    probe = F.col("n") - F.ceil(F.col("n") * similarity / 100 - 1e-9) + 1
    index = F.col("n") - F.ceil(2 * F.col("n") * similarity / (100 + similarity) - 1e-9) + 1
    tokens = stored(
        ranked.filter(F.col("crosses") & (F.col("place") <= probe)).select(
            "id", "component", "n", "token", "place", (F.col("place") <= index).alias("index")
        ),
        work
    )
    small, large = tokens.filter("index").alias("s"), tokens.alias("l")
    need = F.ceil((F.col("s.n") + F.col("l.n")) * similarity / (100 + similarity) - 1e-9)
    room = F.least(F.col("s.n") - F.col("s.place"), F.col("l.n") - F.col("l.place")) + 1
    after = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.id") < F.col("l.id")))
    match = (F.col("s.token") == F.col("l.token")) & (F.col("s.component") != F.col("l.component")) & after & (
        100 * F.col("s.n") >= similarity * F.col("l.n")
    ) & (room >= need)
    return small.join(large, match).select(F.col("s.id").alias("a"), F.col("l.id").alias("b")).distinct()


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY,
    row: str | None = None
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set are the distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z; of a shorter
    text, all its words as one; a null or empty text has none and links with nothing. Documents link where 100 *
    intersection >= ``similarity`` * union of full sets; component_id is the least id reachable, and that document is kept.

    Each row is a document of its own, whatever its id: repeated rows, and rows that share an id but not a text, link by
    their own texts alone, and all rows with the component's id are kept. A row without an id takes the least id of its
    component and is not kept there; a component of none but such rows has no id, and all are kept. Other columns are
    ignored; an empty table gives no rows. ``row`` names a column of unique numbers, the same in every reading; without it the
    rows are numbered first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = shared_folder(spark)
    given = docs if row is not None else numbered(docs, ROW)
    slim = given.select(
        F.col(f"`{row or ROW}`").alias("id"), F.col(f"`{doc_id}`").alias("name"),
        F.col(f"`{text}`").cast("string").alias("text")
    )
    signed = stored(signatures(slim, words))
    # A class of equal sets is known by the least of its rows.
    classes = stored(
        signed.filter("n > 0").groupBy("digest").agg(
            F.min("id").alias("id"), F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")
        ),
        work
    )
    banded = signed.join(classes.select("id"), "id", "left_semi").select("id", "n", F.explode("bands").alias("band"))
    sizes = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), work)
    shared = stored(banded.join(sizes, "band").select("band", "id", "n", "members"), work)
    degree = shared.groupBy("id").agg(F.sum("members").alias("degree"))
    central = F.max(F.struct("degree", (-F.col("id")).alias("id"), "n"))
    centres = shared.join(degree, "id").groupBy("band").agg(central.alias("c")).select(
        "band", (-F.col("c.id")).alias("a"), F.col("c.n").alias("m")
    )
    members = stored(
        shared.join(stored(centres, work), "band").select("band", "a", "m", F.col("id").alias("b"), "n"), work
    )
    texts = stored(with_ids(slim, members.select(F.col("b").alias("id")).distinct()), work)
    stars = members.filter("a <> b").filter(
        f"100 * least(m, n) >= {similarity} * greatest(m, n)"
    ).select("a", "b").distinct()
    first = components(confirmed(stored(stars, work), texts, words, similarity), work)
    # Only members of buckets with more than one component can still link.
    placed = members.select("band", F.col("b").alias("id")).join(first, "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("component")
    )
    open_ = placed.groupBy("band").agg(
        F.min("component").alias("one"), F.max("component").alias("other")
    ).filter("one <> other").select("band")
    unsettled = stored(placed.join(stored(open_, work), "band").select("id", "component").distinct(), work)
    sets = stored(set_table(with_ids(texts, unsettled.select("id")), words), work)
    crossing = stored(cross_pairs(sets, unsettled, similarity, work), work)
    rest = stored(confirmed(crossing, texts, words, similarity), work)
    # Links between components: their least ids stand for them.
    at = {k: first.select(F.col("id").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"}
    between = rest.join(at["a"], "a", "left").join(at["b"], "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")
    )
    second = components(between, work).select(F.col("id").alias("component"), F.col("component").alias("last"))
    moved = first.join(second, "component", "left").select("id", F.coalesce("last", "component").alias("component"))
    alone = second.join(first.select("component").distinct(), "component", "left_anti").select(
        F.col("component").alias("id"), F.col("last").alias("component")
    )
    labels = moved.unionByName(alone)
    # Classes of more than one row, or in a component of several: the others stand for themselves.
    joined = stored(
        classes.join(labels, "id", "left").filter("copies > 1 OR component IS NOT NULL").select(
            "digest", F.coalesce("component", "id").alias("component"), "name"
        ),
        work
    )
    names = stored(joined.groupBy("component").agg(F.min("name").alias("least")), work)
    grouped = stored(joined.join(names, "component").select("digest", "least", F.lit(True).alias("found")))
    discard(spark, work)  # what is left to read are the signatures and the groups
    out = signed.select("name", "n", "digest").join(grouped, "digest", "left")
    component = F.when(F.col("found"), F.col("least")).otherwise(F.col("name"))
    return out.select(
        F.col("name").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("name")).alias("kept")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` over shingles of four words."""
    return near_groups(table(spark, sf_dir, "documents"), words=4)
