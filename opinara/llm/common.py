"""Sampling and byte-level text helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, shared_folder, stored, table

__all__ = [
    "WORD_BYTES", "batches_of", "bounded_batches", "discard", "in_part", "kept_columns", "lower_table", "named", "numbered",
    "ordered_sample", "plain_names",
    "shared_folder", "stored", "table", "utf8"
]

#: Letters kept by byte-level features after A-Z is lowered: digits, a-z and every byte of a multi-byte character.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


#: Bytes of rows that a task hands to Python at a time, unless the session says otherwise.
BATCH_BYTES = "4m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES where the session has Spark's default, which takes several times 64 MB of memory a task."""
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def kept_columns(docs: DataFrame, keep: list[str] | None, replaced: list[str]) -> list[str]:
    """The columns ``keep`` of docs (all if None) but for those that differ from a replaced one at most in case, unless the
    session tells such names apart."""
    own = docs.columns if keep is None else keep
    if docs.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true":
        return [c for c in own if c not in replaced]
    gone = {c.lower() for c in replaced}
    return [c for c in own if c.lower() not in gone]


def plain_names(keep: list[str]) -> list[str]:
    """Names for the kept columns on their way through Python, which takes none with dots."""
    return [f"\x01{k}" for k in range(len(keep))]


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


#: Files of a table whose names are broadcast to number its rows.
FILES = 50_000


def numbered(docs: DataFrame, into: str) -> DataFrame:
    """docs with a number of its own for every row, which is the same wherever and however often the rows are read.

    Rows read from files are numbered by their file and their place in it; nothing is written. A table of more than FILES
    files, or one that comes from elsewhere, is numbered as it is read and written once.
    """
    spark = docs.sparkSession
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        if "_metadata" in map(str.lower, docs.columns):
            raise AnalysisException("a column hides the files' own")
        docs.select(place)
        files = [r[0] for r in docs.select(path.alias("f")).distinct().limit(FILES + 1).collect()]
    except AnalysisException:
        files = [None] * (FILES + 1)
    if len(files) > FILES:
        return stored(docs.withColumn(into, F.monotonically_increasing_id()))
    table_of_files = spark.createDataFrame(list(zip(sorted(files), range(len(files)))), "`\x01file` string, `\x01base` long")
    own = docs.select("*", path.alias("\x01file"), place.alias("\x01place"))
    joined = own.join(F.broadcast(table_of_files), "\x01file")
    return joined.withColumn(into, F.shiftleft("\x01base", 40) + F.col("\x01place")).drop("\x01file", "\x01base", "\x01place")


def in_part(key: Column, modulus: int, rest: int) -> Column:
    """crc32(key as text) mod modulus equals rest; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def ordered_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones in every run: the smallest hashes of the key (TakeOrdered, no full sort)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key)).limit(rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets, without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(
        offsets, np.int64, len(column) + 1, column.offset * 8
    ) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def batches_of(offsets: np.ndarray, most: int, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes and at most ``rows`` rows each; a longer row is alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def lower_table() -> np.ndarray:
    """Byte map: A-Z to a-z, digits, letters and multi-byte characters kept, all else a space."""
    to = np.full(256, 0x20, np.uint8)
    for c in WORD_BYTES:
        to[c] = c
    to[0x41:0x5B] = np.arange(0x61, 0x7B)
    return to
