"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before has kept; between stages the
documents are written as Parquet and read again. All stages but the last return the columns of ``documents``, under
whatever names and with whatever values docs has them. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import decontamination, exact_dedup, near_dedup, packing, quality
from opinara.llm.common import numbered, shared_folder, table


#: Columns that the stages add and take away; no table of documents has such names.
ROW, OWN = "\x01row", "\x01own"


def _place() -> Column:
    """The order in which rows are kept: by doc_id, those without one last, then by row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(ROW).alias("row"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _kept(rows: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows whose own numbers are among the kept ones; light numbers meet whole rows once."""
    return rows.join(kept, ROW, "left_semi").select(*_columns(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored at the threshold of op9 or more; learns from all labels whose documents are there.

    Every row is judged by its own text, so ids may be null or repeated; a null or empty text has the mean label as score.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, into=OWN).filter(F.col(OWN) >= quality.THRESHOLD).select(*_columns(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal normalised texts: the longest, then the least doc_id; ids may be null or repeated.

    Null and empty texts are equal to each other, so one of them stays.
    """
    rows = numbered(docs, ROW)
    verdicts = exact_dedup.exact_groups(rows, row=ROW)
    return _kept(rows, verdicts.filter("kept").select(F.col("row").alias(ROW)), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates, the first by ``_place``: shingles of five words, similarity 0.8.

    Ids may be null or repeated; rows without a word link with nothing and all stay.
    """
    rows = numbered(docs, ROW)
    members = near_dedup.near_groups(rows, doc_id=ROW, row=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = members.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(_place()).alias("first"))
    return _kept(rows, first.select(F.col("first.row").alias(ROW)), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item; every row is judged by its own text, a null one stays."""
    found = decontamination.find_windows(docs, table(spark, sf_dir, "benchmark"), into=OWN)
    return found.filter(F.size(F.col(f"`{OWN}`.spans")) == 0).select(*_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids; the columns of op10. A null text is the end id alone; an empty table has no pieces."""
    return packing.digest(packing.pack(docs, ranks=packing.tokenizer_path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, shingle components and token ids have no SQL form.
ORACLE_SQL = None
