"""Sinks: flattened reviews, splits, predictions, results, feature caches and checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_flat(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, seed: int, train: float, val: float) -> None:
    """Rows by split, and one row of metadata that names all four, so that an empty split is known and keeps its schema."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    meta = df.sparkSession.range(1).select(
        F.lit(seed).alias("seed"), F.lit(train).alias("train"), F.lit(val).alias("val"),
        F.lit(1 - train - val).alias("test"),
        F.array(*map(F.lit, ["train", "val", "test", "cold_start"])).alias("splits")
    )
    meta.write.mode("overwrite").parquet(f"{path}/metadata")


def prediction_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "model", "domain", "seed", "review_id", "user_id", "business_id", "y_true", "y_pred",
        F.pow(F.col("y_true") - F.col("y_pred"), 2).alias("squared_error")
    )


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    prediction_rows(df).write.mode(mode).partitionBy("model", "domain", "seed").parquet(path)


def write_results(df: DataFrame, path: str, config: str, overwrite: bool = False) -> None:
    """Metrics with the settings as JSON text, by model, domain and seed; existing ones are an error, or replaced run by run."""
    out = df.withColumn("config", F.lit(config))
    writer = out.write.partitionBy("model", "domain", "seed")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def cached_features(
    rows: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, key: str = "review_id"
) -> DataFrame:
    """rows joined with the features stored for their keys; keys without any are computed and appended first."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path)
        missing = rows.join(known.select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        missing = rows
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return attach_scores(rows, spark.read.parquet(path), key)


def write_bucketed(df: DataFrame, table: str, key: str = "review_id", buckets: int = 200, mode: str = "overwrite") -> DataFrame:
    """df as a table whose rows lie in ``buckets`` buckets by key, sorted by it within files; and that table.

    Tables of one key and number of buckets are joined on the key where they lie, without an exchange.
    """
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def cached_in_table(
    rows: DataFrame, compute: Callable[[DataFrame], DataFrame], table: str, key: str = "review_id", buckets: int = 200
) -> DataFrame:
    """As cached_features, with the features in a bucketed table: rows bucketed alike meet them without an exchange, both
    to find the keys that lack features and to attach them."""
    spark = rows.sparkSession
    known = spark.catalog.tableExists(table)
    missing = rows.join(spark.table(table).select(key), key, "left_anti") if known else rows
    if not known or not missing.isEmpty():
        write_bucketed(compute(missing), table, key, buckets, "append")
    return attach_scores(rows, spark.table(table), key)


def attach_scores(rows: DataFrame, scores: DataFrame, key: str = "review_id") -> DataFrame:
    """rows with the scores kept for their keys, null where there are none."""
    return rows.join(scores, key, "left")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
