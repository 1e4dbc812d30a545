"""Readers of raw and normalised review data; all schemas are explicit and all ids are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import counted

CORE = "review_id string, user_id string, business_id string, text string, stars double, date string"
BUSINESS = "business_id string, categories string, stars double, city string, review_count bigint"
USER = "user_id string, review_count bigint, average_stars double"
FIVE_CORE = "reviewText string, overall double, reviewerID string, asin string, unixReviewTime bigint"
HOTEL_REVIEW = "id string, offering_id string, text string, date string, ratings string, author string"
OFFERING = "id string, hotel_class double, address string"


def read_csv(spark: SparkSession, path: str, schema: str = CORE, multi_line: bool = False) -> DataFrame:
    """Flat review CSV with a header and doubled quotes. A field that doesn't fit is null.

    With multi_line, quoted texts may hold line ends; each file is then one task's, however large, so write many of them.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"', enforceSchema=False)


def read_jsonl(spark: SparkSession, path: str, schema: str = CORE) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones dropped."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    lines = spark.read.schema(f"{schema}, _corrupt string").json(
        path, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE"
    )
    return lines.filter(
        F.coalesce("_corrupt", *[F.col(c).cast("string") for c in names]).isNotNull() & F.col("_corrupt").isNull()
    ).drop("_corrupt")


def read_five_core(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Gzipped five-core JSON lines under our names; rows lacking a field stay, for count_rejects. A gzip file is one task to
    read, so what follows is dealt out again."""
    raw = read_jsonl(spark, path, FIVE_CORE)
    out = raw.select(
        F.col("reviewerID").alias("user_id"), F.col("asin").alias("business_id"), F.col("reviewText").alias("text"),
        F.col("overall").alias("stars"), F.col("unixReviewTime").alias("ts"),
        F.to_date(F.timestamp_seconds("unixReviewTime")).alias("date")
    )
    return out.repartition(parts) if parts else out.repartition("user_id", "business_id")


def struct_literal(text: Column, schema: str) -> Column:
    """A Python dict literal as a struct; what can't be read is null in each field."""
    plain = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false"
    )
    return F.from_json(F.regexp_replace(plain, r"(?<=[\[{,:\s])u(?=['\"])", ""), schema, {"allowSingleQuotes": "true"})


def last_of(df: DataFrame, key: str) -> DataFrame:
    """One row per key: of repeated keys the greatest row by all other columns."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*others)).alias("_m")).select(
        key, *[F.col(f"_m.{c}").alias(c) for c in others]
    )


def read_hotel_reviews(spark: SparkSession, reviews: str, offerings: str, multi_line: bool = False) -> DataFrame:
    """Hotel reviews with their offering's class and locality; a review without an offering keeps nulls. Of repeated offerings
    the greatest row counts."""
    r = read_csv(spark, reviews, HOTEL_REVIEW, multi_line)
    o = read_csv(spark, offerings, OFFERING, multi_line).select(
        F.col("id").alias("business_id"), F.col("hotel_class").alias("business_stars"),
        struct_literal(F.col("address"), "locality string")["locality"].alias("business_city")
    )
    flat = r.select(
        F.col("id").alias("review_id"), struct_literal(F.col("author"), "id string")["id"].alias("user_id"),
        F.col("offering_id").alias("business_id"), "text",
        struct_literal(F.col("ratings"), "overall double")["overall"].alias("stars"), F.col("date")
    )
    return flat.join(last_of(o, "business_id"), "business_id", "left")


def preview(df: DataFrame, n: int = 200_000) -> DataFrame:
    return df.limit(n)


#: Why enrich_inner drops a review.
UNMATCHED = ["no_business", "no_user", "neither"]


def enrich_inner(
    reviews: DataFrame, businesses: DataFrame, users: DataFrame, seen: Observation | None = None
) -> DataFrame:
    """Reviews with their business and user attributes; unmatched ones are dropped, and counted by UNMATCHED in ``seen`` if
    it is given. Of repeated dimension keys the greatest row (by all columns) counts."""
    b, u = last_of(businesses, "business_id"), last_of(users, "user_id")
    if seen is None:
        return reviews.join(b, "business_id").join(u, "user_id")
    both = reviews.join(b.withColumn("_b", F.lit(True)), "business_id", "left").join(
        u.withColumn("_u", F.lit(True)), "user_id", "left"
    )
    no_b, no_u = F.col("_b").isNull(), F.col("_u").isNull()
    reason = F.when(no_b & no_u, "neither").when(no_b, "no_business").when(no_u, "no_user")
    return counted(both, reason, UNMATCHED, seen).drop("_b", "_u")


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """The written splits; ValueError if one of the four is not recorded."""
    meta = spark.read.parquet(f"{path}/metadata").first()
    missing = {"train", "val", "test", "cold_start"} - set(meta["splits"])
    if missing:
        raise ValueError(f"splits missing: {sorted(missing)}")
    return spark.read.parquet(f"{path}/rows")


#: Why scan_results skips a run.
SKIPPED = ["malformed", "incomplete"]


def scan_results(spark: SparkSession, path: str, kind: str = "parquet", seen: Observation | None = None) -> DataFrame:
    """Run results (model, domain, seed, rmse, mae, config) as write_results leaves them, or as JSON lines (kind="json").

    Lines that are no JSON (malformed) and rows without a required field (incomplete) are skipped, and counted in ``seen`` if
    it is given; empty lines are neither.
    """
    schema = "model string, domain string, seed int, rmse double, mae double, config string"
    if kind == "json":
        found = spark.read.schema(f"{schema}, _corrupt string").json(
            path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", recursiveFileLookup=True
        )
    else:
        found = spark.read.schema(schema).parquet(path).withColumn("_corrupt", F.lit(None).cast("string"))
    missing = F.lit(False)
    for c in ("model", "domain", "seed", "rmse", "mae"):
        missing = missing | F.col(c).isNull()
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(missing, "incomplete")
    out = found.filter(reason.isNull()) if seen is None else counted(found, reason, SKIPPED, seen)
    return out.drop("_corrupt")


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions partitioned by model, domain and seed; conditions on these prune folders."""
    return spark.read.parquet(path).withColumns(
        {
            "model": F.col("model").cast("string"), "domain": F.col("domain").cast("string"),
            "seed": F.col("seed").cast("int")
        }
    )
