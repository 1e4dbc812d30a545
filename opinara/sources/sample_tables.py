"""Review interactions, texts and model predictions derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.content import multi_hot, term_counts, terms_of
from ..operators.interactions import disambiguate, temporal_split
from ..shared import stored, table


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, user_id, business_id, date, stars, l_orderkey: a review for every line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = disambiguate(
        joined, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    )
    return keyed.select(
        "review_id", F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("business_id"), F.to_date("o_orderdate").alias("date"),
        (1 + (F.col("l_quantity").cast("int") - 1) % 5).cast("double").alias("stars"), "l_orderkey"
    )


def split_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(interactions(spark, sf_dir))


def _bags(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows with a short text of each review, ``bag``: its part's name, its month and its order."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("business_id"), F.lower("p_name").alias("name")
    )
    text = F.concat_ws(
        " ", "name", F.concat(F.lit("month"), F.month("date")), F.concat(F.lit("order"), F.col("l_orderkey") % 40),
        F.concat(F.lit("order"), F.col("l_orderkey") % 7)
    )
    return rows.join(parts, "business_id", "left").withColumn("bag", text)


def review_terms(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """(review_id, term, tf): words of a short text of each review, from its part's name, its month and its order."""
    return term_counts(_bags(spark, sf_dir, rows).select("review_id", "bag"), "review_id", "bag")


def item_term_counts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """(business_id, term, tf) of the same texts, summed per item: reviews go to their items before their words are cut."""
    # Dealt by item alone, the words are counted where they are; a hot item's reviews are slim.
    slim = rows.select("business_id", "date", "l_orderkey").repartition("business_id")
    return term_counts(_bags(spark, sf_dir, slim).select("business_id", "bag"), "business_id", "bag")


def own_terms(spark: SparkSession, sf_dir: str, rows: DataFrame, into: str = "words") -> DataFrame:
    """rows with a list of the terms of the same text, repeats too."""
    return _bags(spark, sf_dir, rows).withColumn(into, terms_of("bag")).drop("name", "bag")


def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, category): brand and type of each part."""
    return multi_hot(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").cast("string").alias("business_id"), F.array("p_brand", "p_type").alias("c")
        ),
        "business_id", "c"
    )


def sentiment(df: DataFrame) -> DataFrame:
    """A stand-in score between 0 and 1 that other engines can repeat."""
    return df.withColumn("sentiment", (F.col("l_orderkey") % 97).cast("double") / 97)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arithmetic models, two domains and five seeds over the test part of the split, which is written once."""
    rows = stored(split_interactions(spark, sf_dir))
    train = rows.filter("split = 'train'")
    test = rows.filter("split = 'test'")
    items = train.groupBy("business_id").agg(F.avg("stars").alias("im"))
    users = train.groupBy("user_id").agg(F.avg("stars").alias("um"))
    means = train.agg(F.avg("stars").alias("gm"))
    based = test.join(items, "business_id", "left").join(users, "user_id", "left").crossJoin(F.broadcast(means))
    models = F.array(
        F.struct(F.lit("global").alias("model"), F.col("gm").alias("base")),
        F.struct(F.lit("item").alias("model"), F.coalesce("im", "gm").alias("base")),
        F.struct(F.lit("user").alias("model"), F.coalesce("um", "gm").alias("base"))
    )
    each = based.withColumn("m", F.explode(models)).withColumn("seed", F.explode(F.array(*map(F.lit, range(1, 6)))))
    noise = ((F.col("l_orderkey") * 7 + F.col("seed") * 13) % 101).cast("double") / 100 - 0.5
    return each.select(
        F.col("m.model").alias("model"), F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("domain"),
        "seed", "review_id", "user_id", "business_id", F.col("stars").alias("y_true"),
        (F.col("m.base") + noise * 0.4).alias("y_pred"), "l_orderkey"
    )
