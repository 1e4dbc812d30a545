"""Error and ranking metrics, stream diagnostics and comparison tables over keyed predictions.

A prediction table has model, domain, seed, review_id, user_id, business_id, y_true and y_pred; every metric is grouped in
one plan, without a loop over runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["model", "domain", "seed"]


def squared_errors(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("squared_error", F.pow(F.col("y_true") - F.col("y_pred"), 2))


def rmse_mae(predictions: DataFrame, by: list[str] = RUN) -> DataFrame:
    d = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def rmse_sanity(metrics: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """verdict: suspicious_low below 5 % of the scale, suspicious_high above 50 %, else ok."""
    share = F.col("rmse") / (high - low)
    return metrics.withColumn(
        "verdict", F.when(share < 0.05, "suspicious_low").when(share > 0.5, "suspicious_high").otherwise("ok")
    )


def stream_diagnostics(long: DataFrame, flat: float = 1e-6) -> DataFrame:
    """Per stream: min, max, mean, population std, distinct values, rows, and whether it is flat. long: (stream, value)."""
    out = long.groupBy("stream").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.countDistinct("value").alias("n_unique"), F.count("value").alias("n")
    )
    return out.withColumn("is_flat", F.col("std") < flat)


def collapse_flags(predictions: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Per run: std, mean, distinct predictions, and collapsed if the std is below the limit."""
    out = predictions.groupBy(*RUN).agg(
        F.stddev_pop("y_pred").alias("std"), F.avg("y_pred").alias("mean"), F.countDistinct("y_pred").alias("n_unique")
    )
    return out.withColumn("collapsed", F.col("std") < limit)


def collapse_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("model", "domain").agg(
        F.count_if("collapsed").alias("n_collapsed"), F.count(F.lit(1)).alias("n_seeds")
    )


def ranked(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Top k items per group and user, an item's best score counting once; ties by item."""
    best = scored.groupBy(*by, "user_id", "business_id").agg(F.max("y_pred").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by, "user_id").orderBy(F.desc("score"), "business_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def ranking_metrics(
    scored: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20), by: list[str] = RUN
) -> DataFrame:
    """Per group and K: mean precision, recall and NDCG over users with relevant items.

    Precision divides by K, recall by all relevant items; the ideal DCG has min(relevant, K) terms.
    """
    # Scores and relevance meet per item once; what follows stays with the group and user. A missing key is never a hit.
    key = [*by, "user_id", "business_id"]
    flags = lambda a, b: (F.lit(a).alias("_scored"), F.lit(b).alias("_wanted"))
    both = scored.select(*key, "y_pred", *flags(True, False)).unionByName(
        relevant.select(*key, F.lit(None).cast("double").alias("y_pred"), *flags(False, True))
    ).groupBy(*key).agg(
        F.max("y_pred").alias("score"), F.max("_scored").alias("_scored"), F.max("_wanted").alias("_wanted")
    )
    order = Window.partitionBy(*by, "user_id").orderBy(F.desc("_scored"), F.desc("score"), "business_id")
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    rank = F.row_number().over(order)
    hit = F.col("_scored") & F.col("_wanted") & known & (F.col("rank") <= max(ks))
    found = both.withColumn("rank", rank).groupBy(*by, "user_id").agg(
        F.count_if("_wanted").alias("n_rel"), F.collect_list(F.when(hit, F.col("rank"))).alias("ranks")  # max(ks) at most
    ).filter("n_rel > 0")
    per_user = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    own = F.filter("ranks", lambda r: r <= F.col("k"))
    dcg = F.aggregate(own, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1)))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("n_rel", "k").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1))
    )
    user = per_user.select(
        *by, "k", (F.size(own) / F.col("k")).alias("p"), (F.size(own) / F.col("n_rel")).alias("r"),
        (dcg / ideal).alias("g")
    )
    return user.groupBy(*by, "k").agg(
        F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"),
        F.count(F.lit(1)).alias("users")
    )


def multi_seed(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation over seeds of each metric; one seed has no deviation."""
    return metrics.groupBy("model", "domain").agg(
        *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.count(F.lit(1)).alias("n_seeds")
    )


def results_pivot(metrics: DataFrame, domains: list[str], value: str = "rmse") -> DataFrame:
    return metrics.groupBy("model").pivot("domain", domains).agg(F.avg(value))


def stability(metrics: DataFrame, value: str = "rmse", seeds: int = 5) -> DataFrame:
    """For groups of exactly ``seeds`` runs: std, the seed farthest from the mean (the least such), std without it, factor."""
    g = Window.partitionBy("model", "domain")
    z = metrics.select(
        "model", "domain", "seed", F.col(value).alias("x"), F.count(F.lit(1)).over(g).alias("n"),
        F.avg(value).over(g).alias("m"), F.stddev_samp(value).over(g).alias("sd")
    ).filter(F.col("n") == seeds)
    z = z.withColumn("far", F.row_number().over(g.orderBy(F.desc(F.round(F.abs(F.col("x") - F.col("m")), 9)), "seed")))
    out = z.groupBy("model", "domain").agg(
        F.first("sd").alias("std"), F.max(F.when(F.col("far") == 1, F.col("seed"))).alias("extreme_seed"),
        F.stddev_samp(F.when(F.col("far") > 1, F.col("x"))).alias("std_without")
    )
    return out.withColumn("reduction", F.try_divide(F.col("std"), F.col("std_without")))


def baseline_versus(metrics_mean: DataFrame, baseline: str, model: str) -> DataFrame:
    """Per domain: RMSE and MAE change of model against baseline in per cent, and the ratio of their deviations."""
    a = metrics_mean.filter(F.col("model") == baseline).select(
        "domain", F.col("rmse_mean").alias("ar"), F.col("mae_mean").alias("am"), F.col("rmse_std").alias("asd")
    )
    b = metrics_mean.filter(F.col("model") == model).select(
        "domain", F.col("rmse_mean").alias("br"), F.col("mae_mean").alias("bm"), F.col("rmse_std").alias("bsd")
    )
    pct = lambda x, y: (F.col(x) - F.col(y)) / F.col(x) * 100
    return a.join(b, "domain").select(
        "domain", pct("ar", "br").alias("rmse_reduction"), pct("am", "bm").alias("mae_reduction"),
        F.try_divide(F.col("asd"), F.col("bsd")).alias("std_ratio")
    )
