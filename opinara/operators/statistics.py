"""Paired tests between models over keyed predictions, p-values combined over seeds, and their tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shared import stored


def paired(predictions: DataFrame, model_a: str, models_b: list[str] | None = None) -> DataFrame:
    """(model_b, domain, seed, review_id, d): differences of squared errors, a minus b, over the reviews both have."""
    e = predictions.withColumn("e", F.pow(F.col("y_true") - F.col("y_pred"), 2))
    a = e.filter(F.col("model") == model_a).select("domain", "seed", "review_id", F.col("e").alias("ea"))
    b = e.filter(F.col("model") != model_a) if models_b is None else e.filter(F.col("model").isin(models_b))
    return b.select(
        F.col("model").alias("model_b"), "domain", "seed", "review_id", F.col("e").alias("eb")
    ).join(a, ["domain", "seed", "review_id"]).withColumn("d", F.col("ea") - F.col("eb"))


def pair_counts(predictions: DataFrame, model_a: str) -> DataFrame:
    """Rows of a, of b and of both; unequal where they differ."""
    n = predictions.groupBy("model", "domain", "seed").agg(F.count(F.lit(1)).alias("n"))
    a = n.filter(F.col("model") == model_a).select("domain", "seed", F.col("n").alias("n_a"))
    b = n.filter(F.col("model") != model_a).select(
        F.col("model").alias("model_b"), "domain", "seed", F.col("n").alias("n_b")
    )
    both = paired(predictions, model_a).groupBy("model_b", "domain", "seed").agg(F.count(F.lit(1)).alias("n_both"))
    out = b.join(a, ["domain", "seed"]).join(both, ["model_b", "domain", "seed"], "left").fillna(0, ["n_both"])
    return out.withColumn("unequal", (F.col("n_a") != F.col("n_both")) | (F.col("n_b") != F.col("n_both")))


GROUP = ["model_b", "domain", "seed"]


def difference_counts(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """Per group and distinct |d| (rounded to ``digits``, zero included): ties and positives, written once."""
    d = F.round("d", digits)
    return stored(
        pairs.groupBy(*GROUP, F.abs(d).alias("size")).agg(
            F.count(F.lit(1)).alias("ties"), F.count_if(d > 0).alias("positive")
        )
    )


def signed_ranks(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """Per group and distinct |d| (rounded to ``digits``): ties, positives, and the average rank; zeros are dropped.

    Equal differences are counted before anything is ordered. The order over all of a group is then taken in two steps: a
    prefix sum over at most BUCKETS value ranges, and one within each range.
    """
    return _ranked(difference_counts(pairs, digits))


def _ranked(counts: DataFrame) -> DataFrame:
    counts = counts.filter("size <> 0")
    # Ranges by magnitude: the float's leading bits grow with it.
    part = F.floor(F.log2("size") * 16)
    counts = counts.withColumn("part", part)
    parts = counts.groupBy(*GROUP, "part").agg(F.sum("ties").alias("total"))
    parts = parts.withColumn(
        "base",
        F.coalesce(
            F.sum("total").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)
        )
    ).drop("total")
    within = F.coalesce(
        F.sum("ties").over(
            Window.partitionBy(*GROUP, "part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0)
    )
    return counts.join(parts, [*GROUP, "part"]).withColumn(
        "rank", F.col("base") + within + (F.col("ties") + 1) / 2
    ).drop("part", "base")


@F.pandas_udf(DoubleType())
def _two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x and x is not None else None)


#: Groups of at most so many differences, none of them zero or tied, get the exact p.
EXACT = 50


def exact_signed_rank_p(n: Column, statistic: Column) -> Column:
    """Two-sided p of the signed-rank statistic of n untied differences: twice the share of all 2^n choices of signs whose
    positive ranks sum up to it or less, 1 at most. The choices are counted rank by rank over an array of the sums.
    """
    one = F.transform(F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int")), lambda w: (w == 0).cast("double"))

    def with_rank(ways: Column, rank: Column) -> Column:
        return F.transform(ways, lambda x, w: x + F.when(w >= rank, F.get(ways, w - rank)).otherwise(0.0))

    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, with_rank)
    below = F.aggregate(F.slice(ways, 1, statistic.cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def wilcoxon(pairs: DataFrame, exact: int = EXACT) -> DataFrame:
    """Signed-rank test per group: n (non-zero), w_plus, w_minus, statistic (the lesser), z, p (two-sided), method.

    p is exact where a group has at most ``exact`` differences, none of them zero or tied with another; elsewhere it is by
    the normal approximation with ties corrected. It is computed on the result rows, and null without a non-zero difference:
    such groups have no row.
    """
    # Pairs, which come of a join, are read once: zeros are counted with the other differences.
    counts = difference_counts(pairs)
    r = _ranked(counts)
    zeros = counts.filter("size = 0").select(*GROUP, F.col("ties").alias("zeros"))
    t, n = F.col("ties"), F.col("n")
    sums = r.groupBy(*GROUP).agg(
        F.sum("ties").alias("n"), F.sum(F.col("positive") * F.col("rank")).alias("w_plus"),
        F.sum((t - F.col("positive")) * F.col("rank")).alias("w_minus"),
        F.sum(t.cast("double") * t * t - t).alias("tied")
    )
    sums = sums.withColumn("statistic", F.least("w_plus", "w_minus"))
    nd = n.cast("double")
    se = F.sqrt(nd * (nd + 1) * (2 * nd + 1) / 24 - F.col("tied") / 48)
    z = F.try_divide(F.col("statistic") - nd * (nd + 1) / 4, se)
    sums = sums.withColumn("z", z).join(zeros, GROUP, "left").fillna(0, ["zeros"])
    small = (n <= exact) & (F.col("tied") == 0) & (F.col("zeros") == 0)
    p = F.when(small, exact_signed_rank_p(n, F.col("statistic"))).otherwise(_two_sided_normal("z"))
    method = F.when(small, "exact").otherwise("normal")
    return sums.withColumn("p", p).withColumn("method", method).drop("tied", "zeros")


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (
            a * math.log(x) if x > 0 else -math.inf
        ) + b * math.log1p(-x)
    ) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [t_two_sided(x, k - 1) if x == x and x is not None and k > 1 else None for x, k in zip(t, n, strict=True)],
        dtype="float64"
    )


def paired_t(pairs: DataFrame) -> DataFrame:
    """t = mean / (sample std / sqrt(n)) per group; p on the result rows; null where the std is 0 or missing."""
    out = pairs.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")
    )
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return out.withColumn("p", _t_p("t", "n"))


LEAST_P = 1e-300


def fisher(p: DataFrame, by: list[str], column: str = "p") -> DataFrame:
    """Fisher's combination: X = -2 sum ln p over m tests; the chi-square tail with 2m degrees is a finite sum.

    A p below LEAST_P, or one that is 0 as no double is small enough, counts as LEAST_P; a null p doesn't count.
    """
    sums = p.filter(F.col(column) >= 0).groupBy(*by).agg(
        (-2 * F.sum(F.log(F.greatest(F.col(column), F.lit(LEAST_P))))).alias("x"),
        F.count(column).cast("int").alias("m")
    )
    half = F.col("x") / 2
    tail = F.aggregate(
        F.sequence(F.lit(1), F.col("m")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), lambda s,
        i: F.struct((s["term"] * half / i).alias("term"), (s["total"] + s["term"]).alias("total"))
    )["total"]
    return sums.withColumn("p_combined", F.exp(-half) * tail)


def significance_table(predictions: DataFrame, model_a: str) -> DataFrame:
    """model_a against every other model per domain and seed: n, both RMSEs, statistic and p, in one job."""
    pairs = paired(predictions, model_a)
    errors = pairs.groupBy(*GROUP).agg(
        F.sqrt(F.avg("ea")).alias("rmse_a"), F.sqrt(F.avg("eb")).alias("rmse_b"), F.count(F.lit(1)).alias("n_pairs")
    )
    return errors.join(
        wilcoxon(pairs).select(*GROUP, "statistic", "p"), GROUP, "left"
    ).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def significance_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("model_b").agg(
        F.count_if("significant").alias("n_significant"), F.count(F.lit(1)).alias("n_tests"),
        F.avg("rmse_a").alias("mean_rmse_a"), F.avg("rmse_b").alias("mean_rmse_b")
    )


def summary_table(metrics_mean: DataFrame, tests: DataFrame, reference: str) -> DataFrame:
    """Per model and domain: RMSE mean and std, significant seeds and combined p; blank for the reference itself."""
    counts = tests.groupBy(F.col("model_b").alias("model"), "domain").agg(
        F.count_if("significant").alias("n_significant")
    )
    combined = fisher(tests, ["model_b", "domain"]).select(F.col("model_b").alias("model"), "domain", "p_combined")
    return metrics_mean.join(counts, ["model", "domain"], "left").join(
        combined, ["model", "domain"], "left"
    ).withColumn("is_reference", F.col("model") == reference)
