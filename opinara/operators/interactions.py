"""Cleaning, filtering, counting, splitting and sampling of review interactions.

A review table has review_id, user_id, business_id, stars and date (plus any others, which pass through). Per-user and
per-item counts are aggregated before they are moved and joined back, so a hot user or item is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..shared import counted, stored
from .keywords import holds_keyword

REQUIRED = ["review_id", "user_id", "business_id", "text", "stars", "date"]
#: Optional business columns and their types.
OPTIONAL = {
    "business_categories": "array<string>", "business_stars": "double", "business_city": "string",
    "business_review_count": "bigint", "reviewer_review_count": "bigint", "reviewer_average_stars": "double"
}


def require_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """df itself; ValueError if a required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional_columns(df: DataFrame, optional: dict[str, str] = OPTIONAL) -> DataFrame:
    """Adds the optional columns that df lacks, as null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns})


def schema_report(df: DataFrame, expected: list[str] = REQUIRED) -> DataFrame:
    """(column, type, status, n_null): present, missing or extra; and how many rows have no value, counted in one pass."""
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*expected, *(c for c in own if c not in expected)]
    nulls = {c: F.count_if(F.col(f"`{c}`").isNull()) if c in own else F.lit(None).cast("bigint") for c in names}
    status = {c: "missing" if c not in own else "present" if c in expected else "extra" for c in names}
    counted = df.agg(*[nulls[c].alias(f"n{k}") for k, c in enumerate(names)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(own.get(c)).cast("string").alias("type"),
                F.lit(status[c]).alias("status"), F.col(f"n{k}").alias("n_null")
            ) for k,
            c in enumerate(names)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def reject_reason(
    text: str = "text", rating: str = "stars", user: str = "user_id", item: str = "business_id", low: float = 1,
    high: float = 5
) -> Column:
    """Why a row is dropped, null if it stays: the first of no_text, no_user, no_item, bad_rating."""
    stars = F.expr(f"try_cast(`{rating}` AS DOUBLE)")
    return F.when(
        F.col(text).isNull() | ~F.col(text).rlike(r"\S"), "no_text"
    ).when(F.col(user).isNull(), "no_user").when(F.col(item).isNull(), "no_item").when(
        stars.isNull() | ~stars.between(low, high), "bad_rating"
    )


#: What reject_reason says.
REJECTS = ["no_text", "no_user", "no_item", "bad_rating"]


def basic_clean(
    df: DataFrame, text: str = "text", rating: str = "stars", user: str = "user_id", item: str = "business_id",
    seen: Observation | None = None
) -> DataFrame:
    """Drops rows with a null or blank text, null user, item or rating, or a rating that is no number in [1, 5].

    seen: gets the rows dropped by reason (REJECTS) from the action that reads the result.
    """
    reason = reject_reason(text, rating, user, item)
    kept = df.filter(reason.isNull()) if seen is None else counted(df, reason, REJECTS, seen)
    return kept.withColumn(rating, F.expr(f"try_cast(`{rating}` AS DOUBLE)"))


def count_rejects(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, rows) of the dropped rows."""
    return df.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


def domain_filter(
    df: DataFrame, keywords: list[str] | DataFrame, column: str = "business_categories"
) -> DataFrame:
    """Rows whose categories hold any keyword as a substring, in any case; null never does.

    keywords: a list, for a few of them, or a table (aspect, keyword), searched with an automaton.
    """
    if isinstance(keywords, DataFrame):
        return holds_keyword(df, keywords, F.col(column), "_held").filter("_held").drop("_held")
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower(F.col(column)), F.lit(k.lower()))
    return df.filter(F.coalesce(found, F.lit(False)))


def non_empty(df: DataFrame, what: str = "the filter") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} leaves no rows")
    return df


#: Users, or items, that a pass of the k-core may drop by a broadcast of their names.
DROPPED = 500_000


def kcore(
    df: DataFrame, min_user: int, min_item: int, user: str = "user_id", item: str = "business_id",
    dropped: int = DROPPED
) -> DataFrame:
    """Drops users and items with too few rows, again and again until nothing changes.

    Only (user, item, rows) triples go round; the rows themselves are filtered once at the end. A pass that drops more than
    ``dropped`` users or items moves the triples and counts anew. Other passes send round the names of what they drop, and
    the neighbours' counts are lowered by the dropped triples alone, so passes that drop little move little. Null users or
    items are dropped.
    """
    pairs = stored(
        df.groupBy(
            F.col(user).alias("u"), F.col(item).alias("i")
        ).agg(F.count(F.lit(1)).alias("n")).dropna(subset=["u", "i"])
    )
    least, other = {"u": min_user, "i": min_item}, {"u": "i", "i": "u"}
    sums = lambda k: stored(pairs.groupBy(k).agg(F.sum("n").alias("c")))
    counts = {k: sums(k) for k in least}
    while True:
        low = {k: counts[k].filter(F.col("c") < least[k]).select(k) for k in least}
        size = {k: low[k].count() for k in least}
        if not any(size.values()):
            break
        if max(size.values()) > dropped:
            for k in least:
                pairs = pairs.join(counts[k].filter(F.col("c") >= least[k]).select(k), k, "left_semi")
            pairs = stored(pairs)
            counts = {k: sums(k) for k in least}
            continue
        # A triple is taken from its user's count as its item goes, and from its item's as its user goes; where both have
        # gone, neither count is read again.
        lost = {
            k: pairs.join(F.broadcast(low[other[k]]), other[k], "left_semi").groupBy(k).agg(F.sum("n").alias("lost"))
            for k in least
        }
        counts = {
            k: stored(
                counts[k].filter(F.col("c") >= least[k]).join(lost[k], k, "left").select(
                    k, (F.col("c") - F.coalesce("lost", F.lit(0))).alias("c")
                )
            ) for k in least
        }
    for k in least:
        pairs = pairs.join(counts[k].select(k), k, "left_semi")
    return df.join(
        pairs.select(F.col("u").alias(user), F.col("i").alias(item)), [user, item], "left_semi"
    ).select(df.columns)


def minimum_both(
    df: DataFrame, min_user: int, min_item: int, user: str = "user_id", item: str = "business_id"
) -> DataFrame:
    """One pass of the above: rows whose user and item both have enough rows."""
    users = df.groupBy(user).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_user)
    items = df.groupBy(item).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_item)
    return df.join(users, user, "left_semi").join(items, item, "left_semi")


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: n_reviews, n_users, n_items, sparsity (null if there are no users or items), rating_min, _max and _mean."""
    n, u, i = F.count(F.lit(1)), F.countDistinct("user_id"), F.countDistinct("business_id")
    return df.agg(
        n.alias("n_reviews"), u.alias("n_users"), i.alias("n_items"),
        (1 - F.try_divide(n.cast("double"), (u * i).cast("double"))).alias("sparsity"),
        F.min("stars").alias("rating_min"), F.max("stars").alias("rating_max"), F.avg("stars").alias("rating_mean")
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("stars").agg(F.count(F.lit(1)).alias("rows"))


def user_places(
    df: DataFrame, user: str = "user_id", date: str = "date", key: str = "review_id", into: str = "place",
    count_into: str | None = None
) -> DataFrame:
    """Adds each row's place, from 1, in its user's order of (date, key), and the user's number of rows.

    Places are counted per (user, date) and offset by the earlier dates' counts, so that one user's rows need not meet. Rows
    without a user or a date have no place and are left out.
    """
    df = df.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    days = df.groupBy(user, date).agg(F.count(F.lit(1)).alias("_day"))
    by_user = Window.partitionBy(user)
    days = days.select(
        user, date,
        (
            F.sum("_day").over(by_user.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_day")
        ).alias("_before"),
        F.sum("_day").over(by_user).alias("_all")
    )
    out = df.join(days, [user, date]).withColumn(
        into, F.col("_before") + F.row_number().over(Window.partitionBy(user, date).orderBy(key))
    )
    return (out.withColumn(count_into, F.col("_all")) if count_into else out).drop("_before", "_all")


def temporal_split(
    df: DataFrame, train: float = 0.8, val: float = 0.1, hold_out_cold: bool = True, user: str = "user_id",
    date: str = "date", key: str = "review_id"
) -> DataFrame:
    """Adds ``split``: per user, in the order of (date, key), first train, then val, then test.

    Users with fewer than three rows are cold_start (or train). Rows without a user or a date are dropped before counting.
    """
    if abs(train + val - round(train + val, 6)) > 1e-6 or not 0 < train + val < 1:
        raise ValueError("ratios must leave a share for the test part")
    placed = user_places(df, user, date, key, "_rn", "_n")
    n, rn = F.col("_n"), F.col("_rn")
    nt0 = F.greatest(F.lit(1), F.bround(n * F.lit(train)))
    nv = F.when(n - nt0 > 1, F.greatest(F.lit(1), F.bround(n * F.lit(val)))).otherwise(0)
    nt = F.least(nt0, n - 1)
    split = F.when(
        n < 3, "cold_start" if hold_out_cold else "train"
    ).when(rn <= nt, "train").when((nv > 0) & (n - nt > nv) & (rn <= nt + nv), "val").otherwise("test")
    return placed.withColumn("split", split).drop("_n", "_rn")


SPLITS = ["train", "val", "test", "cold_start"]


def split_summary(df: DataFrame) -> DataFrame:
    """rows, users, items and mean stars of each of the four parts, 0 and null for empty ones."""
    names = df.sparkSession.sql("SELECT explode(array('train', 'val', 'test', 'cold_start')) AS split")
    found = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
        F.countDistinct("business_id").alias("items"), F.avg("stars").alias("mean_stars")
    )
    return names.join(found, "split", "left").fillna(0, ["rows", "users", "items"])


def leaking_reviews(df: DataFrame, key: str = "review_id") -> DataFrame:
    """Keys that stand in more than one part."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def assert_no_leakage(df: DataFrame, key: str = "review_id") -> DataFrame:
    if not leaking_reviews(df, key).isEmpty():
        raise ValueError("a review is in more than one split")
    return df


def disambiguate(df: DataFrame, base: list[str], order: list[str], into: str = "review_id") -> DataFrame:
    """Key of the base columns joined by '::'; the n-th row of the same base, by order, gets '::n'."""
    key = F.concat_ws("::", *[F.col(c).cast("string") for c in base])
    k = F.row_number().over(Window.partitionBy(*base).orderBy(*order))
    return df.withColumn("_k", k).withColumn(
        into, F.when(F.col("_k") == 1, key).otherwise(F.concat_ws("::", key, F.col("_k").cast("string")))
    ).drop("_k")


def drawn(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def running_sample(df: DataFrame, n_rows: int, seed: int = 42, user: str = "user_id") -> DataFrame:
    """Whole users in drawn order until n_rows are reached, the user that crosses included.

    A running total needs an order over all users; it is taken in two steps, over buckets of the drawn number and then
    within the one bucket where the total crosses.
    """
    users = stored(
        df.groupBy(user).agg(F.count(F.lit(1)).alias("c")).withColumn("draw", drawn(user, seed)).withColumn(
            "part", F.shiftrightunsigned("draw", 54)
        )
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = users.groupBy("part").agg(F.sum("c").alias("total")).withColumn(  # 1024 rows at most
        "base", F.coalesce(F.sum("total").over(before), F.lit(0))
    )
    within = Window.partitionBy("part").orderBy("draw", user).rowsBetween(Window.unboundedPreceding, -1)
    reached = users.join(F.broadcast(parts.filter(F.col("base") < n_rows)), "part").withColumn(
        "earlier", F.col("base") + F.coalesce(F.sum("c").over(within), F.lit(0))
    )
    return df.join(reached.filter(F.col("earlier") < n_rows).select(user), user, "left_semi")


def stratified_subset(df: DataFrame, n_rows: int, min_user: int, min_item: int, seed: int = 42) -> DataFrame:
    """Rows of active users and items, then whole users up to n_rows, then the k-core again.

    What each step leaves is written, as the next one reads it more than once.
    """
    active = stored(minimum_both(stored(df), min_user, min_item))
    return kcore(stored(running_sample(active, n_rows, seed)), min_user, min_item)


def fit_dev_split(df: DataFrame, fraction: float = 0.15, seed: int = 42, key: str = "review_id") -> DataFrame:
    """Adds ``part``: exactly floor(n * fraction) rows, those drawn lowest, are dev, the others fit; keys are unique.

    The last dev row is found in two steps, over buckets of the drawn number and then within the one bucket where the
    count is reached; all rows are then compared with it where they are.
    """
    rows, bucket = df.withColumn("_d", drawn(key, seed)), F.shiftright("_d", 54)
    sizes = sorted(tuple(r) for r in rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c")).collect())  # 1024 rows at most
    left = int(sum(c for _, c in sizes) * fraction)
    if left == 0:
        return df.withColumn("part", F.lit("fit"))
    for part, c in sizes:
        if left <= c:
            break
        left -= c
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_d", key))
    last = rows.filter(bucket == part).select(
        "_d", key, F.lit(part).alias("_part")
    ).withColumn("_rn", place).filter(F.col("_rn") == left).first()
    tie = F.col(key).isNull() | F.coalesce(F.col(key) <= F.lit(last[key]), F.lit(False))
    dev = (F.col("_d") < last["_d"]) | ((F.col("_d") == last["_d"]) & tie)
    return rows.withColumn("part", F.when(dev, "dev").otherwise("fit")).drop("_d")


def fold(key: str, k: int, seed: int = 42) -> Column:
    return F.pmod(drawn(key, seed), F.lit(k)).cast("int")


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, id): the distinct values numbered from 0 in their order, by range partitions and their sizes."""
    values = stored(
        df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn(
            "part", F.spark_partition_id()
        )
    )
    sizes = values.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn(
        "base", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return values.join(
        F.broadcast(sizes.select("part", "base")), "part"
    ).select(column, (F.col("base") + within).alias("id"))
