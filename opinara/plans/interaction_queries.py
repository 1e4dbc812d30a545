"""Queries over interactions: cleaning, k-core, splits, profiles and content predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import interactions as I
from ..operators import profiles as P
from ..shared import shared_folder, stored, table
from ..sources import readers
from ..sources.sample_tables import interactions, item_term_counts, sentiment, split_interactions
from .registry import INTER, SPLIT, query, r6


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """documents as raw reviews; some ratings are out of range or missing."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("user_id"), F.col("lang").alias("business_id"),
        "text", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 8).cast("double").alias("stars")
    )


RAW = (
    "raw AS (SELECT doc_id AS review_id, source AS user_id, lang AS business_id, text, "
    "CAST(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 8 END AS DOUBLE) AS stars FROM documents)"
)


@query(
    "flt_basic_clean",
    f"WITH {RAW} SELECT review_id, stars FROM raw WHERE text IS NOT NULL AND regexp_matches(text, "
    f"'[^ \\t\\n\\r\\f\\v]') AND user_id IS NOT NULL AND business_id IS NOT NULL AND stars BETWEEN 1 AND 5"
)
def flt_basic_clean(spark, sf):
    return I.basic_clean(_raw(spark, sf)).select("review_id", "stars")


@query(
    "flt_required_fields",
    f"WITH {RAW} SELECT CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN 'no_text' "
    f"WHEN user_id IS NULL THEN 'no_user' WHEN business_id IS NULL THEN 'no_item' WHEN stars IS NULL OR stars "
    f"NOT BETWEEN 1 AND 5 THEN 'bad_rating' END AS reason, count(*) AS rows FROM raw GROUP BY 1 HAVING reason "
    f"IS NOT NULL"
)
def flt_required_fields(spark, sf):
    return I.count_rejects(_raw(spark, sf), I.reject_reason())


def counts_of(spark: SparkSession, seen: Observation) -> DataFrame:
    """(reason, rows) of what an observation has counted; an action has run by now."""
    return spark.createDataFrame(list(seen.get.items()), "reason string, rows long")


@query(
    "flt_basic_clean_counted",
    f"""
    WITH {RAW}, judged AS (
      SELECT CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN 'no_text'
        WHEN user_id IS NULL THEN 'no_user' WHEN business_id IS NULL THEN 'no_item'
        WHEN stars IS NULL OR stars NOT BETWEEN 1 AND 5 THEN 'bad_rating' ELSE 'kept' END AS reason FROM raw
    )
    SELECT reason, count(j.reason) AS rows
    FROM (SELECT unnest(['no_text', 'no_user', 'no_item', 'bad_rating', 'kept']) AS reason) r
    LEFT JOIN judged j USING (reason) GROUP BY 1
    UNION ALL SELECT 'rows', count(*) FROM raw
    """
)
def flt_basic_clean_counted(spark, sf):
    """What cleaning drops, counted by reason while the rows that stay are written."""
    seen = Observation("cleaned")
    I.basic_clean(_raw(spark, sf), seen=seen).write.parquet(shared_folder(spark))
    return counts_of(spark, seen)


@query(
    "flt_domain_keywords",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%red%'"
)
def flt_domain_keywords(spark, sf):
    return I.domain_filter(table(spark, sf, "part"), ["Ring", "red"], "p_name").select("p_partkey", "p_name")


@query(
    "flt_neutral",
    f"WITH {INTER} SELECT review_id, CAST(CASE WHEN stars >= 4 THEN 1 ELSE 0 END AS INTEGER) AS sentiment_label "
    f"FROM inter WHERE stars <> 3"
)
def flt_neutral(spark, sf):
    from ..functions.columns import sentiment_label

    return interactions(spark, sf).filter("stars <> 3").select(
        "review_id", sentiment_label(F.col("stars")).alias("sentiment_label")
    )


@query(
    "prj_optional_columns",
    f"WITH {INTER} SELECT review_id, CAST(NULL AS DOUBLE) AS business_stars, CAST(NULL AS VARCHAR) AS business_city "
    f"FROM inter"
)
def prj_optional_columns(spark, sf):
    return I.optional_columns(interactions(spark, sf)).select("review_id", "business_stars", "business_city")


@query("prj_require_columns", f"WITH {INTER} SELECT review_id, user_id, business_id, stars FROM inter")
def prj_require_columns(spark, sf):
    rows = I.require_columns(interactions(spark, sf), ["review_id", "user_id", "business_id", "stars", "date"])
    return rows.select("review_id", "user_id", "business_id", "stars")


@query(
    "prj_schema_report",
    "SELECT * FROM (SELECT unnest(['doc_id', 'text', 'stars', 'lang', 'source', 'n_chars']) AS column, "
    "unnest(['bigint', 'string', NULL, 'string', 'string', 'bigint']) AS type, unnest(['present', "
    "'present', 'missing', 'extra', 'extra', 'extra']) AS status, unnest([count(*) - count(doc_id), "
    "count(*) - count(text), NULL, count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars)]) "
    "AS n_null FROM documents)"
)
def prj_schema_report(spark, sf):
    return I.schema_report(table(spark, sf, "documents"), ["doc_id", "text", "stars"])


@query(
    "agg_kcore",
    f"WITH {INTER}, c0 AS MATERIALIZED (SELECT review_id, user_id, business_id FROM inter), " + ", ".join(
        f"c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} WHERE user_id IN (SELECT user_id FROM c{i - 1} GROUP BY 1 HAVING count(*) >= 25) AND business_id IN (SELECT business_id FROM c{i - 1} GROUP BY 1 HAVING count(*) >= 20))" for i in range(
            1, 15
        )
    ) + " SELECT review_id, user_id, business_id FROM c14"
)
def agg_kcore(spark, sf):
    return I.kcore(interactions(spark, sf), 25, 20).select("review_id", "user_id", "business_id")


@query(
    "agg_kcore_empty",
    f"WITH {INTER}, c0 AS MATERIALIZED (SELECT review_id, user_id, business_id FROM inter), " + ", ".join(
        f"c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} WHERE user_id IN (SELECT user_id FROM c{i - 1} GROUP BY 1 HAVING count(*) >= 30) AND business_id IN (SELECT business_id FROM c{i - 1} GROUP BY 1 HAVING count(*) >= 25))" for i in range(
            1, 40
        )
    ) + " SELECT review_id FROM c39"
)
def agg_kcore_empty(spark, sf):
    return I.kcore(interactions(spark, sf), 30, 25).select("review_id")


@query(
    "jn_semi",
    f"WITH {INTER} SELECT review_id FROM inter WHERE user_id IN (SELECT user_id FROM inter "
    f"GROUP BY 1 HAVING count(*) >= 25) AND business_id IN (SELECT business_id FROM inter "
    f"GROUP BY 1 HAVING count(*) >= 20)"
)
def jn_semi(spark, sf):
    return I.minimum_both(interactions(spark, sf), 25, 20).select("review_id")


@query(
    "agg_dataset_stats",
    f"WITH {INTER} SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) "
    f"AS n_items, round(1 - count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT business_id)), "
    f"6) AS sparsity, min(stars) AS rating_min, max(stars) AS rating_max, round(avg(stars), "
    f"6) AS rating_mean FROM inter"
)
def agg_dataset_stats(spark, sf):
    return I.dataset_stats(interactions(spark, sf)).withColumns(
        {"sparsity": r6("sparsity"), "rating_mean": r6("rating_mean")}
    )


@query("agg_rating_distribution", f"WITH {INTER} SELECT stars, count(*) AS rows FROM inter GROUP BY 1")
def agg_rating_distribution(spark, sf):
    return I.rating_distribution(interactions(spark, sf))


@query("win_temporal_split", f"WITH {SPLIT} SELECT review_id, user_id, split FROM parts")
def win_temporal_split(spark, sf):
    return split_interactions(spark, sf).select("review_id", "user_id", "split")


@query(
    "agg_split_summary",
    f"WITH {SPLIT}, names(split) AS (VALUES ('train'), ('val'), ('test'), ('cold_start')) "
    f"SELECT split, count(review_id) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT business_id) "
    f"AS items, round(avg(stars), 6) AS mean_stars FROM names LEFT JOIN parts USING (split) "
    f"GROUP BY 1"
)
def agg_split_summary(spark, sf):
    return I.split_summary(split_interactions(spark, sf)).withColumn("mean_stars", r6("mean_stars"))


@query(
    "set_intersect_leakage",
    f"WITH {SPLIT} SELECT user_id AS review_id, count(DISTINCT split) AS splits FROM parts "
    f"GROUP BY 1 HAVING count(DISTINCT split) > 1"
)
def set_intersect_leakage(spark, sf):
    """Applied to user ids, which do stand in several parts; review ids don't."""
    return I.leaking_reviews(split_interactions(spark, sf), "user_id").withColumnRenamed("user_id", "review_id")


@query("win_key_disambiguate", f"WITH {INTER} SELECT review_id, l_orderkey FROM inter")
def win_key_disambiguate(spark, sf):
    return interactions(spark, sf).select("review_id", "l_orderkey")


@query(
    "set_distinct_universe",
    f"WITH {INTER} SELECT business_id, dense_rank() OVER (ORDER BY business_id) - 1 AS id "
    f"FROM (SELECT DISTINCT business_id FROM inter)"
)
def set_distinct_universe(spark, sf):
    return I.dense_ids(interactions(spark, sf), "business_id")


@query(
    "jn_enrich_inner",
    f"WITH {INTER} SELECT review_id, p_brand, c_mktsegment FROM inter JOIN part ON business_id = CAST(p_partkey "
    f"AS VARCHAR) JOIN customer ON user_id = CAST(c_custkey AS VARCHAR)"
)
def jn_enrich_inner(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("business_id"), "p_brand")
    users = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_mktsegment")
    return readers.enrich_inner(interactions(spark, sf), parts, users).select("review_id", "p_brand", "c_mktsegment")


@query(
    "jn_enrich_left",
    f"WITH {INTER} SELECT review_id, p_brand FROM inter LEFT JOIN part ON business_id = CAST(p_partkey AS VARCHAR)"
)
def jn_enrich_left(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("business_id"), "p_brand")
    return interactions(spark, sf).join(parts, "business_id", "left").select("review_id", "p_brand")


@query(
    "jn_enrich_counted",
    f"""
    WITH {INTER}, joined AS (
      SELECT p_partkey IS NULL AS no_b, c_custkey IS NULL AS no_u FROM inter
      LEFT JOIN (SELECT * FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%red%')
        ON business_id = CAST(p_partkey AS VARCHAR)
      LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = CAST(c_custkey AS VARCHAR)
    )
    SELECT 'rows' AS reason, count(*) AS rows FROM joined
    UNION ALL SELECT 'kept', count(*) FROM joined WHERE NOT no_b AND NOT no_u
    UNION ALL SELECT 'neither', count(*) FROM joined WHERE no_b AND no_u
    UNION ALL SELECT 'no_business', count(*) FROM joined WHERE no_b AND NOT no_u
    UNION ALL SELECT 'no_user', count(*) FROM joined WHERE no_u AND NOT no_b
    """
)
def jn_enrich_counted(spark, sf):
    """Reviews of one domain's items by users in credit: what the join drops, counted while the result is written."""
    parts = I.domain_filter(table(spark, sf, "part"), ["ring", "red"], "p_name")
    parts = parts.select(F.col("p_partkey").cast("string").alias("business_id"), "p_brand")
    users = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("user_id"), "c_mktsegment"
    )
    seen = Observation("enriched")
    readers.enrich_inner(interactions(spark, sf), parts, users, seen).write.parquet(shared_folder(spark))
    return counts_of(spark, seen)


@query(
    "jn_anti",
    f"WITH {SPLIT} SELECT DISTINCT business_id FROM parts WHERE business_id NOT IN (SELECT business_id "
    f"FROM parts WHERE split = 'val')"
)
def jn_anti(spark, sf):
    rows = split_interactions(spark, sf)
    return P.cold_items(rows, rows.filter("split = 'val'"))


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(sentiment(split_interactions(spark, sf)))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


@query(
    "agg_history_profile",
    f"WITH {SPLIT}, s AS (SELECT business_id, avg(stars) AS a, avg(sentiment) AS b FROM train "
    f"GROUP BY 1), g AS (SELECT avg(stars) AS ga, avg(sentiment) AS gb FROM train) SELECT review_id, "
    f"round(coalesce(a, ga), 6) AS stars_history, round(coalesce(b, gb), 6) AS sentiment_history "
    f"FROM evald LEFT JOIN s USING (business_id) CROSS JOIN g"
)
def agg_history_profile(spark, sf):
    train, test = _parts(spark, sf)
    return P.history_profile(train, test, ["stars", "sentiment"]).select(
        "review_id", r6("stars_history").alias("stars_history"), r6("sentiment_history").alias("sentiment_history")
    )


@query(
    "win_leave_one_out",
    f"WITH {SPLIT}, g AS (SELECT avg(stars) AS gs, avg(sentiment) AS gb FROM train), w AS (SELECT review_id, "
    f"stars, sentiment, count(*) OVER i AS n, sum(stars) OVER i AS ss, sum(sentiment) OVER i AS sb "
    f"FROM train WINDOW i AS (PARTITION BY business_id)) SELECT review_id, n - 1 AS n_others, "
    f"round(CASE WHEN n > 1 THEN (ss - stars) / (n - 1) ELSE gs END, 6) AS stars_history, "
    f"round(CASE WHEN n > 1 THEN (sb - sentiment) / (n - 1) ELSE gb END, 6) AS sentiment_history "
    f"FROM w CROSS JOIN g"
)
def win_leave_one_out(spark, sf):
    train, _ = _parts(spark, sf)
    return P.leave_one_out(train, ["stars", "sentiment"]).select(
        "review_id", "n_others", r6("stars_history").alias("stars_history"),
        r6("sentiment_history").alias("sentiment_history")
    )


@query(
    "op_protocol_history",
    f"WITH {SPLIT}, g AS (SELECT avg(sentiment) AS gb FROM train), w AS (SELECT review_id, "
    f"sentiment, count(*) OVER i AS n, sum(sentiment) OVER i AS sb FROM train WINDOW i AS (PARTITION BY business_id)), "
    f"s AS (SELECT business_id, avg(sentiment) AS b FROM train GROUP BY 1) SELECT review_id, "
    f"round(CASE WHEN n > 1 THEN (sb - sentiment) / (n - 1) ELSE gb END, 6) AS sentiment "
    f"FROM w CROSS JOIN g UNION ALL SELECT review_id, round(coalesce(b, gb), 6) FROM evald "
    f"LEFT JOIN s USING (business_id) CROSS JOIN g"
)
def op_protocol_history(spark, sf):
    train, test = _parts(spark, sf)
    out = P.apply_protocol(train, train, ["sentiment"], "history", True).unionByName(
        P.apply_protocol(test, train, ["sentiment"], "history", False)
    )
    return out.select("review_id", r6("sentiment").alias("sentiment"))


@query("op_protocol_target", f"WITH {SPLIT} SELECT review_id, round(sentiment, 6) AS sentiment FROM evald")
def op_protocol_target(spark, sf):
    train, test = _parts(spark, sf)
    return P.apply_protocol(
        test, train, ["sentiment"], "target_review", False
    ).select("review_id", r6("sentiment").alias("sentiment"))


@query("op_protocol_none", f"WITH {SPLIT} SELECT review_id, CAST(0 AS DOUBLE) AS sentiment FROM evald")
def op_protocol_none(spark, sf):
    train, test = _parts(spark, sf)
    return P.apply_protocol(test, train, ["sentiment"], "none", False).select("review_id", "sentiment")


UNIVERSE = "universe AS (SELECT business_id FROM inter UNION SELECT CAST(p_partkey AS VARCHAR) FROM part)"


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """Items of all parts of the split, and those without a review."""
    return interactions(spark, sf).select("business_id").unionByName(
        table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("business_id"))
    ).distinct()


@query(
    "agg_item_profile",
    f"WITH {SPLIT}, {UNIVERSE}, k AS (SELECT business_id, count(*) AS review_count, avg(stars) AS a, "
    f"avg(sentiment) AS b FROM train GROUP BY 1), g AS (SELECT avg(stars) AS ga, avg(sentiment) AS gb "
    f"FROM train) SELECT business_id, coalesce(review_count, 0) AS review_count, round(coalesce(a, "
    f"ga), 6) AS avg_rating, round(coalesce(b, gb), 6) AS sentiment_agg FROM universe LEFT "
    f"JOIN k USING (business_id) CROSS JOIN g"
)
def agg_item_profile(spark, sf):
    """All training reviews are known; cold items are those that the split leaves without one, and unreviewed parts."""
    out = P.item_profile(_parts(spark, sf)[0], universe(spark, sf))
    return out.withColumns({"avg_rating": r6("avg_rating"), "sentiment_agg": r6("sentiment_agg")})


@query(
    "jn_item_profile_left",
    f"WITH {SPLIT}, items AS (SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_brand "
    f"FROM part), k AS (SELECT business_id, count(*) AS review_count, avg(stars) AS a FROM train "
    f"GROUP BY 1), g AS (SELECT avg(stars) AS ga FROM train) SELECT business_id, p_brand, "
    f"coalesce(review_count, 0) AS review_count, round(coalesce(a, ga), 6) AS avg_rating "
    f"FROM items LEFT JOIN k USING (business_id) CROSS JOIN g"
)
def jn_item_profile_left(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("business_id"), "p_brand")
    profile = P.item_profile(_parts(spark, sf)[0], items, sentiment=None)
    return items.join(profile, "business_id", "left").select(
        "business_id", "p_brand", "review_count", r6("avg_rating").alias("avg_rating")
    )


TERMS = (
    "terms AS (SELECT review_id, t.business_id, unnest(list_filter(string_split(concat_ws(' ', "
    "lower(p_name), 'month' || month(date), 'order' || (l_orderkey % 40), 'order' || (l_orderkey % 7)), "
    "' '), lambda w: length(w) >= 2)) AS term FROM train t LEFT JOIN part ON t.business_id = CAST(p_partkey "
    "AS VARCHAR))"
)


@query(
    "agg_item_profile_terms",
    f"WITH {SPLIT}, {TERMS}, n AS (SELECT business_id, term, count(*) AS tf FROM terms GROUP BY 1, "
    f"2), k AS (SELECT business_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_words, string_agg(term || ':' "
    f"|| tf, ' ' ORDER BY term) AS profile FROM n GROUP BY 1) SELECT business_id, coalesce(n_terms, "
    f"0) AS n_terms, coalesce(n_words, 0) AS n_words, coalesce(profile, '') AS profile FROM (SELECT DISTINCT "
    f"business_id FROM inter) LEFT JOIN k USING (business_id)"
)
def agg_item_profile_terms(spark, sf):
    """All items with the summed term counts of their training reviews, in place of the joined text.

    Items without a training review, or without a date, have no terms.
    """
    rows = interactions(spark, sf)
    counts = item_term_counts(spark, sf, I.temporal_split(rows).filter("split = 'train'"))
    return P.spelled_terms(counts, rows)


@query(
    "set_dedupe_first",
    f"WITH {INTER} SELECT business_id, arg_min(CAST(date AS VARCHAR), review_id) AS first_date FROM inter GROUP BY 1"
)
def set_dedupe_first(spark, sf):
    rows = interactions(spark, sf).withColumn("first_date", F.col("date").cast("string"))
    return P.first_categories(rows, column="first_date")


CLUSTERED = SPLIT + (
    ", clustered AS (SELECT *, CAST(business_id AS BIGINT) % 7 AS cluster FROM train), "
    "pref AS (SELECT user_id, cluster, sum(stars) / sum(sum(stars)) OVER (PARTITION BY user_id) AS preference "
    "FROM clustered GROUP BY 1, 2), cm AS (SELECT cluster, avg(stars) AS cluster_avg, count(*) AS n "
    "FROM clustered GROUP BY 1)"
)


def _clustered(train: DataFrame) -> DataFrame:
    return train.withColumn("cluster", F.col("business_id").cast("long") % 7)


@query(
    "agg_user_cluster_pref", f"WITH {CLUSTERED} SELECT user_id, cluster, round(preference, 6) AS preference FROM pref"
)
def agg_user_cluster_pref(spark, sf):
    return P.user_cluster_preference(_clustered(_parts(spark, sf)[0])).withColumn("preference", r6("preference"))


@query("agg_cluster_mean", f"WITH {CLUSTERED} SELECT cluster, round(cluster_avg, 6) AS cluster_avg, n FROM cm")
def agg_cluster_mean(spark, sf):
    return P.cluster_mean(_clustered(_parts(spark, sf)[0])).withColumn("cluster_avg", r6("cluster_avg"))


def _cbf(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    rated = _clustered(train)
    clusters = rated.filter("CAST(business_id AS BIGINT) % 13 <> 0").select("business_id", "cluster").distinct()
    glob = train.agg(F.avg("stars").alias("global_avg"))
    return P.cbf_predict(
        test.crossJoin(F.broadcast(glob)), clusters, P.user_cluster_preference(rated),
        P.cluster_mean(rated).select("cluster", "cluster_avg")
    )


CBF = CLUSTERED + (
    ", cl AS (SELECT DISTINCT business_id, cluster FROM clustered WHERE CAST(business_id AS BIGINT) % 13 "
    "<> 0), ga AS (SELECT avg(stars) AS global_avg FROM train), joined AS (SELECT e.review_id, "
    "cl.cluster, preference, cluster_avg, global_avg FROM evald e LEFT JOIN cl USING (business_id) "
    "LEFT JOIN pref ON pref.user_id = e.user_id AND pref.cluster = cl.cluster LEFT JOIN cm ON cm.cluster "
    "= cl.cluster CROSS JOIN ga), cbf AS (SELECT review_id, CASE WHEN cluster IS NULL THEN 'unknown_item' "
    "WHEN preference IS NULL THEN 'no_preference' ELSE 'none' END AS fallback_kind, least(greatest(CASE WHEN "
    "cluster IS NULL THEN global_avg WHEN preference IS NULL THEN cluster_avg ELSE 1 + preference * 4 * 0.5 "
    "+ cluster_avg * 0.5 END, 1), 5) AS prediction FROM joined)"
)


@query("op_cbf_predict", f"WITH {CBF} SELECT review_id, fallback_kind, round(prediction, 6) AS prediction FROM cbf")
def op_cbf_predict(spark, sf):
    return _cbf(spark, sf).select("review_id", "fallback_kind", r6("prediction").alias("prediction"))


@query(
    "ev_fallback_rate",
    f"WITH {CBF} SELECT fallback_kind, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), "
    f"6) AS share FROM cbf GROUP BY 1"
)
def ev_fallback_rate(spark, sf):
    return P.fallback_rate(_cbf(spark, sf)).withColumn("share", r6("share"))


@query(
    "jn_nearest_centroid",
    "WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice / 100 AS DOUBLE) AS b "
    "FROM part), c AS (SELECT p_partkey % 5 AS cluster, avg(a) AS ca, avg(b) AS cb FROM x "
    "GROUP BY 1), d AS (SELECT p_partkey, cluster, sqrt(pow(a - ca, 2) + pow(b - cb, 2)) AS distance "
    "FROM x, c) SELECT p_partkey, arg_min(cluster, (round(distance, 9), cluster)) AS cluster, "
    "round(min(distance), 6) AS distance FROM d GROUP BY 1"
)
def jn_nearest_centroid(spark, sf):
    x = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b")
    )
    c = x.groupBy((F.col("p_partkey") % 5).alias("cluster")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return P.nearest_centroid(x, c, ["a", "b"], "p_partkey").withColumn("distance", r6("distance"))


@query("op_fit_dev_split")
def op_fit_dev_split(spark, sf):
    return I.fit_dev_split(interactions(spark, sf)).select("review_id", "part")


@query("win_running_sample")
def win_running_sample(spark, sf):
    rows = interactions(spark, sf)
    return I.running_sample(rows, rows.count() // 2).select("review_id", "user_id")


@query("op_stratified_subset")
def op_stratified_subset(spark, sf):
    rows = interactions(spark, sf).select("review_id", "user_id", "business_id")
    return I.stratified_subset(rows, rows.count() // 2, 5, 5).select("review_id", "user_id", "business_id")
