"""Sources and sinks on data derived from the tables (written, read back and compared), and lookups, sorts and searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import content as T
from ..operators import evaluation as E
from ..operators import fusion as U
from ..operators import interactions as I
from ..operators import profiles as P
from ..operators import ratings as R
from ..operators.hierarchy import WardClusters
from ..shared import shared_folder, stored, table
from ..sources import readers, writers
from ..sources.sample_tables import interactions, predictions, sentiment, split_interactions
from .evaluation_queries import RANKED, rounded
from .interaction_queries import CLUSTERED, UNIVERSE, _clustered, _parts, universe
from .model_queries import _item_vectors, content_parts, content_predictions
from .registry import INTER, METRICS, PREDICTED, SPLIT, query, r6

CORE = f"WITH {INTER} SELECT review_id, user_id, business_id, stars FROM inter"


def _core(spark, sf):
    return interactions(spark, sf).select(
        "review_id", "user_id", "business_id", F.lit("a \"quoted\"\ntext").alias("text"), "stars",
        F.date_format("date", "yyyy-MM-dd").alias("date")
    )


@query("src_csv", CORE)
def src_csv(spark, sf):
    path = shared_folder(spark)
    _core(spark, sf).write.csv(path, header=True, escape='"')
    return readers.read_csv(spark, path, multi_line=True).select("review_id", "user_id", "business_id", "stars")


@query("src_jsonl", CORE)
def src_jsonl(spark, sf):
    path = shared_folder(spark)
    _core(spark, sf).write.json(path)
    return readers.read_jsonl(spark, path).select("review_id", "user_id", "business_id", "stars")


@query(
    "src_jsonl_gz",
    f"WITH {INTER} SELECT user_id, business_id, stars, CAST(to_timestamp(l_orderkey * 86400) AT TIME ZONE "
    f"'UTC' AS DATE) AS date FROM inter"
)
def src_jsonl_gz(spark, sf):
    path = shared_folder(spark)
    rows = interactions(spark, sf).select(
        F.lit("t").alias("reviewText"), F.col("stars").alias("overall"), F.col("user_id").alias("reviewerID"),
        F.col("business_id").alias("asin"), (F.col("l_orderkey") * 86400).alias("unixReviewTime")
    )
    rows.write.json(path, compression="gzip")
    return readers.read_five_core(spark, path).select("user_id", "business_id", "stars", "date")


@query(
    "src_struct_literal",
    f"WITH {INTER} SELECT review_id, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE stars END AS overall FROM inter"
)
def src_struct_literal(spark, sf):
    text = F.when(F.col("l_orderkey") % 5 == 0, "{'overall': ").otherwise(
        F.concat(F.lit("{u'overall': "), F.col("stars").cast("string"), F.lit(", 'good': True, 'note': None}"))
    )
    return interactions(spark, sf).select(
        "review_id", readers.struct_literal(text, "overall double")["overall"].alias("overall")
    )


@query(
    "src_two_table_csv",
    f"WITH {INTER} SELECT review_id, user_id, business_id, stars, CASE WHEN CAST(business_id AS BIGINT) % "
    f"3 <> 0 THEN p_brand END AS business_city FROM inter JOIN part ON business_id = CAST(p_partkey AS VARCHAR)"
)
def src_two_table_csv(spark, sf):
    a, b = shared_folder(spark), shared_folder(spark)
    literal = lambda name, c: F.concat(F.lit(f"{{'{name}': "), c, F.lit("}"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    interactions(spark, sf).select(
        F.col("review_id").alias("id"), F.col("business_id").alias("offering_id"), F.lit("t").alias("text"),
        F.lit("d").alias("date"), literal("overall", F.col("stars").cast("string")).alias("ratings"),
        literal("id", quoted(F.col("user_id"))).alias("author")
    ).write.csv(a, header=True, escape='"')
    table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("id"), F.lit(3.0).alias("hotel_class"),
        literal("locality", quoted(F.col("p_brand"))).alias("address")
    ).write.csv(b, header=True, escape='"')
    return readers.read_hotel_reviews(spark, a, b).select(
        "review_id", "user_id", "business_id", "stars", "business_city"
    )


@query("snk_flat", CORE)
def snk_flat(spark, sf):
    path = shared_folder(spark)
    writers.write_flat(_core(spark, sf), path)
    return spark.read.parquet(path).select("review_id", "user_id", "business_id", "stars")


@query("src_split_load", f"WITH {SPLIT} SELECT review_id, user_id, stars, split FROM parts")
def src_split_load(spark, sf):
    path = shared_folder(spark)
    writers.write_splits(split_interactions(spark, sf), path, 42, 0.8, 0.1)
    return readers.load_splits(spark, path).select("review_id", "user_id", "stars", "split")


@query("src_preview", f"WITH {INTER} SELECT review_id, stars FROM inter ORDER BY review_id LIMIT 200000")
def src_preview(spark, sf):
    """The first rows in the order of their ids, as far as the preview reaches."""
    return readers.preview(interactions(spark, sf).orderBy("review_id")).select("review_id", "stars")


@query("snk_splits", f"WITH {SPLIT} SELECT review_id, split FROM parts")
def snk_splits(spark, sf):
    """Written and loaded again: src_split_load."""
    path = shared_folder(spark)
    writers.write_splits(split_interactions(spark, sf), path, 42, 0.8, 0.1)
    return readers.load_splits(spark, path).select("review_id", "split")


@query(
    "src_predictions_scan",
    f"WITH {PREDICTED} SELECT model, domain, seed, review_id, round(pow(y_true - y_pred, "
    f"2), 6) AS squared_error FROM preds WHERE seed = 3 AND model = 'item'"
)
def src_predictions_scan(spark, sf):
    path = shared_folder(spark)
    writers.write_predictions(predictions(spark, sf), path)
    return readers.scan_predictions(spark, path).filter("seed = 3 AND model = 'item'").select(
        "model", "domain", "seed", "review_id", r6("squared_error").alias("squared_error")
    )


@query(
    "ev_recompute_ranking",
    f"WITH {RANKED} SELECT model, domain, seed, CAST(k AS INTEGER) AS k, round(avg(n_hit / k), "
    f"6) AS precision, round(avg(n_hit / n_rel), 6) AS recall, round(avg(dcg / idcg), 6) AS ndcg, "
    f"count(*) AS users FROM each GROUP BY ALL"
)
def ev_recompute_ranking(spark, sf):
    path = shared_folder(spark)
    writers.write_predictions(predictions(spark, sf).withColumn("y_pred", F.round("y_pred", 9)), path)
    p = readers.scan_predictions(spark, path)
    return rounded(E.ranking_metrics(p, p.filter("y_true >= 4")), "precision", "recall", "ndcg")


@query("snk_results", f"WITH {METRICS} SELECT model, domain, seed, round(rmse, 6) AS rmse, '7' AS k FROM metrics")
def snk_results(spark, sf):
    """Written with their settings and read again: src_results_scan."""
    path = shared_folder(spark)
    writers.write_results(E.rmse_mae(predictions(spark, sf)), path, '{"a": {"k": 7}}')
    back = spark.read.parquet(path).dropna(subset=["rmse", "mae"])
    return back.select(
        "model", "domain", "seed", r6("rmse").alias("rmse"), F.get_json_object("config", "$.a.k").alias("k")
    )


@query(
    "snk_feature_cache",
    f"WITH {INTER} SELECT review_id, round((l_orderkey % 97) / 97.0::DOUBLE, 6) AS sentiment FROM inter"
)
def snk_feature_cache(spark, sf):
    """Scores of some rows are there, the rest is computed and appended, all are joined: jn_score_cache."""
    rows, path = interactions(spark, sf), shared_folder(spark)
    compute = lambda x: sentiment(x).select("review_id", "sentiment")
    writers.cached_features(rows.filter("l_orderkey % 2 = 0"), compute, path)
    return writers.cached_features(rows, compute, path).select("review_id", r6("sentiment").alias("sentiment"))


@query(
    "jn_score_cache",
    f"WITH {INTER} SELECT review_id, CASE WHEN stars >= 3 THEN round((l_orderkey % 97) / 97.0::DOUBLE, "
    f"6) END AS sentiment FROM inter"
)
def jn_score_cache(spark, sf):
    """Scores kept for the reviews of three stars or more, joined to all; the others have none."""
    rows, path = interactions(spark, sf), shared_folder(spark)
    writers.write_flat(sentiment(rows.filter("stars >= 3")).select("review_id", "sentiment"), path)
    return writers.attach_scores(rows, spark.read.parquet(path)).select("review_id", r6("sentiment").alias("sentiment"))


@query(
    "snk_feature_cache_bucketed",
    f"WITH {INTER} SELECT review_id, stars, round((l_orderkey % 97) / 97.0::DOUBLE, 6) AS sentiment FROM inter"
)
def snk_feature_cache_bucketed(spark, sf):
    """The cache and the reviews as tables bucketed by review: scores are found lacking, appended and attached where they lie."""
    name = f"opinara_{uuid.uuid4().hex}"
    rows = writers.write_bucketed(interactions(spark, sf), f"{name}_reviews", buckets=16)
    compute = lambda x: sentiment(x).select("review_id", "sentiment")
    writers.cached_in_table(rows.filter("stars >= 3"), compute, f"{name}_scores", buckets=16)
    out = writers.cached_in_table(rows, compute, f"{name}_scores", buckets=16)
    return out.select("review_id", "stars", r6("sentiment").alias("sentiment"))


@query(
    "snk_checkpoint_append",
    f"WITH {METRICS} SELECT DISTINCT domain AS stage, model AS candidate FROM metrics WHERE model <> 'item'"
)
def snk_checkpoint_append(spark, sf):
    path = shared_folder(spark)
    c = stored(
        predictions(spark, sf).select(F.col("domain").alias("stage"), F.col("model").alias("candidate")).distinct()
    )
    writers.append_checkpoint(c.filter("candidate = 'item'"), path)
    return U.pending(c, spark.read.parquet(path))


@query("flt_relevant", f"WITH {PREDICTED} SELECT DISTINCT review_id FROM preds WHERE y_true >= 4")
def flt_relevant(spark, sf):
    return predictions(spark, sf).filter("y_true >= 4").select("review_id").distinct()


@query(
    "jn_map_lookup",
    f"WITH {CLUSTERED} SELECT review_id, c.cluster FROM evald LEFT JOIN (SELECT DISTINCT business_id, "
    f"cluster FROM clustered) c USING (business_id)"
)
def jn_map_lookup(spark, sf):
    train, test = _parts(spark, sf)
    return test.join(
        _clustered(train).select("business_id", "cluster").distinct(), "business_id", "left"
    ).select("review_id", "cluster")


@query(
    "jn_composite_lookup",
    f"WITH {CLUSTERED} SELECT e.review_id, round(p.preference, 6) AS preference FROM evald e "
    f"LEFT JOIN pref p ON p.user_id = e.user_id AND p.cluster = CAST(e.business_id AS BIGINT) % 7"
)
def jn_composite_lookup(spark, sf):
    train, test = _parts(spark, sf)
    return _clustered(test).join(
        P.user_cluster_preference(_clustered(train)), ["user_id", "cluster"], "left"
    ).select("review_id", r6("preference").alias("preference"))


@query(
    "jn_total",
    f"WITH {CLUSTERED} SELECT user_id, cluster, sum(stars) AS s, sum(sum(stars)) OVER (PARTITION BY user_id) "
    f"AS total FROM clustered GROUP BY 1, 2"
)
def jn_total(spark, sf):
    rated = _clustered(_parts(spark, sf)[0])
    own = rated.groupBy("user_id", "cluster").agg(F.sum("stars").alias("s"))
    return own.join(
        rated.groupBy("user_id").agg(F.sum("stars").alias("total")), "user_id"
    ).select("user_id", "cluster", "s", "total")


@query(
    "agg_global_fallback",
    f"WITH {SPLIT}, {UNIVERSE}, g AS (SELECT avg(stars) AS ga FROM train) SELECT business_id, "
    f"0::BIGINT AS review_count, round(ga, 6) AS avg_rating FROM universe CROSS JOIN g WHERE business_id NOT "
    f"IN (SELECT business_id FROM train)"
)
def agg_global_fallback(spark, sf):
    return P.item_profile(_parts(spark, sf)[0], universe(spark, sf)).filter("review_count = 0").select(
        "business_id", F.col("review_count").cast("long").alias("review_count"), r6("avg_rating").alias("avg_rating")
    )


@query(
    "set_except_items",
    f"WITH {SPLIT}, {UNIVERSE} SELECT business_id FROM universe EXCEPT SELECT business_id FROM train"
)
def set_except_items(spark, sf):
    return universe(spark, sf).subtract(_parts(spark, sf)[0].select("business_id"))


@query("set_union_all", f"WITH {SPLIT} SELECT review_id, split FROM parts WHERE split IN ('train', 'val', 'test')")
def set_union_all(spark, sf):
    rows = split_interactions(spark, sf).select("review_id", "split")
    return rows.filter("split = 'train'").unionByName(rows.filter("split = 'val'")).unionByName(
        rows.filter("split = 'test'")
    )


@query(
    "srt_user_date",
    f"WITH {INTER} SELECT review_id, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS rn FROM inter"
)
def srt_user_date(spark, sf):
    return I.user_places(interactions(spark, sf)).select("review_id", F.col("place").cast("long").alias("rn"))


@query(
    "srt_report_order",
    f"WITH {METRICS}, o(model, place) AS (VALUES ('user', 1), ('item', 2), ('global', 3)) "
    f"SELECT place, model, domain, seed FROM metrics JOIN o USING (model) ORDER BY place, "
    f"domain, seed"
)
def srt_report_order(spark, sf):
    order = spark.sql("SELECT * FROM VALUES ('user', 1), ('item', 2), ('global', 3) AS t(model, place)")
    return E.rmse_mae(predictions(spark, sf)).join(F.broadcast(order), "model").select(
        "place", "model", "domain", "seed"
    ).orderBy("place", "domain", "seed")


@query("lim_head", "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 10")
def lim_head(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().orderBy("p_name").limit(10)


@query(
    "win_extreme_seed",
    f"WITH {METRICS}, z AS (SELECT *, avg(rmse) OVER (PARTITION BY model, domain) AS m FROM metrics) "
    f"SELECT model, domain, arg_max(seed, (round(abs(rmse - m), 9), -seed)) AS extreme_seed "
    f"FROM z GROUP BY 1, 2"
)
def win_extreme_seed(spark, sf):
    return E.stability(E.rmse_mae(predictions(spark, sf))).select("model", "domain", "extreme_seed")


@query(
    "win_topk_neighbours",
    f"WITH {SPLIT}, r AS (SELECT user_id AS u, business_id AS i, avg(stars) AS r FROM train "
    f"GROUP BY 1, 2), sims AS (SELECT a.i, b.i AS j, sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r "
    f"* b.r))) AS sim FROM r a JOIN r b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2), near AS (SELECT e.review_id, "
    f"s.i, row_number() OVER (PARTITION BY e.review_id ORDER BY round(s.sim, 9) DESC, s.i) AS rank "
    f"FROM evald e JOIN r ON r.u = e.user_id JOIN sims s ON s.i = r.i AND s.j = e.business_id "
    f"WHERE s.sim > 0) SELECT review_id, i, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 5"
)
def win_topk_neighbours(spark, sf):
    train, test = _parts(spark, sf)
    return R.top_neighbours(train, test, 5).select("review_id", "i", "rank")


@query(
    "agg_cluster_centroid",
    "SELECT p_partkey % 5 AS cluster, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), "
    "6) AS p_retailprice FROM part GROUP BY 1"
)
def agg_cluster_centroid(spark, sf):
    x = table(spark, sf, "part").withColumn("cluster", F.col("p_partkey") % 5)
    return rounded(T.cluster_centroids(x, ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


def _searched(spark, sf, stages, rows=None):
    """rows: the split's, where it is written already."""
    rows = stored(split_interactions(spark, sf)) if rows is None else rows
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    users, items = stored(I.dense_ids(train, "user_id")), stored(I.dense_ids(train, "business_id"))
    candidate = R.als_candidates(train, val, users, items)
    return U.staged_search(spark, stages, lambda settings: candidate(**{"rank": 4, "iterations": 3, **settings})[1])


@query("op_staged_search")
def op_staged_search(spark, sf):
    return _searched(
        spark, sf, {"reg": {"low": {"reg": 0.05}, "high": {"reg": 0.3}}, "rank": {"r4": {"rank": 4}, "r8": {"rank": 8}}}
    )


@query("op_grid_search")
def op_grid_search(spark, sf):
    """Settings of the factor model, and dimensions of the content stream, each by the error on the validation part."""
    rows = stored(sentiment(split_interactions(spark, sf)))
    factors = _searched(
        spark, sf, {"grid": {f"rank{k}_reg{g}": {"rank": k, "reg": g} for k in (4, 8) for g in (0.1, 0.3)}}, rows
    )
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    parts = content_parts(spark, sf, train)

    def evaluate(settings):
        out = content_predictions(train, val, parts, **settings)
        return out.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2)))).first()[0]

    return factors.unionByName(
        U.staged_search(spark, {"dimensions": {f"pca{k}": {"dimensions": k} for k in (2, 8)}}, evaluate)
    )


@query("op_cluster_hier")
def op_cluster_hier(spark, sf):
    """Ward's clusters of the items' vectors, their number by silhouette."""
    vectors = _item_vectors(spark, sf)
    return WardClusters().fit(vectors).choose(vectors, range(2, 6)).transform(vectors).select("business_id", "cluster")
