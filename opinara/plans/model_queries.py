"""Queries of the learned streams: neighbours and biases with SQL, the others checked by property tests."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import sentiment_label
from ..operators import content as T
from ..operators import evaluation as E
from ..operators import fusion as U
from ..operators import interactions as I
from ..operators import profiles as P
from ..operators import ratings as R
from ..operators.network import network_stream
from ..operators.scoring import as_scorer
from ..shared import stored, table
from ..sources.sample_tables import item_categories, item_term_counts, own_terms, sentiment, split_interactions
from .registry import SPLIT, query, r6


def _parts(spark, sf):
    rows = stored(sentiment(split_interactions(spark, sf)))
    return rows.filter("split = 'train'"), rows.filter("split = 'val'"), rows.filter("split = 'test'")


#: What a rating stream reads of the interactions.
RATED = ["review_id", "user_id", "business_id", "stars"]


def _ids(train):
    return stored(I.dense_ids(train, "user_id")), stored(I.dense_ids(train, "business_id"))


#: Similarities over the raters both have, from the rating table r (u, i, r); pairs both ways.
SIMS = {
    "cosine": "sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r)))",
    "pearson": "coalesce((count(*) * sum(a.r * b.r) - sum(a.r) * sum(b.r)) / nullif(sqrt(greatest(count(*) * sum(a.r * a.r) - sum(a.r) * sum(a.r), 0)) * sqrt(greatest(count(*) * sum(b.r * b.r) - sum(b.r) * sum(b.r), 0)), 0), 0)",
    "msd": "1 / (sum((a.r - b.r) * (a.r - b.r)) / count(*) + 1)",
}


def knn_sql(kind: str, user_based: bool = False) -> str:
    u, i = ("business_id", "user_id") if user_based else ("user_id", "business_id")
    return f"""WITH {SPLIT}, r AS MATERIALIZED (SELECT {u} AS u, {i} AS i, avg(stars) AS r FROM train GROUP BY 1, 2),
sims AS MATERIALIZED (SELECT a.i, b.i AS j, {SIMS[kind]} AS sim FROM r a JOIN r b ON a.u = b.u AND a.i <> b.i WHERE b.i IN (SELECT {i} FROM evald) GROUP BY 1, 2),
near AS (SELECT e.review_id, s.sim, r.r, row_number() OVER (PARTITION BY e.review_id ORDER BY round(s.sim, 9) DESC, s.i) AS k FROM evald e JOIN r ON r.u = e.{u} JOIN sims s ON s.i = r.i AND s.j = e.{i} WHERE s.sim > 0),
p AS (SELECT review_id, sum(sim * r) / sum(sim) AS p FROM near WHERE k <= 40 GROUP BY 1)
SELECT e.review_id, CASE WHEN p IS NULL THEN 'global_mean' ELSE 'none' END AS fallback_kind, round(coalesce(p, (SELECT avg(stars) FROM train)), 6) AS prediction FROM evald e LEFT JOIN p USING (review_id)"""


def _knn(spark, sf, kind, user_based=False):
    train, _, test = _parts(spark, sf)
    return R.item_knn(train, test, kind=kind, user_based=user_based).select(
        "review_id", "fallback_kind", r6("prediction").alias("prediction")
    )


@query("op_item_knn", knn_sql("cosine"))
def op_item_knn(spark, sf):
    return _knn(spark, sf, "cosine")


@query("op_item_knn_msd", knn_sql("msd"))
def op_item_knn_msd(spark, sf):
    return _knn(spark, sf, "msd")


@query("op_user_knn", knn_sql("cosine", True))
def op_user_knn(spark, sf):
    return _knn(spark, sf, "cosine", True)


@query(
    "op_corated_pearson",
    f"WITH {SPLIT}, r AS (SELECT user_id AS u, business_id AS i, avg(stars) AS r FROM train "
    f"GROUP BY 1, 2) SELECT a.i, b.i AS j, round({SIMS['pearson']}, 5) AS sim FROM r a JOIN r b ON a.u = b.u "
    f"AND a.i <> b.i GROUP BY 1, 2 HAVING count(*) >= 3"
)
def op_corated_pearson(spark, sf):
    """Pearson correlation of items that three users or more rated both."""
    return R.item_similarity(
        stored(R.mean_ratings(_parts(spark, sf)[0])), kind="pearson", least=3
    ).withColumn("sim", F.round("sim", 5))


@query(
    "jn_corated_self",
    f"WITH {SPLIT}, r AS (SELECT user_id AS u, business_id AS i, avg(stars) AS r FROM train "
    f"GROUP BY 1, 2) SELECT a.i, b.i AS j, round(sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r))), "
    f"6) AS sim FROM r a JOIN r b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2"
)
def jn_corated_self(spark, sf):
    return R.item_similarity(stored(R.mean_ratings(_parts(spark, sf)[0]))).withColumn("sim", r6("sim"))


@query(
    "op_bias_mf",
    f"WITH {SPLIT}, g AS MATERIALIZED (SELECT avg(stars) AS m FROM train), bi AS MATERIALIZED (SELECT business_id, "
    f"sum(stars - m) / (count(*) + 10) AS bi FROM train CROSS JOIN g GROUP BY 1), bu AS MATERIALIZED (SELECT "
    f"user_id, sum(stars - m - bi) / (count(*) + 15) AS bu FROM train JOIN bi USING (business_id) "
    f"CROSS JOIN g GROUP BY 1) SELECT review_id, round(m + coalesce(bi, 0) + coalesce(bu, "
    f"0), 6) AS baseline FROM evald LEFT JOIN bi USING (business_id) LEFT JOIN bu USING (user_id) "
    f"CROSS JOIN g"
)
def op_bias_mf(spark, sf):
    """The bias part, which SQL can say; op_bias_mf_factors adds the factors."""
    train, _, test = _parts(spark, sf)
    return R.bias_means(train, test).select("review_id", r6("baseline").alias("baseline"))


@query("op_bias_mf_factors")
def op_bias_mf_factors(spark, sf):
    train, _, test = _parts(spark, sf)
    return R.bias_factors(train, test, *_ids(train), rank=8).select(
        "review_id", "fallback_kind", "baseline", "prediction"
    )


@query("op_mf_stream")
def op_mf_stream(spark, sf):
    """The factor network at the epoch with the least validation error, for the test part."""
    train, val, test = (rows.select(*RATED) for rows in _parts(spark, sf))
    return network_stream(train, val, test, epochs=4).select("review_id", "fallback_kind", "prediction")


@query("op_mf_stream_als")
def op_mf_stream_als(spark, sf):
    """ALS in the network's place: the settings with the least validation error, then the test part."""
    train, val, test = _parts(spark, sf)
    settings = [{"rank": 8, "reg": g} for g in (0.1, 0.3)]
    out, _, _ = R.als_selected(train, val, test, *_ids(train), settings, iterations=5)
    return out.select("review_id", "fallback_kind", "prediction")


#: Epochs of a fold's network at most; it ends before where epochs no longer lower the validation error.
EPOCHS = 20


@query("op_oof_predict")
def op_oof_predict(spark, sf):
    """Training rows predicted by factor networks of the other four folds; the epoch is chosen on the validation part."""
    train, val, _ = (rows.select(*RATED) for rows in _parts(spark, sf))
    out = R.out_of_fold(train, lambda fit, rows: network_stream(fit, val, rows, epochs=EPOCHS))
    return out.select("review_id", "fold", "fallback_kind", "prediction")


@query("op_oof_bias")
def op_oof_bias(spark, sf):
    train, _, _ = _parts(spark, sf)
    out, _ = R.bias_out_of_fold(train.select(*RATED), k=5)
    return out.select("review_id", "fold", F.col("baseline").alias("prediction"))


@query("op_negative_samples")
def op_negative_samples(spark, sf):
    train, _, test = _parts(spark, sf)
    return R.negative_samples(test, train, _ids(train)[1])


@query("ev_candidate_sampling")
def ev_candidate_sampling(spark, sf):
    """Ranking metrics over test positives and sampled unseen items, scored by bias means."""
    train, _, test = _parts(spark, sf)
    items = stored(I.dense_ids(train, "business_id"))
    pool = stored(R.candidate_pool(test.filter("stars >= 4"), train, items).select("user_id", "business_id", "label"))
    scored = stored(
        R.bias_means(train, pool).select(
            "user_id", "business_id", "label", F.col("baseline").alias("y_pred"), F.lit("bias").alias("model")
        )
    )
    return E.ranking_metrics(scored, scored.filter("label = 1"), by=["model"])


def _labelled(spark, sf):
    """Documents and their labels, quality standing for sentiment; crc32(id) mod 5 deals them out: 0 held out, 1 validation."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), F.col("quality").alias("sentiment_label"), (part == 0).alias("held_out"),
        (part == 1).alias("validation")
    ).dropna()
    return docs, stored(docs.join(labels, "review_id").filter("text IS NOT NULL"))


def _sentiment(spark, sf):
    docs, labelled = _labelled(spark, sf)
    fit, val = labelled.filter("NOT held_out AND NOT validation"), labelled.filter("validation")
    return docs, labelled, *R.sentiment_selected(fit, val, [0.001, 0.01, 0.1])


@query("op_sentiment_train")
def op_sentiment_train(spark, sf):
    """The training report: each regularisation with its log loss and accuracy on the validation rows, and which is kept."""
    _, _, _, report = _sentiment(spark, sf)
    return spark.createDataFrame(report, "reg double, val_log_loss double, val_accuracy double, n_val long, kept boolean")


@query("op_sentiment_score")
def op_sentiment_score(spark, sf):
    """All documents by the kept model, each distinct text once."""
    docs, _, model, _ = _sentiment(spark, sf)
    return as_scorer(model).score(docs).select("review_id", "sentiment_score")


@query("op_sentiment_eval")
def op_sentiment_eval(spark, sf):
    """Accuracy on labelled rows that were held out of the training, and on those that were not."""
    _, labelled, model, _ = _sentiment(spark, sf)
    return R.accuracy(as_scorer(model).score(labelled), ["held_out"])


@query(
    "op_sentiment_eval_given",
    f"WITH {SPLIT} SELECT business_id, round(avg(CAST((sentiment >= 0.5) = (stars >= 4) AS INTEGER)), 6) AS accuracy, "
    f"count(*) AS n FROM evald WHERE stars <> 3 GROUP BY 1"
)
def op_sentiment_eval_given(spark, sf):
    """Accuracy of given scores against the labels of the stars, per item."""
    _, _, test = _parts(spark, sf)
    rows = test.withColumn("sentiment_label", sentiment_label(F.col("stars"))).filter("sentiment_label IS NOT NULL")
    out = R.accuracy(rows.withColumnRenamed("sentiment", "sentiment_score"), ["business_id"])
    return out.withColumn("accuracy", r6("accuracy"))


def content_parts(spark, sf, train):
    """What the content stream reads of train: profile, category and term tables."""
    profile = stored(P.item_profile(train, train))
    counts = stored(item_term_counts(spark, sf, train))
    categories = stored(item_categories(spark, sf).join(profile.select("business_id"), "business_id", "left_semi"))
    return {"profile": profile, "counts": counts, "categories": categories}


NUMBERS = ["avg_rating", "review_count", "sentiment_agg"]


def content_clusters(parts, dimensions=8, ks=range(2, 6)):
    """Fitted features, items' reduced vectors with their cluster, and the centroids."""
    features = T.ItemFeatures(top=100, dimensions=dimensions).fit(
        parts["counts"], parts["categories"], parts["profile"], NUMBERS
    )
    items = features.shortened(features.fitted)
    columns = [f"r{j}" for j in range(features.k)]
    vectors = stored(items.withColumn("features", array_to_vector(F.array(*columns))))
    model, _, _ = T.best_clusters(vectors, ks)
    assigned = stored(model.transform(vectors).select("business_id", "cluster", *columns))
    return features, assigned, T.cluster_centroids(assigned, columns)


def content_predictions(train, rows, parts, **settings):
    _, assigned, _ = content_clusters(parts, **settings)
    clusters = assigned.select("business_id", "cluster")
    rated = stored(train.select("user_id", "business_id", "stars").join(clusters, "business_id"))
    glob = train.agg(F.avg("stars").alias("global_avg"))
    return P.cbf_predict(
        rows.crossJoin(F.broadcast(glob)), clusters, P.user_cluster_preference(rated),
        P.cluster_mean(rated).select("cluster", "cluster_avg")
    )


def leave_one_out_clusters(spark, sf, train, parts, **settings):
    """Rows of train with ``cluster``, their item's, and ``near``, the centroid nearest to its vector without the review.

    A review goes to its item once; all that is asked of the item meets it there.
    """
    features, assigned, centroids = content_clusters(parts, **settings)
    columns = [f"r{j}" for j in range(features.k)]
    # Means and counts of the others are of all of train.
    rows = train.select("review_id", "user_id", "business_id", "date", "l_orderkey", "stars", "sentiment")
    loo = own_terms(spark, sf, P.leave_one_out(rows, ["stars", "sentiment"])).join(
        assigned.select("business_id", "cluster"), "business_id"
    ).select(
        "review_id", "user_id", "business_id", "stars", F.col("cluster").alias("own"),
        F.col("stars_history").alias("avg_rating"), F.col("sentiment_history").alias("sentiment_agg"),
        F.col("n_others").alias("review_count"), "words"
    )
    near = P.with_nearest(features.without_own(parts["counts"], parts["categories"], loo), centroids, columns)
    return near.select(
        "review_id", "user_id", "business_id", "stars", F.col("cluster").alias("near"), F.col("own").alias("cluster")
    )


@query("op_cbf_predict_loo")
def op_cbf_predict_loo(spark, sf):
    """Content predictions of train rows, each by its item's features without the row's own text, stars and sentiment."""
    train, _, _ = _parts(spark, sf)
    rated = stored(leave_one_out_clusters(spark, sf, train, content_parts(spark, sf, train)))
    out = P.cbf_predict_placed(
        rated, P.user_cluster_preference(rated), P.cluster_mean(rated).select("cluster", "cluster_avg")
    )
    return out.select("review_id", "reassigned", "fallback_kind", "prediction")


def _item_vectors(spark, sf):
    """Dense vectors of categories, term weights and numbers of all items of the training part."""
    train, _, _ = _parts(spark, sf)
    parts = content_parts(spark, sf, train)
    given = parts["counts"], parts["categories"], parts["profile"]
    return stored(T.ItemFeatures(top=100).prepare(*given, NUMBERS).vectors(*given))


@query("op_item_features")
def op_item_features(spark, sf):
    """Categories, text and numbers, sentiment among them, fitted and reduced."""
    train, _, _ = _parts(spark, sf)
    parts = content_parts(spark, sf, train)
    features = T.ItemFeatures(top=100, dimensions=8).fit(
        parts["counts"], parts["categories"], parts["profile"], NUMBERS
    )
    return features.shortened(features.fitted)


@query("op_pca")
def op_pca(spark, sf):
    vectors = _item_vectors(spark, sf)
    reduced = T.pca(vectors, 50).transform(vectors)
    return reduced.select("business_id", vector_to_array("reduced").alias("reduced"))


@query("op_cluster_kmeans")
def op_cluster_kmeans(spark, sf):
    vectors = _item_vectors(spark, sf)
    model, _, _ = T.best_clusters(vectors)
    return model.transform(vectors).select("business_id", "cluster")


@query("op_tree_fusion")
def op_tree_fusion(spark, sf):
    """Bias stream, item history and sentiment history fused; fitted on train, predicted for test."""
    train, _, test = (rows.select(*RATED, "sentiment") for rows in _parts(spark, sf))
    features = ["stars_history", "sentiment_history", "baseline"]
    fit, rows = R.bias_out_of_fold(
        train, P.history_profile(train, test, ["stars", "sentiment"]), k=3,
        wide=P.leave_one_out(train, ["stars", "sentiment"])
    )
    fit, rows = stored(fit.select("stars", *features)), stored(rows.select("review_id", "stars", *features))
    return U.tree_fusion(fit, rows, features).select("review_id", "stars", "prediction")


@query("op_nmf")
def op_nmf(spark, sf):
    train, _, _ = _parts(spark, sf)
    rows = P.leave_one_out(train, ["stars", "sentiment"]).select(
        "review_id", "stars", "stars_history", "sentiment_history"
    )
    rows = stored(rows)
    return U.NonNegativeFactors(2).fit(
        rows, ["stars_history", "sentiment_history"]
    ).transform(rows).select("review_id", "latent_0", "latent_1")
