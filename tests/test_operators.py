"""Exact cases and invariants of the review engine's operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara import shared
from opinara.functions import columns as C
from opinara.operators import absa, content, evaluation, fusion, interactions, profiles, ratings, statistics

TRAIN = [("r1", "A", 0.2), ("r2", "A", 0.4), ("r3", "A", 0.6), ("r4", "B", 1.0), ("r5", "B", 0.0), ("r6", "C", 0.9)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "review_id string, business_id string, score double")


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_history_and_leave_one_out(spark, train):
    loo = by_key(profiles.leave_one_out(train, ["score"]), "review_id", "score_history")
    assert loo == pytest.approx({"r1": 0.5, "r2": 0.4, "r3": 0.3, "r4": 0.0, "r5": 1.0, "r6": 3.1 / 6})
    ev = spark.createDataFrame([("e1", "A"), ("e2", "B"), ("e3", "Z")], "review_id string, business_id string")
    assert by_key(profiles.history_profile(train, ev, ["score"]), "review_id", "score_history") == pytest.approx({"e1": 0.4, "e2": 0.5, "e3": 3.1 / 6})


def test_two_columns_stay_apart(spark):
    t = spark.createDataFrame([("1", "A", 0.2, 0.5), ("2", "A", 0.8, 0.5), ("3", "B", 1.0, 0.9), ("4", "B", 0.0, 0.1)], "review_id string, business_id string, a double, b double")
    out = {r["review_id"]: (r["a_history"], r["b_history"]) for r in profiles.leave_one_out(t, ["a", "b"]).collect()}
    assert out["1"] == pytest.approx((0.8, 0.5)) and out["3"] == pytest.approx((0.0, 0.1))


@pytest.mark.parametrize(("n", "sizes"), [(3, (2, 0, 1)), (5, (4, 0, 1)), (7, (6, 0, 1)), (8, (6, 1, 1)), (10, (8, 1, 1)), (25, (20, 2, 3))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lit("u").alias("user_id"), F.col("id").cast("string").alias("review_id"), F.expr("date_add(DATE'2020-01-01', CAST(id / 2 AS INT))").alias("date"))
    got = by_key(interactions.temporal_split(df).groupBy("split").count(), "split", "count")
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes


def test_small_users_are_cold(spark):
    df = spark.createDataFrame([("u", "1", "2020-01-01"), ("u", "2", "2020-01-02")], "user_id string, review_id string, date string").withColumn("date", F.to_date("date"))
    assert {r["split"] for r in interactions.temporal_split(df).collect()} == {"cold_start"}
    assert {r["split"] for r in interactions.temporal_split(df, hold_out_cold=False).collect()} == {"train"}
    with pytest.raises(ValueError):
        interactions.temporal_split(df, 0.9, 0.2)


def test_fit_dev_split(spark):
    df = spark.range(1000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), F.lit(1).alias("x"))
    one, two = ({r["review_id"] for r in interactions.fit_dev_split(df, 0.15, s).filter("part = 'dev'").collect()} for s in (1, 2))
    again = interactions.fit_dev_split(df, 0.15, 1)
    assert len(one) == 150 and one != two and {r["review_id"] for r in again.filter("part = 'dev'").collect()} == one
    assert again.count() == 1000 and set(df.columns) < set(again.columns)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_fit_dev_split_without_one_heap(spark):
    """The same rows as by a sort of all, and no task that takes them all."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("review_id")).repartition(7)
    for fraction in (0.0, 0.0004, 0.15, 1.0):
        n = int(3000 * fraction)
        want = {r[0] for r in df.orderBy(F.xxhash64("review_id", F.lit(42)), "review_id").limit(n).collect()}
        out = interactions.fit_dev_split(df, fraction)
        assert {r["review_id"] for r in out.filter("part = 'dev'").collect()} == want and out.count() == 3000
        assert "TakeOrdered" not in plan(out) and "Limit" not in plan(out)
    assert interactions.fit_dev_split(df.limit(0)).isEmpty()


def test_bucket_quantiles_without_one_buffer(spark):
    """The exact percentiles, ties, nulls and negative values among them, without their one buffer."""
    value = F.when(F.col("id") % 13 > 0, F.round(F.sin("id"), 3))
    df = spark.range(4000).select(F.when(F.col("id") < 3900, "51+").when(F.col("id") < 3901, "1-5").when(F.col("id") < 3913, "6-15").when(F.col("id") == 3913, "none").alias("bucket"), value.alias("shift")).repartition(7)
    out = content.bucket_quantiles(df, "shift", "bucket")
    want = df.groupBy("bucket").agg(F.count("shift"), F.avg("shift"), F.percentile("shift", F.lit(0.5)), F.percentile("shift", F.lit(0.9)))
    got = {r["bucket"]: list(r)[1:] for r in out.collect()}
    assert got.keys() == {r["bucket"] for r in want.collect()} and got["51+"][0] == 3600 and "percentile(" not in plan(out)
    for r in want.collect():
        assert got[r["bucket"]] == [x if x is None else pytest.approx(x, abs=1e-12) for x in list(r)[1:]]


def test_running_sample_takes_whole_users(spark):
    df = spark.range(1000).select((F.col("id") % 40).cast("string").alias("user_id"), F.col("id").alias("review_id"))
    out = interactions.running_sample(df, 300)
    assert 300 <= out.count() < 300 + 25 and out.groupBy("user_id").count().filter("count <> 25").isEmpty()


def test_kcore_is_a_fixpoint(spark):
    df = spark.range(3000).select((F.col("id") % 97).cast("string").alias("user_id"), (F.xxhash64("id") % 113).cast("string").alias("business_id"), F.col("id").alias("review_id"))
    out = interactions.kcore(df, 25, 20)
    assert out.groupBy("user_id").count().filter("count < 25").isEmpty() and out.groupBy("business_id").count().filter("count < 20").isEmpty()


def test_kcore_moves_triples_once_where_passes_drop_little(spark, monkeypatch):
    written = []
    monkeypatch.setattr(interactions, "stored", lambda df: (written.append(df.columns), shared.stored(df))[1])
    # A chain: each pass drops one more user and one more item.
    links = [(f"u{k}", f"i{k + d}") for k in range(12) for d in (0, 1)] + [(f"v{a}", f"j{b}") for a in range(3) for b in range(3)]
    df = spark.createDataFrame([(u, i, f"{u}-{i}") for u, i in links], "user_id string, business_id string, review_id string")
    out = {r["review_id"] for r in interactions.kcore(df, 2, 2).collect()}
    assert out == {f"v{a}-j{b}" for a in range(3) for b in range(3)}
    assert written.count(["u", "i", "n"]) == 1 and len(written) > 8
    assert {r["review_id"] for r in interactions.kcore(df, 2, 2, dropped=0).collect()} == out


def test_key_disambiguation(spark):
    df = spark.createDataFrame([("u", "i", 5, 1), ("u", "i", 5, 2), ("u", "i", 5, 3)], "u string, i string, ts int, o int")
    assert [r["review_id"] for r in interactions.disambiguate(df, ["u", "i", "ts"], ["o"]).orderBy("o").collect()] == ["u::i::5", "u::i::5::2", "u::i::5::3"]


def test_schema_checks(spark, train):
    with pytest.raises(ValueError, match="stars"):
        interactions.require_columns(train)
    status = by_key(interactions.schema_report(train), "column", "status")
    assert status["stars"] == "missing" and status["review_id"] == "present" and status["score"] == "extra"
    assert "business_city" in interactions.optional_columns(train).columns


def test_clean_drops_by_reason(spark):
    df = spark.createDataFrame([("a", "u", "i", "3"), ("\t\n", "u", "i", "3"), (None, "u", "i", "3"), ("a", None, "i", "3"), ("a", "u", "i", "x"), ("a", "u", "i", "6")], "text string, user_id string, business_id string, stars string")
    assert interactions.basic_clean(df).count() == 1
    assert by_key(interactions.count_rejects(df, interactions.reject_reason()), "reason", "rows") == {"no_text": 2, "no_user": 1, "bad_rating": 2}


def test_labels_and_confidence(spark):
    df = spark.createDataFrame([(1.0, 0.9, 2), (3.0, 0.5, 0), (5.0, 0.1, 9)], "stars double, s double, n int")
    assert [r[0] for r in df.select(C.sentiment_label(F.col("stars"))).collect()] == [0, None, 1]
    c = [r[0] for r in df.select(C.confidence(F.col("s"), F.col("n"))).collect()]
    assert c == pytest.approx([(0.8 + 2 / 3) / 2, 0.0, 0.9])
    assert df.select(C.confidence(F.col("s"), F.col("n"), 0.05)).collect()[1][0] == 0.05
    with pytest.raises(Exception, match="no label"):
        df.select(C.sentiment_label(F.col("stars"), strict=True)).collect()


def test_content_formula(spark):
    rows = spark.createDataFrame([("r1", "u1", "a"), ("r2", "u2", "b"), ("r3", "u3", "c"), ("r4", "u1", "z")], "review_id string, user_id string, business_id string").withColumn("global_avg", F.lit(3.3))
    clusters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "business_id string, cluster int")
    pref = spark.createDataFrame([("u1", 0, 0.5), ("u2", 1, 1.0)], "user_id string, cluster int, preference double")
    means = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 3.2)], "cluster int, cluster_avg double")
    out = {r["review_id"]: (r["prediction"], r["fallback_kind"]) for r in profiles.cbf_predict(rows, clusters, pref, means).collect()}
    assert out == {"r1": (4.0, "none"), "r2": (5.0, "none"), "r3": (3.2, "no_preference"), "r4": (3.3, "unknown_item")}


def test_ranking_counts_relevant_items_without_a_score_and_meets_once(spark):
    scored = spark.createDataFrame([("m", "u", "a", 0.9), ("m", "u", "b", 0.5), ("m", "v", "a", 0.1)], "model string, user_id string, business_id string, y_pred double")
    relevant = spark.createDataFrame([("m", "u", "b"), ("m", "u", "z"), ("m", "w", "a")], "model string, user_id string, business_id string")
    out = evaluation.ranking_metrics(scored, relevant, (2,), ["model"])
    r = out.first()
    assert (r["precision"], r["recall"], r["users"]) == pytest.approx((0.25, 0.25, 2))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_ranking(spark):
    scored = spark.createDataFrame([("u", "a", 0.9), ("u", "b", 0.8), ("u", "a", 0.7), ("u", "c", 0.6)], "user_id string, business_id string, y_pred double").withColumn("model", F.lit("m"))
    rel = spark.createDataFrame([("m", "u", "a"), ("m", "u", "c")], "model string, user_id string, business_id string")
    r = evaluation.ranking_metrics(scored, rel, (2,), ["model"]).first()
    assert (r["precision"], r["recall"], r["ndcg"]) == pytest.approx((0.5, 0.5, 1 / (1 + 1 / math.log2(3))))


def test_fisher_and_sanity(spark):
    p = spark.createDataFrame([("x", 0.01), ("x", 0.2), ("x", 0.03)], "g string, p double")
    assert statistics.fisher(p, ["g"]).first()["p_combined"] == pytest.approx(0.003478302, abs=1e-8)
    m = spark.createDataFrame([(0.015,), (0.85,), (2.5,)], "rmse double")
    assert [r["verdict"] for r in evaluation.rmse_sanity(m).orderBy("rmse").collect()] == ["suspicious_low", "ok", "suspicious_high"]


def test_t_tail():
    assert statistics.t_two_sided(0.0, 5) == 1.0
    assert statistics.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert statistics.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)


def test_wilcoxon_against_brute_force(spark):
    d = [0.3, -0.1, 0.1, 0.0, -0.7, 0.3, 0.2]
    pairs = spark.createDataFrame([("b", "d", 1, str(i), x) for i, x in enumerate(d)], "model_b string, domain string, seed int, review_id string, d double")
    sizes = sorted(abs(x) for x in d if x)
    rank = {s: (sizes.index(s) + 1 + len(sizes) - sizes[::-1].index(s)) / 2 for s in sizes}
    r = statistics.wilcoxon(pairs).first()
    assert (r["w_plus"], r["w_minus"]) == (sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    assert 0 < r["p"] <= 1


def test_aspects(spark):
    df = spark.createDataFrame([("1", "Great food. The room was priceless! Bad food."), ("2", "Nothing here."), ("3", None)], "review_id string, text string")
    lex = {"food": ["food"], "price": ["price"]}
    score = lambda t: F.when(F.contains(t, F.lit("Bad")), 0.2).otherwise(0.8)
    s = absa.long_scores(df, lex, score)
    assert by_key(absa.mean_score(s), "review_id", "sentiment_score") == pytest.approx({"1": 0.5, "2": 0.8, "3": 0.8})
    wide = {r["review_id"]: (r["food"], r["price"]) for r in absa.per_aspect(s, lex).collect()}
    assert wide["1"] == (0.2, 0.8) and wide["2"] == (0.8, 0.8)
    assert {r["review_id"]: (r["food"], r["price"]) for r in absa.evidence_counts(df, lex).collect()}["1"] == (2, 1)
    with pytest.raises(ValueError):
        absa.lexicon_of({"hotel": lex}, "garden")


def test_out_of_fold_leaks_nothing(spark):
    df = spark.range(80).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), (F.col("id") % 15).cast("string").alias("user_id"), (F.col("id") % 10).cast("string").alias("business_id"), (1 + F.col("id") % 5).cast("double").alias("stars"))
    run = lambda d: by_key(ratings.out_of_fold(d, ratings.bias_means, 3), "review_id", "baseline")
    one, two = run(df), run(df.withColumn("stars", F.when(F.col("review_id") == "r7", 5.0 - F.col("stars")).otherwise(F.col("stars"))))
    assert len(one) == 80 and one["r7"] == pytest.approx(two["r7"]) and one != two


def test_negatives_are_unseen(spark):
    seen = spark.createDataFrame([("u1", "0"), ("u1", "1"), ("u2", "2")], "user_id string, business_id string")
    items = spark.range(30).select(F.col("id").cast("string").alias("business_id"), "id")
    pos = spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "review_id string, user_id string")
    out = ratings.negative_samples(pos, seen, items, 4)
    assert out.count() == 8 and out.join(seen, ["user_id", "business_id"]).isEmpty()


def test_factors_and_tree(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 20).cast("double").alias("a"), ((F.col("id") % 20) * 2 - 3).cast("double").alias("b"), (1 + (F.col("id") % 20) / 5).alias("stars"))
    out = fusion.tree_fusion(df, df, ["a", "b"], k=2)
    r = out.agg(F.min("prediction"), F.max("prediction"), F.avg(F.abs(F.col("prediction") - F.col("stars")))).first()
    assert r[0] >= 1 and r[1] <= 5 and r[2] < 0.2
    low = fusion.NonNegativeFactors(2).fit(df, ["a", "b"]).transform(df.withColumn("a", F.lit(-9.0))).agg(F.min("latent_0")).first()[0]
    assert low >= 0


def test_als_falls_back(spark):
    t = spark.range(60).select((F.col("id") % 6).cast("string").alias("user_id"), (F.col("id") % 10).cast("string").alias("business_id"), (1 + F.col("id") % 5).cast("double").alias("stars"))
    rows = spark.createDataFrame([("1", "2"), ("nobody", "2")], "user_id string, business_id string")
    out = {r["user_id"]: (r["fallback_kind"], r["prediction"]) for r in ratings.als_stream(t, rows, interactions.dense_ids(t, "user_id"), interactions.dense_ids(t, "business_id"), fallback="midpoint").collect()}
    assert out["nobody"] == ("midpoint", 3.0) and out["1"][0] == "none"


def test_als_candidates_are_fitted_once(spark, monkeypatch):
    t = spark.range(60).select((F.col("id") % 6).cast("string").alias("user_id"), (F.col("id") % 10).cast("string").alias("business_id"), (1 + F.col("id") % 5).cast("double").alias("stars"))
    fits, als = [], ratings.ALS
    monkeypatch.setattr(ratings, "ALS", lambda **k: fits.append(k["regParam"]) or als(**k))
    ids = [interactions.dense_ids(t, c) for c in ("user_id", "business_id")]
    assert ratings.als_selected(t, t, t, *ids, [{"reg": 5.0}, {"reg": 0.01}], rank=2, iterations=1)[0].count() == 60
    assert fits == [5.0, 0.01]


def test_silhouette_selection(spark):
    from pyspark.ml.linalg import Vectors

    pts = spark.createDataFrame([(i, Vectors.dense([float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3)])) for i in range(90)], ["id", "features"])
    _, k, value = content.best_clusters(pts, range(2, 6))
    assert k == 3 and value > 0.9


def test_leave_one_out_terms(spark):
    df = spark.createDataFrame([("a", "x", "battery screen"), ("b", "x", "delicious spicy"), ("c", "y", "battery battery")], "review_id string, business_id string, bag string")
    out = {r["review_id"]: r["shift"] for r in content.leakage_shift(df, "bag").collect()}
    assert set(out) == {"a", "b"} and all(0 < v < 1 for v in out.values())


def test_whole_queries_read_all_rows(spark, sf):
    """No order, part or event is left out, and the profile counts all training reviews."""
    import __spark_entry__ as entry
    from opinara.plans.interaction_queries import _parts

    run = lambda name: entry.queries()[name](spark, sf)
    assert run("agg_item_profile").agg(F.sum("review_count")).first()[0] == _parts(spark, sf)[0].count()
    assert run("fn_p_display").count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert run("jn_enrich_left").filter("p_brand IS NULL").isEmpty()


def small_reviews(spark):
    """Reviews of four items, one of them with a single review, with texts, categories and scores."""
    rows = [("r1", "x", "battery battery screen", 5.0, 0.9), ("r2", "x", "spicy delicious", 1.0, 0.1), ("r3", "x", "screen fine", 4.0, 0.6), ("r4", "y", "spicy spicy soup", 2.0, 0.3), ("r5", "y", "soup fine", 3.0, 0.4), ("r6", "z", "lonely words only", 4.0, 0.8), ("r7", "w", "battery fine", 5.0, 0.7), ("r8", "w", "battery charger", 4.0, 0.5)]
    df = spark.createDataFrame(rows, "review_id string, business_id string, bag string, stars double, sentiment double").repartition(3)
    cats = spark.createDataFrame([("x", "phone"), ("w", "phone"), ("y", "food"), ("z", "food"), ("z", "odd")], "business_id string, category string")
    return df, cats


def test_leave_one_out_features_against_rebuilt_texts(spark):
    """The vector of an item without a review is what the fitted features make of the other reviews' joined texts."""
    df, cats = small_reviews(spark)
    own = content.term_counts(df, "review_id", "bag").join(df.select("review_id", "business_id"), "review_id")
    counts = own.groupBy("business_id", "term").agg(F.sum("tf").alias("tf"))
    profile = profiles.item_profile(df, df)
    numbers = ["avg_rating", "review_count", "sentiment_agg"]
    features = content.ItemFeatures(top=8, dimensions=3).fit(counts, cats, profile, numbers)
    loo = profiles.leave_one_out(df, ["stars", "sentiment"]).select("review_id", "business_id", F.col("stars_history").alias("avg_rating"), F.col("sentiment_history").alias("sentiment_agg"), F.col("n_others").alias("review_count"))
    got = {r["review_id"]: list(r)[1:] for r in features.transform_without_own(counts, cats, loo, own).collect()}
    means = df.agg(F.avg("stars"), F.avg("sentiment")).first()
    for r in df.collect():
        others = df.filter((F.col("business_id") == r["business_id"]) & (F.col("review_id") != r["review_id"]))
        rest = content.term_counts(others, "business_id", "bag")
        n = others.count()
        s = others.agg(F.avg("stars"), F.avg("sentiment")).first() if n else means
        one = spark.createDataFrame([(r["business_id"], n, s[0], s[1])], "business_id string, review_count bigint, avg_rating double, sentiment_agg double")
        want = list(features.transform(rest, cats.filter(F.col("business_id") == r["business_id"]), one).first())[1:]
        assert got[r["review_id"]] == pytest.approx(want, abs=1e-9), r["review_id"]


def test_features_are_the_dense_vectors_reduced(spark):
    from pyspark.ml.functions import vector_to_array

    df, cats = small_reviews(spark)
    counts = content.term_counts(df, "business_id", "bag")
    profile = profiles.item_profile(df, df)
    for own in (cats, None):
        features = content.ItemFeatures(top=8, dimensions=3).fit(counts, own, profile, ["avg_rating", "review_count"])
        dense = features.vectors(counts, own, profile)
        want = {r[0]: list(r[1]) for r in content.pca(dense, 3).transform(dense).select("business_id", vector_to_array("reduced")).collect()}
        got = {r[0]: list(r)[1:] for r in features.transform(counts, own, profile).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_item_vectors_are_sparse_and_shortened_once(spark):
    counts = spark.createDataFrame([("A", "x", 3), ("A", "y", 4), ("B", "y", 1)], "business_id string, term string, tf long")
    cats = spark.createDataFrame([("B", f"c{k}") for k in range(30)], "business_id string, category string")
    profile = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "business_id string, avg_rating double")
    features = content.ItemFeatures(top=2, dimensions=2).fit(counts, cats, profile, ["avg_rating"])
    held = {r["business_id"]: r["features"] for r in features.fitted.collect()}
    x, y = features.idf["x"] * 3, features.idf["y"] * 4
    assert type(held["A"]).__name__ == "SparseVector" and held["A"].toArray()[:2] == pytest.approx(np.array([x, y]) / math.hypot(x, y))
    assert held["B"].toArray()[1:32] == pytest.approx(np.ones(31)) and held["C"].toArray()[:32].sum() == 0
    again = {r[0]: r[1:] for r in features.transform(counts, cats, profile).collect()}
    for r in features.shortened(features.fitted).collect():
        assert r[1:] == pytest.approx(again[r[0]])


def test_leave_one_out_moves_by_the_others_alone(spark):
    df, cats = small_reviews(spark)
    rated = df.withColumn("user_id", F.lit("u")).withColumn("cluster", F.lit(0))
    near = df.select("review_id", F.when(F.col("review_id") == "r1", 1).otherwise(0).alias("cluster"))
    pref = spark.createDataFrame([("u", 0, 1.0)], "user_id string, cluster int, preference double")
    means = spark.createDataFrame([(0, 3.0), (1, 2.0)], "cluster int, cluster_avg double")
    out = {r["review_id"]: (r["reassigned"], r["fallback_kind"], r["prediction"]) for r in profiles.cbf_predict_loo(rated, near, pref, means).collect()}
    assert out["r1"] == (True, "no_preference", 2.0) and out["r2"] == (False, "none", 4.5) and len(out) == 8
    assert profiles.reassigned_share(profiles.cbf_predict_loo(rated, near, pref, means)).first()["share"] == pytest.approx(1 / 8)


@pytest.mark.parametrize("kind", ["cosine", "pearson", "msd"])
@pytest.mark.parametrize("heavy", [512, 2])
def test_similarities_against_brute_force(spark, kind, heavy, monkeypatch):
    """All three, however the heavy users' items are dealt; wanted restricts one side."""
    import numpy as np

    monkeypatch.setattr(ratings, "HEAVY", heavy)
    rng = np.random.default_rng(4)
    rows = [(f"u{u}", f"i{i}", float(rng.integers(1, 6))) for u in range(8) for i in range(7) if rng.random() < 0.7]
    r = spark.createDataFrame(rows, "u string, i string, r double")
    by = {}
    for u, i, x in rows:
        by.setdefault(i, {})[u] = x
    want = {}
    for i in by:
        for j in by:
            both = sorted(by[i].keys() & by[j].keys())
            if i != j and both:
                x, y = np.array([by[i][u] for u in both]), np.array([by[j][u] for u in both])
                a, b = x - x.mean(), y - y.mean()
                bottom = np.sqrt((a * a).sum() * (b * b).sum())
                want[i, j] = {"cosine": (x @ y) / np.sqrt((x @ x) * (y @ y)), "pearson": (a @ b) / bottom if bottom > 1e-9 else 0.0, "msd": 1 / (((x - y) ** 2).mean() + 1)}[kind]
    got = {(s["i"], s["j"]): s["sim"] for s in ratings.item_similarity(r, kind=kind).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    some = spark.createDataFrame([("i1",), ("i2",)], "i string")
    assert {(s["i"], s["j"]) for s in ratings.item_similarity(r, some, kind).collect()} == {k for k in want if k[1] in ("i1", "i2")}


def planted(spark):
    return spark.range(600).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), (F.col("id") % 30).cast("string").alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(20)).cast("string").alias("business_id")).withColumn("stars", F.when((F.col("user_id").cast("int") % 2) == (F.col("business_id").cast("int") % 2), 5.0).otherwise(1.0))


def test_factors_see_what_biases_do_not(spark):
    rows = planted(spark).cache()
    train, test = rows.filter("crc32(review_id) % 6 <> 0"), rows.filter("crc32(review_id) % 6 = 0")
    users, items = interactions.dense_ids(train, "user_id"), interactions.dense_ids(train, "business_id")
    out = ratings.bias_factors(train, test.unionByName(test.limit(1).withColumn("user_id", F.lit("new"))), users, items, rank=2, reg=0.01)
    error = lambda c: out.filter("user_id <> 'new'").agg(F.sqrt(F.avg(F.pow(F.col(c) - F.col("stars"), 2)))).first()[0]
    assert error("prediction") < 0.6 < error("baseline")
    new = out.filter("user_id = 'new'").first()
    assert new["fallback_kind"] == "baseline" and new["prediction"] == pytest.approx(new["baseline"])


def test_settings_by_validation(spark):
    rows = planted(spark).cache()
    train, val = rows.filter("crc32(review_id) % 6 <> 0"), rows.filter("crc32(review_id) % 6 = 0")
    users, items = interactions.dense_ids(train, "user_id"), interactions.dense_ids(train, "business_id")
    _, best, error = ratings.als_selected(train, val, val, users, items, [{"reg": 5.0}, {"reg": 0.01}], rank=2)
    assert best == {"reg": 0.01} and error < 1


def test_profile_terms(spark):
    df, _ = small_reviews(spark)
    out = {(r["business_id"], r["term"]): r["tf"] for r in profiles.item_terms(df, content.term_counts(df, "review_id", "bag")).collect()}
    assert {t: n for (i, t), n in out.items() if i == "x"} == {"battery": 2, "screen": 2, "spicy": 1, "delicious": 1, "fine": 1}


def test_places(spark):
    df = spark.createDataFrame([("u", "2020-01-02", "b"), ("u", "2020-01-02", "a"), ("u", "2020-01-01", "c"), (None, "2020-01-01", "d"), ("u", None, "e")], "user_id string, date string, review_id string")
    out = interactions.user_places(df, count_into="n").collect()
    assert {r["review_id"]: (r["place"], r["n"]) for r in out} == {"c": (1, 3), "a": (2, 3), "b": (3, 3)}


def test_fisher_counts_vanishing_p(spark):
    p = spark.createDataFrame([("x", 0.0), ("x", 0.5), ("y", None)], "g string, p double")
    out = {r["g"]: (r["m"], r["p_combined"]) for r in statistics.fisher(p, ["g"]).collect()}
    assert out["x"][0] == 2 and 0 <= out["x"][1] < 1e-200


def test_negatives_do_not_depend_on_the_partitions(spark):
    seen = spark.createDataFrame([("u1", "0")], "user_id string, business_id string")
    items = spark.range(6).select(F.col("id").cast("string").alias("business_id"), "id")
    pos = spark.createDataFrame([(f"r{i}", "u1") for i in range(40)], "review_id string, user_id string")
    one, two = (sorted(map(tuple, ratings.negative_samples(pos.repartition(n), seen, items, 3).collect())) for n in (1, 7))
    assert one == two


def test_spelled_terms_keep_items_without_any(spark):
    counts = spark.createDataFrame([("a", "red", 2), ("a", "big", 10), ("b", "red", 1)], "business_id string, term string, tf long")
    items = spark.createDataFrame([("a",), ("b",), ("cold",), ("a",)], "business_id string")
    got = {tuple(r) for r in profiles.spelled_terms(counts, items).collect()}
    assert got == {("a", 2, 12, "big:10 red:2"), ("b", 1, 1, "red:1"), ("cold", 0, 0, "")}


def test_the_item_profile_query_keeps_items_without_training_reviews(spark, sf):
    import __spark_entry__ as entry
    from opinara.sources.sample_tables import interactions as reviews

    out = entry.queries()["agg_item_profile_terms"](spark, sf)
    assert out.columns == ["business_id", "n_terms", "n_words", "profile"]
    assert out.count() == reviews(spark, sf).select("business_id").distinct().count()


@pytest.mark.parametrize("kind", ["cosine", "pearson", "msd"])
@pytest.mark.parametrize("user_based", [False, True])
def test_neighbours_by_hand(spark, monkeypatch, kind, user_based):
    """Users of several pieces, items that a user rated twice and that a row asks for again, unknown users and items."""
    monkeypatch.setattr(ratings, "HEAVY", 4)
    monkeypatch.setattr(ratings, "PAIRS", 50)
    rng = np.random.default_rng(3)
    data = [(f"r{n}", f"u{rng.integers(12)}", f"i{rng.integers(15)}", float(rng.integers(1, 6))) for n in range(150)]
    asking = [(f"t{n}", f"u{rng.integers(13)}", f"i{rng.integers(16)}", 3.0) for n in range(60)]
    names = "review_id string, user_id string, business_id string, stars double"
    train, rows = spark.createDataFrame(data, names), spark.createDataFrame(asking, names)
    a, b = (2, 1) if user_based else (1, 2)
    held = {}
    for r in data:
        held.setdefault((r[a], r[b]), []).append(r[3])
    mean = {k: sum(v) / len(v) for k, v in held.items()}
    sims = {(s["i"], s["j"]): s["sim"] for s in ratings.item_similarity(ratings.mean_ratings(train, *(("business_id", "user_id") if user_based else ("user_id", "business_id"))), kind=kind).collect()}
    want = {}
    for r in asking:
        near = [(-round(sims[i, r[b]], 9), i, sims[i, r[b]], x) for (u, i), x in mean.items() if u == r[a] and sims.get((i, r[b]), 0) > 0]
        for rank, (_, i, sim, x) in enumerate(sorted(near)[:3], 1):
            want[r[0], rank] = (i, sim, x)
    got = {(r["review_id"], r["rank"]): (r["i"], r["sim"], r["r"]) for r in ratings.top_neighbours(train, rows, 3, kind=kind, user_based=user_based).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1:] == pytest.approx(want[k][1:]) for k in want)


def test_neighbour_search_sends_no_pairs(spark, tmp_path):
    """The shuffles before the search carry lists; no aggregation by pair is planned."""
    rows = planted(spark)
    plan = ratings.top_neighbours(rows, rows.limit(20), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "xy" not in plan


def test_pairs_of_corated_items_are_not_shuffled(spark):
    """The pair sums take their input as it is dealt, by the greater item."""
    plan = ratings.item_similarity(ratings.mean_ratings(planted(spark)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(j#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\((i#\d+, j|j#\d+, i)#", plan)


def test_bias_of_all_folds_goes_to_items_and_users_once(spark, monkeypatch):
    df = spark.range(90).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), F.when(F.col("id") != 5, (F.col("id") % 15).cast("string")).alias("user_id"), F.when(F.col("id") != 7, (F.col("id") % 11).cast("string")).alias("business_id"), F.when(F.col("id") % 13 != 4, 1.0 + F.col("id") % 5).alias("stars"))
    new = df.limit(20).unionByName(df.limit(1).withColumn("user_id", F.lit("new")).withColumn("review_id", F.lit("x")))
    writes, store = [], ratings.stored
    monkeypatch.setattr(ratings, "stored", lambda d, *a: writes.append(d) or store(d, *a))
    out, known = ratings.bias_out_of_fold(df, new, 3)
    assert len(writes) == 3
    for got, wanted in ((out, ratings.out_of_fold(df, ratings.bias_means, 3)), (known, ratings.bias_means(df, new))):
        got, wanted = by_key(got, "review_id", "baseline"), by_key(wanted, "review_id", "baseline")
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(v) for k, v in wanted.items())


def test_biases_and_numbers_meet_ratings_together(spark, monkeypatch):
    train = planted(spark).withColumn("user_id", F.when(F.col("review_id") != "r8", F.col("user_id"))).withColumn("business_id", F.when(F.col("review_id") != "r9", F.col("business_id")))
    users, items = interactions.dense_ids(train, "user_id"), interactions.dense_ids(train, "business_id")
    fitted, als = [], ratings.ALS

    class Seen:
        def __init__(self, **k):
            self.als = als(**k)

        def fit(self, df):
            fitted.append(df)
            return self.als.fit(df)

    monkeypatch.setattr(ratings, "ALS", Seen)
    out = by_key(ratings.bias_factors(train, train, users, items, rank=2), "review_id", "baseline")
    means = by_key(ratings.bias_means(train, train), "review_id", "baseline")
    assert out.keys() == means.keys() and all(v == pytest.approx(means[k]) for k, v in out.items())
    assert fitted[0].columns == ["_u", "_i", "residual"] and fitted[0].count() == 598
    named = train.join(users.withColumnRenamed("id", "_u"), "user_id").join(items.withColumnRenamed("id", "_i"), "business_id")
    wanted = sorted((r["_u"], r["_i"], round(r["stars"] - means[r["review_id"]], 9)) for r in named.collect())
    assert wanted == sorted((r[0], r[1], round(r[2], 9)) for r in fitted[0].collect())
