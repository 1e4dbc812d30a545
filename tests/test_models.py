"""Ward clusters, the factor network, the scorer hook, exact signed ranks and counts taken beside a write."""

import itertools
import re
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from opinara import shared
from opinara.operators import absa, content, fusion, hierarchy, interactions, keywords, network, profiles, ratings, scoring, statistics
from opinara.sources import readers, writers


def vectors(spark, x, parts=3):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts).select("id", array_to_vector("v").alias("features"))


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def ward_by_pairs(x, k):
    """Clusters by merging the closest pair by Ward's criterion, over all pairs, until k are left."""
    held = [[i] for i in range(len(x))]
    while len(held) > k:
        def cost(p, q):
            a, b = x[held[p]], x[held[q]]
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()

        p, q = min(itertools.combinations(range(len(held)), 2), key=lambda pq: cost(*pq))
        held[p] += held.pop(q)
    out = np.zeros(len(x), int)
    for c, members in enumerate(held):
        out[members] = c
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tables_have_wards_own_clusters(spark, seed):
    x = np.random.default_rng(seed).normal(0, 1, (60, 3))
    x = np.concatenate([x, x[:5]])
    df = vectors(spark, x)
    model = hierarchy.WardClusters().fit(df)
    assert len(model.centres) == 60 and model.n.sum() == 65
    near = {r["id"]: r["entry"] for r in model.nearest(df).collect()}
    for k in (2, 3, 7, 20):
        got = hierarchy.cut(model.merges, 60, k)
        assert same_partition([got[near[i]] for i in range(65)], list(ward_by_pairs(x, k)))


def test_many_rows_in_few_entries(spark):
    """Blobs of 3000 rows in 60 entries: every row falls to its own blob, and no task or driver sees more entries."""
    rng = np.random.default_rng(4)
    centre = np.array([[0, 0], [30, 0], [0, 30], [30, 30]])
    of = rng.integers(0, 4, 3000)
    df = vectors(spark, centre[of] + rng.normal(0, 1, (3000, 2)), 20)
    held = hierarchy.cluster_features(df, leaves=60).collect()
    assert 4 <= len(held) <= 60 and sum(r["n"] for r in held) == 3000
    whole = np.array([r["features"].toArray() for r in df.collect()])
    assert np.allclose(sum(np.array(r["total"]) for r in held), whole.sum(0))
    model = hierarchy.WardClusters(60).fit(df).choose(df, range(2, 8))
    got = {r["id"]: r["cluster"] for r in model.transform(df).collect()}
    assert model.k == 4 and same_partition([got[i] for i in range(3000)], list(of))


def test_clusters_need_no_table_of_pairs(spark):
    df = vectors(spark, np.random.default_rng(1).normal(0, 1, (30, 2)))
    plan = hierarchy.WardClusters().fit(df).transform(df, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_clusters_of_equal_and_null_vectors(spark):
    df = vectors(spark, [[1.0, 2.0]] * 9)
    df = df.unionByName(df.limit(1).select(F.lit(99).cast("long").alias("id"), F.when(F.col("id") < 0, F.col("features")).alias("features")))
    model = hierarchy.WardClusters().fit(df).choose(df)
    got = {r["id"]: r["cluster"] for r in model.transform(df).collect()}
    assert model.k == 1 and model.silhouette is None and got[99] is None and set(got.values()) == {0, None}
    assert content.best_clusters(vectors(spark, [[1.0, 2.0]] * 9))[1:] == (1, None)
    with pytest.raises(ValueError):
        content.pca(df.limit(0), 3)


def planted(spark, seed=3, users=60, items=50):
    """Ratings that users' and items' means know nothing of: who likes what is a matter of two groups each."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        for i in rng.choice(items, 25, replace=False):
            liked = (u % 2 == 0) == (i % 2 == 0)
            rows.append((f"r{u}_{i}", f"u{u}", f"i{i}", float(np.clip(round(4.3 if liked else 1.7) + rng.integers(-1, 2) * 0.5, 1, 5))))
    df = spark.createDataFrame(rows, "review_id string, user_id string, business_id string, stars double")
    part = F.pmod(F.crc32(F.col("review_id").cast("binary")), F.lit(10))
    return df.filter(part > 1), df.filter(part == 1), df.filter(part == 0)


def rmse(df, column="prediction"):
    return df.agg(F.sqrt(F.avg(F.pow(F.col(column) - F.col("stars"), 2)))).first()[0]


def test_network_sees_what_biases_do_not(spark):
    train, val, test = planted(spark)
    model = network.FactorNetwork(epochs=8, blocks=3, rate=0.15).fit(train, val)
    assert model.errors[model.best] == min(model.errors)
    assert rmse(model.predict(test)) < 0.7 < rmse(ratings.bias_means(train, test), "baseline")


def test_network_falls_back_and_repeats(spark):
    train, val, test = planted(spark, users=12, items=30)
    rows = test.limit(3).unionByName(spark.createDataFrame([("x", "nobody", "i1", 4.0)], test.schema))
    run = lambda: sorted(map(tuple, network.network_stream(train, val, rows, epochs=2, blocks=2).collect()))
    one, two = run(), run()
    assert [r[:4] + r[5:] for r in one] == [r[:4] + r[5:] for r in two]
    assert np.allclose([r[4] for r in one], [r[4] for r in two])
    cold = [r for r in one if r[1] == "nobody"][0]
    assert cold[5] == "train_mean" and cold[4] == pytest.approx(train.agg(F.avg("stars")).first()[0])


def test_tasks_hold_blocks_of_factors(spark):
    """In each round a task's factors are of one block of users and one of items, and no block is in two tasks."""
    train, val, _ = planted(spark, users=20, items=30)
    model = network.FactorNetwork(blocks=4)
    model.mean = 3.0
    rated = train.select("user_id", "business_id", (F.col("stars") - 3.0).alias("r"), model._block("user_id").alias("ub"), model._block("business_id").alias("ib"))
    first = model._first(rated)
    head = network.Head.new(model.d, model.h, 1)
    for shift in range(4):
        out = model._round(rated, first, head, shift, 1)
        assert out.filter("side = 'h'").agg(F.sum("rows")).first()[0] == rated.filter(F.pmod(F.col("ib") - F.col("ub"), F.lit(4)) == shift).count()
        assert out.filter("side <> 'h'").count() == first.count()


def test_network_cuts_larger_ratings_into_more_blocks(spark, monkeypatch):
    """A cell has some CELL ratings at any size, and how its numbers are packed changes nothing."""
    train, val, test = planted(spark, users=20, items=30)
    run = lambda m: {r["review_id"]: r["prediction"] for r in m.predict(test).collect()}
    whole = network.FactorNetwork(epochs=1, blocks=2).fit(train, val)
    assert whole.blocks == 2
    one = run(whole)
    monkeypatch.setattr(network, "PIECE", 3)
    monkeypatch.setattr(network, "PART", 7)
    two = run(network.FactorNetwork(epochs=1, blocks=2).fit(train, val))
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v) for k, v in one.items())
    monkeypatch.setattr(network, "CELL", train.count() / 9)
    assert network.FactorNetwork(epochs=1, blocks=2).fit(train, val).blocks == 3


def test_folds_are_fitted_at_once(spark):
    import threading

    together = threading.Barrier(3)

    def fit(train, rows):
        together.wait(60)
        return rows.withColumn("prediction", F.lit(train.count()))

    df = spark.range(60).select(F.col("id").cast("string").alias("review_id"))
    got = ratings.out_of_fold(df, fit, 3).groupBy("fold", "prediction").count().collect()
    assert len(got) == 3 and all(r["prediction"] + r["count"] == 60 for r in got)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    head = network.Head.new(4, 3, 1)
    p, q, r = rng.normal(0, 1, (5, 5)), rng.normal(0, 1, (5, 5)), rng.normal(0, 1, 5)
    dp, dq, dh = head.gradients(p, q, head.predict(p, q) - r)
    loss = lambda: 0.5 * (head.predict(p, q) - r) ** 2
    for table, grad, mean in ((p, dp, False), (q, dq, False), (head.values, dh, True)):
        for at in np.ndindex(table.shape):
            old = table[at]
            table[at] = old + 1e-6
            up = loss()
            table[at] = old - 1e-6
            down = loss()
            table[at] = old
            got = (up - down) / 2e-6
            assert grad[at] == pytest.approx(got.mean() if mean else got.sum(), abs=1e-6)


def vowels():
    """A scorer without Spark: the share of vowels. The class is made here, so that workers get it whole."""

    class Vowels:
        def predict_proba(self, texts):
            return [[1 - s, s] for s in (sum(c in "aeiou" for c in t) / max(1, len(t)) for t in texts)]

    return Vowels


def scored_texts(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(["good food", "bad room", None, "good food", ""] * 8)], "review_id string, text string")


def test_scorers_of_all_kinds_go_through_one_hook(spark):
    df = scored_texts(spark)
    labelled = df.filter("text <> ''").withColumn("sentiment_label", F.contains("text", F.lit("good")).cast("int"))
    model, report = ratings.sentiment_selected(labelled, labelled, [0.01, 0.1])
    assert [r[-1] for r in report].count(True) == 1 and min(r[1] for r in report) == [r[1] for r in report if r[-1]][0]
    lexicon = {"food": ["food"], "room": ["room"]}
    for scorer in (model, vowels()(), scoring.ObjectScorer(vowels()), lambda t: F.lit(0.25)):
        whole = scoring.as_scorer(scorer).score(df)
        assert whole.columns == ["review_id", "text", "sentiment_score"] and whole.count() == 40
        wide = absa.per_aspect(absa.long_scores(df, lexicon, scorer), lexicon)
        got = {r["review_id"]: r["food"] for r in wide.collect()}
        want = {r["review_id"]: r["sentiment_score"] for r in whole.collect()}
        assert got == pytest.approx(want)
    direct = {r["review_id"]: r["sentiment_score"] for r in ratings.sentiment_score(model, df).collect()}
    assert direct == pytest.approx({r["review_id"]: r["sentiment_score"] for r in scoring.as_scorer(model).score(df).collect()})
    with pytest.raises(TypeError):
        scoring.as_scorer(3)


def test_each_distinct_text_is_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting(vowels()):
        def predict_proba(self, texts):
            seen.add(len(texts))
            return super().predict_proba(texts)

    out = scoring.ObjectScorer(Counting).score(scored_texts(spark))
    assert out.count() == 40 and out.filter("sentiment_score IS NULL").isEmpty() and seen.value == 3


def test_training_scores_and_accuracy(spark):
    df = scored_texts(spark).withColumn("sentiment_label", F.lit(1)).withColumn("sentiment_score", F.when(F.col("text").isNull(), 0.2).otherwise(0.5))
    got = {r["text"]: (r["accuracy"], r["n"]) for r in ratings.accuracy(df, ["text"]).collect()}
    assert got == {None: (0.0, 8), "good food": (1.0, 16), "bad room": (1.0, 8), "": (1.0, 8)}


def signed(spark, groups):
    rows = [(g, "d", 1, str(i), float(x)) for g, d in groups.items() for i, x in enumerate(d)]
    return spark.createDataFrame(rows, "model_b string, domain string, seed int, review_id string, d double")


def test_exact_wilcoxon_against_all_signs(spark):
    rng = np.random.default_rng(5)
    groups = {f"g{n}": rng.normal(0.4, 1, n) for n in (1, 2, 5, 9, 12)}
    got = {r["model_b"]: r for r in statistics.wilcoxon(signed(spark, groups)).collect()}
    for name, d in groups.items():
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        t = min(ranks[d > 0].sum(), ranks[d < 0].sum())
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(d))]
        assert got[name]["method"] == "exact"
        assert got[name]["p"] == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= t)), abs=1e-12)


def test_wilcoxon_reads_its_pairs_once(spark):
    """The test itself is planned on written counts alone; the pairs, which come of a join, are not read again."""
    plan = statistics.wilcoxon(signed(spark, {"a": [1.0, -2.0, 0.0]}).withColumn("d", F.col("d") + F.lit(0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_wilcoxon_is_normal_where_it_must_be(spark):
    rng = np.random.default_rng(6)
    groups = {"tied": [1.0, -1.0, 2.0], "zero": [0.0, 1.0, 2.0], "many": rng.normal(0, 1, 51), "fifty": rng.normal(0.2, 1, 50)}
    got = {r["model_b"]: r for r in statistics.wilcoxon(signed(spark, groups)).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"tied": "normal", "zero": "normal", "many": "normal", "fifty": "exact"}
    near = statistics.wilcoxon(signed(spark, {"fifty": groups["fifty"]}), exact=0).first()["p"]
    assert got["fifty"]["p"] == pytest.approx(near, abs=0.01)


def counted_by(df, seen, path):
    df.write.parquet(path)
    return seen.get


def test_cleaning_counts_beside_the_write(spark, tmp_path):
    rows = [("a", "u", "i", "4"), (None, "u", "i", "4"), (" \n", "u", "i", "4"), ("a", None, "i", "4"), ("a", "u", None, "4"), ("a", "u", "i", "9"), ("a", "u", "i", "x")]
    df = spark.createDataFrame(rows, "text string, user_id string, business_id string, stars string")
    seen = Observation("clean")
    out = interactions.basic_clean(df, seen=seen)
    assert counted_by(out, seen, f"{tmp_path}/a") == {"rows": 7, "kept": 1, "no_text": 2, "no_user": 1, "no_item": 1, "bad_rating": 2}
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1


def test_enrichment_counts_what_it_drops(spark, tmp_path):
    reviews = spark.createDataFrame([("1", "b1", "u1"), ("2", "b9", "u1"), ("3", "b1", "u9"), ("4", "b9", "u9"), ("5", None, "u1")], "review_id string, business_id string, user_id string")
    b = spark.createDataFrame([("b1", 3), ("b1", 4), ("b2", 1)], "business_id string, size int")
    u = spark.createDataFrame([("u1", "x")], "user_id string, name string")
    seen = Observation("enrich")
    out = readers.enrich_inner(reviews, b, u, seen)
    assert counted_by(out, seen, f"{tmp_path}/b") == {"rows": 5, "kept": 1, "no_business": 2, "no_user": 1, "neither": 1}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/b").select("review_id", "size", "name").collect()] == [("1", 4, "x")]
    assert sorted(out.columns) == sorted(readers.enrich_inner(reviews, b, u).columns)


def test_result_scan_counts_what_it_skips(spark, tmp_path):
    good = '{"model": "m", "domain": "d", "seed": 1, "rmse": 1.0, "mae": 0.5, "config": "{}"}'
    lines = [good, good[:30], "no json", good.replace('"rmse": 1.0, ', ""), "", good.replace('"d"', "null")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text("\n".join(lines))
    seen = Observation("scan")
    out = readers.scan_results(spark, f"file://{tmp_path}/log", "json", seen)
    assert counted_by(out, seen, f"{tmp_path}/c") == {"rows": 5, "kept": 1, "malformed": 2, "incomplete": 2}
    assert readers.scan_results(spark, f"file://{tmp_path}/log", "json").count() == 1


def test_stratified_subset_keeps_whole_users_above_the_thresholds(spark):
    df = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("review_id"), (F.col("id") % 97).cast("string").alias("user_id"), (F.col("id") * 7 % 41).cast("string").alias("business_id"), F.lit(3.0).alias("stars"))
    out = interactions.stratified_subset(df, 900, 5, 5, seed=3)
    assert 0 < out.count() < 3000
    for c in ("user_id", "business_id"):
        assert out.groupBy(c).count().agg(F.min("count")).first()[0] >= 5
    again = interactions.stratified_subset(df.repartition(7), 900, 5, 5, seed=3)
    assert {r[0] for r in out.select("review_id").collect()} == {r[0] for r in again.select("review_id").collect()}


def test_candidates_are_positives_and_unseen_items(spark):
    train, _, test = planted(spark, users=10, items=40)
    items = interactions.dense_ids(train.unionByName(test), "business_id")
    seen = train.unionByName(test)
    pool = ratings.candidate_pool(test, seen, items, per_positive=5, seed=1)
    assert pool.filter("label = 1").count() == test.count()
    drawn = pool.filter("label = 0")
    assert drawn.join(seen, ["user_id", "business_id"]).isEmpty()
    assert drawn.groupBy("review_id").count().agg(F.max("count")).first()[0] <= 5


@pytest.mark.parametrize("k", [1, 3, 9])
def test_least_squares_meet_the_optimality_conditions(k):
    rng = np.random.default_rng(k)
    for kind in range(4):
        h = rng.normal(0, 1, (k, 12))
        x = rng.normal(0, 1, (400, 12))
        if kind == 1:
            h[-1] = h[0]  # a singular gram
        if kind == 2:
            h, x = np.abs(h), np.abs(x)
        if kind == 3:
            x[:50] = 0
        w = fusion.weights(x, h)
        slope = (w @ h - x) @ h.T
        assert (w >= 0).all() and slope.min() > -1e-6 and np.abs(w * slope).max() < 1e-5


def test_least_squares_against_all_active_sets():
    rng = np.random.default_rng(8)
    h, x = rng.normal(0, 1, (3, 5)), rng.normal(0, 1, (40, 5))
    w = fusion.weights(x, h)
    for row, got in zip(x, w, strict=True):
        best = np.inf
        for own in itertools.product([False, True], repeat=3):
            own = np.array(own)
            c = np.zeros(3)
            if own.any():
                c[own] = np.linalg.lstsq(h[own].T, row, rcond=None)[0]
            if (c >= -1e-12).all():
                best = min(best, ((c @ h - row) ** 2).sum())
        assert ((got @ h - row) ** 2).sum() == pytest.approx(best)


def test_factors_stop_when_the_error_no_longer_falls(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 2)) @ rng.random((2, 5))
    df = spark.createDataFrame([[float(v) for v in r] for r in x], [f"c{j}" for j in range(5)]).repartition(3)
    nmf = fusion.NonNegativeFactors(2).fit(df, df.columns)
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(nmf.errors)) and len(nmf.errors) < 50
    assert nmf.errors[-1] < 0.03 * (x**2).sum() and (nmf.h >= 0).all()
    with pytest.raises(ValueError):
        fusion.NonNegativeFactors(2).fit(df.limit(0), df.columns)


STAGES = {"x": {"x1": {"x": 1}, "x3": {"x": 3}}, "y": {"y1": {"y": 1}, "y9": {"y": 9}}}


def distance(s):
    return abs(s.get("x", 0) - 3) + abs(s.get("y", 0) - 1)


def test_staged_search_resumes(spark, tmp_path):
    calls = []
    path = f"file://{tmp_path}/done"
    out = fusion.staged_search(spark, STAGES, lambda s: calls.append(dict(s)) or distance(s), path).collect()
    assert [(r["candidate"], r["accepted"]) for r in out] == [("x3", True), ("y1", True)] and len(calls) == 4
    again = fusion.staged_search(spark, STAGES, lambda s: calls.append(dict(s)), path).collect()
    assert again == out and len(calls) == 4
    alone = fusion.staged_search(spark, STAGES, distance, together=1).collect()
    assert alone == out


def test_candidates_of_a_stage_run_at_once(spark):
    both = threading.Barrier(2, timeout=60)

    def evaluate(s):
        both.wait()
        return float(spark.range(10).count()) + distance(s)

    assert [r["candidate"] for r in fusion.staged_search(spark, STAGES, evaluate).collect()] == ["x3", "y1"]


def test_a_broken_candidate_keeps_the_others(spark, tmp_path):
    """The stage's other candidate is logged; the next driver runs the broken one alone."""
    path, calls = f"file://{tmp_path}/log", []

    def broken(s):
        if s["x"] == 3:
            raise RuntimeError("no luck")
        return distance(s)

    with pytest.raises(RuntimeError):
        fusion.staged_search(spark, {"x": STAGES["x"]}, broken, path)
    (tmp_path / "log" / "half" / "_temporary").mkdir(parents=True)  # what a lost driver leaves
    (tmp_path / "log" / "half" / "_temporary" / "part-0.parquet").write_bytes(b"PAR1")
    out = fusion.staged_search(spark, {"x": STAGES["x"]}, lambda s: calls.append(s) or distance(s), path).collect()
    assert calls == [{"x": 3}] and [tuple(r) for r in out] == [("x", "x3", 1.0, True)]


def test_bucketed_scores_meet_reviews_without_an_exchange(spark):
    name, old = f"t{uuid.uuid4().hex}", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    calls = []

    def compute(rows):
        calls.append(rows.count())
        return rows.select("review_id", (F.col("n") * 2).alias("score"))

    try:
        reviews = writers.write_bucketed(spark.range(500).select(F.col("id").cast("string").alias("review_id"), F.col("id").alias("n")), f"{name}_r", buckets=4)
        writers.cached_in_table(reviews.filter("n < 200"), compute, f"{name}_s", buckets=4)
        out = writers.cached_in_table(reviews, compute, f"{name}_s", buckets=4)
        again = writers.cached_in_table(reviews, compute, f"{name}_s", buckets=4)
        assert calls == [200, 300] and again.filter("score = 2 * n").count() == 500
        out.collect()
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("r", "s"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def test_ten_thousand_keywords_in_one_pass(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(2, 7)))
    pairs = sorted({(f"a{rng.integers(0, 300)}", word()) for _ in range(10_000)} | {("a0", "Ab"), ("a1", "")})
    lexicon = spark.createDataFrame(pairs, "aspect string, keyword string")
    rows = [(str(i), ". ".join(" ".join(word() for _ in range(6)).capitalize() for _ in range(4)) if i else None) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id string, text string").repartition(3)
    want = {}
    for i, t in rows:
        for s in (t or "").split(". "):
            for a in {a for a, k in pairs if k and k.lower() in s.lower()}:
                want.setdefault((i, a), []).append(s)
    for block in (keywords.BLOCK, 4000):
        cut = df.select("review_id", F.split(F.coalesce("text", F.lit("")), r"\. ").alias("s"))
        got = keywords.sentence_aspects(cut, keywords.lexicon_table(lexicon), block=block).collect()
        assert {(r["review_id"], r["aspect"]): (r["text"], r["n_sentences"]) for r in got} == {k: (" ".join(v), len(v)) for k, v in want.items()}
    odd = spark.createDataFrame([("x", "abba"), ("x", "cede")], "aspect string, keyword string")
    held = {r["review_id"] for r in interactions.domain_filter(df, odd, "text").collect()}
    assert held == {i for i, t in rows if t and ("abba" in t.lower() or "cede" in t.lower())}


def test_lexicon_tables_by_domain(spark):
    df = spark.createDataFrame([("1", "Great food. The room was priceless! Bad food."), ("2", "Nothing here.")], "review_id string, text string")
    rows = spark.createDataFrame([("h", "food", "Food"), ("h", "price", "price"), ("g", "room", "room")], "domain string, aspect string, keyword string")
    plain = absa.matches(df, {"food": ["food"], "price": ["price"]}).collect()
    assert sorted(absa.matches(df, keywords.lexicon_table(rows, "h")).collect()) == sorted(plain)
    with pytest.raises(ValueError):
        keywords.lexicon_table(rows, "none")


def test_text_models_reach_the_tasks_after_an_observation(spark):
    """The session of an observation can't be sent; a model's training summary would take it along."""
    seen = Observation("before")
    df = scored_texts(spark)
    assert df.observe(seen, F.count(F.lit(1)).alias("n")).count() == 40 and seen.get["n"] == 40
    labelled = df.filter("text <> ''").withColumn("sentiment_label", F.contains("text", F.lit("good")).cast("int"))
    model, report = ratings.sentiment_selected(labelled, labelled, [0.01])
    assert report[0][3] == 24 and ratings.sentiment_score(model, df).count() == 40
    mine = ratings.sentiment_model(reg=0.01).fit(labelled)
    got = {r["review_id"]: r["sentiment_score"] for r in scoring.as_scorer(mine).score(df).collect()}
    assert got == pytest.approx({r["review_id"]: r["sentiment_score"] for r in ratings.sentiment_score(model, df).collect()})


def test_columns_that_share_places_are_solved_together(monkeypatch):
    rng = np.random.default_rng(3)
    x, h = np.maximum(rng.normal(0.5, 0.6, (3, 5000)), 0), rng.random((3, 3)) + 0.1
    alone, sizes = fusion.nnls(h @ h.T, x.T @ h.T), []
    solve = fusion.nnls
    monkeypatch.setattr(fusion, "nnls", lambda gram, target: sizes.append(len(target)) or solve(gram, target))
    assert np.allclose(fusion.column_weights(x, h), alone.T, atol=1e-9) and sum(sizes) < 500


def test_factors_pass_over_packed_rows(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 3).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    sizes, inner = [], fusion.NonNegativeFactors._rounds
    monkeypatch.setattr(fusion, "BLOCK", 150)

    def rounds(self, packed):
        sizes.extend(len(r["x"]) // 24 for r in packed.collect())
        inner(self, packed)

    monkeypatch.setattr(fusion.NonNegativeFactors, "_rounds", rounds)
    nmf = fusion.NonNegativeFactors(2).fit(df, df.columns)
    x = np.array([tuple(r) for r in df.collect()])
    rest = ((x - fusion.weights(x, nmf.h) @ nmf.h) ** 2).sum()
    assert max(sizes) == 150 and sum(sizes) == 1000 and len(sizes) <= 9 and rest == pytest.approx(nmf.errors[-1], rel=1e-3)


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.getPath()).glob("*/shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """F1 to F9: a step's shuffle files go with its write, also as threads write at once, and the session's setting stays."""
    before, was = shuffle_files(spark), spark.conf.get(shared.CLEANUP, None)
    df = spark.range(3000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count()
    with ThreadPoolExecutor(2) as pool:
        tables = list(pool.map(lambda _: shared.stored(df), range(2)))
    assert [t.agg(F.sum("count")).first()[0] for t in tables] == [3000, 3000]
    ends = time.time() + 20
    while len(shuffle_files(spark) - before) > 2 and time.time() < ends:  # two are of the sums just read
        time.sleep(0.2)
    assert len(shuffle_files(spark) - before) <= 2 and spark.conf.get(shared.CLEANUP, None) == was


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange hash")


def test_reviews_meet_their_item_once_for_the_nearest_centroid(spark):
    """a review's terms stay in its row, as does the choice of the centroid."""
    df = spark.range(60).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 7).cast("string").alias("business_id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 5), F.lit("all"), F.lit("all")).alias("bag"), (1.0 + F.col("id") % 5).alias("stars"))
    counts, numbers = content.term_counts(df, "business_id", "bag"), df.groupBy("business_id").agg(F.avg("stars").alias("stars"))
    features = content.ItemFeatures(top=6, dimensions=2).fit(counts, None, numbers, ["stars"])
    rows = df.withColumn("words", content.terms_of("bag")).drop("bag").cache()
    out = features.without_own(counts, None, rows)
    centres = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.1)], "cluster int, r0 double, r1 double")
    near = profiles.with_nearest(out, centres, ["r0", "r1"])
    assert exchanges(near) == exchanges(out) <= 3
    own = {r["review_id"]: (r["r0"], r["r1"]) for r in out.collect()}
    for r in near.collect():
        far = [sum((x - y) ** 2 for x, y in zip(own[r["review_id"]], c, strict=True)) ** 0.5 for c in ((0.0, 0.0), (0.5, 0.1))]
        assert r["distance"] == pytest.approx(min(far)) and r["cluster"] == far.index(min(far))


def test_als_rows_are_numbered_once_for_all_settings(spark, monkeypatch):
    """candidates read numbers, and every iteration ends in a checkpoint, which its shuffle files go with."""
    train, val, test = planted(spark, users=12, items=30)
    ids = [interactions.dense_ids(train, c) for c in ("user_id", "business_id")]
    calls, every, number, als = [], [], ratings.numbered, ratings.ALS
    monkeypatch.setattr(ratings, "numbered", lambda *a: calls.append(a) or number(*a))
    monkeypatch.setattr(ratings, "ALS", lambda **k: every.append(k["checkpointInterval"]) or als(**k))
    out, best, error = ratings.als_selected(train, val, test, *ids, [{"reg": g} for g in (5.0, 0.1, 0.3)], rank=2, iterations=2)
    assert len(calls) == 3 and every == [1, 1, 1]
    assert error == pytest.approx(rmse(ratings.als_stream(train, val, *ids, rank=2, iterations=2, **best)))
    assert rmse(out) == pytest.approx(rmse(ratings.als_stream(train, test, *ids, rank=2, iterations=2, **best)))


def test_the_grid_reads_one_split(spark, monkeypatch):
    """both searches of op_grid_search read the same written split."""
    from opinara.plans import source_queries

    train, val, _ = planted(spark, users=8, items=30)
    rows = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val"))).withColumn("l_orderkey", F.lit(1))
    splits, searched = [], []
    monkeypatch.setattr(source_queries, "split_interactions", lambda *a: splits.append(a) or rows)
    monkeypatch.setattr(source_queries, "content_parts", lambda *a: {})
    monkeypatch.setattr(source_queries.U, "staged_search", lambda s, stages, evaluate: searched.append((stages, evaluate)) or s.range(0))
    source_queries.op_grid_search(spark, "nowhere")
    assert len(splits) == 1 and [list(s) for s, _ in searched] == [["grid"], ["dimensions"]]
    stages, evaluate = searched[0]
    numbered = []
    monkeypatch.setattr(source_queries.R, "numbered", lambda *a: numbered.append(a))
    assert all(evaluate({**c, "iterations": 1}) > 0 for c in list(stages["grid"].values())[:2]) and not numbered


def test_packed_lists_hold_all_ids_and_ratings():
    """F6 to F8: steps of one to four bytes, a few values, up to 256 and more, lists of one and of odd numbers."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, top, n)) for top, n in ((2**31 - 1, 5), (90, 30), (20_000, 49), (5_000_000, 600), (9, 1), (2**31 - 1, 700), (300, 7))]
    values = [rng.choice([1.0, 2.0, 2.5, 5.0], len(x)) if len(x) < 40 else rng.normal(size=len(x)) if len(x) > 650 else rng.integers(0, 200, len(x)) / 3 for x in lists]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(lists)))), pa.array(lists, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["u", "ids", "xs"])
    packed = next(ratings._pack(iter([batch])))
    for part in (packed, packed.slice(2, 4), packed.slice(0, 0)):
        ids, xs, size = ratings._unpack(part)
        assert ids.tolist() == part.column("ids").flatten().to_pylist() and xs.tolist() == part.column("xs").flatten().to_pylist()
        assert size.tolist() == part.column("ids").value_lengths().to_pylist()
    assert sum(len(packed.column(c)[2].as_py()) for c in ("steps", "codes")) <= 49 * 3


@pytest.mark.parametrize("heavy", [512, 3])
def test_negatives_are_the_first_unseen_draws(spark, monkeypatch, heavy):
    """by hand from the draws, for users of one list and of several; a positive's draws are never rows of a shuffle."""
    monkeypatch.setattr(ratings, "HEAVY", heavy)
    rng = np.random.default_rng(2)
    seen = [(f"u{u}", f"i{i:02d}") for u in range(4) for i in rng.choice(25, 4 + 5 * u, replace=False)] + [("u1", "gone"), (None, "i03")]
    pos = spark.createDataFrame([(f"r{n}", f"u{n % 5}" if n != 7 else None) for n in range(30)], "review_id string, user_id string")
    items = spark.createDataFrame([(f"i{i:02d}", i) for i in range(25)], "business_id string, id long")
    draws = {r["review_id"]: r["d"] for r in pos.select("review_id", F.array(*[F.pmod(F.xxhash64("review_id", F.lit(k), F.lit(42)), F.lit(25)) for k in range(1, 15)]).alias("d")).collect()}
    want = set()
    for key, user in pos.collect():
        fresh = [f"i{d:02d}" for d in dict.fromkeys(draws[key]) if user is None or (user, f"i{d:02d}") not in seen]
        want |= {(key, user, i, 0) for i in fresh[:4]}
    table = spark.createDataFrame(seen, "user_id string, business_id string")
    out = ratings.negative_samples(pos, table, items, 4)
    got = [tuple(r) for r in out.select("review_id", "user_id", "business_id", "label").collect()]
    assert set(got) == want and len(got) == len(want)
    assert not re.search(r"hashpartitioning\(review_id#\d+, user_id#\d+, business_id", out._jdf.queryExecution().executedPlan().toString())


def test_the_folds_query_fits_five_whole_networks(spark, sf, monkeypatch):
    """five folds, twenty epochs at most; what a fold predicts is written, so the result has no shuffle of its own."""
    from opinara.plans import model_queries

    asked = []

    def stream(fit, val, rows, **settings):
        asked.append(settings)
        return rows.withColumn("prediction", F.lit(1.0)).withColumn("fallback_kind", F.lit("none")).repartition(3, "review_id")

    monkeypatch.setattr(model_queries, "network_stream", stream)
    out = model_queries.op_oof_predict(spark, sf)
    assert asked == [{"epochs": 20}] * 5 and exchanges(out) == 0
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == set(range(5))


def test_item_queries_try_all_numbers_and_keep_fifty_dimensions(spark, monkeypatch):
    """2 to 20 clusters are tried, so 9 planted ones are found; F12: 50 dimensions."""
    from opinara.plans import model_queries

    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(0, 20, (9, 60)), 12, axis=0) + rng.normal(0, 0.1, (108, 60))
    df = vectors(spark, x).withColumnRenamed("id", "business_id")
    monkeypatch.setattr(model_queries, "_item_vectors", lambda *a: df)
    assert model_queries.op_pca(spark, "nowhere").select(F.size("reduced")).first()[0] == 50
    tried, kmeans = [], content.KMeans
    monkeypatch.setattr(content, "KMeans", lambda **k: tried.append(k["k"]) or kmeans(**k))
    got = {r["business_id"]: r["cluster"] for r in model_queries.op_cluster_kmeans(spark, "nowhere").collect()}
    assert sorted(tried) == list(range(2, 21)) and len(set(got.values())) > 5
