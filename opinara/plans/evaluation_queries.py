"""Queries over predictions: errors, ranking, paired tests and comparison tables."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.columns import normalise
from ..operators import evaluation as E
from ..operators import statistics as S
from ..operators.fusion import best_candidate
from ..shared import shared_folder, stored
from ..sources import readers, writers
from ..sources.sample_tables import predictions
from ..sources.writers import prediction_rows
from .registry import METRICS, PREDICTED, query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query(
    "snk_predictions",
    f"WITH {PREDICTED} SELECT model, domain, seed, review_id, user_id, business_id, y_true, "
    f"round(y_pred, 6) AS y_pred, round(pow(y_true - y_pred, 2), 6) AS squared_error FROM preds"
)
def snk_predictions(spark, sf):
    return rounded(prediction_rows(predictions(spark, sf)), "y_pred", "squared_error")


@query(
    "agg_rmse_mae",
    f"WITH {METRICS} SELECT model, domain, seed, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n FROM metrics"
)
def agg_rmse_mae(spark, sf):
    return rounded(E.rmse_mae(predictions(spark, sf)), "rmse", "mae")


@query(
    "agg_rmse_sanity",
    f"WITH {METRICS} SELECT model, domain, seed, CASE WHEN rmse / 4 < 0.05 THEN 'suspicious_low' WHEN rmse "
    f"/ 4 > 0.5 THEN 'suspicious_high' ELSE 'ok' END AS verdict FROM metrics"
)
def agg_rmse_sanity(spark, sf):
    return E.rmse_sanity(E.rmse_mae(predictions(spark, sf))).select("model", "domain", "seed", "verdict")


@query(
    "agg_stream_diagnostics",
    f"WITH {PREDICTED} SELECT model AS stream, round(min(y_pred), 6) AS low, round(max(y_pred), "
    f"6) AS high, round(avg(y_pred), 6) AS mean, round(stddev_pop(y_pred), 6) AS std, count(DISTINCT round(y_pred, "
    f"6)) AS n_unique, count(*) AS n, stddev_pop(y_pred) < 1e-6 AS is_flat FROM (SELECT model, "
    f"round(y_pred, 6) AS y_pred FROM preds) GROUP BY 1"
)
def agg_stream_diagnostics(spark, sf):
    long = predictions(spark, sf).select(F.col("model").alias("stream"), r6("y_pred").alias("value"))
    return rounded(E.stream_diagnostics(long), "low", "high", "mean", "std")


@query(
    "agg_collapse_flag",
    f"WITH {PREDICTED} SELECT model, domain, seed, round(stddev_pop(y_pred), 6) AS std, "
    f"round(avg(y_pred), 6) AS mean, count(DISTINCT round(y_pred, 6)) AS n_unique, stddev_pop(y_pred) < 1e-3 "
    f"AS collapsed FROM (SELECT model, domain, seed, round(y_pred, 6) AS y_pred FROM preds) "
    f"GROUP BY 1, 2, 3"
)
def agg_collapse_flag(spark, sf):
    return rounded(E.collapse_flags(predictions(spark, sf).withColumn("y_pred", r6("y_pred"))), "std", "mean")


RANKED = PREDICTED + """,
best AS (SELECT model, domain, seed, user_id, business_id, max(round(y_pred, 9)) AS score FROM preds GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, domain, seed, user_id ORDER BY score DESC, business_id) AS rank FROM best),
rel AS (SELECT DISTINCT model, domain, seed, user_id, business_id FROM preds WHERE y_true >= 4),
sizes AS (SELECT model, domain, seed, user_id, count(*) AS n_rel FROM rel GROUP BY ALL),
hits AS (SELECT ranked.* FROM ranked JOIN rel USING (model, domain, seed, user_id, business_id)),
ks(k) AS (VALUES (5), (10), (20)),
each AS (SELECT s.model, s.domain, s.seed, s.user_id, s.n_rel, k, count(h.rank) AS n_hit, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= least(s.n_rel, k)) AS idcg
  FROM sizes s CROSS JOIN ks LEFT JOIN hits h ON h.model = s.model AND h.domain = s.domain AND h.seed = s.seed AND h.user_id = s.user_id AND h.rank <= k GROUP BY ALL)"""


@query(
    "ev_precision_recall_ndcg",
    f"WITH {RANKED} SELECT model, domain, seed, CAST(k AS INTEGER) AS k, round(avg(n_hit / k), "
    f"6) AS precision, round(avg(n_hit / n_rel), 6) AS recall, round(avg(dcg / idcg), 6) AS ndcg, "
    f"count(*) AS users FROM each GROUP BY ALL"
)
def ev_precision_recall_ndcg(spark, sf):
    p = stored(predictions(spark, sf).withColumn("y_pred", F.round("y_pred", 9)))
    return rounded(E.ranking_metrics(p, p.filter("y_true >= 4")), "precision", "recall", "ndcg")


@query(
    "win_rank_topk",
    f"WITH {RANKED} SELECT model, domain, seed, user_id, business_id, CAST(rank AS INTEGER) AS rank "
    f"FROM ranked WHERE rank <= 5"
)
def win_rank_topk(spark, sf):
    return E.ranked(predictions(spark, sf).withColumn("y_pred", F.round("y_pred", 9)), 5, E.RUN).drop("score")


MEANS = METRICS + (
    ", means AS (SELECT model, domain, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, "
    "avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, count(*) AS n_seeds FROM metrics "
    "GROUP BY 1, 2)"
)


def _means(spark, sf):
    return E.multi_seed(E.rmse_mae(predictions(spark, sf)), ["rmse", "mae"])


@query(
    "agg_multi_seed",
    f"WITH {MEANS} SELECT model, domain, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, "
    f"6) AS rmse_std, round(mae_mean, 6) AS mae_mean, round(mae_std, 6) AS mae_std, n_seeds "
    f"FROM means"
)
def agg_multi_seed(spark, sf):
    return rounded(_means(spark, sf), "rmse_mean", "rmse_std", "mae_mean", "mae_std")


@query(
    "agg_results_pivot",
    f"WITH {METRICS} SELECT model, round(avg(rmse) FILTER (WHERE domain = 'even'), 6) AS even, "
    f"round(avg(rmse) FILTER (WHERE domain = 'odd'), 6) AS odd FROM metrics GROUP BY 1"
)
def agg_results_pivot(spark, sf):
    return rounded(E.results_pivot(E.rmse_mae(predictions(spark, sf)), ["even", "odd"]), "even", "odd")


@query(
    "agg_stability",
    f"WITH {METRICS}, z AS (SELECT *, avg(rmse) OVER g AS m, stddev_samp(rmse) OVER g AS sd, "
    f"count(*) OVER g AS c FROM metrics WINDOW g AS (PARTITION BY model, domain)), f AS (SELECT *, "
    f"row_number() OVER (PARTITION BY model, domain ORDER BY round(abs(rmse - m), 9) DESC, "
    f"seed) AS far FROM z WHERE c = 5) SELECT model, domain, round(any_value(sd), 6) AS std, "
    f"max(seed) FILTER (WHERE far = 1) AS extreme_seed, round(stddev_samp(rmse) FILTER (WHERE far > 1), "
    f"6) AS std_without, round(any_value(sd) / stddev_samp(rmse) FILTER (WHERE far > 1), "
    f"4) AS reduction FROM f GROUP BY 1, 2"
)
def agg_stability(spark, sf):
    return rounded(
        E.stability(E.rmse_mae(predictions(spark, sf))).withColumn("reduction", F.round("reduction", 4)), "std",
        "std_without"
    )


@query(
    "ev_baseline_vs_best",
    f"WITH {MEANS} SELECT a.domain, round((a.rmse_mean - b.rmse_mean) / a.rmse_mean * 100, "
    f"6) AS rmse_reduction, round((a.mae_mean - b.mae_mean) / a.mae_mean * 100, 6) AS mae_reduction, "
    f"round(a.rmse_std / b.rmse_std, 4) AS std_ratio FROM means a JOIN means b USING (domain) "
    f"WHERE a.model = 'global' AND b.model = 'user'"
)
def ev_baseline_vs_best(spark, sf):
    return rounded(
        E.baseline_versus(_means(spark, sf), "global", "user").withColumn("std_ratio", F.round("std_ratio", 4)),
        "rmse_reduction", "mae_reduction"
    )


@query(
    "ev_hybrid_vs_cf",
    f"WITH {MEANS} SELECT a.domain, round((a.rmse_mean - b.rmse_mean) / a.rmse_mean * 100, "
    f"6) AS rmse_reduction, round((a.mae_mean - b.mae_mean) / a.mae_mean * 100, 6) AS mae_reduction "
    f"FROM means a JOIN means b USING (domain) WHERE a.model = 'item' AND b.model = 'user'"
)
def ev_hybrid_vs_cf(spark, sf):
    return rounded(
        E.baseline_versus(_means(spark, sf), "item", "user").drop("std_ratio"), "rmse_reduction", "mae_reduction"
    )


PAIRED = PREDICTED + (
    ", e AS MATERIALIZED (SELECT *, pow(y_true - y_pred, 2) AS e FROM preds), pairs AS MATERIALIZED (SELECT "
    "b.model AS model_b, domain, seed, review_id, a.e AS ea, b.e AS eb, a.e - b.e AS d "
    "FROM e b JOIN e a USING (domain, seed, review_id) WHERE a.model = 'global' AND b.model <> 'global')"
)
SIGNED = PAIRED + (
    ", nz AS (SELECT *, round(d, 9) AS r FROM pairs WHERE round(d, 9) <> 0), rk AS MATERIALIZED (SELECT *, "
    "count(*) OVER (PARTITION BY model_b, domain, seed, abs(r)) AS t, rank() OVER w + (count(*) OVER (PARTITION "
    "BY model_b, domain, seed, abs(r)) - 1) / 2.0 AS rank FROM nz WINDOW w AS (PARTITION BY model_b, "
    "domain, seed ORDER BY abs(r)))"
)


def _pairs(spark, sf):
    return S.paired(
        stored(predictions(spark, sf).select("model", "domain", "seed", "review_id", "y_true", "y_pred")), "global"
    )


@query("jn_paired_predictions", f"WITH {PAIRED} SELECT model_b, domain, seed, review_id, round(d, 6) AS d FROM pairs")
def jn_paired_predictions(spark, sf):
    return _pairs(spark, sf).select("model_b", "domain", "seed", "review_id", r6("d").alias("d"))


@query(
    "ev_wilcoxon",
    f"WITH {SIGNED} SELECT model_b, domain, seed, count(*) AS n, CAST(sum(rank) FILTER (WHERE r > 0) AS DOUBLE) "
    f"AS w_plus, CAST(sum(rank) FILTER (WHERE r < 0) AS DOUBLE) AS w_minus FROM rk GROUP BY 1, "
    f"2, 3"
)
def ev_wilcoxon(spark, sf):
    return S.wilcoxon(_pairs(spark, sf)).select(
        *S.GROUP, "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus")
    )


@query(
    "ev_wilcoxon_exact",
    f"""
    WITH RECURSIVE {PREDICTED},
    e AS (
      SELECT model, seed, user_id, review_id, (y_true - y_pred) * (y_true - y_pred) AS e FROM preds
    ),
    d AS (
      SELECT b.model AS model_b, b.user_id AS domain, b.seed, round(a.e - b.e, 9) AS r
      FROM e a JOIN e b USING (seed, review_id) WHERE a.model = 'global' AND b.model <> 'global'
    ),
    rk AS MATERIALIZED (
      SELECT *, rank() OVER (PARTITION BY model_b, domain, seed ORDER BY abs(r)) AS rank,
        count(*) OVER (PARTITION BY model_b, domain, seed, abs(r)) AS t FROM d
    ),
    sums AS (
      SELECT model_b, domain, seed, count(*) AS n,
        least(coalesce(sum(rank) FILTER (r > 0), 0), coalesce(sum(rank) FILTER (r < 0), 0))::BIGINT AS statistic
      FROM rk GROUP BY ALL HAVING count(*) <= 50 AND max(t) = 1 AND count(*) FILTER (r = 0) = 0
    ),
    ways AS (
      SELECT 0 AS n, 0::BIGINT AS w, 1::DOUBLE AS c
      UNION ALL
      SELECT n + 1, x.w, sum(x.c) FROM (
        SELECT n, unnest([w, w + n + 1]) AS w, c FROM ways WHERE n < 50
      ) x GROUP BY n, x.w
    ),
    below AS (SELECT n, w, sum(c) OVER (PARTITION BY n ORDER BY w) AS c FROM ways)
    SELECT model_b, domain, seed, n, CAST(statistic AS DOUBLE) AS statistic, round(least(1, 2 * c / pow(2, n)), 9) AS p
    FROM sums JOIN (SELECT n, w, c FROM below) b USING (n) WHERE b.w = statistic
    """
)
def ev_wilcoxon_exact(spark, sf):
    """The signed-rank test of each user's errors, where the exact p applies: few differences, none zero or tied."""
    rows = predictions(spark, sf).select(
        "model", F.col("user_id").alias("domain"), "seed", "review_id", "y_true", "y_pred"
    )
    return S.wilcoxon(S.paired(stored(rows), "global")).filter("method = 'exact'").select(
        *S.GROUP, "n", F.col("statistic").cast("double").alias("statistic"), F.round("p", 9).alias("p")
    )


@query(
    "win_avg_rank",
    f"WITH {SIGNED} SELECT model_b, domain, seed, abs(r) AS size, count(*) AS ties, CAST(any_value(rank) AS "
    f"DOUBLE) AS rank FROM rk GROUP BY 1, 2, 3, 4"
)
def win_avg_rank(spark, sf):
    return S.signed_ranks(_pairs(spark, sf)).select(
        *S.GROUP, "size", "ties", F.col("rank").cast("double").alias("rank")
    )


@query(
    "ev_paired_t",
    f"WITH {PAIRED} SELECT model_b, domain, seed, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), "
    f"5) AS t FROM pairs GROUP BY 1, 2, 3"
)
def ev_paired_t(spark, sf):
    return S.paired_t(_pairs(spark, sf)).select(*S.GROUP, "n", F.round("t", 5).alias("t"))


@query(
    "ev_fisher",
    f"WITH {PREDICTED}, p AS (SELECT model, domain, seed, ((count(*) + seed) % 97 + 1) / 100.0::DOUBLE AS "
    f"p FROM preds GROUP BY 1, 2, 3), x AS (SELECT model, domain, -2 * sum(ln(p)) AS x, "
    f"count(*) AS m FROM p GROUP BY 1, 2) SELECT model, domain, round(x, 6) AS x, round(exp(-x / 2) * (1 + "
    f"x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6 + pow(x / 2, 4) / 24), 6) AS p_combined "
    f"FROM x"
)
def ev_fisher(spark, sf):
    p = predictions(spark, sf).groupBy("model", "domain", "seed").agg(
        (((F.count(F.lit(1)) + F.col("seed")) % 97 + 1).cast("double") / 100).alias("p")
    )
    return rounded(S.fisher(p, ["model", "domain"]).drop("m"), "x", "p_combined")


# Two-sided normal p: erfc(x) by the series of erf for small x, by its continued fraction for larger x, as a logarithm.
TESTED = SIGNED + """,
sums AS (SELECT model_b, domain, seed, CAST(count(*) AS DOUBLE) AS n, coalesce(CAST(sum(rank) FILTER (WHERE r > 0) AS DOUBLE), 0) AS wp, coalesce(CAST(sum(rank) FILTER (WHERE r < 0) AS DOUBLE), 0) AS wm, CAST(sum(t * t - 1) AS DOUBLE) AS tied FROM rk GROUP BY 1, 2, 3),
zed AS (SELECT *, least(wp, wm) AS statistic, abs(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) / sqrt(2::DOUBLE) AS x FROM sums),
tails AS (SELECT *, CASE WHEN x < 2 THEN ln(1 - 2 / sqrt(pi()) * exp(-x * x) * x * list_reduce(list_prepend(1::DOUBLE, list_transform(range(400, 0, -1), lambda k: 2::DOUBLE * k + 1)), lambda a, k: 1 + 2 * x * x / k * a))
  ELSE -x * x - ln(sqrt(pi()) * list_reduce(list_prepend(x, list_transform(range(400, 0, -1), lambda k: k / 2::DOUBLE)), lambda a, k: x + k / a)) END AS ln_p FROM zed),
errors AS (SELECT model_b, domain, seed, sqrt(avg(ea)) AS rmse_a, sqrt(avg(eb)) AS rmse_b, count(*) AS n_pairs FROM pairs GROUP BY 1, 2, 3),
tests AS (SELECT model_b, domain, seed, rmse_a, rmse_b, n_pairs, statistic, exp(ln_p) AS p, ln_p, coalesce(exp(ln_p) < 0.05, false) AS significant FROM errors LEFT JOIN tails USING (model_b, domain, seed))"""


@query(
    "ev_significance_table",
    f"WITH {TESTED} SELECT model_b, domain, seed, round(rmse_a, 6) AS rmse_a, round(rmse_b, "
    f"6) AS rmse_b, n_pairs, statistic, round(p, 6) AS p, significant FROM tests"
)
def ev_significance_table(spark, sf):
    out = S.significance_table(stored(predictions(spark, sf)), "global")
    return rounded(out, "rmse_a", "rmse_b", "p").withColumn("statistic", F.col("statistic").cast("double"))


@query(
    "agg_significance_summary",
    f"WITH {TESTED} SELECT model_b, count(*) FILTER (WHERE significant) AS n_significant, "
    f"count(*) AS n_tests, round(avg(rmse_a), 6) AS mean_rmse_a, round(avg(rmse_b), 6) AS mean_rmse_b "
    f"FROM tests GROUP BY 1"
)
def agg_significance_summary(spark, sf):
    return rounded(
        S.significance_summary(S.significance_table(stored(predictions(spark, sf)), "global")), "mean_rmse_a",
        "mean_rmse_b"
    )


@query(
    "ev_summary_table",
    f"WITH {TESTED}, metrics AS (SELECT model, domain, seed, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) "
    f"AS rmse, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY ALL), means AS (SELECT model, "
    f"domain, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(mae) AS mae_mean, "
    f"stddev_samp(mae) AS mae_std, count(*) AS n_seeds FROM metrics GROUP BY 1, 2), joint AS (SELECT model_b "
    f"AS model, domain, count(*) FILTER (WHERE significant) AS n_significant, -sum(greatest(ln_p, "
    f"ln(1e-300))) AS h, count(ln_p) AS m FROM tests GROUP BY 1, 2) SELECT model, domain, "
    f"round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std, round(mae_mean, "
    f"6) AS mae_mean, round(mae_std, 6) AS mae_std, n_seeds, n_significant, round(exp(-h) * (1 + h + pow(h, "
    f"2) / 2 + pow(h, 3) / 6 + pow(h, 4) / 24), 6) AS p_combined, model = 'global' AS is_reference "
    f"FROM means LEFT JOIN joint USING (model, domain)"
)
def ev_summary_table(spark, sf):
    p = stored(predictions(spark, sf))
    means = E.multi_seed(E.rmse_mae(p), ["rmse", "mae"])
    return rounded(
        S.summary_table(means, S.significance_table(p, "global"), "global"), "rmse_mean", "rmse_std", "mae_mean",
        "mae_std", "p_combined"
    )


@query(
    "op_mf_eval",
    f"WITH {PREDICTED} SELECT model, domain, seed, round(sqrt(avg(pow((y_true - 1) / 4 - (y_pred - 1) / 4, "
    f"2))), 6) AS rmse, round(avg(abs((y_true - 1) / 4 - (y_pred - 1) / 4)), 6) AS mae, "
    f"count(*) AS n FROM preds GROUP BY 1, 2, 3"
)
def op_mf_eval(spark, sf):
    """Errors on the normalised scale, as a factor model is validated."""
    p = predictions(spark, sf)
    return rounded(E.rmse_mae(p.withColumns({c: normalise(F.col(c)) for c in ("y_true", "y_pred")})), "rmse", "mae")


@query(
    "src_results_scan",
    f"WITH {METRICS} SELECT model, domain, seed, round(rmse, 6) AS rmse, round(mae, 6) AS mae, '7' AS k FROM metrics"
)
def src_results_scan(spark, sf):
    """Scans what the results sink has written; a run without metrics is skipped."""
    path = shared_folder(spark)
    runs = E.rmse_mae(predictions(spark, sf))
    broken = runs.limit(1).withColumns({"seed": F.lit(99), "rmse": F.lit(None).cast("double")})
    writers.write_results(runs.unionByName(broken), path, '{"a": {"k": 7}}')
    return rounded(readers.scan_results(spark, path), "rmse", "mae").select(
        "model", "domain", "seed", "rmse", "mae", F.get_json_object("config", "$.a.k").alias("k")
    )


@query(
    "src_results_counted",
    f"""
    WITH {METRICS}
    SELECT 'rows' AS reason, count(*) AS rows FROM metrics
    UNION ALL SELECT 'kept', count(*) FROM metrics WHERE seed < 4
    UNION ALL SELECT 'malformed', count(*) FROM metrics WHERE seed = 4
    UNION ALL SELECT 'incomplete', count(*) FROM metrics WHERE seed = 5
    """
)
def src_results_counted(spark, sf):
    """A log of results as JSON lines, one seed's cut short and one's without its error: what a scan skips, by reason."""
    path = shared_folder(spark)
    runs = E.rmse_mae(predictions(spark, sf))
    whole = F.to_json(F.struct(*[c for c in runs.columns if c != "rmse"], F.when(F.col("seed") < 5, F.col("rmse")).alias("rmse")))
    line = F.when(F.col("seed") == 4, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    runs.select(line.alias("value")).write.text(path)
    seen = Observation("scanned")
    readers.scan_results(spark, path, "json", seen).write.parquet(shared_folder(spark))
    return spark.createDataFrame(list(seen.get.items()), "reason string, rows long")


@query(
    "topk_best_candidate",
    f"WITH {METRICS} SELECT domain AS stage, arg_min(model, (round(rmse, 9), model)) AS candidate, "
    f"round(min(rmse), 6) AS rmse, min(rmse) < 1.5 AS accepted FROM metrics WHERE seed = 1 "
    f"GROUP BY 1"
)
def topk_best_candidate(spark, sf):
    m = E.rmse_mae(predictions(spark, sf)).filter("seed = 1").select(
        F.col("domain").alias("stage"), F.col("model").alias("candidate"), F.round("rmse", 9).alias("rmse")
    )
    return rounded(best_candidate(m, 1.5), "rmse")
