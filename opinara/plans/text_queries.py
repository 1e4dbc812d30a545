"""Queries over texts: cleaning, sentences, aspects, TF-IDF; and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import absa as A
from ..operators import content as T
from ..operators.keywords import lexicon_table
from ..shared import table
from ..sources.sample_tables import interactions
from .registry import INTER, query, r6

#: Aspects for the invented prose: frequent words of each language.
LEXICON = {
    "aspect_en": ["the ", "that "], "aspect_fr": ["que ", "les "], "aspect_de": ["der ", "und "],
    "aspect_es": ["para ", "los "]
}
STOP = ["the", "of", "and", "to", "in", "is", "it"]


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text", "lang", "source")


def _scorer(text):
    return (F.length(text) % 97).cast("double") / 96


@query(
    "fn_clean_minimal",
    r"SELECT doc_id AS review_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), "
    r"'[ \t\n\r\f\v]+', ' ', 'g')), '[^\x20-\x7E]', '', 'g') AS text_bert FROM documents"
)
def fn_clean_minimal(spark, sf):
    return _docs(spark, sf).select("review_id", C.clean_minimal(F.col("text")).alias("text_bert"))


BAG = (
    "SELECT doc_id AS review_id, lang, source, list_filter(string_split(regexp_replace(lower(coalesce(text, "
    "'')), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and', "
    "'to', 'in', 'is', 'it')) AS w FROM documents"
)


@query("fn_clean_bag", f"SELECT review_id, array_to_string(w, ' ') AS text_tfidf FROM ({BAG})")
def fn_clean_bag(spark, sf):
    return _docs(spark, sf).select("review_id", C.clean_bag(F.col("text"), STOP).alias("text_tfidf"))


@query("flt_empty_text", f"SELECT count(*) FILTER (WHERE len(w) = 0) AS n_empty, count(*) AS n FROM ({BAG})")
def flt_empty_text(spark, sf):
    return _docs(spark, sf).select(C.clean_bag(F.col("text"), STOP).alias("t")).agg(
        F.count_if(F.length("t") == 0).alias("n_empty"), F.count(F.lit(1)).alias("n")
    )


# RE2 has no lookbehind: a sign is put after each end first.
SENT = (
    r"SELECT doc_id AS review_id, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, "
    r"''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, "
    r"'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda s: length(s) >= 3) AS s FROM documents"
)
_MATCH = {a: " OR ".join(f"contains(lower(x), '{k}')" for k in ks) for a, ks in LEXICON.items()}
LONG = f"sent AS ({SENT}), m AS (" + " UNION ALL ".join(
    f"SELECT review_id, '{a}' AS aspect, list_filter(s, lambda x: {c}) AS own FROM sent" for a, c in _MATCH.items()
) + "), matched AS (SELECT review_id, aspect, len(own) AS n, (length(array_to_string(own, ' ')) % 97) / 96.0::DOUBLE AS score FROM m WHERE len(own) > 0), whole AS (SELECT review_id, (length(coalesce(text, '')) % 97) / 96.0::DOUBLE AS w FROM sent)"


@query("fn_sentences", f"SELECT review_id, len(s) AS n, array_to_string(s, '|') AS sentences FROM ({SENT})")
def fn_sentences(spark, sf):
    return _docs(spark, sf).select("review_id", C.sentences(F.col("text")).alias("s")).select(
        "review_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences")
    )


@query("fn_match_aspects", f"WITH {LONG} SELECT review_id, aspect, n AS n_sentences FROM matched")
def fn_match_aspects(spark, sf):
    return A.matches(_docs(spark, sf), LEXICON).select(
        "review_id", "aspect", F.col("n_sentences").cast("long").alias("n_sentences")
    )


@query(
    "fn_match_aspects_table",
    f"""
    WITH sent AS ({SENT}),
    lexicon AS (SELECT DISTINCT p_brand AS aspect, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part),
    words AS (SELECT DISTINCT keyword FROM lexicon WHERE keyword <> ''),
    each AS (SELECT review_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent),
    hits AS (SELECT DISTINCT review_id, i, aspect FROM each
      JOIN words ON contains(lower(x), keyword) JOIN lexicon USING (keyword))
    SELECT review_id, aspect, count(*) AS n_sentences FROM hits GROUP BY 1, 2
    """
)
def fn_match_aspects_table(spark, sf):
    """A lexicon that is a table: the words of the parts' names are the keywords of their brands."""
    words = table(spark, sf, "part").select(
        F.col("p_brand").alias("aspect"), F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")
    )
    return A.matches(_docs(spark, sf), lexicon_table(words)).select(
        "review_id", "aspect", F.col("n_sentences").cast("long").alias("n_sentences")
    )


@query(
    "fn_join_matched",
    f"WITH sent AS ({SENT}) SELECT review_id, array_to_string(list_filter(s, lambda x: {_MATCH['aspect_en']}), "
    f"' ') AS matched FROM sent"
)
def fn_join_matched(spark, sf):
    return _docs(spark, sf).select("review_id", C.matched_text(F.col("text"), LEXICON["aspect_en"]).alias("matched"))


@query(
    "agg_aspect_coverage",
    f"WITH {LONG}, c AS (SELECT aspect, count(DISTINCT review_id) AS reviews FROM matched "
    f"GROUP BY 1 UNION ALL SELECT 'any', count(DISTINCT review_id) FROM matched) SELECT aspect, "
    f"reviews, round(reviews * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM c"
)
def agg_aspect_coverage(spark, sf):
    return A.coverage(_docs(spark, sf), LEXICON).withColumn("percent", r6("percent"))


@query(
    "agg_aspect_evidence",
    f"WITH {LONG} SELECT w.review_id, " + ", ".join(
        f"CAST(coalesce(max(n) FILTER (WHERE aspect = '{a}'), 0) AS BIGINT) AS {a}" for a in LEXICON
    ) + " FROM whole w LEFT JOIN matched USING (review_id) GROUP BY 1"
)
def agg_aspect_evidence(spark, sf):
    return A.evidence_counts(_docs(spark, sf), LEXICON).select(
        "review_id", *[F.col(a).cast("long").alias(a) for a in LEXICON]
    )


def _scores(spark, sf):
    return A.long_scores(_docs(spark, sf), LEXICON, _scorer)


@query(
    "op_absa_mean",
    f"WITH {LONG} SELECT review_id, round(coalesce(avg(score), any_value(w)), 6) AS sentiment_score "
    f"FROM whole LEFT JOIN matched USING (review_id) GROUP BY 1"
)
def op_absa_mean(spark, sf):
    return A.mean_score(_scores(spark, sf)).withColumn("sentiment_score", r6("sentiment_score"))


CONF = "(abs(score - 0.5) * 2 + least(n / 3.0::DOUBLE, 1)) / 2"


@query(
    "op_absa_conf_mean",
    f"WITH {LONG}, c AS (SELECT *, greatest({CONF}, 0.05::DOUBLE) AS c FROM matched) SELECT review_id, "
    f"round(coalesce(sum(c * score) / sum(c), any_value(w)), 6) AS sentiment_score FROM whole "
    f"LEFT JOIN c USING (review_id) GROUP BY 1"
)
def op_absa_conf_mean(spark, sf):
    return A.confidence_mean(_scores(spark, sf)).withColumn("sentiment_score", r6("sentiment_score"))


_WIDE = {a: f"coalesce(max(score) FILTER (WHERE aspect = '{a}'), any_value(w))" for a in LEXICON}
_N = {a: f"coalesce(max(n) FILTER (WHERE aspect = '{a}'), 0)" for a in LEXICON}


@query(
    "op_absa_concat",
    f"WITH {LONG} SELECT review_id, " + ", ".join(
        f"round({x}, 6) AS {a}" for a, x in _WIDE.items()
    ) + " FROM whole LEFT JOIN matched USING (review_id) GROUP BY 1"
)
def op_absa_concat(spark, sf):
    return A.per_aspect(_scores(spark, sf), LEXICON).select("review_id", *[r6(a).alias(a) for a in LEXICON])


@query(
    "op_absa_concat_conf",
    f"WITH {LONG} SELECT review_id, " + ", ".join(
        f"round({x}, 6) AS {a}, round((abs({x} - 0.5) * 2 + least({_N[a]} / 3.0::DOUBLE, 1)) / 2, 6) AS {a}_confidence" for a,
        x in _WIDE.items()
    ) + " FROM whole LEFT JOIN matched USING (review_id) GROUP BY 1"
)
def op_absa_concat_conf(spark, sf):
    return A.per_aspect_confidence(_scores(spark, sf), LEXICON).select(
        "review_id", *[r6(c).alias(c) for a in LEXICON for c in (a, f"{a}_confidence")]
    )


@query(
    "prj_derived_sentiment",
    f"WITH {LONG}, wide AS (SELECT review_id, " + ", ".join(
        f"{x} AS {a}" for a, x in _WIDE.items()
    ) + f" FROM whole LEFT JOIN matched USING (review_id) GROUP BY 1) SELECT review_id, round(({' + '.join(LEXICON)}) / 4, 6) AS sentiment_score FROM wide"
)
def prj_derived_sentiment(spark, sf):
    return A.derived_sentiment(A.per_aspect(_scores(spark, sf), LEXICON), list(LEXICON)).select(
        "review_id", r6("sentiment_score").alias("sentiment_score")
    )


@query(
    "prj_fusion_columns",
    f"WITH {LONG} SELECT review_id, " + ", ".join(
        f"round({x}, 6) AS {a}" for a, x in _WIDE.items()
    ) + " FROM whole LEFT JOIN matched USING (review_id) GROUP BY 1"
)
def prj_fusion_columns(spark, sf):
    wide = A.per_aspect_confidence(_scores(spark, sf), LEXICON)
    return wide.select("review_id", *[r6(c).alias(c) for c in A.fusion_columns("concat", list(LEXICON))])


def _bags(spark, sf):
    return _docs(spark, sf).select("review_id", "source", C.clean_bag(F.col("text"), STOP).alias("bag"))


TF = (
    f"bags AS ({BAG}), tf AS (SELECT review_id, any_value(source) AS source, term, count(*) AS tf "
    f"FROM (SELECT review_id, source, unnest(w) AS term FROM bags) WHERE length(term) >= 2 "
    f"GROUP BY review_id, term)"
)


@query(
    "op_tfidf",
    f"WITH {TF}, nd AS (SELECT count(DISTINCT review_id) AS n FROM tf), vocab AS (SELECT term, "
    f"count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 500), raw AS (SELECT review_id, "
    f"term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (term) "
    f"CROSS JOIN nd) SELECT review_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY review_id)), "
    f"6) AS w FROM raw"
)
def op_tfidf(spark, sf):
    return T.tfidf(_bags(spark, sf), "review_id", "bag").withColumn("w", r6("w"))


LEAK = f"""{TF}, items AS (SELECT source, term, sum(tf) AS tf FROM tf GROUP BY 1, 2), nd AS (SELECT count(DISTINCT source) AS n FROM items),
vocab AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1 + count(*))) + 1 AS idf FROM items CROSS JOIN nd GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500),
x AS (SELECT source, term, tf * idf AS x FROM items JOIN vocab USING (term)), full_ AS (SELECT source, sum(x * x) AS xx FROM x GROUP BY 1),
y AS (SELECT review_id, source, term, tf * idf AS y FROM tf JOIN vocab USING (term)), cross_ AS (SELECT review_id, sum(x * y) AS xy, sum(y * y) AS yy FROM y JOIN x USING (source, term) GROUP BY 1),
sizes AS (SELECT source, count(*) AS n_reviews FROM documents GROUP BY 1),
shift AS (SELECT d.doc_id AS review_id, d.source, n_reviews, 1 - (xx - coalesce(xy, 0)) / (sqrt(xx) * sqrt(greatest(xx - 2 * coalesce(xy, 0) + coalesce(yy, 0), 0))) AS shift FROM documents d JOIN sizes USING (source) JOIN full_ USING (source) LEFT JOIN cross_ c ON c.review_id = d.doc_id WHERE n_reviews > 1)"""


def _shift(spark, sf):
    return T.leakage_shift(_bags(spark, sf), "bag", "source")


@query("op_leakage_shift", f"WITH {LEAK} SELECT review_id, source, n_reviews, abs(round(shift, 6)) AS shift FROM shift")
def op_leakage_shift(spark, sf):
    return _shift(spark, sf).withColumn("shift", F.abs(r6("shift")))


@query(
    "agg_bucket_quantiles",
    f"WITH {LEAK} SELECT CASE WHEN n_reviews <= 5 THEN '1-5' WHEN n_reviews <= 15 THEN '6-15' WHEN n_reviews "
    f"<= 50 THEN '16-50' ELSE '51+' END AS bucket, count(*) AS n, round(avg(shift), 6) AS mean, "
    f"round(quantile_cont(shift, 0.5), 6) AS median, round(quantile_cont(shift, 0.9), 6) AS p90 "
    f"FROM shift GROUP BY 1"
)
def agg_bucket_quantiles(spark, sf):
    out = T.bucket_quantiles(_shift(spark, sf).withColumn("bucket", C.bucket(F.col("n_reviews"))), "shift", "bucket")
    return out.withColumns({c: r6(c) for c in ("mean", "median", "p90")})


@query(
    "agg_low_count_share",
    f"WITH {INTER}, s AS (SELECT business_id, count(*) AS n FROM inter GROUP BY 1) SELECT round(avg(CASE WHEN "
    f"n <= 15 THEN 1.0 ELSE 0 END) * 100, 6) AS percent FROM inter JOIN s USING (business_id)"
)
def agg_low_count_share(spark, sf):
    rows = interactions(spark, sf)
    n = rows.groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "business_id").agg(r6(F.avg((F.col("n") <= 15).cast("double")) * 100).alias("percent"))


@query(
    "op_multilabel_onehot",
    "SELECT DISTINCT p_partkey, unnest(list_filter(list_transform(string_split(p_brand || '|' || p_type || "
    "'| ' || p_name, '|'), lambda x: trim(x)), lambda x: x <> '')) AS category FROM part"
)
def op_multilabel_onehot(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", C.split_categories(F.concat("p_brand", F.lit("|"), "p_type", F.lit("| "), "p_name")).alias("c")
    )
    return T.multi_hot(parts, "p_partkey", "c")


@query(
    "fn_split_categories",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_brand || '||' || p_type "
    "|| ' | ' || p_name, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS parts FROM part"
)
def fn_split_categories(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        C.join_categories(
            C.split_categories(F.concat("p_brand", F.lit("||"), "p_type", F.lit(" | "), "p_name")), ";"
        ).alias("parts")
    )


@query(
    "fn_join_categories",
    "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand || '|' || p_type END, '') AS joined FROM part"
)
def fn_join_categories(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        C.join_categories(F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type"))).alias("joined")
    )


@query(
    "op_scale",
    "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), "
    "6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), "
    "6) AS p_retailprice FROM part"
)
def op_scale(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return T.scaled(x, ["p_size", "p_retailprice"]).withColumns({c: r6(c) for c in ("p_size", "p_retailprice")})


@query(
    "fn_confidence",
    "WITH x AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS s, event_id % 6 AS n "
    "FROM events) SELECT event_id, round(abs(s - 0.5) * 2, 6) AS margin, round(least(n / 3.0::DOUBLE, "
    "1), 6) AS evidence, round(greatest((abs(s - 0.5) * 2 + least(n / 3.0::DOUBLE, 1)) / 2, "
    "0.05), 6) AS confidence FROM x"
)
def fn_confidence(spark, sf):
    x = table(spark, sf, "events").select(
        "event_id", ((F.col("event_id") % 101).cast("double") / 100).alias("s"), (F.col("event_id") % 6).alias("n")
    )
    s, n = F.col("s"), F.col("n")
    return x.select(
        "event_id", r6(C.margin_confidence(s)).alias("margin"), r6(C.evidence_confidence(n)).alias("evidence"),
        r6(C.confidence(s, n, 0.05)).alias("confidence")
    )


@query(
    "fn_margin_confidence",
    "SELECT event_id, round(abs((event_id % 101) / 100.0::DOUBLE - 0.5) * 2, 6) AS margin FROM events"
)
def fn_margin_confidence(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r6(C.margin_confidence((F.col("event_id") % 101).cast("double") / 100)).alias("margin")
    )


@query(
    "fn_evidence_confidence",
    "SELECT event_id, round(least((event_id % 6) / 3.0::DOUBLE, 1), 6) AS evidence FROM events"
)
def fn_evidence_confidence(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r6(C.evidence_confidence(F.col("event_id") % 6)).alias("evidence")
    )


@query(
    "fn_epoch_to_date",
    "SELECT l_orderkey, l_linenumber, CAST(to_timestamp(l_orderkey * 86399) AT TIME ZONE 'UTC' AS DATE) AS "
    "date FROM lineitem"
)
def fn_epoch_to_date(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.epoch_to_date(F.col("l_orderkey") * 86399).alias("date")
    )


@query(
    "fn_parse_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders"
)
def fn_parse_date(spark, sf):
    text = F.when(
        F.col("o_orderkey") % 5 == 0, F.concat(F.lit("no date "), F.col("o_orderkey").cast("string"))
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", C.parse_date(text).alias("date"))


@query(
    "fn_bucket",
    "SELECT p_partkey, CASE WHEN p_size <= 5 THEN '1-5' WHEN p_size <= 15 THEN '6-15' WHEN p_size <= 50 THEN "
    "'16-50' ELSE '51+' END AS bucket FROM part"
)
def fn_bucket(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.bucket(F.col("p_size")).alias("bucket"))


@query(
    "fn_json_path",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS nested FROM events"
)
def fn_json_path(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.json_path(F.col("props"), "k").alias("k"), C.json_path(F.col("props"), "a.b").alias("nested")
    )


@query(
    "fn_relative_delta",
    "SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id % 10 - value) / (event_id "
    "% 10) * 100 END, 6) AS delta FROM events"
)
def fn_relative_delta(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r6(C.relative_delta((F.col("event_id") % 10).cast("double"), F.col("value"))).alias("delta")
    )


@query(
    "fn_p_display",
    "WITH x AS (SELECT event_id, (event_id % 2000) / 20000.0::DOUBLE AS p FROM events) "
    "SELECT event_id, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.4f', p) END AS shown, "
    "p < 0.05 AS significant FROM x"
)
def fn_p_display(spark, sf):
    """Both engines round the double itself, so that no value is a tie in one of them only."""
    x = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 2000).cast("double") / 20000).alias("p"))
    return x.select("event_id", C.p_display(F.col("p")).alias("shown"), (F.col("p") < 0.05).alias("significant"))


@query(
    "fn_log_discount",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(1 / log2(l_linenumber + 1), 6) AS discount FROM lineitem"
)
def fn_log_discount(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(C.log_discount(F.col("l_linenumber"))).alias("discount")
    )


@query("prj_clip", "SELECT event_id, least(greatest(value / 10, 1), 5) AS clipped FROM events")
def prj_clip(spark, sf):
    return table(spark, sf, "events").select("event_id", C.clip(F.col("value") / 10).alias("clipped"))


@query("prj_rating_normalise", f"WITH {INTER} SELECT review_id, (stars - 1) / 4 AS scaled, stars AS back FROM inter")
def prj_rating_normalise(spark, sf):
    n = C.normalise(F.col("stars"))
    return interactions(spark, sf).select("review_id", n.alias("scaled"), C.denormalise(n).alias("back"))


@query(
    "prj_sentiment_label",
    f"WITH {INTER} SELECT review_id, CAST(CASE WHEN stars >= 4 THEN 1 WHEN stars <= 2 THEN 0 END AS INTEGER) "
    f"AS label FROM inter"
)
def prj_sentiment_label(spark, sf):
    return interactions(spark, sf).select("review_id", C.sentiment_label(F.col("stars")).alias("label"))
