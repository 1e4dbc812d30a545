"""Aspect-based sentiment: sentences matched to aspects by keywords, scored in one pass, aggregated four ways.

The lexicon is a mapping aspect -> keywords (a keyword is a substring of the lower-cased sentence), for a few dozen of them
one expression, or a table (aspect, keyword) of any size, searched with an automaton. All modes read one long
table, (review_id, aspect, text, n_sentences) with the whole text under the aspect null, so each text is scored once.
``scorer`` is anything that scoring.as_scorer takes: a fitted Spark ML model, an object with ``predict_proba``, or a function
from a text column to a score between 0 and 1.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence, holds_any, sentences
from .keywords import sentence_aspects
from .scoring import as_scorer

Lexicon = dict[str, list[str]]


def lexicon_of(lexicons: dict[str, Lexicon], domain: str) -> Lexicon:
    if domain not in lexicons:
        raise ValueError(f"no aspect lexicon for the domain {domain!r}")
    return lexicons[domain]


def matches(reviews: DataFrame, lexicon: Lexicon | DataFrame, text: str = "text") -> DataFrame:
    """(review_id, aspect, text, n_sentences): a row for each aspect that some sentence matches."""
    cut = reviews.select("review_id", sentences(F.col(text)).alias("s"))
    if isinstance(lexicon, DataFrame):
        return sentence_aspects(cut, lexicon)

    def own(aspect: str, keywords: list[str]) -> Column:
        return F.struct(F.lit(aspect).alias("aspect"), F.filter("s", lambda s: holds_any(s, keywords)).alias("own"))

    found = F.array(*[own(a, k) for a, k in lexicon.items()])
    each = cut.select("review_id", F.explode(F.filter(found, lambda x: F.size(x["own"]) > 0)).alias("m"))
    return each.select(
        "review_id", "m.aspect", F.array_join("m.own", " ").alias("text"), F.size("m.own").alias("n_sentences")
    )


def long_scores(
    reviews: DataFrame, lexicon: Lexicon | DataFrame, scorer: Any, text: str = "text"
) -> DataFrame:
    """(review_id, aspect, score, n_sentences): the matched aspects, and the whole text as aspect null."""
    whole = reviews.select(
        "review_id", F.lit(None).cast("string").alias("aspect"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit(0).alias("n_sentences")
    )
    texts = matches(reviews, lexicon, text).unionByName(whole)
    return as_scorer(scorer).score(texts, "text", "score").select("review_id", "aspect", "score", "n_sentences")


def _fallback() -> Column:
    return F.max(F.when(F.col("aspect").isNull(), F.col("score")))


def mean_score(scores: DataFrame) -> DataFrame:
    """Mean over matched aspects; the whole text's score if none matched."""
    return scores.groupBy("review_id").agg(
        F.coalesce(F.avg(F.when(F.col("aspect").isNotNull(), F.col("score"))), _fallback()).alias("sentiment_score")
    )


def confidence_mean(scores: DataFrame, floor: float = 0.05) -> DataFrame:
    """Mean weighted by confidence, not below floor; without a match the whole text's score."""
    c = F.when(F.col("aspect").isNotNull(), confidence(F.col("score"), F.col("n_sentences"), floor))
    return scores.groupBy("review_id").agg(
        F.coalesce(F.try_divide(F.sum(c * F.col("score")), F.sum(c)), _fallback()).alias("sentiment_score")
    )


def per_aspect(scores: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A column per aspect: its score, or the whole text's."""
    own = [F.coalesce(F.max(F.when(F.col("aspect") == a, F.col("score"))), _fallback()).alias(a) for a in lexicon]
    return scores.groupBy("review_id").agg(*own)


def per_aspect_confidence(scores: DataFrame, lexicon: Lexicon, floor: float | None = None) -> DataFrame:
    """Scores as above and ``{aspect}_confidence``; an unmatched aspect has the whole text's margin and no evidence."""
    wide = scores.groupBy("review_id").agg(
        *[F.coalesce(F.max(F.when(F.col("aspect") == a, F.col("score"))), _fallback()).alias(a) for a in lexicon],
        *[
            F.coalesce(
                F.max(F.when(F.col("aspect") == a, F.col("n_sentences"))), F.lit(0)
            ).alias(f"_n_{a}") for a in lexicon
        ]
    )
    return wide.withColumns(
        {f"{a}_confidence": confidence(F.col(a), F.col(f"_n_{a}"), floor) for a in lexicon}
    ).drop(*[f"_n_{a}" for a in lexicon])


def evidence_counts(reviews: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Matched sentences of every review per aspect, 0 where none."""
    found = matches(reviews, lexicon, text).groupBy("review_id").agg(
        *[F.coalesce(F.max(F.when(F.col("aspect") == a, F.col("n_sentences"))), F.lit(0)).alias(a) for a in lexicon]
    )
    return reviews.select("review_id").join(found, "review_id", "left").fillna(0, list(lexicon))


def coverage(reviews: DataFrame, lexicon: Lexicon | DataFrame, text: str = "text") -> DataFrame:
    """(aspect, reviews, percent): reviews that match each aspect, and any of them."""
    m = matches(reviews, lexicon, text)
    total = reviews.agg(F.count(F.lit(1)).alias("total"))
    each = m.groupBy("aspect").agg(F.countDistinct("review_id").alias("reviews")).unionByName(
        m.agg(F.lit("any").alias("aspect"), F.countDistinct("review_id").alias("reviews"))
    )
    return each.crossJoin(F.broadcast(total)).select(
        "aspect", "reviews", (F.try_divide(F.col("reviews"), F.col("total")) * 100).alias("percent")
    )


def derived_sentiment(wide: DataFrame, aspects: list[str], into: str = "sentiment_score") -> DataFrame:
    return wide.withColumn(into, sum((F.col(a) for a in aspects), F.lit(0.0)) / len(aspects))


def fusion_columns(mode: str, aspects: list[str]) -> list[str]:
    """Which columns a fusion takes: one score, the aspects, or the aspects and their confidences."""
    kinds = {
        "mean": ["sentiment_score"], "confidence_mean": ["sentiment_score"], "concat": list(aspects),
        "concat_confidence": [*aspects, *(f"{a}_confidence" for a in aspects)]
    }
    if mode not in kinds:
        raise ValueError(f"unknown mode {mode}")
    return kinds[mode]
