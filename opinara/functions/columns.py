"""Column functions of the review engine. All are built-in expressions; null in gives null out unless a docstring says else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_minimal(text: Column) -> Column:
    """White space runs to one space, ends stripped, only printable ASCII kept; null becomes ''."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(one), r"[^\x20-\x7E]", "")


def clean_bag(text: Column, stop: list[str], lemmas: dict[str, str] | None = None) -> Column:
    """Lower case, letters a-z only, stop words dropped, lemmas looked up, joined by spaces; null becomes ''."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "), " "), lambda w: w != ""
    )
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.array_join(words, " ")


def sentences(text: Column, shortest: int = 3) -> Column:
    """Cut after . ! or ? and white space; sentences of fewer than ``shortest`` characters are dropped; null has none."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(
        F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= shortest
    )


def holds_any(sentence: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased sentence has any keyword as a substring."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower(sentence), F.lit(k))
    return found


def matched_text(text: Column, keywords: list[str]) -> Column:
    """The sentences that hold a keyword, in order, joined by a space."""
    return F.array_join(F.filter(sentences(text), lambda s: holds_any(s, keywords)), " ")


def sentiment_label(stars: Column, strict: bool = False) -> Column:
    """4 and more: 1, 2 and less: 0; in between null, or an error if strict."""
    between = F.raise_error(F.lit("a rating between 2 and 4 has no label")) if strict else F.lit(None)
    return F.when(stars >= 4, 1).when(stars <= 2, 0).otherwise(between.cast("int"))


def clip(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def normalise(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return (x - low) / (high - low)


def denormalise(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return x * (high - low) + low


def margin_confidence(score: Column) -> Column:
    return F.abs(score - 0.5) * 2


def evidence_confidence(n: Column, enough: int = 3) -> Column:
    return F.least(n / F.lit(float(enough)), F.lit(1.0))


def confidence(score: Column, n: Column, floor: float | None = None) -> Column:
    """Mean of margin and evidence; not below ``floor`` if one is given."""
    c = (margin_confidence(score) + evidence_confidence(n)) / 2
    return c if floor is None else F.greatest(c, F.lit(floor))


def split_categories(text: Column, delimiter: str = "|") -> Column:
    """Parts, trimmed, without empty ones; null becomes an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\\" + delimiter), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_categories(parts: Column, delimiter: str = "|") -> Column:
    return F.array_join(F.coalesce(parts, F.array()), delimiter)


def epoch_to_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def parse_date(text: Column) -> Column:
    """Null where the text is no date or time."""
    return F.try_to_timestamp(text).cast("date")


#: Review-count buckets: (upper end, name); the last has no end.
COUNT_BUCKETS = [(5, "1-5"), (15, "6-15"), (50, "16-50"), (None, "51+")]


def bucket(n: Column, ends=COUNT_BUCKETS) -> Column:
    out = F
    for end, name in ends:
        out = out.otherwise(name) if end is None else out.when(n <= end, name)
    return out


def json_path(config: Column, path: str) -> Column:
    """Dotted path in a JSON text; null where it leads nowhere."""
    return F.get_json_object(config, "$." + path)


def relative_delta(base: Column, x: Column) -> Column:
    """(base - x) / base in per cent; null for base 0."""
    return F.try_divide(base - x, base) * 100


def p_display(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_number(p, 4))


def log_discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)
