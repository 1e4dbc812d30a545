"""Line deduplication by content-defined line chunks, in DataFrame operations only.

Lines are read as pieces of a few words: a piece ends, after sixteen characters or more, with a word whose last character is
a punctuation mark or one of six letters, or with the line. So pieces of equal passages soon fall alike, inside lines too. Each piece has a hash; a rolling hash over the last two piece hashes ends a chunk where it
is less than its neighbours' (a local minimum). The ends depend on nearby pieces alone, so text put in or taken out
elsewhere shifts no others, and a chunk has two pieces or more. Chunks of LEAST characters that occur more than once
anywhere are removed, but for the first occurrence.

A repeated passage seldom begins and ends where a chunk does. So each run of removed chunks is grown on both sides: the
chunk next to it is compared, word by word, with the one next to the first occurrence, and the words that are equal up to
the first difference go as well. Only chunks at the ends of such runs meet for that.

Texts are cut once, into a written table. Chunks are counted by names (64-bit hashes), so a chunk that a third of all
documents hold travels once per task, and of all others only names and places move. The repeated ones are then compared by
their bytes; should two different ones share a name, such names are spelled out in full and the count is taken again.

Not removed: a passage that holds fewer than two cuts, so that no chunk of it is whole: few of 50 words, hardly any of 100,
but any within a line that has neither such words nor spaces; and the rest of a passage beyond a chunk that is too short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, numbered, shared_folder, stored, table
from .exact_dedup import clashing_of

#: White space of one line and its opposite, as both Java's and DuckDB's regular expressions read them.
GAP, WORD = r"[ \t\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
#: The pieces of a text; together they are the text.
PIECE = rf"[^\n]{{16,63}}?[.!?,;:|dglnry]{GAP}+|[^\n]{{64}}{WORD}*{GAP}+|[^\n]*\n|[^\n]+"
MODULUS = 1_000_003
#: Characters that a removed chunk has at least.
LEAST = 32
#: Stands between chunks while they are made; texts that hold it are escaped by ESCAPE.
END, ESCAPE = "\x01", "\x02"
#: A column that no table of documents has.
ROW = "\x01row"


def name_of(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def spelled_name(chunk: Column, clashing: list[int], name=name_of) -> Column:
    """The chunk's name; where some names clash, with the chunk itself for these: equal exactly if the chunks are."""
    own = name(chunk)
    return F.struct(own.alias("name"), F.when(own.isin(clashing), chunk).alias("chunk")) if clashing else own


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "\x04")), F.lit(END), F.lit(ESCAPE + "\x03"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "\x03"), F.lit(END)), F.lit(ESCAPE + "\x04"), F.lit(ESCAPE))


def chunks_in(text: Column) -> Column:
    """struct<several, chunks>: whether an escaped text has several pieces, and its chunks in order; joined they are the text.

    Null for null; '' has one chunk, which is empty.
    """

    def rolled(x: Column) -> Column:
        """x: struct of pieces p and their hashes h."""
        roll = lambda h, i: F.when(i > 0, (F.get(x["h"], i - 1) * 31 + h) % MODULUS)
        return F.struct(x["p"].alias("p"), F.transform(x["h"], roll).alias("r"))

    def joined(x: Column) -> Column:
        """x: struct of pieces p and rolled hashes r. Nothing ends where a neighbour has no hash, or one piece would be left."""

        def ended(p: Column, i: Column) -> Column:
            least = (F.get(x["r"], i) < F.get(x["r"], i - 1)) & (F.get(x["r"], i) <= F.get(x["r"], i + 1))
            return F.when(least & (i < F.size(x["p"]) - 2), F.concat(p, F.lit(END))).otherwise(p)

        chunks = F.split(F.array_join(F.transform(x["p"], ended), ""), END)
        return F.struct((F.size(x["p"]) > 1).alias("several"), chunks.alias("chunks"))

    hashed = lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 7), 16, 10).cast("long")
    # Each step is a lambda's argument, so that it is worked out once.
    pieces = F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))
    steps = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.transform(p, hashed).alias("h")))
    return F.when(text.isNotNull(), F.element_at(F.transform(F.transform(steps, rolled), joined), 1))


def flagged(chunks: Column, gone: Column, step) -> Column:
    """step of (struct of chunks c and flags f): f has a byte for each place up to the last in gone (sorted, from 0)."""
    last = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    spelled = F.transform(gone, lambda k, i: F.concat(F.repeat(F.lit("0"), k - last(i) - 1), F.lit("1")))
    flags = F.array_join(spelled, "").cast("binary")
    return F.element_at(F.transform(F.array(F.struct(chunks.alias("c"), flags.alias("f"))), step), 1)


def _stays(x: Column, k: Column) -> Column:
    return F.substring(x["f"], k + 1, F.lit(1)) != F.lit(b"1")


def without(chunks: Column, gone: Column) -> Column:
    """chunks without those at the places in gone."""
    return flagged(chunks, gone, lambda x: F.filter(x["c"], lambda c, k: _stays(x, k)))


def blanked(chunks: Column, gone: Column) -> Column:
    """chunks with '' at the places in gone, so that the others keep theirs."""
    return flagged(chunks, gone, lambda x: F.transform(x["c"], lambda c, k: F.when(_stays(x, k), c).otherwise("")))


#: Words and gaps of a chunk, in turn; together they are the chunk.
TOKEN = r"[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+"


def shared_length(own: Column, other: Column, tail: bool) -> Column:
    """Characters of the longest run of whole tokens that both texts begin with (or end with, from a word on)."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    a, b = (F.reverse(cut(x)) if tail else cut(x) for x in (own, other))
    # Each step is a lambda's argument, so that it is worked out once.
    both = F.array(F.struct(a.alias("a"), b.alias("b")))

    def equal(x: Column) -> Column:
        same = F.transform(x["a"], lambda t, i: F.coalesce(t == F.get(x["b"], i), F.lit(False)))
        first = F.array_position(same, False)
        run = F.slice(x["a"], 1, F.when(first > 0, first - 1).otherwise(F.size(x["a"])).cast("int"))
        if not tail:
            return F.struct(run.alias("run"))
        # The gap before the first word stays: it parts what is left from what follows.
        gap = F.try_element_at(run, F.lit(-1)).rlike(GAP_ONLY)
        return F.struct(F.when(F.size(run) == 0, run).when(gap, F.slice(run, 1, F.size(run) - 1)).otherwise(run).alias("run"))

    runs = F.transform(both, equal)
    return F.element_at(F.transform(runs, lambda x: F.length(F.array_join(x["run"], ""))), 1)


GAP_ONLY = r"^[ \t\n\x0B\f\r]"


def gone_places(places: Column) -> Column:
    return F.array_sort(F.transform(F.filter(places, lambda p: ~p["stays"]), lambda p: p["at"]))


def run_ends(gone: Column, chunks: Column) -> Column:
    """(at, step) of the removed chunks that have a neighbour which isn't removed, before (-1) or after (1) them."""
    before = F.filter(gone, lambda p, i: (p > 0) & F.coalesce(F.get(gone, i - 1) != p - 1, F.lit(True)))
    after = F.filter(gone, lambda p, i: (p + 1 < F.size(chunks)) & F.coalesce(F.get(gone, i + 1) != p + 1, F.lit(True)))
    side = lambda step: lambda p: F.struct(p.alias("at"), F.lit(step).alias("step"))
    return F.concat(F.transform(before, side(-1)), F.transform(after, side(1)))


def grown_ends(marked: DataFrame, name) -> DataFrame:
    """(row, ends): for each chunk next to a removed one, how many characters of its head and tail go as well.

    marked: rows with places and run_ends. The chunk beside a removed one is held against that beside its first occurrence,
    which is earlier in the order of rows and places; so whatever goes is still there in an earlier place.
    """
    own = marked.filter(F.size("run_ends") > 0).select("row", "chunks", F.explode("run_ends").alias("e"))
    beside = F.col("e.at") + F.col("e.step")
    ends = own.select(
        name(F.get("chunks", F.col("e.at"))).alias("name"), "e.step", "row", beside.alias("at"),
        F.get("chunks", beside).alias("own")
    )
    stays = marked.filter("places IS NOT NULL").select(
        "chunks", F.explode(F.filter("places", lambda p: p["stays"])).alias("p")
    ).select("chunks", "p.at", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"))
    first = stays.select(
        name(F.get("chunks", F.col("at"))).alias("name"), "step", F.get("chunks", F.col("at") + F.col("step")).alias("other")
    ).filter("other <> ''")
    met = ends.join(first, ["name", "step"])
    tail = F.col("step") < 0
    size = F.when(tail, shared_length(F.col("own"), F.col("other"), True)).otherwise(
        shared_length(F.col("own"), F.col("other"), False)
    )
    sizes = met.select("row", "at", F.when(tail, 0).otherwise(size).alias("head"), F.when(tail, size).otherwise(0).alias("tail"))
    by_chunk = sizes.groupBy("row", "at").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    by_row = by_chunk.filter("head > 0 OR tail > 0").groupBy("row")
    return by_row.agg(F.sort_array(F.collect_list(F.struct("at", "head", "tail"))).alias("ends"))


def trimmed(chunks: Column, ends: Column) -> Column:
    """chunks less the heads and tails in ``ends`` (at, head, tail; in order of at)."""
    none = F.struct(F.lit(0).alias("head"), F.lit(0).alias("tail"))
    last = lambda i: F.coalesce(F.get(ends, i - 1)["at"], F.lit(-1))
    spread = F.flatten(F.transform(
        ends, lambda e, i: F.concat(
            F.array_repeat(none, e["at"] - last(i) - 1),
            F.array(F.struct(e["head"].alias("head"), e["tail"].alias("tail")))
        )
    ))
    cut = lambda c, e: F.when(e.isNull(), c).otherwise(
        F.substring(c, e["head"] + 1, F.greatest(F.length(c) - e["head"] - e["tail"], F.lit(0)))
    )
    held = F.transform(
        F.array(F.struct(chunks.alias("c"), spread.alias("e"))),
        lambda x: F.transform(x["c"], lambda c, i: cut(c, F.get(x["e"], i)))
    )
    return F.element_at(held, 1)


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name=name_of) -> DataFrame:
    """Per row of docs: doc_id, text (without repeated chunks), n_chars, n_removed (characters).

    A chunk is removed if it has two pieces and LEAST characters or more, something besides white space in it, and an
    earlier occurrence; and so are the words next to it that are equal to those next to that first occurrence, within the
    chunks on both sides. Earlier is: in a row of a lesser doc_id (rows without one come last; rows of one id as they
    lie in their files), or earlier in the row. Each row is a document of its own, so of repeated rows the first keeps what the others lose, and
    rows that share an id but not a text lose nothing to each other. A null text stays null, an empty one empty, both of 0
    characters; a text of which all goes is empty. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = shared_folder(spark)
    own = escaped(F.col(f"`{text}`").cast("string"))
    slim = numbered(docs, ROW).select(
        F.col(ROW).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), own.alias("text"),
        F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n_chars")
    )
    cut = slim.select("row", "doc_id", "n_chars", chunks_in(F.col("text")).alias("c"))
    cut = cut.select("row", "doc_id", "n_chars", "c.several", "c.chunks")
    cut = stored(cut, work, compression="zstd")
    counted = lambda chunk: (F.length(chunk) >= LEAST) & chunk.rlike(WORD)
    each = cut.filter("several").select("row", "doc_id", F.posexplode("chunks").alias("at", "chunk"))
    each = each.filter(counted(F.col("chunk")))
    clashing: list = []
    while True:
        named = each.select(spelled_name(F.col("chunk"), clashing, name).alias("name"), "row", "at", "doc_id")
        counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
        repeated = stored(counts.filter("n > 1").drop("n"), work)
        first = F.col("doc_id").eqNullSafe(F.col("first_id")).alias("first")
        again = stored(named.join(repeated, "name").select("name", "row", "at", first), work)
        # In the first document the least place stays; it may repeat itself, or share its id with other rows.
        kept = again.filter("first").groupBy("name").agg(F.min(F.struct("row", "at")).alias("kept"))
        inside = again.filter("first").join(stored(kept, work), "name")
        stays = inside.select("row", "at", (F.struct("row", "at") == F.col("kept")).alias("stays"))
        places = stays.unionByName(again.filter("NOT first").select("row", "at", F.lit(False).alias("stays")))
        by_row = places.groupBy("row").agg(F.collect_list(F.struct("at", "stays")).alias("places"))
        # Texts move as one string each, which is smaller than their chunks in an array.
        lines = cut.select("row", "doc_id", "n_chars", F.array_join("chunks", END).alias("line"))
        marked = lines.join(stored(by_row, work), "row", "left").select(
            "row", "doc_id", "n_chars", F.split("line", END).alias("chunks"), "places"
        ).withColumn("gone", gone_places(F.col("places")))
        marked = stored(marked.withColumn("run_ends", run_ends(F.col("gone"), F.col("chunks"))), compression="zstd")
        chunk = F.get("chunks", F.col("place.at"))
        held = marked.filter("places IS NOT NULL").select(
            "chunks", F.explode("places").alias("place")
        ).select(chunk.alias("chunk"))
        held = held.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
        found = clashing_of(held.select(spelled_name(F.col("chunk"), clashing, name).alias("name")))
        if not found:
            break
        clashing += [x["name"] if clashing else x for x in found]
    discard(spark, work)
    # Names that clash are spelled out here too, so a name has one chunk.
    ends = stored(grown_ends(marked, lambda c: spelled_name(c, clashing, name)))
    # Only rows with an end beside a removed chunk meet what it loses, and their removed chunks stay behind.
    ended = F.coalesce(F.size("run_ends"), F.lit(0)) > 0
    touched = marked.filter(ended).select(
        "row", "doc_id", "n_chars", F.array_join(blanked(F.col("chunks"), F.col("gone")), END).alias("line")
    ).join(ends, "row", "left")
    trim = F.array_join(trimmed(F.split("line", END), F.col("ends")), "")
    whole = F.when(F.col("ends").isNull(), F.replace("line", F.lit(END), F.lit(""))).otherwise(trim)
    left = F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(without(F.col("chunks"), F.col("gone")))
    rows = marked.filter(~ended).select("doc_id", F.array_join(left, "").alias("text"), "n_chars")
    rows = rows.unionByName(touched.select("doc_id", whole.alias("text"), "n_chars"))
    out = rows.select("doc_id", restored(F.col("text")).alias("text"), "n_chars")
    return out.withColumn("n_removed", F.col("n_chars") - F.coalesce(F.length("text"), F.lit(0)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of whole ``documents`` that repeated chunks take; the digest is of the text that stays."""
    out = deduplicate_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_chars", "n_removed", digest.alias("text_sha256"))


SQL = rf"""
WITH texts AS (SELECT doc_id, replace(replace(text, chr(2), chr(2) || chr(4)), chr(1), chr(2) || chr(3)) AS text FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PIECE}')) AS piece, generate_subscripts(regexp_extract_all(text, '{PIECE}'), 1) AS i FROM texts),
hashed AS (SELECT *, CAST('0x' || substr(md5(piece), 1, 7) AS BIGINT) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM pieces),
rolled AS (SELECT *, CASE WHEN i >= 2 THEN (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 1000003 END AS r FROM hashed),
ended AS (SELECT *, coalesce(r < lag(r) OVER w AND r <= lead(r) OVER w AND i < n - 1, false) AS ends FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ended),
chunks AS (SELECT doc_id, k, min(n) > 1 AS several, string_agg(piece, '' ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, k),
counted AS (SELECT *, several AND length(chunk) >= 32 AND regexp_matches(chunk, '{WORD}') AS counts FROM chunks),
ranked AS (SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, k) > 1 AS gone FROM counted),
beside AS (
  SELECT *, lag(chunk) OVER w AS before, lead(chunk) OVER w AS after, lag(gone) OVER w AS gone_before, lead(gone) OVER w AS gone_after
  FROM ranked WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
first AS (SELECT * FROM beside WHERE counts AND NOT gone),
met AS (
  SELECT b.doc_id, b.k + 1 AS k, 'head' AS side, regexp_extract_all(b.after, '{TOKEN}') AS own, regexp_extract_all(f.after, '{TOKEN}') AS other
  FROM beside b JOIN first f USING (chunk) WHERE b.gone AND NOT b.gone_after AND f.after <> ''
  UNION ALL
  SELECT b.doc_id, b.k - 1, 'tail', list_reverse(regexp_extract_all(b.before, '{TOKEN}')), list_reverse(regexp_extract_all(f.before, '{TOKEN}'))
  FROM beside b JOIN first f USING (chunk) WHERE b.gone AND NOT b.gone_before AND f.before <> ''),
runs AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, len(own) + 1), lambda i: coalesce(own[i] = other[i], false)), false), 0) - 1, len(own)) AS n FROM met),
sizes AS (
  SELECT doc_id, k, coalesce(max(length(array_to_string(own[1:n], ''))) FILTER (side = 'head'), 0) AS head,
    coalesce(max(length(array_to_string(own[1:CASE WHEN n > 0 AND regexp_matches(own[n], '{GAP_ONLY}') THEN n - 1 ELSE n END], ''))) FILTER (side = 'tail'), 0) AS tail
  FROM runs GROUP BY 1, 2),
cut AS (
  SELECT r.doc_id, r.k, r.gone, CASE WHEN s.k IS NULL THEN r.chunk ELSE substr(r.chunk, CAST(s.head AS BIGINT) + 1, greatest(length(r.chunk) - CAST(s.head AS BIGINT) - CAST(s.tail AS BIGINT), 0)) END AS chunk
  FROM ranked r LEFT JOIN sizes s ON s.doc_id = r.doc_id AND s.k = r.k),
kept AS (SELECT doc_id, string_agg(chunk, '' ORDER BY k) FILTER (WHERE NOT gone) AS text FROM cut GROUP BY doc_id),
restored AS (SELECT doc_id, replace(replace(text, chr(2) || chr(3), chr(1)), chr(2) || chr(4), chr(2)) AS text FROM kept)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(length(d.text), 0) - coalesce(length(k.text), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN restored k USING (doc_id)
"""
