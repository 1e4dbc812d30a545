"""Decontamination, lattice scoring, URL rules, packing and the pipeline against brute force."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opinara.llm import decontamination, language, lattice, packing, queries, url_rules
from opinara.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    text = lambda d: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert text(mine) == text(theirs)


def test_all_thirteen_are_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("block", [1000, 7])
def test_windows(spark, block):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item!"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x TWO three, four five six seven eight nine ten ELEVEN y"), (2, "a short item b short, item"), (3, None), (4, ""), (5, "two three four"), (5, "short item")], "doc_id long, text string").withColumn("found", F.lit(0))
    out = sorted((r["doc_id"], r["found"]["n_words"], [tuple(s) for s in r["found"]["spans"]], r["found"]["items"]) for r in decontamination.find_windows(docs, bench, keep=["doc_id"], block=block).collect())
    assert out == [(1, 12, [(1, 11)], [1]), (2, 6, [(1, 3), (4, 6)], [2]), (3, 0, [], []), (4, 0, [], []), (5, 2, [(0, 2)], [2]), (5, 3, [], [])]
    assert decontamination.find_windows(docs.limit(0), bench).isEmpty()
    assert decontamination.find_windows(docs, bench.limit(0)).filter(F.size("found.spans") > 0).isEmpty()


def segmentations(word, p):
    """Probability of a word, summed over all ways to cut it."""
    out = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        out[j] = sum(out[i] * p.get(word[i:j], 0.0) for i in range(j))
    return out[-1]


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", ""]
    prior = np.array([5, 3, 2, 2, 4, 1, 1, 1.0])
    m = lattice.Lattice(pieces, prior, {b: 7 for b in range(256)})
    p = dict(zip(pieces[:7], (prior / prior.sum())[:7], strict=True))
    words = [b"abab", b"b", b"aabba", b"ababababab"]
    assert m.marginals(words) == pytest.approx([math.log(segmentations("▁" + w.decode(), p)) for w in words])
    used = np.zeros(8)
    m.marginals([b"ab"], np.array([2.0]), used)
    assert used @ np.array([1, 2, 1, 1, 2, 3, 2, 1]) == pytest.approx(2 * 3)  # every segmentation covers the mark and two letters
    assert m.marginals(["é".encode()])[0] == pytest.approx(math.log(p["▁"]) + 2 * math.log(1 / prior.sum()))


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_long_words_are_walked_alike(block, monkeypatch):
    """Place by place and in blocks, marginals and expected uses are those of the walk over whole words."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "", "abab"]
    m = lattice.Lattice(pieces, np.array([5, 3, 2, 2, 4, 1, 1, 1.0, 3]), {b: 7 for b in range(256)})
    rng = random.Random(2)
    for size in (1, 2, 30):
        word = "".join(rng.choice("aabé") for _ in range(size))
        points = np.array([lattice.MARK, *map(ord, word)], np.uint32)
        a, b = np.zeros(9), np.zeros(9)
        assert m.long_walk(points, 2.0, a) == pytest.approx(m.walk(points[None], np.array([2.0]), b)[0])
        assert a == pytest.approx(b) and m.long_walk(points) == pytest.approx(m.walk(points[None])[0])


def test_tables_hold_any_vocabulary():
    rng = random.Random(6)
    pieces = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(1, 6))) for _ in range(20_000)})
    m = lattice.Lattice(pieces, np.ones(len(pieces)), {})
    for k in range(1, 7):
        own = [i for i, p in enumerate(pieces) if len(p) == k]
        points = np.array([list(map(ord, pieces[i])) for i in own], np.uint32)
        rows, found = m.lookup(m.hashed(points)[k], points)
        assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == list(enumerate(own))
        assert len(m.lookup(m.hashed(points)[k], points + 50)[0]) == 0  # equal hashes, other characters


def lattice_by_hand(docs):
    """(score, lattice_score) of texts that are all learned from: EM over dictionaries, in plain Python."""
    m = lattice.load()
    names = ["".join(map(chr, p[p > 0])) for p in m.points]
    p = {x: float(v) for x, v in zip(names, m.prior, strict=True) if x}
    byte = {b: float(m.prior[i]) for b, i in m.byte_of.items()}
    prior, prior_byte = dict(p), dict(byte)
    words = Counter(w for t in docs for w in (t or "").lower().split())
    total, ends = sum(words.values()), len(docs)

    def arc(x):
        return p[x] if x in p else math.prod(byte[b] for b in x.encode()) if len(x) == 1 else 0.0

    def walk(word):
        x = "▁" + word
        f, g = [1.0] + [0.0] * len(x), [0.0] * len(x) + [1.0]
        for j in range(1, len(x) + 1):
            f[j] = sum(f[i] * arc(x[i:j]) for i in range(max(0, j - 16), j))
        for i in range(len(x) - 1, -1, -1):
            g[i] = sum(arc(x[i:j]) * g[j] for j in range(i + 1, min(len(x), i + 16) + 1))
        return x, f, g

    for _ in range(3):
        used, used_byte, marginal = Counter(), Counter(), {}
        for w, n in words.items():
            x, f, g = walk(w)
            marginal[w] = f[-1]
            for i in range(len(x)):
                for j in range(i + 1, min(len(x), i + 16) + 1):
                    use = f[i] * arc(x[i:j]) * g[j] / f[-1] * n
                    if x[i:j] in p:
                        used[x[i:j]] += use
                    elif use:
                        for b in x[i:j].encode():
                            used_byte[b] += use
        all_ = sum(used.values()) + sum(used_byte.values()) + lattice.PRIOR_TOKENS
        p = {k: (used[k] + lattice.PRIOR_TOKENS * v) / all_ for k, v in prior.items()}
        byte = {k: (used_byte[k] + lattice.PRIOR_TOKENS * v) / all_ for k, v in prior_byte.items()}
    held = [
        sum(n * math.log((max(n - 1 - d, 0) + d * (len(words) - (n == 1)) * marginal[w]) / total) for w, n in words.items())
        for d in lattice.DISCOUNTS
    ]
    discount = lattice.DISCOUNTS[int(np.argmax(held))]
    p_end = (ends + 0.5) / (total + ends + 1)
    out = []
    for t in docs:
        a = b = math.log10(p_end)
        for w in (t or "").lower().split():
            own = walk(w)[1][-1]
            a += math.log10((max(words[w] - discount, 0) + discount * len(words) * own) / total * (1 - p_end))
            b += math.log10(own * (1 - p_end))
        out.append((a, b))
    return out


def test_lm_score_against_brute_force(spark):
    texts = ["the cat sat on the mat", "A cat, a hat; the the THE", None, "", "über 中文 zzxqj naïve", "the mat sat " * 20, "contradistinguishable 12345"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "")], "doc_id long, text string").repartition(3)
    want = lattice_by_hand([*texts, ""])
    for r in lattice.score(df).collect():
        assert (r["score"], r["lattice_score"]) == pytest.approx(want[r["doc_id"]], rel=1e-6), texts[r["doc_id"]]


def test_lm_scores(spark):
    out = {r["doc_id"]: r for r in lattice.op4_lattice_lm(spark, SF).collect()}
    counts, tokens = Counter(), {}
    for r in table(spark, SF, "documents").collect():
        tokens[r["doc_id"]] = [*(r["text"] or "").encode().lower().split(), None]
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update(tokens[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert math.isfinite(r["score"]) and r["score"] <= r["known_score"] + 1e-9 < 1e-6 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_known_words_score_nearly_as_by_counts(spark):
    """On training rows, which hold known words alone, the score is within a tenth of a token's count formula; on held-out
    rows the known words lie above the formula's mean, so the gap is that of the unknown ones."""
    out = lattice.op4_lattice_lm(spark, "/root/testdata/sf0.01").groupBy("held_out").agg(*[
        F.sum(c).alias(c) for c in ("score", "known_score", "base_score", "n_tokens", "n_known")
    ])
    got = {r["held_out"]: r for r in out.collect()}
    assert got[False]["score"] == pytest.approx(got[False]["known_score"])
    assert got[False]["score"] / got[False]["n_tokens"] > got[False]["base_score"] / got[False]["n_tokens"] - 0.1
    assert got[True]["known_score"] / got[True]["n_known"] > got[True]["base_score"] / got[True]["n_tokens"]


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "z" * 5000, 1), (None, "no id", 1), (4, "aa bb aa", 1), (4, "aa bb aa", 1), (5, "中\U0001f600", 1)], "doc_id long, text string, word int")
    out = [(r["doc_id"], r["n_tokens"], r["score"]) for r in lattice.score(docs).orderBy("doc_id").collect()]
    out = out[1:]  # that without an id comes first
    assert [x[1] for x in out] == [1, 1, 2, 4, 4, 2] and all(math.isfinite(x[2]) for x in out) and out[0][2] == out[1][2] and out[3] == out[4]
    assert lattice.score(docs.limit(0)).isEmpty()
    alone = lattice.score(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "a-b", "c", "com", "net"]
    host = lambda k: ".".join(rng.choice(labels) for _ in range(rng.randint(1, k)))
    rules = {(host(3), rng.choice(["", "/", "/x", "/x/y"])): rng.choice(["allow", "block"]) for _ in range(40)}
    urls = [None, "no scheme", "http://", "://A.B/x"] + [f"http://{host(4).upper()}{rng.choice(['', '/', '/x', '/x/y?q', '/z#f'])}" for _ in range(400)]
    urls += ["http://a.com/x"] * 200
    pages = spark.createDataFrame([(i, u, "k", 0) for i, u in enumerate(urls)], "page_id long, url string, key string, kind int").repartition(7)
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] + [(None, "/", "block")], "host string, path string, verdict string")
    for r in url_rules.judge_urls(pages, frame, default="none").collect():
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        h, p = rest[:at].lower(), rest[at:].split("?")[0].split("#")[0]
        fit = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules.items() if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fit)[2:] if fit else (None, "none")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, *best), u
    assert url_rules.judge_urls(pages.limit(0), frame).isEmpty()
    assert url_rules.judge_urls(pages, frame.limit(0)).filter("rule IS NOT NULL").isEmpty()


TEXTS = [None, "", " ", "  two  spaces ", "plain words here", "tab\there\n\nline  end ", "<|endoftext|> inside", "中文 and émigré", "x" * 300, "a b " * 20_000, "it's we'll 12345 !!! ...", " lead", "trail "]


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(5)
    alphabet = "ab é'’ \n\t\r\x0b\x1c\x85 　.,1²A中́😀"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    # Each character that the fast path takes, between each kind of neighbours; and all documents.
    plain = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180))]
    texts += [a + c + b for c in plain for a in ("", "a", " ", "1", "\n", "'", "é") for b in ("", "a", " ", "1", "\n", ".", "é")]
    texts += [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    enc = packing.Encoder(packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_packing_round_trip(spark, ranks):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, part int, offset int").repartition(3)
    pieces = packing.pack(docs, window=256, ranks=ranks and packing.tokenizer_path(ranks)).orderBy("sequence_id", "offset").collect()
    tk = Tokenizer.from_file(packing.tokenizer_path())
    own = {}  # ids are as many times there as rows
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["start"] == len(own.setdefault(r["doc_id"], []))
        own[r["doc_id"]] += ids
    assert own == {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert all(r["doc_tokens"] == len(own[r["doc_id"]]) for r in pieces)
    fill = {}
    for r in pieces:
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and all(v == 256 for k, v in fill.items() if k < len(fill) - 1)
    assert packing.pack(docs.limit(0)).isEmpty()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF).cache()
        assert out.columns == docs.columns and out.exceptAll(left).isEmpty(), name
        left = out
    ids = {r["doc_id"] for r in left.collect()}
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.collect()} == ids and 0 < len(ids) < docs.count()
    found = decontamination.find_windows(left, table(spark, SF, "benchmark"))
    assert found.filter(F.size("found.spans") > 0).isEmpty()


@pytest.mark.parametrize("stage", ["exact_stage", "near_stage"])
def test_dedup_stages_with_missing_and_repeated_ids(spark, stage):
    """Each row has its own verdict: none is lost for want of an id, or kept for another row of its id."""
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    given = [(None, "a"), (None, "b"), (None, "b"), (1, "c"), (1, "d"), (2, "d"), (2, "e"), (0, "d"), (None, "e"), (3, "f"), (3, "f"), (4, "g")]
    docs = spark.createDataFrame([(i, text[k], k) for i, k in given], "doc_id long, text string, lang string").repartition(3)
    out = getattr(corpus_pipeline, stage)(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["lang"]) for r in out.collect()), key=str) == sorted([(None, "a"), (None, "b"), (1, "c"), (0, "d"), (2, "e"), (3, "f"), (4, "g")], key=str)


def test_packing_repeated_ids(spark):
    """Rows that share an id are packed each; nothing overlaps and nothing is lost."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words"), (None, "none"), (None, None)], "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, window=4).orderBy("sequence_id", "offset").collect()
    places = [r["sequence_id"] * 4 + r["offset"] for r in pieces]
    assert places == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
    per = Counter((r["doc_id"], r["doc_tokens"]) for r in pieces for _ in range(r["length"]))
    assert per == {(1, 4): 8, (1, 3): 3, (None, 2): 2, (None, 1): 1}


def test_quality_and_benchmark_stages_keep_names(spark):
    """Columns named like those of a stage come through; repeated rows stay, nulls and empty tables have their results."""
    import corpus_pipeline

    docs = table(spark, SF, "documents").limit(60).withColumns({"quality_score": F.lit(9.0), "benchmark_windows": F.lit("b"), "\x01": F.lit(1), "component_id": F.lit(3)})
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty() and out.filter("quality_score <> 9.0 OR benchmark_windows <> 'b'").isEmpty(), name
        assert stage(spark, docs.limit(0), SF).isEmpty(), name
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SF).isEmpty()
    docs = docs.filter("text IS NOT NULL")  # near duplicates keep all rows without a word
    twice = docs.unionByName(docs)
    for name, n in (("quality", 2), ("exact_dedup", 1), ("near_dedup", 1), ("decontamination", 2)):
        stage = dict(corpus_pipeline.STAGES)[name]
        assert stage(spark, twice, SF).count() == n * stage(spark, docs, SF).count(), name


def odd_names(spark):
    """A table whose columns differ from the operators' own in case alone, or have dots, and its text column's name."""
    rows = [(1, "the cat. sat on the mat and the dog", 7, 8, 9, "q"), (2, None, 7, 8, 9, "q"), (3, "le chat est assis", 7, 8, 9, "q")]
    return spark.createDataFrame(rows, "`doc.id` long, `my.text` string, SCORE int, FOUND int, Lang_Pred int, `a.b` string")


@pytest.mark.parametrize("operator", ["language", "quality", "toxicity", "windows"])
def test_columns_that_differ_in_case_or_have_dots(spark, operator):
    df = odd_names(spark)
    if operator == "language":
        known = df.withColumn("la.ng", F.when(F.col("`doc.id`") == 3, "fr").otherwise("en"))
        out = language.detect(df, language.fit(known, "my.text", "la.ng", "doc.id"), "my.text")
        gone, into = {"SCORE", "Lang_Pred"}, "lang_pred"
    elif operator == "windows":
        items = spark.createDataFrame([("i", "sat on the mat")], "`item.id` string, `item.text` string")
        out = decontamination.find_windows(df, items, "my.text", None, "item.id", "item.text")
        gone, into = {"FOUND"}, "found"
    else:
        from opinara.llm import quality, toxicity

        own = {"quality": quality, "toxicity": toxicity}[operator]
        labels = spark.createDataFrame([(1, 1), (3, 0)], "`doc.id` long, label int")
        out = own.score(df, own.fit(df, labels, "label", text="my.text", doc_id="doc.id"), "my.text")
        gone, into = {"SCORE"}, "score"
    assert set(df.columns) - gone <= set(out.columns) and not gone & set(out.columns)
    assert out.select(f"`{into}`", "`a.b`").count() == 3


def test_urls_under_names_with_dots(spark):
    from opinara.llm import url_rules

    pages = spark.createDataFrame([(1, "http://a.com/x", "h")], "`page.id` long, `the.url` string, HOST string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, rules, "the.url", "page.id").select("page_id", "host", "verdict").collect()] == [(1, "a.com", "block")]
