"""Held-out accuracy, edge cases and invariants of the three classifiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import language, quality, queries, toxicity
from opinara.llm.common import batches_of, table

EDGE = [(1, None), (2, ""), (3, "12 345 !!"), (4, "x"), (5, "word " * 60_000), (6, "é" * 3), (6, "é" * 3)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "keep", 9.0) for i, t in EDGE], "doc_id long, text string, lang_pred string, score double")


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op1_language"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_ignores_the_labels_of_held_out_rows(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).write.parquet(f"file://{tmp_path}/documents.parquet")
    one = language.op1_language(spark, "/root/testdata/sf0.001").select("doc_id", "lang_pred")
    assert one.exceptAll(language.op1_language(spark, f"file://{tmp_path}").select("doc_id", "lang_pred")).isEmpty()


def test_language_edges(spark, edge):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(docs)
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.detect(edge, model).orderBy("doc_id").collect()]
    assert len(out) == len(EDGE) and [x[1] for x in out[:3]] == ["und"] * 3 and all(0 <= x[2] <= 1 for x in out) and out[5] == out[6]
    assert language.detect(edge.limit(0), model).isEmpty()
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.detect(edge, nothing).collect()} == {"und"}


def test_mixture_finds_both_languages():
    a, b = np.zeros((language.BUCKETS, 2)), None
    a[:100, 0], a[100:200, 1] = 1000, 1000
    model = language.Languages(["a", "b"], a)
    row = np.zeros(200, np.int64)
    share = model.infer(row, np.arange(200), np.r_[np.full(100, 3), np.ones(100)], 1)[0]
    assert share == pytest.approx([0.75, 0.25], abs=0.03) and b is None
    assert model.infer(row[:100], np.arange(100), np.full(100, 3), 1)[0].tolist() == [1.0, 0.0]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op9_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.98
    assert (held[held.quality == 1].predicted == 1).mean() > 0.99


def test_quality_edges(spark, edge):
    sf = "/root/testdata/sf0.001"
    model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    out = [r["score"] for r in quality.score(edge, model).orderBy("doc_id").collect()]
    assert len(out) == len(EDGE) and all(0 <= x <= 1 for x in out) and out[0] == out[1] == pytest.approx(model.prior)
    empty = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels").limit(0))
    assert {r["score"] for r in quality.score(edge, empty).collect()} == {0.5}


def sparse(rng, n):
    """n random rows of terms and counts."""
    return [(np.sort(rng.choice(quality.FEATURES, 60, replace=False)), rng.integers(1, 5, 60)) for _ in range(n)]


def test_neighbour_vote_against_brute_force():
    """Dense vectors, a full SVD and a sorted vote; equally near rows count in the sample's order."""
    rng = np.random.default_rng(0)
    sample = sparse(rng, 60)
    sample[7] = sample[3]
    labels = (np.arange(60) % 2).astype(float)
    m = quality.Neighbours(sample, labels, 0.5, dimensions=59, neighbours=5)
    new = [*sparse(rng, 7), sample[3]]

    def dense(rows):
        x = np.zeros((len(rows), quality.FEATURES))
        for i, (t, c) in enumerate(rows):
            x[i, t] = np.log1p(c)
        x *= np.log((1 + 60) / (1 + np.bincount(np.concatenate([t for t, _ in sample]), minlength=quality.FEATURES))) + 1
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    _, _, vt = np.linalg.svd(dense(sample), full_matrices=False)
    unit = lambda x: (x @ vt[:59].T) / np.sqrt(((x @ vt[:59].T) ** 2).sum(1, keepdims=True))
    cosine = unit(dense(new)) @ unit(dense(sample)).T
    rows = np.repeat(np.arange(len(new)), [len(t) for t, _ in new])
    got = m.scores(rows, np.concatenate([t for t, _ in new]), np.concatenate([c for _, c in new]), len(new))
    for i in range(len(new)):
        near = sorted(range(60), key=lambda k: (-round(cosine[i, k], 5), k))[:5]
        w = np.maximum(cosine[i, near], 0) ** quality.SHARPNESS
        want = ((w * labels[near]).sum() + quality.PRIOR_WEIGHT * 0.5) / (w.sum() + quality.PRIOR_WEIGHT)
        assert got[i] == pytest.approx(want, abs=1e-3)
    one = quality.Neighbours([sample[3]] * 4, np.array([1.0, 1, 0, 0]), 0.5, neighbours=2)
    assert one.scores(np.zeros(60, np.int64), *sample[3], 1)[0] == pytest.approx((2 + 0.05) / 2.1)


@pytest.mark.parametrize(("module", "count"), [(quality, quality.term_counts), (language, language.grams)])
def test_counts_do_not_depend_on_batches_or_pieces(module, count, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"Aa  bb!\nbb bb", b"", b"x", b"same same\nsame same\n", "é ö\n\n é".encode()]
    texts.append(b"".join(rng.choice([b"ab", b" ", b"  ", b"\n", b"cde", b"\n\n", b"x x ", b"line\n"], 3000)))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, term, n = count(data, offsets)
    for size in (1 << 20, 5, 64):
        monkeypatch.setattr(module, "CHUNK", size)
        for a, b in batches_of(offsets, size):
            r, t, k = count(data, offsets[a : b + 1])
            own = (row >= a) & (row < b)
            assert np.array_equal(r + a, row[own]) and np.array_equal(t, term[own]) and np.array_equal(k, n[own])
    if module is quality:
        own = dict(zip(term[row == 3].tolist(), n[row == 3].tolist(), strict=True))
        assert own[quality.FEATURES - 2] == 3 and own[quality.FEATURES - 1] == 1 and not (row == 1).any()
        assert sum(c for t, c in zip(term[row == 0], n[row == 0], strict=True) if quality.PAIRS <= t < quality.FEATURES - 2) == 4  # Aa, bb!, bb, bb


def test_texts_over_a_piece(spark):
    """Texts of several MiB are counted whole, and score as their parts would have it."""
    line = "same words in one line "
    text = line * 150_000
    data = np.frombuffer(text.encode(), np.uint8)
    _, term, n = quality.term_counts(data, np.array([0, len(data)]))
    own = dict(zip(term.tolist(), n.tolist(), strict=True))
    assert len(data) > 3 << 20 and sum(c for t, c in own.items() if quality.PAIRS <= t < quality.FEATURES - 2) == 5 * 150_000
    giant = np.frombuffer(b"x" * (3 << 20) + b" y", np.uint8)
    _, term, n = quality.term_counts(giant, np.array([0, len(giant)]))
    assert sum(c for t, c in zip(term, n, strict=True) if t >= quality.PAIRS) == 2
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    good = docs.filter("lang = 'de' AND n_chars > 2000").first()["text"]
    df = spark.createDataFrame([(1, good), (2, (good + "\n") * (1 + (3 << 20) // len(good.encode())))], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.detect(df, language.fit(docs)).collect()}
    assert found == {1: "de", 2: "de"}


def exhaustive(m, bucket, count):
    """The language set of best penalised likelihood among all of them, by a plain EM for each, and its proportions."""
    best = None
    for bits in range(1, 1 << len(m.names)):
        own = [k for k in range(len(m.names)) if bits >> k & 1]
        lik = m.likelihood[bucket][:, own].astype(float)
        share = np.full(len(own), 1 / len(own))
        for _ in range(language.ROUNDS):
            part = lik * share
            share = (part / part.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
        value = (count * np.log((lik * share).sum(1))).sum() / language.OVERLAP - 0.5 * np.log(max(count.sum(), 2)) * (len(own) - 1)
        if best is None or value > best[0]:
            best = value, {m.names[k]: s for k, s in zip(own, share, strict=True)}
    return best


def test_language_sets_against_all_of_them(spark):
    """Documents and mixtures of two: the sets entered one by one are nearly always the best of all sets, and never worse
    than it in likelihood by more than a penalty; proportions agree where the sets do."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    m = language.fit(docs)
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").collect()]
    by = {r["lang"]: (r["text"] or "").encode()[:600] for r in docs.filter("lang IS NOT NULL AND n_chars > 800").collect()}
    texts += [by[a] + b" " + by[b] for a in by for b in by if a < b]
    same = total = 0
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        row, bucket, count = language.grams(data, np.array([0, len(data)]))
        if not len(row):
            continue
        share = m.infer(row, bucket, count, 1)[0]
        _, want = exhaustive(m, bucket, count)
        total += 1
        if {m.names[k] for k in np.flatnonzero(share > 0)} == set(want):
            same += 1
            assert {m.names[k]: float(share[k]) for k in np.flatnonzero(share > 0)} == pytest.approx(want, abs=1e-3)
        assert m.names[int(share.argmax())] == max(want, key=want.get)
    assert same >= 0.97 * total


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op3_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9 and (held[held.toxic == 0].predicted == 0).mean() > 0.97


def test_toxicity_shares_subwords(spark):
    bad, good = ["you utter nastiword", "a nastiwort here", "such nastiwordly thing"], ["a kind word here", "you utter darling", "such a thing"]
    docs = spark.createDataFrame([(i, t + f" filler{i % 7} plain") for i, t in enumerate((bad + good) * 10)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 6 < 3).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, "quite long text without anything " * 50 + "nastiworrd"), (2, "quite long text without anything " * 50), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert out[1] > 0.7 and out[2] < 0.5 and out[3] == out[4] < 0.01


def by_hand(model, text):
    """The text's best window, n-gram by n-gram."""
    to = bytes(toxicity.LOWER)
    words = []
    for w in text.translate(to).split():
        x = b" " + w + b" "
        grams = [x[i : i + k] for k in toxicity.ORDERS for i in range(len(x) - k + 1)]
        z = []
        for g in grams:
            h = 0
            for k, c in enumerate(g):
                h ^= int(toxicity._TABLES[k][c])
            z.append(float(model.toward[h & (toxicity.BUCKETS - 1)]))
        if z:
            words.append(sum(z) / len(z))
    n = min(len(words), model.window)
    return max((sum(words[i : i + n]) / n for i in range(len(words) - n + 1)), default=-np.inf) if words else -np.inf


def test_windows_against_brute_force(monkeypatch):
    """Scores of batches and of texts read in pieces, words cut by them among those, are those of n-grams taken one by one."""
    model = toxicity.learned_from([b"bad worse words", b"fine kind words"] * 3, np.array([1, 0] * 3))
    texts = [b"", b"  ", b"a", b"bad", b"A bad, WORSE thing; quite fine", "bäd über kind".encode(), b"fine " * 30 + b"bad worse" + b" fine" * 30, b"badworse" * 20]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [by_hand(model, t) for t in texts]
    assert model.logits(data, offsets) == pytest.approx(want, abs=1e-5)
    for size in (3, 8, 50):
        monkeypatch.setattr(toxicity, "CHUNK", size)
        got = [model.logits(data, offsets[i : i + 2])[0] for i in range(len(texts))]
        assert got == pytest.approx(want, abs=1e-5)


def test_training_moves_the_best_windows():
    """The trained model's loss on its own sample is what its pooled vectors, softmax and bias give, and small."""
    texts = [b"one bad word", b"one fine word", b"so bad here", b"so kind here"]
    model = toxicity.learned_from(texts, np.array([1, 0, 1, 0]))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    z = np.array([by_hand(model, t) for t in texts]) + float(model.bias[1] - model.bias[0])
    assert model.scores(data, offsets) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    assert (model.scores(data, offsets) > 0.5).tolist() == [True, False, True, False]


def test_toxicity_edges(spark, edge):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(edge, model).orderBy("doc_id").collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"] < 0.01 and out[5]["score"] == out[6]["score"] and out[0]["lang_pred"] == "keep"
    assert toxicity.score(edge.limit(0), model).isEmpty() and toxicity.score(edge, toxicity.fit(docs.limit(0), labels)).count() == len(EDGE)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(edge, nothing).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(edge, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()} == {0.5}


def test_repeated_ids_are_learned_once(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    more = docs.union(docs.filter("doc_id % 3 = 0")).union(docs.filter("doc_id % 3 = 0"))
    a, b = quality.fit(docs, labels), quality.fit(more, labels)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)
    assert np.array_equal(toxicity.fit(docs, labels).toward, toxicity.fit(more, labels).toward)


def test_long_text_in_pieces():
    model = toxicity.learned_from([b"bad", b"fine"], np.array([1, 0]))
    text = b"fine " * 300_000 + b"bad" + b" fine" * 300_000
    data = np.frombuffer(text, np.uint8)
    short = np.frombuffer(b"fine bad fine", np.uint8)
    assert model.scores(data, np.array([0, len(data)]))[0] == pytest.approx(model.scores(short, np.array([0, len(short)]))[0])
    giant = np.frombuffer(b"fine " + b"bad" * 500_000 + b" fine", np.uint8)
    whole = by_hand(model, b"fine " + b"bad" * 400 + b" fine")
    assert model.logits(giant, np.array([0, len(giant)]))[0] == pytest.approx(whole, abs=0.05)


def buckets_by_hand(word):
    """The buckets of a word's n-grams, its ends included, as often as they occur."""
    x, out = b" " + word + b" ", []
    for n in toxicity.ORDERS:
        for i in range(len(x) - n + 1):
            h = 0
            for k, c in enumerate(x[i : i + n]):
                h ^= int(toxicity._TABLES[k][c])
            out.append(h & (toxicity.BUCKETS - 1))
    return out


def test_one_step_of_joint_training_by_hand():
    """From random vectors: averages of averages, softmax, cross entropy, and one step of all numbers by their gradients."""
    texts, labels, rate = [b"one bad bad word", b"fine word", b"bad"], np.array([1, 0, 1]), 0.05
    model = toxicity.learned_from(texts, labels, epochs=1, rate=rate)
    used = sorted({b for t in texts for w in t.split() for b in buckets_by_hand(w)})
    rng = np.random.default_rng(3)
    e = rng.standard_normal((len(used), toxicity.DIMENSIONS)) * 0.1
    softmax, bias = rng.standard_normal((toxicity.DIMENSIONS, 2)) * 0.1, np.array([1.0, -1.0])
    ge, gs, gb = np.zeros_like(e), np.zeros_like(softmax), np.zeros(2)
    for t, y in zip(texts, labels, strict=True):
        words = [[used.index(b) for b in buckets_by_hand(w)] for w in t.split()]
        pooled = np.mean([e[w].mean(0) for w in words], axis=0)
        p = np.exp(pooled @ softmax + bias)
        d = p / p.sum() - np.eye(2)[y]
        gs += np.outer(pooled, d)
        gb += d
        for w in words:
            for k in w:
                ge[k] += softmax @ d / len(w) / len(words)
    for got, start, g in ((model.embedding[used], e, ge), (model.softmax, softmax, gs), (model.bias, bias, gb)):
        assert got == pytest.approx(start - rate * 0.1 * g / (np.sqrt(0.01 * g * g) + 0.01), abs=1e-5)
