"""Merkle manifest, hard negatives and SimHash against plain Python, with edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinara.llm import hard_negatives, merkle, simhash
from opinara.llm.common import stored


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def folded_tree(digests):
    """The root and, for every leaf, its (left, right) sides."""
    level, at, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def manifest_of(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) by one pass over sorted rows."""
    groups = defaultdict(list)
    for d in docs:
        leaf = h(*[spelled(d[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])
        groups[d["lang"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf, d))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    sub = {}
    for n in names:
        groups[n].sort(key=lambda x: x[:3])
        sub[n] = folded_tree([x[2] for x in groups[n]])
    root, tops = folded_tree([sub[n][0] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        for (_, _, leaf, d), path in zip(groups[n], sub[n][1], strict=True):
            at = leaf
            if d["doc_id"] is not None and d["text"] and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0:
                low = d | {"text": "".join(c.lower() if c.isascii() else c for c in d["text"])}
                at = h(*[spelled(low[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])
            for left, right in path + top:
                at = h(left, at, right)
            proof = h("".join(a + b for a, b in path + top))
            out.append((d["doc_id"], leaf, sub[n][0], root, proof, at, at == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos int, TREE string, `digest.x` int"


def manifest_rows(spark, tmp_path, docs):
    frame = spark.createDataFrame([(*[d[k] for k in ("doc_id", "source", "lang", "n_chars", "text")], 1, "x", 2) for d in docs], DOCS)
    path = str(tmp_path / "sf")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted([tuple(r) for r in merkle.op11_merkle_manifest(spark, path).collect()], key=str)


@pytest.mark.parametrize("sizes", [{"en": 600, "de": 65, "ß": 8, "x": 1, None: 9}, {"en": 1}, {None: 3, "a": 1}])
def test_manifest_is_that_of_one_pass(spark, tmp_path, sizes):
    rng, docs = random.Random(5), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Long TEXT " * 2000, f"Ä Word {rng.random()}", "same"])
            docs.append({
                "doc_id": rng.choice([None, rng.randrange(400), rng.randrange(10**9)]), "source": rng.choice([None, "", "s:1"]),
                "lang": lang, "n_chars": rng.choice([None, -3, 10]), "text": text
            })
    docs += docs[:2]
    assert manifest_rows(spark, tmp_path, docs) == manifest_of(docs)


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest_rows(spark, tmp_path, []) == []


def test_manifest_of_many_groups(spark, tmp_path):
    docs = [{"doc_id": i, "source": "s", "lang": f"l{i % 70}", "n_chars": 1, "text": "T"} for i in range(150)]
    assert manifest_rows(spark, tmp_path, docs) == manifest_of(docs)


def negatives_of(rows, positives=5, negatives=10):
    """All (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by scores of all pairs."""
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out, order = [], lambda x: (-x[1], x[0] is None, x[0] or 0)
    for k, (i, v, label) in enumerate(held):
        if i is None or i % 100:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), o) for m, (j, w, o) in enumerate(held) if m != k]
        for p, ps, _ in sorted([x for x in scored if x[2] == label], key=order)[:positives]:
            near = [x for x in scored if x[2] != label and 30 * ps <= 100 * x[1] <= 90 * ps]
            out += [(i, p, r, n, ps, ns) for r, (n, ns, _) in enumerate(sorted(near, key=order)[:negatives], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, v string, ID int"


def vectors(kind):
    rng = np.random.default_rng(7)
    if kind == "random":
        v = rng.normal(0, 0.13, (700, 16))
    elif kind == "clustered":
        v = rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 700)] + rng.normal(0, 0.05, (700, 16))
    elif kind == "lengths":
        v = rng.normal(0, 1, (700, 8)) * rng.choice([0, 0.01, 0.3, 5], (700, 1))
    else:
        v = rng.normal(0, 1, (3, 4))[rng.integers(0, 3, 700)]
    rows = [(i, [float(x) for x in r], int(rng.integers(0, 4))) for i, r in enumerate(v)]
    rows[3] = (3, None, 1)
    rows[5] = (5, [None, 1.0], 1)
    rows[6] = (6, [math.nan] * 4, 1)
    rows[8] = (8, [math.inf, 1.0], 1)
    rows[9] = (9, rows[9][1], None)
    rows[11] = (11, [], 2)
    rows[12] = (12, rows[12][1][:2], 2)
    rows[13] = (None, rows[13][1], 0)
    rows[200] = (100, rows[100][1], rows[100][2])
    return rows


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths", "copies"])
def test_negatives_are_those_of_all_pairs(spark, kind):
    rows = vectors(kind)
    frame = spark.createDataFrame([(*r, "x", 4) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(frame, bucket=64, block=3).collect()
    assert sorted([tuple(r) for r in got], key=str) == negatives_of(rows)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(frame).collect() == []
    frame = spark.createDataFrame([(100, [1.0], 1, "x", 1), (200, None, 1, "x", 1)], VECTORS)
    assert hard_negatives.hard_negatives(frame).collect() == []


def test_coordinates_prune_and_lose_nothing():
    """In clusters, few rows outside the anchor's own are scored, and every row that reaches the bound is."""
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 2000)] + rng.normal(0, 0.02, (2000, 16))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None])
    unit, length = hard_negatives.units(v)
    b = object.__new__(hard_negatives.Bucket)
    b.v, b.unit, b.order, b.least, b.most = v, unit, np.argsort(unit, axis=0).T, length.min(), length.max()
    full = v[:50] @ v.T
    least = np.sort(full, axis=1)[:, -20]
    found, scored = hard_negatives.scores(v[:50], least, b)
    assert (found[full >= least[:, None]] == full[full >= least[:, None]]).all()
    assert scored < 0.25 * full.size


def test_products_that_are_not_exact_are_refused():
    b = object.__new__(hard_negatives.Bucket)
    b.v = np.full((1, 2), 2.0**27)
    b.unit, length = hard_negatives.units(b.v)
    b.order, b.least, b.most = np.zeros((2, 1), int), length.min(), length.max()
    with pytest.raises(ArithmeticError):
        hard_negatives.scores(b.v, np.zeros(1), b)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    held = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in held) > len(held))


def classes_of(rows, distance=3):
    """doc_id -> least doc_id reachable, by all pairs."""
    fp = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= distance:
                label[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, f"{f:016x}", least.get(top(i))) for i, ((k, _), f) in enumerate(zip(rows, fp, strict=True))), key=str)


def texts():
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{k}" for k in range(900)], k=rng.randint(1, 400))) for _ in range(60)]
    out = [None, "", " \t\r\n", "One  two", "one\ttwo", "É word", "one two three", "x" * 3_000_000]
    for t in base:
        out.append(t)
        for k in (1, 1, 2, 5):
            c = t.split()
            for _ in range(k):
                c[rng.randrange(len(c))] = f"n{rng.randrange(99)}"
            out.append("\n".join(c))
    out += [base[0].upper()] * 40 + [" ".join(rng.choices(["lorem", "ipsum", "Dolor"], k=500_000))]
    rows = [(None if i % 41 == 40 else 5 * (i // 3) if i % 17 == 0 else i, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_classes_are_those_of_all_pairs(spark, limit):
    rows = texts()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, FP int").repartition(4)
    got = simhash.simhash_groups(frame, limit=limit).collect()
    assert sorted([tuple(r) for r in got], key=str) == classes_of(rows)


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limit", [4096, 20])
def test_no_link_is_lost_in_a_dense_cloud(spark, limit):
    """Thousands of fingerprints around a few points, so that some anchors are hot, and single links at distance 3."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(1500)], np.uint64)
    fp = np.unique(np.r_[centre[rng.integers(0, 3, 1500)] ^ flips, centre, centre ^ flips[:40]])
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(rows, limit=limit, work=None).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    a, b = np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    x, y = np.nonzero(near)
    assert (simhash.least_reached(a, b, len(fp)) == simhash.least_reached(x, y, len(fp))).all()


def test_every_value_is_near_one_codeword():
    pattern, begin, far = simhash.error_patterns(3)
    assert len(pattern) == 1 << 11 and (np.diff(begin) == 1).all() and not far.any()


def test_stored_tables_are_in_the_shared_folder(spark):
    found = stored(spark.range(3).withColumn("x", F.lit(1)))
    assert "opinara-" in found.inputFiles()[0]
