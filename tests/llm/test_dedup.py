"""Exact, near and line duplicates against brute force, with hot groups, ties and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opinara.llm import exact_dedup, line_dedup, near_dedup
from opinara.llm.common import numbered, table


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    out = [None, "", " \t\n", "a b", "A  b", "ab", "a b"]
    base = [prose(rng, rng.randint(3, 160)) for _ in range(40)]
    passage = prose(rng, 60)
    out += base + base[:10] + [t.upper() for t in base[:5]]
    for t in base:
        w = t.split()
        for k in (1, 2, 4):
            c = list(w)
            for _ in range(k):
                c[rng.randrange(len(c))] = "zz" + str(rng.randrange(99))
            out.append(" ".join(c))
    out += [passage + " " + prose(rng, 10) for _ in range(40)] + ["one hot text of six words"] * 90
    out.append(prose(rng, 30_000))
    out.append(out[-1] + " end")
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[j]) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", True, "y") for i, t in docs], "doc_id long, text string, component string, kept boolean, name string").repartition(5)


def test_exact_groups(frame, docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i))
    want = {}
    for own, members in groups.items():
        for _, i in members:
            want[i] = (min(members)[1], len(members), min(members)[1] == i, hashlib.sha256(own.encode()).hexdigest())
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(frame).collect()}
    assert got == want


def test_exact_groups_with_clashing_names(frame, docs):
    """Names of two bits clash everywhere; the bytes still tell."""
    weak = lambda c: F.struct((F.xxhash64(c) % 2).alias("a"), F.lit(0).cast("long").alias("b"))
    good = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(frame).collect()}
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(frame, name=weak).collect()} == good


def test_chunks_are_the_text_and_shift(spark):
    rng = random.Random(1)
    t = prose(rng, 3000).replace(" ", ".")
    df = spark.createDataFrame([(1, t), (2, "zz" + t)], "doc_id long, text string")
    a, b = ([c for c in r[0]] for r in df.orderBy("doc_id").select(exact_dedup.chunks_of(F.col("text"))).collect())
    assert "".join(a) == t and "".join(b) == "zz" + t and len(a) > 4 and len(set(a) & set(b)) >= len(a) - 2


def test_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "ab"), (None, "c"), (None, "c"), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(None, None, 2, True), (3, None, 2, False), (None, None, 2, True), (None, None, 2, False), (5, 5, 1, True)], key=str)
    near = near_dedup.near_groups(df)
    assert near.count() == 5 and [r["component_id"] for r in near.filter("doc_id = 3").collect()] == [3]
    assert line_dedup.deduplicate_lines(df).count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_one_row_of_each_group_stays(spark, seed):
    """Repeated and missing ids, with equal and with different originals: each group keeps one row, the longest, then least."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, None, 1, 1, 2, 3]), rng.choice(["x y", "x  y", "xy", "z", " z", "", None])) for _ in range(40)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        _, none, first = min(groups[r["text_sha256"]])
        assert r["keep_id"] == (None if none else first) and r["group_size"] == len(groups[r["text_sha256"]])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_rows_are_numbered_alike_in_every_reading(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(1000).select("id", F.lit("x").alias("text")).repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = numbered(docs, "n")
    one, two = ({r["id"]: r["n"] for r in rows.repartition(k).collect()} for k in (1, 5))
    assert one == two and len(set(one.values())) == 1000
    for other in (docs.withColumn("_metadata", F.lit(1)), docs.unionByName(docs), spark.range(5).toDF("id")):
        ids = numbered(other, "n")
        assert ids.columns == [*other.columns, "n"] and ids.select("n").distinct().count() == other.count()
    assert numbered(docs.limit(0), "n").isEmpty()


def test_empty_tables(frame):
    none = frame.limit(0)
    assert exact_dedup.exact_groups(none).isEmpty() and near_dedup.near_groups(none).isEmpty() and line_dedup.deduplicate_lines(none).isEmpty()


def brute_components(docs, words, similarity=80):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, k in common.items():
            if 100 * k >= similarity * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(frame, docs, words):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(frame, words=words).collect()}
    assert got == brute_components(docs, words)


def test_near_groups_of_documents(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op7_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in d.collect()], 4)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pairs_cross_components_only(spark):
    """The prefix join finds links that bands may miss, between components and nowhere else."""
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(1, 11))), (3, list(range(100, 110))), (4, list(range(10)))], "id long, shingles array<long>")
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "id long, component long")
    pairs = {tuple(sorted(r)) for r in near_dedup.cross_pairs(sets, labels, 80).collect()}
    assert {(1, 2), (2, 4)} >= pairs and pairs and {tuple(sorted(r)) for r in held_against(spark, [(1, 2), (1, 3)])} == {(1, 2)}


def held_against(spark, pairs):
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "A  b c d e f g h i"), (3, "a b c"), (4, "j k")], "id long, text string")
    return near_dedup.confirmed(spark.createDataFrame(pairs, "a long, b long"), texts, 1, 80).collect()


def test_a_centre_meets_all_its_members(spark, monkeypatch):
    """A centre's members are dealt over tasks, each with its own copy of the centre."""
    monkeypatch.setattr(near_dedup, "TOGETHER", 2)
    members = [(k, "a b c d e f g h i j " + "x " * (k % 2 * 5 + 1) + f"y{k}" * (k % 2)) for k in range(2, 30)]
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), *members], "id long, text string").repartition(4)
    found = near_dedup.confirmed(spark.createDataFrame([(1, k) for k, _ in members], "a long, b long"), texts, 1, 85).collect()
    assert sorted(tuple(r) for r in found) == [(1, k) for k, _ in members if k % 2 == 0]


def pieces_of(t):
    """The pieces of a text by their rule: 16 to 63 characters up to a mark or letter that ends a word, if a gap follows; else
    64 characters and the rest of their word, if a gap follows; else the rest of the line."""
    out, gap = [], " \t\x0b\f\r"
    while t:
        line = t[: (t.find("\n") + 1 or len(t) + 1) - 1]
        ends = [j + 1 for j in range(16, min(64, len(line))) if line[j] in ".!?,;:|dglnry" and line[j + 1 : j + 2] in tuple(gap)]
        k = 64
        while len(line) > k and line[k] not in gap:
            k += 1
        if ends:
            end = ends[0]
        elif len(line) > k:
            end = k
        else:
            end = len(line) + 1
        while end < len(line) and line[end] in gap:
            end += 1
        out.append(t[:end])
        t = t[end:]
    return out


def chunks_by_hand(t):
    pieces, start, out = pieces_of(t), 0, []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in pieces]
    r = [None] + [(h[i - 1] * 31 + h[i]) % 1_000_003 for i in range(1, len(h))]
    for i in range(len(pieces)):
        low = 1 < i < len(pieces) - 2 and r[i] < r[i - 1] and r[i] <= r[i + 1]
        if i == len(pieces) - 1 or low:
            out.append((i + 1 - start, "".join(pieces[start : i + 1])))
            start = i + 1
    return out


def shared(own, other, tail):
    """Characters of the equal words that both begin with, or end with."""
    a, b = (re.findall(r"[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+", t) for t in (own, other))
    if tail:
        a, b = a[::-1], b[::-1]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    if tail and n and a[n - 1].isspace():
        n -= 1
    return len("".join(a[:n]))


def lines_by_hand(rows):
    """rows in their order of precedence -> (text, characters, removed ones) of each."""
    cut = [chunks_by_hand(t or "") for t in rows]
    first, gone = {}, set()
    for d, own in enumerate(cut):
        for k, (n, c) in enumerate(own):
            if n > 1 and len(c) >= 32 and re.search(r"[^ \t\n\r\f\v]", c):
                if c in first:
                    gone.add((d, k))
                else:
                    first[c] = d, k
    head, tail = defaultdict(int), defaultdict(int)
    for d, k in gone:
        e, j = first[cut[d][k][1]]
        for step, size in ((1, head), (-1, tail)):
            if 0 <= k + step < len(cut[d]) and 0 <= j + step < len(cut[e]) and (d, k + step) not in gone:
                size[d, k + step] = shared(cut[d][k + step][1], cut[e][j + step][1], step < 0)
    out = []
    for d, t in enumerate(rows):
        kept = [c[head[d, k] : max(head[d, k], len(c) - tail[d, k])] for k, (_, c) in enumerate(cut[d]) if (d, k) not in gone]
        left = "".join(kept)
        out.append((None if t is None else left, len(t or ""), len(t or "") - len(left)))
    return out


@pytest.fixture(scope="module")
def line_texts():
    rng = random.Random(2)
    block = [prose(rng, 6) for _ in range(12)]
    texts = [None, "", "\n\n\n", "one line", "  led by gaps, and. more ", " ", "x" * 5000, "x" * 5000, ", ".join(["a"] * 90), " " * 300]
    texts += ["one piece of thirty-five characters", "one piece of thirty-five characters"]
    for _ in range(25):
        lines = [prose(rng, 5) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice(["\n", ". ", ", ", " \x01\x02\x04"]).join(lines + block[: rng.randint(6, 12)] + [prose(rng, 5)]))
    return texts


def test_lines_against_brute_force(spark, line_texts):
    want = lines_by_hand(line_texts)
    df = spark.createDataFrame([(i, t, 1, "g", 3, "n") for i, t in enumerate(line_texts)], "doc_id long, text string, at int, gone string, row int, name string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["n_removed"]) for r in line_dedup.deduplicate_lines(df).collect()}
    plain = {i for i, t in enumerate(line_texts) if "\x01" not in (t or "")}  # escaped pieces hash otherwise
    assert {i: got[i] for i in plain} == {i: want[i] for i in plain} and any(v[2] for v in want)
    for i, t in enumerate(line_texts):  # what is left is the text less whole runs of it
        left = iter(t or "")
        assert all(c in left for c in got[i][0] or "") and len(got[i][0] or "") == got[i][1] - got[i][2]


def test_lines_with_clashing_names(spark, line_texts):
    """Names of two bits clash everywhere; the bytes still tell."""
    weak = lambda c: F.xxhash64(c) % 2
    df = spark.createDataFrame(list(enumerate(line_texts[10:22])), "doc_id long, text string").repartition(3)
    good = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df).collect()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df, name=weak).collect()} == good


def test_lines_of_repeated_and_missing_ids(spark):
    """Rows of one id with two texts lose nothing to each other; of repeated rows one keeps what the others lose."""
    rng = random.Random(8)
    one, two, three = (prose(rng, 90) for _ in range(3))
    rows = [(1, one), (1, two), (2, two + " " + three), (2, two + " " + three), (None, one), (None, None), (3, prose(rng, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.deduplicate_lines(df).collect()]
    assert sorted((t for i, t, n in got if i == 1), key=str) == sorted([one, two], key=str) and all(n == 0 for i, _, n in got if i in (1, 3))
    a, b = sorted(n for i, _, n in got if i == 2)
    assert 0 < a < b and [n for i, t, n in got if i is None and t is not None][0] > 50 and len(got) == len(rows)


@pytest.mark.parametrize("joint", [" ", "\n"])
def test_passages_inside_lines_are_found(spark, joint):
    """Of passages of over 50 words that two documents share at any place, nearly all are removed from the second, in good
    part; documents without one keep all."""
    rng = random.Random(11)
    marks = lambda n: " ".join(w + rng.choice(["", "", "", "", ",", ".", "."]) for w in prose(rng, n).split())
    rows, n, lengths = [], 60, []
    for k in range(n):
        passage = marks(rng.randint(51, 90))
        lengths.append(len(passage.split()))
        for i in (2 * k, 2 * k + 1):
            w = marks(rng.randint(60, 200)).split()
            at = rng.randrange(len(w))
            rows.append((i, " ".join(w[:at]) + joint + passage + joint + " ".join(w[at:])))
    rows += [(1000 + k, marks(150)) for k in range(40)]
    out = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = [len(text[i].split()) - len(out[i]["text"].split()) for i in range(1, 2 * n, 2)]
    assert sum(x > 0 for x in found) >= 0.9 * n and sum(found) > 0.8 * sum(lengths)
    assert all(out[i]["text"] == text[i] for i in [*range(0, 2 * n, 2), *range(1000, 1040)])


def test_near_groups_of_repeated_rows(spark, docs):
    """Every row twice, and rows without an id: nothing is lost."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 4)
    got = near_dedup.near_groups(df.union(df).repartition(5), words=4).collect()
    assert len(got) == 2 * len(docs) and {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_near_groups_of_ids_with_two_texts(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    near = text["a"].replace("a39", "zz")
    rows = [(5, text["a"]), (5, text["b"]), (7, near), (None, text["b"]), (None, text["c"]), (None, text["c"]), (2, None), (2, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()), key=str)
    assert got == sorted([(5, 37, 5, True), (5, 37, 5, True), (7, 37, 5, False), (None, 37, 5, False), (None, 37, None, True), (None, 37, None, True), (2, 0, 2, True), (2, 0, 2, True)], key=str)


@pytest.mark.parametrize(("lines", "words", "least"), [(1, 60, 0.8), (2, 30, 0.85), (3, 20, 0.85), (6, 20, 0.9), (10, 10, 0.85)])
def test_planted_runs_of_lines_go_whole(spark, lines, words, least):
    """Of runs of lines that two documents share between other lines, the second loses nearly all words, and no others."""
    rng = random.Random(lines)
    marks = lambda n: " ".join(w + rng.choice(["", "", "", ",", "."]) for w in prose(rng, n).split())
    rows, run = [], {}
    for k in range(60):
        run[k] = [marks(words) for _ in range(lines)]
        for i in (2 * k, 2 * k + 1):
            own = [marks(words) for _ in range(rng.randint(4, 9))]
            at = rng.randint(0, len(own))
            rows.append((i, "\n".join(own[:at] + run[k] + own[at:])))
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    lost = [len(text[i].split()) - len(out[i].split()) for i in range(1, 120, 2)]
    assert sum(lost) >= least * 60 * lines * words and max(lost) <= lines * words + 1
    assert all(out[i] == text[i] for i in range(0, 120, 2))


def test_line_dedup_moves_texts_as_strings(spark):
    """Texts meet what they lose as one string each, without the chunks that are removed anyway."""
    df = spark.createDataFrame([(["a", "b", "c", "d"], [1, 2])], "c array<string>, g array<int>")
    assert df.select(line_dedup.blanked(F.col("c"), F.col("g")).alias("x")).first()["x"] == ["a", "", "", "d"]
    same = "The first line of the passage, in plain words.\nThe second line, longer by a good few words; it ends here.\n" * 3
    docs = spark.createDataFrame([(1, "One. " + same + "tail"), (2, "Two. " + same + "end")], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup.deduplicate_lines(docs)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.split("\n\n") if ") Exchange" in x.strip().split("\n")[0]]
    assert moved and not any("chunks" in x for x in moved)
