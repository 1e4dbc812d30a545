"""Rating streams: item-kNN, bias means, ALS factors, negatives, out-of-fold predictions, a text sentiment model."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .interactions import dense_ids, fold
from .scoring import without_summary


def mean_ratings(train: DataFrame, user: str = "user_id", item: str = "business_id") -> DataFrame:
    """One rating per user and item: their mean."""
    return train.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.avg("stars").alias("r"))


#: Similarities of two rating vectors over the raters both have, from n, sums, products and squares.
SIMILARITIES: dict[str, Callable[[], Column]] = {
    "cosine": lambda: F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")),
    "pearson": lambda: F.coalesce(
        F.try_divide(
            F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"),
            F.sqrt(
                F.greatest(F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"), F.lit(0.0))
            ) * F.sqrt(F.greatest(F.col("n") * F.col("yy") - F.col("sy") * F.col("sy"), F.lit(0.0)))
        ),
        F.lit(0.0)
    ),
    "msd": lambda: 1 / ((F.col("xx") - 2 * F.col("xy") + F.col("yy")) / F.col("n") + 1),
}
#: Pairs that a task compares, about.
PAIRS = 4_000_000
#: Items of a user that travel in one row; users of more have several rows.
HEAVY = 512


def item_similarity(
    ratings: DataFrame, wanted: DataFrame | None = None, kind: str = "cosine", least: int = 1
) -> DataFrame:
    """(i, j, sim): cosine, pearson or msd over the users that rated both, ``least`` at least; wanted restricts j.

    Each unordered pair is summed once, in the task of its greater item, and then given both ways. A rating meets its user's
    lesser items as lists of at most ``HEAVY``; pairs come of them after the lists have moved, so no pair is sent. ratings:
    (u, i, r).
    """
    flagged = ratings.withColumn("w", F.lit(True)) if wanted is None else ratings.join(
        wanted.select("i", F.lit(True).alias("w")).distinct(), "i", "left"
    ).withColumn("w", F.coalesce("w", F.lit(False)))
    known = flagged.filter("u IS NOT NULL AND i IS NOT NULL")
    placed = known.join(known.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u")
    piece = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / HEAVY))
    lists = stored(
        placed.groupBy("u", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("i", "r", "w"))).alias("l"))
    )
    sizes = lists.groupBy("u").agg(F.sum(F.size("l")).cast("double").alias("n"))
    parts = int((sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) / PAIRS) + 1
    parts = max(parts, ratings.sparkSession.sparkContext.defaultParallelism)
    lists = lists.select("u", "l").repartition(parts, "u")
    # Lists of items, ratings and flags apart: alike values stand together and pack well.
    both = lists.select("u", F.explode("l").alias("e")).join(lists.hint("merge"), "u").select(
        F.col("e.i").alias("j"), F.col("e.r").alias("y"), F.col("e.w").alias("wj"),
        F.filter("l", lambda x: (x["i"] < F.col("e.i")) & (x["w"] | F.col("e.w"))).alias("l")
    ).filter(F.size("l") > 0).select(
        "j", "y", "wj", F.col("l.i").alias("i"), F.col("l.r").alias("x"),
        *([] if wanted is None else [F.col("l.w").alias("wi")])
    ).repartition(parts, "j")
    columns = ["i", "x"] if wanted is None else ["i", "x", "wi"]
    each = both.select("j", "y", "wj", F.explode(F.arrays_zip(*columns)).alias("p")).select("j", "y", "wj", "p.*")
    if wanted is None:
        each = each.withColumn("wi", F.lit(True))
    products = {"xy": ("x", "y"), "xx": ("x", "x"), "yy": ("y", "y")}
    sums = each.groupBy("j", "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        *[F.sum(F.col(p) * F.col(q)).alias(k) for k, (p, q) in products.items()], F.first("wi").alias("wi"),
        F.first("wj").alias("wj")
    )
    ways = F.array(
        F.struct(F.col("i"), F.col("j"), F.col("wj").alias("w")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("wi").alias("w"))
    )
    return sums.filter(F.col("n") >= least).select(
        SIMILARITIES[kind]().alias("sim"), F.explode(ways).alias("p")
    ).filter("p.w").select("p.i", "p.j", "sim")


def _similarity(kind: str, n, sx, sy, xy, xx, yy) -> np.ndarray:
    """SIMILARITIES over arrays of sums; not a number where there is none."""
    with np.errstate(all="ignore"):
        if kind == "cosine":
            return xy / (np.sqrt(xx) * np.sqrt(yy))
        if kind == "msd":
            return 1 / ((xx - 2 * xy + yy) / n + 1)
        below = np.sqrt(np.maximum(n * xx - sx * sx, 0)) * np.sqrt(np.maximum(n * yy - sy * sy, 0))
        return np.where(below > 0, (n * xy - sx * sy) / below, 0.0)


#: What a packed list is: width and number of its parts and its first id in one number, steps to the next ids, codes and values.
_PACKED = ["meta", "steps", "codes", "levels"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (u, ids, xs), ids ascending, with _PACKED beside them: steps of as few bytes as the list's longest needs, and of
    each x the place among the list's distinct values, half a byte where there are 16 at most."""
    for batch in batches:
        size = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
        ends, ids, xs = np.cumsum(size), batch.column("ids").flatten().to_numpy(), batch.column("xs").flatten().to_numpy()
        out = []
        for end, n in zip(ends, size, strict=True):
            own, step = ids[end - n : end], np.diff(ids[end - n : end]).astype("<u4")
            width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
            levels, code = np.unique(xs[end - n : end], return_inverse=True)
            kind = 0 if len(levels) <= 16 else 1 if len(levels) <= 256 else 4
            if kind:
                code = code.astype(f"<u{kind}")
            else:
                code = np.append(code, [0] * (n % 2)).astype("u1")
                code = code[::2] | code[1::2] << 4
            out.append((
                int(own[0]) << 32 | int(n) << 8 | kind << 3 | width, step.view("u1").reshape(-1, 4)[:, :width].tobytes(),
                code.tobytes(), levels
            ))
        meta, steps, codes, levels = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns, pa.array(meta, pa.int64()), pa.array(steps, pa.binary()), pa.array(codes, pa.binary()),
                pa.array(levels, pa.list_(pa.float64()))
            ],
            [*batch.schema.names, *_PACKED]
        )


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids and xs of a batch's packed lists, one after the other, and the lists' sizes; all lists at once."""
    meta = batch.column("meta").to_numpy()
    size, kind, width = meta >> 8 & 0xFFFFFF, meta >> 3 & 7, meta & 7
    row = np.repeat(np.arange(len(meta)), size)
    start = np.cumsum(size) - size
    step, code = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    later = np.ones(len(row), bool)
    later[start] = False
    raw = lambda name, rows: np.frombuffer(b"".join(batch.column(name).take(pa.array(rows)).to_pylist()), "u1")
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        some = raw("steps", rows).reshape(-1, w)
        whole = np.zeros((len(some), 4), "u1")
        whole[:, :w] = some
        step[later & (width == w)[row]] = whole.view("<u4").ravel()
    for k in np.unique(kind):
        rows, own = np.flatnonzero(kind == k), (kind == k)[row]
        some = raw("codes", rows)
        if k:
            code[own] = some.view(f"<u{k}")
        else:
            both, n = np.stack([some & 15, some >> 4], 1).ravel(), size[rows]
            filled = np.ones(len(both), bool)
            filled[(np.cumsum(n + n % 2) - 1)[n % 2 == 1]] = False
            code[own] = both[filled]
    ids = np.cumsum(step)
    ids += np.repeat((meta >> 32) - ids[start], size)
    levels = batch.column("levels")
    many = levels.value_lengths().to_numpy(zero_copy_only=False)
    return ids, levels.flatten().to_numpy()[np.repeat(np.cumsum(many) - many, size) + code], size


def _search(kind: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (test, key, j, y, packed list of ids and xs), those with test first: the k most similar of the ids of each test row.

    The pairs that test rows ask for are held, and sums for them alone; other rows, a rating y of j beside ratings xs of ids by
    the same user, pass by.
    """

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, size = _unpack(batch)
        return np.repeat(batch.column("j").to_numpy(), size) << 32 | ids, x, size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked, given, askers, wanted, sums, n_keys = [], [], [], [], None, None, 0
        for batch in batches:
            own = batch.filter(batch.column("test"))
            if own.num_rows:
                pair, x, size = pairs(own)
                others = pair >> 32 != pair & 0xFFFFFFFF  # an item is no neighbour of its own
                keys.append(own.column("key")), asked.append(pair[others]), given.append(x[others])
                askers.append((n_keys + np.repeat(np.arange(own.num_rows), size))[others])
                n_keys += own.num_rows
            rest = batch.filter(pc.invert(batch.column("test")))
            if not asked or not rest.num_rows:
                continue
            if wanted is None:
                wanted = np.unique(np.concatenate(asked))
                sums = np.zeros((6, len(wanted)))
            if not len(wanted):
                return
            pair, x, size = pairs(rest)
            at = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            hit = wanted[at] == pair
            at, x, y = at[hit], x[hit], np.repeat(rest.column("y").to_numpy(), size)[hit]
            for s, v in zip(sums, (None, x, y, x * y, x * x, y * y), strict=True):
                s += np.bincount(at, v, len(wanted))
        if sums is None:
            return
        pair, x = np.concatenate(asked), np.concatenate(given)
        # A user of several pieces has several rows of one key.
        key = pa.chunked_array(keys).combine_chunks().dictionary_encode()
        row, names = key.indices.to_numpy()[np.concatenate(askers)], key.dictionary
        at = np.searchsorted(wanted, pair)
        sim = np.where(sums[0][at] > 0, _similarity(kind, *sums)[at], np.nan)
        good = sim > 0
        row, item, x, sim = row[good], pair[good] & 0xFFFFFFFF, x[good], sim[good]
        order = np.lexsort((item, -np.round(sim, 9), row))
        row, item, x, sim = row[order], item[order], x[order], sim[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
        top = np.flatnonzero(rank <= k)
        for start in range(0, len(top), 100_000):
            t = top[start:start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(row[t])), pa.array(item[t]), pa.array(sim[t]), pa.array(x[t]), pa.array(rank[t], pa.int32())],
                ["key", "id", "sim", "r", "rank"]
            )

    return search


def _ranked(
    train: DataFrame, rows: DataFrame, k: int, key: str, kind: str, user_based: bool
) -> tuple[DataFrame, DataFrame]:
    """(key, id, sim, r, rank) as in top_neighbours, with the items' numbers, and the table (i, id) of these.

    All that concerns an item j meets in one task: the lists of its raters' items, and the lists of the users of rows that ask
    for it. Pairs are summed there, those alone that a row asks for, and never travel; packed lists of numbers do.
    """
    spark = train.sparkSession
    user, item = ("business_id", "user_id") if user_based else ("user_id", "business_id")
    known = mean_ratings(train, user, item).filter("u IS NOT NULL AND i IS NOT NULL AND r IS NOT NULL")
    ids = stored(dense_ids(known, "i"))
    rated = known.join(ids, "i").select("u", F.col("id").cast("int").alias("id"), "r")
    placed = rated.join(rated.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u")
    piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / HEAVY))
    lists = stored(
        placed.groupBy("u", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("id", "r"))).alias("l")).select(
            "u", F.col("l.id").alias("ids"), F.col("l.r").alias("xs")
        ).mapInArrow(
            _pack, f"u {rated.schema['u'].dataType.simpleString()}, ids array<int>, xs array<double>, meta long, steps binary, "
            f"codes binary, levels array<double>"
        )
    )
    own = rows.select(F.col(key).alias("key"), F.col(user).alias("u"), F.col(item).alias("i")).join(ids, "i").select(
        "key", "u", F.col("id").alias("j")
    )
    sizes = lists.groupBy("u").agg(F.sum(F.size("ids")).cast("double").alias("n"))
    parts = int((sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) / PAIRS) + 1
    parts = max(parts, spark.sparkContext.defaultParallelism)
    lists = lists.repartition(parts, "u")
    ratings = lists.select("u", F.explode(F.arrays_zip("ids", "xs")).alias("e")).select(
        "u", F.col("e.ids").cast("long").alias("j"), F.col("e.xs").alias("y")
    )
    kind_of = own.schema["key"].dataType
    # Sides are dealt by user into as many parts as pairs need, so that the rows that come of them are not spilled.
    seen = ratings.join(lists.hint("merge"), "u").select(
        F.lit(False).alias("test"), F.lit(None).cast(kind_of).alias("key"), "j", "y", *_PACKED
    )
    asking = own.repartition(parts, "u").join(lists.hint("merge"), "u").select(
        F.lit(True).alias("test"), "key", "j", F.lit(0.0).alias("y"), *_PACKED
    )
    met = asking.unionByName(seen).repartition(parts, "j").sortWithinPartitions(F.desc("test"))
    found = met.mapInArrow(
        _search(kind, k), f"key {kind_of.simpleString()}, id long, sim double, r double, rank int"
    )
    return found.withColumnRenamed("key", key), ids


def top_neighbours(
    train: DataFrame, rows: DataFrame, k: int = 40, key: str = "review_id", kind: str = "cosine",
    user_based: bool = False
) -> DataFrame:
    """(key, i, sim, r, rank): the user's k rated items most similar to the row's item, ties by item.

    user_based swaps the roles: the k users most similar to the row's user among those who rated its item. Keys are unique.
    """
    found, ids = _ranked(train, rows, k, key, kind, user_based)
    return found.join(ids, "id").select(key, "i", "sim", "r", "rank")


def item_knn(
    train: DataFrame, rows: DataFrame, k: int = 40, min_k: int = 1, key: str = "review_id", kind: str = "cosine",
    user_based: bool = False
) -> DataFrame:
    """rows with prediction and fallback_kind: mean of the ratings of the k most similar items (or users), weighted by
    similarity. Rows with fewer than min_k positive neighbours get the train mean.
    """
    top, _ = _ranked(train, rows, k, key, kind, user_based)
    found = top.groupBy(key).agg(
        F.sum(F.col("sim") * F.col("r")).alias("sr"), F.sum("sim").alias("s"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= min_k)
    mean = train.agg(F.avg("stars").alias("_mean"))
    out = rows.join(found.select(key, (F.col("sr") / F.col("s")).alias("_p")), key, "left").crossJoin(F.broadcast(mean))
    return out.withColumn(
        "fallback_kind", F.when(F.col("_p").isNull(), "global_mean").otherwise("none")
    ).withColumn("prediction", F.coalesce("_p", "_mean")).drop("_p", "_mean")


#: Rows of mean stars that an item's bias counts beside its own, and a user's.
DAMP_ITEM, DAMP_USER = 10.0, 15.0


def bias_means(train: DataFrame, rows: DataFrame, damp_item: float = DAMP_ITEM, damp_user: float = DAMP_USER) -> DataFrame:
    """rows with baseline = mean + item bias + user bias, each damped towards 0; unknown ones have none."""
    mean = train.agg(F.avg("stars").alias("_m"))
    t = train.select("user_id", "business_id", "stars").crossJoin(F.broadcast(mean))
    bi = t.groupBy("business_id").agg(
        (F.sum(F.col("stars") - F.col("_m")) / (F.count(F.lit(1)) + damp_item)).alias("_bi")
    )
    bu = t.join(bi, "business_id").groupBy("user_id").agg(
        (F.sum(F.col("stars") - F.col("_m") - F.col("_bi")) / (F.count(F.lit(1)) + damp_user)).alias("_bu")
    )
    out = rows.join(bi, "business_id", "left").join(bu, "user_id", "left").crossJoin(F.broadcast(mean))
    return out.withColumn(
        "baseline", F.col("_m") + F.coalesce("_bi", F.lit(0.0)) + F.coalesce("_bu", F.lit(0.0))
    ).drop("_m", "_bi", "_bu")


def bias_out_of_fold(
    train: DataFrame, rows: DataFrame | None = None, k: int = 5, seed: int = 42, key: str = "review_id",
    damp_item: float = DAMP_ITEM, damp_user: float = DAMP_USER, wide: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """out_of_fold of bias_means over train, with fold, and bias_means of all of train for rows.

    The sums of all these models are taken at once, a column for each, so that a row goes to its item and to its user once,
    however many folds there are. wide: train with more columns, which comes out in its place; sums are of train alone.
    """
    models = range(k + 1)  # the last one is of all rows
    inside = [F.col("fold") != m for m in range(k)] + [F.lit(True)]
    folded = train.select("user_id", "business_id", "stars", fold(key, k, seed).alias("fold"))
    found = folded.agg(*[F.avg(F.when(inside[m], F.col("stars"))).alias(f"_m{m}") for m in models]).first()
    mean = [F.lit(v).cast("double") for v in found]
    items = stored(
        folded.groupBy("business_id").agg(
            *[
                (F.sum(F.when(inside[m], F.col("stars") - mean[m])) /
                 (F.count_if(inside[m]) + damp_item)).alias(f"_i{m}") for m in models
            ]
        )
    )
    placed = stored(
        (train if wide is None else wide).withColumn("fold", fold(key, k, seed)).join(items, "business_id", "left")
    )
    users = stored(
        placed.filter("business_id IS NOT NULL").groupBy("user_id").agg(
            *[
                (F.sum(F.when(inside[m], F.col("stars") - mean[m] - F.col(f"_i{m}"))) /
                 (F.count_if(inside[m]) + damp_user)).alias(f"_u{m}") for m in models
            ]
        )
    )

    def baseline(m: int) -> Column:
        return mean[m] + F.coalesce(f"_i{m}", F.lit(0.0)) + F.coalesce(f"_u{m}", F.lit(0.0))

    own = F.coalesce(*[F.when(F.col("fold") == m, baseline(m)) for m in range(k)])
    out = placed.join(users, "user_id", "left").withColumn("baseline", own).drop(
        *[f"_{side}{m}" for side in "iu" for m in models]
    )
    if rows is None:
        return out, None
    known = rows.join(items.select("business_id", f"_i{k}"), "business_id", "left").join(
        users.select("user_id", f"_u{k}"), "user_id", "left"
    )
    return out, known.withColumn("baseline", baseline(k)).drop(f"_i{k}", f"_u{k}")


def als_stream(
    train: DataFrame, rows: DataFrame, users: DataFrame, items: DataFrame, rank: int = 16, reg: float = 0.1,
    iterations: int = 8, seed: int = 42, fallback: str = "train_mean", target: str = "stars"
) -> DataFrame:
    """rows with prediction of an ALS model of train; users and items are dense id tables (column, id) of train alone.

    Rows of unknown users or items get the train mean, or the scale's midpoint if fallback is midpoint, or 0 if the target
    is what a baseline leaves.
    """
    return als_fitted(train, users, items, rank, reg, iterations, seed, fallback, target)(rows)


def als_fitted(
    train: DataFrame, users: DataFrame, items: DataFrame, rank: int = 16, reg: float = 0.1, iterations: int = 8,
    seed: int = 42, fallback: str = "train_mean", target: str = "stars"
) -> Callable[[DataFrame], DataFrame]:
    """als_stream of one model for any rows."""
    fit = stored(numbered(train.select("user_id", "business_id", target), users, items, "inner").select("_u", "_i", target))
    mean = F.lit(3.0) if fallback == "midpoint" else F.lit(0.0) if fallback == "baseline" else F.lit(
        train.agg(F.avg(target)).first()[0]
    )
    stream = _als_numbered(fit, rank, reg, iterations, seed, target)
    return lambda rows: stream(numbered(rows, users, items), fallback, mean)


def numbered(rows: DataFrame, users: DataFrame, items: DataFrame, how: str = "left") -> DataFrame:
    """rows with the numbers _u and _i of their users and items; users and items are dense id tables (column, id)."""
    return rows.join(users.withColumnRenamed("id", "_u"), "user_id", how).join(
        items.withColumnRenamed("id", "_i"), "business_id", how
    ).withColumn("_u", F.col("_u").cast("int")).withColumn("_i", F.col("_i").cast("int"))


def als_rated(rows: DataFrame, users: DataFrame, items: DataFrame, how: str = "left") -> DataFrame:
    """(_u, _i, stars) of rows, written: what candidates of ALS settings read again and again."""
    return stored(numbered(rows.select("user_id", "business_id", "stars"), users, items, how).select("_u", "_i", "stars"))


def als_candidates(
    train: DataFrame, val: DataFrame, users: DataFrame, items: DataFrame
) -> Callable[..., tuple[Callable[[DataFrame], DataFrame], float | None]]:
    """A function of rank, reg, iterations and seed: als_fitted of train for numbered rows, and its RMSE on val.

    Rows are numbered once for all settings.
    """
    fit, checked = als_rated(train, users, items, "inner"), als_rated(val, users, items)
    mean = F.lit(train.agg(F.avg("stars")).first()[0])

    def candidate(rank: int = 16, reg: float = 0.1, iterations: int = 8, seed: int = 42):
        model = _als_numbered(fit, rank, reg, iterations, seed, "stars")
        error = model(checked, "train_mean", mean).agg(
            F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2)))
        ).first()[0]
        return lambda rows: model(rows, "train_mean", mean), error

    return candidate


def _als_numbered(
    train: DataFrame, rank: int, reg: float, iterations: int, seed: int, target: str
) -> Callable[[DataFrame, str, Column], DataFrame]:
    """als_fitted over numbers _u and _i in place of ids; rows without one of them get the mean that is given.

    Each iteration ends in a checkpoint, with which the shuffle files of those before go.
    """
    model = ALS(
        rank=rank, regParam=reg, maxIter=iterations, seed=seed, userCol="_u", itemCol="_i", ratingCol=target,
        coldStartStrategy="nan", checkpointInterval=1
    ).fit(train)

    def stream(rows: DataFrame, fallback: str, mean: Column) -> DataFrame:
        out = model.transform(rows.fillna(-1, ["_u", "_i"]))
        cold = F.isnan("prediction") | F.col("prediction").isNull()
        return out.withColumn("fallback_kind", F.when(cold, fallback).otherwise("none")).withColumn(
            "prediction", F.when(cold, mean).otherwise(F.col("prediction").cast("double"))
        ).drop("_u", "_i")

    return stream


def bias_factors(
    train: DataFrame, rows: DataFrame, users: DataFrame, items: DataFrame, rank: int = 16, reg: float = 0.1,
    iterations: int = 8, seed: int = 42, low: float = 1.0, high: float = 5.0
) -> DataFrame:
    """rows with prediction: bias means, and ALS factors of what they leave of the train ratings; clipped to the scale.

    Rows of unknown users or items get the baseline alone; fallback_kind tells. Biases and numbers stand in one table of items
    and one of users, so a row goes to its item once and to its user once for both; ALS reads numbers alone.
    """
    mean = F.lit(train.agg(F.avg("stars")).first()[0]).cast("double")
    number = lambda ids, into: ids.select(ids.columns[0], F.col("id").cast("int").alias(into))
    t = train.select("user_id", "business_id", "stars")
    bi = t.groupBy("business_id").agg(
        (F.sum(F.col("stars") - mean) / (F.count(F.lit(1)) + DAMP_ITEM)).alias("_bi")
    )
    of_item = stored(number(items, "_i").join(bi, "business_id", "full"))
    placed = stored(
        t.join(of_item, "business_id", "left").select(
            "user_id", "_i", "stars", "_bi", F.col("business_id").isNotNull().alias("_known")
        )
    )
    bu = placed.filter("_known").groupBy("user_id").agg(
        (F.sum(F.col("stars") - mean - F.col("_bi")) / (F.count(F.lit(1)) + DAMP_USER)).alias("_bu")
    )
    of_user = stored(number(users, "_u").join(bu, "user_id", "full"))
    baseline = mean + F.coalesce("_bi", F.lit(0.0)) + F.coalesce("_bu", F.lit(0.0))
    left = placed.join(of_user, "user_id").filter("_u IS NOT NULL AND _i IS NOT NULL").select(
        "_u", "_i", (F.col("stars") - baseline).alias("residual")
    )
    known = rows.join(of_item, "business_id", "left").join(of_user, "user_id", "left")
    out = _als_numbered(stored(left), rank, reg, iterations, seed, "residual")(
        known.withColumn("baseline", baseline).drop("_bi", "_bu"), "baseline", F.lit(0.0)
    )
    raw = F.col("baseline") + F.when(F.col("fallback_kind") == "none", F.col("prediction")).otherwise(0.0)
    return out.withColumn("prediction", F.least(F.greatest(raw, F.lit(low)), F.lit(high)))


def als_selected(
    train: DataFrame, val: DataFrame, rows: DataFrame, users: DataFrame, items: DataFrame, settings: list[dict], **fixed
) -> tuple[DataFrame, dict, float]:
    """als_stream of the settings with the least RMSE on val (the first on ties); with them, and that RMSE.

    Every candidate is fitted on train alone, and once; an empty val leaves the first.
    """
    candidate, best = als_candidates(train, val, users, items), None
    for own in settings:
        stream, error = candidate(**fixed, **own)
        error = float("inf") if error is None else float(error)
        if best is None or error < best[1]:
            best = own, error, stream
    return best[2](numbered(rows, users, items)), best[0], best[1]


def negative_samples(
    positives: DataFrame, seen: DataFrame, items: DataFrame, ratio: int = 4, tries: int = 10, seed: int = 42,
    key: str = "review_id"
) -> DataFrame:
    """(key, user_id, business_id, label 0): ratio drawn items per positive that the user hasn't rated; items: (business_id, id).

    An item drawn twice counts by its first draw. ratio + tries are drawn, so a user who has rated nearly all items may get
    fewer than ratio. A positive's draws stay in its row, as numbers, and meet those of the user's items as a list; users of
    more than ``HEAVY`` items have several lists, and a draw goes to the one that would hold it. Keys are unique.
    """
    n = items.count()
    rated = stored(
        seen.select("user_id", "business_id").join(items, "business_id").select(
            "user_id", F.col("id").cast("int").alias("id")
        ).distinct().filter("user_id IS NOT NULL")
    )
    pieces = rated.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("pieces"))
    piece = lambda c: F.pmod(F.xxhash64(c), F.coalesce("pieces", F.lit(1))).cast("int")
    lists = rated.join(pieces, "user_id").groupBy("user_id", piece("id").alias("piece")).agg(
        F.collect_list("id").alias("taken")
    )
    drawn = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.lit(ratio + tries)),
            lambda k: F.pmod(F.xxhash64(key, k, F.lit(seed)), F.lit(n)).cast("int")
        )
    )
    draws = positives.select(key, "user_id", drawn.alias("d")).withColumn(
        "d", F.transform("d", lambda d, k: F.struct(k.alias("k"), d.alias("id")))
    ).join(pieces, "user_id", "left")
    dealt = draws.withColumn(
        "piece", F.explode(F.array_distinct(F.transform("d", lambda d: piece(d["id"]))))
    ).select(key, "user_id", "piece", F.filter("d", lambda d: piece(d["id"]) == F.col("piece")).alias("d"))
    free = dealt.join(lists, ["user_id", "piece"], "left").select(
        key, "user_id",
        F.filter("d", lambda d: ~F.array_contains(F.coalesce("taken", F.array().cast("array<int>")), d["id"])).alias("d")
    )
    first = free.groupBy(key, "user_id").agg(F.flatten(F.collect_list("d")).alias("d")).select(  # ratio + tries at most
        key, "user_id", F.explode(F.slice(F.sort_array("d"), 1, ratio)).alias("d")
    )
    return first.select(key, "user_id", F.col("d.id").alias("id")).join(items, "id").select(
        key, "user_id", "business_id", F.lit(0).alias("label")
    )


def candidate_pool(
    test: DataFrame, seen: DataFrame, items: DataFrame, per_positive: int = 20, seed: int = 42
) -> DataFrame:
    """Test positives (label 1) and sampled unseen items (label 0): ranking candidates that make metrics mean something."""
    pos = test.select("review_id", "user_id", "business_id", F.lit(1).alias("label"))
    return pos.unionByName(negative_samples(test, seen, items, per_positive, 10, seed))


def out_of_fold(
    rows: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], k: int = 5, seed: int = 42,
    key: str = "review_id"
) -> DataFrame:
    """Each fold predicted by a model of the others: fit_predict(train, rows) -> rows with prediction.

    Up to TOGETHER models are fitted at once, so that a step of one with few tasks leaves no cores idle. A fold's predictions
    are written as they come, so the disk holds the shuffles of these folds alone.
    """
    folded = stored(rows.withColumn("fold", fold(key, k, seed)))

    def part(f: int) -> DataFrame:
        return stored(fit_predict(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)))

    with ThreadPoolExecutor(TOGETHER) as pool:
        running = [pool.submit(inheritable_thread_target(rows.sparkSession)(part), f) for f in range(k)]
    return functools.reduce(DataFrame.unionByName, [r.result() for r in running])


#: Models of out_of_fold that are fitted at once.
TOGETHER = 4


def sentiment_model(features: int = 1 << 14, reg: float = 0.01) -> Pipeline:
    """Words hashed, weighted by idf, logistic regression; columns text and sentiment_label in."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\s+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol="sentiment_label", regParam=reg)
        ]
    )


def sentiment_selected(fit: DataFrame, val: DataFrame, regs: list[float]) -> tuple[PipelineModel, list[tuple]]:
    """The model of ``fit`` whose regularisation has the least log loss on ``val`` (the first on ties, or if val is empty),
    and a report: (reg, log loss, accuracy, validation rows, kept) of each."""
    fit, val, best, report = stored(fit), stored(val), None, []
    for reg in regs:
        model = without_summary(sentiment_model(reg=reg).fit(fit))
        p = F.least(F.greatest("sentiment_score", F.lit(1e-12)), F.lit(1 - 1e-12))
        loss = -F.when(F.col("sentiment_label") == 1, F.log(p)).otherwise(F.log(1 - p))
        right = ((F.col("sentiment_score") >= 0.5).cast("int") == F.col("sentiment_label")).cast("double")
        got = sentiment_score(model, val).agg(F.avg(loss), F.avg(right), F.count(F.lit(1))).first()
        report.append((reg, *got))
        if best is None or got[0] is not None and got[0] < report[best[0]][1]:
            best = len(report) - 1, model
    return best[1], [(*r, k == best[0]) for k, r in enumerate(report)]


def sentiment_score(model, rows: DataFrame) -> DataFrame:
    """rows with sentiment_score, the probability of label 1; a null text counts as empty."""
    out = model.transform(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    return out.withColumn("sentiment_score", vector_to_array("probability")[1]).drop(
        "_words", "_tf", "_features", "rawPrediction", "probability", "prediction"
    )


def accuracy(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(
        F.avg(
            ((F.col("sentiment_score") >= 0.5).cast("int") == F.col("sentiment_label")).cast("double")
        ).alias("accuracy"),
        F.count(F.lit(1)).alias("n")
    )
