"""Readers and writers round trip on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from opinara.sources import readers, writers


def test_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('review_id,user_id,business_id,text,stars,date\n1,07,b,"two\nlines, ""quoted""",4.0,2020-01-01\n2,u,b,x,bad,2020-01-02\n')
    out = readers.read_csv(spark, f"file://{p}", multi_line=True).orderBy("review_id").collect()
    assert out[0]["text"] == 'two\nlines, "quoted"' and out[0]["user_id"] == "07" and out[1]["stars"] is None


def test_jsonl(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"review_id": "1", "stars": 3}\n\n{broken\n{"review_id": "2"}\n')
    assert sorted(r["review_id"] for r in readers.read_jsonl(spark, f"file://{p}").collect()) == ["1", "2"]


def test_five_core(spark, tmp_path):
    p = tmp_path / "r.json.gz"
    with gzip.open(p, "wt") as f:
        f.write(json.dumps({"reviewText": "ok", "overall": 5.0, "reviewerID": "u", "asin": "i", "unixReviewTime": 86400}) + "\n")
    r = readers.read_five_core(spark, f"file://{p}", 2).first()
    assert (r["user_id"], r["business_id"], r["stars"], str(r["date"])) == ("u", "i", 5.0, "1970-01-02")


def test_struct_literal(spark):
    df = spark.createDataFrame([("{u'overall': 4.0, 'x': None}",), ("{'overall'",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.struct_literal(F.col("t"), "overall double")["overall"]).collect()] == [4.0, None, None]


def test_hotel_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,offering_id,text,date,ratings,author\n1,9,nice,\"May 1, 2012\",\"{'overall': 5.0}\",\"{'id': 'U1'}\"\n2,8,bad,x,\"{'overall': 1.0}\",\"{'id': 'U2'}\"\n")
    (tmp_path / "o.csv").write_text("id,hotel_class,address\n9,4.5,\"{'locality': 'Bogor'}\"\n")
    out = {r["review_id"]: (r["user_id"], r["stars"], r["business_city"]) for r in readers.read_hotel_reviews(spark, f"file://{tmp_path}/r.csv", f"file://{tmp_path}/o.csv").collect()}
    assert out == {"1": ("U1", 5.0, "Bogor"), "2": ("U2", 1.0, None)}


def test_splits_keep_empty_parts(spark, tmp_path):
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "review_id string, split string")
    path = f"file://{tmp_path}/s"
    writers.write_splits(df, path, 42, 0.8, 0.1)
    assert sorted(tuple(r) for r in readers.load_splits(spark, path).select("review_id", "split").collect()) == [("1", "train"), ("2", "test")]


def test_predictions_and_results(spark, tmp_path):
    p = spark.createDataFrame([("m", "d", 1, "r", "u", "b", 4.0, 3.0)], "model string, domain string, seed int, review_id string, user_id string, business_id string, y_true double, y_pred double")
    writers.write_predictions(p, f"file://{tmp_path}/p")
    assert readers.scan_predictions(spark, f"file://{tmp_path}/p").filter("seed = 1").first()["squared_error"] == 1.0
    m = spark.createDataFrame([("m", "d", 1, 1.0, 0.5)], "model string, domain string, seed int, rmse double, mae double")
    writers.write_results(m, f"file://{tmp_path}/r", "{}")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_results(m, f"file://{tmp_path}/r", "{}")
    writers.write_results(m.withColumn("rmse", F.lit(2.0)), f"file://{tmp_path}/r", "{}", overwrite=True)
    assert [r["rmse"] for r in spark.read.parquet(f"file://{tmp_path}/r").collect()] == [2.0]
    (tmp_path / "x.json").write_text('{"model": "m", "domain": "d", "seed": 1, "rmse": 1.5, "mae": 1}\nbroken\n{"model": "m"}\n')
    assert readers.scan_results(spark, f"file://{tmp_path}/x.json", "json").count() == 1


def test_feature_cache_computes_once(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return rows.select("review_id", F.lit(1.0).alias("score"))

    rows = spark.range(5).select(F.col("id").cast("string").alias("review_id"))
    path = f"file://{tmp_path}/c"
    assert writers.cached_features(rows.limit(3), compute, path).count() == 3
    assert writers.cached_features(rows, compute, path).filter("score IS NULL").isEmpty()
    assert seen == [3, 2]


def test_preview(spark):
    assert readers.preview(spark.range(100), 7).count() == 7


def test_folder_is_shared_or_refused(spark, monkeypatch):
    from opinara import shared

    df = spark.range(3)
    work = shared.shared_folder(spark)
    assert shared.stored(df, work).count() == 3
    shared.discard(spark, work)
    with pytest.raises(Exception, match="(?i)path_not_found|not exist"):
        spark.read.parquet(work)

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Session())
