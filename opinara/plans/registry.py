"""Registration of queries and the SQL building blocks that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


INTER = """base AS MATERIALIZED (
  SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(l.l_partkey AS VARCHAR) AS business_id, CAST(o.o_orderdate AS DATE) AS date,
    CAST(1 + ((CAST(l.l_quantity AS INTEGER) - 1) % 5) AS DOUBLE) AS stars, l.l_orderkey,
    CAST(l.l_orderkey AS VARCHAR) || '::' || CAST(l.l_linenumber AS VARCHAR) AS base_id,
    row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber ORDER BY l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS k
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
inter AS MATERIALIZED (SELECT CASE WHEN k = 1 THEN base_id ELSE base_id || '::' || k END AS review_id, user_id, business_id, date, stars, l_orderkey FROM base)"""
SPLIT = INTER + """,
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM inter WHERE date IS NOT NULL),
sized AS (SELECT *, greatest(1, round_even(n * 0.8, 0)) AS nt0 FROM placed),
cut AS (SELECT *, CASE WHEN n - nt0 > 1 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END AS nv, least(nt0, n - 1) AS nt FROM sized),
parts AS MATERIALIZED (SELECT review_id, user_id, business_id, date, stars, l_orderkey,
  CASE WHEN n < 3 THEN 'cold_start' WHEN rn <= nt THEN 'train' WHEN nv > 0 AND n - nt > nv AND rn <= nt + nv THEN 'val' ELSE 'test' END AS split FROM cut),
train AS MATERIALIZED (SELECT *, (l_orderkey % 97) / 97.0::DOUBLE AS sentiment FROM parts WHERE split = 'train'),
evald AS MATERIALIZED (SELECT *, (l_orderkey % 97) / 97.0::DOUBLE AS sentiment FROM parts WHERE split = 'test')"""
PREDICTED = SPLIT + """,
im AS (SELECT business_id, avg(stars) AS im FROM train GROUP BY 1), um AS (SELECT user_id, avg(stars) AS um FROM train GROUP BY 1), gm AS (SELECT avg(stars) AS gm FROM train),
based AS (SELECT t.*, im, um, gm FROM evald t LEFT JOIN im USING (business_id) LEFT JOIN um USING (user_id) CROSS JOIN gm),
modelled AS (SELECT *, 'global' AS model, gm AS b FROM based UNION ALL SELECT *, 'item', coalesce(im, gm) FROM based UNION ALL SELECT *, 'user', coalesce(um, gm) FROM based),
preds AS MATERIALIZED (SELECT model, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, CAST(seed AS INTEGER) AS seed, review_id, user_id, business_id, stars AS y_true,
  b + (((l_orderkey * 7 + seed * 13) % 101) / 100.0::DOUBLE - 0.5::DOUBLE) * 0.4::DOUBLE AS y_pred, l_orderkey FROM modelled, range(1, 6) s(seed))"""
METRICS = PREDICTED + """,
metrics AS MATERIALIZED (SELECT model, domain, seed, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae, count(*) AS n FROM preds GROUP BY ALL)"""
