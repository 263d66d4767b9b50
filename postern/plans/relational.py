"""Plain relational queries over the business tables, with the quote and message operators' building blocks: filter, join, group, rank."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}


def both(name: str, sql: str, duck: str | None = None) -> None:
    """A query whose text both engines run; tables are read by name from the input folder."""

    def run(spark, sf_dir, sql=sql):
        names = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql))
        return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = duck or sql


both("pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity)) AS BIGINT) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount))) AS BIGINT) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("segment_revenue", "SELECT c_mktsegment, CAST(round(sum(l_extendedprice * (1 - l_discount))) AS BIGINT) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
both("top_parts", "SELECT p_brand, p_partkey, qty FROM (SELECT p_brand, p_partkey, qty, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS k FROM (SELECT p_brand, p_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) x) y WHERE k <= 3")
both("customers_without_orders", "SELECT c_nationkey, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL GROUP BY c_nationkey")
