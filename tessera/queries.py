"""The registered relational queries with their equivalents for the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import Engine
from tessera.sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FLAGSHIP = "SELECT customer.c_mktsegment, COUNT(*) FROM customer, orders WHERE customer.c_custkey = orders.o_custkey AND orders.o_orderstatus = 'F' GROUP BY customer.c_mktsegment"

#: name: (query in the engine's dialect, output names, equivalent SQL)
SQL: dict[str, tuple[str, list[str], str]] = {
    "flagship": (FLAGSHIP, ["c_mktsegment", "n"], "SELECT c_mktsegment, CAST(count(*) AS INTEGER) AS n FROM customer, orders WHERE c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_mktsegment"),
    "scan_star": ("SELECT * FROM nation", ["n_nationkey", "n_name", "n_regionkey"], "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "project": ("SELECT supplier.s_name, supplier.s_suppkey FROM supplier", ["s_name", "s_suppkey"], "SELECT s_name, s_suppkey FROM supplier"),
    "filter_int": ("SELECT lineitem.l_orderkey, lineitem.l_linenumber FROM lineitem WHERE lineitem.l_linenumber >= 6", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 6"),
    "filter_string": ("SELECT orders.o_orderkey, orders.o_orderpriority FROM orders WHERE orders.o_orderstatus = 'P'", ["o_orderkey", "o_orderpriority"], "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'"),
    "filter_not_equal": ("SELECT orders.o_orderkey FROM orders WHERE orders.o_orderstatus <> 'O'", ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'"),
    "filter_and": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size > 10 AND part.p_size <= 20 AND part.p_retailprice < 1500", ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20 AND p_retailprice < 1500"),
    "filter_mul": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size * part.p_size > 400", ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size * p_size > 400"),
    "filter_constant": ("SELECT nation.n_name FROM nation WHERE 1 = 1", ["n_name"], "SELECT n_name FROM nation WHERE 1 = 1"),
    "filter_negative": ("SELECT customer.c_custkey FROM customer WHERE customer.c_acctbal < -500", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_acctbal < -500"),
    "join_hash": ("SELECT orders.o_orderkey, orders.o_orderstatus, lineitem.l_linenumber, lineitem.l_returnflag FROM orders, lineitem WHERE orders.o_orderkey = lineitem.l_orderkey", ["o_orderkey", "o_orderstatus", "l_linenumber", "l_returnflag"], "SELECT o_orderkey, o_orderstatus, l_linenumber, l_returnflag FROM orders, lineitem WHERE o_orderkey = l_orderkey"),
    "join_star": ("SELECT * FROM region, nation WHERE region.r_regionkey = nation.n_regionkey", ["r_regionkey", "r_name", "n_nationkey", "n_name", "n_regionkey"], "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region, nation WHERE r_regionkey = n_regionkey"),
    "join_multi_key": ("SELECT customer.c_custkey, supplier.s_suppkey FROM customer, supplier WHERE customer.c_nationkey = supplier.s_nationkey AND customer.c_custkey = supplier.s_suppkey", ["c_custkey", "s_suppkey"], "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey"),
    "join_residual": ("SELECT orders.o_orderkey, lineitem.l_linenumber FROM orders, lineitem WHERE orders.o_orderkey = lineitem.l_orderkey AND lineitem.l_extendedprice > orders.o_totalprice", ["o_orderkey", "l_linenumber"], "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_extendedprice > o_totalprice"),
    "join_theta": ("SELECT region.r_name, nation.n_name FROM region, nation WHERE region.r_regionkey < nation.n_regionkey", ["r_name", "n_name"], "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey"),
    "join_cross": ("SELECT region.r_name, nation.n_name FROM region, nation", ["r_name", "n_name"], "SELECT r_name, n_name FROM region, nation"),
    "join_string_literal": ("SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey = region.r_regionkey AND region.r_name = 'ASIA'", ["n_name", "r_name"], "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'"),
    "join_three_way": ("SELECT nation.n_name, COUNT(*) FROM region, nation, customer WHERE region.r_regionkey = nation.n_regionkey AND nation.n_nationkey = customer.c_nationkey GROUP BY nation.n_name", ["n_name", "n"], "SELECT n_name, CAST(count(*) AS INTEGER) AS n FROM region, nation, customer WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey GROUP BY n_name"),
    "join_left_deep_four": ("SELECT region.r_name, COUNT(*) FROM region, nation, customer, orders WHERE region.r_regionkey = nation.n_regionkey AND nation.n_nationkey = customer.c_nationkey AND customer.c_custkey = orders.o_custkey GROUP BY region.r_name", ["r_name", "n"], "SELECT r_name, CAST(count(*) AS INTEGER) AS n FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name"),
    "agg_sum": ("SELECT part.p_brand, SUM(part.p_size) FROM part GROUP BY part.p_brand", ["p_brand", "total"], "SELECT p_brand, CAST(sum(p_size) AS INTEGER) AS total FROM part GROUP BY p_brand"),
    "agg_avg": ("SELECT part.p_brand, AVG(part.p_size) FROM part GROUP BY part.p_brand", ["p_brand", "average"], "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS INTEGER) AS average FROM part GROUP BY p_brand"),
    "agg_count": ("SELECT lineitem.l_returnflag, COUNT(*), COUNT(lineitem.l_linenumber) FROM lineitem GROUP BY lineitem.l_returnflag", ["l_returnflag", "n", "n_lines"], "SELECT l_returnflag, CAST(count(*) AS INTEGER) AS n, CAST(count(l_linenumber) AS INTEGER) AS n_lines FROM lineitem GROUP BY l_returnflag"),
    "agg_min_max": ("SELECT part.p_brand, MIN(part.p_name), MAX(part.p_size) FROM part GROUP BY part.p_brand", ["p_brand", "least_name", "most_size"], "SELECT p_brand, min(p_name) AS least_name, max(p_size) AS most_size FROM part GROUP BY p_brand"),
    "agg_mixed": ("SELECT lineitem.l_returnflag, COUNT(*), SUM(lineitem.l_linenumber), AVG(lineitem.l_linenumber), MIN(lineitem.l_linenumber), MAX(lineitem.l_linenumber) FROM lineitem GROUP BY lineitem.l_returnflag", ["l_returnflag", "n", "s", "a", "lo", "hi"], "SELECT l_returnflag, CAST(count(*) AS INTEGER) AS n, CAST(sum(l_linenumber) AS INTEGER) AS s, CAST(sum(l_linenumber) // count(l_linenumber) AS INTEGER) AS a, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag"),
    "agg_mul": ("SELECT part.p_brand, SUM(part.p_size * part.p_size) FROM part GROUP BY part.p_brand", ["p_brand", "squares"], "SELECT p_brand, CAST(sum(p_size * p_size) AS INTEGER) AS squares FROM part GROUP BY p_brand"),
    "agg_literal": ("SELECT SUM(1) FROM lineitem GROUP BY lineitem.l_linestatus", ["n"], "SELECT CAST(sum(1) AS INTEGER) AS n FROM lineitem GROUP BY l_linestatus"),
    "agg_global": ("SELECT COUNT(*), SUM(part.p_size), MIN(part.p_size) FROM part", ["n", "s", "lo"], "SELECT CAST(count(*) AS INTEGER) AS n, CAST(sum(p_size) AS INTEGER) AS s, min(p_size) AS lo FROM part"),
    "agg_global_empty": ("SELECT COUNT(*), SUM(part.p_size) FROM part WHERE part.p_size < 0", ["n", "s"], "SELECT CAST(count(*) AS INTEGER) AS n, CAST(sum(p_size) AS INTEGER) AS s FROM part WHERE p_size < 0 HAVING count(*) > 0"),
    "group_keys_only": ("SELECT lineitem.l_returnflag, lineitem.l_linestatus FROM lineitem GROUP BY lineitem.l_returnflag, lineitem.l_linestatus", ["l_returnflag", "l_linestatus"], "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_key_hidden": ("SELECT COUNT(*) FROM orders GROUP BY orders.o_orderpriority", ["n"], "SELECT CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_orderpriority"),
    "group_multi": ("SELECT lineitem.l_returnflag, lineitem.l_linestatus, COUNT(*) FROM lineitem GROUP BY lineitem.l_returnflag, lineitem.l_linestatus", ["l_returnflag", "l_linestatus", "n"], "SELECT l_returnflag, l_linestatus, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_columns_first": ("SELECT COUNT(*), part.p_brand, SUM(part.p_size) FROM part GROUP BY part.p_brand", ["p_brand", "n", "total"], "SELECT p_brand, CAST(count(*) AS INTEGER) AS n, CAST(sum(p_size) AS INTEGER) AS total FROM part GROUP BY p_brand"),
    "distinct": ("SELECT DISTINCT lineitem.l_returnflag FROM lineitem", ["l_returnflag"], "SELECT DISTINCT l_returnflag FROM lineitem"),
    "distinct_multi": ("SELECT DISTINCT orders.o_orderstatus, orders.o_orderpriority FROM orders", ["o_orderstatus", "o_orderpriority"], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "sort": ("SELECT customer.c_custkey, customer.c_name FROM customer ORDER BY customer.c_custkey", ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"),
    "sort_multi": ("SELECT nation.n_regionkey, nation.n_nationkey FROM nation ORDER BY nation.n_regionkey, nation.n_nationkey", ["n_regionkey", "n_nationkey"], "SELECT n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey"),
    "topk": ("SELECT orders.o_orderkey, orders.o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 25", ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25"),
    "limit_all": ("SELECT region.r_name FROM region LIMIT 1000", ["r_name"], "SELECT r_name FROM region LIMIT 1000"),
    "limit_zero": ("SELECT region.r_name FROM region LIMIT 0", ["r_name"], "SELECT r_name FROM region LIMIT 0"),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Catalog.from_parquet(spark, sf_dir, TABLES))


def _query(sql: str, names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).frame(sql, names)


def limit_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a LIMIT lets through, and whether it says that there are more, for a LIMIT below and one above."""
    found = [engine(spark, sf_dir).execute(f"SELECT nation.n_name FROM nation LIMIT {n}") for n in (7, 1000)]
    return spark.createDataFrame([(n, len(r.rows), r.truncated) for n, r in zip((7, 1000), found, strict=True)], "lim int, n int, truncated boolean")


QUERIES = {name: _query(sql, names) for name, (sql, names, _) in SQL.items()}
ORACLE_SQL = {name: oracle for name, (_, _, oracle) in SQL.items()}
QUERIES["limit_flag"] = limit_flag
ORACLE_SQL["limit_flag"] = "SELECT CAST(l AS INTEGER) AS lim, CAST(least(l, (SELECT count(*) FROM nation)) AS INTEGER) AS n, l < (SELECT count(*) FROM nation) AS truncated FROM (VALUES (7), (1000)) v(l)"
