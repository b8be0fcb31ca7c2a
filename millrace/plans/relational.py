"""Queries over the relational operators, one or more for each, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import arithmetic, both, compare, either, is_true
from millrace.operators import aggregates, joins, ordering, scans, setops, stats, transforms, verify
from millrace.plans.engine import Engine, explain
from millrace.session import shared_folder, table
from millrace.sources.tables import ColumnDef, ConstraintError

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


c = F.col


@query("""
SELECT c.c_custkey AS c_custkey, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'
GROUP BY c.c_custkey ORDER BY revenue DESC, c_custkey LIMIT 10""")
def flagship(spark, sf):
    """Scan, filter, join, group and top-k: the biggest customers of a segment."""
    customers = scans.lookup(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING")
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    joined = joins.equi_join(orders, customers, c("o_custkey") == c("c_custkey"))
    grouped = aggregates.aggregate(joined, ["c_custkey"], {"n_orders": ("count", "*"), "total": ("sum", "o_totalprice")})
    return ordering.top_n(grouped.select("c_custkey", "n_orders", F.round("total", 2).alias("revenue")), [("revenue", False), ("c_custkey", True)], 10)


# Scans and lookups


@query("SELECT * FROM nation")
def seq_scan(spark, sf):
    return scans.scan(table(spark, sf, "nation"))


@query("SELECT * FROM orders WHERE o_orderkey = 100")
def point_lookup(spark, sf):
    return scans.lookup(table(spark, sf, "orders"), "o_orderkey", 100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 500")
def range_scan_incl(spark, sf):
    return scans.range_lookup(table(spark, sf, "orders"), "o_orderkey", 100, 500).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 500")
def range_scan_excl(spark, sf):
    return scans.range_lookup(table(spark, sf, "orders"), "o_orderkey", 100, 500, False, False).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 900")
def range_scan_open(spark, sf):
    return scans.range_lookup(table(spark, sf, "orders"), "o_orderkey", low=900).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 100 AND l_linenumber >= 2")
def composite_prefix_range(spark, sf):
    return scans.prefix_lookup(table(spark, sf, "lineitem"), {"l_orderkey": 100}, "l_linenumber", low=2).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 40 AND p_brand = 'Brand#11'")
def bitmap_and(spark, sf):
    return scans.rows_where_all(table(spark, sf, "part"), c("p_size") >= 40, c("p_brand") == "Brand#11").select("p_partkey", "p_size", "p_brand")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size = 1 OR p_brand = 'Brand#11'")
def bitmap_or(spark, sf):
    return scans.rows_where_any(table(spark, sf, "part"), c("p_size") == 1, c("p_brand") == "Brand#11").select("p_partkey", "p_size", "p_brand")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size < 5 AND p_brand = 'Brand#11') OR (p_size > 45 AND p_brand = 'Brand#22')")
def bitmap_dnf(spark, sf):
    first, second = (c("p_size") < 5) & (c("p_brand") == "Brand#11"), (c("p_size") > 45) & (c("p_brand") == "Brand#22")
    return scans.rows_where_any(table(spark, sf, "part"), first, second).select("p_partkey", "p_size", "p_brand")


@query("SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def bitmap_heap_scan(spark, sf):
    orders = table(spark, sf, "orders")
    return scans.fetch(orders, scans.key_list(orders, "o_orderkey", c("o_orderstatus") == "P"), "o_orderkey")


@query("SELECT l_orderkey FROM lineitem")
def index_only_scan(spark, sf):
    return scans.covering(table(spark, sf, "lineitem"), ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 500")
def index_only_composite(spark, sf):
    return scans.covering(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], c("l_orderkey") >= 500)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def ordered_index_scan(spark, sf):
    return scans.ordered_scan(table(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 200 AND o_orderkey <= 900 ORDER BY o_orderkey LIMIT 25")
def late_materialization_limit(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return scans.fetch_after_limit(orders, "o_orderkey", (c("o_orderkey") >= 200) & (c("o_orderkey") <= 900), 25)


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def materialize_reuse(spark, sf):
    part = scans.materialize(scans.lookup(table(spark, sf, "nation"), "n_regionkey", 1).select("n_nationkey"))
    return setops.combine(part, "UNION ALL", part)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def clustered_layout(spark, sf):
    return scans.cluster_by(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderkey"])


# Filters, projections, expressions


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 OR l_discount = 0.1")
def filter_or(spark, sf):
    return transforms.keep(table(spark, sf, "lineitem"), (c("l_quantity") > 45) | (c("l_discount") == F.lit(0.1))).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < l_linenumber")
def filter_col_col(spark, sf):
    return transforms.keep(table(spark, sf, "lineitem"), c("l_quantity") < c("l_linenumber")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE 100000 < o_totalprice")
def filter_const_left(spark, sf):
    return transforms.keep(table(spark, sf, "orders"), compare(F.lit(100000), "<", c("o_totalprice"))).select("o_orderkey")


@query("SELECT id, dept, salary FROM emp WHERE salary <> 0 AND salary IS NOT NULL")
def filter_truthy(spark, sf):
    return transforms.keep(table(spark, sf, "emp"), c("salary")).select("id", "dept", "salary")


@query("SELECT p_partkey AS k, p_name AS label, p_size AS size_of FROM part")
def project_alias(spark, sf):
    return transforms.project(table(spark, sf, "part"), {"k": c("p_partkey"), "label": c("p_name"), "size_of": c("p_size")})


@query("SELECT n.*, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def project_star_join(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return transforms.all_columns_of(n, r, joins.equi_join(n, r, c("n_regionkey") == c("r_regionkey")))


@query("SELECT a.n_nationkey AS n_nationkey, a.n_name AS n_name, b.n_nationkey AS n_nationkey_2, b.n_name AS n_name_2 FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def project_star_clashing(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    a, b = n.alias("a"), n.alias("b")
    return transforms.all_columns_of(n, n, joins.equi_join(a, b, c("a.n_nationkey") == c("b.n_nationkey")))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS is_f FROM orders")
def project_boolean(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", is_true(compare(c("o_orderstatus"), "=", "F")).alias("is_f"))


@query("SELECT id, COALESCE(salary > 50000, FALSE) AS high, COALESCE(salary > 50000, FALSE) AND COALESCE(dept = 172, FALSE) AS both_of, COALESCE(salary > 50000, FALSE) OR COALESCE(dept = 172, FALSE) AS one_of FROM emp")
def project_two_valued(spark, sf):
    high, own = compare(c("salary"), ">", 50000), compare(c("dept"), "=", 172)
    return table(spark, sf, "emp").select("id", is_true(high).alias("high"), both(high, own).alias("both_of"), either(high, own).alias("one_of"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS v FROM lineitem")
def arith_add(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arithmetic(c("l_extendedprice"), "+", c("l_tax"), True).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey - l_linenumber AS v FROM lineitem")
def arith_sub(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arithmetic(c("l_orderkey"), "-", c("l_linenumber")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS v FROM lineitem")
def arith_mul(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arithmetic(c("l_extendedprice"), "*", c("l_discount"), True).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS DOUBLE) / l_linenumber AS v FROM lineitem")
def arith_div(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arithmetic(c("l_orderkey"), "/", c("l_linenumber")).alias("v"))


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def compare_all_ops(spark, sf):
    names = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return table(spark, sf, "part").select("p_partkey", *(is_true(compare(c("p_size"), op, 10)).alias(n) for n, op in names.items()))


# Joins


_CUSTOMER_ORDERS = "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey, o.o_totalprice AS o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"


def _customer_orders(spark, sf, strategy):
    customers, orders = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.equi_join(orders, customers, c("o_custkey") == c("c_custkey"), strategy).select("c_custkey", "o_orderkey", "o_totalprice")


@query(_CUSTOMER_ORDERS)
def join_hash(spark, sf):
    return _customer_orders(spark, sf, "hash")


@query(_CUSTOMER_ORDERS)
def join_merge(spark, sf):
    return _customer_orders(spark, sf, "merge")


@query(_CUSTOMER_ORDERS)
def join_broadcast(spark, sf):
    return _customer_orders(spark, sf, "broadcast")


@query(_CUSTOMER_ORDERS)
def join_auto(spark, sf):
    return _customer_orders(spark, sf, None)


@query("SELECT n.n_nationkey AS n_nationkey, r.r_regionkey AS r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey")
def join_nested_loop_theta(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return joins.theta_join(n, r, c("n_regionkey") < c("r_regionkey")).select("n_nationkey", "r_regionkey")


@query("SELECT n.n_name AS n_name, s.s_suppkey AS s_suppkey FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
def join_index_nested_loop(spark, sf):
    few = scans.lookup(table(spark, sf, "nation"), "n_regionkey", 2)
    return joins.lookup_join(few, table(spark, sf, "supplier"), "n_nationkey", "s_nationkey").select("n_name", "s_suppkey")


@query("SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, p.p_partkey AS p_partkey, p.p_brand AS p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
def join_memoized(spark, sf):
    lines, parts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return joins.many_to_one_join(lines, parts, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "p_brand")


@query("SELECT c.c_custkey AS c_custkey, n.n_name AS n_name, r.r_name AS r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_three_way(spark, sf):
    t = [table(spark, sf, x) for x in ("customer", "nation", "region")]
    return joins.join_all(t, [c("c_nationkey") == c("n_nationkey"), c("n_regionkey") == c("r_regionkey")]).select("c_custkey", "n_name", "r_name")


@query("SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(spark, sf):
    a, b = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b")
    return joins.equi_join(a, b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("first_name"), c("b.n_name").alias("second_name"))


@query("SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > c.c_acctbal * 10 AND c.c_mktsegment = 'BUILDING'")
def join_residual_filter(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    joined = joins.equi_join(orders, scans.lookup(customers, "c_mktsegment", "BUILDING"), c("o_custkey") == c("c_custkey"))
    return transforms.keep(joined, c("o_totalprice") > c("c_acctbal") * 10).select("c_custkey", "o_orderkey")


@query("SELECT e.id AS id, d.dname AS dname FROM emp e JOIN dept d ON e.dept = d.id")
def join_emp_dept(spark, sf):
    emp, dept = table(spark, sf, "emp").select("id", "dept"), table(spark, sf, "dept").select(c("id").alias("dept_id"), "dname")
    return joins.equi_join(emp, dept, c("dept") == c("dept_id")).select("id", "dname")


# Aggregation


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_hash(spark, sf):
    out = aggregates.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", "*"), "total": ("sum", "l_quantity")})
    return out.select("l_returnflag", "l_linestatus", "n", F.round("total", 2).alias("qty"))


@query("SELECT o_orderpriority, MIN(o_orderstatus) AS least, MAX(o_orderstatus) AS greatest FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority")
def agg_sorted(spark, sf):
    out = aggregates.aggregate(table(spark, sf, "orders"), ["o_orderpriority"], {"least": ("min", "o_orderstatus"), "greatest": ("max", "o_orderstatus")})
    return ordering.sort(out, [("o_orderpriority", True)])


@query("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem")
def agg_global(spark, sf):
    return aggregates.aggregate(table(spark, sf, "lineitem"), [], {"n": ("count", "*"), "lines": ("sum", "l_linenumber"), "low": ("min", "l_quantity"), "high": ("max", "l_quantity")})


@query("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, MIN(l_quantity) AS low FROM lineitem WHERE l_orderkey < 0")
def agg_empty(spark, sf):
    none = table(spark, sf, "lineitem").where(c("l_orderkey") < 0)
    return aggregates.aggregate(none, [], {"n": ("count", "*"), "lines": ("sum", "l_linenumber"), "low": ("min", "l_quantity")})


@query("SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept")
def agg_count_star(spark, sf):
    return aggregates.aggregate(table(spark, sf, "emp"), ["dept"], {"n": ("count", "*")})


@query("SELECT dept, COUNT(salary) AS n FROM emp GROUP BY dept")
def agg_count_col(spark, sf):
    return aggregates.aggregate(table(spark, sf, "emp"), ["dept"], {"n": ("count", "salary")})


@query("SELECT dept, CAST(SUM(salary) AS BIGINT) AS total FROM emp GROUP BY dept")
def agg_sum_int(spark, sf):
    return aggregates.aggregate(table(spark, sf, "emp"), ["dept"], {"total": ("sum", "salary")})


@query("SELECT l_suppkey, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
def agg_sum_double(spark, sf):
    return aggregates.aggregate(table(spark, sf, "lineitem"), ["l_suppkey"], {"t": ("sum", "l_extendedprice")}).select("l_suppkey", F.round("t", 2).alias("total"))


@query("SELECT dept, MIN(salary) AS low FROM emp GROUP BY dept")
def agg_min(spark, sf):
    return aggregates.aggregate(table(spark, sf, "emp"), ["dept"], {"low": ("min", "salary")})


@query("SELECT dept, MAX(salary) AS high FROM emp GROUP BY dept")
def agg_max(spark, sf):
    return aggregates.aggregate(table(spark, sf, "emp"), ["dept"], {"high": ("max", "salary")})


@query("SELECT o_orderstatus, MIN(o_orderpriority) AS first_name, MAX(o_orderpriority) AS last_name FROM orders GROUP BY o_orderstatus")
def agg_min_max_string(spark, sf):
    return aggregates.aggregate(table(spark, sf, "orders"), ["o_orderstatus"], {"first_name": ("min", "o_orderpriority"), "last_name": ("max", "o_orderpriority")})


@query("SELECT o_orderstatus, COUNT(CASE WHEN o_totalprice > 100000 THEN TRUE ELSE FALSE END) AS n, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS high FROM orders GROUP BY o_orderstatus")
def agg_count_expression(spark, sf):
    over = is_true(compare(c("o_totalprice"), ">", 100000))
    return aggregates.aggregate(table(spark, sf, "orders"), ["o_orderstatus"], {"n": ("count", over), "high": ("count", F.when(over, True))})


@query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_only(spark, sf):
    return aggregates.groups(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT DISTINCT o_orderstatus FROM orders")
def group_only_dedup(spark, sf):
    return aggregates.groups(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], merge_equal=True)


@query("SELECT DISTINCT dept FROM emp")
def distinct(spark, sf):
    return aggregates.distinct(table(spark, sf, "emp"), ["dept"])


@query("SELECT DISTINCT n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)")
def distinct_over_agg(spark, sf):
    return aggregates.distinct(aggregates.aggregate(table(spark, sf, "orders"), ["o_custkey"], {"n": ("count", "*")}), ["n"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag, l_linestatus")
def unique_sorted(spark, sf):
    return ordering.sort(aggregates.distinct(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]), [("l_returnflag", True), ("l_linestatus", True)])


# Order and limits


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def sort_multi(spark, sf):
    return ordering.sort(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [("o_orderstatus", True), ("o_totalprice", False), ("o_orderkey", True)])


@query("SELECT s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 15")
def sort_non_projected(spark, sf):
    return ordering.top_n(table(spark, sf, "supplier"), [("s_acctbal", True), ("s_suppkey", True)], 15).select("s_name")


@query("SELECT o_totalprice AS t, o_orderkey AS k FROM orders ORDER BY t DESC, k LIMIT 20")
def sort_alias_desc(spark, sf):
    named = transforms.project(table(spark, sf, "orders"), {"t": c("o_totalprice"), "k": c("o_orderkey")})
    return ordering.top_n(named, [("t", False), ("k", True)], 20)


@query("SELECT id, salary FROM (SELECT DISTINCT id, salary FROM emp) ORDER BY salary ASC NULLS FIRST, id LIMIT 50")
def sort_nulls_first(spark, sf):
    return ordering.top_n(aggregates.distinct(table(spark, sf, "emp"), ["id", "salary"]), [("salary", True), ("id", True)], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf):
    return ordering.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 10)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf):
    return ordering.limit(table(spark, sf, "orders").select("o_orderkey"), 0)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30")
def limit_only_total_order(spark, sf):
    return ordering.limit(ordering.sort(table(spark, sf, "customer").select("c_custkey", "c_name"), [("c_custkey", True)]), 30)


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def order_by_aggregate(spark, sf):
    return ordering.top_n(aggregates.aggregate(table(spark, sf, "orders"), ["o_custkey"], {"n": ("count", "*")}), [("n", False), ("o_custkey", True)], 10)


# Set operations


def _sides(spark, sf):
    return table(spark, sf, "customer").select(c("c_nationkey").alias("k")), table(spark, sf, "supplier").select(c("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@query(f"{_C} UNION ALL {_S}")
def union_all(spark, sf):
    a, b = _sides(spark, sf)
    return setops.combine(a, "UNION ALL", b)


@query(f"{_C} UNION {_S}")
def union_distinct(spark, sf):
    a, b = _sides(spark, sf)
    return setops.combine(a, "UNION", b)


@query(f"{_C} INTERSECT {_S}")
def intersect(spark, sf):
    a, b = _sides(spark, sf)
    return setops.combine(a, "INTERSECT", b)


@query(f"{_C} INTERSECT ALL {_S}")
def intersect_all(spark, sf):
    a, b = _sides(spark, sf)
    return setops.combine(a, "INTERSECT ALL", b)


@query("SELECT dept AS k FROM emp EXCEPT SELECT id AS k FROM dept")
def except_distinct(spark, sf):
    return setops.combine(table(spark, sf, "emp").select(c("dept").alias("k")), "EXCEPT", table(spark, sf, "dept").select(c("id").alias("k")))


@query(f"{_C} EXCEPT ALL {_S}")
def except_all(spark, sf):
    a, b = _sides(spark, sf)
    return setops.combine(a, "EXCEPT ALL", b)


@query(f"(({_C} UNION ALL {_S}) INTERSECT SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def compound_left_assoc(spark, sf):
    a, b = _sides(spark, sf)
    n = table(spark, sf, "nation").select(c("n_nationkey").alias("k"), "n_regionkey")
    return setops.compound(a, [("UNION ALL", b), ("INTERSECT", n.where("n_regionkey < 3").select("k")), ("EXCEPT", n.where("n_regionkey = 1").select("k"))])


@query("SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier) ORDER BY k DESC LIMIT 12")
def compound_order_limit(spark, sf):
    a, b = table(spark, sf, "nation").select(c("n_nationkey").alias("k")), table(spark, sf, "supplier").select(c("s_nationkey").alias("k"))
    return ordering.top_n(setops.compound(a, [("UNION ALL", b)]), [("k", False)], 12)


# Tables that change


def _engine(spark: SparkSession) -> Engine:
    """An engine with tables of its own in the shared folder."""
    return Engine(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")


_KINDS = {T.IntegerType(): "INT", T.LongType(): "BIGINT", T.DoubleType(): "DOUBLE", T.BooleanType(): "BOOLEAN", T.StringType(): "VARCHAR(200)", T.TimestampNTZType(): "VARCHAR(30)"}


def _stored(spark: SparkSession, sf: str, name: str, *indexes: tuple[list[str], bool]) -> Engine:
    """An engine that holds a copy of a table."""
    engine = _engine(spark)
    df = table(spark, sf, name)
    engine.create_table(name, [ColumnDef(f.name, _KINDS[f.dataType]) for f in df.schema.fields])
    for i, (keys, unique) in enumerate(indexes):
        engine.store.create_index(name, f"{name}_index_{i}", keys, unique)
    engine.load(name, df)
    return engine


@query("SELECT * FROM supplier UNION ALL SELECT 1000000, 'O''Brien', 7, 12.5")
def insert_row(spark, sf):
    engine = _stored(spark, sf, "supplier", (["s_suppkey"], True))
    engine.sql("INSERT INTO supplier VALUES (1000000, 'O''Brien', 7, 12.5);")
    return engine.sql("SELECT * FROM supplier")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 OR s_acctbal < 0 THEN 'changed' ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 OR s_acctbal < 0 THEN 24 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier")
def update_where(spark, sf):
    engine = _stored(spark, sf, "supplier", (["s_suppkey"], True))
    engine.sql("UPDATE supplier SET s_name = 'changed', s_nationkey = 24 WHERE supplier.s_nationkey = 3 OR s_acctbal < 0;")
    return engine.sql("SELECT * FROM supplier")


@query("SELECT * FROM orders WHERE NOT (o_totalprice > 150000 AND o_orderstatus = 'F')")
def delete_where(spark, sf):
    engine = _engine(spark)
    orders = table(spark, sf, "orders")
    engine.create_table("orders", [ColumnDef(f.name, _KINDS.get(f.dataType, "VARCHAR(30)")) for f in orders.schema.fields])
    engine.load("orders", orders)
    engine.sql("DELETE FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
    return engine.sql("SELECT * FROM orders").withColumn("o_orderdate", c("o_orderdate").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
def unique_violations(spark, sf):
    return verify.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT COUNT(*) FILTER (WHERE dept IS NULL) AS \"dept is null\", COUNT(*) FILTER (WHERE LENGTH(name) > 10) AS \"name is longer than 10\" FROM emp")
def constraint_violations(spark, sf):
    return verify.violations(table(spark, sf, "emp"), ["dept"], {"name": 10})


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def sql_select(spark, sf):
    engine = _engine(spark)
    engine.attach("nation", f"{sf}/nation.parquet")
    return engine.sql("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey;")


@query("SELECT k FROM ((SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY k LIMIT 4")
def sql_compound(spark, sf):
    engine = _engine(spark)
    for name in ("nation", "supplier"):
        engine.attach(name, f"{sf}/{name}.parquet")
    return engine.sql("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY k LIMIT 4")


# Statistics, plans, checks


_STATS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", COUNT(*) AS row_count, COUNT(DISTINCT {n}) AS distinct_count, (COUNT(*) - COUNT({n}))::DOUBLE / COUNT(*) AS null_fraction FROM {t}"
    for t, n in (("emp", "dept"), ("emp", "salary"), ("emp", "name"))))
def stats_columns(spark, sf):
    return stats.columns(table(spark, sf, "emp"), ["dept", "salary", "name"]).select("column", "row_count", "distinct_count", "null_fraction")


@query("SELECT 'o_custkey' AS \"column\", MIN(o_custkey)::DOUBLE AS min_value, MAX(o_custkey)::DOUBLE AS max_value FROM orders UNION ALL SELECT 'o_totalprice', MIN(o_totalprice), MAX(o_totalprice) FROM orders")
def stats_minmax(spark, sf):
    return stats.columns(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"]).select("column", "min_value", "max_value")


@query("SELECT dept AS value, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM emp) AS frequency FROM emp WHERE dept IS NOT NULL GROUP BY dept ORDER BY COUNT(*) DESC, dept LIMIT 8")
def stats_mcv(spark, sf):
    return stats.most_common(table(spark, sf, "emp"), "dept")


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, COUNT(*) AS distinct_pairs FROM (SELECT DISTINCT {a}, {b} FROM orders)"
    for a, b in (("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "o_custkey"), ("o_orderpriority", "o_custkey"))))
def stats_pairs(spark, sf):
    return stats.pairs(table(spark, sf, "orders"), _STATS)[0]


@query("SELECT 'o_orderstatus' AS column_1, 'o_orderpriority' AS column_2, o_orderstatus AS value_1, o_orderpriority AS value_2, COUNT(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, value_1, value_2 LIMIT 8")
def stats_common_pairs(spark, sf):
    return stats.pairs(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])[1].drop("rank")


@query("SELECT bucket, CASE WHEN bucket = 10 THEN (SELECT MAX(o_totalprice) FROM orders) END AS greatest, TRUE AS fits FROM (SELECT CAST(UNNEST(RANGE(1, 11)) AS INTEGER) AS bucket)")
def stats_histogram(spark, sf):
    """Bounds of ten buckets: each has its share of the rows up to it, within a thousandth."""
    orders = table(spark, sf, "orders").select("o_totalprice")
    bounds = stats.histogram(orders, "o_totalprice").agg(F.sort_array(F.collect_list("upper_bound")).alias("b")).scalar()
    below = orders.select("o_totalprice", bounds.alias("b"))
    upto = below.agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"), *(F.count_if(c("o_totalprice") <= c("b")[i]).alias(f"n{i}") for i in range(10)))
    each = upto.select("n", F.posexplode(F.arrays_zip("b", F.array(*(f"n{i}" for i in range(10))).alias("upto"))).alias("pos", "x"))
    bucket = c("pos") + 1
    return each.select(bucket.alias("bucket"), F.when(bucket == 10, c("x.b")).alias("greatest"), (F.abs(c("x.upto") / c("n") - bucket / 10) <= 0.001).alias("fits"))


_ANALYZED = ("o_orderstatus", "o_custkey", "o_totalprice")


@query(" UNION ALL ".join(f"""
SELECT '{n}' AS "column", COUNT(*) AS row_count, COUNT(DISTINCT {n}) AS distinct_count, (COUNT(*) - COUNT({n}))::DOUBLE / COUNT(*) AS null_fraction,
       {f"MIN({n})::DOUBLE" if number else "NULL::DOUBLE"} AS min_value, {f"MAX({n})::DOUBLE" if number else "NULL::DOUBLE"} AS max_value,
       (SELECT COUNT(*) FROM orders GROUP BY {n} ORDER BY COUNT(*) DESC LIMIT 1)::DOUBLE / COUNT(*) AS top_frequency,
       LEAST(COUNT(DISTINCT {n}), 8) AS n_common, {10 if number else "NULL"}::INTEGER AS n_bounds FROM orders""" for n, number in (("o_orderstatus", False), ("o_custkey", True), ("o_totalprice", True))))
def stats_analyze(spark, sf):
    """Kept statistics of a table that was analyzed and read again."""
    engine = _stored(spark, sf, "orders")
    engine.analyze("orders")
    kept = engine.statistics("orders").where(c("column").isin(*_ANALYZED))
    return kept.select(
        "column", "row_count", "distinct_count", "null_fraction", "min_value", "max_value", c("most_common")[0]["frequency"].alias("top_frequency"),
        F.size("most_common").cast("long").alias("n_common"), F.when(c("bounds").isNotNull(), F.size("bounds")).alias("n_bounds"),
    )


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 AS BIGINT) AS surplus FROM orders WHERE o_custkey % 10 = 3
UNION ALL SELECT o_orderkey, o_custkey, 'X', -1 FROM orders WHERE o_custkey % 10 = 3""")
def consistency_check(spark, sf):
    """A table against a sorted copy of it in which some rows were changed: exactly these differ."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders.withColumn("o_orderstatus", F.when(c("o_custkey") % 10 == 3, "X").otherwise(c("o_orderstatus")))
    return verify.differences(orders, scans.cluster_by(changed, ["o_custkey"]))


@query("""
SELECT 'rows by part' AS "rule", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'order of the first index', 0
UNION ALL SELECT 's_suppkey is null', 0 UNION ALL SELECT 's_name is longer than 200', 0
UNION ALL SELECT 'supplier_index_0 is unique', (SELECT COUNT(*) FROM (SELECT s_suppkey FROM supplier GROUP BY s_suppkey HAVING COUNT(*) > 1))""")
def table_check(spark, sf):
    """A stored table with an index, after changes, obeys all its rules."""
    engine = _stored(spark, sf, "supplier", (["s_suppkey"], True))
    engine.sql("UPDATE supplier SET s_nationkey = 1 WHERE s_suppkey < 5")
    return engine.store.check("supplier")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 70")
def index_lookup_after_create(spark, sf):
    """A lookup by a key whose index was made after the rows were there: laid out by it, and filtered in the reader."""
    engine = _stored(spark, sf, "orders")
    engine.sql("CREATE INDEX by_customer ON orders (o_custkey)")
    return engine.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 70")


@query("SELECT 'duplicate key' AS what, TRUE AS refused, COUNT(*) + 1 AS n FROM supplier UNION ALL SELECT 'null key', TRUE, COUNT(*) + 1 FROM supplier UNION ALL SELECT 'long text', TRUE, COUNT(*) + 1 FROM supplier UNION ALL SELECT 'index over duplicates', TRUE, COUNT(*) + 1 FROM supplier")
def rules_refuse(spark, sf):
    """Statements that break a rule are refused and change nothing."""
    engine = _stored(spark, sf, "supplier", (["s_suppkey"], True))
    first, nation = table(spark, sf, "supplier").agg(F.min("s_suppkey"), F.min("s_nationkey")).first()
    engine.sql(f"INSERT INTO supplier VALUES (-1, 'neighbour', {nation}, 0.0)")
    statements = {
        "duplicate key": f"INSERT INTO supplier VALUES ({first}, 'x', 1, 1.0)", "null key": "INSERT INTO supplier VALUES (NULL, 'x', 1, 1.0)",
        "long text": f"INSERT INTO supplier VALUES (-1, '{'x' * 201}', 1, 1.0)", "index over duplicates": "CREATE UNIQUE INDEX by_nation ON supplier (s_nationkey)",
    }
    out = []
    for what, sql in statements.items():
        try:
            engine.sql(sql)
            refused = False
        except ConstraintError:
            refused = True
        out.append((what, refused))
    return engine.spark.createDataFrame(out, "what string, refused boolean").withColumn("n", engine.sql("SELECT COUNT(*) AS n FROM supplier").scalar())


@query("""
SELECT 'Created table t.' AS message UNION ALL SELECT 'Created index i.' UNION ALL SELECT 'Inserted 1 row.' UNION ALL SELECT 'Inserted 1 row.'
UNION ALL SELECT 'Updated 2 rows.' UNION ALL SELECT 'Inserted 1 row.' UNION ALL SELECT 'Deleted 1 row.' UNION ALL SELECT 'Deleted 0 rows.' UNION ALL SELECT 'Deleted 2 rows.'""")
def command_messages(spark, sf):
    engine = _engine(spark)
    statements = (
        "CREATE TABLE t (a INT)", "CREATE INDEX i ON t (a)", "INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (2)",
        "UPDATE t SET a = 5 WHERE a > 0", "INSERT INTO t VALUES (3)", "DELETE FROM t WHERE a = 3 AND a < 5", "DELETE FROM t WHERE a = 9", "DELETE FROM t",
    )
    return spark.createDataFrame([(engine.sql(x).first()[0],) for x in statements], "message string")


@query("SELECT CAST(1 AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS versions")
def torn_commit(spark, sf):
    """A commit that was not written whole does not count, and the next writer goes on after it."""
    engine = _engine(spark)
    engine.sql("CREATE TABLE t (a INT)")
    engine.sql("INSERT INTO t VALUES (1)")
    engine.store.storage.publish("t/commits/000000000003.json", '{"table": ')
    engine.sql("UPDATE t SET a = 2")
    store = engine.store
    return engine.sql("SELECT COUNT(*) AS n_rows FROM t").select(c("n_rows"), F.lit(store.snapshot("t").version).cast("long").alias("versions"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, c_nationkey, 0.0 FROM customer WHERE c_nationkey = 3")
def transaction_commit(spark, sf):
    """Two tables changed together, and a third change rolled back."""
    engine = _engine(spark)
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    for name in ("here", "there"):
        engine.create_table(name, [ColumnDef("c_custkey", "BIGINT"), ColumnDef("c_nationkey", "INT"), ColumnDef("c_acctbal", "DOUBLE")])
    engine.load("here", customers)
    with engine.store.transaction() as both:
        both.append("there", both.read("here").where("c_nationkey = 3"))
        both.delete("here", c("c_nationkey") == 3)
        both.update("there", {"c_acctbal": 0.0})
    engine = Engine(spark, engine.store.root)
    engine.sql("BEGIN")
    engine.sql("DELETE FROM here")
    engine.sql("ROLLBACK")
    return engine.sql("SELECT * FROM here UNION ALL SELECT * FROM there")


@query("SELECT 'a condition reaches the reader' AS what, TRUE AS seen UNION ALL SELECT 'only named columns are read', TRUE UNION ALL SELECT 'groups are combined before the shuffle', TRUE UNION ALL SELECT 'the limit keeps few rows', TRUE")
def explain_plan(spark, sf):
    """What the plan of the flagship query shows."""
    plan = "\n".join(r.plan for r in explain(flagship(spark, sf)).collect())
    seen = {
        "a condition reaches the reader": "EqualTo(c_mktsegment,BUILDING)" in plan, "only named columns are read": "struct<o_custkey:bigint,o_totalprice:double>" in plan,
        "groups are combined before the shuffle": "partial_sum(o_totalprice" in plan, "the limit keeps few rows": "TakeOrderedAndProject" in plan,
    }
    return spark.createDataFrame(list(seen.items()), "what string, seen boolean")


@query("SELECT 'a projection of all columns is no step' AS what, TRUE AS seen UNION ALL SELECT 'rows in order are not sorted again', TRUE UNION ALL SELECT 'states are merged after one shuffle', TRUE")
def plan_shapes(spark, sf):
    """What the optimizer leaves out, by the plans of three queries."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    same = transforms.project(orders, orders.columns)
    again = ordering.sort(ordering.sort(orders, [("o_custkey", True)]), [("o_custkey", True)])
    groups = plan(aggregates.aggregate(orders, ["o_custkey"], {"n": ("count", "*"), "least": ("min", "o_orderkey")}))
    seen = {
        "a projection of all columns is no step": "Project" not in plan(same), "rows in order are not sorted again": plan(again).count("Sort [") == 1,
        "states are merged after one shuffle": groups.count("Exchange") == 1 and "partial_count" in groups and "partial_min" in groups,
    }
    return spark.createDataFrame(list(seen.items()), "what string, seen boolean")


@query("SELECT 'kept' AS which, COUNT(*) AS row_count FROM supplier UNION ALL SELECT 'after a change', COUNT(*) FROM supplier UNION ALL SELECT 'refreshed', COUNT(*) + 1 FROM supplier")
def stats_refresh(spark, sf):
    """Statistics stay as they were kept until they are asked for anew."""
    engine = _stored(spark, sf, "supplier")
    out = []
    for which in ("kept", "after a change", "refreshed"):
        if which == "after a change":
            engine.sql("INSERT INTO supplier VALUES (-1, 'new', 1, 0.0)")
        else:
            engine.analyze("supplier")
        out.append((which, engine.statistics("supplier").where(c("column") == "s_suppkey").first()["row_count"]))
    return spark.createDataFrame(out, "which string, row_count long")


@query("""
SELECT CAST(1 AS BIGINT) AS version, 'create' AS operation UNION ALL SELECT 2, 'insert' UNION ALL SELECT 3, 'create index by_nation' UNION ALL SELECT 4, 'update'
UNION ALL SELECT 5, 'delete' UNION ALL SELECT 6, 'insert, update' UNION ALL SELECT 7, 'compact'""")
def table_history(spark, sf):
    """What was done to a table, as its commits tell."""
    engine = _stored(spark, sf, "supplier")
    engine.sql("CREATE INDEX by_nation ON supplier (s_nationkey)")
    first = engine.sql("SELECT MIN(s_suppkey) FROM supplier").first()[0]
    engine.sql(f"UPDATE supplier SET s_nationkey = 1 WHERE s_suppkey > {first}")
    engine.sql(f"DELETE FROM supplier WHERE s_suppkey = {first}")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO supplier VALUES (-1, 'new', 1, 0.0)")
    engine.sql("UPDATE supplier SET s_acctbal = 1.5 WHERE s_suppkey = -1")
    engine.sql("COMMIT")
    engine.store.compact("supplier")
    return spark.createDataFrame(engine.store.history("supplier"), "version long, operation string")
