"""Queries of the engine's own operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import eager, replay
from millrace.plans import relational
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]
HEAVY_SHARE = 0.03


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay.table_state(table(spark, sf, "log_record")).select("relation_id", "page_no", "slot_no", "lsn")


def p3_state(spark: SparkSession, sf: str) -> DataFrame:
    """Content of every live tuple."""
    return replay.table_state(table(spark, sf, "log_record"))


def p3_undo(spark: SparkSession, sf: str) -> DataFrame:
    """Undo entries that the feed and the stored undo list do not agree on."""
    ours = replay.undo_list(table(spark, sf, "log_record"))
    stored = table(spark, sf, "heap_item").select("lsn", "txn_id").distinct()
    sides = ours.withColumn("side", F.lit("feed")).unionByName(stored.withColumn("side", F.lit("stored")))
    return sides.groupBy("lsn", "txn_id").agg(F.min("side").alias("side"), F.max("side").alias("other")).where("side = other").select("lsn", "txn_id", "side")


def p3_undo_lagging(spark: SparkSession, sf: str) -> DataFrame:
    """Undo entries of a feed that lacks half of its COMMIT and ABORT records (those with odd numbers), beyond the stored list."""
    log = table(spark, sf, "log_record")
    ours = replay.undo_list(log.where(~F.upper(F.trim("type")).isin("COMMIT", "ABORT") | (F.col("lsn") % 2 == 0)))
    stored = table(spark, sf, "heap_item").select("lsn", "txn_id").distinct()
    return ours.join(stored.select(F.col("lsn").alias("l"), F.col("txn_id").alias("t")), (F.col("lsn") == F.col("l")) & F.col("txn_id").eqNullSafe(F.col("t")), "left_anti")


def _by_department(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "dept").select("id").distinct()
    return eager.eager_join_aggregate(
        table(spark, sf, "emp"), names, ("dept", "id"), how="left", key_name="dept",
        left_aggs={"with_salary": ("count", "salary"), "payroll": ("sum", "salary"), "lowest": ("min", "salary"), "highest": ("max", "salary")},
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return eager.heavy_keys(_by_department(spark, sf), "dept", HEAVY_SHARE).select("dept")


def p5_departments(spark: SparkSession, sf: str) -> DataFrame:
    return _by_department(spark, sf).withColumnRenamed("joined_rows", "n_rows")


def p5_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Rolled up by department name; every delivery of a department row counts, as in the plain join."""
    states = eager.eager_join_aggregate(
        table(spark, sf, "emp"), table(spark, sf, "dept"), ("dept", "id"), right_group=["dname"], key_name="dept",
        left_aggs={"payroll": ("sum", "salary"), "highest": ("max", "salary")}, right_aggs={"name_rows": ("count", "dname")},
    )
    return eager.rollup(states, ["dname"], {"joined_rows": "count", "payroll": "sum", "highest": "max", "name_rows": "sum"}).withColumnRenamed("joined_rows", "n_rows")


CHANGES = """
WITH k AS (SELECT *, UPPER(TRIM(type)) AS kind FROM log_record),
     c AS (SELECT k.* FROM k WHERE kind IN ('HEAP_INSERT', 'HEAP_UPDATE', 'HEAP_DELETE')
           AND txn_id IN (SELECT txn_id FROM k WHERE kind = 'COMMIT' AND txn_id IS NOT NULL)),
     l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY relation_id, page_no, slot_no ORDER BY lsn DESC) AS r FROM c)
"""

P_SQL = {
    "p3_found": CHANGES + "SELECT relation_id, page_no, slot_no, lsn FROM l WHERE r = 1 AND kind <> 'HEAP_DELETE'",
    "p3_state": CHANGES + r"""
SELECT relation_id, page_no, slot_no, lsn,
       CAST(NULLIF(SPLIT_PART(after_image, '|', 1), 'NULL') AS INTEGER) AS id, CAST(NULLIF(SPLIT_PART(after_image, '|', 2), 'NULL') AS INTEGER) AS dept,
       CAST(NULLIF(SPLIT_PART(after_image, '|', 3), 'NULL') AS INTEGER) AS salary,
       REPLACE(NULLIF(REGEXP_REPLACE(after_image, '^[^|]*\|[^|]*\|[^|]*\|', ''), 'NULL'), '\|', '|') AS name
FROM l WHERE r = 1 AND kind <> 'HEAP_DELETE'""",
    "p3_undo": """
WITH k AS (SELECT *, UPPER(TRIM(type)) AS kind FROM log_record),
     o AS (SELECT DISTINCT lsn, txn_id FROM k WHERE kind LIKE 'HEAP_%' AND txn_id NOT IN (SELECT txn_id FROM k WHERE kind IN ('COMMIT', 'ABORT') AND txn_id IS NOT NULL)),
     s AS (SELECT DISTINCT lsn, txn_id FROM heap_item)
SELECT lsn, txn_id, 'feed' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM s) UNION ALL
SELECT lsn, txn_id, 'stored' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM o)""",
    "p3_undo_lagging": """
WITH k AS (SELECT *, UPPER(TRIM(type)) AS kind FROM log_record),
     e AS (SELECT DISTINCT txn_id FROM k WHERE kind IN ('COMMIT', 'ABORT') AND lsn % 2 = 0 AND txn_id IS NOT NULL)
SELECT DISTINCT k.lsn AS lsn, k.txn_id AS txn_id FROM k WHERE kind IN ('HEAP_INSERT', 'HEAP_UPDATE', 'HEAP_DELETE')
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.txn_id = k.txn_id)
  AND NOT EXISTS (SELECT 1 FROM heap_item h WHERE h.lsn = k.lsn AND h.txn_id IS NOT DISTINCT FROM k.txn_id)""",
    "p5_found": "SELECT dept FROM emp WHERE dept IS NOT NULL GROUP BY dept HAVING COUNT(*) >= 0.03 * (SELECT COUNT(*) FROM emp)",
    "p5_departments": """
SELECT e.dept AS dept, COUNT(*) AS n_rows, COUNT(e.salary) AS with_salary, CAST(SUM(e.salary) AS BIGINT) AS payroll, MIN(e.salary) AS lowest, MAX(e.salary) AS highest
FROM emp e LEFT JOIN (SELECT DISTINCT id FROM dept) d ON e.dept = d.id GROUP BY e.dept""",
    "p5_by_name": """
SELECT d.dname AS dname, COUNT(*) AS n_rows, CAST(SUM(e.salary) AS BIGINT) AS payroll, MAX(e.salary) AS highest, COUNT(d.dname) AS name_rows
FROM emp e JOIN dept d ON e.dept = d.id GROUP BY d.dname""",
}


def queries() -> dict[str, Query]:
    return relational.QUERIES | {
        "p3_found": p3_found, "p3_state": p3_state, "p3_undo": p3_undo, "p3_undo_lagging": p3_undo_lagging,
        "p5_found": p5_found, "p5_departments": p5_departments, "p5_by_name": p5_by_name,
    }


def oracle_sql() -> dict[str, str]:
    return relational.SQL | P_SQL
