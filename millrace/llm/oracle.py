"""SQL that gives the rows of the queries in this package, where SQL can."""

P1_ROWS = "SELECT DISTINCT dept, id, salary FROM emp WHERE dept IS NOT NULL AND salary IS NOT NULL"

P1_FOUND = f"""
WITH e AS ({P1_ROWS}),
     v AS (SELECT dept, salary, COUNT(*) AS c FROM e GROUP BY dept, salary),
     r AS (SELECT dept, salary, SUM(c) OVER (PARTITION BY dept ORDER BY salary) AS upto, SUM(c) OVER (PARTITION BY dept) AS n FROM v),
     h AS (SELECT DISTINCT dept, bucket_no, upper_bound, cumulative_fraction FROM histogram_bucket
           WHERE upper_bound IS NOT NULL AND cumulative_fraction IS NOT NULL),
     f AS (SELECT h.dept, h.bucket_no, h.upper_bound, h.cumulative_fraction, MAX(r.n) AS n,
                  COALESCE(MAX(r.upto) FILTER (WHERE r.salary < h.upper_bound), 0) AS below,
                  COALESCE(MAX(r.upto) FILTER (WHERE r.salary <= h.upper_bound), 0) AS upto
           FROM h JOIN r ON r.dept = h.dept GROUP BY ALL)
SELECT DISTINCT dept, bucket_no FROM f
WHERE cumulative_fraction < below::DOUBLE / n - 0.05 OR cumulative_fraction > upto::DOUBLE / n + 0.05
"""

P1_PERCENTILES = f"""
WITH e AS ({P1_ROWS}), g AS (SELECT dept, COUNT(*) AS n FROM e GROUP BY dept),
     q AS (SELECT UNNEST([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS fraction),
     p AS (SELECT dept, UNNEST([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS fraction,
                  UNNEST(QUANTILE_CONT(salary, [0.05, 0.25, 0.5, 0.75, 0.95]))::DOUBLE AS percentile FROM e GROUP BY dept)
SELECT p.dept AS dept, g.n AS n, p.fraction AS fraction, ROUND(p.percentile, 6) AS percentile FROM p JOIN g ON g.dept = p.dept
"""

# a stretch of n / m values stands for the value in its middle; 50 stretches per pay day and department at most
P1_FROM_CONDENSED = """
WITH e AS (SELECT DISTINCT pay_day, dept, id, salary FROM emp WHERE dept IS NOT NULL AND salary IS NOT NULL),
     r AS (SELECT pay_day, dept, salary, ROW_NUMBER() OVER (PARTITION BY pay_day, dept ORDER BY salary) - 1 AS place, COUNT(*) OVER (PARTITION BY pay_day, dept) AS n FROM e),
     s AS (SELECT pay_day, dept, n, LEAST(n, 50) AS m, UNNEST(RANGE(0, LEAST(n, 50))) AS s FROM (SELECT DISTINCT pay_day, dept, n FROM r)),
     w AS (SELECT s.dept, r.salary, (s.s + 1) * s.n // s.m - s.s * s.n // s.m AS weight
           FROM s JOIN r ON r.pay_day IS NOT DISTINCT FROM s.pay_day AND r.dept = s.dept AND r.place = (2 * s.s + 1) * s.n // (2 * s.m)),
     v AS (SELECT dept, salary, UNNEST(RANGE(0, weight)) FROM w),
     p AS (SELECT dept, COUNT(*) AS n, UNNEST([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS fraction,
                  UNNEST(QUANTILE_CONT(salary, [0.05, 0.25, 0.5, 0.75, 0.95]))::DOUBLE AS percentile FROM v GROUP BY dept)
SELECT dept, n, fraction, ROUND(percentile, 6) AS percentile FROM p
"""

P2_COUNTS = """
WITH e AS (SELECT DISTINCT relation_id, column_idx, segment_no, tuple_count, value, frequency FROM mcv_entry),
     t AS (SELECT relation_id, column_idx, SUM(tuple_count)::DOUBLE AS total
           FROM (SELECT DISTINCT relation_id, column_idx, segment_no, tuple_count FROM mcv_entry) GROUP BY ALL),
     c AS (SELECT relation_id, column_idx, value, SUM(frequency * tuple_count) AS n FROM e WHERE value IS NOT NULL AND frequency IS NOT NULL GROUP BY ALL)
"""

P2_FOUND = P2_COUNTS + """
SELECT c.relation_id AS relation_id, c.column_idx AS column_idx, c.value AS value
FROM c JOIN t ON t.relation_id = c.relation_id AND t.column_idx = c.column_idx WHERE c.n / t.total >= 0.015
"""

P2_TOP_VALUES = P2_COUNTS + """
SELECT relation_id, column_idx, value, ROUND(n, 3) AS n, rank FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY relation_id, column_idx ORDER BY ROUND(n, 6) DESC, value) AS INTEGER) AS rank FROM c)
WHERE rank <= 20
"""

P2_TOP_DEPARTMENTS = """
SELECT dept, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, dept) AS INTEGER) AS rank
FROM (SELECT dept, COUNT(*) AS n FROM emp WHERE dept IS NOT NULL GROUP BY dept) ORDER BY n DESC, dept LIMIT 20
"""

P4_FOUND = f"""
SELECT dept, id FROM (SELECT dept, id, ROW_NUMBER() OVER (PARTITION BY dept ORDER BY salary DESC, id) AS r FROM ({P1_ROWS})) WHERE r <= 3
"""

P6_FOUND = r"""
WITH d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(REGEXP_REPLACE(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, REGEXP_EXTRACT_ALL(LOWER(REGEXP_REPLACE(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM eval_item WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, ARRAY_TO_STRING(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 10)) AS p FROM d WHERE LEN(w) >= 12)),
     ig AS (SELECT DISTINCT item_id, ARRAY_TO_STRING(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, UNNEST(RANGE(1, LEN(w) - 10)) AS p FROM i WHERE LEN(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
# windows of an item in a document that begin within twelve words of one another are one span
P6_SPANS = P6_FOUND.rsplit("SELECT DISTINCT", 1)[0].replace("SELECT doc_id, ARRAY_TO_STRING", "SELECT doc_id, p, ARRAY_TO_STRING") + """
  , h AS (SELECT DISTINCT doc_id, item_id, p FROM dg JOIN ig USING (g)),
     b AS (SELECT *, CASE WHEN p - LAG(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) <= 12 THEN 0 ELSE 1 END AS fresh FROM h),
     s AS (SELECT *, SUM(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS span FROM b)
SELECT doc_id, item_id, CAST(MIN(p) - 1 AS INTEGER) AS first_word, CAST(MAX(p) + 11 AS INTEGER) AS end_word FROM s GROUP BY doc_id, item_id, span
"""

P7_FILLED = """
WITH d AS (SELECT doc_id, LOWER(TRIM(source)) AS source, STRLEN(text) AS n FROM documents WHERE text <> ''),
     t AS (SELECT LOWER(TRIM(source)) AS source, SUM(target_share) AS share, MAX(max_repeats) AS repeats FROM mix_target WHERE source IS NOT NULL GROUP BY ALL),
     own AS (SELECT source, SUM(n) AS n FROM d GROUP BY source)
SELECT t.source AS source, CAST(FLOOR((SELECT SUM(n) FROM d)::DOUBLE * t.share) AS BIGINT) AS wanted,
       CAST(COALESCE(own.n, 0) * t.repeats AS BIGINT) AS available, TRUE AS filled
FROM t LEFT JOIN own ON own.source = t.source
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_percentiles": P1_PERCENTILES, "p1_from_condensed": P1_FROM_CONDENSED, "p2_found": P2_FOUND, "p2_top_values": P2_TOP_VALUES,
        "p2_top_departments": P2_TOP_DEPARTMENTS, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p6_spans": P6_SPANS, "p7_filled": P7_FILLED,
    }
