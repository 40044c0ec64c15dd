"""Queries whose text two engines share, one for each entry of the operator inventory and each decision-support shape.

A text holds two macros, expanded for each engine: [[avg|x|s]] is the average of
a decimal of scale s with four more digits, [[ratio|n|sn|d|sd|s]] a quotient of
sums n (scale sn) and d (scale sd) with s digits; both round half away from
zero and are worked out in integers where an engine would go through doubles.
Names start with the inventory's numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessaline.plans.catalog import duckdb_sql

_MACRO = re.compile(r"\[\[(\w+)\|(.*?)\]\]", re.S)


def _units(n: str, whole: str, scale: int) -> str:
    return f"CAST(({n}) * {10**scale} AS {whole})"


def _spark(m: re.Match) -> str:
    kind, args = m[1], m[2].split("|")
    if kind == "avg":
        return f"CAST(avg({args[0]}) AS DECIMAL(38, {int(args[1]) + 4}))"
    n, sn, d, sd, s = args[0], int(args[1]), args[2], int(args[3]), int(args[4])
    n, d = _units(n, "DECIMAL(24, 0)", sn), _units(d, "DECIMAL(24, 0)", sd)
    up = 10 ** (s + sd - sn)
    return f"CASE WHEN {d} <> 0 THEN CAST(CAST((2 * {n} * {up} + {d}) DIV (2 * {d}) AS DECIMAL(19, 0)) * CAST('{10**-s:.{s}f}' AS DECIMAL({s + 1}, {s})) AS DECIMAL(38, {s})) END"


def _duck(m: re.Match) -> str:
    kind, args = m[1], m[2].split("|")
    if kind == "avg":
        s = int(args[1])
        n, d, out, up = _units(f"sum({args[0]})", "HUGEINT", s), f"count({args[0]})", s + 4, 10**4
    else:
        sn, sd, out = int(args[1]), int(args[3]), int(args[4])
        n, d, up = _units(args[0], "HUGEINT", sn), _units(args[2], "HUGEINT", sd), 10 ** (out + sd - sn)
    return f"CASE WHEN {d} <> 0 THEN CAST(CAST(sign({n}) * ((2 * abs({n}) * {up} + {d}) // (2 * {d})) AS DECIMAL(25, 0)) * CAST('{10**-out:.{out}f}' AS DECIMAL({out + 1}, {out})) AS DECIMAL(38, {out})) END"


@dataclass(frozen=True)
class Query:
    doc: str
    text: str
    other: str | None = None  # the other engine's text where it differs

    def spark(self) -> str:
        return _MACRO.sub(_spark, self.text)

    def oracle(self) -> str:
        return duckdb_sql(_MACRO.sub(_duck, self.other or self.text))


QUERIES: dict[str, Query] = {}


def q(name: str, doc: str, text: str, other: str | None = None) -> None:
    QUERIES[name] = Query(doc, text, other)


REVENUE = "l_extendedprice * (1 - l_discount)"
PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS DECIMAL(12, 2)) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"

# --- decision-support shapes; what the tables lack is replaced by the nearest column -----------------------------

q("q1_pricing_summary", "S1 P5 P6 P22 A1 A3 A4 A5 O1: pricing summary report", f"""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DECIMAL(38, 2)) AS sum_qty, CAST(sum(l_extendedprice) AS DECIMAL(38, 2)) AS sum_base_price,
       CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS sum_disc_price, CAST(sum({REVENUE} * (1 + l_tax)) AS DECIMAL(38, 6)) AS sum_charge,
       [[avg|l_quantity|2]] AS avg_qty, [[avg|l_extendedprice|2]] AS avg_price, [[avg|l_discount|2]] AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
q("q2_minimum_cost_supplier", "P27 J1: correlated minimum", f"""
WITH {PARTSUPP}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%O%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM partsupp x, supplier y, nation m, region g
    WHERE p_partkey = x.ps_partkey AND y.s_suppkey = x.ps_suppkey AND y.s_nationkey = m.n_nationkey AND m.n_regionkey = g.r_regionkey AND g.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
q("q3_shipping_priority", "J1 O1 O3: joins, grouping, top ten", f"""
SELECT l_orderkey, CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS revenue, o_orderdate, o_orderpriority FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
q("q4_order_priority", "P15 J6: EXISTS", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 30 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")
q("q5_local_supplier_volume", "J1: six-way join", f"""
SELECT n_name, CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC""")
q("q6_revenue_change", "P5 P12 A2: filtered global sum", """
SELECT CAST(sum(l_extendedprice * l_discount) AS DECIMAL(38, 4)) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
q("q7_volume_shipping", "J1 J15 F12: derived table, OR across tables", f"""
SELECT supp_nation, cust_nation, l_year, CAST(sum(volume) AS DECIMAL(38, 4)) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS l_year, {REVENUE} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
q("q8_market_share", "P19 A11: ratio of conditional sums", f"""
SELECT o_year, [[ratio|sum(CASE WHEN nation_name = 'NATION_5' THEN volume ELSE 0 END)|4|sum(volume)|4|8]] AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation_name
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""")
q("q9_product_profit", "P16 J1: profit by nation and year", f"""
WITH {PARTSUPP}
SELECT nation_name, o_year, CAST(sum(amount) AS DECIMAL(38, 4)) AS sum_profit FROM (
  SELECT n_name AS nation_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} - ps_supplycost * CAST(0.1 AS DECIMAL(3, 2)) AS amount
  FROM part, supplier, lineitem, partsupp, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit
GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""")
q("q10_returned_items", "J1 O3: top twenty customers", f"""
SELECT c_custkey, c_name, CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
q("q11_important_stock", "P26 A10: HAVING against a scalar subquery", f"""
WITH {PARTSUPP}
SELECT ps_partkey, CAST(sum(ps_supplycost * ps_availqty) AS DECIMAL(38, 4)) AS stock FROM partsupp, supplier, nation
WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey
HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * CAST(0.002 AS DECIMAL(4, 3)) FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
ORDER BY stock DESC, ps_partkey""")
q("q12_flags_and_priority", "P13 P19: conditional counts", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""")
q("q13_customer_distribution", "J4 J9 J15: outer join with a residual condition", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
q("q14_promotion_effect", "P16 P19 A11: percentage", f"""
SELECT [[ratio|100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END)|4|sum({REVENUE})|4|8]] AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""")
q("q15_top_supplier", "P26: view with a scalar subquery over itself", f"""
WITH revenue0 AS (SELECT l_suppkey AS supplier_no, sum({REVENUE}) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, CAST(total_revenue AS DECIMAL(38, 4)) AS total_revenue FROM supplier, revenue0
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey""")
q("q16_part_supplier", "J7 P14 A8: NOT IN with COUNT(DISTINCT)", f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
q("q17_small_quantity", "P27: correlated average", """
SELECT [[ratio|sum(l_extendedprice)|2|CAST(7 AS DECIMAL(2, 0))|0|6]] AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_type = 'LARGE' AND l_quantity * 5 < (SELECT sum(x.l_quantity) / count(*) FROM lineitem x WHERE x.l_partkey = p_partkey)""")
q("q18_large_orders", "P14 A10: IN over a grouped subquery", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(l_quantity) AS DECIMAL(38, 2)) AS quantity FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 240) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
q("q19_discounted_revenue", "P9 P12 P13: disjunction over both sides", f"""
SELECT CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND
  ((p_brand = 'Brand#12' AND p_type IN ('SMALL', 'ECONOMY') AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'STANDARD') AND l_quantity >= 10 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#19' AND p_type IN ('LARGE', 'PROMO') AND l_quantity >= 20 AND l_quantity <= 40 AND p_size BETWEEN 1 AND 50))""")
q("q20_promotion_candidates", "P14 P27: nested IN with a correlated sum", f"""
WITH {PARTSUPP}
SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (
    SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
      AND ps_availqty > (SELECT sum(l_quantity) / 2 FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'))
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_8', 'NATION_15', 'NATION_20') ORDER BY s_name""")
q("q21_waiting_suppliers", "J6 J7 J10: EXISTS and NOT EXISTS on the same table", """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL 30 DAY
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_4') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
q("q22_sales_opportunity", "P26 J7: scalar subquery and NOT EXISTS", """
SELECT c_nationkey, count(*) AS numcust, CAST(sum(c_acctbal) AS DECIMAL(38, 2)) AS totacctbal FROM customer
WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT sum(c_acctbal) / count(*) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000) GROUP BY c_nationkey ORDER BY c_nationkey""")

# --- projection, filters, predicates ------------------------------------------------------------------------------

q("S1_typed_scan", "S1 S3: a scan of the columns asked for", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= DATE '2001-06-01'")
q("S6_values", "S6: constant rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
q("S7_no_from", "S7: constants without FROM; a false WHERE gives no row", "SELECT 1 AS one, 'a' AS letter, CAST(2.50 AS DECIMAL(3, 2)) AS price UNION ALL SELECT 2, 'b', CAST(0 AS DECIMAL(3, 2)) WHERE 1 = 2")
q("P2_star", "P1 P2 P3: stars of one table of a join, and aliases", "SELECT n.*, r_name AS region_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
q("P4_constants_only", "P4: constants keep the number of rows", "SELECT 1 AS one, 'a' AS letter FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 490000")
q("P6_comparisons", "P6 P7: all comparisons, with an implicit cast of a literal", """
SELECT o_orderkey, o_totalprice = 200000 AS eq, o_totalprice <> 200000 AS ne, o_totalprice < 200000 AS lt, o_totalprice <= 200000 AS le, o_totalprice > 200000 AS gt, o_totalprice >= 200000 AS ge
FROM orders WHERE o_orderdate > DATE '2001-07-01'""")
q("P8_null_safe_equal", "P8 (extension): null-safe equality", "SELECT a, b, a <=> b AS same FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL)) AS t(a, b)", "SELECT a, b, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL)) AS t(a, b)")
q("P9_three_valued_logic", "P9: AND, OR, NOT with unknown", "SELECT x.v AS a, y.v AS b, x.v AND y.v AS a_and_b, x.v OR y.v AS a_or_b, NOT x.v AS not_a FROM (VALUES (TRUE), (FALSE), (CAST(NULL AS BOOLEAN))) AS x(v) CROSS JOIN (VALUES (TRUE), (FALSE), (CAST(NULL AS BOOLEAN))) AS y(v)")
q("P11_is_null", "P11: IS [NOT] NULL over an outer join", "SELECT c_custkey, o_orderkey IS NULL AS without, o_orderkey IS NOT NULL AS with_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
q("P12_between", "P12: BETWEEN and NOT BETWEEN", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1050")
q("P13_in_list", "P13: IN and NOT IN lists", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type NOT IN ('PROMO', 'LARGE')")
q("P14_in_subquery", "P14 J6: IN (subquery)", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
q("P15_not_exists", "P15 J7: NOT EXISTS", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
q("P16_like", "P16: LIKE with % and _", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%_ing' AND p_name NOT LIKE 'r%' AND p_brand LIKE 'Brand#1_'")
q("P19_case", "P19: searched and simple CASE", """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'middle' END AS band,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders""")
q("P20_if", "P20: IF", "SELECT o_orderkey, IF(o_orderstatus = 'F', o_totalprice, 0) AS done FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS done FROM orders")
q("P21_coalesce", "P21: COALESCE of several", "SELECT c_custkey, COALESCE(o_orderkey, -c_custkey) AS reference FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
q("P24_intervals", "P24 F8: dates plus and minus intervals; month ends clamp", """
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS month_on, CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS year_back, CAST(o_orderdate + INTERVAL 14 DAY AS DATE) AS two_weeks
FROM orders""")
q("P26_scalar_subquery", "P26: uncorrelated scalar subquery", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > (SELECT max(s_acctbal) * CAST(0.9 AS DECIMAL(2, 1)) FROM supplier)")
q("P27_correlated_scalar", "P27: correlated scalar subquery in SELECT", "SELECT n_nationkey, n_name, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS best FROM nation")

# --- joins --------------------------------------------------------------------------------------------------------

q("J1_inner", "J1: inner join with ON, and a comma join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey, nation WHERE c_nationkey = n_nationkey AND o_totalprice > 450000")
q("J2_hash", "J2: hash join by hint, build side with unique keys", "SELECT /*+ SHUFFLE_HASH(o) */ l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders o ON l_orderkey = o_orderkey WHERE l_quantity = 50")
q("J3_merge", "J3: sort-merge join by hint, keys unique on neither side", "SELECT /*+ MERGE(s) */ c_custkey, s_suppkey FROM customer JOIN supplier s ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000")
q("J4_left", "J4: left outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
q("J4_right", "J4: right outer", "SELECT n_nationkey, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
q("J5_full", "J5: full outer with rows of both sides unmatched", """
SELECT a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.k = b.k""")
q("J7_not_in_null_aware", "J7: NOT IN is empty when the list holds a null, and passes all when it is empty", """
SELECT 'without null' AS kind, s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
UNION ALL SELECT 'with null', s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN c_acctbal > 9900 THEN NULL ELSE c_nationkey END FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT 'empty', s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 1000000)""")
q("J8_theta", "J8: join on an inequality, and a product", "SELECT a.r_name AS first_name, b.r_name AS second_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey UNION ALL SELECT a.r_name, n_name FROM region a CROSS JOIN nation WHERE n_nationkey < 3")
q("J8_theta_left", "J8: outer join on an inequality", "SELECT a.r_regionkey AS k, b.n_nationkey AS n FROM region a LEFT JOIN nation b ON a.r_regionkey * 10 > b.n_nationkey + 12")
q("J9_residual_left", "J9: the residual of an outer join stays in ON", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 48")
q("J9_residual_full", "J9: residual of a full join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_acctbal + c_acctbal > 19000")
q("J9_residual_semi", "J9: residual of a semi join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice * 4 > o_totalprice) AND o_orderdate >= DATE '2001-01-01'")
q("J_empty_sides", "J1 J4 J5: an empty side", """
SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey AND o_custkey = 123456789
UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey = 123456789) o ON c_custkey = o_custkey
UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN (SELECT * FROM orders WHERE o_custkey = 123456789) o ON c_custkey = o_custkey
UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_custkey = 123456789)""")
q("J11_star", "J11: a fact table and three dimensions", f"""
SELECT n_name, p_type, c_mktsegment, CAST(sum({REVENUE}) AS DECIMAL(38, 4)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_shipdate >= DATE '2001-01-01' GROUP BY n_name, p_type, c_mktsegment""")
q("J15_derived", "J15: derived table with column names", "SELECT t.k, t.total FROM (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey) AS t(k, total) WHERE t.total > 3000000", "SELECT t.k, CAST(t.total AS DECIMAL(22, 2)) AS total FROM (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey) AS t(k, total) WHERE t.total > 3000000")

# --- aggregation, order, sets -------------------------------------------------------------------------------------

q("A1_group_by_forms", "A1: expression and ordinal keys", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
q("A2_empty_global", "A2 A3 A4: one row for an empty input", "SELECT count(*) AS n, count(o_custkey) AS m, CAST(sum(o_totalprice) AS DECIMAL(38, 2)) AS total, max(o_orderdate) AS last FROM orders WHERE o_orderkey < 0")
q("A3_counts", "A3: COUNT(*) and COUNT(x)", "SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS positive FROM customer GROUP BY c_nationkey")
q("A4_sums", "A4: SUM of integers and decimals", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS sizes, CAST(sum(p_retailprice) AS DECIMAL(38, 2)) AS prices FROM part GROUP BY p_type")
q("A5_avg", "A5: AVG keeps four more digits", "SELECT p_brand, [[avg|p_retailprice|2]] AS price, [[avg|CAST(p_size AS DECIMAL(10, 0))|0]] AS size FROM part GROUP BY p_brand")
q("A6_min_max", "A6: MIN and MAX of numbers, text and dates", "SELECT o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS first_priority, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus")
q("A7_any_value", "A7: ANY_VALUE of a determined column", "SELECT c_nationkey, any_value(n_name) AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey")
q("A8_distinct_aggregates", "A8: several aggregates of distinct values", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_quantity) AS DECIMAL(38, 2)) AS quantities, min(DISTINCT l_linenumber) AS first_line, max(DISTINCT l_tax) AS high_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag")
q("A9_distinct", "A9: SELECT DISTINCT", "SELECT DISTINCT p_brand, p_type FROM part")
q("A10_having", "A10: HAVING on an aggregate that is not selected", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 495000 AND count(*) > 5")
q("A11_over_aggregates", "A11: expressions over aggregates, in ORDER BY too", "SELECT o_orderpriority, [[ratio|sum(o_totalprice)|2|count(*)|0|6]] AS mean, CASE WHEN sum(o_totalprice) > 700000000 THEN 'big' ELSE 'small' END AS kind FROM orders GROUP BY o_orderpriority ORDER BY max(o_totalprice) - min(o_totalprice)")
q("A12_constants_with_groups", "A12: constants beside groups", "SELECT 7 AS seven, 'x' AS letter, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
q("A18_rollup", "A18 (extension): ROLLUP", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("A18_cube", "A18 (extension): CUBE with GROUPING", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
q("A19_more_aggregates", "A19 (extension): COUNT(DISTINCT a, b) as a count of pairs", "SELECT count(*) AS pairs FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) t")
q("O1_order_by_forms", "O1 O2: null is smallest, ordinals and hidden keys", "SELECT a, b FROM (VALUES (1, 'x'), (NULL, 'y'), (3, NULL), (2, 'z')) AS t(a, b) ORDER BY 1 NULLS FIRST LIMIT 3", None)
q("O3_limit_offset", "O3 O4: LIMIT with OFFSET", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
q("O3_limit_zero", "O3: LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")
q("U1_union_all", "U1: UNION ALL", "SELECT c_nationkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000")
q("U2_union", "U2: UNION", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("U3_intersect_except", "U3 (extension): INTERSECT and EXCEPT", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) x UNION ALL SELECT 'first', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) y")
q("X_window_ranks", "2.5 (extension): ROW_NUMBER, RANK, DENSE_RANK, LAG, running sums", """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS dr,
       lag(o_totalprice) OVER w AS before, CAST(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38, 2)) AS last_three
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
q("X_cte", "2.11 (extension): WITH", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")

# --- combinations -------------------------------------------------------------------------------------------------

q("C1_empty_right_aggregate", "J4 A2: aggregates over the empty side of an outer join", """
SELECT c_nationkey, count(*) AS n, count(o_orderkey) AS placed, max(o_orderdate) AS last, CAST(sum(o_totalprice) AS DECIMAL(38, 2)) AS total
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey = 123456789) o ON c_custkey = o_custkey GROUP BY c_nationkey""")
q("C2_residual_on_kept_side", "J9: a residual on the kept side of an outer join drops matches, not rows", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 9000 AND o_orderstatus = 'F'")
q("C3_row_in_subquery", "P14: several columns IN a subquery", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
q("C4_subquery_in_case", "P19 P26: a scalar subquery inside CASE", "SELECT s_suppkey, CASE WHEN s_acctbal > (SELECT sum(s_acctbal) / count(*) FROM supplier) THEN 'above' ELSE 'below' END AS side FROM supplier")
q("C5_nested_derived", "J15: derived tables three deep", """
SELECT band, count(*) AS n FROM (SELECT k, CASE WHEN n > 10 THEN 'many' ELSE 'few' END AS band FROM (SELECT o_custkey AS k, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') a GROUP BY o_custkey) b) c GROUP BY band""")
q("C6_join_of_aggregates", "J1 A1: two grouped tables joined", """
SELECT a.k AS k, a.n AS placed, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey) a
JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""")
q("C7_union_in_derived", "U1 A1: grouping over a union with constants", "SELECT side, k, count(*) AS n FROM (SELECT 'buys' AS side, c_nationkey AS k FROM customer UNION ALL SELECT 'sells', s_nationkey FROM supplier) t GROUP BY side, k")
q("C8_case_as_key", "A1 P19: CASE as a grouping key", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS band, count(*) AS n, CAST(sum(l_extendedprice) AS DECIMAL(38, 2)) AS total FROM lineitem GROUP BY CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END")
q("C9_semi_and_anti", "J6 J7: EXISTS and NOT IN side by side", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
  AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)""")
q("C10_text_in_other_scripts", "P16: LIKE on characters of several bytes", """
SELECT a, a LIKE '_é%' AS second, a LIKE '%界' AS last, a LIKE '____' AS four, substring(a, 2, 2) AS middle FROM (VALUES ('héro'), ('世界'), ('éé'), (NULL), ('naïf')) AS t(a)""")
q("C11_correlated_count", "P27 A3: a correlated count, nought included", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS rich FROM nation")
q("C12_exists_with_or", "P9 P15: EXISTS or a plain condition", "SELECT p_partkey FROM part WHERE p_size > 48 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50 AND l_discount > 0.09)")
q("C13_full_of_three", "J5: a full join of a full join", """
SELECT coalesce(a.k, b.k, c.k) AS k, a.n AS an, b.n AS bn, c.n AS cn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY c_nationkey) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) b ON a.k = b.k
FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS n FROM nation) c ON coalesce(a.k, b.k) = c.k""")
q("C14_distinct_and_plain", "A8 A10: DISTINCT and plain aggregates with HAVING on a distinct one", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_day FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = 3")
