"""Queries that are built from the library's operators and functions, with an independent text for each where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.functions import dialect, narrow, scalar, wide
from tessaline.functions.narrow import Spec
from tessaline.functions.wide import Col
from tessaline.operators import aggregates, joins, partitions, sets
from tessaline.plans.catalog import duckdb_sql, load, register
from tessaline.session import scratch
from tessaline.sources import delimited
from tessaline.sources.snapshot import SnapshotTable
from tessaline.streaming import events as streaming

Build = Callable[[SparkSession, str], DataFrame]
BUILT: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        BUILT[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duckdb_sql(oracle)
        return f

    return add


def dialect_query(name: str, doc: str, text: str, tables: list[str], oracle: str) -> None:
    """A statement of the SQL entry point."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return dialect.sql(spark, text)

    run.__name__, run.__doc__ = name, doc
    query(oracle)(run)


# --- scalar functions through the SQL entry point -----------------------------------------------------------------

dialect_query("F1_substring", "F1: all forms of SUBSTRING", "SELECT c_custkey, SUBSTRING(c_name FROM 1 FOR 4) AS a, SUBSTR(c_name, -3) AS b, SUBSTRING(c_name, 10, 2) AS c, SUBSTRING(c_name, 0, 3) AS d, SUBSTRING(c_name FROM 12) AS e FROM customer", ["customer"],
    "SELECT c_custkey, substring(c_name, 1, 4) AS a, right(c_name, 3) AS b, substring(c_name, 10, 2) AS c, '' AS d, substring(c_name, 12) AS e FROM customer")
dialect_query("F2_concat", "F2: CONCAT turns numbers to text; a null makes null", "SELECT n_nationkey, CONCAT(n_name, '-', n_regionkey) AS a, CONCAT('x', NULL, n_name) AS b FROM nation", ["nation"], "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, CAST(NULL AS VARCHAR) AS b FROM nation")
dialect_query("F3_abs", "F3: ABS of decimals and integers", "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(10 - c_nationkey) AS b FROM customer", ["customer"], "SELECT c_custkey, abs(c_acctbal) AS a, abs(10 - c_nationkey) AS b FROM customer")
dialect_query("F4_truncate", "F4: TRUNCATE toward zero, negative digits too", "SELECT c_custkey, CAST(TRUNCATE(c_acctbal, 1) AS DECIMAL(12, 1)) AS a, CAST(TRUNCATE(c_acctbal, -2) AS DECIMAL(12, 0)) AS b FROM customer", ["customer"],
    "SELECT c_custkey, CAST(CAST(trunc(c_acctbal * 10) AS BIGINT) * CAST(0.1 AS DECIMAL(2, 1)) AS DECIMAL(12, 1)) AS a, CAST(CAST(trunc(c_acctbal / 100) AS BIGINT) * 100 AS DECIMAL(12, 0)) AS b FROM customer")
dialect_query("F5_mod", "F5: MOD and %; null for a zero divisor", "SELECT o_orderkey, MOD(o_orderkey, 7) AS a, MOD(-o_orderkey, 7) AS b, MOD(o_orderkey, 0) AS c FROM orders", ["orders"], "SELECT o_orderkey, o_orderkey % 7 AS a, -o_orderkey % 7 AS b, CAST(NULL AS BIGINT) AS c FROM orders")
dialect_query("F6_cast", "F6: lenient casts of text, and CONVERT", "SELECT CAST('12abc' AS SIGNED) AS a, CAST('a111' AS SIGNED) AS b, CAST(' -7 ' AS BIGINT) AS c, CONVERT('2020-02-29', DATE) AS d, CAST('1.256' AS DECIMAL(5, 2)) AS e, CAST(CAST(12.7 AS DECIMAL(4, 1)) AS DECIMAL) AS f", [],
    "SELECT CAST(12 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(-7 AS BIGINT) AS c, DATE '2020-02-29' AS d, CAST(1.26 AS DECIMAL(5, 2)) AS e, CAST(13 AS DECIMAL(10, 0)) AS f")
dialect_query("F7_date", "F7: DATE of a time stamp", "SELECT event_id, DATE(ts) AS d FROM events", ["events"], "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
dialect_query("F8_date_add", "F8: DATE_ADD, ADDDATE, DATE_SUB; a bare number means days", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS a, ADDDATE(o_orderdate, 10) AS b, DATE_SUB(o_orderdate, INTERVAL 2 QUARTER) AS c, CAST(DATE_ADD(o_orderdate, INTERVAL 90 MINUTE) AS STRING) AS d FROM orders", ["orders"],
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, o_orderdate + 10 AS b, CAST(o_orderdate - INTERVAL 6 MONTH AS DATE) AS c, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d FROM orders")
dialect_query("F10_datediff", "F10: DATEDIFF", "SELECT l_orderkey, l_linenumber, l_partkey, DATEDIFF(l_shipdate, o_orderdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ["lineitem", "orders"], "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate - o_orderdate AS INT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
dialect_query("F11_timediff", "F11: TIMEDIFF, hours beyond 24 and negative", "SELECT event_id, TIMEDIFF(date_trunc('SECOND', ts), TIMESTAMP '2024-01-02 12:00:00') AS d FROM events", ["events"],
    "SELECT event_id, (CASE WHEN s < 0 THEN '-' ELSE '' END) || lpad(CAST(abs(s) // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(abs(s) // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(abs(s) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(s) % 60 AS VARCHAR), 2, '0') AS d FROM (SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 - epoch_us(TIMESTAMP '2024-01-02 12:00:00') // 1000000 AS s FROM events) t")
dialect_query("F12_extract", "F12: EXTRACT of simple and compound units; weeks begin on Sunday", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(HOUR FROM ts) AS h, EXTRACT('YEAR_MONTH', ts) AS ym, EXTRACT('DAY_MINUTE', ts) AS dm, EXTRACT(WEEK FROM ts) AS w, EXTRACT(MICROSECOND FROM ts) AS us FROM events", ["events"],
    "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(quarter(ts) AS INT) AS q, CAST(hour(ts) AS INT) AS h, CAST(year(ts) * 100 + month(ts) AS INT) AS ym, CAST(day(ts) * 10000 + hour(ts) * 100 + minute(ts) AS INT) AS dm, CAST(strftime(ts, '%U') AS INT) AS w, CAST(epoch_us(ts) % 1000000 AS BIGINT) AS us FROM events")
dialect_query("F13_month", "F13: MONTH", "SELECT o_orderkey, MONTH(o_orderdate) AS m FROM orders", ["orders"], "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS m FROM orders")
dialect_query("F14_now", "F14: NOW is one value in a statement", "SELECT count(DISTINCT NOW()) AS n, min(NOW() >= o_orderdate) AS later FROM orders", ["orders"], "SELECT CAST(1 AS BIGINT) AS n, TRUE AS later")
dialect_query("F15_unix_timestamp", "F15: UNIX_TIMESTAMP at the fixed offset of eight hours", "SELECT o_orderkey, UNIX_TIMESTAMP(o_orderdate) AS s FROM orders", ["orders"], "SELECT o_orderkey, CAST(epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 - 28800 AS DECIMAL(20, 0)) AS s FROM orders")
dialect_query("F16_date_format", "F16: DATE_FORMAT", "SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d %H:%i:%s') AS a, DATE_FORMAT(ts, '%W %M %e, day %j of %y') AS b, DATE_FORMAT(ts, '%h %p|%w|%U|%V|%%') AS c FROM events", ["events"],
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%A %B %-d, day %j of %y') AS b, strftime(ts, '%I %p|%w|%U|') || CASE WHEN strftime(ts, '%U') = '00' THEN strftime(make_date(year(ts) - 1, 12, 31), '%U') ELSE strftime(ts, '%U') END || '|%' AS c FROM events")
dialect_query("F17_conditionals", "F17: ISNULL, COALESCE, IF with merged types", "SELECT c_custkey, ISNULL(o_orderkey) AS a, COALESCE(o_totalprice, c_acctbal, 0) AS b, IF(o_orderkey IS NULL, 0, o_totalprice) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000", ["customer", "orders"],
    "SELECT c_custkey, o_orderkey IS NULL AS a, COALESCE(o_totalprice, c_acctbal, 0) AS b, CASE WHEN o_orderkey IS NULL THEN 0 ELSE o_totalprice END AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000")
dialect_query("F20_session", "F20: DATABASE() and a bound marker", "SELECT length(DATABASE()) > 0 AS named", [], "SELECT TRUE AS named")
dialect_query("O3_limit_comma", "O3: LIMIT offset, count", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", ["orders"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")


def _over(n: str, sn: int, d: str, sd: int) -> str:
    """The other engine's exact quotient with four more digits, in integers."""
    n, d, out = f"CAST(({n}) * {10**sn} AS HUGEINT)", f"CAST(({d}) * {10**sd} AS HUGEINT)", sn + 4
    return f"CASE WHEN {d} <> 0 THEN CAST(CAST(sign({n}) * sign({d}) * ((2 * abs({n}) * {10 ** (4 + sd)} + abs({d})) // (2 * abs({d}))) AS DECIMAL(25, 0)) * CAST('{10**-out:.{out}f}' AS DECIMAL({out + 1}, {out})) AS DECIMAL(38, {out})) END"


_LINE = "l_orderkey, l_linenumber, l_partkey"
dialect_query("P22_sql_division", "P22, F5: / and DIV by the types of their operands, in one rounding; a zero divisor gives null", f"""SELECT {_LINE}, CAST(l_extendedprice / 113 AS DECIMAL(38, 6)) AS a, CAST(l_quantity DIV 139 AS DECIMAL(38, 6)) AS b, CAST((0.05 - l_discount) / 177 AS DECIMAL(38, 6)) AS c,
  CAST(l_extendedprice / l_quantity AS DECIMAL(38, 6)) AS d, CAST(l_linenumber / 177 AS DECIMAL(38, 4)) AS e, CAST(-l_partkey DIV (l_linenumber - 1) AS DECIMAL(38, 4)) AS f, CAST(l_linenumber / 7 / 3 AS DECIMAL(38, 8)) AS g FROM lineitem""", ["lineitem"],
    f"""SELECT {_LINE}, {_over('l_extendedprice', 2, '113', 0)} AS a, {_over('l_quantity', 2, '139', 0)} AS b, {_over('0.05 - l_discount', 2, '177', 0)} AS c, {_over('l_extendedprice', 2, 'l_quantity', 2)} AS d,
  {_over('l_linenumber', 0, '177', 0)} AS e, {_over('-l_partkey', 0, 'l_linenumber - 1', 0)} AS f, {_over('e7', 4, '3', 0)} AS g FROM (SELECT *, {_over('l_linenumber', 0, '7', 0)} AS e7 FROM lineitem) t""")  # fmt: skip
dialect_query("P22_sql_remainder", "P22, F5: %, infix MOD and MOD() of integers and decimals", "SELECT o_orderkey, o_orderkey % 7 AS a, -o_orderkey MOD 13 AS b, o_orderkey % 0 AS c, CAST(o_totalprice % 0.7 AS DECIMAL(12, 2)) AS d, MOD(o_orderkey, o_orderkey % 3) AS e FROM orders", ["orders"],
    "SELECT o_orderkey, o_orderkey % 7 AS a, -o_orderkey % 13 AS b, CAST(NULL AS BIGINT) AS c, CAST((CAST(o_totalprice * 100 AS BIGINT) % 70) * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(12, 2)) AS d, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % (o_orderkey % 3) END AS e FROM orders")
dialect_query("P22_sql_ratio_of_sums", "P22, A11: quotients of aggregates, in HAVING too", "SELECT l_suppkey, CAST(SUM(l_extendedprice * (1 - l_discount)) / SUM(l_quantity) AS DECIMAL(38, 8)) AS a, CAST(SUM(l_linenumber) / COUNT(*) AS DECIMAL(38, 4)) AS b FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) / COUNT(*) > 25", ["lineitem"],
    f"SELECT l_suppkey, {_over('sum(l_extendedprice * (1 - l_discount))', 4, 'sum(l_quantity)', 2)} AS a, {_over('sum(l_linenumber)', 0, 'count(*)', 0)} AS b FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 25 * count(*)")
dialect_query("A5_sql_avg", "A5: AVG of integers and decimals keeps four more digits", "SELECT p_brand, CAST(AVG(p_size) AS DECIMAL(38, 4)) AS a, CAST(AVG(DISTINCT p_size) AS DECIMAL(38, 4)) AS b, CAST(AVG(p_retailprice) AS DECIMAL(38, 6)) AS c, CAST(AVG(p_size) / 3 AS DECIMAL(38, 8)) AS d FROM part GROUP BY p_brand ORDER BY SUM(p_retailprice) / COUNT(*)", ["part"],
    f"SELECT p_brand, a, b, c, {_over('a', 4, '3', 0)} AS d FROM (SELECT p_brand, {_over('sum(p_size)', 0, 'count(p_size)', 0)} AS a, {_over('sum(DISTINCT p_size)', 0, 'count(DISTINCT p_size)', 0)} AS b, {_over('sum(p_retailprice)', 2, 'count(p_retailprice)', 0)} AS c FROM part GROUP BY p_brand) t")
dialect_query("P7_sql_text_and_numbers", "P7: a number compared with text reads the text's leading number", "SELECT o_orderkey, o_custkey > '70x' AS a, o_totalprice <= '150000.5 or so' AS b, 'none' < o_custkey AS c, o_orderstatus = 'F' AS d FROM orders", ["orders"], "SELECT o_orderkey, o_custkey > 70 AS a, o_totalprice <= 150000.5 AS b, 0 < o_custkey AS c, o_orderstatus = 'F' AS d FROM orders")
dialect_query("F6_sql_casts", "F6: casts of bad text", "SELECT CAST('abc' AS DECIMAL(5, 2)) AS a, CAST('1.256x' AS DECIMAL(5, 2)) AS b, CAST('no date' AS DATE) AS c, CAST(concat(p_size, ' mm') AS SIGNED) AS d, CAST(concat(p_retailprice, 'e') AS DECIMAL(12, 2)) AS e, p_partkey FROM part", ["part"],
    "SELECT CAST(0 AS DECIMAL(5, 2)) AS a, CAST(1.26 AS DECIMAL(5, 2)) AS b, CAST(NULL AS DATE) AS c, CAST(p_size AS BIGINT) AS d, p_retailprice AS e, p_partkey FROM part")
dialect_query("F11_sql_timediff_number", "F11: TIMEDIFF compared with a number is the number HHMMSS", "SELECT event_id, TIMEDIFF(date_trunc('SECOND', ts), TIMESTAMP '2024-01-02 12:00:00') < 480000 AS soon, -13000 <= TIMEDIFF(date_trunc('SECOND', ts), TIMESTAMP '2024-01-02 12:00:00') AS not_long_ago FROM events", ["events"],
    "SELECT event_id, v < 480000 AS soon, -13000 <= v AS not_long_ago FROM (SELECT event_id, sign(s) * (abs(s) // 3600 * 10000 + abs(s) // 60 % 60 * 100 + abs(s) % 60) AS v FROM (SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 - epoch_us(TIMESTAMP '2024-01-02 12:00:00') // 1000000 AS s FROM events) t) u")
dialect_query("F16_sql_specifiers", "F16: the other specifiers of DATE_FORMAT", "SELECT event_id, DATE_FORMAT(ts, '%a %b %c %D %I %k %l') AS a, DATE_FORMAT(ts, '%r|%S|%T|%f') AS b, DATE_FORMAT(ts, '%u|%v|%x|%X') AS c FROM events", ["events"],
    "SELECT event_id, strftime(ts, '%a %b %-m ') || day(ts) || CASE WHEN day(ts) IN (11, 12, 13) THEN 'th' ELSE CASE day(ts) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END || strftime(ts, ' %I %-H %-I') AS a, strftime(ts, '%I:%M:%S %p|%S|%H:%M:%S|') || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS b, "
    "CASE WHEN isoyear(ts) < year(ts) THEN '00' WHEN isoyear(ts) > year(ts) THEN '53' ELSE strftime(ts, '%V') END || strftime(ts, '|%V|%G|') || CASE WHEN strftime(ts, '%U') = '00' THEN year(ts) - 1 ELSE year(ts) END AS c FROM events")  # fmt: skip


@query("""SELECT o_orderkey, CAST(CAST((2 * CAST(o_orderkey AS HUGEINT) * 10000 + 7) // 14 AS DECIMAL(20, 0)) * CAST(0.0001 AS DECIMAL(5, 4)) AS DECIMAL(24, 4)) AS over_seven,
  CAST(NULL AS DECIMAL(24, 4)) AS over_zero, CASE WHEN o_custkey % 5 <> 0 THEN CAST(CAST((2 * CAST(o_totalprice * 100 AS HUGEINT) * 10000 + (o_custkey % 5)) // (2 * (o_custkey % 5)) AS DECIMAL(25, 0)) * CAST(0.000001 AS DECIMAL(7, 6)) AS DECIMAL(38, 6)) END AS price
  FROM orders""")
def P22_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int / int has four digits, decimal / int four more than the dividend; a zero divisor gives null."""
    df = load(spark, sf_dir, "orders").withColumn("r", F.expr("o_custkey % 5"))
    return df.select("o_orderkey", scalar.column(scalar.int_divide, "o_orderkey", "7").alias("over_seven"), scalar.column(scalar.int_divide, "o_orderkey", "0").alias("over_zero"), narrow.quotient(df, "o_totalprice", "r").alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS a, l_extendedprice - l_discount AS b, CAST(l_extendedprice * l_tax AS DECIMAL(24, 4)) AS c, -l_quantity AS d FROM lineitem")
def P22_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+ - * and sign on decimals; a product has the sum of the digits."""
    df = load(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + F.col("l_tax")).alias("a"), (F.col("l_extendedprice") - F.col("l_discount")).alias("b"), (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(24,4)").alias("c"), (-F.col("l_quantity")).alias("d"))


# --- operators ----------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def J7_not_in_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null-aware anti join as an operator."""
    listed = load(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey")
    return joins.in_subquery(load(spark, sf_dir, "supplier"), "s_nationkey", listed, negate=True).select("s_suppkey")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem x WHERE EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_suppkey <> x.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_suppkey <> x.l_suppkey AND y.l_returnflag = 'R') GROUP BY l_orderkey""")
def J10_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS and NOT EXISTS of a table with itself in one grouped pass."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    marked = joins.others_in_group(rows, "l_orderkey", "l_suppkey", F.col("l_returnflag") == "R")
    return marked.where("others AND NOT others_late").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def J4_left_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join operator with keys and a residual."""
    customers, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return joins.join(customers, orders, [("c_custkey", "o_custkey")], "left", orders["o_totalprice"] > 300000).select("c_custkey", "o_orderkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def J8_theta_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any condition between two small tables."""
    a, b = load(spark, sf_dir, "nation").alias("a"), load(spark, sf_dir, "nation").alias("b")
    return joins.theta_join(a, b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_custkey, c_name, c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_nationkey")
def A15_group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the unique key is grouped, what it determines rides along."""
    joined = joins.join(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")])
    return aggregates.group_by_key(joined, ["c_custkey", "c_name", "c_nationkey"], "c_custkey", [F.count(F.lit(1)).alias("n")])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def A13_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold all rows; values are made distinct over all tasks before they are counted."""
    distinct = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.lit(1).alias("one"))
    return distinct.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier")
def U2_union_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides must agree in number and types of columns."""
    return sets.union(load(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def O4_top_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k with an offset."""
    return aggregates.top(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 5)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-06-01' AND o_orderdate < DATE '1997-03-01'")
def S1_range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGE partitions on a date; only the folders of the ranges asked for are read."""
    from datetime import date

    bounds, path = [date(y, 1, 1) for y in range(1996, 2002)], scratch(spark)
    partitions.write_ranges(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", bounds)
    return partitions.read_ranges(spark, path, "o_orderdate", bounds, date(1996, 6, 1), date(1997, 3, 1))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM part WHERE p_brand IS NOT NULL")
def F18_dict_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a dictionary column, in the order of its values."""
    return partitions.dict_index(load(spark, sf_dir, "part"), "p_brand", "code").select("p_partkey", "code")


# --- sources, sinks, statements that change tables ----------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def S4_load_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a delimited file and loaded with a declared schema in strict mode."""
    rows, path = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), scratch(spark)
    delimited.write_delimited(rows, path)
    return delimited.load_delimited(spark, path, rows.schema, fields="|")


@query("SELECT (n_nationkey + 0) AS k, CASE WHEN n_nationkey = 3 THEN 'third' WHEN n_regionkey = 1 THEN concat(n_name, '!') ELSE n_name END AS name FROM nation WHERE n_regionkey <> 4 OR n_nationkey = 3 UNION ALL SELECT 100, 'added'")
def S9_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, INSERT ... ON DUPLICATE KEY UPDATE, UPDATE and DELETE on a versioned table."""
    nation = load(spark, sf_dir, "nation")
    schema = T.StructType([T.StructField("k", nation.schema["n_nationkey"].dataType, False), T.StructField("name", T.StringType()), T.StructField("region", nation.schema["n_regionkey"].dataType)])
    table = SnapshotTable.create(spark, scratch(spark), schema, key=["k"], defaults={"name": "added"})
    table.insert(nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    table.update({"name": F.concat("name", F.lit("!"))}, F.col("region") == 1)
    table.insert([{"k": 3, "name": "third"}, {"k": 100, "region": 0}], on_duplicate={"name": F.col("new.name"), "region": F.lit(0)})
    table.delete(F.col("region") == 4)
    return table.read().select("k", "name")


@query("SELECT (n_nationkey + 0) AS k, CASE WHEN n_nationkey = 3 THEN 'third' WHEN n_regionkey = 1 THEN concat(n_name, '!') ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN CAST(0.6667 AS DECIMAL(12, 4)) END AS share FROM nation WHERE n_regionkey <> 4 OR n_nationkey = 3 UNION ALL SELECT 100, 'added', NULL")
def S9_sql_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 S10 S11, DDL: the same changes as statements."""
    register(spark, sf_dir, "nation")
    name = f"nation_{uuid.uuid4().hex}"
    for text in (
        f"CREATE TABLE {name} (k INT NOT NULL, name VARCHAR(40) DEFAULT 'added', region INT, share DECIMAL(12, 4), PRIMARY KEY (k))",
        f"INSERT INTO {name} (k, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation",
        f"UPDATE {name} SET name = CONCAT(name, '!') WHERE region = 1",
        f"INSERT INTO {name} (k, name) VALUES (3, 'third') ON DUPLICATE KEY UPDATE name = VALUES(name), region = 0, share = 2 / k",
        f"INSERT INTO {name} SET k = 100, region = '0x'",
        f"DELETE FROM {name} WHERE region = 4",
    ):
        dialect.sql(spark, text)
    return dialect.sql(spark, f"SELECT k, name, share FROM {name}")


@query("SELECT o_orderstatus, count(*) AS n, count(*) AS ids FROM orders GROUP BY o_orderstatus")
def S12_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-id pseudo column of a versioned table; two readings agree on it."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = SnapshotTable.create(spark, scratch(spark), orders.schema)
    table.insert(orders)
    again = table.read(row_id="row_id").select("row_id", F.col("o_orderkey").alias("same"))
    met = table.read(row_id="row_id").join(again, "row_id").where("o_orderkey = same")
    return met.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def S15_data_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CACHE TABLE keeps a table's columns on the executors, in memory first, then on disk."""
    load(spark, sf_dir, "orders").select("o_orderstatus").createOrReplaceTempView("kept_orders")
    dialect.sql(spark, "CACHE LAZY TABLE kept_orders OPTIONS ('storageLevel' 'MEMORY_AND_DISK')")
    return dialect.sql(spark, "SELECT o_orderstatus, count(*) AS n FROM kept_orders GROUP BY o_orderstatus")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def S4_sql_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD DATA INFILE as a statement, into a table with a key."""
    path, name = scratch(spark), f"customer_{uuid.uuid4().hex}"
    delimited.write_delimited(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    dialect.sql(spark, f"CREATE TABLE {name} (c_custkey BIGINT NOT NULL PRIMARY KEY, c_name VARCHAR(25) NOT NULL, c_acctbal DECIMAL(12, 2))")
    dialect.sql(spark, f"LOAD DATA INFILE '{path}' INTO TABLE {name} FIELDS TERMINATED BY '|' LINES TERMINATED BY '\\n'")
    return dialect.sql(spark, f"SELECT * FROM {name}")


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def S14_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key values that several rows hold."""
    return delimited.duplicates(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def X_streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 (extension): daily windows over a stream of files; a window is written once the watermark has passed it."""
    path, arrived = scratch(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    arrived.write.parquet(f"{path}/in")
    streaming.follow(spark, f"{path}/in", arrived.schema, f"{path}/sink", f"{path}/state").awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint, total decimal(28,2)").parquet(f"{path}/sink")


# --- decimals beyond 38 digits ------------------------------------------------------------------------------------


def _digits(seed: int, key: str = "o_orderkey") -> tuple[str, str]:
    """Text of an integer of 68 digits made from a key, for both engines."""
    part = f"lpad(CAST(({key} * {7919 + seed} + {seed}) % 99999999999999989 AS STRING), 17, '{seed % 9 + 1}')"
    spark = f"concat({part}, reverse({part}), {part}, reverse({part}))"
    return spark, spark.replace("STRING", "VARCHAR")


def _wide_orders(spark: SparkSession, sf_dir: str, specs: list[Spec]) -> DataFrame:
    """o_orderkey and columns c0, c1, ... of wide decimals with two digits after the point, the last two of the integer text."""
    df = load(spark, sf_dir, "orders").select("o_orderkey")
    for i, s in enumerate(specs):
        text = F.expr(_digits(i)[0])
        text = F.concat(F.expr(f"substring({_digits(i)[0]}, 1, {68 - s.scale})"), F.lit("."), F.expr(f"right({_digits(i)[0]}, {s.scale})")) if s.scale else text
        df = df.withColumn(f"c{i}", wide.from_text(text, s))
    return df


def _point(unscaled: str, scale: int) -> str:
    return f"left({unscaled}, CAST(length({unscaled}) - {scale} AS BIGINT)) || '.' || right({unscaled}, {scale})"


def _big(seed: int) -> str:
    return f"CAST({_digits(seed)[1]} AS BIGNUM)"


W70 = Spec(70, 2)


@query(f"SELECT o_orderkey, {_point('s', 2)} AS total FROM (SELECT o_orderkey, CAST({_big(0)} + {_big(1)} + {_big(2)} AS VARCHAR) AS s FROM orders) t")
def W1_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.4: col1 + col2 + col3 at 70 digits."""
    return _wide_orders(spark, sf_dir, [W70] * 3).select("o_orderkey", wide.compute_text(Col("c0", W70) + Col("c1", W70) + Col("c2", W70)).alias("total"))


@query(f"SELECT o_orderkey, {_point('s', 11)} AS total FROM (SELECT o_orderkey, CAST(CAST({_digits(0)[1]} || '0000000000' AS BIGNUM) + {_big(1)} + CAST({_digits(2)[1]} || '0000000000' AS BIGNUM) AS VARCHAR) AS s FROM orders) t")
def W2_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4: addends of scale 1 and 11; low scales are added first."""
    low, high = Spec(69, 1), Spec(68, 11)
    return _wide_orders(spark, sf_dir, [low, high, low]).select("o_orderkey", wide.compute_text(Col("c0", low) + Col("c1", high) + Col("c2", low)).alias("total"))


@query(f"SELECT o_orderkey, {_point('s', 2)} AS total FROM (SELECT o_orderkey, CAST({_big(0)} + CAST('1100' AS BIGNUM) AS VARCHAR) AS s FROM orders) t")
def W3_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4: 1 + a + 2 + 11 - 3, with the constants folded once."""
    a = Col("c0", W70)
    return _wide_orders(spark, sf_dir, [W70]).select("o_orderkey", wide.compute_text(1 + a + 2 + 11 - 3).alias("total"))


@query(f"SELECT g, {_point('s', 2)} AS total FROM (SELECT o_orderkey % 7 AS g, CAST(sum({_big(0)}) AS VARCHAR) AS s FROM orders GROUP BY 1) t")
def W4_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM of 70 digits by limbs, combined on the map side."""
    return wide.wide_sum(_wide_orders(spark, sf_dir, [W70]).withColumn("g", F.col("o_orderkey") % 7), ["g"], "c0", W70, "total")


@query(f"SELECT g, {_point('lo', 2)} AS low, {_point('hi', 2)} AS high, n FROM (SELECT o_orderkey % 5 AS g, min({_digits(0)[1]}) AS lo, max({_digits(0)[1]}) AS hi, count(DISTINCT {_digits(0)[1]}) AS n FROM orders GROUP BY 1) t")
def W5_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison, MIN, MAX and DISTINCT are the engine's own on the encoding."""
    found = _wide_orders(spark, sf_dir, [W70]).groupBy((F.col("o_orderkey") % 5).alias("g")).agg(F.min("c0").alias("low"), F.max("c0").alias("high"), F.count_distinct("c0").alias("n"))
    return found.select("g", wide.to_text(F.col("low"), 2).alias("low"), wide.to_text(F.col("high"), 2).alias("high"), "n")


def _narrow_as_wide(column: str) -> Column:
    return wide.from_text(F.col(column).cast("string"), Spec(60, 2))


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice * CAST(o_orderkey % 97 - 48 AS DECIMAL(12, 2)) AS DECIMAL(30, 4)) AS VARCHAR) AS product,
  CASE WHEN o_orderkey % 97 <> 48 THEN CAST(CAST(CASE WHEN o_orderkey % 97 > 48 THEN 1 ELSE -1 END * ((2 * CAST(o_totalprice * 100 AS HUGEINT) * 10000 + abs(o_orderkey % 97 - 48)) // (2 * abs(o_orderkey % 97 - 48))) AS DECIMAL(28, 0)) * CAST(0.000001 AS DECIMAL(7, 6)) AS VARCHAR) END AS quotient,
  CASE WHEN o_orderkey % 97 <> 48 THEN CAST(CAST(CAST(o_totalprice * 100 AS HUGEINT) % (abs(o_orderkey % 97 - 48) * 100) AS DECIMAL(28, 0)) * CAST(0.01 AS DECIMAL(3, 2)) AS VARCHAR) END AS remainder
  FROM orders""")
def W6_multiply_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: product, quotient (half away from zero, four more digits) and remainder in the wide encoding; zero divisors give null."""
    s = Spec(60, 2)
    df = load(spark, sf_dir, "orders").withColumn("d", F.expr("CAST(o_orderkey % 97 - 48 AS DECIMAL(12, 2))"))
    df = df.select("o_orderkey", _narrow_as_wide("o_totalprice").alias("a"), _narrow_as_wide("d").alias("b"))
    a, b = Col("a", s), Col("b", s)
    return df.select("o_orderkey", wide.compute_text(a * b).alias("product"), wide.compute_text(a / b).alias("quotient"), wide.compute_text(a % b).alias("remainder"))


@query("SELECT o_orderkey, CAST((c * c % n) * c % n AS VARCHAR) AS cube FROM (SELECT o_orderkey, CAST(o_orderkey * 6700417 + 11 AS HUGEINT) AS c, CAST(67280421310721 AS HUGEINT) AS n FROM orders) t")
def W7_modular_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5: c * c % n * c % n."""
    s = Spec(17, 0)
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(o_orderkey * 6700417 + 11 AS DECIMAL(17, 0))").alias("c"))
    c, n = Col("c", s), 67280421310721
    return df.select("o_orderkey", wide.compute_text(c * c % n * c % n).alias("cube"))


def _sine(x: Col, terms: int):
    total, power, factorial, sign = x, x, 1, 1
    for k in range(3, 2 * terms + 1, 2):
        power, factorial, sign = power * x * x, factorial * (k - 1) * k, -sign
        total = total + power / factorial if sign > 0 else total - power / factorial
    return total


@query("""SELECT o_orderkey, CAST(CAST(x * CAST(1000000000000 AS HUGEINT) - (2 * x * x * x * 10000 + 6) // 12 * 10000 + (2 * x * x * x * x * x * 10000 + 120) // 240 AS DECIMAL(24, 0)) * CAST('0.00000000000001' AS DECIMAL(15, 14)) AS VARCHAR) AS sine
  FROM (SELECT o_orderkey, CAST(o_orderkey % 157 AS HUGEINT) AS x FROM orders) t""")
def W10_sine_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5: three terms of the sine series at 2 digits."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST((o_orderkey % 157) / 100.0 AS DECIMAL(3, 2))").alias("x"))
    return df.select("o_orderkey", wide.compute_text(_sine(Col("x", Spec(3, 2)), 3)).alias("sine"))


@query()
def W8_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5: six terms of the sine series at 8 digits, 95 digits wide; tests hold it against integers."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST((o_orderkey % 157) / 100.0 AS DECIMAL(9, 8))").alias("x"))
    return df.select("o_orderkey", wide.compute_text(_sine(Col("x", Spec(9, 8)), 6)).alias("sine"))


@query("""SELECT l_returnflag, l_linestatus, CAST(CAST(sum(l_quantity) AS DECIMAL(38, 2)) AS VARCHAR) AS sum_qty, CAST(CAST(sum(l_extendedprice) AS DECIMAL(38, 2)) AS VARCHAR) AS sum_base_price,
  CAST(CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(38, 4)) AS VARCHAR) AS sum_disc_price, CAST(CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DECIMAL(38, 6)) AS VARCHAR) AS sum_charge, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def W9_wide_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5: the pricing summary with quantities and prices of 68 and 64 digits."""
    quantity, price, rate = Spec(68, 2), Spec(64, 2), Spec(3, 2)
    df = load(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    df = df.select("l_returnflag", "l_linestatus", wide.from_native(F.col("l_quantity"), 2, quantity).alias("qty"), wide.from_native(F.col("l_extendedprice"), 2, price).alias("price"), F.col("l_discount").cast("decimal(3,2)").alias("disc"), F.col("l_tax").cast("decimal(3,2)").alias("tax"))
    p, d, t = Col("price", price), Col("disc", rate), Col("tax", rate)
    parts = {"sum_qty": Col("qty", quantity), "sum_base_price": p, "sum_disc_price": p * (1 - d), "sum_charge": p * (1 - d) * (1 + t)}
    return wide.wide_sums(df, ["l_returnflag", "l_linestatus"], parts, F.count(F.lit(1)).alias("count_order"))
