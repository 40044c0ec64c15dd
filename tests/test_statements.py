"""The SQL entry point, delimited files, tables that change, streams."""

import random
import uuid
from datetime import datetime
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline import sql, translate
from tessaline.functions.narrow import mean
from tessaline.operators import sets
from tessaline.sources import delimited
from tessaline.sources.snapshot import ConcurrentChange, DuplicateKey, SnapshotTable
from tessaline.streaming.events import windowed


def one(spark, text, args=None):
    return tuple(sql(spark, text, args).first())


def test_dialect(spark):
    assert one(spark, "SELECT 7 DIV 2, 'a DIV b LIMIT 1, 2', SUBSTR('héllo' FROM -3), SUBSTRING('abc', 0), SUBSTRING('abcdef' FROM 2 FOR 3)") == (3.5, "a DIV b LIMIT 1, 2", "llo", "", "bcd")
    assert one(spark, "SELECT DATE_FORMAT('2024-03-03 04:05:06', '%D|%a|%b|%c|%k|%l|%r|%T|%f|%X|%x|%v|%u|%q')") == ("3rd|Sun|Mar|3|4|4|04:05:06 AM|04:05:06|000000|2024|2024|09|09|q",)
    assert one(spark, "SELECT EXTRACT('DAY_SECOND', '2024-02-29 01:02:03'), EXTRACT(WEEK FROM DATE '2024-01-06'), EXTRACT('SECOND_MICROSECOND', '2024-02-29 01:02:03.5')") == (29010203, 0, 3500000)
    assert str(one(spark, "SELECT DATE_ADD('2024-01-31', INTERVAL 1 MONTH)")[0]).startswith("2024-02-29")
    assert one(spark, "SELECT ? + 1, MOD(5, 0), CAST('x' AS SIGNED), ISNULL(NULL)", [41]) == (42, None, 0, True)
    assert "LIMIT 3 OFFSET 2" in translate("SELECT 1 LIMIT 2, 3") and "JOIN" in translate("SELECT 1 FROM a STRAIGHT_JOIN b") and "STRAIGHT" not in translate("a STRAIGHT_JOIN b")
    with pytest.raises(ValueError):
        translate("SELECT DATE_FORMAT(a, b)")


def test_arithmetic_by_types(spark):
    from decimal import Decimal as D

    assert one(spark, "SELECT 7 DIV 2, 7/2, 1/0, 5 % 0, 10 MOD 3, -7 DIV 3, 0.01/113, 1/3/7, 2*3/4*5, '6'/4, NULL/3, TRUE/2") == (D("3.5000"), D("3.5000"), None, None, 1, D("-2.3333"), D("0.000088"), D("0.04761429"), D("7.5000"), 1.5, None, D("0.5000"))
    rows = "(VALUES (1, 1.5D), (2, 0D), (2, NULL)) AS t(x, y)"
    assert one(spark, f"SELECT AVG(x), AVG(DISTINCT x), SUM(x) / COUNT(*), AVG(y), SUM(CASE WHEN x / y > 0.5 THEN 1 ELSE 0 END) FROM {rows}") == (D("1.6667"), D("1.5000"), D("1.6667"), 0.75, 1)
    assert [tuple(r) for r in sql(spark, f"SELECT x / 7 AS k, COUNT(*) AS n FROM {rows} GROUP BY x / 7 ORDER BY x / 7").collect()] == [(D("0.1429"), 1), (D("0.2857"), 2)]
    assert one(spark, f"SELECT AVG(x) OVER (PARTITION BY 1), x IN (SELECT x % 2 + 1 FROM {rows}), (SELECT MAX(x) / 3 FROM {rows}) FROM {rows}")[2] == D("0.6667")
    assert one(spark, f"SELECT x = '1x', '0.5 or so' < x, x <> 'none' FROM {rows}") == (True, True, True)
    assert one(spark, "SELECT CAST('abc' AS DECIMAL(5, 2)), CAST(' -1.256x' AS DECIMAL(5, 2)), CAST('bad' AS DATE), CAST(12.7 AS SIGNED)") == (D("0.00"), D("-1.26"), None, 12)
    assert one(spark, f"SELECT FIRST(x) / 2, 3 / .5, t.x / 4 AS q, COUNT(*) / 2 FROM {rows} GROUP BY t.x ORDER BY q NULLS FIRST LIMIT 1") == (D("0.5000"), D("6.0000"), D("0.2500"), D("0.5000"))
    assert one(spark, "SELECT TIMEDIFF('2024-03-03', '2024-03-02') < 480000, 240000 = TIMEDIFF('2024-03-03', '2024-03-02')") == (True, True)


@pytest.mark.parametrize(("scales", "digits"), [((2, 2), 12), ((0, 0), 19), ((4, 2), 24), ((6, 6), 31)])
def test_quotients_are_rounded_once(spark, scales, digits):
    """Random quotients, many with further digits just below or at the half, against fractions."""
    getcontext().prec = 80
    rng = random.Random(digits)
    rows = []
    for _ in range(400):
        d = rng.choice([113, 139, 177, 7, 3, rng.randrange(1, 10**4)]) * rng.choice([1, -1])
        n = rng.randrange(-(10 ** (digits - 8)), 10 ** (digits - 8)) if rng.random() < 0.5 else rng.randrange(-(10**4), 10**4)
        rows.append((Decimal(n).scaleb(-scales[0]), Decimal(d).scaleb(-scales[1])))
    df = spark.createDataFrame(rows, f"n decimal({digits},{scales[0]}), d decimal({digits},{scales[1]})")
    df.createOrReplaceTempView("quotients")
    for n, d, q, m in sql(spark, "SELECT n, d, n / d, MOD(n, d) FROM quotients").collect():
        exact = Fraction(n) / Fraction(d) * 10 ** (scales[0] + 4)
        want = int(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)
        assert q == Decimal(want).scaleb(-scales[0] - 4), (n, d)
        assert m == n - d * int(Fraction(n) / Fraction(d))


def test_statements_change_tables(spark):
    name = f"accounts_{uuid.uuid4().hex}"
    rows = lambda columns="id, name, bal": [tuple(r) for r in sql(spark, f"SELECT {columns} FROM {name} ORDER BY id").collect()]
    sql(spark, f"CREATE TABLE {name} (id INT NOT NULL, name VARCHAR(20) DEFAULT 'none', bal DECIMAL(12, 2), PRIMARY KEY (id)) COMMENT = 'x'")
    with pytest.raises(ValueError):
        sql(spark, f"CREATE TABLE {name} (id INT)")
    sql(spark, f"CREATE TABLE IF NOT EXISTS {name} (id INT)")
    sql(spark, f"INSERT INTO {name} (id, bal) VALUES (1, 10.5), (2, 7 / 2)")
    sql(spark, f"INSERT INTO {name} SET id = ?, name = ?", [3, "it's"])
    assert rows() == [(1, "none", Decimal("10.50")), (2, "none", Decimal("3.50")), (3, "it's", None)]
    with pytest.raises(DuplicateKey):
        sql(spark, f"INSERT INTO {name} VALUES (1, 'again', 0)")
    sql(spark, f"INSERT INTO {name} VALUES (2, '+', 1), (4, DEFAULT, 2) ON DUPLICATE KEY UPDATE bal = bal / 2 + VALUES(bal), name = CONCAT(name, VALUES(name))")
    sql(spark, f"UPDATE {name} SET bal = bal DIV 3, name = 'low' WHERE bal < '10 and more' AND id <> 4")
    assert rows() == [(1, "none", Decimal("10.50")), (2, "low", Decimal("0.92")), (3, "it's", None), (4, "none", Decimal("2.00"))]
    sql(spark, "START TRANSACTION")
    sql(spark, f"DELETE FROM {name} WHERE bal IS NULL OR id = 1")
    assert [r[0] for r in rows()] == [2, 4]
    sql(spark, "ROLLBACK")
    assert len(rows()) == 4
    sql(spark, f"CREATE OR REPLACE VIEW v_{name} (k, third) AS SELECT id, bal / 3 FROM {name}")
    assert one(spark, f"SELECT third FROM v_{name} WHERE k = 1") == (Decimal("3.500000"),)
    assert name in [r["name"] for r in sql(spark, "SHOW TABLES").collect()]
    sql(spark, f"DELETE FROM {name}")
    assert rows() == []
    sql(spark, f"DROP VIEW v_{name}")
    sql(spark, f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        sql(spark, f"DELETE FROM {name}")


def test_load_statement(spark, tmp_path):
    path, name = tmp_path / "in.csv", f"loaded_{uuid.uuid4().hex}"
    path.write_text("head\n1,'a\nb',2.5\n2,'it''s',\\N\n".replace("''", "\\'"))
    sql(spark, f"CREATE TABLE {name} (k INT PRIMARY KEY, s TEXT, v DECIMAL(6, 2))")
    sql(spark, f"LOAD DATA LOCAL INFILE '{path}' INTO TABLE {name} FIELDS TERMINATED BY ',' OPTIONALLY ENCLOSED BY '\\'' LINES TERMINATED BY '\\n' IGNORE 1 LINES (k, s, v)")
    assert sorted(map(tuple, sql(spark, f"SELECT * FROM {name}").collect())) == [(1, "a\nb", Decimal("2.50")), (2, "it's", None)]


def test_variables(spark):
    sql(spark, "SET @rate = 5, @name = 'x''y'")
    assert one(spark, "SELECT @rate / 2, @name, @none, CONNECTION_ID() >= 0, @@version IS NOT NULL") == (Decimal("2.5000"), "x'y", None, True, True)
    with pytest.raises(ValueError):
        sql(spark, "SELECT @@no_such_thing")


def test_first_writer_wins(spark, tmp_path):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), SCHEMA, key=["a"])
    t.insert([{"a": 1}])
    base = t.version()
    mine = t.read().select("a", F.lit(1).alias("b"), F.lit("mine").alias("c"))
    t.update({"c": F.lit("theirs")}, F.lit(True))
    with pytest.raises(ConcurrentChange):
        t._publish(mine, base)
    assert [r["c"] for r in t.read().collect()] == ["theirs"]


def test_first_lines_of_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"head\nunits\n{i}|1|x\n")
    got = delimited.load_delimited(spark, str(tmp_path), SCHEMA, fields="|", ignore=2).collect()
    assert sorted(r["a"] for r in got) == [0, 1, 2]


def test_timediff_and_times(spark):
    assert one(spark, "SELECT TIMEDIFF('2024-01-03 00:00:01', '2024-01-01 00:00:00'), TIMEDIFF('2024-01-01 00:00:00', '2024-01-01 00:00:01'), UNIX_TIMESTAMP('1970-01-01 08:00:00')")[:2] == ("48:00:01", "-00:00:01")


def test_mean_of_integers(spark):
    assert str(spark.createDataFrame([(1,), (2,), (2,)], "x int").select(mean("x").alias("m")).first()["m"]) == "1.6667"


SCHEMA = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.DecimalType(6, 2)), T.StructField("c", T.StringType())])


def loaded(spark, tmp_path, text, **options):
    path = tmp_path / f"f{abs(hash((text, str(options))))}.txt"
    path.write_text(text, newline="")
    return sorted((tuple(r) for r in delimited.load_delimited(spark, str(path), SCHEMA, **options).collect()), key=str)


def test_load(spark, tmp_path):
    from decimal import Decimal as D

    assert loaded(spark, tmp_path, "1|2.5|x\n2|\\N|\n", fields="|") == [(1, D("2.50"), "x"), (2, None, None)]
    assert loaded(spark, tmp_path, "head\n1,'2.5','x,y'\n", fields=",", enclosed="'", ignore=1) == [(1, D("2.50"), "x,y")]
    assert loaded(spark, tmp_path, "1|2|x|\n", fields="|") == [(1, D("2.00"), "x")]
    assert loaded(spark, tmp_path, ">1|2|x;no;junk>3|4|y", fields="|", lines=";", starting=">") == [(1, D("2.00"), "x"), (3, D("4.00"), "y")]
    assert loaded(spark, tmp_path, "1|99999.99|x\n2\n", fields="|", strict=False) == [(1, None, "x"), (2, None, None)]
    for text in ("x|1|y\n", "1|99999.99|x\n", "\\N|1|x\n", "3000000000|1|x\n"):
        with pytest.raises(Exception, match="bad value|null for"):
            loaded(spark, tmp_path, text, fields="|")


def test_changes(spark, tmp_path):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), SCHEMA, key=["a"], defaults={"c": "none"})
    t.insert([{"a": 1, "b": None, "c": "x"}, {"a": 2}])
    with pytest.raises(DuplicateKey):
        t.insert([{"a": 2}])
    with pytest.raises(DuplicateKey):
        t.insert([{"a": 5}, {"a": 5}])
    with pytest.raises(ValueError):
        t.insert([{"c": "no key"}])
    version = t.version()
    t.insert([{"a": 2, "c": "new"}, {"a": 3}], on_duplicate={"c": F.concat("old.c", F.lit("+"), "new.c")})
    t.update({"b": F.lit(1)}, F.col("a") > 1)
    t.delete(F.col("b") > 5)  # unknown for the null: it stays
    t.delete(F.col("a") == 3)
    rows = lambda v=None: sorted((r["a"], r["b"] and float(r["b"]), r["c"]) for r in t.read(v).collect())
    assert rows() == [(1, None, "x"), (2, 1.0, "none+new")]
    assert rows(version) == [(1, None, "x"), (2, None, "none")]
    assert delimited.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).collect()[0]["n"] == 2


def test_union_types_must_agree(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(TypeError):
        sets.union(a, a.select(F.col("x").cast("long")))
    assert sets.union_all(a, a).count() == 2


def test_windows_in_batch(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5), "a", 1.5), (datetime(2024, 1, 1, 23), "a", 2.0), (datetime(2024, 1, 2), "a", 1.0)], "ts timestamp, event_type string, value double")
    assert sorted((r["n"], float(r["total"])) for r in windowed(df).collect()) == [(1, 1.0), (2, 3.5)]
