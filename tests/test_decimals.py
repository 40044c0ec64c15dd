"""Types, values and rewriting of decimals against integers."""

from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaline.functions import narrow, wide
from tessaline.functions.narrow import Spec
from tessaline.functions.wide import Col, Const

UNSCALED = st.integers(-(10**60) + 1, 10**60 - 1)


def rounded(x: Fraction, scale: int) -> int:
    """Half away from zero."""
    y = abs(x) * 10**scale
    n = y.numerator // y.denominator
    n += 2 * (y - n) >= 1
    return -n if x < 0 else n


@given(st.lists(UNSCALED, min_size=2, max_size=20))
@settings(max_examples=200)
def test_bytes_sort_as_numbers(values):
    size = wide.width(60)
    coded = [wide.encode(v, size) for v in values]
    assert [wide.decode(c) for c in coded] == values
    assert [wide.decode(c) for c in sorted(coded)] == sorted(values)


@given(UNSCALED, st.integers(0, 40))
def test_text_round_trip(value, scale):
    assert wide.parse(wide.render(value, scale), scale) == value


def test_text_rounds_half_away():
    assert [wide.parse(t, 2) for t in ("1.005", "-1.005", "1.0049", ".5", "-0.005", "7")] == [101, -101, 100, 50, -1, 700]


def test_declared_digits():
    a, b = Spec(12, 2), Spec(10, 4)
    assert narrow.add(a, b) == Spec(15, 4) and narrow.multiply(a, b) == Spec(22, 6)
    assert narrow.divide(a, b) == Spec(11, 6) and narrow.average(a) == Spec(16, 6) and narrow.merge(a, b) == Spec(14, 4)
    with pytest.raises(ValueError):
        Spec(0, 0)


TREES = st.recursive(
    st.one_of(st.sampled_from([Col("a", Spec(20, 2)), Col("b", Spec(30, 9)), Col("c", Spec(18, 0))]), st.builds(Const, st.integers(-50, 50), st.integers(0, 3))),
    lambda t: st.one_of(st.builds(lambda x, y: x + y, t, t), st.builds(lambda x, y: x - y, t, t), st.builds(lambda x, y: x * y, t, t), st.builds(lambda x: -x, t)),
    max_leaves=7,
)


def value(e, row):
    """(exact value, scale) by the tree as written."""
    match e:
        case Col():
            return Fraction(row[e.name], 10**e.spec.scale)
        case Const():
            return Fraction(e.value, 10**e.scale)
        case wide.Negate():
            return -value(e.arg, row)
        case wide.Nary():
            parts = [value(x, row) for x in e.args]
            out = parts[0]
            for p in parts[1:]:
                out = out + p if e.op == "+" else out * p
            return out


@given(TREES, st.integers(-(10**19), 10**19), st.integers(-(10**29), 10**29), st.integers(-(10**17), 10**17))
@settings(max_examples=300, deadline=None)
def test_rewriting_keeps_values(tree, a, b, c):
    row = {"a": a, "b": b, "c": c}
    for e in (tree, wide.simplify(tree)):
        f, scale = wide.evaluator(e)
        assert Fraction(f(row), 10**scale) == value(tree, row)


def test_rewriting():
    a, b = Col("a", Spec(20, 2)), Col("b", Spec(30, 9))
    assert wide.simplify(1 + a + 2 + 11 - 3) == wide.Nary("+", (Const(11, 0), a))
    assert wide.simplify(wide.lift("0.25") * (a + b) * 4) == wide.Nary("+", (a, b))
    assert wide.simplify(b + a + b).args == (a, b, b)
    assert wide.simplify(a + 0) == a and wide.simplify(a * 0) == Const(0, 0) and wide.simplify(a - 0 + b - b * 0) == wide.Nary("+", (a, b))
    assert isinstance(wide.simplify((a + 1) / 2 + 1).args[-1], (Const, wide.Binary))  # nothing crosses a division


def test_division_rounds_half_away(spark):
    s = Spec(60, 2)
    rows = [(i, n, d) for i, (n, d) in enumerate([("1.00", "3.00"), ("-1.00", "3.00"), ("0.05", "8.00"), ("1.00", "0.00"), (None, "1.00"), ("-7.55", "-0.01"), ("9" * 57 + ".99", "0.01"), ("2.00", "64.00")])]
    df = spark.createDataFrame(rows, "i int, n string, d string").select("i", "n", "d", wide.from_text(F.col("n"), s).alias("a"), wide.from_text(F.col("d"), s).alias("b"))
    a, b = Col("a", s), Col("b", s)
    for r in df.select("n", "d", wide.compute_text(a / b).alias("q"), wide.compute_text(a % b).alias("m")).collect():
        if r["n"] is None or r["d"] == "0.00":
            assert r["q"] is None and r["m"] is None
            continue
        n, d = Fraction(r["n"]), Fraction(r["d"])
        assert wide.parse(r["q"], 6) == rounded(n / d, 6)
        assert Fraction(r["m"]) == (abs(n) % abs(d)) * (-1 if n < 0 else 1)


def test_sums_of_288_digits(spark):
    s = Spec(288, 10)
    texts = ["9" * 270 + "." + "9" * 10, "-" + "9" * 270 + "." + "9" * 10, None, "1.5", "-0.0000000001"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts * 3)] + [(5, None)], "g int, t string").withColumn("v", wide.from_text(F.col("t"), s))
    got = {r["g"]: r["total"] for r in wide.wide_sum(df, ["g"], "v", s, "total").collect()}
    want = {g: sum(wide.parse(t, 10) for i, t in enumerate(texts * 3) if t and i % 2 == g) for g in (0, 1)}
    assert got == {g: wide.render(v, 10) for g, v in want.items()} | {5: None}


def test_native_where_38_digits_suffice(spark):
    a, b = Col("a", Spec(12, 2)), Col("b", Spec(12, 2))
    df = spark.sql("SELECT CAST(1.25 AS DECIMAL(12, 2)) AS a, CAST(-3.10 AS DECIMAL(12, 2)) AS b")
    out = df.select(wide.compute_text(a * b + 1).alias("x"))
    assert out.first()["x"] == "-2.8750" and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert not wide.fits(Col("a", Spec(38, 2)) + 1) and not wide.fits(a / b)


def test_overflow_is_an_error(spark):
    s = Spec(200, 0)
    df = spark.createDataFrame([("9" * 200,)], "t string").select(wide.from_text(F.col("t"), s).alias("a"))
    with pytest.raises(Exception, match="288 digits"):
        df.select(wide.compute_text(Col("a", s) * Col("a", s))).collect()
    with pytest.raises(Exception, match="more than 5 digits"):
        spark.createDataFrame([("123456",)], "t string").select(wide.from_text(F.col("t"), Spec(5, 0))).collect()


def test_sine_against_integers(spark, sf_dir):
    from tessaline.plans.built import W8_sine

    for key, text in [tuple(r) for r in W8_sine(spark, sf_dir).limit(200).collect()]:
        x = Fraction(key % 157, 100)
        power, factorial, total = Fraction(x), 1, Fraction(x)
        for n, k in enumerate(range(3, 13, 2)):
            power, factorial = power * x * x, factorial * (k - 1) * k
            term = Fraction(rounded(power / factorial, 8 * k + 4), 10 ** (8 * k + 4))
            total += -term if n % 2 == 0 else term
        assert Fraction(text) == total


def test_native_storage_and_sums_of_products(spark):
    """Built-in encoding equals the parsed one, and sums of wide times narrow equal integers, nulls and signs included."""
    values = [Decimal(x).scaleb(-2) for x in (0, 1, -1, 10**11, -(10**11), 999_999_999_999, -999_999_999_999)]
    rows = [(i % 2, v, Decimal(i - 3).scaleb(-2)) for i, v in enumerate(values)] + [(0, None, Decimal(1)), (3, None, Decimal(2))]
    s = Spec(64, 4)
    df = spark.createDataFrame(rows, "g int, v decimal(12,2), f decimal(3,2)").withColumn("w", wide.from_native(F.col("v"), 2, s))
    assert df.where(~F.col("w").eqNullSafe(wide.from_text(F.col("v").cast("string"), s))).count() == 0
    got = {r["g"]: r["total"] for r in wide.wide_sums(df, ["g"], {"total": Col("w", s) * (1 - Col("f", Spec(3, 2)))}).collect()}
    want = {g: sum((v * (1 - f) for h, v, f in rows if h == g and v is not None), Decimal(0)) for g in (0, 1)}
    assert {g: None if t is None else Decimal(t) for g, t in got.items()} == {**want, 3: None}
