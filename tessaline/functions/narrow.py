"""Result types and Column builders for decimals of at most 38 digits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.functions import scalar

MOST = 288
NATIVE = 38
EXTRA = 4  # digits that a quotient or an average gains
INT_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


@dataclass(frozen=True)
class Spec:
    """Digits in all, and after the point."""

    precision: int
    scale: int

    def __post_init__(self) -> None:
        if not (0 <= self.scale <= MOST and 1 <= self.precision):
            raise ValueError(f"no decimal has {self.precision} digits with {self.scale} after the point")

    def capped(self) -> Spec:
        return Spec(min(MOST, self.precision), min(self.scale, MOST))


def add(a: Spec, b: Spec) -> Spec:
    s = max(a.scale, b.scale)
    return Spec(max(a.precision - a.scale, b.precision - b.scale) + 1 + s, s).capped()


def multiply(a: Spec, b: Spec) -> Spec:
    return Spec(a.precision + b.precision, a.scale + b.scale).capped()


def divide(a: Spec, b: Spec) -> Spec:
    return Spec(max(1, a.precision - b.precision + b.scale + EXTRA + 1, a.scale + EXTRA + 1), a.scale + EXTRA).capped()


def roomy(a: Spec, b: Spec) -> Spec:
    """What any quotient fits: `divide` declares fewer digits, which a divisor far below its type's range exceeds."""
    return Spec(a.precision + b.scale + EXTRA, a.scale + EXTRA).capped()


def modulo(a: Spec, b: Spec) -> Spec:
    s = max(a.scale, b.scale)
    return Spec(max(b.precision - b.scale, 1) + s, s).capped()


def average(a: Spec) -> Spec:
    return Spec(a.precision + EXTRA, a.scale + EXTRA).capped()


def merge(a: Spec, b: Spec) -> Spec:
    """Of the branches of CASE, IF and COALESCE."""
    s = max(a.scale, b.scale)
    return Spec(max(a.precision - a.scale, b.precision - b.scale) + s, s).capped()


def spec_of(kind: T.DataType) -> Spec:
    if isinstance(kind, T.DecimalType):
        return Spec(kind.precision, kind.scale)
    if kind.simpleString() in INT_DIGITS:
        return Spec(INT_DIGITS[kind.simpleString()], 0)
    raise TypeError(f"{kind.simpleString()} is not exact")


def quotient(df: DataFrame, a: str, b: str) -> Column:
    """a / b with the scale of a plus four, half away from zero in one rounding, null for a zero divisor."""
    sa, sb = (spec_of(df.select(F.expr(x).alias("x")).schema[0].dataType) for x in (a, b))
    return F.expr(scalar.divide(a, b, sa.precision, sa.scale, sb.precision, sb.scale)).cast(T.DecimalType(NATIVE, sa.scale + EXTRA))


def mean(column: str, scale: int = 0) -> Column:
    """Average of an integer or decimal column with four more digits than `scale`."""
    return F.avg(F.col(column).cast(T.DecimalType(NATIVE - 10, scale))).cast(T.DecimalType(NATIVE, scale + EXTRA))
