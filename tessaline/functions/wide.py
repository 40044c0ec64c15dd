"""Decimals of up to 288 digits.

Storage.  A value is its unscaled integer as big-endian two's complement with
the sign bit flipped, in as many bytes as its precision needs.  Bytes then sort
as numbers do, so comparison, MIN, MAX, ORDER BY, GROUP BY, DISTINCT and equi-
joins are Spark's own on the binary column.

Arithmetic.  An expression tree is typed by the rules of `narrow`, simplified
(`simplify`) and compiled to one Arrow-batched function per output column; a
tree that fits 38 digits at every node becomes native Columns instead.

SUM reads a value's bytes as base-2^32 digits by built-in functions; digits,
each times a narrow factor where the summed expression is a product of a wide
column and narrow ones, are summed by Spark's own partial and final aggregation
and carried once per group.

Null in, null out; a zero divisor gives null; a result beyond 288 digits raises
OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.functions import narrow
from tessaline.functions.narrow import MOST, NATIVE, Spec

# --- values -----------------------------------------------------------------


def width(precision: int) -> int:
    """Bytes of a value's storage."""
    return (10**precision).bit_length() // 8 + 1


def encode(value: int, size: int) -> bytes:
    return (value + (1 << (8 * size - 1))).to_bytes(size, "big")


def decode(raw: bytes) -> int:
    return int.from_bytes(raw, "big") - (1 << (8 * len(raw) - 1))


def parse(text: str, scale: int) -> int:
    """Unscaled integer of decimal text; excess digits round half away from zero."""
    text = text.strip()
    sign = -1 if text.startswith("-") else 1
    whole, _, fraction = text.lstrip("+-").partition(".")
    kept = int((whole or "0") + fraction[:scale].ljust(scale, "0"))
    return sign * (kept + (len(fraction) > scale and fraction[scale] >= "5"))


def render(value: int, scale: int) -> str:
    """Decimal text with exactly `scale` digits after the point."""
    digits = str(abs(value)).rjust(scale + 1, "0")
    return ("-" if value < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def rescale(value: int, old: int, new: int) -> int:
    return value * 10 ** (new - old) if new >= old else half_away(value, 10 ** (old - new))


def half_away(a: int, b: int) -> int:
    q = (2 * abs(a) + abs(b)) // (2 * abs(b))
    return q if (a < 0) == (b < 0) else -q


# --- expressions ------------------------------------------------------------


@dataclass(frozen=True)
class Expr:
    def __add__(self, other: Expr) -> Expr:
        return Nary("+", (self, lift(other)))

    def __sub__(self, other: Expr) -> Expr:
        return Nary("+", (self, Negate(lift(other))))

    def __mul__(self, other: Expr) -> Expr:
        return Nary("*", (self, lift(other)))

    def __truediv__(self, other: Expr) -> Expr:
        return Binary("/", self, lift(other))

    def __mod__(self, other: Expr) -> Expr:
        return Binary("%", self, lift(other))

    def __radd__(self, other) -> Expr:
        return lift(other) + self

    def __rmul__(self, other) -> Expr:
        return lift(other) * self

    def __rsub__(self, other) -> Expr:
        return lift(other) - self

    def __neg__(self) -> Expr:
        return Negate(self)


@dataclass(frozen=True)
class Col(Expr):
    name: str
    spec: Spec


@dataclass(frozen=True)
class Const(Expr):
    value: int
    scale: int


@dataclass(frozen=True)
class Negate(Expr):
    arg: Expr


@dataclass(frozen=True)
class Nary(Expr):
    op: str  # "+" or "*"
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # "/" or "%"
    left: Expr
    right: Expr


def lift(x) -> Expr:
    """A constant from an int or decimal text."""
    if isinstance(x, Expr):
        return x
    text = str(x)
    scale = len(text.partition(".")[2])
    return Const(parse(text, scale), scale)


def spec(e: Expr, quotient: Callable[[Spec, Spec], Spec] = narrow.divide) -> Spec:
    """Declared digits; with `narrow.roomy` for quotients, the digits that a result is stored in."""
    match e:
        case Col():
            return e.spec
        case Const():
            return Spec(max(1, len(str(abs(e.value))), e.scale), e.scale)
        case Negate():
            return spec(e.arg, quotient)
        case Nary():
            return reduce(narrow.add if e.op == "+" else narrow.multiply, [spec(x, quotient) for x in e.args])
        case Binary():
            return (quotient if e.op == "/" else narrow.modulo)(spec(e.left, quotient), spec(e.right, quotient))
    raise TypeError(type(e))


def _flat(op: str, e: Expr) -> list[Expr]:
    if isinstance(e, Nary) and e.op == op:
        return [y for x in e.args for y in _flat(op, x)]
    if op == "+" and isinstance(e, Negate):
        return [_negated(y) for y in _flat("+", e.arg)]
    return [e]


def _negated(e: Expr) -> Expr:
    match e:
        case Negate():
            return e.arg
        case Const():
            return Const(-e.value, e.scale)
    return Negate(e)


def simplify(e: Expr) -> Expr:
    """Chains of + and * flattened, constants folded, zeros and ones dropped, addends ordered by scale.

    Low scales are added first, so that fewer values are brought to a higher scale.  Nothing moves across a
    division or a remainder, whose results depend on their operands' scales.
    """
    match e:
        case Negate():
            return _negated(simplify(e.arg))
        case Binary():
            return Binary(e.op, simplify(e.left), simplify(e.right))
        case Nary():
            args = [y for x in _flat(e.op, e) for y in _flat(e.op, simplify(x))]
            constants, rest = [x for x in args if isinstance(x, Const)], [x for x in args if not isinstance(x, Const)]
            if constants:
                scale = max(c.scale for c in constants) if e.op == "+" else sum(c.scale for c in constants)
                value = sum(rescale(c.value, c.scale, scale) for c in constants) if e.op == "+" else reduce(lambda a, b: a * b, (c.value for c in constants))
                while scale and value % 10 == 0 and (value or e.op == "+"):
                    value, scale = value // 10, scale - 1
                folded = Const(value, scale)
                neutral = value == 0 if e.op == "+" else (value, scale) == (1, 0)
                if e.op == "*" and value == 0:
                    return Const(0, 0)
                rest = rest if neutral and rest else [*rest, folded]
            if e.op == "+":
                rest.sort(key=lambda x: spec(x).scale)
            return rest[0] if len(rest) == 1 else Nary(e.op, tuple(rest))
    return e


def columns(e: Expr) -> list[Col]:
    match e:
        case Col():
            return [e]
        case Negate():
            return columns(e.arg)
        case Nary():
            return list(dict.fromkeys(c for x in e.args for c in columns(x)))
        case Binary():
            return list(dict.fromkeys(columns(e.left) + columns(e.right)))
    return []


def evaluator(e: Expr) -> tuple[Callable[[dict[str, int]], int | None], int]:
    """(function of unscaled column values, scale of its result)."""
    match e:
        case Col():
            return (lambda row, n=e.name: row[n]), e.spec.scale
        case Const():
            return (lambda row, v=e.value: v), e.scale
        case Negate():
            f, s = evaluator(e.arg)
            return (lambda row: None if (v := f(row)) is None else -v), s
        case Nary(op="+"):
            f, s = evaluator(e.args[0])
            for x in e.args[1:]:
                g, t = evaluator(x)
                up = max(s, t)
                f = _plus(f, 10 ** (up - s), g, 10 ** (up - t))
                s = up
            return f, s
        case Nary():
            parts = [evaluator(x) for x in e.args]
            return reduce(_times, (f for f, _ in parts)), sum(s for _, s in parts)
        case Binary():
            (f, s), (g, t) = evaluator(e.left), evaluator(e.right)
            out = spec(e).scale
            return (_over(f, 10 ** max(0, out - s + t), g, 10 ** max(0, s - t - out)) if e.op == "/" else _rest(f, 10 ** (out - s), g, 10 ** (out - t))), out
    raise TypeError(type(e))


def _plus(f, p, g, q):
    return lambda row: None if (a := f(row)) is None or (b := g(row)) is None else a * p + b * q


def _times(f, g):
    return lambda row: None if (a := f(row)) is None or (b := g(row)) is None else a * b


def _over(f, p, g, q):
    return lambda row: None if (a := f(row)) is None or not (b := g(row)) else half_away(a * p, b * q)


def _rest(f, p, g, q):
    def run(row):
        a, b = f(row), g(row)
        if a is None or not b:
            return None
        a, b = a * p, b * q
        return (abs(a) % abs(b)) * (-1 if a < 0 else 1)

    return run


def fits(e: Expr) -> bool:
    """Whether every node has at most 38 digits and only + - * are used, so that native decimals are exact."""
    match e:
        case Binary():
            return False
        case Nary():
            steps = [reduce(narrow.add if e.op == "+" else narrow.multiply, map(spec, e.args[: i + 1])) for i in range(len(e.args))]
            return all(s.precision + (e.op == "*") <= NATIVE for s in steps) and all(map(fits, e.args))
        case Negate():
            return fits(e.arg)
    return spec(e).precision <= NATIVE


def _native(e: Expr) -> Column:
    match e:
        case Col():
            return F.col(e.name).cast(T.DecimalType(e.spec.precision, e.spec.scale))
        case Const():
            s = spec(e)
            return F.lit(render(e.value, e.scale)).cast(T.DecimalType(s.precision, s.scale))
        case Negate():
            return -_native(e.arg)
        case Nary():
            return reduce((lambda a, b: a + b) if e.op == "+" else (lambda a, b: a * b), map(_native, e.args))
    raise TypeError(type(e))


def compute(e: Expr, optimise: bool = True) -> Column:
    """The expression over wide (binary) or native decimal columns, as a wide column; one batch function for the tree."""
    out = spec(e, narrow.roomy)
    e = simplify(e) if optimise else e
    size, names = width(out.precision), [c.name for c in columns(e)]
    specs = {c.name: c.spec for c in columns(e)}
    f, scale = evaluator(e)
    limit = 10**MOST

    def run(*series: pd.Series) -> pd.Series:
        values = [[None if v is None else decode(v) if isinstance(v, (bytes, bytearray)) else int(v.scaleb(specs[n].scale).to_integral_exact()) for v in s] for n, s in zip(names, series)]
        rows = zip(*values) if names else ((),) * len(series[0])
        got = []
        for row in rows:
            v = f(dict(zip(names, row)))
            if v is not None:
                v = rescale(v, scale, out.scale)
                if abs(v) >= limit:
                    raise OverflowError("a result has more than 288 digits")
            got.append(None if v is None else encode(v, size))
        return pd.Series(got, dtype=object)

    return F.pandas_udf(run, T.BinaryType())(*[F.col(n) for n in names] or [F.lit(1)])


def compute_text(e: Expr, optimise: bool = True) -> Column:
    """The expression as decimal text: native where 38 digits suffice, else by `compute`."""
    out = spec(e)
    if fits(e) and out.precision <= NATIVE:
        return _native(simplify(e) if optimise else e).cast(T.DecimalType(NATIVE, out.scale)).cast("string")
    return to_text(compute(e, optimise), out.scale)


# --- columns ----------------------------------------------------------------


def from_text(column: Column, s: Spec) -> Column:
    size, limit = width(s.precision), 10**s.precision

    def run(texts: pd.Series) -> pd.Series:
        values = [None if t is None else parse(t, s.scale) for t in texts]
        if any(v is not None and abs(v) >= limit for v in values):
            raise OverflowError(f"a value has more than {s.precision} digits")
        return pd.Series([None if v is None else encode(v, size) for v in values], dtype=object)

    return F.pandas_udf(run, T.BinaryType())(column)


def to_text(column: Column, scale: int) -> Column:
    return F.pandas_udf(lambda raw: pd.Series([None if r is None else render(decode(r), scale) for r in raw], dtype=object), T.StringType())(column)


def from_native(column: Column, scale: int, s: Spec) -> Column:
    """A native decimal column of at most 18 digits, `scale` of them after the point, in the storage of `s`, by built-in functions.

    The unscaled number has to fit 64 bits at the scale of `s`; the bytes before it repeat its sign.
    """
    size, value = width(s.precision), (column * 10**scale).cast("bigint") * (10 ** (s.scale - scale))
    if size < 9:
        return from_text(column.cast("string"), s)
    return F.unhex(F.concat(F.when(value < 0, "7F" + "FF" * (size - 9)).otherwise("80" + "00" * (size - 9)), F.lpad(F.hex(value), 16, "0")))


def digits(column: Column, precision: int) -> list[Column]:
    """Base-2^32 digits of the stored bytes, least first; the value is theirs less 2^(8 size - 1)."""
    size = width(precision)
    starts = range(size, 0, -4)
    return [F.conv(F.hex(F.substring(column, max(1, end - 3), min(4, end))), 16, 10).cast("decimal(10,0)") for end in starts]


def linear(e: Expr) -> tuple[Col, Expr] | None:
    """(wide column, narrow factor) of a product of one wide column and factors that have nine digits at most together."""
    e = simplify(e)
    if isinstance(e, Col):
        return e, Const(1, 0)
    if not (isinstance(e, Nary) and e.op == "*"):
        return None
    wide = [x for x in e.args if isinstance(x, Col) and x.spec.precision > NATIVE]
    rest = [x for x in e.args if x not in wide]
    if len(wide) != 1 or not rest:
        return None
    factor = rest[0] if len(rest) == 1 else Nary("*", tuple(rest))
    return (wide[0], factor) if fits(factor) and spec(factor).precision <= 9 else None


def wide_sums(df: DataFrame, keys: list[str], parts: dict[str, Expr], *others: Column) -> DataFrame:
    """keys, an exact SUM per group (text; null without values) of each of `parts`, and further aggregates.

    An expression that is not `linear` is computed first.  Sums of digits are good for 10^19 rows a group.
    """
    forms: dict[str, tuple[Column, int, Column, int]] = {}  # stored column, its precision, unscaled factor, scale of the product
    for name, e in parts.items():
        if found := linear(e):
            column, factor = found
            forms[name] = F.col(column.name), column.spec.precision, (_native(factor) * 10 ** spec(factor).scale).cast("decimal(9,0)"), column.spec.scale + spec(factor).scale
        else:
            out = spec(e, narrow.roomy)
            df = df.withColumn(f"__{name}", compute(e))
            forms[name] = F.col(f"__{name}"), out.precision, F.lit(1).cast("decimal(9,0)"), out.scale
    sums = {name: [F.sum((d * f).cast("decimal(19,0)")).alias(f"__{name}_{i}") for i, d in enumerate(digits(c, p))] + [F.sum(F.when(c.isNotNull(), f)).alias(f"__{name}_f")] for name, (c, p, f, _) in forms.items()}
    found = df.groupBy(*keys).agg(*[c for cs in sums.values() for c in cs], *others)

    def carried(bias: int, scale: int) -> Callable[[pd.Series], pd.Series]:
        def carry(groups: pd.Series) -> pd.Series:
            return pd.Series([None if g is None or g[-1] is None else render(sum(int(v) << (32 * i) for i, v in enumerate(g[:-1])) - bias * int(g[-1]), scale) for g in groups], dtype=object)

        return carry

    totals = [F.pandas_udf(carried(1 << (8 * width(p) - 1), scale), T.StringType())(F.array(*[F.col(f"__{name}_{i}").cast("decimal(38,0)") for i in range(len(sums[name]) - 1)], F.col(f"__{name}_f").cast("decimal(38,0)"))).alias(name) for name, (_, p, _, scale) in forms.items()]
    return found.select(*keys, *totals, *found.columns[len(keys) + sum(map(len, sums.values())) :])


def wide_sum(df: DataFrame, keys: list[str], column: str, s: Spec, name: str) -> DataFrame:
    """keys, name (text): exact SUM per group."""
    return wide_sums(df, keys, {name: Col(column, s)})
