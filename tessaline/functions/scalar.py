"""Scalar functions whose meaning differs from Spark's built-ins, as SQL text builders and Column builders.

The builders take SQL text and give SQL text, so one definition serves both the
dialect (`functions.dialect`) and DataFrame code (`column`).  All are built-in
expressions: nothing leaves whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(builder, *args) -> Column:
    """A Column from a builder: column(truncate, "l_tax", "1")."""
    return F.expr(builder(*args))


def substring(s: str, start: str, length: str | None = None) -> str:
    """1-based, negative from the end; a start of 0 gives the empty string."""
    got = f"substring({s}, {start}{f', {length}' if length is not None else ''})"
    if start.strip().lstrip("-").isdigit():
        return got if int(start) else f"if({s} IS NULL, NULL, '')"
    return f"if({start} = 0, if({s} IS NULL, NULL, ''), {got})"


def truncate(x: str, digits: str) -> str:
    """Toward zero at a number of decimal digits; negative digits clear integer places."""
    return f"(CASE WHEN {x} < 0 THEN ceil({x}, {digits}) ELSE floor({x}, {digits}) END)"


def mod(a: str, b: str) -> str:
    """Sign of the dividend; null for a zero divisor."""
    return f"try_mod({a}, {b})"


def signed(x: str) -> str:
    """Lenient integer: leading digits count, anything else is 0, null stays null."""
    return f"(CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast(regexp_extract(CAST({x} AS STRING), '^\\\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) END)"


def _integer(x: str, scale: int) -> str:
    """The unscaled integer of a decimal, null beyond 38 digits."""
    return f"CAST(try_multiply(CAST({x} AS DECIMAL(38, {scale})), CAST({10**scale} AS DECIMAL({scale + 1}, 0))) AS DECIMAL(38, 0))"


def divide(a: str, b: str, precision: int, scale: int, divisor_precision: int, divisor_scale: int) -> str:
    """Exact quotient of decimals, with four more digits than the dividend's `scale`, half away from zero; null for a zero divisor.

    It is worked out in integers and rounded once: (2 |n| 10^k + |d|) less its remainder, over 2 |d|.  Where that
    passes 38 digits, a quotient with six guard digits is rounded instead.
    """
    out = scale + 4
    if len(a) + len(b) > LONG:  # named once instead of being spelt out again and again
        return f"transform(array(named_struct('n', {a}, 'd', {b})), x -> {divide('x.n', 'x.d', precision, scale, divisor_precision, divisor_scale)})[0]"
    up, digits = 10 ** (4 + divisor_scale), min(38, precision + 4 + divisor_scale)
    kind = f"DECIMAL({min(38, digits + 1)}, {out})" if digits + out + 2 <= 38 else f"DECIMAL(38, {out})"
    sign = f"(CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END)"
    # operands below these fit 64-bit integers all the way
    n, d = f"abs(CAST(({a}) * {10**scale} AS BIGINT))", f"abs(CAST(({b}) * {10**divisor_scale} AS BIGINT))"
    short = f"CAST(CAST({sign} * ((2 * {n} * {up} + {d}) DIV (2 * {d})) AS DECIMAL(19, 0)) * CAST('{10**-out:.{out}f}' AS DECIMAL({out + 1}, {out})) AS {kind})"
    small = f"abs({a}) < {10 ** max(0, 14 - divisor_scale - scale)} AND abs({b}) < {10 ** max(0, 18 - divisor_scale)}"
    n, d = f"abs({_integer(a, scale)})", f"abs({_integer(b, divisor_scale)})"
    x = f"try_add(try_multiply(try_multiply({n}, CAST({up} AS DECIMAL({len(str(up))}, 0))), CAST(2 AS DECIMAL(1, 0))), {d})"
    y = f"CAST(2 * {d} AS DECIMAL(38, 0))"
    whole = f"CAST({sign} * try_divide(try_subtract({x}, try_mod({x}, {y})), {y}) AS DECIMAL(38, 0))"
    # a product of q digits and the unit 10^-out is exact while both fit 38 digits; beyond, the point is moved in the text
    long = f"CAST(CAST({whole} AS DECIMAL({digits}, 0)) * CAST('{10**-out:.{out}f}' AS DECIMAL({out + 1}, {out})) AS {kind})" if digits + out + 2 <= 38 else f"try_cast(concat(CAST({whole} AS STRING), 'E-{out}') AS {kind})"
    if precision + 5 + divisor_scale > 38:
        long = f"coalesce({long}, CAST(round(try_divide(CAST({a} AS DECIMAL(38, {min(37, out + 6)})), {b}), {out}) AS {kind}))"
    if precision <= 14 - divisor_scale and divisor_precision <= 18:
        quotient = short
    else:
        quotient = f"CASE WHEN {small} THEN {short} ELSE {long} END" if 14 >= divisor_scale + scale else long
    return f"(CASE WHEN {b} <> 0 THEN {quotient} END)"


LONG = 400  # characters of operands from which on a let-binding is shorter


def int_divide(a: str, b: str) -> str:
    """int / int is a decimal with four digits, half away from zero; null for a zero divisor."""
    return divide(f"CAST({a} AS DECIMAL(19, 0))", f"CAST({b} AS DECIMAL(19, 0))", 19, 0, 19, 0)


_NUMBER = r"^\\s*([+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def lenient_number(x: str, kind: str) -> str:
    """Text as a number: leading digits count, anything else is 0, null stays null."""
    found = f"regexp_extract({x}, '{_NUMBER}', 1)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {found} = '' THEN CAST(0 AS {kind}) ELSE CAST({found} AS {kind}) END)"


def timediff_seconds(a: str, b: str) -> str:
    return f"(unix_timestamp(CAST({a} AS TIMESTAMP)) - unix_timestamp(CAST({b} AS TIMESTAMP)))"


def timediff(a: str, b: str) -> str:
    """[-]HH:MM:SS; hours may exceed 24."""
    s = timediff_seconds(a, b)
    return f"concat(if({s} < 0, '-', ''), lpad(CAST(abs({s}) DIV 3600 AS STRING), greatest(2, length(CAST(abs({s}) DIV 3600 AS STRING))), '0'), ':', lpad(CAST((abs({s}) DIV 60) % 60 AS STRING), 2, '0'), ':', lpad(CAST(abs({s}) % 60 AS STRING), 2, '0'))"


def timediff_number(a: str, b: str) -> str:
    """The difference as the number HHMMSS, signed, as comparisons with numbers see it."""
    s = timediff_seconds(a, b)
    return f"(sign({s}) * ((abs({s}) DIV 3600) * 10000 + ((abs({s}) DIV 60) % 60) * 100 + abs({s}) % 60))"


def unix_time(x: str, offset_hours: int = 8) -> str:
    """Seconds since 1970 of a wall-clock time read at a fixed offset."""
    return f"CAST(unix_timestamp(CAST({x} AS TIMESTAMP)) - {offset_hours * 3600} AS DECIMAL(20, 0))"


def week(x: str) -> str:
    """Weeks that begin on Sunday, counted from the year's first Sunday; 0 before it."""
    return f"CAST(floor((dayofyear({x}) + 7 - dayofweek({x})) / 7) AS INT)"


def _last_year_end(x: str) -> str:
    return f"date_sub(trunc({x}, 'YEAR'), 1)"


def _ordinal_day(x: str) -> str:
    d = f"day({x})"
    return f"concat({d}, CASE WHEN {d} IN (11, 12, 13) THEN 'th' WHEN {d} % 10 = 1 THEN 'st' WHEN {d} % 10 = 2 THEN 'nd' WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


_PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "W": "EEEE", "a": "E", "j": "DDD", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "p": "a", "r": "hh:mm:ss a", "T": "HH:mm:ss", "f": "SSSSSS"}
_SPECIAL = {
    "D": _ordinal_day,
    "w": lambda x: f"(dayofweek({x}) - 1)",
    "U": lambda x: _two(week(x)),
    "u": lambda x: _two(f"(CASE WHEN extract(YEAROFWEEK FROM {x}) < year({x}) THEN 0 WHEN extract(YEAROFWEEK FROM {x}) > year({x}) THEN 53 ELSE weekofyear({x}) END)"),
    "V": lambda x: _two(f"if({week(x)} > 0, {week(x)}, {week(_last_year_end(x))})"),
    "v": lambda x: _two(f"weekofyear({x})"),
    "X": lambda x: f"if({week(x)} > 0, year({x}), year({x}) - 1)",
    "x": lambda x: f"extract(YEAROFWEEK FROM {x})",
}


def date_format(x: str, pattern: str) -> str:
    """%-specifiers to built-in formats; week numbers and ordinals become expressions; unknown ones stand for themselves."""
    x = f"CAST({x} AS TIMESTAMP)"
    parts, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            if c in _PATTERNS:
                parts.append(f"date_format({x}, '{_PATTERNS[c]}')")
            elif c in _SPECIAL:
                parts.append(f"CAST({_SPECIAL[c](x)} AS STRING)")
            else:
                parts.append("'" + c.replace("'", "\\'") + "'")
        else:
            parts.append("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'")
        i += 1
    return f"concat({', '.join(parts)})" if parts else "''"


COMPOUND = {
    "YEAR_MONTH": "year({0}) * 100 + month({0})",
    "DAY_HOUR": "day({0}) * 100 + hour({0})",
    "DAY_MINUTE": "day({0}) * 10000 + hour({0}) * 100 + minute({0})",
    "DAY_SECOND": "day({0}) * 1000000 + hour({0}) * 10000 + minute({0}) * 100 + second({0})",
    "HOUR_MINUTE": "hour({0}) * 100 + minute({0})",
    "HOUR_SECOND": "hour({0}) * 10000 + minute({0}) * 100 + second({0})",
    "MINUTE_SECOND": "minute({0}) * 100 + second({0})",
    "MICROSECOND": "CAST(date_format({0}, 'SSSSSS') AS BIGINT)",
    "SECOND_MICROSECOND": "CAST(second({0}) AS BIGINT) * 1000000 + CAST(date_format({0}, 'SSSSSS') AS BIGINT)",
    "MINUTE_MICROSECOND": "CAST(minute({0}) * 100 + second({0}) AS BIGINT) * 1000000 + CAST(date_format({0}, 'SSSSSS') AS BIGINT)",
    "HOUR_MICROSECOND": "CAST(hour({0}) * 10000 + minute({0}) * 100 + second({0}) AS BIGINT) * 1000000 + CAST(date_format({0}, 'SSSSSS') AS BIGINT)",
    "DAY_MICROSECOND": "CAST(day({0}) * 1000000 + hour({0}) * 10000 + minute({0}) * 100 + second({0}) AS BIGINT) * 1000000 + CAST(date_format({0}, 'SSSSSS') AS BIGINT)",
}


def extract(part: str, x: str) -> str:
    """Simple and compound units; WEEK counts Sundays."""
    part = part.strip().strip("'\"").upper()
    if part == "WEEK":
        return week(x)
    if part in COMPOUND:
        return f"({COMPOUND[part].format(f'CAST({x} AS TIMESTAMP)')})"
    return f"CAST(extract({part} FROM CAST({x} AS TIMESTAMP)) AS INT)"


def add_interval(x: str, n: str, part: str, sign: int = 1) -> str:
    """x plus or minus n units; month ends clamp; DATE plus days, weeks, months, quarters or years stays DATE."""
    part = part.strip().upper().rstrip("S")
    n = f"({n})" if sign > 0 else f"(-({n}))"
    if part == "QUARTER":
        part, n = "MONTH", f"(3 * {n})"
    if part == "MICROSECOND":
        return f"timestampadd(MICROSECOND, {n}, {x})"
    fields = ["YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND"]
    at = fields.index(part)
    start = x if at < 4 else f"CAST({x} AS TIMESTAMP)"
    return f"({start} + make_interval({', '.join([*['0'] * at, n])}))"
