"""Doubles to a number of decimals, by their exact binary values.

``format_string`` and ``bround`` round the shortest decimal that reads back as the double, so 2.675 (which is a little less) becomes
2.68. C's ``%.2f`` rounds the double itself, and exact halves to even: 2.67, and 0.12 for 0.125. Here the
fraction times 10^n is taken as a rounded product plus its error, both doubles, and compared with the half between two
neighbours; no value is rounded on the way. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col

MOST_DIGITS = 15  # 10^15 is the largest power below 2^53
WHOLE = 2.0**53  # doubles from here on have no fraction
SPLIT = 2.0**27 + 1  # cuts a double in two halves of at most 26 bits
DECIMAL_END = 2.0**106  # whole numbers below it are two 53-bit halves


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _halves(value: float) -> tuple[float, float]:
    high = SPLIT * value - (SPLIT * value - value)
    return high, value - high


def _nearest(whole_part: Column, fraction: Column, digits: int) -> Column:
    """``fraction * 10^digits`` (of a fraction below one), rounded half to even without an error."""
    scale = 10.0**digits
    high_s, low_s = _halves(scale)

    def with_error(f: Column, cut: Column, product: Column) -> Column:
        high = cut - (cut - f)
        low = f - high
        error = ((high * high_s - product) + high * low_s + low * high_s) + low * low_s
        whole = F.floor(product)
        beyond = ((product - whole) - 0.5) + error  # its sign is exact
        last = whole if digits else whole_part
        return whole + F.when((beyond > 0) | ((beyond == 0) & (last % 2 == 1)), 1).otherwise(0)

    parts = F.struct(fraction.alias("f"), (fraction * SPLIT).alias("cut"), (fraction * scale).alias("product"))
    return _let(parts, lambda v: with_error(v["f"], v["cut"], v["product"]))


def _parts(size: Column, digits: int) -> Column:
    """(whole, decimals) of a size below 2^53, as whole numbers, after rounding."""
    scale = 10**digits

    def carried(v: Column) -> Column:
        return F.struct((v["whole"] + F.when(v["near"] >= scale, 1).otherwise(0)).alias("whole"), (v["near"] % scale).alias("decimals"))

    def cut(v: Column) -> Column:
        whole = F.floor(v)
        return _let(F.struct(whole.alias("whole"), _nearest(whole, v - whole, digits).alias("near")), carried)

    return _let(size, cut)


def _checked(digits: int) -> None:
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"between 0 and {MOST_DIGITS} decimals")


def fixed(value: ColumnLike, digits: int) -> Column:
    """The text of C's ``%.<digits>f``; ``NaN``, ``Inf`` and ``-Inf`` for those, NULL for NULL.

    From 2^106 on, digits behind the shortest decimal that reads back as the double are zeros.
    """
    _checked(digits)
    double = as_col(value).cast("double")
    point = "." if digits else ""

    def small(size: Column) -> Column:
        return _let(
            _parts(size, digits),
            lambda v: F.concat(v["whole"].cast("string"), F.lit(point), F.lpad(v["decimals"].cast("string"), digits, "0") if digits else F.lit("")),
        )

    def large(size: Column) -> Column:
        top = F.floor(size / WHOLE)
        below = (size - top.cast("double") * WHOLE).cast("long")
        exact = top.cast("decimal(18,0)") * F.lit(Decimal(2**53)) + below.cast("decimal(18,0)")
        return F.concat(exact.cast("decimal(38,0)").cast("string"), F.lit(point + "0" * digits))

    def text(v: Column) -> Column:
        size = F.abs(v)
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        shown = F.when(size < WHOLE, small(size)).when(size < DECIMAL_END, large(size)).otherwise(F.format_string(f"%.{digits}f", size))
        shown = F.when(size == float("inf"), F.lit("Inf")).otherwise(shown)
        return F.when(v.isNull(), None).when(F.isnan(v), "NaN").otherwise(F.concat(sign, shown))

    return _let(double, text)


def rounded(value: ColumnLike, digits: int) -> Column:
    """The double nearest to the value's exact rounding, half to even; what isn't finite stays."""
    _checked(digits)
    scale = 10**digits

    def number(v: Column) -> Column:
        size = F.abs(v)
        sign = F.when(v < 0, -1.0).otherwise(1.0)
        # both are whole numbers below 2^53, so one division rounds once
        near = _let(_parts(size, digits), lambda p: (p["whole"] * scale + p["decimals"]).cast("double") / float(scale))
        return F.when(size < WHOLE / scale / 2, sign * near + 0.0).when(size < WHOLE, fixed(v, digits).cast("double")).otherwise(v)

    return _let(as_col(value).cast("double"), number)
