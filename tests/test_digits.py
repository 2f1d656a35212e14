"""Exact rounding against Python's, which rounds as C does."""

import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.functions.digits import fixed, rounded
from trialstats.functions.text import format_p, interval


def _values():
    draw = random.Random(5)
    out = [0.125, 0.375, 2.675, 1.005, -0.125, -0.001, 0.0, -0.0, 0.995, 9.995, 0.5, 1.5, 2.5, 1e15 + 0.5, 2.0**52 + 0.5, 2.0**53, 1e22, 123456789012345680.0]
    out += [k / 2**draw.randrange(1, 20) for k in range(-3000, 3000)]
    out += [draw.randrange(-(10**7), 10**7) / 1000 + 0.0005 * draw.randrange(3) for _ in range(200_000)]
    out += [draw.gauss(0, 1) * 10 ** draw.randrange(-8, 12) for _ in range(600_000)]
    bits = (struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(200_000))
    return out + [b for b in bits if math.isfinite(b) and abs(b) < 2.0**106]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(pd.DataFrame({"x": _values()})).repartition(8).persist()


@pytest.mark.parametrize("digits", [0, 2, 7])
def test_same_as_c(values, digits):
    rows = values.select("x", fixed("x", digits).alias("t"), rounded("x", digits).alias("r")).toPandas()
    assert len(rows) > 900_000
    wrong = [(x, t) for x, t in zip(rows.x, rows.t, strict=True) if t != f"{x:.{digits}f}"]
    assert wrong == []
    wrong = [(x, r) for x, r in zip(rows.x, rows.r, strict=True) if r != float(f"{x:.{digits}f}")]
    assert wrong == []


def test_not_finite_and_missing(spark):
    rows = spark.sql("SELECT * FROM VALUES (double('NaN')), (double('Infinity')), (double('-Infinity')), (NULL), (1e300) AS t(x)")
    out = rows.select(fixed("x", 2).alias("t"), rounded("x", 2).alias("r")).collect()
    assert [r.t for r in out][:4] == ["NaN", "Inf", "-Inf", None]
    assert math.isnan(out[0].r) and out[1].r == math.inf and out[3].r is None and out[4].r == 1e300
    with pytest.raises(ValueError):
        fixed("x", 16)


def test_texts_round_halves_to_even(spark):
    row = spark.range(1).select(
        interval(F.lit(0.125), F.lit(2.675)).alias("i"), format_p(F.lit(0.0625)).alias("p"), format_p(F.lit(0.9995)).alias("one")
    ).first()
    assert row.i == "[0.12,2.67]"
    assert row.p == "_p_ = .062"
    assert row.one == ("_p_ > .999" if f"{0.9995:.3f}" == "1.000" else "_p_ = .999")
