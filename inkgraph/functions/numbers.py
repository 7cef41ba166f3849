"""Fixed-point numbers, labels and number formats.

Weights and sentiments are held as whole ten-thousandths ("ticks", BIGINT), so that every
rounding step is exact, half away from zero, and the same in any SQL engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TICKS = 10_000
#: Polarity bounds, both strict, in ticks.
BOUND = 500


def ticks(value: Column) -> Column:
    """A number rounded to ten-thousandths, half away from zero."""
    return F.round(value.cast("decimal(30,12)") * TICKS, 0).cast("bigint")


def untick(value: Column) -> Column:
    return (value.cast("decimal(18,0)") / F.lit(TICKS).cast("decimal(5,0)")).cast("decimal(18,4)")


def round_div(n: Column, d: Column | int) -> Column:
    """n / d as the nearest whole number, half away from zero; d > 0."""
    d = d if isinstance(d, Column) else F.lit(d)
    up = 2 * F.abs(n) + d
    whole = F.floor((up - up % (2 * d)) / (2 * d))  # exact: the division has no remainder
    return F.when(n < 0, -whole).otherwise(whole).cast("bigint")


def polarity(sentiment_ticks: Column, scale: int = 1) -> Column:
    """positive above 0.05, negative below -0.05, else neutral; of ticks times ``scale``."""
    return F.when(sentiment_ticks > BOUND * scale, "positive").when(sentiment_ticks < -BOUND * scale, "negative").otherwise("neutral")


@F.pandas_udf(StringType())
def general_format(value: pd.Series) -> pd.Series:
    """Four significant digits, trailing zeros dropped, exponent where it is shorter."""
    return value.map(lambda x: f"{x:.4g}" if x is not None and x == x else None)
