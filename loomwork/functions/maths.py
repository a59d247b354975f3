"""Numeric functions as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-squared with one degree of freedom > x); Spark has no erfc."""
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def chi2_critical(alpha: float, tests: int) -> float:
    """The chi-squared value (one degree of freedom) beyond which p < alpha / tests."""
    return NormalDist().inv_cdf(1 - alpha / (2 * max(1, tests))) ** 2


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in generated code."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def present(x: Column | str) -> Column:
    """A double whose NaN is missing, as null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def bin_of(x: Column, bins: tuple[tuple[float, str], ...], closed: bool = False) -> Column:
    """The label of the first (upper, label) whose bound lies above ``x`` (at or above if ``closed``)."""
    out = F.lit(None).cast("string")
    for upper, label in reversed(bins):
        inside = F.lit(True) if upper == math.inf else (x <= upper if closed else x < upper)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)
