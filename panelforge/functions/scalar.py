"""Column functions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def row_mean(*cols: Column) -> Column:
    """Mean of the non-null columns of a row; null if all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, count)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def midrank(value: Column, *group: str) -> Column:
    """Mid-rank percentile within the group: ties share their mean rank, nulls stay null and don't count."""
    missing = value.isNull()
    ordered = Window.partitionBy(*group, missing).orderBy(value)
    tied = Window.partitionBy(*group, value)
    every = Window.partitionBy(*group, missing)
    one = F.lit(1)
    rank = F.rank().over(ordered) + (F.count(one).over(tied) - 1) / 2
    return F.when(~missing, (rank - 0.5) / F.count(one).over(every) * 100)


def winsorize(value: Column, low: float, high: float, *group: str) -> Column:
    """Clamp at linear quantiles of the group; a group with one value stays as it is."""
    w: WindowSpec = Window.partitionBy(*group)
    bounds = F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w)
    return F.when(value.isNotNull() & (F.count(value).over(w) >= 2), F.greatest(bounds[0], F.least(bounds[1], value))).otherwise(value)


def z_to_score(value: Column, *group: str, inverted: bool = False) -> Column:
    """Population z-score mapped from -3..3 to 0..100; a group without spread maps to 50."""
    w = Window.partitionBy(*group)
    sigma = F.stddev_pop(value).over(w)
    z = (value - F.avg(value).over(w)) / F.when(sigma == 0, F.lit(1e-9)).otherwise(sigma)
    return clamp(((-z if inverted else z) + 3) / 6 * 100, 0, 100)


def parse_number(c: Column) -> Column:
    """Numeric text with commas; '-' , 'N/A' and other text give 0."""
    return F.coalesce(F.try_to_number(F.regexp_replace(F.trim(c), ",", ""), F.lit("S9999999999999.9999")).cast("double"), F.regexp_replace(F.trim(c), ",", "").try_cast("double"), F.lit(0.0))


def parse_amount(c: Column) -> Column:
    """Amount text where parentheses mean negative; anything else that isn't a number gives null."""
    bare = F.regexp_replace(F.trim(c), "[(),]", "").try_cast("double")
    return F.when(F.trim(c).rlike(r"^\(.*\)$"), -bare).otherwise(bare)


def strip_html(c: Column) -> Column:
    """Text without tags and with the common entities resolved."""
    text = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)
