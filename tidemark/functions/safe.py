"""Column functions that give NULL where a value cannot be computed; blanks are never zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timestamp form of recorded reports.
REPORT_TIME = "yyyy-MM-dd HH:mm:ss,SSSSSS"


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def number(text: Column) -> Column:
    """A double from text; blank or malformed text is NULL, and so is NaN."""
    x = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def whole_number(text: Column) -> Column:
    """A long from decimal text or from hexadecimal text that begins with 0x."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 32), 16, 10).try_cast("long")).otherwise(t.try_cast("long"))


def report_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(REPORT_TIME))


def upper_median(x: str) -> Column:
    """The value at place n // 2 of the n sorted values of a column; buffers are merged, not lists gathered."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def variation(x: Column) -> Column:
    """Population standard deviation over mean; NULL where the mean is 0."""
    return ratio(F.stddev_pop(x), F.avg(x))


def pearson(a: Column, b: Column) -> Column:
    """Correlation; NULL, not an error, where either side is constant."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def entropy(counts: Column, total: Column) -> Column:
    """Shannon entropy in bits, aggregated over the counts of the outcomes."""
    p = ratio(counts, total)
    return -F.sum(p * F.log2(p))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Rate and both ends of the Wilson score interval, cut at 0 and 1; NULL where n is 0."""
    p, m = ratio(hits, n), n.cast("double")
    m = F.when(n > 0, m)
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    guard = lambda c: F.when(n > 0, c)
    return p, guard(F.greatest(F.lit(0.0), centre - half)), guard(F.least(F.lit(1.0), centre + half))
