"""Column expressions: numbers, periods, titles and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def br_number(text: Column) -> Column:
    """1.234,56 as 1234.56; what is no number becomes null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".")
    return plain.try_cast("double")


def period_end(text: Column) -> Column:
    """2001, 2001Q2 and 2001M03 as the last day of the period."""
    year = F.substring(text, 1, 4).cast("int")
    part = F.regexp_extract(text, r"(\d+)$", 1).try_cast("int")
    day = lambda month: F.last_day(F.make_date(year, month, F.lit(1)))
    return F.when(text.rlike(r"^\d{4}$"), day(F.lit(12))).when(text.rlike(r"^\d{4}Q[1-4]$"), day(part * 3)).when(text.rlike(r"^\d{4}M\d\d$"), day(part))


def significant(value: Column, digits: int = 6) -> Column:
    """Rounded half to even to so many significant digits; null if not finite."""
    k = digits - 1 - F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), k)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite & (value == 0), F.lit(0.0)).when(finite, F.rint(value * scale) / scale)


def cut_words(text: Column, most: int) -> Column:
    """At most so many characters, cut after a word, with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""), F.lit("…")))


def tokens(text: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of at least three letters that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda t: ~t.isin(stop)))


def gauge(value: Column, low: float, high: float) -> Column:
    """Place between low and high, 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (value - low) / (high - low)))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson's correlation of two columns where both are known; null, not an error, where either is flat."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def half_up(value: Column | str) -> Column:
    """Rounded to two decimals, halves up, as judged by the first five decimals: what sums leave beyond these settles nothing."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(F.round(v * 100000) / 1000 + 0.5).cast("double") / 100


def cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast("long")


def mean_cents(value: str) -> Column:
    """Aggregate: the mean, in whole cents, of values in cents that are not negative; halves up, in whole numbers."""
    n = F.count(value)
    return F.call_function("div", 2 * F.sum(cents(value)) + n, 2 * n)


def thousands(value: str, mean: bool = False) -> Column:
    """Aggregate: the sum, or the mean, in thousands with three decimals, of values in cents that are not negative; halves up, in whole numbers."""
    total = F.sum(cents(value))
    n = F.count(value) if mean else F.lit(1)
    return F.call_function("div", 2 * total + 100 * n, 200 * n) / 1000
