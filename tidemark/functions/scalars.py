"""Scalar expressions: calendar, guards, normal distribution, text sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column) -> Column:
    """NaN and infinities become NULL; Spark orders NaN above every number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_log(x: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(F.log(x))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def float_div(a: Column, b: Column) -> Column:
    """a / b as SQL divides doubles: by zero gives an infinity, or NaN for 0 / 0, instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    nan = F.isnan(a) | (a == 0)
    by_zero = F.when(nan, float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def up_or_down(x: Column) -> Column:
    """1 from zero up, otherwise (also where missing) -1."""
    return F.when(null_if_nan(x) >= 0, 1).otherwise(-1)


def day_number(date: Column) -> Column:
    """A yyyyMMdd integer as a date."""
    return F.to_date(date.cast("string"), "yyyyMMdd")


def month_end_weekday(date: Column) -> Column:
    """Last weekday of the date's month."""
    last = F.last_day(date)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def month_first_weekday(date: Column) -> Column:
    """First weekday of the date's month, or of the month before if the date isn't after it."""

    def first(d: Column) -> Column:
        day = F.trunc(d, "month")
        return F.date_add(day, F.when(F.weekday(day) > 4, 7 - F.weekday(day)).otherwise(0))

    return F.when(first(date) < date.cast("date"), first(date)).otherwise(first(F.add_months(date, -1)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, rational approximation with error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(x: str) -> str:
    """The same approximation as SQL text over a column name."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    upper = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly})"
    return f"(case when {x} >= 0 then 1 - {upper} else {upper} end)"


def clean_text(text: Column) -> Column:
    """Line ends to spaces, ASCII punctuation dropped, lower case, single spaces."""
    flat = F.regexp_replace(text, "[\\r\\n]", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(flat, r"[!-/:-@\[-`{-~]", "")), "\\s+", " "))


def sections(text: Column, start: str, end: str) -> Column:
    """All stretches from a ``start`` match to the next ``end`` match."""
    return F.regexp_extract_all(text, F.lit(f"({start}.*?){end}"), F.lit(1))


def longest(items: Column) -> Column:
    """Longest string (the first of equal ones), NULL if there is none."""
    return F.reduce(items, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def score_or_null(text: Column) -> Column:
    """A number clipped to [0, 1], NULL where it doesn't parse."""
    number = F.regexp_extract(text, r"-?\d+(\.\d+)?", 0).try_cast("double")
    return F.when(number.isNotNull(), clip(number, 0.0, 1.0))


def bet_size(probability: Column, side: Column, classes: int = 2) -> Column:
    z = (probability - 1 / classes) / F.sqrt(probability * (1 - probability))
    return side * (2 * normal_cdf(z) - 1)


def discretise(x: Column, step: float) -> Column:
    return clip(F.round(x / step) * step, -1.0, 1.0)


def position_size(gap: Column, width: Column) -> Column:
    return gap / F.sqrt(width + gap * gap)
