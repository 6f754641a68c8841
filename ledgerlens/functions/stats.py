"""Statistics as column expressions: aggregates over a group, and rules on their results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import exact_sum, ratio

#: Thresholds of the rules.
MOMENTUM_STEP = 0.05
VOLATILE, UPWARD, DOWNWARD = 0.3, 0.1, -0.1
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = (0.1, 6), (0.2, 3)
LOST_AFTER_DAYS = 30


def mean(x: Column) -> Column:
    """Mean of the group; 0 if it has no values."""
    return F.coalesce(ratio(F.sum(x), F.count(x)), F.lit(0.0))


def median(x: Column) -> Column:
    """Exact median of the group; 0 if it has no values."""
    return F.coalesce(F.median(x.cast("double")), F.lit(0.0))


def stddev(x: Column) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    return F.when(F.count(x) <= 1, F.lit(0.0)).otherwise(F.stddev_pop(x.cast("double")))


def stddev_around(x: Column, centre: Column) -> Column:
    """Root mean square distance from a given centre; 0 for fewer than two values."""
    return F.when(F.count(x) <= 1, F.lit(0.0)).otherwise(F.sqrt(F.avg(F.pow(x.cast("double") - centre, F.lit(2)))))


def volatility(x: Column) -> Column:
    """Standard deviation over the absolute mean; 0 if the mean is 0 or there are no values."""
    return F.when(mean(x) == 0, F.lit(0.0)).otherwise(stddev(x) / F.abs(mean(x)))


def exact_volatility(x: Column) -> Column:
    """`volatility` of values of up to four decimal places from exact sums, the same in any order; that of doubles where these would not fit."""
    d = x.try_cast("decimal(18,4)")
    n, s = F.count(x), F.sum(d).try_cast("decimal(18,4)")
    gap = n.try_cast("decimal(10,0)") * F.sum(d * d).try_cast("decimal(27,8)") - s * s
    exact = F.sqrt(gap.cast("double")) / n / F.abs(mean(x))
    return F.when(mean(x) == 0, F.lit(0.0)).otherwise(F.coalesce(F.when(F.count(d) == n, exact), volatility(x)))


def growth_rate(earliest: Column, latest: Column) -> Column:
    """Relative change; from 0 it is 1 if there is growth, else 0."""
    return F.when(earliest == 0, F.when(latest > 0, 1.0).otherwise(0.0)).otherwise((latest - earliest) / earliest)


def momentum(first_change: Column, last_change: Column, changes: Column) -> Column:
    """Rule on the mean step of a series of changes, by its first and last value and their number."""
    step = F.when(changes >= 2, (last_change - first_change) / (changes - 1)).otherwise(0.0)
    return F.when(step > MOMENTUM_STEP, "accelerating").when(step < -MOMENTUM_STEP, "decelerating").otherwise("stable")


def direction(growth: Column, spread: Column) -> Column:
    """Rule on growth and volatility; volatility is looked at first."""
    return F.when(spread > VOLATILE, "volatile").when(growth > UPWARD, "upward").when(growth < DOWNWARD, "downward").otherwise("stable")


def confidence(spread: Column, points: Column) -> Column:
    return (
        F.when((spread < HIGH_CONFIDENCE[0]) & (points >= HIGH_CONFIDENCE[1]), "high")
        .when((spread <= MEDIUM_CONFIDENCE[0]) & (points >= MEDIUM_CONFIDENCE[1]), "medium")
        .otherwise("low")
    )


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(b, a))


def herfindahl(share: Column) -> Column:
    """Sum of squared shares given in percent; 0 without shares."""
    return F.coalesce(exact_sum(F.pow(share / 100, F.lit(2)), 18), F.lit(0.0))
