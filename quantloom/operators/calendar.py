"""The date dimension: rebalance dates and the epochs between them.

Windows over all dates run on distinct dates only, a few thousand rows whatever the panel's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODES = ("W", "M", "Q", "H", "Y")


def bucket(date: Column, code: str) -> Column:
    """Label of the calendar period of a date; weeks start on Monday and end with the year."""
    year = F.year(date)
    if code == "W":
        week = F.floor((F.dayofyear(date) - 1 + 7 - F.weekday(date)) / 7)
        return F.concat_ws("-", year, week)
    if code == "M":
        return F.concat_ws("-", year, F.month(date))
    if code == "Q":
        return F.concat_ws("-", year, F.quarter(date))
    if code == "H":
        return F.concat_ws("-", year, F.ceil(F.month(date) / 6))
    if code == "Y":
        return year.cast("string")
    raise ValueError(f"rebalance period must be a positive int or one of {CODES}, got {code!r}")


def epochs(dates: DataFrame, date: str, period: int | str) -> DataFrame:
    """(date, g, rebalance): each date's epoch, and whether the epoch's portfolio is formed on it.

    An int rebalances every so many dates from the first; a code on the last date of each period, and
    dates before the first rebalance get -1.
    """
    dim = dates.select(date).distinct()
    in_time = Window.orderBy(date)
    if isinstance(period, int):
        if period < 1:
            raise ValueError("a rebalance period must be positive")
        number = F.row_number().over(in_time) - 1
        return dim.select(date, F.floor(number / period).cast("long").alias("g"), (number % period == 0).alias("rebalance"))
    flag = F.col(date) == F.max(date).over(Window.partitionBy(bucket(F.col(date), period)))
    dim = dim.withColumn("rebalance", flag)
    so_far = F.sum(F.col("rebalance").cast("long")).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    return dim.select(date, (so_far - 1).alias("g"), "rebalance")
