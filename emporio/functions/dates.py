"""Calendar expressions shared by dim_date (B5) and time-series features (H5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def parse_ts(col: Column | str) -> Column:
    """Lenient timestamp parse: NULL instead of an error on bad input."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c, F.lit(TS_FMT))


def date_key(d: Column) -> Column:
    """yyyyMMdd as INT."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_year(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def is_weekend(d: Column) -> Column:
    # dayofweek: 1 = Sunday ... 7 = Saturday
    return F.dayofweek(d).isin(1, 7)


def is_month_end(d: Column) -> Column:
    return F.month(d) != F.month(F.date_add(d, 1))


def calendar_columns(d: Column) -> list[Column]:
    """The 16 attributes of dim_date for a DATE column."""
    q = F.quarter(d)
    return [
        date_key(d).alias("date_key"),
        F.dayofmonth(d).alias("day_number"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_number"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short_name"),
        month_year(d).alias("month_year"),
        q.alias("quarter_number"),
        F.concat(F.lit("Q"), q.cast("string")).alias("quarter_name"),
        F.concat(F.year(d).cast("string"), F.lit("Q"), q.cast("string")).alias("quarter_label"),
        F.year(d).alias("year_number"),
        F.dayofyear(d).alias("day_of_year"),
        is_weekend(d).alias("is_weekend"),
        (F.dayofmonth(d) == 1).alias("is_month_start"),
        is_month_end(d).alias("is_month_end"),
    ]
