"""Dates of birth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar model and time format of the knowledge base.
GREGORIAN = "Q1985727"
TIME_FORMAT = "'+'yyyy-MM-dd'T'HH:mm:ss'Z'"


def birth_time(dates: Column) -> Column:
    """Text of the last date given in the Gregorian calendar, from array<struct<time, calendar>>."""
    return F.try_element_at(F.filter(dates, lambda d: d.calendar == GREGORIAN), F.lit(-1)).getField("time")


def parse_time(text: Column) -> Column:
    """Date of a time text; dates of less than day precision give null."""
    return F.try_to_date(text, TIME_FORMAT)


def birth_year(dates: Column) -> Column:
    return F.year(parse_time(birth_time(dates)))
