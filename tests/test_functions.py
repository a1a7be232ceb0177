from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitsignal.functions import maths, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [
    ("2024-01-01 10:00:00.123456", datetime(2024, 1, 1, 10, 0, 0, 123456)),
    ("2024-01-01 10:00:00.5", datetime(2024, 1, 1, 10, 0, 0, 500000)),
    ("2024-01-01 10:00:00", None),
    ("bad", None),
    (None, None),
])
def test_parse_fixed(spark, given, want):
    assert one(spark, times.parse_fixed(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, want", [
    ("2024-01-01T10:00:00+02:00", datetime(2024, 1, 1, 8)),
    ("2024-01-01", datetime(2024, 1, 1)),
    ("31/12/2024", None),
])
def test_parse_iso(spark, given, want):
    assert one(spark, times.parse_iso(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [
    ("3/2/2024", datetime(2024, 2, 3)),
    ("03/02/2024 7:05:09", datetime(2024, 2, 3, 7, 5, 9)),
    ("2024-02-03 01:00:00", datetime(2024, 2, 3, 1)),
    ("31/31/2024", None),
])
def test_parse_day_first(spark, given, want):
    assert one(spark, times.parse_day_first(F.lit(given))) == want


def test_site_time_over_clock_change(spark):
    def local(text_):
        return one(spark, times.to_site_time(F.lit(text_).cast("timestamp_ntz")))

    assert local("2024-01-01 03:00:00") == datetime(2024, 1, 1, 0)
    assert local("2024-07-01 04:00:00") == datetime(2024, 7, 1, 0)
    # Clocks go back on 7 April 2024: both instants show 23:30 on the 6th.
    assert local("2024-04-07 02:30:00") == local("2024-04-07 03:30:00") == datetime(2024, 4, 6, 23, 30)


def test_clock_and_buckets(spark):
    day, clock = (F.lit(t).cast("timestamp_ntz") for t in ("2024-02-03", "2024-02-04 05:06:07.9"))
    assert one(spark, times.replace_clock(day, clock)) == datetime(2024, 2, 3, 5, 6, 7)
    assert one(spark, times.at_time(day, F.lit("05:06:07"))) == datetime(2024, 2, 3, 5, 6, 7)
    assert one(spark, times.at_time(day, F.lit("late"))) is None
    at = F.lit("2024-02-03 00:08:00").cast("timestamp_ntz")
    assert one(spark, times.bucket_start(at, 420, day)) == datetime(2024, 2, 3, 0, 7)
    before = F.lit("1969-12-31 23:59:00").cast("timestamp_ntz")
    assert one(spark, times.bucket_start(before, 3600)) == datetime(1969, 12, 31, 23)
    assert one(spark, times.month_name_es(day)) == "Febrero"
    assert one(spark, times.time_of_day(clock)) == "05:06:07"
    assert one(spark, times.add_days(day)) == datetime(2024, 2, 4)


def test_text(spark):
    assert one(spark, text.tidy_upper(F.lit("\t cat - 789c \n"))) == "CAT - 789C"
    assert one(spark, text.first_three_digits(F.lit("x12 4567"))) == "456"
    assert one(spark, text.first_three_digits(F.lit("x12"))) is None
    assert [one(spark, text.zero_fill(F.lit(x))) for x in ("7", "012", "12345")] == ["007", "012", "12345"]
    assert one(spark, text.banner_date(F.lit("x Equipo  CAEX 1/02/2024 y"))) == "1/02/2024"
    assert one(spark, text.banner_date(F.lit("EQUIPO 1/02/2024"))) is None
    assert [one(spark, text.is_plain_number(F.lit(x))) for x in ("5", "5.", ".5", "1.2.3", ".", "", "-1")] == [
        True, True, True, False, False, False, False]
    assert one(spark, text.is_digits(F.lit(None).cast("string"))) is False
    assert one(spark, text.grouped_number(F.lit(1234567))) == "1,234,567"


def test_numbers(spark):
    assert one(spark, maths.power_of_ten(F.lit(3))) == 1000.0
    assert one(spark, maths.power_of_two(F.lit(3))) == 8.0
    assert one(spark, maths.sin_degrees(F.lit(90.0))) == pytest.approx(1.0)
    assert one(spark, maths.cos_degrees(F.lit(45.0))) == pytest.approx(2 ** -0.5)
    assert [one(spark, maths.to_number(F.lit(x))) for x in ("1.5", "x", "NaN")] == [1.5, None, None]
    assert one(spark, maths.linear_score(F.lit(10), 100, 0.3)) == pytest.approx(103.0)
