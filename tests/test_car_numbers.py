"""Car numbers before which a single spoken digit ends a longer numeral, and those in digits alone."""

from pyspark.sql import functions as F
from utterlake.functions import numbers


def test_one_spoken_digit_is_no_car_number(spark):
    cases = {"二十三車": ("二十三車", "二十三車"), "三車": ("三車", "三車"), "零五車": ("05 車", "零五車"), "二五二六車": ("25/26 車", "二五二六車"), "5車": ("5 車", "5 車"), "1234車": ("12/34 車", "12/34 車"), "九九車 7/12車": ("99 車 07/12 車", "九九車 07/12 車")}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    t = F.col("t")
    got = d.select(t, numbers.normalize_car_numbers(t).alias("all"), numbers.normalize_car_numbers(t, False).alias("digits"), numbers.car_number_changes(t, False).alias("n")).collect()
    assert {r["t"]: (r["all"], r["digits"]) for r in got} == cases
    assert {r["t"]: r["n"] for r in got} == {"二十三車": 0, "三車": 0, "零五車": 0, "二五二六車": 0, "5車": 1, "1234車": 1, "九九車 7/12車": 1}
