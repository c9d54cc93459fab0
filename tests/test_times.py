from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugework.functions import times
from helpers import frame


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_clock_times_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    skipped = dt.datetime(2024, 3, 10, 2, 30, 0, 250000)  # a time New York clocks never show
    earlier = dt.datetime(2024, 3, 9, 2, 30)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = frame(spark, [(earlier, skipped)], "a timestamp_ntz, b timestamp_ntz").select(
            times.clock_text(F.col("b")),
            times.seconds_between(F.col("a"), F.col("b")).cast("double"),
            F.unix_seconds(times.as_instant(F.col("b"))),
            times.from_instant(times.as_instant(F.col("b"))),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    utc = int(skipped.replace(tzinfo=dt.timezone.utc).timestamp())
    assert tuple(row) == ("2024-03-10 02:30:00", 86400.25, utc, skipped)
