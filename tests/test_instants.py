import shutil
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quire.functions.instants import number_instant, parse
from quire.operators.instants import normalise_instants


def ms(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    "raw, zone, day_first, want",
    [
        ("Sun, 14 Apr 2024 06:37:19 CEST", "Europe/Berlin", True, ms(2024, 4, 14, 4, 37, 19)),
        ("Wednesday, 01-Apr-26 03:45:29 GMT", "UTC", True, ms(2026, 4, 1, 3, 45, 29)),
        ("Wed Mar 12 09:42:45 2025", "UTC", True, ms(2025, 3, 12, 9, 42, 45)),
        ("2024-04-15 20:16", "America/New_York", False, ms(2024, 4, 16, 0, 16)),
        ("Mon, 15 Apr 2024 10:00:00 CST", "Asia/Shanghai", True, ms(2024, 4, 15, 2)),
        ("Mon, 15 Apr 2024 10:00:00 CST", "America/Chicago", False, ms(2024, 4, 15, 16)),
        ("02/04/2024 18:59", "UTC", True, ms(2024, 4, 2, 18, 59)),
        ("02/04/2024 18:59", "UTC", False, ms(2024, 2, 4, 18, 59)),
        ("4/15/2024 12:06 AM", "UTC", False, ms(2024, 4, 15, 0, 6)),
        ("13/4/2024 6:03 p.m.", "UTC", True, ms(2024, 4, 13, 18, 3)),
        ("15.4.2024, 02:37:27", "UTC", False, ms(2024, 4, 15, 2, 37, 27)),
        ("2024年4月15日 下午6:34", "UTC", True, ms(2024, 4, 15, 18, 34)),
        ("2024年04月16日 0时21分05秒", "UTC", True, ms(2024, 4, 16, 0, 21, 5)),
        ("16. März 2024, 19:06 Uhr", "UTC", True, ms(2024, 3, 16, 19, 6)),
        ("14 de abril de 2024 21:59", "UTC", True, ms(2024, 4, 14, 21, 59)),
        ("April 15, 2024 2:53 AM", "UTC", True, ms(2024, 4, 15, 2, 53)),
        ("2024-04-15T13:48:14+05:30[Asia/Kolkata]", "UTC", True, ms(2024, 4, 15, 8, 18, 14)),
        ("2024-04-14 09:01:39 Asia/Shanghai", "UTC", True, ms(2024, 4, 14, 1, 1, 39)),
        ("2024-04-19 03:11:35 (Australia/Sydney)", "UTC", True, ms(2024, 4, 18, 17, 11, 35)),
        ("2024-04-14 05:55:16 GMT+01:00", "UTC", True, ms(2024, 4, 14, 4, 55, 16)),
        ("2024-04-16T10:54:03,587999Z", "UTC", True, ms(2024, 4, 16, 10, 54, 3) + 587),
        ("Wed, 17 Apr 24 03:22:54 +1000", "UTC", True, ms(2024, 4, 16, 17, 22, 54)),
        ("20240415T012019Z", "UTC", True, ms(2024, 4, 15, 1, 20, 19)),
        ("20240416", "UTC", True, ms(2024, 4, 16)),
        ("1713106400", "UTC", True, 1713106400000),
        ("1713134120300", "UTC", True, 1713134120300),
        ("1713169613092526", "UTC", True, 1713169613092),
        ("1713169613092526789", "UTC", True, 1713169613092),
        ("1713232453.328", "UTC", True, 1713232453328),
        ("２０２４-04-15", "UTC", True, ms(2024, 4, 15)),
        # a clock time that occurs twice is the first; one that is skipped moves forward by the gap
        ("2024-10-27 02:30", "Europe/Berlin", True, ms(2024, 10, 27, 0, 30)),
        ("2024-03-31 02:30", "Europe/Berlin", True, ms(2024, 3, 31, 1, 30)),
        ("Tue, 15 Apr 2024 10:00:00 GMT", "UTC", True, ms(2024, 4, 15, 10)),  # a wrong weekday
        ("2025-18-16 10:31:00", "UTC", True, None),
        ("31 Jun 2023 08:00:00 +0000", "UTC", True, None),
        ("2024-04-15 25:00", "UTC", True, None),
        ("yesterday", "UTC", True, None),
        ("昨天", "UTC", True, None),
        ("0", "UTC", True, None),
        ("-1", "UTC", True, None),
        ("", "UTC", True, None),
        (None, "UTC", True, None),
        ("Thu, 01 Jan 1970 00:00:00 GMT", "UTC", True, None),
        ("x" * 100_000, "UTC", True, None),
        ("2024-04-15", None, None, ms(2024, 4, 15)),
        ("2024-04-15", "No/Where", None, ms(2024, 4, 15)),
    ],
)
def test_parse(raw, zone, day_first, want):
    assert parse(raw, zone, day_first) == want


def test_numbers_in_the_engine_are_the_same(spark):
    values = [1665778426, 1725116191391, 20250114130811, 1731127737145638, 1719418335725878720, 0, -1, 20241399, 20240416, 202404161230, 2**63 - 1, None]
    df = spark.createDataFrame([(v,) for v in values], "c bigint").select("c", number_instant(F.col("c")).alias("ms"))
    for c, got in df.collect():
        assert got == (None if c is None else parse(str(c))), c


SCHEMA = "field_name string, row_key bigint, raw string, zone_name string, day_first boolean, epoch_ms string"


def test_operator(spark, rows, tmp_path):
    data = [("f", 1, "2024-04-15", "UTC", True, "x"), ("f", 1, "2024-04-15", "UTC", True, "x"), ("f", 2, None, "UTC", True, ""), ("f", 3, " ", None, None, ""), ("g", 4, "soon", None, None, ""), ("g", 5, "1713106400", None, None, "")]
    df = spark.createDataFrame(data, SCHEMA)
    want = [("f", 1, ms(2024, 4, 15))] * 2 + [("g", 5, 1713106400000)]
    assert rows(normalise_instants(df)) == want
    path = str(tmp_path / "dictionary")
    kept = lambda: spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert rows(normalise_instants(df, path)) == want
    assert kept().count() == 3
    more = spark.createDataFrame([*data, ("h", 6, "2024-04-16", "UTC", True, "")], SCHEMA)
    assert len(rows(normalise_instants(more, path))) == 4
    assert kept().count() == 4  # only what was new was parsed and kept
    assert normalise_instants(df.limit(0)).count() == 0


def test_a_broken_run_and_two_runs_at_once_leave_one_row_each(spark, rows, tmp_path):
    path = tmp_path / "dictionary"
    df = spark.createDataFrame([("f", 1, "2024-04-15", "UTC", True, ""), ("g", 2, "2024-04-15", "UTC", True, "")], SCHEMA)
    want = [("f", 1, ms(2024, 4, 15)), ("g", 2, ms(2024, 4, 15))]
    assert rows(normalise_instants(df, str(path))) == want  # the source is part of the key
    one = next(path.glob("reading-*/*"))
    shutil.copytree(one, one.parent / "other-writer")  # the same values from another run
    shutil.copytree(one, one.parent / "broken-off")
    (one.parent / "broken-off" / "_SUCCESS").unlink()
    assert rows(normalise_instants(df, str(path))) == want


def test_long_values_and_remarks():
    assert parse("Mon, 15 Apr 2024 10:00:00 +0000 (a remark " + "that goes on " * 20 + ")") == ms(2024, 4, 15, 10)
    assert parse("2024-04-15 " + "x" * 100_000) is None
