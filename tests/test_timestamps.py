import pandas as pd
import pytest

from strandline.operators.timestamps import _em, normalise, readings

LONDON = "Europe/London"


def us(text):
    return int(pd.Timestamp(text, tz="UTC").value // 1000)


@pytest.mark.parametrize(
    "value,home,want",
    [
        ("2009-03-29T00:41:37.980881Z", None, "2009-03-29 00:41:37.980881"),
        ("2011-10-30T00:00:34.293000018Z", None, "2011-10-30 00:00:34.293"),
        ("2015-01-28 17:14:37+0545", LONDON, "2015-01-28 11:29:37"),
        ("2012-03-24T22:24:44-03:30", LONDON, "2012-03-25 01:54:44"),
        ("2015-01-04 12:06:14 CET", LONDON, "2015-01-04 11:06:14"),
        ("D:20150426155326+03'00'", LONDON, "2015-04-26 12:53:26"),
        ("Sun, 29 Mar 2009 03:29:17 +0200", LONDON, "2009-03-29 01:29:17"),
        ("Sat Jul  2 18:43:40 2016", LONDON, "2016-07-02 17:43:40"),
        ("2010-08-05 07:06", LONDON, "2010-08-05 06:06:00"),
        ("28 Mar 2013", LONDON, "2013-03-28 00:00:00"),
        ("20170430", LONDON, "2017-04-30 00:00:00"),
        ("1319932049", None, "2011-10-29 23:47:29"),
        ("1256431706000", None, "2009-10-25 00:48:26"),
        ("1301189656000000", None, "2011-03-27 01:34:16"),
        ("2014-03-30 01:30:00", LONDON, "2014-03-30 01:30:00"),  # skipped: forward by the gap
        ("2014-10-26 01:30:00", LONDON, "2014-10-26 00:30:00"),  # twice: the earlier
        ("2014-10-26T01:30:00[Europe/London]", "Asia/Kolkata", "2014-10-26 00:30:00"),
    ],
)
def test_notations(value, home, want):
    assert readings(value, home)[1] == us(want)


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "0", "0000-00-00", "2019-02-30", "2021-13-04T10:00:00Z", "2018-06-31 12:00:00", "yesterday", "2015-01-04 12:06:14 XQZ", "D:20159926", "x" * 100_000])
def test_no_instant(value):
    assert readings(value, LONDON)[1:] in ((None, None), (None, None))


def test_local_time_without_a_zone_is_none():
    assert readings("2010-08-05 07:06", None)[1] is None


def test_mixture_is_decided_by_the_data_where_nothing_is_stated():
    assert _em(0.5, 80, 0, 40) > 0.95 and _em(0.5, 0, 80, 40) < 0.05 and 0.4 < _em(0.5, 0, 0, 40) < 0.6


def test_readings_of_numeric_dates_follow_the_source(spark):
    teams = spark.createDataFrame([("a", "UTC", "dmy"), ("b", "UTC", "mdy"), ("a", "UTC", "dmy"), (None, "UTC", "dmy")], "team string, zone_id string, date_order string")
    rows = [(1, "a", "01/02/2015 10:00:00"), (2, "b", "01/02/2015 10:00:00"), (3, "c", "01/02/2015"), (4, None, None), (5, "b", "04/04/2017, 4:50:56 AM"), (6, "c", "01/02/2015"), (7, "a", "12.01.2015, 12:15:33 AM")]
    df = spark.createDataFrame(rows, "id int, team string, v string").withColumn("status", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("mine"))
    out = {r.id: r for r in normalise(df, "v", "team", teams).collect()}
    assert len(out) == 7
    assert out[1].utc_us == us("2015-02-01 10:00") and out[2].utc_us == us("2015-01-02 10:00")
    assert out[3].utc_us is None and out[3].status == "ambiguous"
    assert out[4].status == "unusable"
    assert out[5].utc_us == us("2017-04-04 04:50:56") and out[7].utc_us == us("2015-01-12 00:15:33")
    assert normalise(df.limit(0), "v", "team", teams).count() == 0


def read(spark, rows, teams):
    df = spark.createDataFrame(rows, "id int, team string, v string")
    return {r.id: r for r in normalise(df, "v", "team", spark.createDataFrame(teams, "team string, zone_id string, date_order string")).collect()}


def test_order_is_recovered_where_the_statement_is_missing_or_wrong(spark):
    days = [f"{d}/{m}/2015" for d in range(13, 29) for m in ("03", "07")]
    rows = [(i, team, v) for team, k in (("wrong", 0), ("silent", 100)) for i, v in enumerate([*days, "05/04/2015"], k)]
    out = read(spark, rows, [("wrong", "UTC", "mdy"), ("silent", "UTC", None)])
    assert out[32].utc_us == out[132].utc_us == us("2015-04-05") and out[32].status == "ok"


def test_open_order_is_marked(spark):
    rows = [(1, "mixed", "05/04/2015")] + [(i, "mixed", f"{i}/03/2015") for i in range(13, 25)] + [(i + 100, "mixed", f"03/{i}/2015") for i in range(13, 25)]
    out = read(spark, rows, [("mixed", "UTC", None)])
    assert out[1].status == "ambiguous" and out[1].utc_us is None
    assert out[13].utc_us == us("2015-03-13") and out[113].utc_us == us("2015-03-13")


def test_zone_abbreviations_follow_the_offsets_of_the_source(spark):
    written = [(i, "china", "2015-01-04T12:06:14+08:00") for i in range(2, 60)]
    out = read(spark, [(1, "china", "2015-01-04 12:06:14 CST"), (100, "other", "2015-01-04 12:06:14 CST"), *written], [("china", "Asia/Shanghai", None)])
    assert out[1].utc_us == us("2015-01-04 04:06:14") and out[100].utc_us == us("2015-01-04 18:06:14")
    halves = [(i, "both", f"2015-01-04T12:06:14{'+02:00' if i % 2 else '+05:30'}") for i in range(2, 42)]
    assert read(spark, [(1, "both", "2015-01-04 12:06:14 IST"), *halves], [])[1].status == "ambiguous"


def test_units_of_counts(spark):
    rows = [(1, "a", "1319932049"), (2, "a", "1256431706000"), (3, "a", "1301189656000000"), (4, "a", "1301189656000000123"), (5, "a", "0"), (6, "a", "-86400"), (7, "a", "9" * 20)]
    out = read(spark, rows + [(i, "a", f"12564317{i:05d}") for i in range(10, 200)], [])
    assert [out[i].utc_us for i in (1, 2, 3, 4)] == [us("2011-10-29 23:47:29"), us("2009-10-25 00:48:26"), 1301189656000000, 1301189656000000]
    assert out[5].status == "unusable" and out[6].utc_us == us("1969-12-31") and out[7].status == "ok"


def test_jvm_and_python_read_iso_alike(spark):
    local = ["2014-03-30 01:30:00", "2014-10-26T01:30:00", "2010-08-05 07:06", "2010-08-05", "2015-02-29", "2010-08-05 25:00:00", "2010-08-05T07:06:09.123456789"]
    zoned = ["2009-03-29T00:41:37.980881Z", "2015-01-28 17:14:37+0545", "2015-01-28 17:14:37.5 -0330", "2012-03-24T22:24:44-03:30", "2012-03-24T22:24Z", "2012-13-24T22:24Z", "0000-00-00", "1969-12-31T23:59:59.5Z"]
    rows = [(i, team, v) for team, k in (("l", 0), ("none", 100)) for i, v in enumerate(local + zoned, k)]
    out = read(spark, rows, [("l", LONDON, None), ("none", "Mars/Olympus", None)])
    for i, team, v in rows:
        assert out[i].utc_us == readings(v, LONDON if team == "l" else None)[1], (team, v)
