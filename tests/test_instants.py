from lexloom.functions.instants import listing_norms

LISTING = "id long, source string, date string, date_precision string, extra string, _d_year string, zone_of_source string"
CASES = [
    ("home", "2013-05-13", "day", "2013-05-13"),
    ("home", " 2013-05-13 ", None, "2013-05-13"),
    ("home", "13/05/2013", "day", "2013-05-13"),
    ("us", "05/13/2013", "day", "2013-05-13"),
    ("us", "13/05/2013", "day", "none"),
    ("home", "13.05.48", "day", "1948-05-13"),
    ("home", "13.05.26", "day", "2026-05-13"),
    ("home", "13.05.30", "day", "none"),
    ("home", "29.02.2023", "day", "none"),
    ("home", "29.02.2024", "day", "2024-02-29"),
    ("home", "29.02.1900", "day", "none"),
    ("home", "2 November 2005, 02.48 hrs", "time", "2005-11-01T20:48:00Z"),
    ("home", "Thursday, 19 MAY 2005", "day", "2005-05-19"),
    ("home", "19th May, 2005", None, "2005-05-19"),
    ("home", "2005 மே 19", "day", "2005-05-19"),
    ("home", "2005 මැයි 19", "day", "2005-05-19"),
    ("home", "2005 අප්‍රේල් 19", "day", "2005-04-19"),
    ("home", "May 2005", "day", "2005-05"),
    ("home", "05/2005", None, "2005-05"),
    ("home", "c. 1987", None, "1987"),
    ("home", "Year 1987", "year", "1987"),
    ("home", "1987.", "day", "1987"),
    ("home", "2013-05-13", "year", "2013"),
    ("home", "2013-05-13T23:30:00Z", "day", "2013-05-13"),
    ("home", "2013-05-13T23:30:00.123456Z", "time", "2013-05-13T23:30:00Z"),
    ("home", "20130513T233000Z", None, "2013-05-13T23:30:00Z"),
    ("home", "2013-05-13T23:30:00+05:30[Asia/Colombo]", None, "2013-05-13T18:00:00Z"),
    ("home", "Mon, 13 May 2013 23:30:00 +0530", None, "2013-05-13T18:00:00Z"),
    ("home", "2013-05-13 12:00:00 America/New_York", None, "2013-05-13T16:00:00Z"),
    ("home", "2013-05-13 12:00:00 Nowhere/Land", None, "none"),
    ("us", "2013-03-10 02:30:00", "time", "2013-03-10T07:30:00Z"),  # skipped: the offset before the change
    ("us", "2013-11-03 01:30:00", "time", "2013-11-03T05:30:00Z"),  # twice: the earlier instant
    ("home", "1996-05-24 12:00:00", "time", "1996-05-24T06:30:00Z"),
    ("home", "2000-05-24 12:00:00", "time", "2000-05-24T06:00:00Z"),
    ("us", "05/13/2013 12:05 AM", None, "2013-05-13T04:05:00Z"),
    ("home", "13/05/2013 13:05 PM", None, "none"),
    ("home", "1368487800", None, "2013-05-13T23:30:00Z"),
    ("home", "1368487800123", "day", "2013-05-13"),
    ("home", "", "day", "none"),
    ("home", "pending", None, "none"),
    ("home", "0000-00-00", "year", "none"),
    ("home", "2013-05-13T25:00", None, "none"),
    ("unknown", "2013-05-13 12:00:00", None, "none"),
    (None, "2013-05-13", None, "2013-05-13"),
    ("home", None, "day", None),
    ("home", "x" * 100_000, None, "none"),
]


def sources(spark):
    return spark.createDataFrame([("home", "Asia/Colombo", "dmy"), ("home", "Asia/Colombo", "dmy"), ("us", "America/New_York", "mdy"), (None, "UTC", "dmy")], "source string, home_zone string, date_order string")


def test_writings(spark):
    rows = [(i, s, d, p, "x", "y", "z") for i, (s, d, p, _) in enumerate(CASES)]
    norms = listing_norms(spark.createDataFrame(rows, LISTING), sources(spark))
    assert set(LISTING.replace(",", "").split()[::2]) < set(norms.columns)
    got = {r.id: r.norm for r in norms.collect()}
    assert {CASES[i][:3]: n for i, n in got.items()} == {c[:3]: c[3] for c in CASES}


def test_empty_and_session_zone(spark):
    empty = spark.createDataFrame([], LISTING)
    assert listing_norms(empty, sources(spark)).count() == 0
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([(1, "home", "2013-05-13 00:30:00", None, "", "", "")], LISTING)
        assert listing_norms(row, sources(spark)).first().norm == "2013-05-12T19:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
