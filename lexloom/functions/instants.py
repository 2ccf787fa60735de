"""Dates and moments in mixed writings, brought to one form.

Every writing is one branch of a single regular expression. One pass of it rewrites a text into its components, calendar
ranges are checked by arithmetic, and moments are put together from day numbers, all in built-in expressions.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.keys import SPACES

#: The names of the months, January first, in English, Sinhala and Tamil; English ones may be cut to three letters.
MONTHS = [
    ["january", "ජනවාරි", "ஜனவரி"],
    ["february", "පෙබරවාරි", "பெப்ரவரி", "பிப்ரவரி"],
    ["march", "මාර්තු", "மார்ச்"],
    ["april", "අප්රේල්", "ஏப்ரல்"],
    ["may", "මැයි", "மே"],
    ["june", "ජූනි", "ஜூன்"],
    ["july", "ජූලි", "ஜூலை"],
    ["august", "අගෝස්තු", "ஆகஸ்ட்"],
    ["september", "සැප්තැම්බර්", "செப்டம்பர்", "செப்டெம்பர்"],
    ["october", "ඔක්තෝබර්", "அக்டோபர்"],
    ["november", "නොවැම්බර්", "நவம்பர்"],
    ["december", "දෙසැම්බර්", "டிசம்பர்"],
]
#: Two-digit years lie between these.
FIRST_YEAR, LAST_YEAR = 1948, 2026
#: Bare numbers from here on are milliseconds, below seconds: as seconds it is the year 5138, as milliseconds 1973.
MILLISECONDS_FROM = 100_000_000_000

_DAY_OF_WEEK = r"(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,?\s+)?"
_MONTH = r"[\p{L}\p{M}]{2,}"
_OFFSET = r"z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}"
_ZONE = r"[a-z_]+(?:/[a-z0-9_+-]+)+"
_CLOCK = r"(?<H>[0-9]{1,2})[:.](?<M>[0-9]{2})(?:[:.](?<S>[0-9]{2})(?:[.,][0-9]{1,9})?)?"


def _clock(i: int) -> str:
    return _CLOCK.replace("<H>", f"<h{i}>").replace("<M>", f"<m{i}>").replace("<S>", f"<s{i}>") + rf"(?:\s*(?<half{i}>[ap])\.?m\.?(?![a-z])|\s*(?:hours|hrs?|h)\.?(?![a-z]))?(?:\s*(?<off{i}>{_OFFSET}))?(?:\s*\[?(?<zone{i}>{_ZONE})\]?)?"


#: The branches: name of each group with a number for the branch. d, mo, mon and y are day, month in digits, month in letters
#: and year; p and q are two numbers whose order the source tells; h, m, s, half, off and zone the time; n a count since 1970.
BRANCHES = [
    rf"(?<y1>[0-9]{{4}})(?<sep1>[-/.])(?<mo1>[0-9]{{1,2}})\k<sep1>(?<d1>[0-9]{{1,2}})(?:(?:t|,?\s+){_clock(1)})?",
    rf"(?<y2>[0-9]{{4}})(?<mo2>[0-9]{{2}})(?<d2>[0-9]{{2}})(?:t?(?<h2>[0-9]{{2}})(?<m2>[0-9]{{2}})(?<s2>[0-9]{{2}})?(?:[.,][0-9]+)?(?<off2>z|[+-][0-9]{{2}}:?[0-9]{{2}}))?",
    rf"(?<p3>[0-9]{{1,2}})(?<sep3>[-/.])(?<q3>[0-9]{{1,2}})\k<sep3>(?<y3>[0-9]{{4}}|[0-9]{{2}})(?:,?\s+{_clock(3)})?",
    rf"{_DAY_OF_WEEK}(?<d4>[0-9]{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[\s-]+(?<mon4>{_MONTH})\.?,?[\s-]+(?<y4>[0-9]{{4}}|[0-9]{{2}})(?:,?\s+{_clock(4)})?",
    rf"{_DAY_OF_WEEK}(?<mon5>{_MONTH})\.?\s+(?<d5>[0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y5>[0-9]{{4}})(?:,?\s+{_clock(5)})?",
    rf"(?<y6>[0-9]{{4}})[\s-]+(?<mon6>{_MONTH})\.?[\s-]+(?<d6>[0-9]{{1,2}})(?:,?\s+{_clock(6)})?",
    r"(?<y7>[0-9]{4})[-/.](?<mo7>[0-9]{1,2})",
    r"(?<mo8>[0-9]{1,2})[-/.](?<y8>[0-9]{4})",
    rf"(?<mon9>{_MONTH})\.?,?[\s-]+(?<y9>[0-9]{{4}})",
    r"(?:c\.?|ca\.?|circa|about|year|in)?\s*(?<y10>[0-9]{4})\.?",
    r"(?<n11>[0-9]{9,18})",
]
#: Components in the order of the rewritten text.
PARTS = ["y", "mo", "mon", "d", "p", "q", "h", "m", "s", "half", "off", "zone", "n"]


def _pattern() -> tuple[str, str]:
    body = "|".join(BRANCHES)
    rewrite = "\u0001".join("".join("${" + f"{part}{i}" + "}" for i in range(1, len(BRANCHES) + 1) if f"(?<{part}{i}>" in body) for part in PARTS)
    # A year in words ("year 1999") would pass for a month in letters, so that branch comes before the months.
    order = [*BRANCHES[:8], BRANCHES[9], BRANCHES[8], BRANCHES[10]]
    return "^(?:" + "|".join(order) + ")$", "\u0002" + rewrite


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic with the year beginning in March."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    shifted = F.pmod(month + 9, F.lit(12))
    of_year = F.floor((shifted * 153 + 2) / 5) + day - 1
    return y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + of_year - 719468


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _digits(number: Column, width: int = 2) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 UTC as `YYYY-MM-DDTHH:MM:SSZ`, from the day's number and the rest, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(day, F.lit("T"), _digits(F.floor(rest / 3600)), F.lit(":"), _digits(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), _digits(F.pmod(rest, F.lit(60))), F.lit("Z"))


def _month_number(word: Column) -> Column:
    """Each writing has a dozen names in a row of one array, so that a name's place tells its month; null where there is none."""
    most = max(map(len, MONTHS))
    rows = [[names[k] if k < len(names) else "" for names in MONTHS] for k in range(most)] + [[names[0][:3] for names in MONTHS], ["sept" if names[0] == "september" else "" for names in MONTHS]]
    place = F.array_position(F.array(*[F.lit(n) for row in rows for n in row]), word)
    return F.when((place > 0) & (word != ""), (F.pmod(place - 1, F.lit(12)) + 1).cast("int"))


def kept(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: one row made of each, which the optimizer neither copies into later expressions nor pushes filters through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _offset_seconds(text: Column) -> Column:
    digits = F.regexp_replace(F.substring(text, 2, 10), ":", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int")), F.lit(0))
    return F.when(text.isin("z", "utc", "gmt"), 0).when(text.startswith("-"), -minutes * 60).otherwise(minutes * 60)


def with_norms(df: DataFrame, text: str, precision: str, home_zone: str, date_order: str, to: str = "norm") -> DataFrame:
    """Adds `to`: the date in column text as `YYYY`, `YYYY-MM`, `YYYY-MM-DD`, `YYYY-MM-DDTHH:MM:SSZ` or `none`.

    The precision is the coarser of what is written and what column precision says (year, day, time; null or another word
    says nothing). home_zone holds where the text names no zone, date_order (`dmy`, `mdy`; null is dmy) where day and month
    are digits with the year last. A null text gives null; blank, wordless or impossible dates, times and zones give `none`.
    """
    pattern, rewrite = _pattern()
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), "[\\x{200b}-\\x{200d}\\x{feff}]", ""), SPACES, " "), "^ +| +$", ""))
    mark = "_d"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    col = lambda name: F.col(f"{mark}_{name}")
    spark = df.sparkSession
    zones = spark.createDataFrame([(z.lower(), z) for z in sorted(available_timezones())], f"{mark}_zone string, {mark}_rules string")
    out = kept(df, **{f"{mark}_part": F.split(F.regexp_replace(cleaned, pattern, rewrite), "\u0001")})
    at = {name: F.get(col("part"), F.lit(i)) for i, name in enumerate(PARTS)}
    number = lambda name: at[name].try_cast("int")
    year = F.regexp_replace(at["y"], "\u0002", "")
    first_is_month = F.coalesce(F.lower(F.col(date_order)) == "mdy", F.lit(False))
    short = F.when(year.try_cast("int") + 1900 >= FIRST_YEAR, year.try_cast("int") + 1900).when(year.try_cast("int") + 2000 <= LAST_YEAR, year.try_cast("int") + 2000)
    hour = F.when(at["half"] == "", number("h")).when(number("h").between(1, 12), F.pmod(number("h"), F.lit(12)) + F.when(at["half"] == "p", 12).otherwise(0))
    read = {
        "parsed": F.size(col("part")) == len(PARTS),
        "year": F.when(F.length(year) == 2, short).otherwise(year.try_cast("int")),
        "month": F.coalesce(number("mo"), _month_number(at["mon"]), F.when(first_is_month, number("p")).otherwise(number("q"))),
        "day": F.coalesce(number("d"), F.when(first_is_month, number("q")).otherwise(number("p"))),
        "has_month": (at["mo"] != "") | (at["mon"] != "") | (at["p"] != ""),
        "has_day": (at["d"] != "") | (at["p"] != ""),
        "has_time": at["h"] != "",
        "hour": hour,
        "minute": number("m"),
        "second": F.coalesce(number("s"), F.lit(0)),
        "offset": at["off"],
        "count": at["n"].try_cast("long"),
        "zone": F.coalesce(F.nullif(at["zone"], F.lit("")), F.lower(F.col(home_zone))),
        "said": F.lower(F.col(precision)),
    }
    out = kept(out, **{f"{mark}_{n}": e for n, e in read.items()}).drop(f"{mark}_part")
    out = out.join(F.broadcast(zones.withColumnRenamed(f"{mark}_zone", f"{mark}_name")), col("zone") == col("name"), "left")
    dated = (col("year") >= 1) & (~col("has_month") | col("month").between(1, 12)) & (~col("has_day") | col("day").between(1, days_in_month(col("year"), col("month"))))
    timed = ~col("has_time") | (col("hour").between(0, 23) & col("minute").between(0, 59) & col("second").between(0, 59))
    local = days_from_civil(col("year"), col("month"), col("day")) * 86400 + col("hour") * 3600 + col("minute") * 60 + col("second")
    out = kept(out, **{f"{mark}_valid": F.coalesce(col("parsed") & dated & timed, F.lit(False)), f"{mark}_local": local.cast("long")})
    instant = F.when(col("offset") != "", col("local") - _offset_seconds(col("offset"))).otherwise(F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(col("local")), col("rules"))))
    counted = F.when(col("count") >= MILLISECONDS_FROM, F.floor(col("count") / 1000)).otherwise(col("count"))
    seconds = F.when(col("count").isNotNull(), F.when(counted < 253_402_300_800, counted)).when(col("valid") & col("has_time"), instant).cast("long")
    out = kept(out, **{f"{mark}_seconds": seconds})
    day = F.concat(_digits(col("year"), 4), F.when(col("has_month"), F.concat(F.lit("-"), _digits(col("month")))).otherwise(""), F.when(col("has_day"), F.concat(F.lit("-"), _digits(col("day")))).otherwise(""))
    whole = utc_text(col("seconds"))
    norm = (
        F.when(F.col(text).isNull(), None)
        .when(col("count").isNotNull(), F.substring(whole, F.lit(1), F.when(col("said") == "year", 4).when(col("said") == "day", 10).otherwise(20)))
        .when(~col("valid"), "none")
        .when(col("said") == "year", _digits(col("year"), 4))
        .when(~col("has_time") | (col("said") == "day"), day)
        .otherwise(whole)
    )
    return kept(out, **{f"{mark}_norm": F.when(F.col(text).isNotNull(), F.coalesce(norm, F.lit("none")))}).select(*df.columns, col("norm").alias(to))


def listing_norms(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """listings with `norm`, the one form of their date, by their source's zone and order of day and month.

    sources is a small reference table with one row a source; a repeated source counts by its smallest zone and order, and a
    source that has no row is taken to write dmy and to name every zone: its moments without a zone are `none`.
    """
    mark = "_of_source"
    while any(c.endswith(mark) for c in listings.columns):
        mark += "_"
    source, zone, order = f"source{mark}", f"zone{mark}", f"order{mark}"
    rules = sources.where("source is not null").groupBy(F.col("source").alias(source)).agg(F.min("home_zone").alias(zone), F.min("date_order").alias(order))
    joined = listings.join(rules, F.col("source") == F.col(source), "left")
    return with_norms(joined, "date", "date_precision", zone, order).drop(source, zone, order)
