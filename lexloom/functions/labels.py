"""Labels and names as people write and read them: kinds of provisions, keys of titles, display forms, numbers in words, ranges of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinals in words.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
COURTS = {"ca": "Court of Appeal", "sc": "Supreme Court"}


def ordinal(word: Column) -> Column:
    """The number of an ordinal in words, or in digits with its ending; null for other words."""
    place = F.array_position(F.array(*[F.lit(w) for w in ORDINALS]), F.lower(F.trim(word))).cast("int")
    return F.coalesce(F.nullif(place, F.lit(0)), F.regexp_extract(F.lower(word), r"^\s*([0-9]+)(?:st|nd|rd|th)\s*$", 1).try_cast("int"))


def schedule_name(label: Column) -> Column:
    """A schedule's name in one spelling, `First Schedule`; null for what is none."""
    tidy = F.trim(F.regexp_replace(label, r"\s+", " "))
    return F.when(tidy.rlike("(?i)schedule"), F.initcap(tidy))


def provision_kind(label: Column) -> Column:
    """What a link points at by its label: whole, schedule, part, section or other."""
    tidy = F.trim(label)
    return F.when(label.isNull() | (tidy == ""), "whole").when(tidy.rlike("(?i)schedule"), "schedule").when(tidy.rlike("(?i)^(part|chapter) "), "part").when(tidy.rlike(r"^[0-9]+[A-Za-z]*$"), "section").otherwise("other")


def title_key(title: Column) -> Column:
    """A title for lookup: capitals and digits, one blank between."""
    return F.trim(F.regexp_replace(F.upper(title), "[^A-Z0-9]+", " "))


def shown_key(key: Column) -> Column:
    """A document's key as it is cited: `Act, No. 9 of 2023`, `Gazette No. 1234/05`, `Chapter 12`, `Court of Appeal, 3-2013`."""
    family, number = F.split_part(key, F.lit(":"), F.lit(1)), F.split_part(key, F.lit(":"), F.lit(2))
    numbered = F.concat(F.initcap(family), F.lit(", No. "), F.split_part(number, F.lit("/"), F.lit(1)), F.lit(" of "), F.split_part(number, F.lit("/"), F.lit(2)))
    out = F.when(family.isin("act", "law", "ordinance") & number.contains("/"), numbered).when(family == "gazette", F.concat(F.lit("Gazette No. "), number)).when(family.isin("cap", "cap1956"), F.concat(F.lit("Chapter "), number))
    for short, name in COURTS.items():
        out = out.when(family == short, F.concat(F.lit(f"{name}, "), F.upper(number)))
    return out.otherwise(F.initcap(key))


def page_range(text: Column, most: int) -> Column:
    """(first, last) of a range of pages such as `3-6` or `4`, within 1 and the last page; null for others and those turned round."""
    first = F.regexp_extract(text, r"^\s*([0-9]{1,6})\s*(?:[-–]\s*([0-9]{1,6}))?\s*$", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(text, r"^\s*([0-9]{1,6})\s*[-–]\s*([0-9]{1,6})\s*$", 2).try_cast("int"), first)
    ok = (first >= 1) & (first <= last) & (first <= most)
    return F.when(ok, F.struct(first.alias("first"), F.least(last, F.lit(most)).alias("last")))


def odd_share(text: Column) -> Column:
    """The share of a text's letters that are accented Latin ones, as fonts without Unicode leave them; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.round(F.regexp_count(text, F.lit(r"[\x{c0}-\x{24f}]")) / letters, 6))


def joined_lines(text: Column) -> Column:
    """Lines as one, a word broken at a line's end put together."""
    return F.regexp_replace(F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2"), r"[ \t]*\n[ \t]*", " ")


def open_quotes(text: Column) -> Column:
    """How many quotations a text leaves open: what comes next stands in one if it is more than none."""
    return F.regexp_count(text, F.lit("“")) - F.regexp_count(text, F.lit("”"))


def long_title(text: Column, lines: int = 40) -> Column:
    """The long title among a text's first lines; null if there is none."""
    start = F.substring_index(text, "\n", lines)
    return F.nullif(F.regexp_extract(start, r"(?m)^(An (?:Act|Ordinance|Law|Order) to [^\n]*|Regulations to [^\n]*)", 1), F.lit(""))


def near_pairs(text: Column, first: str, second: str, most: int = 12) -> Column:
    """Pairs of two patterns in one text, the second beginning at most so many characters behind the first: `first~second` each."""
    found = F.regexp_extract_all(text, F.lit(f"({first})[^\\n]{{0,{most}}}?({second})"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, f"^({first})[^\\n]*?({second})$", "$1~$2"))
