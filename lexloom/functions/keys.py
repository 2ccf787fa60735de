"""Document keys: the plain spelling, and the split of any key into a family and a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind; Java's \\s alone is ASCII.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def plain_key(key: Column) -> Column:
    """Lower case, no blanks, no leading zeros; a gazette's second number keeps at least two digits. Null stays null."""
    tight = F.lower(F.regexp_replace(key, SPACES, ""))
    bare = F.regexp_replace(tight, "(^|[^0-9])0+([0-9])", "$1$2")
    one_digit = bare.rlike("^gazette:[0-9]+/[0-9]$")
    return F.when(one_digit, F.regexp_replace(bare, "/", "/0")).otherwise(bare)


def plain_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(label, "^" + SPACES, ""), SPACES + "$", ""))


def tidy(word: Column) -> Column:
    """Letter case and outer blanks aside, as for link kinds and chosen_by."""
    return plain_label(word)
