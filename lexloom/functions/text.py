"""Text functions: built-in expressions where the rule is one, Arrow functions where it is a scan."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest piece of a text.
MOST = 1500
BLOCK_TAGS = "p|div|br|tr|li|h[1-6]|table|ul|ol|section|article|blockquote"


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments dropped, block tags as line breaks, other tags dropped, five entities read, blank runs one."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends, none before a full stop, comma, semicolon or colon."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" ([.,;:])", "$1"))


def script_share(text: Column, first: str, last: str, least: int = 200) -> Column:
    """The share of a text's letters that lie between two characters; null under so many letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters >= least, F.round(F.regexp_count(text, F.lit(f"(?=\\p{{L}})[{first}-{last}]")) / letters, 6))


def short_name(name: Column) -> Column:
    """A law's name for comparison: lower case, without chapter, number, article and the words for its kind."""
    n = F.regexp_replace(F.lower(name), r"\([^)]*\)|,? *no\. *\d+( of \d{4})?", " ")
    n = F.regexp_replace(F.regexp_replace(n, r"[’']s\b", ""), r"^ *the ", "")
    n = F.regexp_replace(n, r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"( (act|law|ordinance|code))+ *$", ""), r" +", " "))


def gazette_title(title: Column, most: int = 100) -> Column:
    """A gazette's subject: without the number at the end, cut at a word's end with an ellipsis."""
    subject = F.trim(F.regexp_replace(title, r" *- *Gazette No\..*$", ""))
    cut = F.regexp_replace(F.substring(subject, 1, most), r" +[^ ]*$", "")
    return F.when(F.length(subject) <= most, subject).otherwise(F.concat(cut, F.lit("…")))


def party_names(title: Column) -> tuple[Column, Column, Column]:
    """First party, second party and case number of a judgment's title."""
    pattern = r"^(.*?) v\. (.*?), ([A-Z][A-Z-]*-\d+-\d{4})\.?$"
    return tuple(F.regexp_extract(title, pattern, i) for i in (1, 2, 3))


def natural_order(label: Column) -> Column:
    """Labels such as 9, 12A and 12B in the order of number and letters."""
    return F.struct(F.regexp_extract(label, r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_extract(label, r"^\d*(.*)$", 1).alias("rest"))


def rough_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def roman(number: Column) -> Column:
    """The value of a numeral in capitals I, V, X, L, C, D, M; null for other texts."""
    value = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    signs = F.transform(F.split(number, ""), lambda c: F.try_element_at(value, c))
    total = F.aggregate(signs, F.struct(F.lit(0).alias("sum"), F.lit(1001).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(v > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")))
    return F.when(number.rlike("^[IVXLCDM]+$"), total["sum"])


def roman_of(numeral: str) -> int:
    """The value of a numeral in capitals; signs that are none count 0."""
    values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.get(c, 0) for c in numeral]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True))


#: Where a long text may be cut, the best first: after a line, after a sentence or clause, at a blank.
CUTS = (re.compile(r"\n"), re.compile(r"(?<=[.;]) "), re.compile(r" "))


def split_long(text: str, most: int = MOST) -> list[str]:
    """Pieces of at most so many characters, filled as far as whole lines go.

    A line that is longer than that is cut for itself: behind the last sentence or clause past a third of the limit, else at the
    last blank, else hard. All places are found in one pass each, and looked up by bisection.
    """
    if len(text) <= most:
        return [text]
    lines, clauses, blanks = ([m.start() for m in p.finditer(text)] for p in CUTS)

    def last(places: list[int], low: int, high: int) -> int | None:
        """The last place within low < place <= high."""
        at = bisect_right(places, high) - 1
        return places[at] if at >= 0 and places[at] > low else None

    pieces: list[str] = []  # what must stay together: a line or a part of one
    for start, end in zip([0, *(n + 1 for n in lines)], [*lines, len(text)], strict=True):
        while end - start > most:
            clause = last(clauses, start, start + most - 2)
            cut = clause if clause is not None and clause - start > most // 3 + 1 else last(blanks, start, start + most - 1) or start + most
            pieces.append(text[start:cut].strip())
            start = cut + len(text[cut:end]) - len(text[cut:end].lstrip())
        pieces.append(text[start:end])
    out: list[list[str]] = []
    room = 0
    for piece in pieces:
        if out and len(piece) + 1 <= room:
            out[-1].append(piece)
            room -= len(piece) + 1
        elif piece:
            out.append([piece])
            room = most - len(piece)
    return ["\n".join(own) for own in out]


def pack_paragraphs(text: str, most: int = MOST) -> list[str]:
    """Paragraphs packed into pieces; a long one by its sentences, a long sentence at its last blank within the limit, or hard."""
    out: list[str] = []
    now = ""
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if len(paragraph) > most:
            if now:
                out.append(now)
                now = ""
            for sentence in re.split(r"(?<=[.;:?!])\s+", paragraph):
                while len(sentence) > most:
                    blanks = [m.start() for m in re.finditer(r"\s", sentence[: most + 1])]
                    cut = blanks[-1] if blanks and blanks[-1] else most
                    if now:
                        out.append(now)
                        now = ""
                    out.append(sentence[:cut].strip())
                    sentence = sentence[cut:].strip()
                if now and len(now) + 1 + len(sentence) > most:
                    out.append(now)
                    now = ""
                now = f"{now} {sentence}".strip()
        elif now and len(now) + 2 + len(paragraph) > most:
            out.append(now)
            now = paragraph
        else:
            now = f"{now}\n\n{paragraph}" if now else paragraph
    if now:
        out.append(now)
    return out


def expand_labels(text: str) -> list[str]:
    """Labels named by a list such as `65 to 68, 70A`: ranges of at most 200 numbers, and of letters without I and O."""
    out: list[str] = []
    for part in re.split(r"\s*(?:,|\band\b|\bor\b|&)\s*", text.strip()):
        m = re.fullmatch(r"(\d+)([A-Z]?)\s*(?:to|-|–)\s*(\d+)([A-Z]?)", part)
        if m:
            a, x, b, y = int(m[1]), m[2], int(m[3]), m[4]
            if a == b and x and y:
                out += [f"{a}{c}" for c in map(chr, range(ord(x), ord(y) + 1)) if c not in "IO"]
            elif 0 <= b - a <= 200:
                out += [f"{a}{x}", *map(str, range(a + 1, b)), f"{b}{y}"] if b > a else [f"{a}{x}"]
            else:
                out += [m[1] + x, m[3] + y]
        elif re.fullmatch(r"\d+[A-Z]{0,3}", part):
            out.append(part)
    return list(dict.fromkeys(out))


def arrow_strings(f):
    """An Arrow function from a text to an array of texts; made where a session is, never at import, for workers import this too."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL: each as a function to an array, and split_long as rows, `FROM t, LATERAL pieces_of(t.text, 1500)`."""
    for f in (split_long, pack_paragraphs, expand_labels):
        spark.udf.register(f.__name__, arrow_strings(f))

    class Pieces:
        def eval(self, text: str, most: int):
            for n, piece in enumerate(split_long(text, most) if text is not None else (), 1):
                yield n, piece

    spark.udtf.register("pieces_of", F.udtf(Pieces, returnType="n int, piece string"))


def gaps(labels: Column) -> Column:
    """The numbers from 1 to the largest that a set of numbered labels lacks; an empty set lacks none."""
    numbers = F.filter(F.transform(labels, lambda x: F.regexp_extract(x, r"^(\d{1,4})", 1).try_cast("int")), lambda n: n.isNotNull())
    return F.when(F.array_max(numbers) > 0, F.array_except(F.sequence(F.lit(1), F.greatest(F.array_max(numbers), F.lit(1))), numbers)).otherwise(F.array().cast("array<int>"))


def in_parts(df: DataFrame, text: str, pieces: Column) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select("*", F.posexplode(pieces).alias("n", "piece"))
