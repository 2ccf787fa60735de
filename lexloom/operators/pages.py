"""Pages as blocks: running titles, columns and gutters, lines put together from cells, spreads, margin notes, tables and pages of HTML.

A block is a row with its document, page, place (y, x) and text. All of it is windows and aggregates within a page or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_of(df: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, page, n, text): the lines of texts that are pages of a document, with their number as place; blank ones are none."""
    return df.where(F.col(text).isNotNull()).select(key, page, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.trim("line") != "").withColumnRenamed("line", "text")


def bare(text: Column) -> Column:
    """A line for comparison with others: lower case, letters only, so that page numbers beside a title don't matter."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def running_titles(blocks: DataFrame, key: str, page: str, share: float = 0.25, least: int = 2) -> DataFrame:
    """(key, title, pages): lines that stand on so many pages of a document and on such a share of them: its furniture."""
    lines = blocks.select(key, page, bare(F.col("text")).alias("title")).where(F.length("title") > 3).distinct()
    per = lines.groupBy(key, "title").agg(F.count("*").alias("pages"))
    every = blocks.groupBy(key).agg(F.count_distinct(page).alias("all"))
    return per.join(every, key).where((F.col("pages") >= least) & (F.col("pages") >= share * F.col("all"))).select(key, "title", "pages")


def words_of(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, word, left, right): the words of each line with the columns of characters that they fill."""
    parts = F.split("text", " ")
    ends = lambda i: F.length(F.call_function("substring_index", F.col("text"), F.lit(" "), i + 1))
    place = F.transform(parts, lambda w, i: F.struct(w.alias("word"), (ends(i) - F.length(w)).alias("left")))
    return blocks.select(*by, "n", F.explode(place).alias("w")).where("w.word <> ''").select(*by, "n", "w.word", "w.left", (F.col("w.left") + F.length("w.word")).alias("right"))


def gutters(words: DataFrame, by: list[str], step: int = 4) -> DataFrame:
    """(by, gutter, crossed): of each page the place in its middle half that the fewest words cross, of equals the one nearest to the middle.

    Places are tried every `step` columns; a word meets only those within it, so that what is counted is words and not words by places.
    """
    size = words.groupBy(*by).agg(F.max("right").alias("width")).where(F.col("width") >= 2 * step)
    first, last = F.ceil(F.col("width") / 4 / step), F.floor(F.col("width") * 3 / 4 / step)
    tried = size.where(first <= last).select(*by, "width", F.explode(F.sequence(first, last)).alias("_p"))
    inside = F.sequence(F.floor(F.col("left") / step) + 1, F.ceil(F.col("right") / step) - 1)
    met = words.where(F.floor(F.col("left") / step) + 1 <= F.ceil(F.col("right") / step) - 1).select(*by, F.explode(inside).alias("_p")).groupBy(*by, "_p").agg(F.count("*").alias("crossed"))
    best = tried.join(met, [*by, "_p"], "left").groupBy(*by).agg(F.min(F.struct(F.coalesce("crossed", F.lit(0)).alias("c"), F.abs(2 * step * F.col("_p") - F.col("width")).alias("off"), F.col("_p"))).alias("b"))
    return best.select(*by, (F.col("b._p") * step).cast("int").alias("gutter"), F.col("b.c").alias("crossed"))


def spread_halves(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, half, words): the words of two printed pages on one image, by the half in which their middle lies."""
    width = F.max("right").over(Window.partitionBy(*by))
    half = F.when((F.col("left") + F.col("right")) / 2 < width / 2, "left").otherwise("right")
    return words.withColumn("half", half).groupBy(*by, "half").agg(F.count("*").alias("words"))


def lines_from_cells(cells: DataFrame, page: str, y: str, x: str, text: str, gap: float) -> DataFrame:
    """(page, line, top, text): cells whose height differs by no more than the gap from the one before are one line, read from left to right."""
    down = Window.partitionBy(page).orderBy(y, x)
    fresh = F.when(F.coalesce(F.col(y) - F.lag(y).over(down) > gap, F.lit(True)), 1).otherwise(0)
    placed = cells.withColumn("_f", fresh).withColumn("line", F.sum("_f").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = placed.groupBy(page, "line").agg(F.min(y).alias("top"), F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).cast("string").alias("t")))).alias("c"))
    return rows.select(page, F.col("line").cast("int").alias("line"), "top", F.array_join(F.transform("c", lambda c: c["t"]), " ").alias("text"))


def notes_to_bodies(notes: DataFrame, bodies: DataFrame, page: str, reach: int) -> DataFrame:
    """(page, note, body): each margin note with the nearest block of its page no farther than the reach, the higher of equals."""
    a = notes.select(page, F.col("n").alias("note"))
    b = bodies.select(page, F.col("n").alias("body"))
    # Notes meet blocks by their height alone, an equal key each: no note meets all blocks of its page.
    wanted = a.withColumn("body", F.explode(F.sequence(F.col("note") - reach, F.col("note") + reach)))
    near = wanted.join(b.distinct(), [page, "body"])
    return near.groupBy(page, "note").agg(F.min(F.struct(F.abs(F.col("note") - F.col("body")).alias("d"), F.col("body").alias("b"))).alias("m")).select(page, "note", F.col("m.b").alias("body"))


def table_cells(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, column, cell): the cells of rows of tables, whose columns are parted by bars."""
    cells = F.transform(F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return blocks.where(F.col("text").contains("|")).select(*by, "n", F.posexplode(cells).alias("column", "cell"))


def rows_to_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): a table's cells as lines with bars, empty cells left out."""
    rows = cells.where("cell <> ''").groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("column", "cell"))).alias("c")).select(*by, "n", F.array_join(F.transform("c", lambda c: c["cell"]), " | ").alias("row"))
    tables = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("r"))
    return tables.select(*by, F.array_join(F.transform("r", lambda r: r["row"]), "\n").alias("text"))


def html_rows(html: Column, widest_note: int = 120) -> Column:
    """The rows of an HTML table as (note, text): a first cell that is no wider than that is a note, and else belongs to the text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    width = lambda r: F.regexp_extract(r, r'(?is)<td[^>]*width="?([0-9]+)', 1).try_cast("int")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), "&amp;", "&"))
    has_note = lambda r: F.coalesce(width(r) <= widest_note, F.lit(False))
    text = lambda r: F.array_join(F.transform(F.when(has_note(r), F.slice(cells(r), 2, 100)).otherwise(cells(r)), plain), " ")
    return F.transform(rows, lambda r: F.struct(F.when(has_note(r), plain(cells(r)[0])).alias("note"), text(r).alias("text")))


def data_rows(html: Column, names: list[str]) -> Column:
    """The elements of a page of HTML that carry their fields as data attributes, a struct of the given fields each."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<tr\s+(data-[^>]*)>"), F.lit(1))
    value = lambda t, n: F.nullif(F.replace(F.replace(F.regexp_extract(t, rf'data-{n}="([^"]*)"', 1), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit(""))
    return F.transform(tags, lambda t: F.struct(*[value(t, n).alias(n) for n in names]))


def paged(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """rows with `page` and `place`: the rows of a text without pages, set on pages of so many rows each."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / most).cast("int") + 1).withColumn("place", (F.col("_n") % most).cast("int")).drop("_n")
