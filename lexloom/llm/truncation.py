"""Texts cut off by field limits.

A text that is a strict prefix of longer copies, one of which goes on inside a sentence or word, was cut. Texts are told apart by
a hash; hashes of their beginnings at a ladder of lengths leave only those that can be a prefix or have one, and only these are
sorted, each text once however many copies it has. In the order of texts the prefixes of a text are those on a stack, so that
every longer copy is met and no pairs are made. How a text ends tells of the cuts that have no longer copy: a sign of the cut,
a sentence without its end, or a closing line after which nothing is due. Last lines that neither end a sentence nor have the
form of a closing line are counted over the corpus: what ends many documents closes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import HOT_ROWS, spread_join
from lexloom.tables import cut, drop

#: Signs of a cut at the end: dots, an ellipsis alone or in brackets, a broken entity, a broken character, words for "goes on".
SIGNS = re.compile(r"(?:\s*(?:\.{2,}|…|\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|&#?\w{0,8}|�+|[\[(](?:continued|cont\.?|more|truncated|read more)[\])]?|\[))+$", re.IGNORECASE)
#: A sentence's end, with what may close after it.
ENDED = re.compile(r"(?:[.!?।])[\"'”’»)\]]*$")
#: A sentence can't end after these, though they end with a full stop; nor after the number that opens a paragraph.
ABBREVIATED = re.compile(r"(?:^|[\s(“\"'])(?:rs|nos?|vs?|ss?|pp?|para|paras|art|arts|cap|ch|chap|sec|reg|regs|vol|dr|mr|mrs|ms|hon|st|viz|cf|e\.g|i\.e|l\.d\.-b|l\.d)\.[\"'”’)\]]*$", re.IGNORECASE)
OPENER = re.compile(r"^\s*(?:\(?[0-9]{1,4}[A-Z]{0,2}[.)]|\([a-zA-Z]{1,5}\)|[ivxlc]+[.)])$", re.IGNORECASE)
#: The names of the months.
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Forms of closing lines: place and date, office, reference, price.
CLOSINGS = [
    re.compile(rf"^(?:[\w.' -]+,\s+)?(?:[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+[0-9]{{4}}|{MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}})$", re.IGNORECASE),
    re.compile(r"^(?:(?:Acting|Deputy|Hon\.?|His|Her|The)\s+)*(?:Minister|Ministry|Registrar|Secretary|Commissioner|Director|Chairman|Chairperson|President|Governor|Clerk|Speaker|Judge|Justice|Controller|Collector|Attorney|Solicitor|Surveyor|Chief|Magistrate|Prime)\b(?:[ ,-]+(?:(?:of|for|to|the|and|in)[ ]+)*[A-Z][\w'-]*)*$"),
    re.compile(r"^[A-Z][A-Za-z.&-]{0,12}(?:/[A-Za-z.-]+)*[\s/:.-]*(?:No\.?\s*)?[0-9]+(?:[/-][0-9A-Z]+)+$"),
    re.compile(r"^(?:price|postage|fee)\b[\s:.-]*(?:rs\.?|lkr|cts\.?)?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?(?:/[=-])?(?:\s*cents)?$", re.IGNORECASE),
]
#: A last line that ends at least this share of the documents, and documents of so many keys, closes them; the longest line that can.
CLOSING_SHARE, CLOSING_DOCUMENTS, CLOSING_CHARACTERS = 5e-4, 3, 80
#: Lengths at which beginnings are hashed, each twice the one before; a shorter text is looked up by itself.
LADDER = (32, 64, 128)
#: Characters by which texts are spread over tasks in their order, and those by which texts are that share so many with very many others.
ORDERED, ORDERED_HOT = 128, 2048


def closing_line(lines: list[str]) -> bool:
    """Whether the last line has the form of a closing line, or is a whole row of a table."""
    last = lines[-1].strip()
    if any(c.match(last) for c in CLOSINGS):
        return True
    for sign in ("|", "\t"):
        if sign in last:
            cells, before = last.split(sign), lines[-2].split(sign) if len(lines) > 1 else []
            if not cells[-1].strip():
                return len(before) in (0, len(cells)) or sign not in lines[-2]
            unit = re.search(r"[^\W\d_]+$", before[-1].strip()) if len(before) > 1 else None
            if len(before) > 1:
                return len(cells) == len(before) and (unit is None or cells[-1].strip().endswith(unit.group()))
            return len(cells) > 1
    return False


def ending(text: str, title: str | None) -> str:
    """How a text that isn't blank ends: `whole`, `title` (it is no more than that), `sign`, `word`, `open` (inside a sentence) or `line` (to be counted)."""
    text = text.rstrip()
    tail = text[-2000:]
    if SIGNS.search(tail):
        return "sign"
    lines = [x for x in tail.split("\n") if x.strip()]
    last = lines[-1].strip()
    if re.search(r"[^\W\d_][-¬­‐]$", last):
        return "word"
    if title and len(lines) == 1 and last == title.strip():
        return "title"
    if closing_line(lines):
        return "whole"
    if ENDED.search(last):
        return "open" if ABBREVIATED.search(last) or OPENER.match(last) else "whole"
    if title and re.sub(r"\W+", "", last.lower()) == re.sub(r"\W+", "", title.lower()):
        return "whole" if len(lines) > 1 or len(text) > len(tail) else "title"
    return "line" if len(lines) > 1 and len(last) <= CLOSING_CHARACTERS else "open"


def goes_on(core: str, after: str) -> bool:
    """Whether a longer copy, of which after is the next character, is inside a sentence or word where core ends."""
    bare = core.rstrip()
    if after == "\n" or "\n" in core[len(bare) :]:
        return False
    if after.isspace() or bare != core:
        return not ENDED.search(bare[-40:]) or bool(ABBREVIATED.search(bare[-40:]))
    return True


def look_at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each text ends, from its end and title; the other columns as they are."""
    for batch in batches:
        hows, lines = [], []
        for text, title in zip(batch.column("text").to_pylist(), batch.column("title").to_pylist(), strict=True):
            how = ending(text, title)
            hows.append(how)
            lines.append(text.rstrip().rpartition("\n")[2].strip() if how == "line" else None)
        kept = batch.drop_columns(["text", "title"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hows, pa.string()), pa.array(lines, pa.string())], names=[*kept.schema.names, "how", "last_line"])


def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct cores in order the verdicts `inside` of those that a longer one goes on from, and `open` those that may have more in the next task.

    The stack holds the cores that are prefixes of the present one, so it is never longer than that has characters.
    """
    stack: list[list] = []  # core, its id, whether a longer one goes on inside
    out: list[tuple] = []
    names = ["core_id", "core", "state"]

    def flush() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) if out else [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], names=names)

    for batch in batches:
        for core_id, core in zip(batch.column("core_id").to_pylist(), batch.column("core").to_pylist(), strict=True):
            while stack and not core.startswith(stack[-1][0]):
                stack.pop()
            for entry in stack:
                if not entry[2] and goes_on(entry[0], core[len(entry[0])]):
                    entry[2] = True
                    out.append((entry[1], None, "inside"))
            stack.append([core, core_id, False])
        yield flush()
    out += [(core_id, core, "open") for core, core_id, inside in stack if not inside]
    yield flush()


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of cores with one of the characters after them inside a sentence or word."""
    for batch in batches:
        on = [goes_on(c, a) for c, a in zip(batch.column("core").to_pylist(), batch.column("after").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("core_id").filter(pa.array(on, pa.bool_()))], names=["core_id"])


def trimmed(documents: DataFrame) -> DataFrame:
    """Documents with a text that isn't null or blank, with `whole`, the text without blanks at its end, and `core`, that without a sign of a cut."""
    # The ends of texts are looked at by themselves: a pattern tried at each place of a long text costs more than all else.
    whole = F.rtrim("text", F.lit(" \t\r\n\u00a0\u3000"))
    tail = F.substring(whole, -14, 14)
    sign = F.length(tail) - F.length(F.regexp_replace(tail, r"(?i)\s*(\.{2,}|…|\[(\.{2,}|…)\]|&#?\w{0,8}|�+|[-¬\x{ad}])$", ""))
    return documents.where(F.col("text").rlike(r"[^\s\x{a0}]")).withColumn("whole", whole).withColumn("core", F.substring(whole, F.lit(1), F.length(whole) - sign))


def prefixes(documents: DataFrame, cores: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """core_id of each core that is a strict prefix of another which goes on inside a sentence or word.

    documents has (doc_id, text), repeated or not; cores has of each, by doc_id and core_id (the hash of core), size (its characters), head
    (its first characters, as many as the least length of the ladder) and rungs (the hashes of its beginnings along the ladder).
    """
    spark = cores.sparkSession
    known = cores.select("core_id", "size", "head", "rungs").distinct()
    # Short cores: the beginnings of all texts at the lengths that short cores have, each with the character after it.
    short = known.where((F.col("size") > 0) & (F.col("size") < LADDER[0]))
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # fewer than the ladder's least length
    starts = [F.when(F.col("size") > n, F.struct(F.left("head", F.lit(n)).alias("core"), F.substring("head", n + 1, 1).alias("after"))) for n in sizes]
    begun = known.select(F.explode(F.array(*starts)).alias("s")).where("s is not null").select("s.*").distinct() if starts else None
    found = begun.join(short.select(F.col("head").alias("core"), "core_id"), "core").mapInArrow(followed, "core_id string") if starts else short.select("core_id").limit(0)
    # Others: only where a beginning at the last rung below a core's own length is shared by another that differs.
    rungs = cores.where(F.col("size") >= LADDER[0]).select("doc_id", "core_id", "size", F.posexplode("rungs").alias("rung", "hash")).where("hash is not null")
    last = F.col("rung") == len(LADDER) - 1
    shared = rungs.groupBy("rung", "hash").agg(F.min("core_id").alias("a"), F.max("core_id").alias("b"), F.min("size").alias("least")).where("a <> b").where(last | (F.col("least") < F.element_at(F.array(*[F.lit(2 * n) for n in LADDER]), F.col("rung") + 1)))
    shared = cut(shared.select("rung", "hash"))
    wanted = cut(rungs.join(shared, ["rung", "hash"], "left_semi").groupBy("core_id").agg(F.min("doc_id").alias("wanted_id")))
    drop(spark, shared)
    if wanted.isEmpty():
        return found.distinct()
    # One document of each is read again; ids that repeat bring other texts too, which the hash tells apart.
    again = documents.join(wanted.select("wanted_id").distinct(), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    again = trimmed(again).select(F.md5("core").alias("core_id"), "core").join(wanted, "core_id", "left_semi")
    own = cut(again.groupBy("core_id").agg(F.first("core").alias("core")))
    drop(spark, wanted)
    start = F.xxhash64(F.left("core", F.lit(ORDERED)))
    hot = own.groupBy(start.alias("start")).agg(F.count("*").alias("rows")).where(F.col("rows") >= hot_rows).select("start", F.lit(True).alias("hot"))
    # The range is one of beginnings, which is what its sampler sends to the driver; equal ones stay together.
    place = own.withColumn("start", start).join(F.broadcast(hot), "start", "left").withColumn("place", F.when(F.col("hot"), F.left("core", F.lit(ORDERED_HOT))).otherwise(F.left("core", F.lit(ORDERED))))
    told = cut(place.repartitionByRange("place").sortWithinPartitions("core").select("core_id", "core").mapInArrow(stacked, "core_id string, core string, state string"))
    # Cores at the end of a task, a stack each, are met with all that begin like them.
    least = F.xxhash64(F.left("core", F.lit(LADDER[0])))
    opened = told.where("state = 'open'").select("core_id", "core", least.alias("start"))
    longer = own.select(F.col("core").alias("longer"), least.alias("start"))
    met = longer.join(F.broadcast(opened), "start").where((F.length("longer") > F.length("core")) & F.startswith("longer", "core"))
    more = met.select("core_id", "core", F.substring("longer", F.length("core") + 1, F.lit(1)).alias("after")).distinct().mapInArrow(followed, "core_id string")
    return found.unionByName(told.where("state = 'inside'").select("core_id")).unionByName(more).distinct()


def endings(documents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, doc_key, source, how, last_line) of every document whose text isn't null or blank."""
    rows = trimmed(documents)
    size = F.length("core")
    rungs = F.array(*[F.when(size >= n, F.xxhash64(F.left("core", F.lit(n)))) for n in LADDER])
    columns = "doc_id long, doc_key string, source string, core_id string, size int, head string, rungs array<long>"
    looked = rows.select("doc_id", "doc_key", "source", F.md5("core").alias("core_id"), size.alias("size"), F.left("core", F.lit(LADDER[0])).alias("head"), rungs.alias("rungs"), F.substring("whole", -2000, 2000).alias("text"), "title")
    told = cut(looked.mapInArrow(look_at_ends, f"{columns}, how string, last_line string"))
    inside = cut(prefixes(documents.select("doc_id", "text"), told, hot_rows))
    copies = told.join(inside, "core_id", "left_semi").groupBy("core_id").agg(F.count("*").alias("copies")).select("core_id", "copies", F.lit(True).alias("inside"))
    met = spread_join(told.select("doc_id", "doc_key", "source", "how", "last_line", "core_id"), copies, "core_id", "copies", ["inside"], hot_rows)
    how = F.when(F.col("inside") & ~F.col("how").isin("sign", "word", "title"), "prefix").otherwise(F.col("how"))
    return met.select("doc_id", "doc_key", "source", how.alias("how"), "last_line")


def truncated(documents: DataFrame, closing_share: float = CLOSING_SHARE, closing_documents: int = CLOSING_DOCUMENTS) -> DataFrame:
    """(doc_id, source, cut, how) of every document: whether its text was cut off inside a sentence or word, and by what it shows.

    how is `sign`, `word`, `open`, `prefix` (a longer copy goes on), `whole` or `none`. Null, empty and blank texts are whole;
    repeated rows come out each. A last line closes documents if it ends those of closing_documents keys or more and of the share
    closing_share of all; null keys are one.
    """
    told = cut(endings(documents))
    least = max(closing_documents, closing_share * told.count())
    keyed = told.where("how = 'line'").groupBy("last_line", "doc_key").agg(F.count("*").alias("rows"))
    lines = keyed.groupBy("last_line").agg(F.sum("rows").alias("rows"), F.count("*").alias("documents"))
    closing = lines.withColumn("closes", F.col("documents") >= least)
    counted = spread_join(told.where("how = 'line'"), closing.select("last_line", "rows", "closes"), "last_line", "rows", ["closes"])
    judged = counted.select("doc_id", "source", F.when(F.col("closes"), "whole").otherwise("open").alias("how")).unionByName(told.where("how <> 'line'").select("doc_id", "source", F.when(F.col("how") == "title", "whole").otherwise(F.col("how")).alias("how")))
    blank = documents.where(~F.coalesce(F.col("text").rlike(r"[^\s\x{a0}]"), F.lit(False))).select("doc_id", "source", F.lit("none").alias("how"))
    return judged.unionByName(blank).select("doc_id", "source", (~F.col("how").isin("whole", "none")).alias("cut"), "how")


def by_source(judged: DataFrame) -> DataFrame:
    """How often each source truncates: documents, those cut off, and their share."""
    return judged.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("int")).alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 4).alias("share"))
