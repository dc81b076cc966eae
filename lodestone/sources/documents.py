"""Readers of documents as pages, and text out of HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import looks_like_heading
from lodestone.operators.guardrails import redacted

# Elements whose content is no text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
# The least characters a page and share of spaces of a text that was extracted well.
PAGE_CHARS, SPACE_SHARE = 40, 0.05


def spread(texts: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows dealt out to all cores, if a few row groups hold them all.

    A row group is read by one task, and texts cost far more to work on than to move. Columns and filters still reach
    the scan. A table of as many parts as there are cores, as large ones are, stays as it is. With rows, a task is
    given about so many of them, however large the table is: for work that takes long for each row.
    """
    parts = texts.rdd.getNumPartitions()
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // rows) if rows else 0)
    return texts.repartition(tasks) if parts < tasks else texts


def _replaced(text: Column, pattern: str, close: str) -> Column:
    """Each match of a pattern as a space, for a pattern whose matches end with a match of close.

    Only the text up to the last close is searched: behind it nothing matches, but a search would go to the end of the
    text for each tag that is never closed.
    """
    head = lambda t: F.array(F.regexp_extract(t, rf"(?is)^(.*{close})", 1))
    rest = lambda t, h: F.substring(t, F.length(h) + 1, F.length(t))
    return F.get(F.transform(F.array(text), lambda t: F.get(F.transform(head(t), lambda h: F.concat(F.regexp_replace(h, pattern, " "), rest(t, h))), 0)), 0)


def html_text(html: Column) -> Column:
    """The text of a page: without DROPPED elements, comments and tags, entities undone, white space collapsed.

    Takes time linear in the page's length, unclosed elements and comments included; what isn't closed is text.
    """
    out = _replaced(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "-->")
    for name in DROPPED:
        out = _replaced(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", rf"</{name}\s*>")
    out = _replaced(out, r"<[^>]*>", ">")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_text(html: Column) -> Column:
    """The text of a page that was fetched, without the secrets that guardrails know."""
    return redacted(html_text(html))


def read_pages(spark: SparkSession, path: str, kind: str = "txt") -> DataFrame:
    """source, page_number and text of txt, md and html files; a CSV gives one page a row, `column: value` lines."""
    if kind == "csv":
        raw = spark.read.csv(path, header=True, inferSchema=False)
        line = F.concat_ws("\n", *(F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in raw.columns))
        rows = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), line.alias("text"))
        # Rows are numbered from the first of their block on, and blocks by the rows of those before: a row for each block.
        blocks = rows.groupBy("source", "block").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
        before = F.sum("rows").over(Window.partitionBy("source").orderBy("block")) - F.col("rows")
        rows = rows.join(F.broadcast(blocks.select("source", "block", "first", before.alias("before"))), ["source", "block"])
        return normalized_pages(rows.select("source", (F.col("before") + F.col("n") - F.col("first")).alias("page_number"), "text"))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("long").alias("page_number"), F.col("value").alias("text"))
    return normalized_pages(text.withColumn("text", html_text(F.col("text"))) if kind == "html" else text)


def normalized_pages(pages: DataFrame) -> DataFrame:
    """Pages with text, numbered from 1."""
    return pages.where(F.trim("text") != "").withColumn("page_number", F.col("page_number") + 1)


def reflowed(text: Column) -> Column:
    """Lines that a page break or hyphen has wrapped are joined; blank lines still part paragraphs."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(joined, r"(?<![.!?:;\n])\n(?=[\p{Ll}\d(])", " ")


# Ends of a sentence at a line's end, breaks within a line, and words that make no heading by themselves.
LINE_ENDS = (".", "!", "?", ":", ";", "،", "؛", '."', '!"', '?"', ".)", ".”")
BREAKS = (". ", "! ", "? ", "; ", "، ", "؛ ")
FRAGMENTS = (
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "for", "at", "by", "with", "as", "so", "our", "its", "it", "is", "are", "was", "were", "this", "that", "these", "those", "from", "here",
    "there", "their", "they", "we", "you", "he", "she", "his", "her", "your", "whether", "however", "meanwhile", "also", "then", "when", "while", "each", "every", "both", "either", "neither", "who", "what",
    "which", "how", "customers", "visitors", "whatever", "whenever", "guests", "clients", "people", "everyone", "them",
)


def ends_sentence(line: Column) -> Column:
    return reduce(lambda a, b: a | b, (line.endswith(x) for x in LINE_ENDS))


def stands_alone(line: Column) -> Column:
    """Whether a line of a page reads as a heading and not as a piece of a wrapped sentence."""
    words = F.filter(F.transform(F.split(line, r"\s+"), lambda w: F.lower(F.trim(w, F.lit(".,;:!?'\"()[]")))), lambda w: w != "")
    inner = reduce(lambda a, b: a | b, (F.contains(line, F.lit(x)) for x in BREAKS))
    return looks_like_heading(line) & ~ends_sentence(line) & ~inner & (F.size(F.array_except(words, F.array(*map(F.lit, FRAGMENTS)))) > 0)


def reflowed_pages(pages: DataFrame, key: str) -> DataFrame:
    """key and text of each page, its wrapped lines joined to paragraphs that blank lines part; headings stay lines of their own.

    A paragraph that ends no sentence takes in the next one up to a heading. Pages without text stay out. Both steps
    number the blocks of a page in order, so a page's lines are shuffled once.
    """
    in_page = Window.partitionBy(key)
    lines = pages.select(key, F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.trim("raw")).withColumn("head", stands_alone(F.col("line")))
    first = (F.col("line") == "") | F.col("head") | F.lag(F.col("head") | (F.col("line") == ""), 1, True).over(in_page.orderBy("at"))
    lines = lines.withColumn("block", F.sum(first.cast("int")).over(in_page.orderBy("at"))).where("line != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n")
    blocks = lines.groupBy(key, "block").agg(F.trim(F.replace(F.regexp_replace(joined, "-\n", ""), F.lit("\n"), F.lit(" "))).alias("line"), F.bool_or("head").alias("was head"))
    blocks = blocks.withColumn("head", stands_alone(F.col("line")))
    begins = F.col("head") | F.lag(F.col("head") | ends_sentence(F.col("line")), 1, True).over(in_page.orderBy("block"))
    blocks = blocks.withColumn("part", F.sum(begins.cast("int")).over(in_page.orderBy("block")))
    parts = blocks.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x.line), " ").alias("line"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x.line), "\n\n").alias("text"))


def page_counts(pages: DataFrame) -> DataFrame:
    """source and page_count, the largest page number."""
    return pages.groupBy("source").agg(F.max("page_number").alias("page_count"))


def readable(pages: DataFrame, key: str) -> DataFrame:
    """key, chars_a_page, space_share and readable of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sums = pages.groupBy(key).agg(F.avg(F.length(text)).alias("chars_a_page"), (F.sum(F.regexp_count(text, F.lit(" "))) / F.greatest(F.sum(F.length(text)), F.lit(1))).alias("space_share"))
    return sums.withColumn("readable", (F.col("chars_a_page") >= PAGE_CHARS) & (F.col("space_share") >= SPACE_SHARE))
