"""Chunks from pages and tables, and the section each chunk belongs to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioflow.functions.text import english_spacing
from folioflow.runtime import cut

SIZE, OVERLAP, SHORTEST = 500, 50, 20
# Substrings that betray a code listing, labels of chunks without a heading, and the head of a table chunk.
CODE_HINTS = ("def ", "import ", "return ", "for ", "# ", "()", "self.", "lambda", "enumerate", "gradient_checkpointing", "torch")
FRONT, NONE, TABLE_HEAD = "Abstract / 摘要", "未分类", "表格内容：\n"
_SENTENCE = re.compile(r"[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+")


def packed(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed greedily; a new chunk opens with the last ``overlap`` characters of the one before. A sentence over
    ``size`` stays whole. Null and blank texts give no chunk."""
    found = [s for s in _SENTENCE.findall(text or "") if s.strip()]
    if not found:
        return []
    chunks, held = [], ""
    for s in found:
        if held and len(held) + len(s) > size:
            chunks.append(held)
            held = held[-overlap:] if overlap else ""
        held += s
    return chunks + [held] if held.strip() else chunks


def pack(size: int = SIZE, overlap: int = OVERLAP):
    """The packing as a column function; the fold carries text from one chunk to the next, which no window can express."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: packed(t, size, overlap))

    return run


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, page, chunk_index, text) from (source, page, text, page_seq): short chunks are dropped and take no index."""
    pieces = F.filter(F.transform(pack(size, overlap)("text"), lambda t: F.trim(t)), lambda t: F.length(t) >= SHORTEST)
    each = cut(pages.select("source", "page", "page_seq", pieces.alias("pieces")))
    return _numbered(each.withColumn("kind", F.lit(1)), pages.sparkSession)


def chunk_documents(tables: DataFrame, pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, page, chunk_index, content_type, text) of whole documents: the tables (source, page, page_seq, cells) that are real and no
    listings come first, then the pages; one index runs through both."""
    kept = tables.where(is_real_table(F.col("cells")) & ~is_code_table(F.col("cells"))).withColumn("text", table_text(F.col("cells"))).where("text is not null")
    pieces = F.filter(F.transform(pack(size, overlap)("text"), lambda t: F.trim(t)), lambda t: F.length(t) >= SHORTEST)
    every = kept.select("source", "page", "page_seq", F.array("text").alias("pieces"), F.lit(0).alias("kind")).unionByName(pages.select("source", "page", "page_seq", pieces.alias("pieces"), F.lit(1).alias("kind")))
    return _numbered(cut(every), tables.sparkSession, typed=True)


def _numbered(each: DataFrame, spark, typed: bool = False) -> DataFrame:
    """Rows of (source, page, page_seq, kind, pieces) as chunks numbered through their source.

    What is sorted by source are counts, one row a page and without text: where each page begins is then joined to its pieces, which
    stay dealt as they are.
    """
    key = ["source", "kind", "page", "page_seq"]
    counts = each.groupBy(*key).agg(F.sum(F.size("pieces")).alias("n"))
    before = Window.partitionBy("source").orderBy("kind", "page", "page_seq").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = each.where(F.size("pieces") > 0).join(begins, key).select("source", "page", "kind", "begin", F.posexplode("pieces").alias("seq", "text"))
    kind = [F.when(F.col("kind") == 0, "table").otherwise("text").alias("content_type")] if typed else []
    return numbered.select("source", "page", (F.col("begin") + F.col("seq")).cast("long").alias("chunk_index"), *kind, "text")


def empty_share(cells: Column) -> Column:
    """Share of null or blank cells of a table (array of rows)."""
    flat = F.flatten(cells)
    blank = F.size(F.filter(flat, lambda c: c.isNull() | (F.trim(c) == "")))
    return F.when(F.size(flat) > 0, blank / F.size(flat))


def is_real_table(cells: Column) -> Column:
    return F.coalesce((F.size(cells) >= 2) & (empty_share(cells) < 0.4), F.lit(False))


def is_code_table(cells: Column) -> Column:
    """At least three of the code hints in the lower-cased cells."""
    text = F.lower(F.array_join(F.filter(F.flatten(cells), lambda c: c.isNotNull() & (c != "")), " "))
    return sum((F.contains(text, F.lit(h)).cast("int") for h in CODE_HINTS), F.lit(0)) >= 3


def table_text(cells: Column) -> Column:
    """A table as lines of ``name: value`` joined by bars; blank cells and rows are skipped, null without a data row."""
    head = F.transform(F.element_at(cells, 1), lambda c: F.coalesce(c, F.lit("")))
    rows = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), lambda r: F.exists(r, lambda c: c.isNotNull() & (F.trim(c) != "")))

    def line(row: Column) -> Column:
        pairs = F.zip_with(F.slice(row, 1, F.greatest(F.size(head), F.lit(1))), head, lambda c, h: F.when(c.isNotNull() & (F.trim(c) != "") & h.isNotNull(), F.concat(h, F.lit(": "), c)))
        return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")

    lines = F.filter(F.transform(rows, line), lambda s: s != "")
    return F.when((F.size(cells) >= 2) & (F.size(rows) > 0), F.concat(F.lit(TABLE_HEAD), F.array_join(lines, "\n")))


def guess_section(page_text: Column) -> Column:
    """A section name from the opening of a page, where no heading was recognised."""
    first = F.trim(F.element_at(F.split(page_text, "\n"), 1))
    numbered = F.regexp_extract(page_text, r"(?m)^(\d+)\.\s*(.+)$", 2)
    return F.when(page_text.rlike(r"(?im)^abstract\b"), "Abstract").when(page_text.rlike(r"(?im)^1\.?\s*introduction"), "1. Introduction").when(numbered != "", F.substring(F.trim(numbered), 1, 60)).when(F.length(first) > 40, "Abstract / 论文摘要").otherwise(F.substring(first, 1, 80))


def sections(chunks: DataFrame, headers: DataFrame, *, spacing: bool = True) -> DataFrame:
    """``chunks`` plus ``heading``: the last first- and second-level heading on or before the chunk's page.

    An as-of join by page, as one union and one sort: headings are first folded to one row per page, then carried
    forward. Sources without any heading get the empty text; chunks before the first heading a front-matter label on pages 1
    and 2, else the label of unclassified ones. A hot source sorts pages and headings, never its chunks: chunks come back by a join on
    (source, page).
    """
    title = F.substring("title", 1, 80)
    heads = headers.where("source is not null and page is not null and level in ('h1', 'h2')").select("source", "page", "line", "level", (english_spacing(title) if spacing else title).alias("title"))
    # the last heading of each level on a page, and whether the second level is newer than the first
    at = F.struct("line", "title")
    h1, h2 = (F.max(F.when(F.col("level") == x, at)) for x in ("h1", "h2"))
    page_heads = heads.groupBy("source", "page").agg(h1.alias("a"), h2.alias("b")).select("source", "page", F.col("a.title").alias("h1"), F.when(F.col("a").isNull() | (F.col("b.line") > F.col("a.line")), F.col("b.title")).alias("h2"))
    pages = chunks.where("source is not null and page is not null").select("source", "page").distinct()
    known = heads.select("source").distinct().withColumn("has", F.lit(True))
    every = pages.select("source", "page", F.lit(True).alias("asked")).unionByName(page_heads, allowMissingColumns=True)
    w = Window.partitionBy("source").orderBy("page", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # a first level resets the second: both are carried as one struct whose order is the heading page
    every = every.withColumn("h1_page", F.last(F.when(F.col("h1").isNotNull(), F.col("page")), True).over(w)).withColumn("h2_page", F.last(F.when(F.col("h2").isNotNull(), F.col("page")), True).over(w)).withColumn("x1", F.last("h1", True).over(w)).withColumn("x2", F.last("h2", True).over(w))
    second = F.when(F.col("h1_page").isNull() | (F.col("h2_page") >= F.col("h1_page")), F.col("x2"))
    found = every.where("asked").join(known, "source", "left").select(
        "source", "page",
        F.when(F.col("has").isNull(), "").when(F.col("x1").isNotNull() & second.isNotNull(), F.concat("x1", F.lit(" > "), second)).when(F.col("x1").isNotNull(), F.col("x1")).when(second.isNotNull(), second).when(F.col("page") <= 2, FRONT).otherwise(NONE).alias("heading"),
    )
    return chunks.join(found, ["source", "page"], "left")
