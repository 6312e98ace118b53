"""Sections and page noise as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T


def lines(spans: DataFrame, by: tuple[str, ...], text: str = "text") -> DataFrame:
    """(by, pos, line): the stripped lines of cleaned texts, blank ones too"""
    return spans.select(*by, F.posexplode(F.split(T.clean_text(text), "\n", -1)).alias("pos", "raw")).select(*by, "pos", T.strip("raw").alias("line"))


def split(spans: DataFrame, by: tuple[str, ...] = ("document_id", "page_number"), text: str = "text") -> DataFrame:
    """(by, section_index, title, body). Headings start a group; groups
    without a body go; a text of headings alone is one section. Each text is
    worked on in its row: its lines are an array, its sections the slices
    between headings; nothing is shuffled."""
    strip_line = lambda x: T.strip(x)
    rows = spans.select(*by, T.clean_text(text).alias("whole"))
    rows = rows.select("*", F.transform(F.split("whole", "\n", -1), strip_line).alias("ls"))
    # places of headings, from 1; 0 stands for what comes before the first
    heads = F.filter(F.transform("ls", lambda x, i: F.when((x != "") & T.is_heading(x), i + 1)), lambda i: i.isNotNull())
    rows = rows.select("*", F.concat(F.array(F.lit(0)), heads).alias("heads"))
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("ls") + 1))
    sections = F.zip_with(
        "heads", ends,
        lambda at, end: F.struct(F.when(at == 0, F.lit("Section")).otherwise(T.strip_hashes(F.get("ls", at - 1))).alias("title"), T.clean_text(F.array_join(F.slice("ls", at + 1, end - at - 1), "\n")).alias("body")),
    )
    rows = rows.select("*", F.filter(sections, lambda x: x["body"] != "").alias("found"))
    alone = F.when(F.col("whole") != "", F.array(F.struct(F.lit("Section").alias("title"), F.col("whole").alias("body"))))
    found = F.when(F.size("found") > 0, F.col("found")).otherwise(alone)
    return rows.select(*by, F.posexplode(found).alias("section_index", "section")).select(*by, "section_index", "section.title", "section.body")


def without_page_noise(pages: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """Pages without the first and last lines that most pages of a document
    of three pages or more have in common."""
    found = pages.select(document, page, F.filter(F.transform(F.split(F.col(text), "\n", -1), T.strip), lambda x: x != "").alias("ls"))
    found = found.withColumns({"first": F.get("ls", F.lit(0)), "last": F.get("ls", F.size("ls") - 1)})
    n = F.count(F.lit(1)).over(Window.partitionBy(document))
    enough = F.greatest(F.lit(2), F.floor(n * 0.6))
    often = lambda c: F.col(c).isNotNull() & (F.length(c) <= 120) & (F.count(F.lit(1)).over(Window.partitionBy(document, c)) >= enough) & (n >= 3)
    found = found.withColumns({"top": F.coalesce(often("first"), F.lit(False)), "bottom": F.coalesce(often("last"), F.lit(False)), "many": n >= 3})
    rest = F.when(F.col("top"), F.slice("ls", 2, F.size("ls"))).otherwise(F.col("ls"))
    found = found.withColumn("rest", rest)
    cut = F.col("bottom") & (F.size("rest") > 0)
    kept = F.when(cut, F.slice("rest", 1, F.size("rest") - 1)).otherwise(F.col("rest"))
    return found.select(document, page, "many", T.clean_text(F.array_join(kept, "\n")).alias("clean")).join(pages.select(F.col(document).alias("_d"), F.col(page).alias("_p"), F.col(text).alias("raw")), (F.col(document) == F.col("_d")) & (F.col(page) == F.col("_p"))).select(document, page, F.when(F.col("many"), F.col("clean")).otherwise(F.col("raw")).alias("text"))
