"""Headings to chapters, page texts with OCR overrides, and texts of chapters and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as k
from ..functions.text import nfc, strip
from .blocks import ordered_join


def headings(blocks: DataFrame) -> DataFrame:
    return blocks.where(k.heading_candidate("text")).select("book_id", "page", "order", strip("text").alias("text"))


def chapter_map(found: DataFrame) -> DataFrame:
    """(book_id, number, title, page_start, page_end): valid headings, neighbours with equal titles once; the last is open.

    A page's second heading leaves the first an end before its start: that chapter is empty.
    """
    w = Window.partitionBy("book_id").orderBy("page", "order")
    valid = found.where(k.valid_heading("text")).withColumn("before", F.lag("text").over(w)).where("before is null or before <> text")
    return valid.select("book_id", F.row_number().over(w).alias("number"), F.col("text").alias("title"), F.col("page").alias("page_start"), (F.lead("page").over(w) - 1).alias("page_end"))


def chapter_pages(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Range join of chapters and pages as an equi-join: each chapter lists its pages; an open one ends with the book."""
    last = pages.groupBy("book_id").agg(F.max("page").alias("last"))
    closed = chapters.join(last, "book_id").withColumn("stop", F.least(F.coalesce("page_end", "last"), "last")).where("page_start <= stop")
    listed = closed.select("book_id", "number", "title", F.explode(F.sequence("page_start", "stop")).alias("page"))
    return listed.join(pages, ["book_id", "page"])


def page_texts(blocks: DataFrame) -> DataFrame:
    """(book_id, page, text): the page's blocks, each in NFC and stripped, one to a line; blank ones are left out."""
    tidy = blocks.select("book_id", "page", "order", nfc("text").alias("text")).where("text <> ''")
    return tidy.groupBy("book_id", "page").agg(ordered_join("order", F.col("text"), "\n").alias("text"))


def chapter_texts(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, number, title, file, text) of chapters with any text; numbers keep the gaps of empty ones and have two digits at least."""
    met = chapter_pages(chapters, pages).where("trim(text) <> ''")
    out = met.groupBy("book_id", "number", "title").agg(ordered_join("page", F.col("text"), "\n").alias("text"))
    return out.withColumn("file", F.concat(F.format_string("%02d", "number"), F.lit(" - "), safe_title("title"), F.lit(".txt")))


def safe_title(c: str) -> Column:
    return F.regexp_replace(F.substring(nfc(c), 1, 80), r'[\\/:*?"<>|]', "_")


def book_plaintext(pages: DataFrame) -> DataFrame:
    """One text for each book: a mark for each page, then its text; pages without text are left out."""
    page = F.concat(F.lit("=== PAGE "), F.col("page"), F.lit(" ===\n"), F.col("text"), F.lit("\n"))
    return pages.where("trim(text) <> ''").groupBy("book_id").agg(ordered_join("page", page, "\n").alias("text"))


def ocr_merge(pages: DataFrame, preflight: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages whose status is not TEXT_OK take their OCR text where there is any: (book_id, page, text, source)."""
    keys = ["book_id", "page"]
    rows = pages.join(preflight.select(*keys, "status"), keys, "left").join(ocr.select(*keys, strip("text").alias("ocr")), keys, "left")
    use = (F.coalesce("status", F.lit("TEXT_OK")) != "TEXT_OK") & (F.coalesce("ocr", F.lit("")) != "")
    return rows.select(*keys, F.when(use, F.col("ocr")).otherwise(F.col("text")).alias("text"), F.when(use, "ocr").otherwise("text").alias("source"))
