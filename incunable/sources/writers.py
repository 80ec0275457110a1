"""Sinks: nested JSON, HTML, plain texts, chapter files, layers and manifests. Rows decide files; Spark's committer makes them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pick_text
from ..operators.blocks import ordered_join


def book_html(blocks: DataFrame) -> DataFrame:
    """(book_id, html): a heading for each page and a paragraph for each block, not escaped; empty blocks stay."""
    body = pick_text("translated_text", "normalized_text", "text")
    pages = blocks.groupBy("book_id", "page").agg(ordered_join("order", F.concat(F.lit("<p>"), body, F.lit("</p>")), "\n").alias("body"))
    page = F.concat(F.lit("<h2>Page "), F.col("page"), F.lit("</h2>\n"), F.col("body"))
    whole = pages.groupBy("book_id").agg(ordered_join("page", page, "\n").alias("body"))
    return whole.select("book_id", F.concat(F.lit("<html><body>\n"), F.col("body"), F.lit("\n</body></html>")).alias("html"))


def book_text(blocks: DataFrame) -> DataFrame:
    """(book_id, text): blocks by page and order, each with its page's mark and a blank line; empty ones are left out."""
    body = pick_text("translated_text", "normalized_text", "text")
    rows = blocks.withColumns({"_t": body, "_at": F.struct("page", "order")}).where("trim(_t) <> ''")
    return rows.groupBy("book_id").agg(ordered_join("_at", F.concat(F.lit("[page "), F.col("page"), F.lit("]\n"), F.col("_t"), F.lit("\n")), "\n").alias("text"))


def layout_json(layout: DataFrame) -> DataFrame:
    return layout.select("book_id", F.to_json(F.struct("book_id", "pages")).alias("json"))


def without_bytes(images: DataFrame) -> DataFrame:
    """Images as they are serialised: their bytes become null."""
    return images.withColumn("image_bytes", F.lit(None).cast("binary"))


def write_json(df: DataFrame, path: str, by: str | None = "book_id", mode: str = "overwrite") -> None:
    """JSON lines, a folder for each value of `by`."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by and by in df.columns else w).json(path)


def write_texts(df: DataFrame, path: str, text: str = "text", by: tuple[str, ...] = ("book_id",), mode: str = "overwrite") -> None:
    """Texts in a folder for each value of `by`, one line feed after each."""
    df.select(*by, F.col(text).alias("value")).write.mode(mode).partitionBy(*by).text(path)


def write_cache(entries: DataFrame, path: str) -> None:
    """Appends to a cache table; its reader takes the latest entry of each block."""
    entries.write.mode("append").partitionBy("model").parquet(path)
