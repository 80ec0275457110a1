"""Sources: layers and manifests as JSON, page and OCR texts, binary books, configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.text import book_id, strip

MANIFEST = "book_id string, source_pdf string, library_pdf string, created_at string, pages int, metadata struct<title:string,author:string,source_path:string,pages:int>, exports map<string,string>"
PAGES_LAYER = "book_id string, pages array<struct<number:int,width:double,height:double,blocks:array<string>>>"
BLOCKS_LAYER = "book_id string, blocks array<struct<id:string,page_number:int,type:string,raw_text:string,normalized_text:string,translated_text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,metadata:struct<protected_tokens:array<string>>>>"
CACHE = "src_hash string, model string, translated string, timestamp string"
BOOK = "file string, pages array<struct<page:int,source:string,blocks:array<struct<bbox:array<double>,text:string>>>>"


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Whole-file JSON of a known schema; a broken file is an error, or with strict=False left out."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST" if strict else "DROPMALFORMED")


def manifests(spark: SparkSession, library: str, strict: bool = True) -> DataFrame:
    """The manifests of all books in a library folder."""
    return read_json(spark, f"{library}/*/manifest.json", MANIFEST, strict)


def pages_layer(spark: SparkSession, library: str) -> DataFrame:
    rows = read_json(spark, f"{library}/*/layers/pages.json", PAGES_LAYER)
    return rows.select("book_id", F.explode("pages").alias("p")).select("book_id", "p.*")


def blocks_layer(spark: SparkSession, library: str) -> DataFrame:
    rows = read_json(spark, f"{library}/*/layers/blocks_index.json", BLOCKS_LAYER)
    return rows.select("book_id", F.explode("blocks").alias("b")).select("book_id", "b.*")


def cache(spark: SparkSession, path: str) -> DataFrame:
    """A translation cache of one file for each block, <book_id>/<block_id>.json."""
    name = F.col("_metadata.file_path")
    rows = spark.read.schema(CACHE).json(f"{path}/*/*.json", multiLine=True)
    return rows.select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("book_id"), F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("block_id"), "*")


def tool_books(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of books in the tools' JSON form: file, page, source, order, bbox, text."""
    pages = read_json(spark, path, BOOK).select("file", F.explode("pages").alias("p"))
    return pages.select("file", "p.page", "p.source", F.posexplode("p.blocks").alias("order", "b")).select("file", "page", "source", "order", "b.bbox", "b.text")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of files page_<n>.txt, stripped; bytes that are no UTF-8 are dropped."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.replace(F.make_valid_utf8(F.decode("content", "UTF-8")), F.lit("�"), F.lit(""))
    return rows.select(F.regexp_extract("path", r"page_(\d+)\.txt$", 1).cast("int").alias("page"), strip(text).alias("text"))


def books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, source_path, size, mtime, content) of files; the id is of the bytes."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.where(F.lower("path").endswith(".pdf")).select(book_id("content").alias("book_id"), F.col("path").alias("source_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


PDF_SCHEMA = "book_id string, page int, width double, height double, idx int, x0 double, y0 double, x1 double, y1 double, text string"


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Blocks of PDF files, by an installed PyMuPDF; raises ImportError on the driver where there is none."""
    import fitz  # noqa: F401  optional

    def run(batches):
        import fitz
        import pandas as pd

        for batch in batches:
            out = []
            for book, content in zip(batch["book_id"], batch["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        for i, (x0, y0, x1, y1, text, *_) in enumerate(page.get_text("blocks")):
                            out.append((book, n, page.rect.width, page.rect.height, i, x0, y0, x1, y1, text))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PDF_SCHEMA.split(", ")])

    return files.select("book_id", "content").mapInPandas(run, PDF_SCHEMA)


def fonts(spans: DataFrame) -> DataFrame:
    return spans.select("font").distinct().orderBy("font")


def read_config(text: str | None) -> dict:
    """Nested mappings of a simple YAML text: keys, scalars and indentation; {} for none or for what is not of that form."""
    root: dict = {}
    stack = [(-1, root)]
    for line in (text or "").splitlines():
        if not (bare := line.split(" #")[0].rstrip()) or bare.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"( *)([\w.-]+):\s*(.*)", bare)
        if not m:
            return {}
        depth, key, value = len(m[1]), m[2], m[3].strip("\"' ")
        while stack[-1][0] >= depth:
            stack.pop()
        if value:
            stack[-1][1][key] = int(value) if value.lstrip("-").isdigit() else {"true": True, "false": False}.get(value.lower(), value)
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return root
