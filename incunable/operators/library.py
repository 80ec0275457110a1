"""The library: manifests, its read API, the translation cache and translation through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passes
from ..functions import text as t


def manifest(books: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, source_pdf, created_at, pages, metadata) of each book; created_at comes with the books, as text."""
    n = pages.groupBy("book_id").agg(F.count("*").cast("int").alias("pages"))
    meta = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), "source_path")
    out = books.join(n, "book_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return out.select("book_id", t.basename("source_path").alias("source_pdf"), "created_at", "pages", meta.alias("metadata"))


def list_books(manifests: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return manifests.select("book_id", "pages", text("metadata.title").alias("title"), text("metadata.author").alias("author"), text("created_at").alias("created_at"))


def search_books(books: DataFrame, query: str = "", title: str = "", author: str = "", min_pages: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Books that hold the text, ignoring case; page bounds pass books whose page count is unknown."""
    has = lambda c, x: F.lower(F.coalesce(c, F.lit(""))).contains(x.lower()) if x else F.lit(True)
    hit = (has("book_id", query) | has("title", query) | has("author", query)) & has("title", title) & has("author", author)
    if min_pages is not None:
        hit &= F.col("pages").isNull() | (F.col("pages") >= min_pages)
    if max_pages is not None:
        hit &= F.col("pages").isNull() | (F.col("pages") <= max_pages)
    return books.where(hit)


def get_pages(pages_layer: DataFrame, book_id: str | None = None) -> DataFrame:
    rows = pages_layer if book_id is None else pages_layer.where(F.col("book_id") == book_id)
    return rows.select("book_id", F.col("number").alias("page"), F.size("blocks").alias("blocks"))


def page_blocks(pages_layer: DataFrame, blocks_layer: DataFrame) -> DataFrame:
    """Each page's blocks in the page's own order; ids without a block drop out, of repeated ids the last counts."""
    listed = pages_layer.select("book_id", F.col("number").alias("page"), F.posexplode("blocks").alias("pos", "id"))
    by = Window.partitionBy("book_id", "id").orderBy(F.col("page_number").desc())
    last = blocks_layer.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "page_number")
    return listed.join(last, ["book_id", "id"])


def get_page(pages_layer: DataFrame, blocks_layer: DataFrame, book_id: str, page: int) -> DataFrame:
    """Rows of one page in order; an unknown page is an error."""
    one = pages_layer.where((F.col("book_id") == book_id) & (F.col("number") == page))
    if one.isEmpty():
        raise ValueError(f"page {page} is not in {book_id}")
    return page_blocks(one, blocks_layer.where(F.col("book_id") == book_id)).orderBy("pos")


def block_view(blocks_layer: DataFrame) -> DataFrame:
    """Blocks as the interface shows them: tokens are never null, a box is its four corners or null."""
    tokens = F.coalesce("metadata.protected_tokens", F.array().cast("array<string>"))
    corners = F.when(F.col("bbox").isNotNull(), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    return blocks_layer.select("book_id", "id", F.col("page_number").alias("page"), "type", F.col("raw_text").alias("raw"), F.col("normalized_text").alias("normalized"), F.col("translated_text").alias("translated"), tokens.alias("protected_tokens"), corners.alias("bbox"))


def get_block(blocks_layer: DataFrame, book_id: str, block_id: str) -> DataFrame:
    """The first block of that id; none is an error."""
    one = block_view(blocks_layer.where((F.col("book_id") == book_id) & (F.col("id") == block_id))).limit(1)
    if one.isEmpty():
        raise ValueError(f"block {block_id} is not in {book_id}")
    return one


def get_book(manifests: DataFrame, book_id: str) -> DataFrame:
    """The manifest of one book; none is an error."""
    one = manifests.where(F.col("book_id") == book_id).limit(1)
    if one.isEmpty():
        raise ValueError(f"no book {book_id}")
    return one


def book_structure(manifests: DataFrame, blocks_layer: DataFrame) -> DataFrame:
    """Every book's number of pages and metadata with each of its blocks."""
    return manifests.select("book_id", "pages", "metadata").join(block_view(blocks_layer).withColumnRenamed("page", "block_page"), "book_id")


#: The names of a book's output files by format.
EXPORTS = {"json": "book.json", "txt": "book_ru.txt", "docx": "book_ru.docx"}


def book_info(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, title, source, pages, json, txt, docx): what is known of each book and which outputs it has, by files (book_id, name)."""
    have = files.groupBy("book_id").agg(*[F.bool_or(F.col("name") == name).alias(kind) for kind, name in EXPORTS.items()])
    rows = manifests.select("book_id", F.coalesce("metadata.title", F.lit("(unknown)")).alias("title"), F.coalesce(F.nullif(t.basename("source_pdf"), F.lit("")), F.lit("?")).alias("source"), F.coalesce(F.col("metadata.pages").cast("string"), F.lit("?")).alias("pages"))
    return rows.join(have, "book_id", "left").na.fill(False, list(EXPORTS))


def export_path(manifests: DataFrame, files: DataFrame, book_id: str, kind: str) -> str:
    """Where a book's output of a format is, under the folder of outputs; an unknown format, book or file is an error."""
    if kind not in EXPORTS:
        raise ValueError(f"no format {kind}")
    get_book(manifests, book_id)
    if files.where((F.col("book_id") == book_id) & (F.col("name") == EXPORTS[kind])).isEmpty():
        raise ValueError(f"{book_id} has no {kind}")
    return f"{book_id}/{EXPORTS[kind]}"


def latest_book(books: DataFrame) -> DataFrame:
    """The book that changed last."""
    return books.orderBy(F.col("mtime").desc(), "book_id").limit(1)


def artefacts(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Which outputs each book has, by their names in files (book_id, name)."""
    kinds = ("json", "txt", "html", "docx", "pdf")
    have = files.groupBy("book_id").agg(*[F.bool_or(F.col("name").endswith(f".{x}")).alias(f"has_{x}") for x in kinds])
    out = manifests.select("book_id", "pages").join(have, "book_id", "left")
    return out.na.fill(False, [f"has_{x}" for x in kinds])


def console_table(books: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One line of text for each row, every column as wide as its longest value."""
    text = books.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    widths = text.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    return text.crossJoin(F.broadcast(widths)).select(F.concat_ws("  ", *[F.rpad(F.col(c), F.col(f"w_{c}"), F.lit(" ")) for c in columns]).alias("line"))


def cache_key(text: str = "text") -> Column:
    return t.sha256(text)


def latest_cache(cache: DataFrame) -> DataFrame:
    """Of each block's entries the one written last."""
    w = Window.partitionBy("book_id", "block_id").orderBy(F.col("timestamp").desc())
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_lookup(blocks: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds cached and cache_hit: an entry counts if it is of the same text and model."""
    entry = latest_cache(cache).select("book_id", F.col("block_id").alias("id"), "src_hash", "model", "translated")
    out = blocks.join(entry, ["book_id", "id"], "left")
    hit = F.coalesce((F.col("src_hash") == cache_key(text)) & (F.col("model") == model), F.lit(False))
    return out.withColumns({"cache_hit": hit, "cached": F.when(hit, F.col("translated"))}).drop("src_hash", "model", "translated")


def translate(blocks: DataFrame, cache: DataFrame, adapter, model: str, text: str = "text", tokens: str | None = "protected_tokens") -> DataFrame:
    """Adds translated_text and cache_hit; equal texts that the cache lacks are translated once.

    adapter maps a column of texts to a column; where it gives null, the text itself stands in and is not for the cache
    (column failed). Protected tokens that a translation lost are appended.
    """
    looked = cache_lookup(blocks, cache, model, text)
    key = cache_key(text)
    fresh = looked.where("not cache_hit").select(key.alias("_h"), F.col(text).alias("_t")).groupBy("_h").agg(F.first("_t").alias("_t"))
    done = fresh.select("_h", adapter(F.col("_t")).alias("_new"))
    out = looked.withColumn("_h", key).join(done, "_h", "left")
    failed = ~F.col("cache_hit") & F.col("_new").isNull()
    target = F.coalesce("cached", "_new", text, F.lit(""))
    if tokens and tokens in blocks.columns:
        target = passes.preserve_tokens(target, tokens)
    return out.withColumns({"translated_text": target, "failed": failed}).drop("_h", "_new", "cached")


def cache_entries(translated: DataFrame, model: str, text: str = "text") -> DataFrame:
    """New rows for the cache: what was neither found in it nor failed."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return translated.where("not cache_hit and not failed").select("book_id", F.col("id").alias("block_id"), cache_key(text).alias("src_hash"), F.lit(model).alias("model"), F.col("translated_text").alias("translated"), stamp.alias("timestamp"))


def translate_summary(translated: DataFrame) -> DataFrame:
    return translated.groupBy("book_id", "page").agg(F.count("*").alias("blocks"), F.count_if("cache_hit").alias("cache_hits"), F.count("*").alias("translated"))


def reassemble_chunks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Translated chunks joined in order to their block; a block without any keeps its text."""
    joined = chunks.where(t.strip(F.coalesce("translated", F.lit(""))) != "").groupBy("book_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "translated"))), lambda x: x["translated"]), " ").alias("_t"))
    return blocks.join(joined, ["book_id", "id"], "left").withColumn("translated_text", F.coalesce("_t", "text")).drop("_t")
