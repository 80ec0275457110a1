"""Blocks: derivation from documents, contracts, order, page statistics, nested and flat layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as k
from ..functions import passes
from ..functions import text as t

REQUIRED = ("id", "page", "order")


def from_documents(docs: DataFrame, per_page: int = 4) -> DataFrame:
    """One block for each line that is not blank: book_id, id, block_id, page, idx, order, text, type, bbox.

    No shuffle: a line's number in its document gives page, index and order.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("book_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = rows.where(F.trim("text") != "")
    page, idx = F.floor(F.col("i") / per_page).cast("int") + 1, F.col("i") % per_page
    block = F.concat(F.lit("p"), page, F.lit("_b"), idx)
    x0, y0 = (F.lit(50) + 250 * (F.col("i") % 2)).cast("double"), (40 * F.floor(F.col("i") / 2)).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 30).alias("y1"))
    return rows.select("book_id", "doc_id", block.alias("id"), block.alias("block_id"), page.alias("page"), idx.alias("idx"), F.col("i").alias("order"), "text", k.block_type("text").alias("type"), box.alias("bbox"))


def normalize(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Adds normalized_text and protected_tokens; values already there stay, tokens are merged in their order."""
    done = F.col("normalized_text") if "normalized_text" in blocks.columns else F.lit(None).cast("string")
    held = F.col("protected_tokens") if "protected_tokens" in blocks.columns else F.array().cast("array<string>")
    new = t.normalize_text(text)
    return blocks.withColumns({"normalized_text": F.coalesce(done, new), "protected_tokens": F.when(done.isNotNull(), F.coalesce(held, F.array().cast("array<string>"))).otherwise(t.merged_tokens(held, t.protected_tokens(new)))})


def violations(blocks: DataFrame, text: str | None = None) -> DataFrame:
    """Rows that break the contract, with the first rule each breaks: id, whole page and order, and filled text where asked."""
    for name in REQUIRED:
        if name not in blocks.columns:
            raise ValueError(f"blocks lack the column {name}")
    whole = lambda c: F.col(c).cast("string").try_cast("int").isNotNull()
    rule = F.when(F.col("id").isNull(), "id").when(~whole("page"), "page").when(~whole("order"), "order")
    if text:
        rule = rule.when(t.strip(F.coalesce(text, F.lit(""))) == "", text)
    return blocks.withColumn("violation", rule).where("violation is not null")


def require(blocks: DataFrame, text: str | None = None) -> DataFrame:
    """The blocks; raises if any breaks the contract."""
    first = violations(blocks, text).select("id", "violation").first()
    if first:
        raise ValueError(f"block {first['id']} breaks the contract on {first['violation']}")
    return blocks


def layout_violations(layout: DataFrame) -> DataFrame:
    """Of (book_id, pages): rows without a book_id or pages, or with a page without number or blocks."""
    bad_page = F.exists("pages", lambda p: p["page_num"].isNull() | p["blocks"].isNull())
    rule = F.when(t.first_filled("book_id") == "", "book_id").when(F.col("pages").isNull(), "pages").when(bad_page, "page")
    return layout.withColumn("violation", rule).where("violation is not null")


def global_order(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("page", "idx")
    return blocks.withColumn("order", F.row_number().over(w) - 1)


def page_index(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id", "page").orderBy("order")
    return blocks.withColumn("idx", F.row_number().over(w) - 1)


def batches(blocks: DataFrame, size: int) -> DataFrame:
    """batch: which group of `size` consecutive blocks of its book a block belongs to."""
    w = Window.partitionBy("book_id").orderBy("order")
    return blocks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def page_lengths(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book_id, page, text_len, status, density); pages without blocks count as 0 where `pages` is given."""
    got = blocks.groupBy("book_id", "page").agg(F.sum(F.length("text")).alias("text_len"))
    if pages is not None:
        got = pages.select("book_id", "page").join(got, ["book_id", "page"], "left")
    got = got.withColumn("text_len", F.coalesce("text_len", F.lit(0)))
    return got.withColumns({"status": k.text_status("text_len"), "density": k.text_density("text_len")})


def status_histogram(preflight: DataFrame) -> DataFrame:
    """Pages of each book by status, zeros kept."""
    known = ("TEXT_OK", "WEAK_TEXT", "NO_TEXT")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in known]
    return preflight.groupBy("book_id").agg(*counts, F.count_if(~F.col("status").isin(*known)).alias("OTHER"))


def source_histogram(pages: DataFrame) -> DataFrame:
    ocr = F.coalesce(F.col("source") == "ocr", F.lit(False))
    return pages.groupBy("book_id").agg(F.count_if(ocr).alias("ocr"), F.count_if(~ocr).alias("text"))


def blocks_per_page(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id", "page").agg(F.count("*").alias("blocks"))


def role_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id", F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))


def ordered_join(order: str, text: Column, sep: str) -> Column:
    """Texts of a group joined in the order of a column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def layout_model(blocks: DataFrame, columns: tuple[str, ...] = ("id", "order", "text", "translated_text", "role")) -> DataFrame:
    """(book_id, pages array<struct<page_num, blocks>>), pages and blocks in order."""
    have = [c for c in columns if c in blocks.columns]
    inner = F.struct(F.coalesce("order", F.lit(0)).alias("by"), *have)
    pages = blocks.groupBy("book_id", F.coalesce("page", F.lit(0)).alias("page_num")).agg(F.array_sort(F.collect_list(inner)).alias("blocks"))
    return pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "blocks"))).alias("pages"))


def flatten(layout: DataFrame) -> DataFrame:
    """Blocks of a nested layout as rows, in any order."""
    pages = layout.select("book_id", F.explode("pages").alias("p"))
    return pages.select("book_id", F.col("p.page_num").alias("page"), F.explode("p.blocks").alias("b")).select("book_id", "page", "b.*").drop("by")


def pages_layer(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, number, width, height, blocks): ids of each page's blocks in order."""
    ids = blocks.groupBy("book_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "id"))), lambda x: x["id"]).alias("blocks"))
    out = pages.join(ids, ["book_id", "page"], "left")
    return out.select("book_id", F.col("page").alias("number"), "width", "height", F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"))


def blocks_layer(blocks: DataFrame) -> DataFrame:
    """The library's rows of blocks, with whatever box and protected tokens the blocks have."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in blocks.columns else F.lit("")
    known = blocks.schema["bbox"].dataType.names if "bbox" in blocks.columns else []
    corner = lambda c: (F.col(f"bbox.{c}") if c in known else F.lit(None)).cast("double").alias(c)
    bbox = F.struct(*map(corner, ("x0", "y0", "x1", "y1")))
    bbox = F.when(F.col("bbox").isNotNull(), bbox) if known else F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    tokens = F.col("protected_tokens") if "protected_tokens" in blocks.columns else F.lit(None).cast("array<string>")
    return blocks.select("book_id", "id", F.col("page").alias("page_number"), "type", text("text").alias("raw_text"), text("normalized_text").alias("normalized_text"), text("translated_text").alias("translated_text"), bbox.alias("bbox"), F.struct(tokens.alias("protected_tokens")).alias("metadata"))


#: Passes over a translation in their order: the stamp's key and value, the pass, and whether only a changed text is stamped.
PASSES = (("quality_pass", "heuristic_v1", passes.quality_pass, False), ("editor_pass", "heuristic_v1", passes.editor_pass, True), ("term_pass", "v1", passes.term_pass, True))


def run_passes(blocks: DataFrame) -> DataFrame:
    """translated_text after the quality, editor and term passes; metadata (a map) says which were applied.

    The quality pass stamps every text that is long enough for it, the others only texts that they change; a null text
    is left alone.
    """
    out = blocks if "metadata" in blocks.columns else blocks.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for name, value, step, only_changed in PASSES:
        out = out.withColumn("_new", step("translated_text"))
        applied = (F.col("_new") != F.col("translated_text")) if only_changed else (F.length("translated_text") >= passes.QUALITY_FROM)
        held = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != name)  # noqa: B023  called at once
        stamped = F.map_concat(held, F.create_map(F.lit(name), F.lit(value)))
        out = out.withColumns({"metadata": F.when(applied, stamped).otherwise(F.col("metadata")), "translated_text": F.col("_new")}).drop("_new")
    return out
