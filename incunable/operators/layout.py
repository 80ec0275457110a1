"""Reading order and paragraphs. Both ordered folds are windows over a book: islands first, a short fold inside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as k
from ..functions import split as s
from ..functions import text as t

SPREAD, SHORT, ROOM = 120, 40, 90


def with_heading_levels(blocks: DataFrame) -> DataFrame:
    text = t.first_filled("translated_text", "text") if "translated_text" in blocks.columns else F.col("text")
    return blocks.withColumn("role", k.heading_level(text, "page", "order"))


def column_order(blocks: DataFrame) -> DataFrame:
    """Adds place: the block's place on its page, two columns read one after the other.

    Pages without boxes go by order, pages less than 120 wide by (y0, order); others by column, then y0. Blocks without
    a box come last.
    """
    x0, y0 = F.col("bbox.x0"), F.col("bbox.y0")
    spread, page = F.col("_spread"), Window.partitionBy("book_id", "page")
    # windows of one partitioning: the blocks are read and dealt out once, and no list of a page is made
    ranked = blocks.withColumn("_n", F.row_number().over(page.orderBy(x0.asc_nulls_last())))
    ranked = ranked.withColumns({"_at": F.floor(F.count(x0).over(page) / 2) + 1, "_spread": F.max(x0).over(page) - F.min(x0).over(page)})
    keyed = ranked.withColumn("_middle", F.max(F.when(F.col("_n") == F.col("_at"), x0)).over(page)).withColumns({
        "_last": F.when(spread.isNull(), 0).when(x0.isNull(), 2).when(spread < SPREAD, 0).otherwise((x0 > F.col("_middle")).cast("int")),
        "_y": F.when(spread.isNull() | x0.isNull(), 0.0).otherwise(y0),
    })
    return keyed.withColumn("place", F.row_number().over(page.orderBy("_last", "_y", "order")) - 1).drop("_last", "_y", "_n", "_at", "_middle", "_spread")


def paragraph_rows(blocks: DataFrame) -> DataFrame:
    """Paragraphs of every block in reading order, before short ones are merged: book_id, page, n1..n3, type, text, rows.

    A page whose blocks hold a graphical-abstract label gets a figure row ahead of its blocks, numbered through the book.
    """
    page, book = Window.partitionBy("book_id", "page"), Window.partitionBy("book_id").orderBy("page", "n1", "n2", "n3")
    placed = column_order(blocks).withColumn("_label", k.graphical_abstract("translated_text"))
    placed = placed.withColumn("_figure", F.col("_label") & (F.col("place") == F.min(F.when(F.col("_label"), F.col("place"))).over(page)))
    # a block with the label is no paragraph, so the page's first one makes the figure row: the blocks are read once
    none = F.lit(None).cast("array<array<string>>")
    figure = F.array(F.struct(F.lit("figure").alias("type"), F.lit("").alias("text"), none.alias("rows")))
    # outer: else the optimizer puts a filter on the array's size below, which makes the paragraphs twice
    cut = F.posexplode_outer(F.when(F.col("_figure"), figure).otherwise(s.block_to_paragraphs("translated_text"))).alias("n3", "p")
    rows = placed.select("book_id", "page", "place", "_figure", cut).where("p is not null")
    at = lambda c: F.when(F.col("_figure"), 0).otherwise(c)
    rows = rows.select("book_id", "page", at(F.lit(1)).alias("n1"), at(F.col("place")).alias("n2"), "n3", "p.type", "p.text", "p.rows")
    number = F.sum(F.when(F.col("type") == "figure", 1).otherwise(0)).over(book)
    return rows.withColumn("text", F.when(F.col("type") == "figure", F.concat(F.lit("Graphical Abstract — Figure "), number)).otherwise(F.col("text")))


def paragraph_stream(blocks: DataFrame) -> DataFrame:
    """(book_id, seq, type, text, page, rows): a short paragraph joins the row before it while that has room.

    Whether a row can join is known from the row itself; a run of such rows after one that cannot is an island, and only
    inside it lengths are folded.
    """
    book = Window.partitionBy("book_id").orderBy("page", "n1", "n2", "n3")
    can = (F.col("type") == "paragraph") & (F.length("text") < SHORT)
    numbered = paragraph_rows(blocks).withColumn("n", F.row_number().over(book))
    islands = numbered.withColumn("island", F.sum(F.when(can & (F.col("n") > 1), 0).otherwise(1)).over(book))
    each = islands.groupBy("book_id", "island").agg(F.array_sort(F.collect_list(F.struct("n", "type", "text", "page", "rows"))).alias("xs"))
    # the fold's state: rows already closed, and the row that may still grow
    first = F.get("xs", F.lit(0))
    closed = F.filter("xs", lambda x: F.lit(False))

    def step(acc, x):
        now = acc["now"]
        grown = F.struct(now["n"].alias("n"), now["type"].alias("type"), F.concat_ws(" ", now["text"], x["text"]).alias("text"), now["page"].alias("page"), now["rows"].alias("rows"))
        return F.when(F.length(now["text"]) < ROOM, F.struct(acc["done"].alias("done"), grown.alias("now"))).otherwise(F.struct(F.array_append(acc["done"], now).alias("done"), x.alias("now")))

    folded = F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), F.struct(closed.alias("done"), first.alias("now")), step, lambda a: F.array_append(a["done"], a["now"]))
    rows = each.select("book_id", F.explode_outer(folded).alias("p")).select("book_id", "p.*")
    seq = F.row_number().over(Window.partitionBy("book_id").orderBy("n")) - 1
    return rows.select("book_id", seq.alias("seq"), "type", "text", "page", "rows")


def reassemble(blocks: DataFrame) -> DataFrame:
    """(book_id, seq, type, text, page): running text is joined to paragraphs up to a full stop; the rest stands alone.

    A paragraph begins wherever the block before it closes one, which lag() sees; its number is a running sum.
    """
    target = t.first_filled("translated_text", "text")
    source = t.first_filled("normalized_text", "text") if "normalized_text" in blocks.columns else F.col("text")
    given = F.col("role") if "role" in blocks.columns else F.lit("paragraph")
    # staged, so that no column's expression is planned more than once
    texts = blocks.select("book_id", "page", "order", "id", t.strip(target).alias("t"), source.alias("source"), given.alias("given"))
    cut = texts.select("book_id", "page", "order", "id", "t", s.split_structural_v1("source", "t").alias("cut"), k.role_v1("t", "given").alias("kind"))
    cut = cut.withColumn("running", F.coalesce("cut.body", "t")).withColumn("item", k.list_text_v1("running"))
    rest = F.struct(
        F.when(F.col("running") == "", "empty").when(F.col("cut").isNull() & (F.col("kind") != "paragraph"), F.col("kind")).when(F.col("item").isNotNull(), "list_item").otherwise("body").alias("k"),
        F.when(F.col("cut").isNull() & (F.col("kind") != "paragraph"), F.col("running")).otherwise(F.coalesce("item", "running")).alias("x"),
    )
    parts = F.when(F.col("cut").isNotNull(), F.array(F.struct(F.lit("heading2").alias("k"), F.col("cut.head").alias("x")), rest)).otherwise(F.array(rest))
    rows = cut.select("book_id", "page", "order", "id", F.posexplode(parts).alias("n", "p")).select("book_id", "page", "order", "id", "n", F.col("p.k").alias("k"), F.col("p.x").alias("x"))
    rows = rows.withColumn("k", F.when((F.col("k") == "body") & (F.length("x") > s.LONG_PARAGRAPH), "long").otherwise(F.col("k")))
    book = Window.partitionBy("book_id").orderBy("page", "order", "id", "n")
    before, ended = F.lag("k").over(book), F.lag(k.ends(F.col("x"), ".!?…")).over(book)
    begins = (F.col("k") != "body") | before.isNull() | (before != "body") | ended
    grouped = rows.withColumn("g", F.sum(begins.cast("int")).over(book)).where("k <> 'empty'")
    joined = grouped.groupBy("book_id", "g").agg(F.min(F.struct("page", "order", "id", "n", "k")).alias("head"), F.array_sort(F.collect_list(F.struct("page", "order", "id", "n", "x"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["x"]), " ")
    out = joined.select("book_id", "g", F.col("head.page").alias("page"), F.col("head.k").alias("k"), F.posexplode(F.when(F.col("head.k") == "long", s.chunk_sentences(text, s.PARAGRAPH_CHUNK, blanks=False)).otherwise(F.array(text))).alias("part", "text"))
    kind = F.when(F.col("k").isin("body", "long"), "paragraph").otherwise(F.col("k"))
    seq = F.row_number().over(Window.partitionBy("book_id").orderBy("g", "part")) - 1
    return out.select("book_id", seq.alias("seq"), kind.alias("type"), "text", "page")


def require_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs; raises if a column that a document needs is missing, or there is none with any text."""
    if missing := {"type", "text"} - set(paragraphs.columns):
        raise TypeError(f"paragraphs lack {', '.join(sorted(missing))}")
    filled = paragraphs.agg(F.count("*").alias("n"), F.count_if(t.strip(F.coalesce("text", F.lit(""))) != "").alias("full")).first()
    if not filled["n"]:
        raise ValueError("there are no paragraphs")
    if not filled["full"]:
        raise ValueError("all paragraphs are empty")
    return paragraphs


def simple_docx_plan(blocks: DataFrame) -> DataFrame:
    """(book_id, page, n, style, level, text): each page a heading of level 2, then every block's text, the empty ones too."""
    texts = blocks.select("book_id", "page", "order", t.pick_text("translated_text", "normalized_text", "text").alias("text"))
    rows = texts.select("book_id", "page", (F.row_number().over(Window.partitionBy("book_id", "page").orderBy("order"))).alias("n"), F.lit("paragraph").alias("style"), F.lit(None).cast("int").alias("level"), "text")
    heads = texts.select("book_id", "page").distinct().select("book_id", "page", F.lit(0).alias("n"), F.lit("heading").alias("style"), F.lit(2).alias("level"), F.concat(F.lit("Page "), "page").alias("text"))
    return heads.unionByName(rows)


def docx_plan(paragraphs: DataFrame) -> DataFrame:
    """How each paragraph is set: style, level and table width; blank ones are left out. require_paragraphs() checks a writer's input."""
    kind = F.lower(F.coalesce("type", F.lit("paragraph")))
    style = (
        F.when(kind.isin("heading1", "h1"), "heading").when(kind.isin("heading2", "heading", "h2"), "heading").when(kind == "list_item", "bullet").when(kind == "caption", "caption")
        .when(kind == "figure", "figure").when((kind == "table") & F.col("rows").isNotNull(), "table").otherwise("justified")
    )
    level = F.when(kind.isin("heading1", "h1"), 1).when(kind.isin("heading2", "heading", "h2"), 2)
    width = F.when(style == "table", F.array_max(F.transform("rows", lambda r: F.size(r))))
    return paragraphs.withColumns({"style": style, "level": level, "columns": width, "text": t.unix_text("text")}).where("text <> '' or columns is not null")


def pdf_lines(blocks: DataFrame, height: float = 842.0, margin: float = 50.0) -> DataFrame:
    """Where each line of text goes: sheet and y. Headings are 12 points high, the rest 10, with a leading of 1.2."""
    size = F.when(F.col("type") == "heading", 12).otherwise(10)
    rows = blocks.select("book_id", "order", size.alias("size"), F.posexplode(t.lines(t.pick_text("translated_text", "normalized_text", "text"))).alias("line", "text"))
    before = F.sum(F.col("size") * 1.2).over(Window.partitionBy("book_id").orderBy("order", "line").rowsBetween(Window.unboundedPreceding, -1))
    usable = height - 2 * margin
    down = F.coalesce(before, F.lit(0.0))
    sheet = F.floor(down / usable)
    return rows.withColumns({"sheet": sheet + 1, "y": height - margin - (down - sheet * usable)})
