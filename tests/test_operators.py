import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from incunable.operators import blocks as b
from incunable.operators import chapters as ch
from incunable.operators import layout as lay
from incunable.operators import library as lib
from incunable.operators import qa
from incunable.plans import book
from incunable.sources import readers, writers
from incunable.streaming import blocks as stream

BLOCK = "book_id string, id string, page int, order int, text string, translated_text string, type string, bbox struct<x0:double,y0:double>"


def frame(spark, rows):
    """Rows of (page, order, text, translated, x0, y0)."""
    return spark.createDataFrame([("b", f"p{p}_b{o}", p, o, x, y, "text", None if x0 is None else (float(x0), float(y0))) for p, o, x, y, x0, y0 in rows], BLOCK)


def test_auto_merge(spark):
    texts = ["a" * 49 + ".", "tail.", "b" * 38 + ".", "c" * 38 + ".", "H", "short."]
    got = lay.paragraph_stream(frame(spark, [(1, i, "", x, None, None) for i, x in enumerate(texts)])).orderBy("seq").collect()
    assert [(r["type"], len(r["text"])) for r in got] == [("paragraph", 96), ("paragraph", 39), ("heading2", 8)]


def test_figures_are_numbered_through_the_book(spark):
    got = lay.paragraph_stream(frame(spark, [(1, 0, "", "Graphical Abstract", 0, 0), (3, 1, "", "graphical abstract", 0, 0), (3, 2, "", "Some words here.", 0, 9)])).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["Graphical Abstract — Figure 1", "Graphical Abstract — Figure 2 Some words here."]


@pytest.mark.parametrize(("xs", "want"), [((50, 50, 300, 300), [0, 2, 1, 3]), ((50, 50, 50, 300, 300), [0, 1, 2, 3, 4]), ((50, 60, 70), [0, 1, 2]), ((None, None), [0, 1])])
def test_column_order(spark, xs, want):
    ys = (0, 20, 10, 30) if len(xs) == 4 else range(0, 100, 10)
    got = lay.column_order(frame(spark, [(1, i, "", "", x, y) for i, (x, y) in enumerate(zip(xs, ys))])).orderBy("place").collect()
    assert [r["order"] for r in got] == want


def test_reassemble(spark):
    rows = [(1, 0, "", "One part", None, None), (1, 1, "", "and end.", None, None), (1, 2, "", "Next", None, None), (2, 3, "", "", None, None), (2, 4, "", "- item", None, None), (2, 5, "", "Abstract", None, None), (2, 6, "", "x. " * 400, None, None)]
    got = lay.reassemble(frame(spark, rows)).orderBy("seq").collect()
    assert [(r["type"], r["page"]) for r in got][:4] == [("paragraph", 1), ("paragraph", 1), ("list_item", 2), ("heading2", 2)]
    assert got[0]["text"] == "One part and end." and got[2]["text"] == "item" and all(len(r["text"]) <= 600 for r in got[4:]) and len(got) == 6


def test_chapters(spark):
    heads = spark.createDataFrame([("b", p, o, x) for o, (p, x) in enumerate([(1, "Alpha Chapter"), (1, "Beta Chapter"), (4, "Beta Chapter"), (9, "Gamma Chapter")])], "book_id string, page int, order int, text string")
    found = ch.chapter_map(heads)
    assert [(r["title"], r["page_start"], r["page_end"]) for r in found.orderBy("number").collect()] == [("Alpha Chapter", 1, 0), ("Beta Chapter", 1, 8), ("Gamma Chapter", 9, None)]
    pages = spark.createDataFrame([("b", p, f"text {p}") for p in range(1, 11)], "book_id string, page int, text string")
    got = {r["file"]: r["text"] for r in ch.chapter_texts(found, pages).collect()}
    assert got == {"02 - Beta Chapter.txt": "\n".join(f"text {p}" for p in range(1, 9)), "03 - Gamma Chapter.txt": "text 9\ntext 10"}


def test_ratios_round_as_sql_rounds_them(spark):
    source, target = frame(spark, [(1, 0, "a" * 80, "", None, None)]), frame(spark, [(1, 0, "", "b" * 322 + ".", None, None)])
    assert [r["message"] for r in qa.check(source, target).where("type = 'length_mismatch'").collect()] == ["4.037"]


def planned(df):
    """The optimized plan, in one line."""
    return " ".join(df._jdf.queryExecution().optimizedPlan().toString().split())


def test_checks_are_made_once(spark):
    pair = frame(spark, [(1, 0, "a b", "", None, None)]), frame(spark, [(1, 0, "", "qi qi", None, None)])
    plan = planned(qa.check(*pair).where("type = 'repeated_tokens'"))
    assert "Filter (size(" not in plan and plan.count("(\\w+)") <= 2  # pairs by id and by place


def test_paragraphs_are_made_once(spark):
    given = frame(spark, [(1, 0, "", "Words.", 0, 0)]).withColumn("translated_text", F.lower("translated_text"))
    for df in (lay.paragraph_rows(given), lay.paragraph_stream(given), lay.docx_plan(lay.paragraph_stream(given))):
        assert "Filter (size(" not in planned(df) and planned(df).count("graphical abstract") == 2  # the label, and the cascade
        assert planned(df).count("LogicalRDD") + planned(df).count("LocalRelation") <= 1


def test_book_reads_its_blocks_once(spark):
    out = book.run_book(frame(spark, [(1, 0, "Words.", "", 0, 0)]).drop("translated_text").withColumn("text", F.lower("text")), gate=False)
    plan = planned(out["paragraphs"])
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and plan.count("\\bMSK\\b") <= 1


def test_figure_row_stands_for_all_labels_of_a_page(spark):
    rows = [(2, 0, "", "Words here before the label.", 0, 0), (2, 1, "", "Graphical abstract", 0, 5), (2, 2, "", "graphical abstract", 0, 9), (3, 3, "", None, 0, 0)]
    got = lay.paragraph_rows(frame(spark, rows)).orderBy("page", "n1", "n2", "n3").collect()
    assert [(r["page"], r["n1"], r["n2"], r["n3"], r["type"], r["text"]) for r in got] == [(2, 0, 0, 0, "figure", "Graphical Abstract — Figure 1"), (2, 1, 0, 0, "paragraph", "Words here before the label.")]


def test_page_texts_need_no_python(spark):
    assert "Python" not in planned(ch.page_texts(frame(spark, [(1, 0, "e\u0301", "", None, None)])))


def test_qa(spark):
    source = frame(spark, [(1, 0, "A" * 30, "", None, None), (1, 1, "Hello world.", "", None, None), (1, 2, "", "", None, None), (1, 3, "same", "", None, None)])
    target = frame(spark, [(1, 0, "", "", None, None), (1, 1, "", "Привет мир.", None, None), (1, 2, "", "x", None, None), (1, 4, "", "qi qi meridiansвсе", None, None)])
    got = {(r["block_id"], r["type"], r["severity"]) for r in qa.check(source, target).collect()}
    assert got == {("p1_b0", "empty_translation", "high"), ("p1_b2", "empty_source", "medium"), ("p1_b3", "lost_block", "high"), ("p1_b4", "extra_block", "high")}
    report = qa.report(source, target).first()
    assert (report["status"], report["total_blocks"], report["checked"], report["issues_total"]) == ("error", 4, 3, 4)
    marks = qa.check(frame(spark, [(1, 0, "qi qi word", "", None, None)]), frame(spark, [(1, 0, "", "qi qi meridiansвсе", None, None)])).collect()
    assert {(r["type"], r["message"]) for r in marks} == {("suspect_terms_en_in_ru", "meridian,meridians,qi"), ("repeated_tokens", "qi"), ("concatenated_scripts", "meridiansвсе")}


def test_glossary_paths_agree(spark):
    rows = frame(spark, [(1, 0, "the children of chi", "x", None, None), (1, 1, "ab", "b", None, None), (1, 2, "", "y", None, None), (1, 3, "chi", "", None, None)])
    terms = spark.createDataFrame([("chi", "ци"), ("a", "b"), ("ab", "q"), ("longer", "z")], "term string, translation string")
    small, large = (sorted(map(tuple, qa.glossary(rows, terms, n).collect())) for n in (1000, 1))
    assert small == large == [("b", "p1_b0", "chi"), ("b", "p1_b1", "ab")]


def test_contract_and_gate(spark):
    rows = frame(spark, [(1, 0, "Some text.", "", None, None), (1, 1, " ", "", None, None)])
    assert [r["violation"] for r in b.violations(rows, "text").collect()] == ["text"]
    with pytest.raises(ValueError):
        b.require(rows, "text")
    with pytest.raises(ValueError):
        b.violations(rows.drop("order"))
    with pytest.raises(book.QualityError):
        book.run_book(frame(spark, [(1, 0, "A" * 30, None, None, None)]), adapter=lambda c: F.lit(""))
    out = book.run_book(frame(spark, [(1, 0, "A fine text.", None, 0, 0)]))
    assert out["report"].first()["status"] == "ok" and out["paragraphs"].first()["text"] == "A fine text."


def test_passes_leave_their_stamps(spark):
    texts = ["short", "a" * 250, "slow" * 60 + " meridiansвсе", "word , " * 80, None]
    rows = frame(spark, [(1, i, "", x, None, None) for i, x in enumerate(texts)]).withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    got = {r["order"]: (r["translated_text"], r["metadata"]) for r in b.run_passes(rows).collect()}
    assert got[0] == ("short", {"k": "v"}) and got[1] == ("a" * 250, {"k": "v"}) and got[4] == (None, {"k": "v"})
    assert got[2][1] == {"k": "v", "editor_pass": "heuristic_v1", "term_pass": "v1"} and "меридианы все" in got[2][0]
    assert got[3][1] == {"k": "v", "quality_pass": "heuristic_v1"} and "word," in got[3][0]
    assert {r["order"]: r["metadata"] for r in b.run_passes(rows.drop("metadata")).collect()}[0] is None


def test_report_is_written_before_the_gate(spark, tmp_path):
    with pytest.raises(book.QualityError):
        book.run_book(frame(spark, [(1, 0, "A" * 30, None, None, None)]), adapter=lambda c: F.lit(""), report_path=f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/qa_report").first()["status"] == "error"
    assert spark.read.json(f"{tmp_path}/r/qa_issues").first()["type"] == "empty_translation"


def test_document_input_errors(spark):
    rows = spark.createDataFrame([("b", "paragraph", " \n")], "book_id string, type string, text string")
    for bad, error in ((rows, ValueError), (rows.limit(0), ValueError), (rows.drop("type"), TypeError)):
        with pytest.raises(error):
            lay.require_paragraphs(bad)
    assert lay.require_paragraphs(rows.unionByName(rows.withColumn("text", F.lit("x")))).count() == 2


def test_book_info_and_export_path(spark):
    m = spark.createDataFrame([("b1", "/in/x.pdf", None), ("b2", None, ("T", "", "", 3))], "book_id string, source_pdf string, metadata struct<title:string,author:string,source_path:string,pages:int>")
    files = spark.createDataFrame([("b1", "book.json"), ("b1", "xbook_ru.txt")], "book_id string, name string")
    got = {r["book_id"]: tuple(r)[1:] for r in lib.book_info(m, files).collect()}
    assert got == {"b1": ("(unknown)", "x.pdf", "?", True, False, False), "b2": ("T", "?", "3", False, False, False)}
    assert lib.export_path(m, files, "b1", "json") == "b1/book.json"
    for call in (("b1", "txt"), ("b3", "json"), ("b1", "pdf")):
        with pytest.raises(ValueError):
            lib.export_path(m, files, *call)


def test_translate_and_cache(spark, tmp_path):
    rows = frame(spark, [(1, 0, "one", None, None, None), (1, 1, "two", None, None, None), (1, 2, "one", None, None, None)]).drop("translated_text")
    empty = spark.createDataFrame([], "book_id string, block_id string, src_hash string, model string, translated string, timestamp string")
    first = lib.translate(rows, empty, lambda c: F.when(c != "two", F.upper(c)), "m")
    got = {r["id"]: (r["translated_text"], r["cache_hit"], r["failed"]) for r in first.collect()}
    assert got == {"p1_b0": ("ONE", False, False), "p1_b1": ("two", False, True), "p1_b2": ("ONE", False, False)}
    writers.write_cache(lib.cache_entries(first, "m"), f"{tmp_path}/cache")
    again = lib.translate(rows, spark.read.parquet(f"{tmp_path}/cache"), lambda c: F.lit("new"), "m")
    assert {r["id"]: (r["translated_text"], r["cache_hit"]) for r in again.collect()} == {"p1_b0": ("ONE", True), "p1_b1": ("new", False), "p1_b2": ("ONE", True)}


def test_library_round_trip(spark, tmp_path):
    at = tmp_path / "library" / "b1"
    (at / "layers").mkdir(parents=True)
    (at / "manifest.json").write_text(json.dumps({"book_id": "b1", "created_at": "x", "pages": None, "metadata": {"title": "My Title"}}))
    (at / "layers/pages.json").write_text(json.dumps({"book_id": "b1", "pages": [{"number": 1, "width": 1.0, "height": 2.0, "blocks": ["p1_b1", "gone", "p1_b0"]}]}))
    (at / "layers/blocks_index.json").write_text(json.dumps({"book_id": "b1", "blocks": [{"id": "p1_b0", "page_number": 1, "type": "text", "raw_text": "a", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "metadata": {"protected_tokens": ["T"]}}, {"id": "p1_b1", "page_number": 1, "type": "text", "raw_text": "b"}]}))
    library = str(tmp_path / "library")
    books = lib.list_books(readers.manifests(spark, library))
    assert lib.search_books(books, query="my t", min_pages=5).count() == 1 and lib.search_books(books, author="x").count() == 0
    pages, blocks = readers.pages_layer(spark, library), readers.blocks_layer(spark, library)
    assert [r["raw_text"] for r in lib.get_page(pages, blocks, "b1", 1).collect()] == ["b", "a"]
    one = lib.get_block(blocks, "b1", "p1_b0").first()
    assert (one["raw"], one["bbox"], one["protected_tokens"]) == ("a", [1.0, 2.0, 3.0, 4.0], ["T"])
    assert lib.get_block(blocks, "b1", "p1_b1").first()["bbox"] is None
    shown = lib.book_structure(readers.manifests(spark, library), blocks).orderBy("id").collect()
    assert [(r["id"], r["metadata"]["title"], r["block_page"], r["protected_tokens"]) for r in shown] == [("p1_b0", "My Title", 1, ["T"]), ("p1_b1", "My Title", 1, [])]
    assert lib.get_book(readers.manifests(spark, library), "b1").first()["book_id"] == "b1"
    for call in (lambda: lib.get_page(pages, blocks, "b1", 9), lambda: lib.get_block(blocks, "b1", "zz"), lambda: lib.get_book(readers.manifests(spark, library), "zz")):
        with pytest.raises(ValueError):
            call()


def test_stream_matches_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.run_to_table(stream.block_stream(stream.document_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), stream.block_stream(docs)
    assert got.count() == want.count() and got.select("book_id", "id", "role", "normalized_text").exceptAll(want.select("book_id", "id", "role", "normalized_text")).isEmpty()
