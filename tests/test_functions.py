import pytest
from pyspark.sql import functions as F

from incunable.functions import classify as k
from incunable.functions import passes as p
from incunable.functions import split as s
from incunable.functions import text as t
from incunable.plans import adapters
from incunable.sources.readers import read_config


def values(spark, rows, expression, schema="x string"):
    return [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema).select(expression).collect()]


def test_normalize(spark):
    given = ["co\u00adop-\nerate\u00a0 now", "x-\ny-\nz", "a\n\n\n  b\t c ", "", None]
    assert values(spark, given, t.normalize_text("x")) == ["cooperate now", "xyz", "a\nb c", "", ""]


def test_protected_tokens(spark):
    given = ["See FIG. 1A and Fig. 1A, TABLE 2 [3-5, 7] [1, 2-4] https://a.b/c", "H\u2082O", ""]
    assert values(spark, given, t.protected_tokens("x")) == [["FIG. 1A", "Fig. 1A", "TABLE 2", "[3-5, 7]", "https://a.b/c"], ["__HAS_SUP_INDEX__"], []]


def test_heading_levels(spark):
    given = [("Introduction", 1, 0), ("Introduction", 5, 40), ("METHODS", 5, 40), ("1. Intro", 1, 0), ("It ends.", 1, 0), ("no capitals here", 1, 0)]
    got = values(spark, given, k.heading_level("x", "page", "order"), "x string, page int, order int")
    assert got == ["heading1", "heading2", "heading1", "paragraph", "paragraph", "paragraph"]


def test_roles(spark):
    given = [("1) note", "text"), ("[1] note", "text"), ("Рис. 3 схема", "text"), ("Results:", "text"), ("It ends.", "text"), ("x", "image"), ("", "text"), (None, "text")]
    assert values(spark, given, k.role("x", "kind"), "x string, kind string") == ["list_item", "footnote", "caption", "heading", "paragraph", "image", "paragraph", "paragraph"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Page 3 of 10", []),
        ("This is Open Access content", []),
        ("Abstract", [("heading2", "Abstract")]),
        ("Abstract short", [("heading2", "Abstract")]),
        ("Abstract This is a long body", [("heading2", "Abstract"), ("paragraph", "This is a long body")]),
        ("Figure 2 shows", [("caption", "Figure 2 shows")]),
        ("a | b\nc | d", [("table", "a | b / c | d")]),
        ("a | b", [("paragraph", "a | b")]),
        ("-5 degrees", [("list_item", "-5 degrees")]),
        ("Chapter 3 The End", [("heading2", "Chapter 3 The End")]),
        ("1 Introduction Musculoskeletal pain is common", [("heading2", "1 Introduction Musculoskeletal pain is"), ("paragraph", "common")]),
        ("Hello world", [("heading2", "Hello world")]),
        ("Hello world.", [("paragraph", "Hello world.")]),
        ("NASA ESA.", [("heading2", "NASA ESA.")]),
        (None, []),
    ],
)
def test_block_to_paragraphs(spark, text, want):
    (got,) = values(spark, [text], s.block_to_paragraphs("x"))
    assert [(r["type"], r["text"]) for r in got] == want


def test_passes(spark):
    pad = " " + "слово " * 40
    given = ["Yin & Yang" + pad, "ци (Qi) и Qi" + pad, "short Qi", "Инь и Ян (Yin & Yang) и MSK" + pad, "meridiansвсе Yangи Yang-и" + pad]
    got = values(spark, given, p.term_pass("x"))
    assert got[0].startswith("Инь и Ян (Инь (Yin) & Ян (Yang))") and got[1].startswith("ци (Qi) и ци (Qi)") and got[2] == "short Qi"
    assert got[3].startswith("Инь и Ян (Yin & Yang) и опорно-двигательный аппарат (MSK)")
    assert values(spark, given[4:], p.editor_pass("x"))[0].startswith("meridians все Yang и Yang- и ")
    (long,) = values(spark, ["a\u00a0 b\u200b ,c .... " + "d " * 300], p.quality_pass("x"))
    assert long.startswith("a b,c\u2026 d d")


def test_preserve_tokens(spark):
    given = [("text", ["FIG. 1", "text"]), ("", ["FIG. 1A", "FIG. 1"]), (None, None)]
    assert values(spark, given, p.preserve_tokens("x", "y"), "x string, y array<string>") == ["text [FIG. 1]", "[FIG. 1A]", ""]


def plain_chunks(text, most):
    if len(text.strip()) <= most:  # a text that fits is one chunk as it stands, an empty one too
        return [text.strip()]
    import re

    out, now = [], ""
    for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?…])\s+", text.strip()))):
        if len(sentence) > most:
            out += [now] * bool(now) + [x for i in range(0, len(sentence), most) if (x := sentence[i : i + most].strip())]
            now = ""
        elif now and len(now) + 1 + len(sentence) > most:
            out, now = [*out, now], sentence
        else:
            now = f"{now} {sentence}" if now else sentence
    return out + [now] * bool(now)


def test_chunks(spark):
    given = ["", "One. Two! Three? Four", "x" * 45 + ". y. z.", "a b " * 20 + ". end.", "One sentence. " * 9]
    assert values(spark, given, s.chunk_sentences("x", 20)) == [plain_chunks(x, 20) for x in given]


def test_small_functions(spark):
    assert values(spark, [0, 299, 300], k.text_status("x"), "x long") == ["NO_TEXT", "WEAK_TEXT", "TEXT_OK"]
    specs = values(spark, ["openai:gpt:4", "", "foo", ":x", None], t.model_spec("x"))
    assert [tuple(r) for r in specs] == [("openai", "gpt:4"), ("dummy", "echo"), ("foo", ""), ("dummy", "x"), ("dummy", "echo")]
    assert values(spark, ["100"], t.sha256("x")) == ["ad57366865126e55649ecb23ae1d48887544976efea46a48eb5d85a6eeb4d306"]
    assert values(spark, ["C:\\a\\b.pdf", "/x/y.pdf"], t.basename("x")) == ["b.pdf", "y.pdf"]
    assert values(spark, ["e\u0301 "], t.nfc("x")) == ["\u00e9"]
    assert values(spark, [("abcd", "bcde")], t.similarity("x", "y"), "x string, y string") == [0.75]
    assert values(spark, ["- item", "12) b", "none"], k.list_text_v1("x")) == ["item", "b", None]
    assert values(spark, ["the cat and the dog", "zzz"], t.detect_language("x")) == ["en", None]
    assert values(spark, ["ok \u0600\u0601", "a\u00a9", ""], t.clean_model_output("x", F.lit("src"))) == ["src", "src", "src"]


def test_detect_language_reads_whole_texts(spark):
    assert values(spark, ["zzz " * 6000 + "der und die", "the cat " + "zzz " * 6000 + "der und die"], t.detect_language("x")) == ["de", "de"]


def test_adapters_and_config(spark):
    adapters.register("shout", adapters.python_adapter(lambda x: x.upper() if x != "bad" else 1 / 0))
    make, model = adapters.adapter("shout:v1")
    assert model == "v1" and values(spark, ["a", "bad"], make(F.col("x"))) == ["A", None]
    assert adapters.adapter("nobody")[1] == "echo"
    with pytest.raises(NotImplementedError):
        adapters.adapter("openai:x")
    config = read_config("default_profile: full\nprofiles:\n  full:\n    backend: nllb  # model\n    batch: 8\n")
    assert adapters.profile(config, "dev")["batch"] == 8 and adapters.profile(None, None)["name"] == "fast" and read_config("- x") == {}


def test_models_are_loaded_once_and_stubs_raise(spark):
    make = adapters.python_adapter(lambda model, x: f"{model}:{x}", load=lambda name: name.upper())
    assert values(spark, ["a", "b"], make("m")(F.col("x"))) == ["M:a", "M:b"]
    echo = adapters.EchoModel()
    assert values(spark, ["a"], echo.qa(F.col("x"), F.col("x"))["semantic_score"]) == [1.0]
    assert values(spark, ["a"], echo.analyze(F.col("x"))) == ["a"]
    for call in (lambda: adapters.TextModel().translate(F.col("x")), lambda: adapters.TextModel().analyze(F.col("x")), lambda: adapters.TextModel().qa(F.col("x"), F.col("x")), lambda: echo.ocr(F.col("x"))):
        with pytest.raises(NotImplementedError):
            call()


def test_chunks_keep_texts_that_fit(spark):
    given = ["One.  Two.", "", None, "a" * 800, "x. " + "b" * 349 + ". c."]
    got = values(spark, given, s.chunk_sentences("x"))
    assert got == [["One.  Two."], [""], [""], ["a" * 350, "a" * 350, "a" * 100], ["x.", "b" * 349 + ".", "c."]]


def test_list_items_keep_control_characters(spark):
    assert values(spark, ["- a\x01b", "3) x", "plain"], k.list_text_v1("x")) == ["a\x01b", "x", None]


def test_editor_pass_mends_both_misreadings(spark):
    text = "НТакупунктура NТакупунктура NТакупунктуры " + "слово " * 40
    assert values(spark, [text], p.editor_pass("x")) == ["Акупунктура Акупунктура N Такупунктуры " + "слово " * 40]


def test_strip_takes_what_a_unicode_pattern_takes(spark):
    every = "".join(map(chr, [*range(0x0, 0xD800), *range(0xE000, 0x10000)]))
    rows = [(c + "x" + c,) for c in every] + [("",), (" \t　\n",), (" a    b  ",)]
    got = spark.createDataFrame(rows, "x string").where(~t.strip("x").eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+\z", "")))
    assert got.count() == 0


def test_terms_are_found_in_any_case(spark):
    given = ["y" * 80 + x for x in (" YİN", " qı", " MSK", " mſk", " tcm", " meridiaN", " \ua78cQi")]
    got = values(spark, given, p.term_pass("x"))
    assert [x[81:] for x in got[2:6]] == ["опорно-двигательный аппарат (MSK)", "опорно-двигательный аппарат (MSK)", "традиционная китайская медицина (ТКМ)", "меридиан"] and got[6] == "y" * 80 + " Qi"
    assert p.ANY_TERM and values(spark, ["z" * 90 + "\ua78c", "z" * 90], p.term_pass("x")) == ["z" * 90, "z" * 90]


def test_nfc_is_that_of_python(spark):
    import unicodedata

    every = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x20000)] if unicodedata.category(chr(i)) != "Cn"]
    rows = every + [a + chr(i) for a in "aeoA\u0438 \u1100\u0915" for i in range(0x300, 0x370)] + ["\u1100\u1161\u11a8", "q\u0307\u0323", "\x1c e\u0301 \x1f", "", None]
    got = values(spark, rows, t.nfc("x"))
    assert got == [x if x is None else unicodedata.normalize("NFC", x).strip() for x in rows]


def test_language_splits_a_text_once(spark):
    plan = spark.createDataFrame([("a",)], "x string").select(t.detect_language("x").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_similarity_of_texts_that_begin_alike(monkeypatch):
    import difflib

    import pandas as pd

    plain = difflib.SequenceMatcher
    long = "ab the quick fox " * 30
    pairs = [(long, long), (long, long * 4), (long + "!", long), ("", long), ("", ""), (None, "x"), ("ab" * 200, "ab" * 200)]
    want = [plain(None, a or "", b or "").ratio() for a, b in pairs]

    def matcher(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(difflib, "SequenceMatcher", matcher)
    assert list(t.similarity.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))) == want
