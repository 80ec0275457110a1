"""One text to many: sentence chunks, headings split from bodies, table rows, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify as k
from .text import col, lines, once, strip

TRANSLATE_CHUNK, PARAGRAPH_CHUNK, LONG_PARAGRAPH = 350, 600, 800
# Words that open an abstract with their titles, and the patterns of numbered headings.
ABSTRACTS = (("аннотация", "Аннотация"), ("abstract", "Abstract"), ("резюме", "Резюме"), ("summary", "Summary"))
_NUMBERED = r"(?U)^\s*(\d+[.)]?)\s+([A-ZА-ЯЁ][\w\-() ]{2,60})\s+(.*)\z"
_TITLED = r"(?U)^\s*(\d+(?:\.\d+)*[.)]?)\s+([A-ZА-ЯЁ][^\n]{0,120})(?:\s+(.+))?"


def chunk_sentences(c: Column | str, most: int = TRANSLATE_CHUNK, blanks: bool = True) -> Column:
    """Sentences packed greedily into chunks of at most `most` characters; a longer sentence is cut into slices.

    A text that fits is one chunk as it stands, an empty one too. Slices of white space alone are kept as empty ones
    unless `blanks` is false.
    """
    whole = strip(F.coalesce(col(c), F.lit("")))
    sentences = F.filter(F.transform(F.split(whole, r"(?U)(?<=[.!?…])\s+"), strip), lambda s: s != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))

    def slices(s: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(s), F.lit(most)), lambda i: strip(F.substr(s, i, F.lit(most))))
        return cuts if blanks else F.filter(cuts, lambda x: x != "")

    def step(acc: Column, s: Column) -> Column:
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        joined = F.when(acc["now"] == "", s).otherwise(F.concat_ws(" ", acc["now"], s))
        return (
            F.when(F.length(s) > most, F.struct(F.concat(flushed, slices(s)).alias("done"), F.lit("").alias("now")))
            .when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("now")))
            .otherwise(F.struct(flushed.alias("done"), s.alias("now")))
        )

    packed = F.aggregate(sentences, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))
    return F.when(F.length(whole) <= most, F.array(whole)).otherwise(packed)


def split_structural_v1(source: Column | str, target: Column | str) -> Column:
    """(head, body) where the source opens with a number and breaks within 80 characters and the target opens alike; else null."""
    src, tgt = strip(F.coalesce(col(source), F.lit(""))), F.coalesce(col(target), F.lit(""))
    at = F.instr(src, "\n") - 1
    pattern = r"(?sU)^\s*(\d+[.)]?\s+\S+)\s+(.*)\z"
    head, body = strip(F.regexp_extract(tgt, pattern, 1)), strip(F.regexp_extract(tgt, pattern, 2))
    fits = src.rlike(r"(?U)^\s*\d+[.)]?\s+\S+") & at.between(0, 80) & (head != "") & (F.length(head) <= 80) & (body != "")
    return F.when(fits, F.struct(head.alias("head"), body.alias("body")))


def split_structural(c: Column | str) -> Column:
    """(head, body) of a block that opens like a numbered heading or a chapter; empty strings if it does not."""
    return once(strip(F.coalesce(col(c), F.lit(""))), lambda t: _structural(t, F.lower(t)))


def _structural(t: Column, low: Column) -> Column:
    part = lambda p, i: strip(F.regexp_extract(t, p, i))
    pair = lambda a, b: F.struct(a.alias("head"), b.alias("body"))
    body = part(_TITLED, 3)
    return (
        F.when(low.rlike(r"(?U)^\s*(глава|chapter)\s+\d+\b"), pair(t, F.lit("")))
        .when(t.rlike(_NUMBERED), pair(F.concat_ws(" ", part(_NUMBERED, 1), part(_NUMBERED, 2)), part(_NUMBERED, 3)))
        .when(t.rlike(_TITLED), pair(F.concat_ws(" ", part(_TITLED, 1), part(_TITLED, 2)), F.when(F.length(body) > 10, body).otherwise("")))
        .otherwise(pair(F.lit(""), F.lit("")))
    )


def split_abstract(c: Column | str) -> Column:
    """(head, body) of an abstract; bodies of up to ten characters are dropped. Empty strings if it is none."""
    return once(F.coalesce(col(c), F.lit("")), lambda raw: once(F.lower(strip(raw)), lambda low: _abstract(raw, low)))


def _abstract(raw: Column, low: Column) -> Column:
    out = F.struct(F.lit("").alias("head"), F.lit("").alias("body"))
    for word, title in reversed(ABSTRACTS):
        body = strip(F.substring(raw, len(word) + 1, 1 << 30))
        out = F.when(low.startswith(word + " "), F.struct(F.lit(title).alias("head"), F.when(F.length(body) > 10, body).otherwise("").alias("body"))).otherwise(out)
    for word, title in ABSTRACTS:
        out = F.when(low == word, F.struct(F.lit(title).alias("head"), F.lit("").alias("body"))).otherwise(out)
    return out


def table_rows(c: Column | str) -> Column:
    full = F.filter(F.transform(lines(col(c)), strip), lambda x: x != "")
    return F.transform(full, lambda x: F.transform(F.split(x, r"\|"), strip))


def block_to_paragraphs(c: Column | str) -> Column:
    """array<struct<type, text, rows>> of none, one or two paragraphs that a translated block becomes."""
    return once(strip(F.coalesce(col(c), F.lit(""))), lambda t: once(F.lower(t), lambda low: _paragraphs(t, low)))


def _paragraphs(t: Column, low: Column) -> Column:
    """The cascade over a stripped text and its lower case; each split is made once, where the rules before it fail."""
    no_rows = F.lit(None).cast("array<array<string>>")
    one = lambda kind, text, rows=no_rows: F.struct(F.lit(kind).alias("type"), text.alias("text"), rows.alias("rows"))
    none = F.array().cast("array<struct<type:string,text:string,rows:array<array<string>>>>")
    heading = lambda s: F.when(s["body"] != "", F.array(one("heading2", s["head"]), one("paragraph", s["body"]))).otherwise(F.array(one("heading2", s["head"])))
    preview = lambda rows: F.nullif(F.substring(F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(r, " | ")), " / "), 1, 200), F.lit(""))
    table = once(table_rows(t), lambda rows: F.array(one("table", F.coalesce(preview(rows), F.lit("[TABLE]")), rows)))
    whole = F.when(k._looks_list(t, low), F.array(one("list_item", t))).when(k._looks_heading(t), F.array(one("heading2", t))).otherwise(F.array(one("paragraph", t)))
    numbered = once(_structural(t, low), lambda s: F.when(s["head"] != "", heading(s)).otherwise(whole))
    plain = F.when(k._figure_caption(low), F.array(one("caption", t))).when(k.table_block(t), table).otherwise(numbered)
    opened = once(_abstract(t, low), lambda s: F.when(s["head"] != "", heading(s)).otherwise(plain))
    return F.when((t == "") | k._page_header_footer(low) | k._license_note(low) | k._graphical_abstract(low), none).otherwise(opened)
