"""What a line or block is: cascades in which the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, col, first_filled, lines, once, strip

# Words and marks that the rules look for.
BULLETS = ("- ", "* ", "• ", "∙ ", "· ")
BULLETS_V1 = r"^[•\-*‣]\s+"
CAPTION_STARTS = ("рис.", "figure", "fig.", "табл.", "table")
FIGURE_STARTS = ("figure ", "рисунок", "рис.")
HEADING_STARTS = ("abstract", "резюме", "аннотация", "summary", "keywords", "ключевые слова", "graphical abstract", "графическая абстракция")
NO_CHAPTERS = ("СОДЕРЖАНИЕ", "ОГЛАВЛЕНИЕ", "ПРЕДИСЛОВИЕ", "ВВЕДЕНИЕ", "ИТОГИ", "ЗАКЛЮЧЕНИЕ", "ЛИТЕРАТУРА", "СПИСОК ЛИТЕРАТУРЫ")


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def ends(c: Column, marks: str) -> Column:
    return F.substring(c, -1, 1).isin(*marks) & (c != "")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def has_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}")


def upper_ratio(c: Column, least: int = 0) -> Column:
    """Share of capitals among letters; least: the denominator's minimum (0: null without letters)."""
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    return F.length(F.regexp_replace(c, r"\P{Lu}+", "")) / (F.greatest(letters, F.lit(least)) if least else F.nullif(letters, F.lit(0)))


def block_type(c: Column | str) -> Column:
    return F.when(strip(_text(c)).endswith(":"), "heading").otherwise("text")


def heading_level(text: Column | str, page: Column | str, order: Column | str) -> Column:
    t = strip(_text(text))
    n = F.length(t)
    plain = (t == "") | (n > 120) | t.endswith(".") | t.rlike(r"(?U)^\d")
    short = (~t.rlike(r"(?U)\s") & (n <= 40) | (n <= 70)) & has_upper(t)
    top = ((col(order) <= 2) & (col(page) <= 3)) | (is_upper(t) & (n <= 80))
    return F.when(plain | ~short, "paragraph").when(top, "heading1").otherwise("heading2")


def list_item(c: Column | str) -> Column:
    t = strip(_text(c))
    return starts(t, BULLETS) | t.rlike(r"(?U)^\d+[.)]\s+")


def role(text: Column | str, kind: Column | str) -> Column:
    t = strip(_text(text))
    n, one = F.length(t), ~t.contains("\n")
    caption = (n <= 120) & starts(F.lower(t), CAPTION_STARTS)
    note = (n <= 200) & t.rlike(r"(?U)^\[\d+\]\s+")
    short = (n <= 120) & one
    return (
        F.when(col(kind).isin("image", "table"), col(kind))
        .when(t == "", "paragraph")
        .when(list_item(t), "list_item")
        .when(caption, "caption")
        .when(note, "footnote")
        .when(short & ~ends(t, ".?!;:"), F.when(n <= 60, "heading").otherwise("subtitle"))
        .when(short & t.endswith(":"), "heading")
        .when((n <= 80) & (upper_ratio(t, 1) > 0.7), "heading")
        .otherwise("paragraph")
    )


def list_text_v1(c: Column | str) -> Column:
    """The item without its marker; null if it is no list item."""
    t = strip(_text(c))
    bullet, number = BULLETS_V1, r"(?U)^\d{1,2}[.)]\s+"
    return F.when(t.rlike(bullet), strip(F.regexp_replace(t, bullet, ""))).when(t.rlike(number), strip(F.regexp_replace(t, number, "")))


def role_v1(text: Column | str, given: Column | str) -> Column:
    t, base = strip(_text(text)), F.lower(F.coalesce(col(given), F.lit("paragraph")))
    keyword = (F.length(t) <= 80) & ~ends(t, ".!?…") & starts(F.lower(t), HEADING_STARTS)
    return F.when(base.isin("heading1", "chapter", "title", "heading"), "heading1").when(base.isin("heading2", "subtitle", "subheading"), "heading2").when(keyword, "heading2").otherwise("paragraph")


# Rules in two forms: of a text, and, under _, of texts that are stripped (t) or in lower case (low) already.
def page_header_footer(c: Column | str) -> Column:
    return once(F.lower(strip(_text(c))), _page_header_footer)


def _page_header_footer(low: Column) -> Column:
    return (low.startswith("страница ") & low.contains(" из ")) | (low.startswith("page ") & low.contains(" of "))


def license_note(c: Column | str) -> Column:
    return once(F.lower(_text(c)), _license_note)


def _license_note(low: Column) -> Column:
    return low.contains("creative commons") | low.contains("open access") | (low.contains("springer nature") & (low.contains("neutral") | low.contains("нейтральн")))


def graphical_abstract(c: Column | str) -> Column:
    return once(F.lower(_text(c)), _graphical_abstract)


def _graphical_abstract(low: Column) -> Column:
    return low.contains("graphical abstract") | (low.contains("графическ") & low.contains("абстрак"))


def looks_heading(c: Column | str) -> Column:
    return once(strip(_text(c)), _looks_heading)


def _looks_heading(t: Column) -> Column:
    opening = (F.length(t) <= 80) & t.rlike(r"^\p{Lu}") & ~ends(t, ".:;")
    return (t != "") & (opening | F.coalesce(upper_ratio(t) > 0.4, F.lit(False)))


def figure_caption(c: Column | str) -> Column:
    return once(F.lower(strip(_text(c))), _figure_caption)


def _figure_caption(low: Column) -> Column:
    return starts(low, FIGURE_STARTS)


def looks_list(c: Column | str) -> Column:
    return once(F.ltrim(_text(c), F.lit(WHITE)), lambda t: _looks_list(t, F.lower(t)))


def _looks_list(t: Column, low: Column) -> Column:
    return t.rlike(r"^[•\-–—*]") | t.rlike(r"(?U)^\(?\d+[.)]\s+") | low.rlike(r"(?U)^[ivxlcdm]+\.\s+")


def table_block(c: Column | str) -> Column:
    full = F.filter(F.transform(lines(_text(c)), strip), lambda x: x != "")
    ruled = (F.size(full) >= 2) & F.forall(full, lambda x: x.contains("|"))
    return F.when(_text(c).contains("|"), ruled).otherwise(_text(c).rlike(r"(?mU)^-{2,}\s+-{2,}"))


def heading_candidate(c: Column | str) -> Column:
    return once(strip(_text(c)), lambda t: (F.length(t) >= 4) & ((F.length(t) < 60) | is_upper(t) | (~ends(t, ".!?") & (F.length(t) < 120))))


def valid_heading(c: Column | str) -> Column:
    return once(strip(F.upper(_text(c))), lambda t: ~t.isin(*NO_CHAPTERS) & F.length(t).between(5, 200))


def text_status(n: Column | str) -> Column:
    return F.when(col(n) == 0, "NO_TEXT").when(col(n) < 300, "WEAK_TEXT").otherwise("TEXT_OK")


def text_density(n: Column | str) -> Column:
    return F.when(col(n) == 0, "NO TEXT").when(col(n) < 100, "WEAK TEXT").otherwise("TEXT OK")


def untranslated(normalized: Column | str, translated: Column | str) -> Column:
    return (first_filled(normalized) != "") & (first_filled(translated) == "")


def bad_formula(kind: Column | str, text: Column | str) -> Column:
    return (col(kind) == "formula") & ~_text(text).contains("=")
