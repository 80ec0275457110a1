"""Passes over translated text. Each applies from a length on; below it the text stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

QUALITY_FROM, EDITOR_FROM, TERMS_FROM = 400, 200, 80
# Terms and their Russian forms, in the order in which they are replaced, and forms that stay as they are.
KEPT_FORMS = (
    r"Инь\s+и\s+Ян\s*\(Yin\s*&\s*Yang\)",
    r"ци\s*\(Qi\)",
    r"меридиан[а-я]*",
    r"опорно-двигательн[а-я]+\s*\(MSK\)",
    r"сухое\s+иглоукалывание\s*\(DN\)",
    r"традиционная китайская медицина\s*\(ТКМ\)",
)
TERMS = (
    (r"Yin\s*&\s*Yang", "Инь и Ян (Yin & Yang)"),
    ("Qi", "ци (Qi)"),
    ("Chi", "ци (Qi)"),
    ("Yin", "Инь (Yin)"),
    ("Yang", "Ян (Yang)"),
    ("meridians", "меридианы"),
    ("meridian", "меридиан"),
    ("MSK", "опорно-двигательный аппарат (MSK)"),
    ("DN", "сухое иглоукалывание (DN)"),
    ("TCM", "традиционная китайская медицина (ТКМ)"),
)
MISREAD = (("НТакупунктура", "Акупунктура"), ("NТакупунктура", "Акупунктура"))
#: A word character of a private plane: glued to a kept form's Latin word, it takes away the word border.
_GLUE = "\ua78c"
#: What every text that term_pass changes holds: a term's letters, which are found fast, and a term that is a word.
ANY_TERM = f"(?iu)yin|yang|qi|chi|meridian|msk|dn|tcm|{_GLUE}"
WHOLE_TERM = rf"(?iuU)\b(?:yin|yang|qi|chi|meridians?|msk|dn|tcm)\b|{_GLUE}"


def _from(c: Column, least: int, changed: Column) -> Column:
    return F.when(F.length(c) >= least, changed).otherwise(c)


def quality_pass(c: Column | str) -> Column:
    c = col(c)
    s = F.replace(F.translate(c, "\u00a0", " "), F.lit("\u200b"), F.lit(""))
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"\s+([,.!?;:])", "$1")
    s = strip(F.regexp_replace(s, r"\.{3,}", "…"))
    return _from(c, QUALITY_FROM, s)


def split_scripts(c: Column | str) -> Column:
    """A space wherever a token passes from Latin to Cyrillic letters or back; what lies between stays with the left."""
    latin, cyrillic = "A-Za-z", r"\u0400-\u04ff"
    s = F.regexp_replace(col(c), rf"([{latin}][^{latin}{cyrillic}\s]*)(?=[{cyrillic}])", "$1 ")
    return F.regexp_replace(s, rf"([{cyrillic}][^{latin}{cyrillic}\s]*)(?=[{latin}])", "$1 ")


def editor_pass(c: Column | str) -> Column:
    c = col(c)
    s = c
    for wrong, right in MISREAD:
        s = F.regexp_replace(s, rf"(?U)\b{wrong}\b", right)
    # neither a misread word nor a change of scripts is without a Cyrillic letter
    return _from(c, EDITOR_FROM, F.when(c.rlike(r"[\u0400-\u04ff]"), split_scripts(s)).otherwise(c))


def term_pass(c: Column | str) -> Column:
    """English terms become Russian ones, in order, each over what the one before has made; kept forms are left alone."""
    c = col(c)
    s = c
    for form in KEPT_FORMS:
        # every Latin word inside a kept form loses its borders while the terms are replaced
        s = F.regexp_replace(s, f"(?iu)({form})", f"{_GLUE}$1{_GLUE}")
    s = F.regexp_replace(s, rf"(?U)(?<=\()(?=[A-Za-z& ]+\){_GLUE})", _GLUE)
    s = F.regexp_replace(s, rf"(?U)(?<=[A-Za-z])(?=\){_GLUE})", _GLUE)
    s = F.regexp_replace(s, rf"(?U)({_GLUE}Yin)(\s*&\s*)(Yang{_GLUE})", f"$1{_GLUE}$2{_GLUE}$3")
    for term, russian in TERMS:
        s = F.regexp_replace(s, rf"(?iuU)\b{term}\b", russian)
    # a text without any term stays, but for marks of ours
    return _from(c, TERMS_FROM, F.when(c.rlike(ANY_TERM) & c.rlike(WHOLE_TERM), F.replace(s, F.lit(_GLUE), F.lit(""))).otherwise(c))


def preserve_tokens(text: Column | str, tokens: Column | str) -> Column:
    """Tokens that the text so far does not contain are appended in brackets, one after another."""
    none = F.array().cast("array<string>")
    filled = F.filter(F.coalesce(col(tokens), none), lambda t: t.isNotNull() & (strip(t) != ""))
    start = F.coalesce(col(text), F.lit(""))
    return F.aggregate(filled, start, lambda s, t: F.when(s.contains(t), s).otherwise(F.concat(s, F.when(s == "", "").otherwise(" "), F.lit("["), t, F.lit("]"))))
