"""Text normalisation and small string functions, as Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and patterns of protected tokens.
SOFT_HYPHEN = "\u00ad"
NBSP = "\u00a0"
#: What \s matches under (?U), the white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FIGURE = r"(?iU)\b(FIG\.?\s*\d+[A-Z]?)\b"
TABLE = r"(?iU)\b(TABLE\.?\s*\d+[A-Z]?)\b"
CITATION = r"(?U)(\[\d+(?:\s*[–-]\s*\d+)?(?:\s*,\s*\d+)*\])"
DOI = r"(?iU)(\b10\.\d{4,9}/\S+\b)"
URL = r"(?U)(https?://\S+)"
RAISED = r"(?U)[A-Za-z0-9]\s*[\u00b2\u00b3\u00b9\u2070-\u209f]"
HAS_RAISED = "__HAS_SUP_INDEX__"
LANGUAGES = (("ru", "rus_Cyrl"), ("en", "eng_Latn"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(col(c), F.lit(WHITE))


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used: a filter repeats what it is pushed through."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_filled(*cs: Column | str) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def lines(c: Column | str) -> Column:
    return F.split(col(c), LINE_BREAKS)


def strip_soft(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit(SOFT_HYPHEN), F.lit("")), F.lit(NBSP), F.lit(" "))


def merge_hyphen(c: Column | str) -> Column:
    """Words broken by a hyphen at a line's end are joined; one pass, as joining makes no new break."""
    return F.regexp_replace(col(c), r"(?U)-(?<=\w-)\n(?=\w)", "")


def normalize_whitespace(c: Column | str) -> Column:
    tidy = F.transform(lines(c), lambda x: strip(F.regexp_replace(x, "[ \t]{2,}|\t", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def protected_tokens(c: Column | str) -> Column:
    """Figures, tables, citations, DOIs and URLs in that order, first occurrences, then the mark of raised digits."""
    found = [F.regexp_extract_all(col(c), F.lit(p)) for p in (FIGURE, TABLE, CITATION, DOI, URL)]
    mark = F.when(col(c).rlike(RAISED), F.array(F.lit(HAS_RAISED))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*found, mark))


def normalize_text(c: Column | str) -> Column:
    return F.coalesce(normalize_whitespace(merge_hyphen(strip_soft(c))), F.lit(""))


def merged_tokens(existing: Column | str, new: Column | str) -> Column:
    """Ordered union of two token lists."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(col(existing), none), F.coalesce(col(new), none)))


def xml_safe(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def clean_model_output(out: Column | str, source: Column | str) -> Column:
    """A model's output without Arabic-script runs and copyright signs; the source where under three characters are left."""
    kept = strip(F.regexp_replace(col(out), r"[\u0600-\u06ff]+|\u00a9", ""))
    return F.when(first_filled(out) == "", col(source)).when(F.length(kept) < 3, col(source)).otherwise(kept)


def unix_text(c: Column | str) -> Column:
    """Line feeds only, stripped; null is empty."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n"))


def pick_text(translated: Column | str, normalized: Column | str, text: Column | str) -> Column:
    return first_filled(translated, normalized, text)


def sha256(c: Column | str) -> Column:
    return F.sha2(F.coalesce(col(c), F.lit("")), 256)


def book_id(content: Column | str) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(col(content), 256), 1, 16)


def basename(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/\\]+)$", 1)


def model_spec(c: Column | str) -> Column:
    """provider:model as a struct; an empty one is (dummy, echo), one without a colon is a provider."""
    s = strip(F.coalesce(col(c), F.lit("")))
    parts = F.split(s, ":", 2)
    provider = F.when(s == "", "dummy").otherwise(F.coalesce(F.nullif(strip(parts[0]), F.lit("")), F.lit("dummy")))
    model = F.when(s == "", "echo").otherwise(F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")))
    return F.struct(provider.alias("provider"), model.alias("model"))


def language_token(c: Column | str) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(LANGUAGES[0][1])
    for prefix, token in LANGUAGES:
        out = F.when(low.startswith(prefix), token).otherwise(out)
    return out


def detection_sample(c: Column | str, most: int = 20_000) -> Column:
    """What book metadata reads to detect a language: the first characters of a long text."""
    return F.substring(col(c), 1, most)


def nfc(c: Column | str) -> Column:
    """Unicode NFC, stripped as Python strips. Spark has no such function, but brings ICU, which needs no Python worker."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col(c), F.lit(False))
    return F.trim(F.when(col(c).isNotNull(), composed), F.lit(WHITE + "\x1c\x1d\x1e\x1f"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters in the sense of difflib, which Levenshtein distance does not give."""
    from difflib import SequenceMatcher

    def ratio(x: str, y: str) -> float:
        # where one text begins the other, its longest match is all of it, and nothing is left to compare
        if x.startswith(y) or y.startswith(x):
            return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 1.0
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


# Frequent words by which a text's language is guessed.
COMMON = {"en": "the of and to in is that for with", "fr": "le la les des et une pour dans que", "de": "der die und das ist nicht ein zu mit", "es": "el los las una que por con para del", "ru": "и в не на что с по как это"}


def detect_language(c: Column | str) -> Column:
    """The language with the most frequent words in the whole text; null if none has any (a heuristic)."""
    every = sorted({w for known in COMMON.values() for w in known.split()})
    # the text is split once, and only words of the lists are looked at again
    found = F.filter(F.split(F.lower(col(c)), r"(?U)[^\w]+"), lambda w: w.isin(*every))

    def best(words: Column) -> Column:
        hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known.split())))
        return F.array_max(F.array(*[F.struct(hits(known).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("lang")) for i, (name, known) in enumerate(COMMON.items())]))

    return once(once(found, best), lambda x: F.when(x["n"] > 0, x["lang"]))
