"""Checks of a translation against its source: pairing, checks of rows, totals and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, once, strip

# English terms that should not stay in Russian text, and marks of broken encodings.
SUSPECTS = ("acupuncture", "meridian", "meridians", "chi", "qi", "yin", "yang", "channel", "channels", "fascia", "fascias")
BROKEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f�ÃÂ]"
#: A character that, whatever its case, may count as a Russian letter; a pattern that is searched fast.
CYRILLIC = r"[\u0400-\u1cff]"
ISSUE = ("book_id", "block_id", "page", "order", "type", "severity", "message")


def last_of_id(blocks: DataFrame) -> DataFrame:
    """One row for each id of a book: the last in order."""
    w = Window.partitionBy("book_id", "id").orderBy(F.col("order").desc())
    return blocks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer pairs by (book_id, id): s and t are structs, null where the block is missing."""
    s = last_of_id(source.where("id is not null")).select("book_id", "id", F.struct("page", "order", "text").alias("s"))
    t = last_of_id(target.where("id is not null")).select("book_id", "id", F.struct("page", "order", "translated_text").alias("t"))
    return s.join(t, ["book_id", "id"], "full_outer")


def pair_by_place(source: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks without ids, paired by their place in the book; what one side has more of is left out."""
    w = Window.partitionBy("book_id").orderBy("order")
    s = source.where("id is null").withColumn("n", F.row_number().over(w)).select("book_id", "n", F.struct("page", "order", "text").alias("s"))
    t = target.where("id is null").withColumn("n", F.row_number().over(w)).select("book_id", "n", F.struct("page", "order", "translated_text").alias("t"))
    return s.join(t, ["book_id", "n"]).select("book_id", F.lit(None).cast("string").alias("id"), "s", "t")


def letters(c: Column) -> tuple[Column, Column]:
    """How many Latin and how many Cyrillic letters."""
    low = F.lower(c)
    kept = lambda others: F.length(F.regexp_replace(low, others, ""))
    return kept("[^a-z]+"), kept("[^а-яё]+")


def joined_scripts(c: Column) -> Column:
    """Tokens with letters of both scripts; a text that lacks one of them is not cut into tokens."""
    both = lambda x: x.rlike("(?i)[a-z]") & x.rlike("(?iu)[а-яё]")
    tokens = F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"))
    return F.when(~(c.rlike(CYRILLIC) & both(c)), F.array().cast("array<string>")).otherwise(F.filter(tokens, both))


def suspect_terms(c: Column) -> Column:
    return once(F.lower(c), lambda low: F.filter(F.array(*[F.lit(x) for x in SUSPECTS]), lambda w: low.contains(w)))


def repeated_tokens(c: Column) -> Column:
    """Words that follow themselves, each once, in order."""

    def twins(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.when(a == b, a))

    found = once(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)")), twins)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def rounded(c: Column) -> Column:
    """To three digits by scaling, as SQL engines round doubles: 323 / 80 is under 4.0375, which F.round() takes for it."""
    return F.round(c * 1000) / 1000


def broken_chars(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({BROKEN})"))))


def row_issues(pairs: DataFrame) -> DataFrame:
    """An array of (type, severity, message) for each pair, in the order of the checks."""
    # staged: each text is stripped once, and each search runs once
    pairs = pairs.withColumns({"_src": strip(F.coalesce("s.text", F.lit(""))), "_tgt": strip(F.coalesce("t.translated_text", F.lit("")))})
    src, tgt = F.col("_src"), F.col("_tgt")
    pairs = pairs.withColumns({"_joined": joined_scripts(tgt), "_terms": suspect_terms(tgt), "_twins": repeated_tokens(tgt), "_broken": broken_chars(tgt), "_letters": F.when(tgt.rlike(CYRILLIC), F.struct(*[x.alias(n) for n, x in zip(("latin", "cyrillic"), letters(tgt))]))})
    a, b = F.length(src), F.length(tgt)
    latin, cyrillic = F.col("_letters.latin"), F.col("_letters.cyrillic")
    ratio = b / F.nullif(a, F.lit(0))
    share = lambda x: x / F.nullif(latin + cyrillic, F.lit(0))
    both = (a > 0) & (b > 0)
    issue = lambda when, kind, severity, message: F.when(when, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), message.cast("string").alias("message")))
    low, medium, high = F.lit("low"), F.lit("medium"), F.lit("high")
    joined = lambda x: F.array_join(x, ",")
    checks = [
        issue((b == 0) & (a > 0), "empty_translation", F.when(a > 20, high).otherwise(medium), a),
        issue((a == 0) & (b > 0), "empty_source", medium, b),
        issue(both & ((ratio < 0.3) | (ratio > 3)), "length_mismatch", F.when((ratio < 0.15) | (ratio > 5), high).otherwise(medium), rounded(ratio)),
        issue(F.size("_broken") > 0, "suspicious_chars", medium, joined("_broken")),
        issue((a > 80) & (b > 0) & ~F.substring(tgt, -1, 1).isin(*".!?;:,-–"), "potential_break", low, F.substring(tgt, -1, 1)),
        issue((share(cyrillic) >= 0.5) & (share(latin) >= 0.2), "mixed_alphabet", medium, F.concat_ws(",", rounded(share(latin)), rounded(share(cyrillic)))),
        issue(F.size("_joined") > 0, "concatenated_scripts", medium, joined("_joined")),
        issue(F.size("_terms") > 0, "suspect_terms_en_in_ru", low, joined(F.array_sort("_terms"))),
        issue(F.size("_twins") > 0, "repeated_tokens", low, joined("_twins")),
    ]
    return pairs.withColumn("issues", F.filter(F.array(*checks), lambda x: x.isNotNull())).select("book_id", "id", "s", "t", "issues")


def _checked(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every pair with its issues: pairs by id, of which one side may be missing, and pairs by place."""
    only = lambda when, kind: F.when(when, F.array(F.struct(F.lit(kind).alias("type"), F.lit("high").alias("severity"), F.lit("").alias("message"))))
    rows = row_issues(pair(source, target))
    rows = rows.withColumn("issues", F.coalesce(only(F.col("t").isNull(), "lost_block"), only(F.col("s").isNull(), "extra_block"), F.col("issues")))
    return rows.unionByName(row_issues(pair_by_place(source, target)))


def check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Issues of a book's translation as rows: lost and extra blocks, then what each pair shows."""
    at = lambda c: F.coalesce(f"s.{c}", f"t.{c}").alias(c)
    # outer: else the optimizer puts a filter on the array's size below, which makes every check again from the texts
    rows = _checked(source, target).select("book_id", F.col("id").alias("block_id"), at("page"), at("order"), F.explode_outer("issues").alias("x")).where("x is not null")
    return rows.select("book_id", "block_id", "page", "order", "x.*")


def report(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each book: status, total_blocks, checked, issues_total and issues by severity. The tables are paired once."""
    severe = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s))).alias(s)
    both = F.col("id").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull()
    found = _checked(source, target).groupBy("book_id").agg(F.count_if(both).alias("checked"), F.sum(F.size("issues")).alias("issues_total"), *map(severe, ("high", "medium", "low")))
    totals = source.groupBy("book_id").agg(F.count("*").alias("total_blocks"))
    out = totals.join(found, "book_id", "full_outer").na.fill(0)
    return out.withColumn("status", F.when(F.col("high") > 0, "error").when(F.col("issues_total") > 0, "warn").otherwise("ok"))


def counts(issues: DataFrame, by: str) -> DataFrame:
    return issues.groupBy("book_id", by).agg(F.count("*").alias("n"))


TERMS_AT_ONCE = 1000


def glossary(blocks: DataFrame, terms: DataFrame, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(book_id, id, term): the source holds the term and the translation lacks its counterpart; untranslated blocks are skipped.

    A glossary (term, translation) of up to `at_once` terms goes along as a literal; a larger one is joined on the first
    three characters of its terms, which any text that holds a term holds too.
    """
    rows = blocks.where(first_filled("translated_text") != "").select("book_id", "id", F.coalesce("text", F.lit("")).alias("text"), "translated_text")
    terms = terms.select("term", "translation").where("term <> '' and translation is not null").distinct()
    few = terms.limit(at_once + 1).collect()
    lacks = lambda term, translation: F.col("text").contains(term) & ~F.col("translated_text").contains(translation)
    if not few:
        return rows.select("book_id", "id", F.lit("").alias("term")).limit(0)
    if len(few) <= at_once:
        listed = F.array(*[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["translation"]).alias("translation")) for r in few])
        return rows.select("book_id", "id", F.explode(F.filter(listed, lambda x: lacks(x["term"], x["translation"]))).alias("x")).select("book_id", "id", "x.term")
    grams = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: i + n - 1 <= F.length("text")), lambda i: F.substr(F.col("text"), i, n))))
    keyed = rows.withColumn("key", F.explode(F.array_distinct(grams)))
    return keyed.join(terms.withColumn("key", F.substring("term", 1, 3)), "key").where(lacks(F.col("term"), F.col("translation"))).select("book_id", "id", "term")


def same_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two page tables have as many pages for each book."""
    n = lambda x, name: x.groupBy("book_id").agg(F.count("*").alias(name))
    return n(a, "left_pages").join(n(b, "right_pages"), "book_id", "full_outer").na.fill(0).withColumn("same", F.col("left_pages") == F.col("right_pages"))
