"""Registered queries over the library's own operators, and the SQL that checks each.

The driver's documents hold none of the marks that the operators look for, so every query works on blocks of all
documents into which marks are put by a rule that both engines can express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as k
from .functions import passes as p
from .functions import split as s
from .functions import text as t
from .operators import blocks as b
from .operators import chapters as ch
from .operators import layout as lay
from .operators import library as lib
from .operators import qa
from .plans import adapters
from .sources import writers

#: What a block becomes where (7 * doc_id + order) % 29 is the number; {t}, {n} and {d} are its text, order and doc_id.
MARKS = {
    0: "{t} See FIG. {n}A and Table {n} [1, 2] and fig. {n}A [3-5, 7]",
    1: "{t} doi 10.1234/abc.{d} https://ex.org/{n}",
    2: "co­op-\nerate  \n\n x-\ny   {t} ",
    3: "1 Introduction {t}",
    4: "Figure {n} shows",
    5: "a | b\nc | d {n}",
    6: "- item {t}",
    7: "Abstract {t}",
    8: "Page {n} of 10",
    9: "This is Open Access content",
    10: "Results:",
    11: "[1] note {n}",
    12: "2) item {n}",
    13: "{t} meridiansвсе Yangи Qi and Yin & Yang, MSK TCM qi qi",
    14: "Chapter {n} The End",
    15: "METHODS AND RESULTS {n}",
    16: "Graphical Abstract",
    17: "Рис. {n} схема",
    18: "tail.",
    19: "short one",
    20: "Title Words {n}",
    21: "H₂O and x² {n}",
}
#: What its translation is where (doc_id + 3 * order) % 17 is the number; elsewhere the text itself.
MUTATIONS = {0: "", 1: "cut", 2: "{t}{t}{t}{t}", 3: "Привет мир все слова и ещё слова {n} abc defghijk", 4: "{t} Ã", 5: "{t} слово слово qi", 6: "{t} bad\x01�"}


def _fill(template: str) -> Column:
    parts, rest = [], template
    while rest:
        at = min((rest.find(x) for x in ("{t}", "{n}", "{d}") if x in rest), default=len(rest))
        if at:
            parts.append(F.lit(rest[:at]))
        if rest[at:]:
            parts.append({"{t}": F.col("text"), "{n}": F.col("order").cast("string"), "{d}": F.col("doc_id").cast("string")}[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return F.concat(*parts) if parts else F.lit("")


def _sql_fill(template: str) -> str:
    q = "'" + template.replace("'", "''") + "'"
    for mark, c in (("{t}", "text"), ("{n}", '"order"::VARCHAR'), ("{d}", "doc_id::VARCHAR")):
        q = q.replace(mark, f"' || {c} || '")
    return f"({q})"


def _cases(number: Column, table: dict[int, str]) -> Column:
    out = F.col("text")
    for i, template in table.items():
        out = F.when(number == i, _fill(template)).otherwise(out)
    return out


def _sql_cases(number: str, table: dict[int, str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {_sql_fill(x)}" for i, x in table.items()) + " ELSE text END"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = b.from_documents(docs).withColumn("text", _cases((7 * F.col("doc_id") + F.col("order")) % 29, MARKS))
    target = _cases((F.col("doc_id") + 3 * F.col("order")) % 17, MUTATIONS)
    return marked.withColumns({"translated_text": target, "type": k.block_type("text")})


BLOCKS = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS "order" FROM documents),
plain AS (SELECT doc_id::VARCHAR AS book_id, doc_id, "order", text, ("order" // 4 + 1)::INTEGER AS page, ("order" % 4)::INTEGER AS idx FROM lines WHERE trim(text) <> ''),
marked AS (SELECT * REPLACE ({_sql_cases('(7 * doc_id + "order") % 29', MARKS)} AS text), 'p' || page || '_b' || idx AS id FROM plain),
blocks AS (SELECT *, {_sql_cases('(doc_id + 3 * "order") % 17', MUTATIONS)} AS translated_text, CASE WHEN trim(text) LIKE '%:' THEN 'heading' ELSE 'text' END AS type,
  (50 + 250 * ("order" % 2))::DOUBLE AS x0, (40 * ("order" // 2))::DOUBLE AS y0 FROM marked)
"""
KEYS = ("book_id", "id")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; sql follows WITH blocks AS ..."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = f"WITH {BLOCKS} {sql}"
        return f

    return add


def row_query(name: str, value, sql: str, alias: str = "value") -> None:
    """A query of one expression (made when it is asked for) over each block."""
    QUERIES[name] = lambda spark, sf_dir: blocks(spark, sf_dir).select(*KEYS, value().alias(alias))
    ORACLE_SQL[name] = f"WITH {BLOCKS} SELECT book_id, id, {sql} AS {alias} FROM blocks"


W = r"[\p{L}\p{N}_]"
_strip = lambda c: f"regexp_replace({c}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
SQL_SOFT = "replace(replace(text, chr(173), ''), chr(160), ' ')"
SQL_HYPHEN = lambda c: rf"regexp_replace(regexp_replace({c}, '({W})-\n({W})', '\1\2', 'g'), '({W})-\n({W})', '\1\2', 'g')"
SQL_SPACE = lambda c: r"array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))".replace("{}", c)
SQL_NORMAL = SQL_SPACE(SQL_HYPHEN(SQL_SOFT))
_all = lambda c, pattern: f"regexp_extract_all({c}, '{pattern}')"
SQL_TOKENS = "list_concat(list_concat(list_concat(list_concat(list_concat({0}, {1}), {2}), {3}), {4}), CASE WHEN regexp_matches(n, '[A-Za-z0-9]\\s*[²³¹⁰-₟]') THEN ['__HAS_SUP_INDEX__'] ELSE [] END)".format(
    _all("n", r"(?i)\bFIG\.?\s*\d+[A-Z]?\b"), _all("n", r"(?i)\bTABLE\.?\s*\d+[A-Z]?\b"), _all("n", r"\[\d+(?:\s*[–-]\s*\d+)?(?:\s*,\s*\d+)*\]"), _all("n", r"(?i)\b10\.\d{4,9}/\S+\b"), _all("n", r"https?://\S+")
)

row_query("norm_strip_soft", lambda: t.strip_soft("text"), SQL_SOFT)
row_query("norm_merge_hyphen", lambda: t.merge_hyphen("text"), SQL_HYPHEN("text"))
row_query("norm_whitespace", lambda: t.normalize_whitespace(t.strip_soft("text")), SQL_SPACE(SQL_SOFT))
row_query("normalize_text", lambda: t.normalize_text("text"), SQL_NORMAL)
_CONTROL = "".join(map(chr, range(1, 33)))
row_query("xml_sanitize", lambda: t.xml_safe(F.concat("translated_text", F.lit(_CONTROL))), "translated_text || chr(9) || chr(10) || chr(13) || ' '".replace("translated_text", "replace(translated_text, chr(1), '')"))
row_query("text_sha256", lambda: t.sha256("text"), "sha256(text)")
row_query("pick_text", lambda: t.pick_text("translated_text", F.lit(None).cast("string"), "text"), "CASE WHEN translated_text <> '' THEN translated_text ELSE text END")
row_query("unicode_nfc", lambda: t.nfc("text"), "trim(nfc_normalize(text), ' ' || chr(10))")
row_query("block_type", lambda: k.block_type("text"), "CASE WHEN trim(text) LIKE '%:' THEN 'heading' ELSE 'text' END")
row_query("list_item", lambda: k.list_item("text"), rf"regexp_matches({_strip('text')}, '^[-*•∙·] ') OR regexp_matches({_strip('text')}, '^\d+[.)]\s+')")
row_query("list_text_v1", lambda: k.list_text_v1("text"), rf"CASE WHEN regexp_matches({_strip('text')}, '^([•*‣-]\s+|\d{{1,2}}[.)]\s+)') THEN regexp_replace({_strip('text')}, '^([•*‣-]\s+|\d{{1,2}}[.)]\s+)', '') END")
SQL_HEADER = "lower(text) LIKE 'page % of %' OR lower(text) LIKE 'страница % из %'"
row_query("page_header_footer", lambda: k.page_header_footer("text"), SQL_HEADER)
SQL_LICENSE = "lower(text) LIKE '%creative commons%' OR lower(text) LIKE '%open access%' OR (lower(text) LIKE '%springer nature%' AND lower(text) LIKE '%neutral%')"
row_query("license_note", lambda: k.license_note("text"), SQL_LICENSE)
SQL_GRAPHICAL = "lower(text) LIKE '%graphical abstract%'"
row_query("graphical_abstract", lambda: k.graphical_abstract("text"), SQL_GRAPHICAL)
SQL_CAPTION = "regexp_matches(lower(text), '^\\s*(figure |рисунок|рис\\.)')"
row_query("figure_caption", lambda: k.figure_caption("text"), SQL_CAPTION)
SQL_LIST = rf"regexp_matches({_strip('text')}, '^[•*–—-]') OR regexp_matches({_strip('text')}, '^\(?\d+[.)]\s+') OR regexp_matches(lower({_strip('text')}), '^[ivxlcdm]+\.\s+')"
row_query("looks_list", lambda: k.looks_list("text"), SQL_LIST)
SQL_TABLE = "CASE WHEN contains(text, '|') THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT contains(x, '|'))) = 0 ELSE false END"
row_query("table_block", lambda: k.table_block("text"), SQL_TABLE)
row_query("heading_candidate", lambda: k.heading_candidate("text"), f"(WITH x AS (SELECT {_strip('text')} AS t) SELECT length(t) >= 4 AND (length(t) < 60 OR (upper(t) = t AND lower(t) <> t) OR (NOT regexp_matches(t, '[.!?]$') AND length(t) < 120)) FROM x)")
row_query(  # upper case has sharp s as two letters
    "valid_heading", lambda: k.valid_heading(F.when(F.col("order") % 3 == 0, " Введение ").when(F.col("order") % 3 == 1, "список литературы").otherwise(F.col("text"))),
    f"""CASE WHEN "order" % 3 < 2 THEN false ELSE length(replace({_strip('text')}, 'ß', 'SS')) BETWEEN 5 AND 200 END""",
)
row_query("untranslated", lambda: k.untranslated("text", "translated_text"), "text <> '' AND translated_text = ''")
row_query("role_v1", lambda: k.role_v1("text", F.lit("paragraph")), rf"CASE WHEN length({_strip('text')}) <= 80 AND NOT regexp_matches({_strip('text')}, '[.!?…]$') AND regexp_matches(lower({_strip('text')}), '^(abstract|summary|keywords|graphical abstract)') THEN 'heading2' ELSE 'paragraph' END")
row_query("preserve_tokens", lambda: p.preserve_tokens("translated_text", F.array(F.lit("FIG. 1"), F.lit("the"), F.lit("FIG. 1A"), F.lit(" "))), """
  (WITH a AS (SELECT translated_text AS s), b AS (SELECT CASE WHEN contains(s, 'FIG. 1') THEN s ELSE s || CASE WHEN s = '' THEN '' ELSE ' ' END || '[FIG. 1]' END AS s FROM a),
   c AS (SELECT CASE WHEN contains(s, 'the') THEN s ELSE s || ' [the]' END AS s FROM b) SELECT CASE WHEN contains(s, 'FIG. 1A') THEN s ELSE s || ' [FIG. 1A]' END FROM c)""")
row_query("language_token", lambda: t.language_token(F.when(F.col("order") % 3 == 0, "ru_RU").when(F.col("order") % 3 == 1, "EN").otherwise("xx")), """CASE WHEN "order" % 3 = 1 THEN 'eng_Latn' ELSE 'rus_Cyrl' END""")


@query(f"""SELECT book_id, id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '~') AS tokens FROM (SELECT book_id, id, {SQL_TOKENS} AS x FROM (SELECT book_id, id, {SQL_NORMAL} AS n FROM blocks))""")
def protected_tokens(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, F.array_join(t.protected_tokens(t.normalize_text("text")), "~").alias("tokens"))


@query(f"""SELECT book_id, id, CASE WHEN t = '' OR length(t) > 120 OR t LIKE '%.' OR regexp_matches(t, '^\\d') OR NOT ((NOT regexp_matches(t, '\\s') AND length(t) <= 40 OR length(t) <= 70) AND regexp_matches(t, '\\p{{Lu}}')) THEN 'paragraph'
  WHEN ("order" <= 2 AND page <= 3) OR (upper(t) = t AND lower(t) <> t AND length(t) <= 80) THEN 'heading1' ELSE 'heading2' END AS role FROM (SELECT *, {_strip("text")} AS t FROM blocks)""")
def heading_level(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, k.heading_level("text", "page", "order").alias("role"))


@query(f"""SELECT book_id, id, CASE WHEN t = '' THEN 'paragraph' WHEN regexp_matches(t, '^[-*•∙·] ') OR regexp_matches(t, '^\\d+[.)]\\s+') THEN 'list_item'
  WHEN length(t) <= 120 AND regexp_matches(lower(t), '^(рис\\.|figure|fig\\.|табл\\.|table)') THEN 'caption' WHEN length(t) <= 200 AND regexp_matches(t, '^\\[\\d+\\]\\s+') THEN 'footnote'
  WHEN length(t) <= 120 AND NOT contains(t, chr(10)) AND NOT regexp_matches(t, '[.?!;:]$') THEN CASE WHEN length(t) <= 60 THEN 'heading' ELSE 'subtitle' END
  WHEN length(t) <= 120 AND NOT contains(t, chr(10)) AND t LIKE '%:' THEN 'heading'
  WHEN length(t) <= 80 AND length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g'))) > 0.7 THEN 'heading' ELSE 'paragraph' END AS role FROM (SELECT *, {_strip("text")} AS t FROM blocks)""")
def block_role(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, k.role("text", "type").alias("role"))


@query(f"""SELECT book_id, id, t <> '' AND ((length(t) <= 80 AND regexp_matches(t, '^\\p{{Lu}}') AND NOT regexp_matches(t, '[.:;]$')) OR coalesce(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')), 0) > 0.4, false)) AS value FROM (SELECT *, {_strip("text")} AS t FROM blocks)""")
def looks_heading(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, k.looks_heading("text").alias("value"))


@query(r"""SELECT book_id, id, CASE WHEN length(x) >= 400 THEN trim(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(160), ' '), '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g'), '\.{3,}', '…', 'g')) ELSE x END AS value FROM (SELECT *, text || ' , ' || text || '....' AS x FROM blocks)""")
def quality_pass(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, p.quality_pass(F.concat("text", F.lit(" , "), "text", F.lit("...."))).alias("value"))


_LC = r"([A-Za-z][^A-Za-zЀ-ӿ\s]*)([Ѐ-ӿ])"
_CL = r"([Ѐ-ӿ][^A-Za-zЀ-ӿ\s]*)([A-Za-z])"


@query(rf"""SELECT book_id, id, CASE WHEN length(x) >= 200 THEN regexp_replace(regexp_replace(replace(replace(x, ' НТакупунктура,', ' Акупунктура,'), ' NТакупунктура ', ' Акупунктура '), '{_LC}', '\1 \2', 'g'), '{_CL}', '\1 \2', 'g') ELSE x END AS value FROM (SELECT *, 'a НТакупунктура, b NТакупунктура c NТакупунктуры ' || text AS x FROM blocks)""")
def editor_pass(spark, sf_dir):
    """Both misread words stand in every text, and one form of them that is no such word."""
    return blocks(spark, sf_dir).select(*KEYS, p.editor_pass(F.concat(F.lit("a НТакупунктура, b NТакупунктура c NТакупунктуры "), "text")).alias("value"))


_MARK = chr(2)


def _sql_terms() -> str:
    # RE2's \b is ASCII only, so the SQL takes the border characters as groups (twice: neighbours share one)
    c = "text"
    for term, russian in p.TERMS:
        for _ in range(1 if "&" in russian else 2):  # the first form holds its own term
            c = rf"regexp_replace({c}, '(?i)(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])', '\1{russian}\2', 'g')" if not russian.endswith(f"({term})") else rf"replace(regexp_replace({c}, '(?i)(^|[^\p{{L}}\p{{N}}_\x02]){term}($|[^\p{{L}}\p{{N}}_])', '\1{russian[: -len(term) - 1]}{_MARK}{term})\2', 'g'), '{_MARK}{_MARK}', '{_MARK}')"
        c = f"replace({c}, '{_MARK}', '')"
    return f"CASE WHEN length(text) >= 80 THEN {c} ELSE text END"


@query(f"SELECT book_id, id, {_sql_terms()} AS value FROM blocks")
def term_pass(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, p.term_pass("text").alias("value"))


@query("""SELECT book_id, page, text_len, CASE WHEN text_len = 0 THEN 'NO_TEXT' WHEN text_len < 300 THEN 'WEAK_TEXT' ELSE 'TEXT_OK' END AS status, CASE WHEN text_len = 0 THEN 'NO TEXT' WHEN text_len < 100 THEN 'WEAK TEXT' ELSE 'TEXT OK' END AS density
  FROM (SELECT book_id, page, sum(length(text))::BIGINT AS text_len FROM blocks GROUP BY ALL)""")
def preflight(spark, sf_dir):
    return b.page_lengths(blocks(spark, sf_dir))


@query("""SELECT book_id, count(*) FILTER (n >= 300) AS TEXT_OK, count(*) FILTER (n > 0 AND n < 300) AS WEAK_TEXT, count(*) FILTER (n = 0) AS NO_TEXT, 0::BIGINT AS OTHER FROM (SELECT book_id, page, sum(length(text)) AS n FROM blocks GROUP BY ALL) GROUP BY book_id""")
def status_histogram(spark, sf_dir):
    return b.status_histogram(b.page_lengths(blocks(spark, sf_dir)))


@query("SELECT book_id, page, count(*) AS blocks FROM blocks GROUP BY ALL")
def blocks_per_page(spark, sf_dir):
    return b.blocks_per_page(blocks(spark, sf_dir))


@query("""SELECT book_id, type AS role, count(*) AS n FROM blocks GROUP BY ALL""")
def roles_count(spark, sf_dir):
    return b.role_counts(blocks(spark, sf_dir).withColumn("role", F.col("type")))


@query("""SELECT book_id, id, (row_number() OVER (PARTITION BY book_id ORDER BY page, idx) - 1)::INTEGER AS "order" FROM blocks""")
def global_order(spark, sf_dir):
    return b.global_order(blocks(spark, sf_dir)).select(*KEYS, "order")


@query("""SELECT book_id, id, ((row_number() OVER (PARTITION BY book_id ORDER BY "order") - 1) // 8)::BIGINT AS batch FROM blocks""")
def row_batches(spark, sf_dir):
    return b.batches(blocks(spark, sf_dir), 8).select(*KEYS, "batch")


@query("""SELECT book_id, page AS number, string_agg(id, ',' ORDER BY "order") AS blocks FROM blocks GROUP BY ALL""")
def pages_layer(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    pages = rows.select("book_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return b.pages_layer(rows, pages).select("book_id", "number", F.array_join("blocks", ",").alias("blocks"))


@query("""SELECT book_id, id, page AS page_number, type, text AS raw_text, '' AS normalized_text, translated_text, x0, y0, CASE WHEN "order" % 2 = 0 THEN 'T' || "order" END AS tokens FROM blocks""")
def blocks_layer(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("protected_tokens", F.when(F.col("order") % 2 == 0, F.array(F.concat(F.lit("T"), "order"))))
    return b.blocks_layer(rows).select("*", "bbox.x0", "bbox.y0", F.array_join("metadata.protected_tokens", ",").alias("tokens")).drop("bbox", "metadata")


@query("""SELECT book_id, count(DISTINCT page) AS n_pages, count(*) AS n_blocks, string_agg(id, ',' ORDER BY page, "order") AS ids FROM blocks GROUP BY book_id""")
def layout_model(spark, sf_dir):
    model = b.layout_model(blocks(spark, sf_dir))
    each = F.transform("pages", lambda x: F.array_join(x["blocks"]["id"], ","))
    return model.select("book_id", F.size("pages").cast("long").alias("n_pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + F.size(x["blocks"])).alias("n_blocks"), F.array_join(each, ",").alias("ids"))


def _pair(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    source = rows.where((F.col("doc_id") + F.col("order")) % 19 != 0)
    target = rows.where((3 * F.col("doc_id") + F.col("order")) % 23 != 0)
    return source, target


SQL_PAIR = """, src AS (SELECT * FROM blocks WHERE (doc_id + "order") % 19 <> 0), tgt AS (SELECT * FROM blocks WHERE (3 * doc_id + "order") % 23 <> 0),
pairs AS (SELECT coalesce(s.book_id, t.book_id) AS book_id, coalesce(s.id, t.id) AS block_id, coalesce(s.page, t.page) AS page, coalesce(s."order", t."order") AS "order", s.id AS sid, t.id AS tid,
  regexp_replace(coalesce(s.text, ''), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS a, regexp_replace(coalesce(t.translated_text, ''), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS b FROM src s FULL JOIN tgt t ON s.book_id = t.book_id AND s.id = t.id),
n AS (SELECT *, length(a) AS la, length(b) AS lb, length(regexp_replace(lower(b), '[^a-z]', '', 'g')) AS lat, length(regexp_replace(lower(b), '[^а-яё]', '', 'g')) AS cyr FROM pairs),
issues AS (
  SELECT *, 'lost_block' AS type, 'high' AS severity, '' AS message FROM n WHERE tid IS NULL
  UNION ALL SELECT *, 'extra_block', 'high', '' FROM n WHERE sid IS NULL
  UNION ALL SELECT *, 'empty_translation', CASE WHEN la > 20 THEN 'high' ELSE 'medium' END, la::VARCHAR FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND lb = 0 AND la > 0
  UNION ALL SELECT *, 'empty_source', 'medium', lb::VARCHAR FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND la = 0 AND lb > 0
  UNION ALL SELECT *, 'length_mismatch', CASE WHEN lb / la < 0.15 OR lb / la > 5 THEN 'high' ELSE 'medium' END, round(lb / la, 3)::VARCHAR FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND la > 0 AND lb > 0 AND (lb / la < 0.3 OR lb / la > 3)
  UNION ALL SELECT *, 'suspicious_chars', 'medium', array_to_string(list_sort(list_distinct(regexp_extract_all(b, '[\\x{01}-\\x{08}\\x{FFFD}ÃÂ]'))), ',') FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND regexp_matches(b, '[\\x{01}-\\x{08}\\x{FFFD}ÃÂ]')
  UNION ALL SELECT *, 'potential_break', 'low', right(b, 1) FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND la > 80 AND lb > 0 AND NOT regexp_matches(b, '[.!?;:,–-]$')
  UNION ALL SELECT *, 'mixed_alphabet', 'medium', round(lat / (lat + cyr), 3)::VARCHAR || ',' || round(cyr / (lat + cyr), 3)::VARCHAR FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND lat + cyr > 0 AND cyr / (lat + cyr) >= 0.5 AND lat / (lat + cyr) >= 0.2
  UNION ALL SELECT *, 'concatenated_scripts', 'medium', array_to_string(list_filter(regexp_extract_all(b, '\\S+'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(lower(x), '[а-яё]')), ',') FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND len(list_filter(regexp_extract_all(b, '\\S+'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(lower(x), '[а-яё]'))) > 0
  UNION ALL SELECT *, 'suspect_terms_en_in_ru', 'low', array_to_string(list_sort(list_filter(['acupuncture','meridian','meridians','chi','qi','yin','yang','channel','channels','fascia','fascias'], lambda w: contains(lower(b), w))), ',') FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL AND regexp_matches(lower(b), 'acupuncture|meridian|chi|qi|yin|yang|channel|fascia')
)"""


@query(SQL_PAIR + """ SELECT book_id, block_id, page, "order", type, severity, message FROM issues""")
def qa_issues(spark, sf_dir):
    return qa.check(*_pair(spark, sf_dir)).where("type <> 'repeated_tokens'").withColumn("message", F.col("message"))


@query(SQL_PAIR + """ SELECT book_id, type, count(*) AS n FROM issues GROUP BY ALL""")
def qa_issues_by_type(spark, sf_dir):
    return qa.counts(qa.check(*_pair(spark, sf_dir)).where("type <> 'repeated_tokens'"), "type")


@query(SQL_PAIR + """ SELECT book_id, severity, count(*) AS n FROM issues GROUP BY ALL""")
def qa_issues_by_severity(spark, sf_dir):
    return qa.counts(qa.check(*_pair(spark, sf_dir)).where("type <> 'repeated_tokens'"), "severity")


@query(SQL_PAIR + """, w AS (SELECT book_id, block_id, regexp_extract_all(lower(b), '[\\p{L}\\p{N}_]+') AS w FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL),
  d AS (SELECT book_id, block_id, list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x) AS d FROM w) SELECT book_id, block_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS message FROM d WHERE len(d) > 0""")
def qa_repeated_tokens(spark, sf_dir):
    return qa.check(*_pair(spark, sf_dir)).where("type = 'repeated_tokens'").select("book_id", "block_id", "message")


@query(SQL_PAIR + """, rep AS (SELECT book_id, count(*) AS r FROM (SELECT book_id, regexp_extract_all(lower(b), '[\\p{L}\\p{N}_]+') AS w FROM n WHERE sid IS NOT NULL AND tid IS NOT NULL) WHERE len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) > 0 GROUP BY book_id),
  tot AS (SELECT book_id, count(*) FILTER (sid IS NOT NULL) AS total_blocks, count(*) FILTER (sid IS NOT NULL AND tid IS NOT NULL) AS checked FROM n GROUP BY book_id),
  iss AS (SELECT book_id, count(*) AS i, count(*) FILTER (severity = 'high') AS high FROM issues GROUP BY book_id)
  SELECT tot.book_id, total_blocks, checked, (coalesce(i, 0) + coalesce(r, 0))::BIGINT AS issues_total, CASE WHEN coalesce(high, 0) > 0 THEN 'error' WHEN coalesce(i, 0) + coalesce(r, 0) > 0 THEN 'warn' ELSE 'ok' END AS status FROM tot LEFT JOIN iss USING (book_id) LEFT JOIN rep USING (book_id)""")
def qa_report(spark, sf_dir):
    return qa.report(*_pair(spark, sf_dir)).select("book_id", "total_blocks", "checked", "issues_total", "status")


@query("""SELECT book_id, id, term FROM blocks, (VALUES ('of', 'de'), ('Figure', 'Abbildung'), ('qi', 'ци')) g(term, translation) WHERE translated_text <> '' AND contains(text, term) AND NOT contains(translated_text, translation)""")
def glossary_check(spark, sf_dir):
    terms = spark.createDataFrame([("of", "de"), ("Figure", "Abbildung"), ("qi", "ци")], "term string, translation string")
    return qa.glossary(blocks(spark, sf_dir), terms)


SQL_COLUMNS = """, m AS (SELECT *, count(*) OVER w AS c, max(x0) OVER w - min(x0) OVER w AS spread, list(x0 ORDER BY x0) OVER (PARTITION BY book_id, page) AS xs FROM blocks WINDOW w AS (PARTITION BY book_id, page)),
placed AS (SELECT *, (row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN spread < 120 THEN 0 ELSE (x0 > list_sort(xs)[c // 2 + 1])::INTEGER END, y0, "order") - 1)::INTEGER AS place FROM m)"""


@query(SQL_COLUMNS + " SELECT book_id, id, place FROM placed")
def column_order(spark, sf_dir):
    return lay.column_order(blocks(spark, sf_dir)).select(*KEYS, "place")


_NUMBERED = r"^\s*(\d+[.)]?)\s+([A-ZА-ЯЁ][\p{L}\p{M}\p{N}_\-() ]{2,60})\s+(.*)$"
_TITLED = r"^\s*(\d+(?:\.\d+)*[.)]?)\s+([A-ZА-ЯЁ][^\n]{0,120})(?:\s+(.+))?"
_part = lambda pattern, i: _strip(f"regexp_extract(text, '{pattern}', {i})")
SQL_STRUCTURAL = f"""CASE WHEN regexp_matches(lower(text), '^(глава|chapter)\\s+\\d+\\b') THEN {{'head': text, 'body': ''}}
  WHEN regexp_matches(text, '{_NUMBERED}') THEN {{'head': {_part(_NUMBERED, 1)} || ' ' || {_part(_NUMBERED, 2)}, 'body': {_part(_NUMBERED, 3)}}}
  WHEN regexp_matches(text, '{_TITLED}') THEN {{'head': {_part(_TITLED, 1)} || ' ' || {_part(_TITLED, 2)}, 'body': CASE WHEN length({_part(_TITLED, 3)}) > 10 THEN {_part(_TITLED, 3)} ELSE '' END}}
  ELSE {{'head': '', 'body': ''}} END"""
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
_ROWS = f"list_transform({_LINES}, lambda x: list_transform(string_split(x, '|'), lambda y: {_strip('y')}))"
_HEADING = r"(length(text) <= 80 AND regexp_matches(text, '^\p{Lu}') AND NOT regexp_matches(text, '[.:;]$')) OR coalesce(len(regexp_extract_all(text, '\p{Lu}')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0) > 0.4, false)"
#: Paragraphs of every block, n1..n3 their place on a page; cols: the widest row of a table.
SQL_PARAGRAPHS = f"""{SQL_COLUMNS}, stripped AS (SELECT book_id, page, place, {_strip("translated_text")} AS text FROM placed),
opened AS (SELECT *, regexp_extract(lower(text), '^(аннотация|abstract|резюме|summary)( |$)', 1) AS word FROM stripped),
kinds AS (SELECT *, CASE WHEN text = '' OR {SQL_HEADER} OR {SQL_LICENSE} OR {SQL_GRAPHICAL} THEN 'none' WHEN word <> '' THEN 'abstract' WHEN {SQL_CAPTION} THEN 'caption' WHEN {SQL_TABLE} THEN 'table'
  WHEN ({SQL_STRUCTURAL}).head <> '' THEN 'structural' WHEN {SQL_LIST} THEN 'list_item' WHEN {_HEADING} THEN 'heading2' ELSE 'paragraph' END AS kind FROM opened),
two AS (SELECT *, CASE kind WHEN 'abstract' THEN {{'head': CASE word WHEN 'abstract' THEN 'Abstract' WHEN 'summary' THEN 'Summary' WHEN 'резюме' THEN 'Резюме' ELSE 'Аннотация' END, 'body': CASE WHEN length({_strip("substr(text, length(word) + 1)")}) > 10 THEN {_strip("substr(text, length(word) + 1)")} ELSE '' END}} ELSE {SQL_STRUCTURAL} END AS hb FROM kinds WHERE kind IN ('abstract', 'structural')),
paragraphs AS (SELECT book_id, page, 1 AS n1, place AS n2, 0 AS n3, 'heading2' AS type, hb.head AS text, NULL::INTEGER AS cols FROM two
  UNION ALL SELECT book_id, page, 1, place, 1, 'paragraph', hb.body, NULL FROM two WHERE hb.body <> ''
  UNION ALL SELECT book_id, page, 1, place, 0, 'table', CASE WHEN {_ROWS} = [] THEN '[TABLE]' ELSE substr(array_to_string(list_transform(({_ROWS})[:3], lambda r: array_to_string(r, ' | ')), ' / '), 1, 200) END, list_max(list_transform({_ROWS}, lambda r: len(r)))::INTEGER FROM kinds WHERE kind = 'table'
  UNION ALL SELECT book_id, page, 1, place, 0, kind, text, NULL FROM kinds WHERE kind IN ('caption', 'list_item', 'heading2', 'paragraph')
  UNION ALL SELECT book_id, page, 0, 0, 0, 'figure', 'Graphical Abstract — Figure ' || row_number() OVER (PARTITION BY book_id ORDER BY page), NULL FROM (SELECT DISTINCT book_id, page FROM stripped WHERE {SQL_GRAPHICAL}))"""
#: The stream: a fold over each book's paragraphs, in which a short one joins the row before it while that has room.
_ROW = "{'type': type, 'text': text, 'page': page, 'cols': cols}"
_NO_ROWS = "[]::STRUCT(type VARCHAR, text VARCHAR, page INTEGER, cols INTEGER)[]"
_FOLD = "CASE WHEN x.now.type = 'paragraph' AND length(x.now.text) < 40 AND length(a.now.text) < 90 THEN {'done': a.done, 'now': {'type': a.now.type, 'text': a.now.text || ' ' || x.now.text, 'page': a.now.page, 'cols': a.now.cols}} ELSE {'done': list_append(a.done, a.now), 'now': x.now} END"
SQL_STREAM = f"""{SQL_PARAGRAPHS}, folded AS (SELECT book_id, list_reduce(list({{'done': {_NO_ROWS}, 'now': {_ROW}}} ORDER BY page, n1, n2, n3), lambda a, x: {_FOLD}) AS z FROM paragraphs GROUP BY book_id),
stream AS (SELECT book_id, generate_subscripts(list_append(z.done, z.now), 1)::INTEGER - 1 AS seq, unnest(list_append(z.done, z.now)) AS p FROM folded)"""


@query(SQL_STREAM + " SELECT book_id, seq, p.type AS type, p.text AS text, p.page AS page FROM stream")
def paragraph_stream(spark, sf_dir):
    return lay.paragraph_stream(blocks(spark, sf_dir)).select("book_id", "seq", "type", "text", "page")


@query(SQL_PARAGRAPHS + " SELECT book_id, page, n1, n2, n3, type, text FROM paragraphs")
def block_to_paragraphs(spark, sf_dir):
    return lay.paragraph_rows(blocks(spark, sf_dir)).select("book_id", "page", "n1", "n2", "n3", "type", "text")


_SQL_PLAIN = f"""SELECT * REPLACE (CASE WHEN "order" % 5 = 0 THEN '1 Intro' || chr(10) || text ELSE text END AS text, CASE WHEN "order" % 10 = 0 THEN '' WHEN "order" % 5 = 0 THEN '1 Введение ' || translated_text ELSE translated_text END AS translated_text),
  CASE WHEN "order" % 15 = 5 THEN '' WHEN "order" % 5 = 0 THEN ' 1 Intro' || chr(10) || text ELSE text END AS normalized_text, CASE WHEN "order" % 11 = 3 THEN 'Subtitle' ELSE '' END AS role FROM blocks"""


def _sql_packed(sentences: str, most: int, blanks: bool) -> str:
    """Greedy packing of a list of sentences, as a fold over the list."""
    cuts = f"list_transform(range(0, length(x.now), {most}), lambda i: {_strip(f'substr(x.now, i + 1, {most})')})"
    cuts = cuts if blanks else f"list_filter({cuts}, lambda y: y <> '')"
    flushed = "CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END"
    joined = "CASE WHEN a.now = '' THEN x.now ELSE a.now || ' ' || x.now END"
    none = "[]::VARCHAR[]"
    step = f"CASE WHEN length(x.now) > {most} THEN {{'done': list_concat({flushed}, {cuts}), 'now': ''}} WHEN length({joined}) <= {most} THEN {{'done': a.done, 'now': {joined}}} ELSE {{'done': {flushed}, 'now': x.now}} END"
    items = f"list_prepend({{'done': {none}, 'now': ''}}, list_transform(list_filter({sentences}, lambda y: y <> ''), lambda y: {{'done': {none}, 'now': y}}))"
    return f"(WITH f AS (SELECT list_reduce({items}, lambda a, x: {step}) AS z) SELECT CASE WHEN z.now = '' THEN z.done ELSE list_append(z.done, z.now) END FROM f)"


def _sql_sentences(c: str) -> str:
    return f"list_transform(string_split(regexp_replace({c}, '([.!?…])[\\s\\x{{A0}}]+', '\\1' || chr(2), 'g'), chr(2)), lambda y: {_strip('y')})"


@query(rf""", given AS ({_SQL_PLAIN}),
texts AS (SELECT book_id, page, "order", id, role, {_strip("CASE WHEN translated_text <> '' THEN translated_text ELSE text END")} AS t, {_strip("CASE WHEN normalized_text <> '' THEN normalized_text ELSE text END")} AS src FROM given),
cut AS (SELECT *, regexp_extract(t, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 1) AS h, {_strip(r"regexp_extract(t, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 2)")} AS bd FROM texts),
split AS (SELECT *, regexp_matches(src, '^\d+[.)]?\s+\S+') AND strpos(src, chr(10)) BETWEEN 1 AND 81 AND h <> '' AND length(h) <= 80 AND bd <> '' AS two FROM cut),
bodies AS (SELECT *, CASE WHEN two THEN bd ELSE t END AS r, CASE WHEN lower(role) IN ('heading1', 'chapter', 'title', 'heading') THEN 'heading1' WHEN lower(role) IN ('heading2', 'subtitle', 'subheading') THEN 'heading2'
  WHEN length(t) <= 80 AND NOT regexp_matches(t, '[.!?…]$') AND regexp_matches(lower(t), '^(abstract|резюме|аннотация|summary|keywords|ключевые слова|graphical abstract|графическая абстракция)') THEN 'heading2' ELSE 'paragraph' END AS kind FROM split),
parts AS (SELECT book_id, page, "order", id, 0 AS n, 'heading2' AS k, h AS x FROM bodies WHERE two
  UNION ALL SELECT book_id, page, "order", id, 1, CASE WHEN r = '' THEN 'empty' WHEN NOT two AND kind <> 'paragraph' THEN kind WHEN regexp_matches(r, '^([•*‣-]|\d{{1,2}}[.)])\s+') THEN 'list_item' WHEN length(r) > 800 THEN 'long' ELSE 'body' END,
  CASE WHEN (two OR kind = 'paragraph') AND regexp_matches(r, '^([•*‣-]|\d{{1,2}}[.)])\s+') THEN {_strip(r"regexp_replace(r, '^([•*‣-]|\d{1,2}[.)])\s+', '')")} ELSE r END FROM bodies),
seen AS (SELECT *, lag(k) OVER w AS bk, lag(regexp_matches(x, '[.!?…]$')) OVER w AS ended FROM parts WINDOW w AS (PARTITION BY book_id ORDER BY page, "order", id, n)),
numbered AS (SELECT *, sum(CASE WHEN k <> 'body' OR bk IS NULL OR bk <> 'body' OR ended THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page, "order", id, n) AS g FROM seen),
joined AS (SELECT book_id, g, first(page ORDER BY page, "order", id, n) AS page, first(k ORDER BY page, "order", id, n) AS k, string_agg(x, ' ' ORDER BY page, "order", id, n) AS text FROM numbered WHERE k <> 'empty' GROUP BY book_id, g),
listed AS (SELECT *, CASE WHEN k = 'long' THEN {_sql_packed(_sql_sentences("text"), 600, False)} ELSE [text] END AS xs FROM joined),
every AS (SELECT book_id, g, page, k, unnest(xs) AS text, generate_subscripts(xs, 1) AS part FROM listed)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY g, part) - 1)::INTEGER AS seq, CASE WHEN k IN ('body', 'long') THEN 'paragraph' ELSE k END AS type, text, page FROM every""")
def reassemble_v1(spark, sf_dir):
    """Blocks of which some break after a numbered heading, in their text, their normalised text or both, and some have a role."""
    five, order = F.col("order") % 5 == 0, F.col("order")
    rows = blocks(spark, sf_dir)
    opened = F.concat(F.lit("1 Intro\n"), "text")
    rows = rows.withColumns({
        "normalized_text": F.when(order % 15 == 5, "").when(five, F.concat(F.lit(" "), opened)).otherwise(F.col("text")),
        "text": F.when(five, opened).otherwise(F.col("text")),
        "translated_text": F.when(order % 10 == 0, "").when(five, F.concat(F.lit("1 Введение "), "translated_text")).otherwise(F.col("translated_text")),
        "role": F.when(order % 11 == 3, "Subtitle").otherwise(""),
    })
    return lay.reassemble(rows)


@query(f"""SELECT book_id, id, generate_subscripts(xs, 1)::INTEGER - 1 AS n, unnest(xs) AS chunk FROM (SELECT book_id, id, CASE WHEN length(x) <= 350 THEN [x] ELSE {_sql_packed(_sql_sentences("x"), 350, True)} END AS xs FROM (SELECT book_id, id, {_strip("text || '  ' || text || '. ' || translated_text || '   ' || text")} AS x FROM blocks))""")
def chunk_sentences(spark, sf_dir):
    """Longer texts than blocks are, so that many are packed and some sentences are cut."""
    long = F.concat("text", F.lit("  "), "text", F.lit(". "), "translated_text", F.lit("   "), "text")
    return blocks(spark, sf_dir).select(*KEYS, F.posexplode(s.chunk_sentences(long)).alias("n", "chunk"))


@query("""SELECT book_id, id, n, array_to_string(list_transform(string_split(line, '|'), lambda x: trim(x)), '~') AS cells FROM (SELECT book_id, id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, (generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1)::INTEGER AS n FROM blocks WHERE contains(text, '|'))""")
def table_rows(spark, sf_dir):
    rows = blocks(spark, sf_dir).where(F.col("text").contains("|")).select(*KEYS, F.posexplode(s.table_rows("text")).alias("n", "row"))
    return rows.select(*KEYS, "n", F.array_join("row", "~").alias("cells"))


@query(f"""SELECT book_id, id, x.head AS head, x.body AS body FROM (SELECT book_id, id, {SQL_STRUCTURAL} AS x FROM (SELECT book_id, id, {_strip("text")} AS text FROM blocks)) WHERE x.head <> ''""")
def split_structural(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("x", s.split_structural("text")).where("x.head <> ''").select(*KEYS, "x.head", "x.body")


@query(f"""SELECT book_id, id, 'Abstract' AS head, CASE WHEN length(body) > 10 THEN body ELSE '' END AS body FROM (SELECT *, {_strip("substr(text, 9)")} AS body FROM blocks WHERE lower(text) LIKE 'abstract %' OR lower(text) = 'abstract')""")
def split_abstract(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("x", s.split_abstract("text")).where("x.head <> ''").select(*KEYS, "x.head", "x.body")


@query(SQL_STREAM + f""" SELECT book_id, seq, p.type AS type, CASE p.type WHEN 'heading1' THEN 'heading' WHEN 'heading2' THEN 'heading' WHEN 'list_item' THEN 'bullet' WHEN 'caption' THEN 'caption' WHEN 'figure' THEN 'figure' WHEN 'table' THEN 'table' ELSE 'justified' END AS style,
  CASE p.type WHEN 'heading1' THEN 1 WHEN 'heading2' THEN 2 END AS level, p.cols AS columns FROM stream WHERE {_strip("p.text")} <> '' OR p.cols IS NOT NULL""")
def docx_plan(spark, sf_dir):
    return lay.docx_plan(lay.paragraph_stream(blocks(spark, sf_dir))).select("book_id", "seq", "type", "style", "level", "columns")


@query("""SELECT book_id, "order", line, (floor(down / 742) + 1)::BIGINT AS sheet FROM (SELECT book_id, "order", line, coalesce(sum(CASE type WHEN 'heading' THEN 12 ELSE 10 END * 1.2::DOUBLE) OVER (PARTITION BY book_id ORDER BY "order", line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down
  FROM (SELECT book_id, "order", type, (generate_subscripts(string_split(v, chr(10)), 1) - 1)::INTEGER AS line FROM (SELECT *, CASE WHEN translated_text <> '' THEN translated_text ELSE text END AS v FROM blocks)))""")
def pdf_pagination(spark, sf_dir):
    return lay.pdf_lines(blocks(spark, sf_dir).withColumn("normalized_text", F.lit(""))).select("book_id", "order", "line", "sheet")


def _page_texts(spark, sf_dir):
    return ch.page_texts(blocks(spark, sf_dir))


@query(f"""SELECT book_id, page, sha256(string_agg(x, chr(10) ORDER BY "order")) AS text_sha256 FROM (SELECT book_id, page, "order", {_strip("nfc_normalize(chr(9) || text || ' e' || chr(769) || chr(160))")} AS x FROM blocks) GROUP BY book_id, page""")
def page_texts_nfc(spark, sf_dir):
    """Blocks that end in a decomposed letter and begin and end in white space."""
    return ch.page_texts(blocks(spark, sf_dir).withColumn("text", F.concat(F.lit("\t"), "text", F.lit(" e\u0301\u00a0")))).select("book_id", "page", F.sha2("text", 256).alias("text_sha256"))


SQL_PAGES = f""", tidy AS (SELECT book_id, page, "order", {_strip("nfc_normalize(text)")} AS text FROM blocks), pages_t AS (SELECT book_id, page, string_agg(text, chr(10) ORDER BY "order") AS text FROM tidy WHERE text <> '' GROUP BY ALL)"""
SQL_CHAPTERS = SQL_PAGES + f""", cand AS (SELECT *, {_strip("text")} AS t FROM blocks), heads AS (SELECT book_id, page, "order", t FROM cand WHERE length(t) >= 4 AND (length(t) < 60 OR (upper(t) = t AND lower(t) <> t) OR (NOT regexp_matches(t, '[.!?]$') AND length(t) < 120)) AND length(replace(t, 'ß', 'SS')) BETWEEN 5 AND 200),
lagged AS (SELECT *, lag(t) OVER (PARTITION BY book_id ORDER BY page, "order") AS before FROM heads),
chapters AS (SELECT book_id, (row_number() OVER w)::INTEGER AS number, t AS title, page AS page_start, (lead(page) OVER w - 1)::INTEGER AS page_end FROM lagged WHERE before IS NULL OR before <> t WINDOW w AS (PARTITION BY book_id ORDER BY page, "order")),
last AS (SELECT book_id, max(page) AS last FROM pages_t GROUP BY book_id)"""


@query(SQL_CHAPTERS + " SELECT book_id, number, title, page_start, page_end FROM chapters")
def chapter_map(spark, sf_dir):
    return ch.chapter_map(ch.headings(blocks(spark, sf_dir)))


@query(SQL_CHAPTERS + " SELECT c.book_id, number, page FROM chapters c JOIN last USING (book_id) JOIN pages_t p ON p.book_id = c.book_id AND p.page BETWEEN page_start AND coalesce(page_end, last)")
def chapters_range_join(spark, sf_dir):
    return ch.chapter_pages(ch.chapter_map(ch.headings(blocks(spark, sf_dir))), _page_texts(spark, sf_dir)).select("book_id", "number", "page")


@query(SQL_CHAPTERS + r""" SELECT c.book_id, number + 90 AS number, CASE WHEN number + 90 < 10 THEN '0' ELSE '' END || (number + 90) || ' - ' || regexp_replace(substr(title, 1, 80), '[\\/:*?"<>|]', '_', 'g') || '.txt' AS file, sha256(string_agg(p.text, chr(10) ORDER BY page)) AS text_sha256 FROM (SELECT * REPLACE (nfc_normalize(title) AS title) FROM chapters) c JOIN last USING (book_id) JOIN pages_t p ON p.book_id = c.book_id AND p.page BETWEEN page_start AND coalesce(page_end, last) GROUP BY c.book_id, number, title""")
def chapter_texts(spark, sf_dir):
    """Chapters numbered from 91 on, so that numbers of two and of three digits occur."""
    found = ch.chapter_map(ch.headings(blocks(spark, sf_dir))).withColumn("number", F.col("number") + 90)
    return ch.chapter_texts(found, _page_texts(spark, sf_dir)).select("book_id", "number", "file", F.sha2("text", 256).alias("text_sha256"))


@query(SQL_PAGES + " SELECT book_id, sha256(string_agg('=== PAGE ' || page || ' ===' || chr(10) || text || chr(10), chr(10) ORDER BY page)) AS text_sha256 FROM pages_t GROUP BY book_id")
def book_plaintext(spark, sf_dir):
    return ch.book_plaintext(_page_texts(spark, sf_dir)).select("book_id", F.sha2("text", 256).alias("text_sha256"))


SQL_OCR = SQL_PAGES + """, pre AS (SELECT book_id, page, sum(length(text)) AS n FROM blocks GROUP BY ALL), ocr AS (SELECT book_id, page, CASE WHEN page % 3 = 0 THEN '' ELSE 'scanned ' || page END AS o FROM pages_t WHERE page % 2 = 0),
merged AS (SELECT p.book_id, p.page, CASE WHEN n < 300 AND coalesce(o, '') <> '' THEN o ELSE p.text END AS text, CASE WHEN n < 300 AND coalesce(o, '') <> '' THEN 'ocr' ELSE 'text' END AS source FROM pages_t p LEFT JOIN pre USING (book_id, page) LEFT JOIN ocr USING (book_id, page))"""


def _merged(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    pages = ch.page_texts(rows)
    ocr = pages.where("page % 2 = 0").select("book_id", "page", F.when(F.col("page") % 3 == 0, " ").otherwise(F.concat(F.lit("scanned "), F.col("page"))).alias("text"))
    return ch.ocr_merge(pages, b.page_lengths(rows), ocr)


@query(SQL_OCR + " SELECT book_id, page, source, sha256(text) AS text_sha256 FROM merged")
def ocr_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("book_id", "page", "source", F.sha2("text", 256).alias("text_sha256"))


@query(SQL_OCR + " SELECT book_id, count(*) FILTER (source = 'ocr') AS ocr, count(*) FILTER (source <> 'ocr') AS text FROM merged GROUP BY book_id")
def source_histogram(spark, sf_dir):
    return b.source_histogram(_merged(spark, sf_dir))


@query("""SELECT book_id, sha256('<html><body>' || chr(10) || string_agg(body, chr(10) ORDER BY page) || chr(10) || '</body></html>') AS html_sha256 FROM (SELECT book_id, page, '<h2>Page ' || page || '</h2>' || chr(10) || string_agg('<p>' || CASE WHEN translated_text <> '' THEN translated_text ELSE text END || '</p>', chr(10) ORDER BY "order") AS body FROM blocks GROUP BY book_id, page) GROUP BY book_id""")
def export_html(spark, sf_dir):
    return writers.book_html(blocks(spark, sf_dir).withColumn("normalized_text", F.lit(""))).select("book_id", F.sha2("html", 256).alias("html_sha256"))


@query("""SELECT book_id, sha256(string_agg('[page ' || page || ']' || chr(10) || v || chr(10), chr(10) ORDER BY page, "order")) AS text_sha256 FROM (SELECT *, CASE WHEN translated_text <> '' THEN translated_text ELSE text END AS v FROM blocks) WHERE trim(v) <> '' GROUP BY book_id""")
def export_txt(spark, sf_dir):
    return writers.book_text(blocks(spark, sf_dir).withColumn("normalized_text", F.lit(""))).select("book_id", F.sha2("text", 256).alias("text_sha256"))


def _manifests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.select(t.book_id(F.encode("source", "UTF-8")).alias("book_id"), F.col("doc_id").alias("page"))
    books = docs.select("source").distinct().select(t.book_id(F.encode("source", "UTF-8")).alias("book_id"), F.concat(F.lit("C:\\in/"), "source", F.lit(".pdf")).alias("source_path"), F.concat(F.lit("Book "), "source").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    return lib.manifest(books, pages)


SQL_MANIFESTS = """SELECT substr(sha256(source), 1, 16) AS book_id, count(*)::INTEGER AS pages, 'Book ' || source AS title, '' AS author, '2024-01-01T00:00:00Z' AS created_at, source || '.pdf' AS source_pdf FROM documents GROUP BY source"""


@query(f"SELECT book_id, source_pdf, pages, title FROM ({SQL_MANIFESTS})")
def manifest(spark, sf_dir):
    return _manifests(spark, sf_dir).select("book_id", "source_pdf", "pages", "metadata.title")


@query(f"SELECT book_id, pages, title, author, created_at FROM ({SQL_MANIFESTS})")
def list_books(spark, sf_dir):
    return lib.list_books(_manifests(spark, sf_dir))


@query(f"SELECT book_id, pages, title, author, created_at FROM ({SQL_MANIFESTS}) WHERE contains(lower(title), 'src1') AND pages >= 3")
def search_books(spark, sf_dir):
    return lib.search_books(lib.list_books(_manifests(spark, sf_dir)), title="SRC1", min_pages=3)


@query(f"SELECT rpad(book_id, 16, ' ') || '  ' || rpad(title, max(greatest(length(title), 5)) OVER ()::INTEGER, ' ') AS line FROM ({SQL_MANIFESTS})")
def console_table(spark, sf_dir):
    return lib.console_table(lib.list_books(_manifests(spark, sf_dir)), ("book_id", "title"))


@query(f"SELECT book_id, pages, pages % 2 = 0 AS has_json, false AS has_txt, false AS has_html, true AS has_docx, false AS has_pdf FROM ({SQL_MANIFESTS})")
def book_artefacts(spark, sf_dir):
    m = _manifests(spark, sf_dir)
    files = m.select("book_id", F.explode(F.when(F.col("pages") % 2 == 0, F.array(F.lit("book.json"), F.lit("book_ru.docx"))).otherwise(F.array(F.lit("book_ru.docx")))).alias("name"))
    return lib.artefacts(m, files)


@query(f"""SELECT m.book_id, m.title, source_pdf AS source, m.pages::VARCHAR AS pages, m.pages % 2 = 0 AS json, false AS txt, true AS docx FROM ({SQL_MANIFESTS}) m""")
def book_info(spark, sf_dir):
    m = _manifests(spark, sf_dir)
    files = m.select("book_id", F.explode(F.when(F.col("pages") % 2 == 0, F.array(F.lit("book.json"), F.lit("book_ru.docx"))).otherwise(F.array(F.lit("book_ru.docx")))).alias("name"))
    return lib.book_info(m.withColumn("metadata", F.col("metadata").withField("pages", F.col("pages"))), files)


@query("""SELECT book_id, id, page, type, text AS raw, translated_text AS translated, '' AS tokens, CASE WHEN "order" % 3 > 0 THEN x0::VARCHAR || ',' || y0::VARCHAR END AS corners FROM blocks""")
def api_block_view(spark, sf_dir):
    """Blocks as the interface shows them; every third has no box."""
    rows = blocks(spark, sf_dir).withColumn("bbox", F.when(F.col("order") % 3 > 0, F.col("bbox")))
    out = lib.block_view(b.blocks_layer(rows))
    return out.select("book_id", "id", "page", "type", "raw", "translated", F.array_join("protected_tokens", ",").alias("tokens"), F.when(F.col("bbox").isNotNull(), F.array_join(F.slice("bbox", 1, 2), ",")).alias("corners"))


@query("""SELECT book_id, page, n, style, level, text FROM (SELECT book_id, page, (row_number() OVER (PARTITION BY book_id, page ORDER BY "order"))::INTEGER AS n, 'paragraph' AS style, NULL::INTEGER AS level, CASE WHEN translated_text <> '' THEN translated_text ELSE text END AS text FROM blocks UNION ALL SELECT DISTINCT book_id, page, 0, 'heading', 2, 'Page ' || page FROM blocks)""")
def simple_docx(spark, sf_dir):
    return lay.simple_docx_plan(blocks(spark, sf_dir).withColumn("normalized_text", F.lit("")))


@query("SELECT book_id, page, count(*)::INTEGER AS blocks FROM blocks GROUP BY ALL")
def api_get_pages(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    pages = rows.select("book_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return lib.get_pages(b.pages_layer(rows, pages))


@query("""SELECT book_id, page, (row_number() OVER (PARTITION BY book_id, page ORDER BY "order") - 1)::INTEGER AS pos, id, text AS raw_text FROM blocks""")
def api_page_blocks(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    pages = rows.select("book_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return lib.page_blocks(b.pages_layer(rows, pages), b.blocks_layer(rows)).select("book_id", "page", "pos", "id", "raw_text")


def _cache(rows):
    text = F.when(F.col("order") % 3 == 0, "stale").otherwise(F.col("text"))
    return rows.where("order % 2 = 0").select("book_id", F.col("id").alias("block_id"), F.sha2(text, 256).alias("src_hash"), F.when(F.col("order") % 5 == 0, "other").otherwise("echo").alias("model"), F.concat(F.lit("cached "), F.col("text")).alias("translated"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))


SQL_HIT = """("order" % 2 = 0 AND "order" % 3 <> 0 AND "order" % 5 <> 0)"""


@query(f"SELECT book_id, id, {SQL_HIT} AS cache_hit, CASE WHEN {SQL_HIT} THEN 'cached ' || text END AS cached FROM blocks")
def cache_lookup(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return lib.cache_lookup(rows, _cache(rows), "echo").select(*KEYS, "cache_hit", "cached")


def _translated(spark, sf_dir):
    rows = blocks(spark, sf_dir).drop("translated_text")
    return lib.translate(rows, _cache(rows), adapters.adapter("dummy:echo")[0], "echo")


@query(f"SELECT book_id, id, {SQL_HIT} AS cache_hit, CASE WHEN {SQL_HIT} THEN 'cached ' || text ELSE text END AS translated_text FROM blocks")
def api_translate(spark, sf_dir):
    return _translated(spark, sf_dir).select(*KEYS, "cache_hit", "translated_text")


@query(f"SELECT book_id, page, count(*) AS blocks, count(*) FILTER {SQL_HIT} AS cache_hits, count(*) AS translated FROM blocks GROUP BY ALL".replace("FILTER (", "FILTER (WHERE "))
def translate_summary(spark, sf_dir):
    return lib.translate_summary(_translated(spark, sf_dir))


@query("SELECT book_id, id, CASE WHEN text = translated_text THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM blocks")
def semantic_score(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, adapters.semantic_score("text", "translated_text").alias("score"))


@query()
def similarity_ratio(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEYS, t.similarity("text", "translated_text").alias("ratio"))


def _sql_language() -> str:
    """Languages by the count of their frequent words, first of equals."""
    count = lambda words: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words.split()) + ")))"
    return "[" + ", ".join(f"{{'n': {count(words)}, 'i': {-i}, 'lang': '{name}'}}" for i, (name, words) in enumerate(t.COMMON.items())) + "]"


@query(rf"""SELECT doc_id, CASE WHEN best.n > 0 THEN best.lang END AS language FROM (SELECT doc_id, list_max({_sql_language()}) AS best FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents))""")
def detect_language(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.detect_language("text").alias("language"))


@query("""SELECT book_id, CASE WHEN "order" % 7 <> 1 THEN id END AS id, "order" AS n, CASE WHEN "order" % 7 = 1 THEN 'id' WHEN "order" % 7 = 2 THEN 'page' WHEN "order" % 7 = 3 THEN 'order' ELSE 'text' END AS violation FROM blocks WHERE "order" % 7 BETWEEN 1 AND 5""")
def contract_violations(spark, sf_dir):
    """Every rule is broken by some rows: no id, a page that is no whole number, no order, a blank and a missing text."""
    at = F.col("order") % 7
    rows = blocks(spark, sf_dir).withColumns({
        "n": F.col("order"), "id": F.when(at != 1, F.col("id")), "page": F.when(at == 2, "1.5").otherwise(F.col("page").cast("string")),
        "order": F.when(at != 3, F.col("order")), "text": F.when(at == 4, " \t\n").when(at != 5, F.col("text")),
    })
    return b.violations(rows, "text").select("book_id", "id", "n", "violation")


@query()
def book_pipeline(spark, sf_dir):
    from .plans.book import run_book

    return run_book(blocks(spark, sf_dir).drop("translated_text"), gate=False)["paragraphs"].select("book_id", "seq", "type", "text", "page")


row_query(  # some outputs are Arabic, or nearly so
    "clean_model_output", lambda: t.clean_model_output(F.when(F.col("order") % 4 == 1, F.concat(F.lit("سلام"), "translated_text", F.lit("©"))).when(F.col("order") % 4 == 2, "م ab ©").otherwise(F.col("translated_text")), "text"),
    f"""(WITH x AS (SELECT CASE "order" % 4 WHEN 2 THEN 'ab' ELSE {_strip('translated_text')} END AS o) SELECT CASE WHEN length(o) < 3 THEN text ELSE o END FROM x)""",
)
row_query("unix_text", lambda: t.unix_text("text"), _strip("text"))
row_query("basename", lambda: t.basename(F.concat(F.lit("C:\\books/"), "id", F.lit(".pdf"))), "id || '.pdf'")
row_query("formula_check", lambda: k.bad_formula(F.when(F.col("order") % 2 == 0, "formula").otherwise("text"), "text"), """"order" % 2 = 0 AND NOT contains(text, '=')""")
row_query("text_file_id", lambda: t.book_id(F.encode("text", "UTF-8")), "substr(sha256(text), 1, 16)")


@query("""SELECT book_id, id, CASE "order" % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'dummy' ELSE 'foo' END AS provider, CASE "order" % 3 WHEN 0 THEN 'gpt:4' WHEN 1 THEN 'echo' ELSE '' END AS model FROM blocks""")
def model_spec(spark, sf_dir):
    spec = F.when(F.col("order") % 3 == 0, "openai:gpt:4").when(F.col("order") % 3 == 1, " ").otherwise("foo")
    return blocks(spark, sf_dir).select(*KEYS, t.model_spec(spec).alias("x")).select(*KEYS, "x.*")


@query("""SELECT book_id, "order", text FROM (SELECT book_id, text, row_number() OVER (PARTITION BY book_id ORDER BY "order") AS n, "order" FROM blocks WHERE "order" % 2 = 0) s JOIN (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY "order") AS n FROM blocks WHERE "order" % 2 = 1) t USING (book_id, n)""")
def pair_by_place(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    pairs = qa.pair_by_place(rows.where("order % 2 = 0"), rows.where("order % 2 = 1"))
    return pairs.select("book_id", "s.order", "s.text")


@query("""SELECT book_id, left_pages, right_pages, left_pages = right_pages AS same FROM (SELECT book_id, count(DISTINCT page) AS left_pages, count(DISTINCT page) FILTER ("order" % 2 = 0) AS right_pages FROM blocks GROUP BY book_id)""")
def structure_compare(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return qa.same_structure(rows.select("book_id", "page").distinct(), rows.where("order % 2 = 0").select("book_id", "page").distinct())


@query(f"""SELECT book_id, id, CASE WHEN list IS NULL THEN text ELSE list END AS translated_text FROM blocks LEFT JOIN (SELECT book_id, id, string_agg(x, ' ' ORDER BY n) AS list FROM (SELECT book_id, id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS n FROM blocks) WHERE {_strip("x")} <> '' GROUP BY book_id, id) USING (book_id, id)""")
def reassemble_chunks(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    chunks = rows.select(*KEYS, F.posexplode(F.split("text", " ")).alias("n", "translated"))
    return lib.reassemble_chunks(rows.drop("translated_text"), chunks).select(*KEYS, "translated_text")


@query(SQL_CHAPTERS + """ SELECT book_id, page, "order", t AS text FROM cand WHERE length(t) >= 4 AND (length(t) < 60 OR (upper(t) = t AND lower(t) <> t) OR (NOT regexp_matches(t, '[.!?]$') AND length(t) < 120))""")
def detect_headings(spark, sf_dir):
    return ch.headings(blocks(spark, sf_dir))


@query("""SELECT DISTINCT 'Font ' || (doc_id % 7) AS font FROM documents""")
def distinct_fonts(spark, sf_dir):
    from .sources.readers import fonts

    return fonts(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("Font "), F.col("doc_id") % 7).alias("font")))


@query("""SELECT source AS book_id, max(doc_id) AS mtime FROM documents GROUP BY source ORDER BY mtime DESC, book_id LIMIT 1""")
def latest_book(spark, sf_dir):
    return lib.latest_book(spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("book_id")).agg(F.max("doc_id").alias("mtime")))


@query(r"""SELECT book_id, id, regexp_extract(tt, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 1) AS head, trim(regexp_extract(tt, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 2)) AS body FROM (SELECT *, '1 ' || text AS tt FROM blocks) WHERE length(regexp_extract(tt, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 1)) BETWEEN 1 AND 80 AND trim(regexp_extract(tt, '(?s)^\s*(\d+[.)]?\s+\S+)\s+(.*)$', 2)) <> ''""")
def split_structural_v1(spark, sf_dir):
    target = F.concat(F.lit("1 "), "text")
    cut = s.split_structural_v1(F.concat(F.lit("1 Head\n"), "text"), target)
    return blocks(spark, sf_dir).withColumn("x", cut).where("x is not null").select(*KEYS, "x.head", "x.body")
