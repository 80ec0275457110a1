"""Chat formatting with DataFrame functions only: a role automaton, text segments and loss flags from a template.

A template is data: what opens a turn, what closes it, which roles carry loss and which role may follow which. Texts and
roles are escaped so that no control string can occur inside them: a backslash becomes ``\\b`` and the control strings
become ``\\h``, ``\\e`` and ``\\c``. In escaped text a backslash is always followed by one of those letters, so the
escape can be undone letter by letter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, loss flags and the automaton's transitions ('' is the start state)."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant", "user")


DEFAULT = Template()
#: What is escaped in texts, and as which letter after the backslash; the backslash itself goes first.
CODES = (("\\", "b"), ("### ", "h"), ("</turn>", "e"))
ROLE_CODES = (*CODES, (":", "c"))


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column, codes: tuple = CODES) -> Column:
    for text, letter in codes:
        c = _replace(c, text, f"\\{letter}")
    return c


def unescape(c: Column, codes: tuple = CODES) -> Column:
    for text, letter in reversed(codes):
        c = _replace(c, f"\\{letter}", text)
    return c


def format_chats(turns: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, segments array<struct<text, loss>>, formatted, valid, problem.

    segments concatenated are `formatted`; `loss` marks exactly the bodies of turns whose role carries loss. `valid`
    says whether the automaton accepts the role sequence; `problem` names the first step it refuses. Turns go by
    (turn, role, text), so ties and repeated rows have one order; null texts and roles count as empty, null turns come
    first, null conv_ids form one conversation. Invalid conversations are formatted all the same, never dropped. Extra
    columns are not read; an empty table gives no rows.
    """
    t = template
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segs(x: Column) -> Column:
        head = F.concat(F.lit(t.open), escape(x["role"], ROLE_CODES), F.lit(t.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    def step(state: Column, x: Column) -> Column:
        """The state is the last role; what is refused leaves a '!' and the step, which nothing leaves again."""
        ok = F.lit(False)
        for a, bs in t.follows.items():
            ok = ok | ((state == a) & x["role"].isin(*bs))
        return F.when(state.startswith("!"), state).when(ok, x["role"]).otherwise(F.concat(F.lit("!"), state, F.lit(">"), x["role"]))

    out = chats.select("conv_id", F.flatten(F.transform("turns", segs)).alias("segments"), F.aggregate("turns", F.lit(""), step).alias("state"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        F.col("state").isin(*t.final).alias("valid"),
        F.when(F.col("state").startswith("!"), F.substring("state", 2, 1 << 30)).when(~F.col("state").isin(*t.final), F.concat("state", F.lit(">end"))).alias("problem"),
    )


def read_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Undo format_chats from its output alone: conv_id, turns array<struct<role, text>>, loss_text.

    The turns come from `formatted` by its control strings; loss_text from the segments that carry loss.
    """
    t = template
    parts = F.filter(F.split("formatted", "(?<=" + t.close + ")"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(t.open) + 1, 1 << 30)
        at = F.instr(body, t.after_role)
        text = F.substr(body, at + len(t.after_role), F.length(body) - at - len(t.after_role) - len(t.close) + 1)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), ROLE_CODES).alias("role"), unescape(text).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted", "valid")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    two = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    back = read_chats(format_chats(turns.unionByName(two)))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql_escape(c: str, codes: tuple) -> str:
    for text, letter in codes:
        c = f"replace({c}, '{text}', '\\{letter}')"
    return c


OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : </turn>') + 1 + length({_sql_escape("role", ROLE_CODES)}) + length({_sql_escape("text", CODES)}))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                WHEN before = 'user' THEN role = 'assistant' ELSE false END
           AND (after IS NOT NULL OR role IN ('assistant', 'user'))) AS valid
FROM s GROUP BY conv_id
"""
