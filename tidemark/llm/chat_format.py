"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds text or a list of typed parts. A visitor walks the parts in order and
flattens them: text is escaped, an image, a sound or a document becomes a
placeholder with its number in the conversation, and is recorded as an attachment
with its reference and the number of tokens that it expands to.

The template writes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. In texts the
first character of each control string (of this and of other common templates)
is replaced by an entity, and so is the ``&`` of a text that looks like such an
entity. Undoing the entities gives the text back exactly, so ``read_back`` restores
the turns from the output alone. Loss spans (start and length in code points,
from 0) mark what the assistant says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: After "<": s, /s, unk, pad, a bar, or the system marks; after "[": the instruction marks.
_ANGLE = r"<(/?s>|unk>|pad>|\||</?SYS>>)"
_SQUARE = r"\[(/?INST\]|/?AVAILABLE_TOOLS\]|TOOL_CALLS\])"
_ENTITY = r"&(amp;|lt;|#91;|#10;)"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment expands to: per image patch, second of sound and page."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, _ENTITY, "&amp;$1")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "&lt;$1"), _SQUARE, "&#91;$1")


def unescaped(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _tokens(part: Column, rule: Expansion) -> Column:
    """Tokens of an attachment; at least 1, also where its size is missing."""
    cells = F.ceil(part["width"] / rule.patch) * F.ceil(part["height"] / rule.patch)
    found = (
        F.when(part["type"] == "image", cells)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * rule.per_second))
        .when(part["type"] == "document", part["pages"] * F.lit(rule.per_page))
    )
    return F.greatest(F.coalesce(found.cast("long"), F.lit(1)), F.lit(1).cast("long"))


def _visit(parts: Column, first: Column) -> Column:
    """The flattened text of a turn; attachments are numbered from `first`.

    Texts side by side are escaped as one, so that no control string arises where they meet.
    """

    def step(state: Column, part: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        is_text = kind == "text"
        mark = F.concat(F.lit("<|"), F.translate(kind, "<|>&[\n", "______"), F.lit(":"), (first + state["n"]).cast("string"), F.lit("|>"))
        return F.struct(
            F.when(is_text, state["text"]).otherwise(F.concat(state["text"], escaped(state["run"]), mark)).alias("text"),
            F.when(is_text, F.concat(state["run"], F.coalesce(part["text"], F.lit("")))).otherwise("").alias("run"),
            (state["n"] + F.when(is_text, 0).otherwise(1)).cast("long").alias("n"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("run"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["text"], escaped(s["run"])))


def format_conversations(turns: DataFrame, *, content: str = "content", trained_role: str = "assistant", rule: Expansion = Expansion()) -> DataFrame:
    """One row for each conv_id: formatted, loss_spans, attachments, expanded_tokens, n_turns.

    `turns` has conv_id, turn, role and `content`, an array of PART (or a column
    `text` instead). Turns are in the order of turn, then role, then content, nulls
    first, so ties and repeated rows have one result, in which each row is a turn. A
    null role, content, part or text counts as empty, a null type as text; rows with a
    null conv_id make one conversation. Other columns are ignored. An empty table
    gives an empty result. One shuffle by conv_id; a conversation, which is one row
    of the result, is put together in one task.
    """
    if content not in turns.columns:
        parts = F.array(
            F.struct(
                F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
                F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
            )
        )
    else:
        parts = F.filter(F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    files = F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("files", files).withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    head = F.concat(F.lit(OPEN), F.regexp_replace(escaped(F.col("role")), "\n", "&#10;"), F.lit("\n"))
    rows = rows.select("conv_id", "number", "role", "files", "first", head.alias("head"), _visit(F.col("parts"), F.col("first")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    later = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(later), F.lit(0)) + F.length("head")
    span = F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    listed = F.transform(
        "files",
        lambda p, i: F.struct(
            (F.col("first") + i).cast("long").alias("index"), F.col("number").cast("long").alias("turn"), p["type"].alias("type"),
            p["ref"].alias("ref"), _tokens(p, rule).alias("tokens"),
        ),
    )
    spans = F.when(F.col("role") == trained_role, span)
    rows = rows.select("conv_id", "number", "piece", spans.alias("span"), listed.alias("listed"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "piece", "span", "listed"))).alias("all"))
    attachments = F.flatten(F.transform("all", lambda t: t["listed"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        F.size("all").cast("long").alias("n_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (array of role and text, placeholders as they are) and loss_text, from the output alone."""
    cut = F.split(F.col("formatted"), "<\\|im_end\\|>\n", -1)
    pieces = F.slice(cut, 1, F.size(cut) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.locate("\n", inner)
        role = F.substr(inner, F.lit(1), at - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inner, at + 1)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(loss, ""))


SAMPLE = "</s>[INST] ok [/INST]"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '{SAMPLE}' AS text FROM range(2)")
    done = read_back(format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    for pattern, to in ((_ENTITY, "&amp;"), (_ANGLE, "&lt;"), (_SQUARE, "&#91;")):
        text = f"regexp_replace({text}, '{pattern}', '{to}\\1', 'g')"
    return text


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAMPLE}' UNION ALL SELECT -7, 1, 'assistant', '{SAMPLE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({_sql_escaped("role")}, chr(10), '&#10;')) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

QUERIES = {"op1_chat_format": op1}
ORACLES = {"op1_chat_format": ORACLE}
