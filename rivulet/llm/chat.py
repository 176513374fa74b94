"""Chat formatting with a grammar round trip, in DataFrame operations only.

    conversation = turn*
    turn         = "### " role ": " body "</turn>" newline
    role, body   = text without "###", "</turn>", and with backslashes only as codes
    codes        = \\s backslash, \\h "###", \\t "</turn>", \\c ":" (in roles)

A conversation is rendered as it is and parsed again.  If the turns that come back aren't the
source's, or the text isn't in the grammar, its control strings are replaced by their codes and it
is parsed again; every backslash of an escaped text begins a code, so this is reversible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.runtime import columns


@dataclass(frozen=True)
class Template:
    """The markers and the role whose texts are trained on."""

    head: str = "### "
    mark: str = "###"
    colon: str = ": "
    end: str = "</turn>"
    loss_role: str = "assistant"


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x: Column, t: Template, role: bool = False) -> Column:
    x = _replace(_replace(_replace(x, "\\", "\\s"), t.mark, "\\h"), t.end, "\\t")
    return _replace(x, ":", "\\c") if role else x


def unescape(x: Column, t: Template) -> Column:
    x = _replace(_replace(_replace(x, "\\c", ":"), "\\t", t.end), "\\h", t.mark)
    return _replace(x, "\\s", "\\")


def render(turns: Column, t: Template, escaped: bool) -> Column:
    def one(x: Column) -> Column:
        role, text = (escape(x["role"], t, True), escape(x["text"], t)) if escaped else (x["role"], x["text"])
        return F.concat(F.lit(t.head), role, F.lit(t.colon), text, F.lit(t.end + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(text: Column, t: Template) -> Column:
    """The turns of a text in the grammar, else null."""
    parts = F.split(text, f"\\Q{t.end}\\E\n")
    own = F.slice(parts, 1, F.size(parts) - 1)
    body = F.transform(own, lambda x: F.substring(x, F.lit(len(t.head) + 1), F.length(x)))
    turns = F.transform(body, lambda x: F.struct(F.substring_index(x, t.colon, 1).alias("role"), F.substring(x, F.length(F.substring_index(x, t.colon, 1)) + len(t.colon) + 1, F.length(x)).alias("text")))
    bad = lambda x: x.contains(t.mark) | x.contains(t.end) | _replace(_replace(_replace(_replace(x, "\\s", ""), "\\h", ""), "\\t", ""), "\\c", "").contains("\\")
    wrong = F.exists(own, lambda x: ~x.startswith(t.head) | ~x.contains(t.colon)) | F.exists(body, bad) | (F.element_at(parts, -1) != "")
    plain = F.transform(turns, lambda x: F.struct(unescape(x["role"], t).alias("role"), unescape(x["text"], t).alias("text")))
    return F.when(text == "", F.array().cast("array<struct<role:string,text:string>>")).when(~wrong, plain)


def formatted(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed from it), escaped, mask.

    The loss mask gives for each turn how many characters of the formatted text come before its
    trained part, in it, and after it; together they are the whole text.

    Turns are in order of turn, then role and text; null turns come first.  Null texts and roles
    count as empty; long texts are rendered whole.  A null conv_id is a conversation of its own;
    repeated rows are turns of their own; no rows give no rows; extra columns are ignored, whatever
    their names.  A conversation is one row of the result, so its turns meet in one task whatever the
    method.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = columns(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.struct("turn", blank("role").alias("role"), blank("text").alias("text")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    source = whole.select("conv_id", F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    same = lambda text: F.coalesce(parse(text, t) == F.col("source"), F.lit(False))
    first = source.withColumn("raw", render(F.col("source"), t, False)).withColumn("escaped", ~same(F.col("raw")))
    second = first.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), t, True)).otherwise(F.col("raw"))).withColumn("turns", parse(F.col("formatted"), t))
    checked = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("array<struct<role:string,text:string>>"))
    def lengths(x: Column) -> Column:
        role, text = (F.when(F.col("escaped"), escape(x[c], t, c == "role")).otherwise(x[c]) for c in ("role", "text"))
        body, loss = F.length(text), F.when(x["role"] == t.loss_role, F.length(text)).otherwise(0)
        return F.struct((F.length(role) + len(t.head + t.colon)).alias("before"), loss.alias("loss"), (body - loss + len(t.end) + 1).alias("after"))

    return second.select("conv_id", "formatted", checked.alias("turns"), "escaped", F.transform("source", lengths).alias("mask"))


def digest(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """formatted()'s rows, reduced to counts and digests of what was parsed and of what the loss mask
    cuts out of the formatted text."""
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = F.split("formatted", f"\\Q{t.end}\\E\n")
    cut = lambda x, m: unescape(F.substring(x, m["before"] + 1, m["loss"]), t)
    loss = F.array_join(F.zip_with(F.slice(parts, 1, F.size(parts) - 1), "mask", cut), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CONFLICT = r"\### Assistant: </turn> ok"


def with_conflict(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are made of control strings."""
    spark: SparkSession = conversations.sparkSession
    text = F.lit(CONFLICT)
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return columns(conversations, "conv_id", "turn", "role", "text").unionByName(more)


#: The contract in DuckDB SQL; the template's length is that of the escaped form.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS r, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length('### ') + length(r) + 2 + length(x) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
