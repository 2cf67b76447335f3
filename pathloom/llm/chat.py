"""Chat formatting: conversations rebuilt from event logs and rendered, with DataFrame functions only.

A log has a row an event: conversation, sequence number, role, text and, where the log streams,
an event kind and the number of the event it refers to. Kinds: `message` opens a turn; `delta`
appends to the open turn of its role, or opens one; `edit` replaces a turn's text; `regenerate`
empties a turn, which following deltas fill again. An event that refers to another belongs to the
turn which that one opened, however long ago; else it belongs to the turn opened last. A log
without kinds is one of messages, and goes through the same fold. Partition by conversation, sort
by sequence, fold.

A turn is rendered as `<|turn|>role NEWLINE text<|end|>`. Within roles and texts every backslash
is doubled and every control string gets a backslash after its first character, so no control
string stands in escaped text and removing one backslash before a character restores it. The
loss mask covers the escaped text of assistant turns.

Defined results: null roles and texts are empty; long texts are kept whole (a conversation's output
is one string, so 2 GB at most); rows of equal sequence number follow each other
by role and text, repeated rows included; events of a null conversation form one conversation
under null; unknown kinds and null ones count as `message`; an event that refers to one which opened
no turn opens one itself; an empty log gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, picked

TURN, END = "<|turn|>", "<|end|>"
#: Strings that mark structure here or in other common templates; each starts with the only < or [ in it.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
MASKED_ROLE = "assistant"


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r"\|[]/" else c for c in s)


#: The first character of a control string, where one stands.
OPENS = "|".join(f"{_literal(s[0])}(?={_literal(s[1:])})" for s in CONTROL)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), f"({OPENS})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(?s:(.))", "$1")


def escape_role(c: Column) -> Column:
    """A role ends at the first newline, so its own get a backslash."""
    return F.regexp_replace(escape(c), "\n", "\\\\\n")


def messages(log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", kind: str | None = None, ref: str | None = None) -> DataFrame:
    """Events folded into final messages: conv_id, turn (from 0), role, text.

    Windows keep the fold spillable: no conversation is gathered as one value here.
    """
    log = picked(log, *dict.fromkeys(c for c in (conv, seq, role, text, kind, ref) if c))
    s = F.col(seq).alias("_seq")
    kind_of, ref_of = F.col(kind) if kind else F.lit("message"), F.col(ref) if ref else F.lit(None)
    e = log.select(F.col(conv).alias("conv_id"), s, F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), kind_of.alias("_kind"), ref_of.cast(log.select(s).schema["_seq"].dataType).alias("_ref"))
    order = Window.partitionBy("conv_id").orderBy("_seq", "role", "text")
    e = e.withColumns({"_n": F.row_number().over(order), "_before": F.lag("role").over(order)})
    joins = F.coalesce(F.col("_kind").isin("delta", "edit", "regenerate") & (F.col("_ref").isNotNull() | (F.col("_before") == F.col("role"))), F.lit(False))
    # a turn is named by the place of the event that opened it; of equal sequence numbers the first is referred to
    named = Window.partitionBy("conv_id", F.coalesce("_ref", "_seq"))
    opener = F.min(F.when(~joins, F.col("_n"))).over(named) if ref else F.lit(None).cast("int")
    e = e.withColumns({"_joins": joins, "_opener": opener})
    opens = ~F.col("_joins") | (F.col("_ref").isNotNull() & F.col("_opener").isNull())
    last = F.last(F.when(opens, F.col("_n")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("_n"))
    e = e.withColumn("_turn", F.when(~opens & F.col("_ref").isNotNull(), F.col("_opener")).otherwise(last)).withColumn("_opens", opens)
    fresh = F.max(F.when(~F.col("_opens") & F.col("_kind").isin("edit", "regenerate"), F.col("_n"))).over(Window.partitionBy("conv_id", "_turn"))
    kept = e.withColumn("_from", F.coalesce(fresh, F.lit(0))).where("_opens OR _n >= _from")
    piece = F.when((F.col("_n") < F.col("_from")) | (F.col("_kind") == "regenerate"), "").otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("_n", piece.alias("p"))))
    folded_ = kept.groupBy("conv_id", "_turn").agg(F.max(F.when(F.col("_opens"), F.col("role"))).alias("role"), F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("text"))
    return folded_.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn")) - 1).cast("long").alias("turn"), "role", "text")


def rendered(msgs: DataFrame) -> DataFrame:
    """conv_id and formatted, the conversation as one string."""
    piece = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    turns = F.array_sort(F.collect_list(F.struct("turn", piece.alias("p"))))
    return msgs.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["p"]), "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The turns read back: an array of (role, text), both unescaped."""
    turns = F.split(formatted, r"<\|end\|>")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    head = r"^<\|turn\|>((?s:[^\\\n]|\\.)*)\n"
    return F.transform(turns, lambda t: F.struct(unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_replace(t, head, "")).alias("text")))


def spans(formatted: Column) -> Column:
    """The loss mask: an array of (start, end) in code points, over assistant texts as escaped."""
    turns = F.split(formatted, r"<\|end\|>")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    opening = f"{TURN}{MASKED_ROLE}\n"

    def step(at, t):
        end = at + F.length(t)
        span = F.struct((at + len(opening)).alias("start"), end.alias("end"))
        return end + len(END), F.when(t.startswith(opening), span)

    return folded(turns, F.lit(0), "struct<start:int,end:int>", step)


def under_mask(formatted: Column) -> Column:
    """What the spans hold, span by span, taken from the turns as they are split: cutting spans out of the whole would walk to each from the beginning."""
    turns = F.split(formatted, r"<\|end\|>")
    opening = f"{TURN}{MASKED_ROLE}\n"
    return F.transform(F.filter(turns, lambda t: t.startswith(opening)), lambda t: F.substring(t, F.lit(len(opening) + 1), F.length(t)))


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    r = rendered(messages(conversations)).select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted")).alias("mask"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = unescape(F.array_join("mask", ""))
    r = r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), masked.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return r.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


TRICKY = "</s>[INST] ok [/INST]"


def with_tricky(conversations: DataFrame) -> DataFrame:
    """conversations and one more, -7, whose texts hold control strings of other templates."""
    spark = conversations.sparkSession
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return picked(conversations, "conv_id", "turn", "role", "text").unionByName(more)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS escaped FROM c)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(length(role) + length(escaped) + 16)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
