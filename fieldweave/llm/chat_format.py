"""Chat formatting by event-sourced reconstruction, with DataFrame expressions only.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations are folded into the final text of each turn; the turns are rendered into one string
with a loss mask.  Everything after the one shuffle by conversation keeps that partitioning.

Template of a turn: ``<s>[INST] role [/INST]`` newline, text, ``</s>`` newline.  Every control
string holds ``<`` or ``[``; role and text have neither after escaping, so no text can close or
open a turn, and ``parse`` restores both exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESETS = ("message", "edit", "regenerate", "delete")
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
#: Code points of a delta where rows are turned into a log, and deltas of a text at most.
CHUNK, MOST_DELTAS = 256, 64
#: Escape codes; the backslash comes first when escaping and last when restoring.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final turns (conv_id, turn, role, text) of events (conv_id, seq, turn, kind, role, text).

    Kinds: ``message``, ``edit`` and ``regenerate`` set the text of their turn anew (a
    regeneration usually to nothing), ``delta`` and any other kind append to it, ``delete`` as the
    last reset removes the turn.  Events of one turn apply by seq, ties by kind, role and text;
    null seq first.  A turn's role is the last one given; none: empty.  Null text counts as empty.
    """
    events = events.select("conv_id", "seq", "turn", "kind", "role", "text").repartition("conv_id")
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    turns = events.groupBy("conv_id", "turn").agg(log.alias("log"))
    starts = F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i + 1).otherwise(F.lit(1)))
    turns = turns.withColumn("from", F.array_max(starts))
    live = F.slice("log", F.col("from"), F.size("log"))
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return turns.where(~(F.coalesce(F.get(F.col("log.kind"), F.col("from") - 1), F.lit("")) == "delete")).select(
        "conv_id",
        "turn",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` lists, in order, where the escaped text of each ``learn`` turn stands:
    start and end in code points, byte_start and byte_end in UTF-8.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    parts = turns.withColumns({"_head": head, "_body": escape(F.col("text"))})
    parts = parts.withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    for name, length in (("_c", F.char_length), ("_b", F.octet_length)):
        start = F.coalesce(F.sum(length("_piece").cast("long")).over(before), F.lit(0)) + length("_head")
        parts = parts.withColumn(name, start).withColumn(name + "e", F.col(name) + length("_body"))
    span = F.struct(
        F.col("_c").alias("start"), F.col("_ce").alias("end"), F.col("_b").alias("byte_start"), F.col("_be").alias("byte_end")
    )
    row = F.struct("turn", F.col("_piece").alias("piece"), (F.col("role") == learn).alias("learn"), span.alias("span"))
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.col("rows.piece"), "").alias("formatted"),
        F.filter("rows", lambda r: r["learn"]).getField("span").alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), restored."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = lambda p: F.substring_index(p, MID, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(head(p), len(OPEN) + 1, 2147483647)).alias("role"),
            unescape(F.substring(p, F.char_length(head(p)) + len(MID) + 1, F.lit(2147483647))).alias("text"),
        ),
    )


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, restored."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(
        data, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")
    )
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s).cast("string"))), "")


def rows_as_events(rows: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as a message of its own; equal turns stand by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.withColumn("turn", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def rows_as_stream(rows: DataFrame, chunk: int = CHUNK, most: int = MOST_DELTAS) -> DataFrame:
    """Each row (conv_id, turn, role, text) as the events that streaming it leaves in a log.

    A text comes in deltas of ``chunk`` code points, longer ones where there would be more than
    ``most`` of them.  By a hash of the row, a third of the turns just stream; a third stream a draft
    first, which a regeneration throws away; a third stream wrong words that an edit corrects half
    way.  Folding the log gives back the rows in the order of ``rows_as_events``, wherever the events lie.
    """
    whole = rows_as_events(rows).drop("kind", "seq").withColumn("text", F.coalesce("text", F.lit("")))
    size = F.greatest(F.lit(chunk), F.ceil(F.char_length("text") / most).cast("int"))
    whole = whole.withColumn("_size", size).withColumn("_n", F.ceil(F.char_length("text") / F.col("_size")).cast("int"))
    part = lambda i: F.substring(F.col("text"), i * F.col("_size") + 1, F.col("_size"))
    deltas = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: part(i - 1))
    whole = whole.withColumn("_parts", F.when(F.col("_n") > 0, deltas).otherwise(F.array().cast("array<string>")))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, role = F.lit(None).cast("string"), F.coalesce("role", F.lit(""))
    stream = lambda parts: F.transform(parts, lambda t: event("delta", none, t))
    half = F.floor(F.col("_n") / 2).cast("int")
    start, rest = F.slice("_parts", F.lit(1), half), F.slice("_parts", half + 1, F.col("_n"))
    opening = F.array(event("message", role, F.lit("")))
    plain = F.concat(opening, stream(F.col("_parts")))
    again = F.concat(opening, stream(F.transform(start, lambda t: F.reverse(t))), F.array(event("delta", none, F.lit("...")), event("regenerate", none, none)), stream(F.col("_parts")))
    edited = F.concat(F.array(event("message", F.lit("draft"), F.lit("wrong "))), stream(start), F.array(event("edit", role, F.array_join(start, ""))), stream(rest))
    case = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(3))
    events = F.when(case == 0, plain).when(case == 1, again).otherwise(edited)
    log = whole.select("conv_id", "turn", F.posexplode(events).alias("at", "e"))
    return log.select("conv_id", (F.shiftleft("turn", 20) + F.col("at")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


def format_chat(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Folds a log of events and renders each conversation; see ``fold`` and ``render``.

    Defined cases: a null conv_id is a conversation of its own; an empty log gives no rows; other
    columns are not read; equal rows of a log apply one after the other.
    """
    return render(fold(events), learn)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_chat(rows_as_stream(rows.unionByName(probe)))
    said = F.array_join(
        F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return out.withColumn("_learned", learned(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(regexp_replace(role, '[\\<\[]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[]', 'xx', 'g')))::BIGINT
         AS formatted_chars
FROM rows GROUP BY conv_id
"""
