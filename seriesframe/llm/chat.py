"""Chat formatting: fold an event log into conversations and render them.

Events of a conversation, in the order of ``seq``: ``open`` begins a message
with a role, ``delta`` appends text, ``edit`` replaces the message's text by
its own, ``regenerate`` throws the text away. Partitions are built by
conversation (``collect_list``, combined before the shuffle), and the fold is a
linear pass of array functions within a row, all as DataFrame expressions. One
conversation is one training example and so one row of the result; it is the
unit that a task holds.

Rendering. A message of the assistant is ``<s>`` text ``</s>``, any other is
``[INST]`` role, line feed, text ``[/INST]``. A backslash inside a text is
doubled and a control string gets one after its first character, so control
strings appear only where the template puts them, and removing the escapes
gives the text back. The loss mask covers exactly the assistant's texts.

Defined results: null roles and texts are empty. Rows of one turn are ordered
by role, then by a hash of the text; repeated rows are all kept. A null turn
comes first. Events before the first ``open`` belong to no message and are
ignored. A conversation without messages has an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read, text_of

#: Fixed values of the template.
BOS, EOS, INST, INST_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"(<|\[)(/?s>|/?INST\])"
PIECE = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
RESETS = ("edit", "regenerate")


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _message(events: Column) -> Column:
    """Role and text of the events of one message, the first of which opens it."""
    last = F.array_max(F.transform(events, lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(0)))
    kept = F.slice(events, last + 1, F.size(events) - last)
    texts = F.transform(kept, lambda e: F.when(e["kind"].isin("delta", "edit"), F.coalesce(e["text"], F.lit(""))).otherwise(""))
    return F.struct(F.coalesce(F.element_at(events, 1)["role"], F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """``conv_id`` and ``messages`` (role, text) from rows of conv_id, seq, kind, role, text."""
    log = events.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    opens = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] == "open", i)), lambda i: i.isNotNull())
    log = log.withColumn("opens", opens)
    ends = F.concat(F.slice("opens", 2, F.greatest(F.size("opens"), F.lit(1))), F.array(F.size("log")))
    bounds = F.filter(F.arrays_zip(F.col("opens").alias("a"), ends.alias("b")), lambda x: x["a"].isNotNull())
    messages = F.transform(bounds, lambda x: F.slice(F.col("log"), x["a"] + 1, x["b"] - x["a"]))
    return log.select("conv_id", F.transform(messages, _message).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """Add ``segments`` (text, loss), whose texts joined are ``formatted``, to rows with ``messages``."""

    def parts(m: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        role = F.regexp_replace(escape(m["role"]), "\n", "\\\\\n")
        text = escape(m["text"])
        return F.when(m["role"] == "assistant", F.array(piece(F.lit(BOS), False), piece(text, True), piece(F.lit(EOS), False))).otherwise(
            F.array(piece(F.concat(F.lit(INST), role, F.lit("\n"), text, F.lit(INST_END)), False)))

    out = conversations.withColumn("segments", F.flatten(F.transform("messages", parts)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """Messages (role, text) read back from a formatted conversation."""

    def one(piece: Column) -> Column:
        ours = piece.startswith(BOS)
        inner = F.when(ours, F.substring(piece, F.lit(len(BOS) + 1), F.length(piece) - len(BOS + EOS))).otherwise(
            F.substring(piece, F.lit(len(INST) + 1), F.length(piece) - len(INST + INST_END)))
        head = F.regexp_extract(inner, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        role = F.when(ours, F.lit("assistant")).otherwise(unescape(head))
        text = F.when(ours, unescape(inner)).otherwise(unescape(F.substring(inner, F.length(head) + 2, F.length(inner))))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(PIECE), F.lit(0)), one)


def masked(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def event_log(turns: DataFrame, delta_chars: int = 400, draft_chars: int = 12) -> DataFrame:
    """The event log that a chat service would have kept of rows of conv_id, turn, role, text.

    Assistant turns begin with a draft that is regenerated and then streamed;
    other turns are streamed, of which every third is a draft edited later.
    """
    text, role = text_of("text"), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "row", F.struct("turn", "role", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")))
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (role if role is not None else F.lit("")).alias("role"), text.alias("text"))
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.length("text"), F.lit(1)) / delta_chars).cast("int") - 1)
    deltas = F.transform(starts, lambda i: event("delta", F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars))))
    draft = event("delta", F.substring("text", 1, draft_chars))
    edited = F.array(event("open", F.lit(""), F.col("role")), draft, event("edit", F.col("text")))
    streamed = F.concat(F.array(event("open", F.lit(""), F.col("role"))),
                        F.when(F.col("role") == "assistant", F.array(draft, event("regenerate", F.lit("")))).otherwise(F.array_repeat(draft, 0)), deltas)
    events = F.when((F.col("role") != "assistant") & (F.pmod("row.hash", F.lit(3)) == 0), edited).otherwise(streamed)
    return rows.select("conv_id", "row", F.posexplode(events)).select(
        "conv_id", F.struct("row", F.col("pos").alias("step")).alias("seq"), "col.kind", "col.role", "col.text")


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from the output."""
    out = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("segments")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return digest(render(reconstruct(event_log(turns.unionByName(extra)))))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1#\2', 'g')) n,
  length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1#\2', 'g')) r FROM c),
a AS (SELECT conv_id, count(*)::BIGINT n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) turns,
  coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '') loss,
  sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + r + 14 END)::BIGINT formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) turns_sha256, length(loss)::BIGINT loss_chars, sha256(loss) loss_sha256, formatted_chars FROM a
"""
