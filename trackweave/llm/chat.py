"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: `message` (a whole text), `delta` (more of a streamed text), `edit` (a new text), `regenerate`
(the text starts anew, with what the event carries), `delete`. Events are gathered by (conversation, message), sorted by sequence
number and folded: the last event that sets the text counts, and the deltas after it are joined to it. Messages are then ordered by
their first event and rendered. Sequence numbers may be of any type that has an order, pairs included.

The template is `<turn:ROLE>\\n TEXT </turn>\\n` without the blanks. In texts a backslash is doubled and `<` becomes `\\l`; in roles also `>`
becomes `\\g`. So `<` and `>` in the output belong to the template alone, and reading back is exact. The loss mask is a list of run
lengths in code points, for each turn: template, text under loss, text not under loss, template.

Defined results: null texts and roles count as empty; events without a conversation form one of their own; an event that a log has
twice (all columns equal) counts once; messages of equal first sequence number are ordered by role, then text; null sequence
numbers come first, so numbered deltas are joined to a reset without one; an empty log gives no rows. A conversation is one
output row, so its own messages meet in one task, after streamed events have been folded apart by message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESETS, LOSS_ROLES = ("message", "edit", "regenerate", "delete"), ("assistant",)
#: The query's log streams each text in so many pieces.
PIECES = 4
LOG = ("conv_id", "seq", "event", "message_id", "role", "text")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Pairs of backslashes split the text; between them only `\\l` and `\\g` are left."""

    def part(x: Column) -> Column:
        out = F.replace(x, F.lit("\\l"), F.lit("<"))
        return F.replace(out, F.lit("\\g"), F.lit(">")) if role else out

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), part), "\\")


def rebuild(log: DataFrame) -> DataFrame:
    """conv_id and its final messages, an ordered array of (position, role, text)."""
    event = F.struct("seq", F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = log.select("conv_id", "message_id", event.alias("e")).groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_set("e")).alias("es"))
    sets = F.filter("es", lambda e: e["event"].isin(*RESETS))
    last = F.try_element_at(sets, F.lit(-1))
    tail = F.filter("es", lambda e: F.col("last").isNull() | (e["event"] == "delta") & (F.col("last.seq").isNull() | (e["seq"] > F.col("last.seq"))))
    messages = by_message.withColumn("last", last).withColumn("tail", tail).where("last IS NULL OR last.event <> 'delete'")
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform("tail", lambda e: e["text"]), ""))
    role = F.coalesce(F.try_element_at(F.filter("es", lambda e: e["role"] != ""), F.lit(1))["role"], F.lit(""))
    turn = F.struct(F.element_at("es", 1)["seq"].alias("position"), role.alias("role"), text.alias("text"))
    return messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def render(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, loss_runs."""
    escaped = conversations.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<turn:"), escape(t["role"], role=True), F.lit(">\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss"))).alias("ts"))
    foot = "</turn>\n"
    runs = F.flatten(F.transform("ts", lambda t: F.array(
        F.length(t["head"]), F.when(t["loss"], F.length(t["body"])).otherwise(0), F.when(t["loss"], 0).otherwise(F.length(t["body"])), F.lit(len(foot)))))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(foot))), "")
    return escaped.select("conv_id", formatted.alias("formatted"), runs.alias("loss_runs"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, and what the output says: turns (role, text, and what of the text is under the loss mask)."""
    mark = F.lit("<turn:([^>]*)>\n([^<]*)</turn>\n")
    parsed = rendered.select("*", F.regexp_extract_all("formatted", mark, F.lit(1)).alias("roles"), F.regexp_extract_all("formatted", mark, F.lit(2)).alias("bodies"))
    turns = F.transform("bodies", lambda body, i: F.struct(
        unescape(F.get("roles", i), role=True).alias("role"), unescape(body).alias("text"),
        unescape(F.substring(body, F.lit(1), F.get("loss_runs", 4 * i + 1))).alias("loss")))
    return parsed.select("conv_id", "formatted", turns.alias("turns"))


def digests(rendered: DataFrame) -> DataFrame:
    """One row for each conversation, all of it read back from the output."""
    back = read_back(rendered)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A log in which each row of a conversation table is one message, streamed in pieces that come in any order.

    Sequence numbers are pairs (turn, step). By hash, a third of the messages are streamed alone, a third have a draft and more of it
    before they are regenerated, and a third have a draft that an edit replaces with the first piece."""
    text, way = F.coalesce("text", F.lit("")), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    size = F.greatest(F.lit(1), F.ceil(F.length(text) / PIECES)).cast("int")

    def event(step: int, kind: Column | str, said: Column, role: Column | None = None) -> Column:
        number = F.struct("turn", F.lit(step).alias("step"))
        return F.struct(number.alias("seq"), (F.lit(kind) if isinstance(kind, str) else kind).alias("event"), (F.lit(None).cast("string") if role is None else role).alias("role"), said.alias("text"))

    none, role = F.lit(None).cast("string"), F.col("role")
    pieces = [F.substring(text, size * k + 1, size) for k in range(PIECES)]
    events = [event(3 + k, "delta", pieces[k]) for k in range(PIECES - 1, 0, -1)]
    events += [event(3, F.when(way == 2, "edit").otherwise("delta"), pieces[0], role), F.when(way == 1, event(2, "regenerate", none))]
    events += [F.when(way > 0, event(1, "delta", F.lit(" <dropped>"))), F.when(way > 0, event(0, "message", F.lit("a draft"), role))]
    told = conversations.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.array_compact(F.array(*events)).alias("events"))
    return told.select("conv_id", "message_id", F.inline("events")).select(*LOG)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say what looks like control text."""
    said = F.lit("\\### Assistant: </turn> ok")
    rows = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), said.alias("text")) for k, r in enumerate(("user", "assistant"))))
    return spark.range(1).select(F.inline(rows))


#: The same in SQL; lengths of the escaped forms are counted, not built.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<', '\l')) AS body, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) AS head FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(body + head + 16) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a
"""
