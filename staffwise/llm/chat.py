"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``open`` (with the role), ``delta`` (text to
append), ``edit`` (the whole text anew) and ``regenerate`` (drop what was
streamed so far). Logs are partitioned by conversation and message, so that
one large conversation spreads over tasks, sorted by sequence and folded as a
stream into final messages; each message is rendered as it ends and stays a
row of its own, with its offset in the conversation.

A turn is an opening marker, a space, its text, a space and a closing marker.
In texts, a control string gets a backslash in front and the backslashes just
before it are doubled, which ``unescape`` undoes. The loss mask is the list of
assistant texts' spans in the output.

Defined results: null text counts as empty, a null role as the empty role; a
null conversation id is a conversation of its own; events of equal sequence
apply in the order of kind and body; a repeated event applies again; deltas
before any ``open`` form a message of the empty role; an empty log gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import row_number_within
from .arrow import mapped
from .common import ship, staged, unstage

# fixed values of the template: opening and closing marker by role
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE:{}]", "[/ROLE]")
CONTROL = r"<</?SYS>>|\[/?INST\]|</?s>|\[ROLE:[^\]\s]*\]|\[/ROLE\]"
GUARDED = re.compile(rf"(\\*)({CONTROL})")

DELTA_CHARS = 48


def escape(text: str) -> str:
    return GUARDED.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return GUARDED.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its escaped text in it."""
    begin, end = MARKERS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])
    body = escape(text)
    return f"{begin} {body} {end}", len(begin) + 1, len(begin) + 1 + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    opens = {a: (role, b) for role, (a, b) in MARKERS.items()}
    turns, waiting, start, role = [], None, 0, ""
    for m in GUARDED.finditer(formatted):
        if m[1]:
            continue  # a guarded control string is text
        marker = m[2]
        if waiting is None:
            role, waiting = opens.get(marker) or (unquote(marker[6:-1]), OTHER[1])
            start = m.end() + 1
        elif marker == waiting:
            turns.append((role, unescape(formatted[start:m.start() - 1])))
            waiting = None
    return turns


def fold(rows):
    """Stream of (conv, message, seq, kind, role, body) in order to
    (conv, message, first, role, text)."""
    current, first, role, parts = None, 0, "", []
    for conv, message, seq, kind, said, body in rows:
        if current != (conv, message):
            if current is not None:
                yield (*current, first, role, "".join(parts))
            current, first, role, parts = (conv, message), seq, "", []
        if kind == "open":
            role = said or ""
        elif kind == "edit":
            parts = [body or ""]
        elif kind == "regenerate":
            parts = []
        elif kind == "delta":
            parts.append(body or "")
    if current is not None:
        yield (*current, first, role, "".join(parts))


def turn_rows(events: DataFrame) -> DataFrame:
    """One row per final message of a log (conv_id, message, seq, kind, role,
    body): conv_id, first, message, at (offset of the turn in the rendered
    conversation), block, start and end (span of an assistant's text in the
    block; -1 as start for other roles)."""
    ship(events.sparkSession)
    log = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"),
                        F.col("seq").cast("long"), "kind", "role", "body")
    ordered = log.repartition("conv_id", "message").sortWithinPartitions(
        "conv_id", "message", "seq", F.expr("array_position(array('open','regenerate','edit','delta'), kind)"),
        "body")

    def turns(rows):
        for conv, message, first, role, text in fold(rows):
            out, start, end = rendered(role, text)
            yield conv, message, first, out, (start if role == "assistant" else -1), end

    # written before it is dealt by ranges, whose bounds are found in a run of their own
    blocks = staged(mapped(ordered, turns, "conv_id long, message long, first long, block string, start int, end int"),
                    "blocks")
    # turns in order of their first event, a line feed between them; offsets
    # are sums over ranges of turns and sums inside a range, so that a large
    # conversation spreads over tasks
    order = ["first", "message"]
    dealt = staged(blocks.repartitionByRange("conv_id", *order).withColumn("_range", F.spark_partition_id())
                   .withColumn("_n", (F.char_length("block") + 1).cast("long")), "turns")
    unstage(blocks)
    ranges = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "_range").agg(F.sum("_n").alias("_sum")).select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"),
        F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_range").orderBy(*order)
    placed = dealt.withColumn("_end", F.sum("_n").over(inside)).join(
        before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    return placed.select("conv_id", *order, (F.col("_before") + F.col("_end") - F.col("_n")).alias("at"),
                         "block", "start", "end")


def format_log(events: DataFrame) -> DataFrame:
    """Per conversation of a log: conv_id, formatted, loss_spans (start and end
    of each assistant text). A conversation is one row here, so it must fit
    one; ``turn_rows`` and ``digests`` have no such bound."""
    span = F.when(F.col("start") >= 0, F.struct("at", F.col("at") + F.col("start"), F.col("at") + F.col("end")))
    whole = turn_rows(events).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "block"))).alias("_turns"),
        F.array_sort(F.collect_list(span)).alias("_spans"))
    return whole.select(
        "conv_id", F.array_join(F.col("_turns.block"), "\n").alias("formatted"),
        F.flatten(F.transform("_spans", lambda x: F.array(x["col2"], x["col3"]))).alias("loss_spans"))


def digests(turns: DataFrame) -> DataFrame:
    """What ``read_back`` gives, from ``turn_rows``: each block is read back by
    itself; a conversation's turns pass in order as a stream that keeps the
    state of the hashes, not the texts."""
    ship(turns.sparkSession)

    def read(rows):
        current, said = None, None
        for conv, at, block, start, end in rows:
            if said is None or conv != current:
                if said is not None:
                    yield current, n, said.hexdigest(), chars, loss.hexdigest(), size
                current, n, chars, said, loss = conv, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parsed(block):
                n += 1
                said.update(f"{role}\n{text}\n".encode("utf-8"))
            if start >= 0:
                text = unescape(block[start:end])
                chars += len(text)
                loss.update(text.encode("utf-8"))
            size = at + len(block)
        if said is not None:
            yield current, n, said.hexdigest(), chars, loss.hexdigest(), size

    ordered = turns.select("conv_id", "at", "block", "start", "end").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "at")
    return mapped(ordered, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
                                 " loss_sha256 string, formatted_chars long")


def read_back(conversations: DataFrame) -> DataFrame:
    """Of format_log's output, per conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars - all parsed from
    ``formatted`` and cut out of it by ``loss_spans``."""
    ship(conversations.sparkSession)

    def read(rows):
        for conv, formatted, spans in rows:
            turns = parsed(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2]))
            yield (conv, len(turns), hashlib.sha256(said.encode("utf-8")).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(formatted))

    return mapped(conversations.select("conv_id", "formatted", "loss_spans"), read,
                  "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
                  " formatted_chars long")


def as_log(conversations: DataFrame) -> DataFrame:
    """An event log of finished conversations (conv_id, turn, role, text).

    Every message is opened and streamed in deltas. An assistant's message is
    first streamed as a draft that a regeneration drops; a user's message is
    first sent without its last character and then edited."""
    text = F.coalesce("text", F.lit(""))
    rows = row_number_within(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text.alias("text")),
        "conv_id", ["turn", "role", "text"], "message").withColumn("message", F.col("message").cast("long"))
    n = F.char_length("text")

    def deltas(of):
        return F.transform(F.sequence(F.lit(0), F.floor((F.char_length(of) - 1) / DELTA_CHARS).cast("int")),
                           lambda i: _event("delta", F.substring(of, (i * DELTA_CHARS + 1).cast("int"),
                                                                 F.lit(DELTA_CHARS))))

    opened = F.array(_event("open", F.lit("")))
    full = F.when(n > 0, deltas(F.col("text"))).otherwise(F.array(_event("delta", F.lit(""))))
    draft = F.reverse(F.substring("text", F.lit(1), F.lit(DELTA_CHARS)))
    events = (F.when(F.col("role") == "assistant",
                     F.concat(opened, F.array(_event("delta", draft), _event("regenerate", F.lit(""))), full))
              .when(F.col("role") == "user",
                    F.concat(opened, F.when(n > 1, deltas(F.expr("left(text, char_length(text) - 1)")))
                             .otherwise(F.array(_event("delta", F.lit("")))),
                             F.array(_event("edit", F.col("text")))))
              .otherwise(F.concat(opened, full)))
    return (rows.select("conv_id", "message", "role", F.posexplode(events).alias("at", "event"))
            .select("conv_id", "message", (F.col("message") * (1 << 32) + F.col("at")).alias("seq"),
                    F.col("event.kind").alias("kind"), "role", F.col("event.body").alias("body")))


def _event(kind: str, body: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), body.alias("body"))
