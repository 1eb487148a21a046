"""Chat formatting by event sourcing: logs are folded into final messages, then rendered.

An event is (conversation, sequence, kind, message, role, text). Sorted by sequence, a conversation's events fold so:

* ``message`` starts a message, or replaces its text if it is there;
* ``delta`` appends to a message's text, starting it if it isn't there;
* ``edit`` replaces a message's text and drops all messages after it: the conversation goes on from there;
* ``regenerate`` does the same, its text being the start of the new version (deltas may follow);
* ``delete`` removes a message.

Edits, regenerations and deletions of messages that aren't there, and unknown kinds, do nothing. A role that is given
replaces the message's role. Messages render in the order in which they started, as ``<|im_start|>role``, a line
break, the text, ``<|im_end|>`` and a line break; either marker inside a text or role has a space put after its ``<|``.

Logs are partitioned by conversation and sorted within partitions, so that a conversation streams through a task in
order; what a task holds is one conversation's messages.

Cases: rows without a conversation are left out. A null sequence sorts first; events of one sequence sort by kind, message,
role and text. Repeated rows are one event (a log delivered twice folds alike). A null kind is ``message``, a null message
id the sequence as text (or ""), a null role ``unknown`` unless one was given (an empty role is one), a null text "". A conversation without messages
left renders as "". Empty tables give none. Very long texts are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.llm.common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"


class Fold:
    """The state of one conversation."""

    def __init__(self) -> None:
        self.messages: dict[str, list] = {}

    def _after(self, message: str) -> None:
        names = list(self.messages)
        for name in names[names.index(message) + 1 :]:
            del self.messages[name]

    def apply(self, kind: str, message: str, role: str | None, text: str) -> None:
        own = self.messages.get(message)
        if kind in ("message", "delta"):
            if own is None:
                own = self.messages[message] = [None, []]
            elif kind == "message":
                own[1].clear()
            own[1].append(text)
        elif own is None:
            return
        elif kind in ("edit", "regenerate"):
            self._after(message)
            own[1][:] = [text]
        elif kind == "delete":
            del self.messages[message]
        else:
            return
        if role is not None:
            own[0] = role

    def final(self) -> list[tuple[str, str]]:
        return [("unknown" if role is None else role, "".join(parts)) for role, parts in self.messages.values()]


def _safe(text: str) -> str:
    return text.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")


def render(messages: Iterable[tuple[str, str]]) -> str:
    return "".join(f"{START}{_safe(role)}\n{_safe(text)}{END}\n" for role, text in messages)


_OUT = pa.schema([("conv_id", pa.int64()), ("messages", pa.int64()), ("rendered", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, before = None, Fold(), None
    done: list[tuple[int, list]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([len(m) for _, m in done], pa.int64()), pa.array([render(m) for _, m in done], pa.string())], schema=_OUT)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            conv, seq, kind, message, role, text = row
            if conv != current:
                if current is not None:
                    done.append((current, state.final()))
                    size += sum(len(t) for _, t in done[-1][1])
                    if size > 4 << 20 or len(done) >= 5000:
                        yield flush()
                        done, size = [], 0
                current, state, before = conv, Fold(), None
            if row == before:
                continue
            before = row
            state.apply("message" if kind is None else kind, message if message is not None else "" if seq is None else str(seq), role, text or "")
    if current is not None:
        done.append((current, state.final()))
    yield flush()


def chats(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", kind_col: str = "kind", message_col: str = "message_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, messages, rendered) for each conversation of an event log."""
    own = events.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(seq_col).cast("long").alias("seq"), F.col(kind_col).cast("string").alias("kind"), F.col(message_col).cast("string").alias("message_id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where("conv_id is not null")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "message_id", "role", "text")
    return arrow_map(ordered, _fold, "conv_id long, messages long, rendered string")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table of turns (conv_id, turn, role, text): each row is a ``message`` event.

    Rows of one turn and role are one message, the last in sorted order standing; of two roles, two messages.
    """
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.concat_ws(":", F.col("turn").cast("string"), "role").alias("message_id"), "role", "text")


ORACLE = """
SELECT conv_id, count(*) AS messages,
       string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
                  || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn, role) AS rendered
FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, max(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL)
GROUP BY conv_id
"""


def replayed_log(conversations: DataFrame) -> DataFrame:
    """An event log that ends in known messages: every text comes in two parts, each second of three turns is generated again,
    the first message of every fifth conversation is edited at the end and the second of others deleted."""
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda seq, kind, text, role=None: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    base, last = F.col("turn") * 10, F.lit(1 << 40)
    none = F.lit(None).cast("struct<seq:bigint,kind:string,role:string,text:string>")
    again, edited = F.pmod("turn", F.lit(3)) == 1, (F.pmod("conv_id", F.lit(5)) == 0) & (F.col("n") == 1)
    deleted = (F.pmod("conv_id", F.lit(5)) != 0) & (F.pmod("conv_id", F.lit(7)) == 3) & (F.col("n") == 2)
    events = [
        event(base, "message", F.substring("text", F.lit(1), half), True),
        event(base + 1, "delta", F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")),
        F.when(again, event(base + 2, "regenerate", F.lit("Again: "))).otherwise(none),
        F.when(again, event(base + 3, "delta", F.col("text"))).otherwise(none),
        F.when(edited, event(last, "edit", F.concat(F.lit("Edited: "), F.col("text")))).otherwise(none),
        F.when(deleted, event(last, "delete", F.lit(None).cast("string"))).otherwise(none),
    ]
    each = own.select("conv_id", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("message_id"), F.explode(F.array(*events)).alias("e")).where("e is not null")
    return each.select("conv_id", "e.seq", "e.kind", "message_id", "e.role", "e.text")


REPLAY_ORACLE = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, max(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM m),
     f AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN 'Edited: ' || text WHEN turn % 3 = 1 THEN 'Again: ' || text ELSE text END AS text
           FROM n WHERE CASE WHEN conv_id % 5 = 0 THEN n = 1 WHEN conv_id % 7 = 3 THEN n <> 2 ELSE true END)
SELECT conv_id, count(*) AS messages,
       string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
                  || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn, role) AS rendered
FROM f GROUP BY conv_id
"""
