"""Chat formatting by event-sourced reconstruction.

The log is partitioned by conversation and sorted by sequence; one pass folds its events (whole messages, streamed
deltas, edits, regenerations) into final messages and renders them. The template marks every turn with control strings
and escapes those inside texts reversibly, so an output can be read back without loss, and a loss mask marks the
assistant's texts.

A task streams through its sorted rows, and a conversation's digest is sequential, so one conversation is one task's work. It
holds that conversation's messages where the log may edit them or the text is asked for, else one message at a time.

Defined results. Null text: empty. Null role: the empty role. Null conversation: a conversation of its own. Rows of
one conversation with the same turn: ordered by role, text and kind, null as empty. Null turn: first. Conversations of no rows do not
exist; an empty table gives no rows (the query: conversation -1 alone). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: The template's control strings.
USER, END_USER, SYSTEM, END_SYSTEM, ROLE, END_ROLE, END = "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "</s>"
_CONTROL = re.compile(r"\\|\[(?=/?(?:INST|SYS|ROLE)\])|<(?=/s>)")
_MARK = re.compile(r"\[/?(?:INST|SYS|ROLE)\]|</s>")


def escape(text: str) -> str:
    r"""No control string stands in the result: a backslash is doubled, one is put behind the first sign of each."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(.)\\", r"\1", text, flags=re.S) if "\\" in text else text


def fold(events: Iterable[tuple[str, str | None, str | None]]) -> list[list[str]]:
    """Final [role, text] messages of a conversation's events (kind, role, text) in order.

    message: a new message. delta: goes on with the last message if that has the same role and was streamed, else
    begins one. end: the streamed message is over. edit: the last message of the role gets this text, and what follows
    it goes. regenerate: the last message goes if the assistant wrote it; a text begins the new one.
    """
    out: list[list[str]] = []
    streaming = False
    for kind, role, text in events:
        role, text = role or "", text or ""
        if kind == "delta":
            if streaming and out and out[-1][0] == role:
                out[-1][1] += text
            else:
                out.append([role, text])
            streaming = True
            continue
        streaming = False
        if kind == "message":
            out.append([role, text])
        elif kind == "edit":
            at = next((i for i in range(len(out) - 1, -1, -1) if out[i][0] == role), None)
            if at is None:
                out.append([role, text])
            else:
                del out[at + 1 :]
                out[at][1] = text
        elif kind == "regenerate":
            if out and out[-1][0] == "assistant":
                out.pop()
            if text:
                out.append(["assistant", text])
                streaming = True
        elif kind != "end":
            raise ValueError(f"unknown event {kind}")
    return out


def streamed(events: Iterable[tuple[str, str | None, str | None]]) -> Iterator[list[str]]:
    """As fold(), for logs without edits and regenerations: a message is given away once it is final, so one is held at most."""
    role, parts, streaming = None, [], False
    for kind, who, text in events:
        who = who or ""
        if kind == "delta" and streaming and who == role:
            parts.append(text or "")
            continue
        if kind in ("message", "delta"):
            if role is not None:
                yield [role, "".join(parts)]
            role, parts = who, [text or ""]
        elif kind != "end":
            raise ValueError(f"a log with {kind} events is folded whole")
        streaming = kind == "delta"
    if role is not None:
        yield [role, "".join(parts)]


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A formatted turn, and the span of it that the loss counts, an assistant's escaped text."""
    body = escape(text)
    if role == "assistant":
        return body + END, (0, len(body))
    if role == "user":
        return USER + body + END_USER, None
    if role == "system":
        return SYSTEM + body + END_SYSTEM, None
    return ROLE + escape(role) + END_ROLE + body + END, None


def render(messages: Iterable[list[str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (begin, end) of it that the loss counts."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in messages:
        turn, span = render_turn(role, text)
        if span:
            spans.append((at + span[0], at + span[1]))
        parts.append(turn)
        at += len(turn)
    return "".join(parts), spans


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at, role = 0, "assistant"
    for mark in _MARK.finditer(formatted):
        body = formatted[at : mark.start()]
        at = mark.end()
        if mark[0] in (USER, SYSTEM, ROLE):
            role = {USER: "user", SYSTEM: "system", ROLE: "role"}[mark[0]]
        elif mark[0] == END_ROLE:
            role = "=" + unescape(body)
        else:
            yield role.removeprefix("="), unescape(body)
            role = "assistant"


def conversations(events: DataFrame, with_text: bool = True, edits: bool = True) -> DataFrame:
    """From events (conv_id, seq, kind, role, text): conv_id, formatted, loss_spans, and the digest of what a reader finds.

    edits: whether the log may have edits and regenerations; without them, messages pass through one by one.
    """

    def rows(batches):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def finished(conv, log):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = at = 0
        parts, spans = [], []
        for message in fold(log) if edits else streamed(log):
            turn, span = render_turn(*message)
            for role, text in parse(turn):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            if span:
                text = unescape(turn[span[0] : span[1]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            if with_text:
                parts.append(turn)
                spans += [[at + span[0], at + span[1]]] if span else []
            at += len(turn)
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), at, *(["".join(parts), spans] if with_text else [])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] + ["formatted", "loss_spans"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * with_text

    def kernel(batches):
        done: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names)

        for conv, log in groupby(rows(batches), itemgetter(0)):
            done.append(finished(conv, (x[1:] for x in log)))
            held += done[-1][5] if with_text else 0
            if len(done) >= 1000 or held > 4_000_000:
                yield flush()
                done, held = [], 0
        if done:
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + ", formatted string, loss_spans array<array<long>>" * with_text
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    dealt = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", *plain).repartition("conv_id")
    return map_arrow(dealt.sortWithinPartitions("conv_id", "seq", "role", "text", "kind").drop("seq"), kernel, schema)


def message_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns as a log: each turn is one message event, its number the sequence."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, t AS seq, 'message' AS kind, r AS role, '{hard}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    log = message_events(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(more)
    return conversations(log, with_text=False, edits=False)


OP8_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[/?INST\]|\[/?SYS\]|\[/?ROLE\]|</s>'))
    + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11
      ELSE 17 + length(role) + len(regexp_extract_all(role, '\\|\[/?INST\]|\[/?SYS\]|\[/?ROLE\]|</s>')) END AS chars FROM log
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
