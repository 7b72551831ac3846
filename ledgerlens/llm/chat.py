"""Chat formatting by incremental black-box rendering.

A template is any function from messages to one string.  It is called on successive
prefixes of a conversation; what a prefix adds to the output of the one before is the
new turn.  Where the text stands inside a turn is found by rendering the same prefix
with two other texts.  A template whose output does not begin with what it said before
rewrites history and is reported.

Only a template that is marked ``by_turn`` is rendered in segments; any other sees every
turn with the whole conversation before it.  The mark is checked at linear cost, whatever the
length: the whole conversation is rendered once more, and where that is not what the segments
say, its turns are rendered with their whole history as for any other template.  A template
that is made of a function of one turn (``from_turns``) needs no check and is never held.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import narrow_batches

# The control strings of the default template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
SEGMENT_TURNS = 32
#: Without effect: marks are checked at every length.  Callers may still set it.
CHECKED_CHARS = 16 << 20
OUT_CHARS = 4 << 20

Spans = list[tuple[int, int] | None]
Template = Callable[[list[tuple[str, str]]], str]


def by_turn(template: Template) -> Template:
    """Mark a template whose output for a conversation is that for its turns one by one, joined."""
    template.by_turn = True
    return template


def escape(text: str) -> str:
    """Break control strings with a backslash and a bar after their first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\|{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", lambda m: "\\" if m[1] == "\\" else "", text)


def from_turns(turn: Callable[[str, str], str]) -> Template:
    """A template that joins what ``turn(role, text)`` says, so it is by turn as it is made."""
    @functools.wraps(turn)
    def template(messages: list[tuple[str, str]]) -> str:
        return "".join(turn(role, text) for role, text in messages)

    template.from_turns = True
    return by_turn(template)


@from_turns
def bracket_template(role: str, text: str) -> str:
    """The default: role and text of every turn between control strings, both escaped."""
    return f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read back what ``bracket_template`` wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _begin(template: Template) -> str:
    """What is said without any turn; a template that refuses that says nothing."""
    try:
        return template([])
    except Exception:
        return ""


def spans(template: Template, messages: list[tuple[str, str]]) -> tuple[str, Spans | None, bool]:
    """Output for all messages, the span of each text in it, and whether history was rewritten.

    A turn has no span (None) if its text is shown in no place or in several.  Once history
    was rewritten there are no spans at all: those of earlier turns are places in earlier outputs.
    """
    said, found, rewritten = _begin(template), [], False
    for i, (role, text) in enumerate(messages):
        before = messages[:i]
        now = template([*before, (role, text)])
        rewritten |= not now.startswith(said)
        a, b = (template([*before, (role, mark)]) for mark in ("\ue000", "\ue001"))
        low = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        once = len(a) == len(b) > low and a[low + 1:] == b[low + 1:]
        found.append((low, max(low, len(now) - (len(a) - low - 1))) if once else None)
        said = now
    return said, None if rewritten else found, rewritten


def format_conversations(
    conversations: DataFrame, template: Template = bracket_template, loss_role: str = "assistant",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """``conv_id, segment, turns, formatted, spans, loss, rewrites_history``, one row per segment.

    Rows of a conversation stream in turn order (ties by role and text, null turns
    first) through one sorted task.  Of a template made ``from_turns`` only ``segment_turns``
    turns are held and rendered together, so a conversation of any length needs bounded memory
    and linear time, and its segments follow one another.  Of one that is marked ``by_turn`` a
    conversation is held and also rendered whole, whatever its length; where that is not what
    the segments say, the mark is wrong and the template is treated as one without it.  With
    any other template a conversation is one segment: it is held whole
    and rendered up to each of its turns, in time that grows with the square of its turns.
    ``spans`` and ``loss`` are character ranges of ``formatted``; a turn without a place of its
    own has a null span, ``loss`` is null if such a turn belongs to it, and both are null where
    history was rewritten.  Null texts and roles are empty; rows without a conversation
    id form one conversation; other columns are ignored.
    """
    narrow_batches(conversations.sparkSession, 1024)
    most = segment_turns if getattr(template, "by_turn", False) else None
    of_turns = getattr(template, "from_turns", False)
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ranges = "array<array<int>>"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "segment", "turns", "formatted", "spans", "loss", "rewrites_history"]
        pair = pa.list_(pa.list_(pa.int32()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pair, pair, pa.bool_()]

        def made(conv, segment, messages):
            text, found, rewritten = spans(template, messages)
            loss = None
            if found is not None:
                loss = [s for s, (role, _) in zip(found, messages) if role == loss_role]
                loss = None if None in loss else loss
            return conv, segment, len(messages), text, found, loss, rewritten

        def batch_of(made_rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made_rows), kinds)], names)

        def conversation(conv, messages):
            """Segments of one conversation whose messages are read one by one."""
            if most is None:
                yield made(conv, 0, list(messages))
                return
            if not of_turns:
                # Segments that begin anew must say what the whole conversation says.
                messages = list(messages)
                if len(messages) > most and not joined(messages):
                    yield made(conv, 0, messages)
                    return
            for segment, held in enumerate(itertools.batched(messages, most)):
                yield made(conv, segment, list(held))

        def joined(messages):
            """Whether the whole conversation's output is that of its segments, one after the other."""
            said, at = template(messages), 0
            for held in itertools.batched(messages, most):
                text = template(list(held))
                if not said.startswith(text, at):
                    return False
                at += len(text)
            return at == len(said)

        def messages_of():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))

        out, size = [], 0
        for conv, turns in itertools.groupby(messages_of(), key=lambda row: row[0]):
            for row in conversation(conv, ((role, text) for _, role, text in turns)):
                out.append(row)
                size += len(row[3])
                if size > OUT_CHARS:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(
        render,
        f"conv_id bigint, segment bigint, turns int, formatted string, spans {ranges}, loss {ranges}, rewrites_history boolean",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: turns and loss with their hashes.

    Where ``loss`` is null its length and hash are null, too.  Segments stream in order through one sorted task and the hashes take them one by one.
    """
    rows = formatted.select("conv_id", "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, chars, loss_chars, masked = None, True, 0, 0, 0, True
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv, _, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if first or conv != key:
                    if not first:
                        out.append((key, n, turns.hexdigest(), loss_chars if masked else None, loss.hexdigest() if masked else None, chars))
                    key, first, n, chars, loss_chars, masked = conv, False, 0, 0, 0, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                masked &= mask is not None
                for low, high in mask or ():
                    said = unescape(text[low:high])
                    loss_chars += len(said)
                    loss.update(said.encode())
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if not first:
            out = [(key, n, turns.hexdigest(), loss_chars if masked else None, loss.hexdigest() if masked else None, chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(
        read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
