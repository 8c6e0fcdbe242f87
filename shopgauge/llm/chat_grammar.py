r"""Conversations as training text, by a grammar whose parser gives the turns back.

A turn is rendered in lines: ``### role:``, the text, ``</turn>``.

    turn  = "### " role ":" newline text newline "</turn>" newline
    role  = what comes before the first plain newline, but for the colon
    text  = what comes before the first plain "</turn>", but for the newline

A control string ("### ", "</turn>", and the newline in roles) after
backslashes is not plain: it stands for itself with one backslash less.  No
other plain one may come within a role or a text.  (The colon and the newline
keep a last backslash of a role or text apart from the mark that follows.)  ``format_turns`` renders a turn as it is, parses that, and
compares.  Where the turn does not come back it escapes the control strings,
first of the text, then of the role too, until what is parsed equals the
source; a turn that no step brings back raises an error.  As each turn
starts and ends plainly, a conversation parses to its turns if each turn does.

Formatted text is a table of parts: whole turns of a conversation, about
``PART`` characters each (more only for a longer turn), with the loss mask as
spans of code points over the texts of trained roles.  ``read_back`` parses
parts in their order and checks spans against the grammar.  Turns are dealt
by range of (conversation, turn), so a conversation of any length lies in
several tasks; what crosses a task's border is finished after a second
shuffle, of such conversations' parts only.  Memory: one part and one turn.

* Null roles and texts are empty.  Turns of a conversation are ordered by
  turn (nulls first), then role, then a hash of the text; repeated rows are
  turns of their own.  Rows without a conv_id form one conversation, whose id
  is null.  An empty table gives no part.
* Only conv_id, turn, role and text are read; further columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import in_order

# Fixed values of the template.
OPEN, LINE, CLOSE = "### ", "\n", "</turn>"
BETWEEN, END = ":" + LINE, LINE + CLOSE + LINE
#: Roles whose texts are trained on.
TRAINED = ("assistant",)
#: Characters of a part, about.
PART = 1 << 18

_TEXT = re.compile(rf"(\\*)({re.escape(OPEN)}|{re.escape(CLOSE)})")
_ROLE = re.compile(rf"(\\*)({re.escape(OPEN)}|{re.escape(CLOSE)}|{LINE})")


def escaped(s: str, controls: re.Pattern) -> str:
    return controls.sub(r"\\\1\2", s)


def unescaped(s: str, controls: re.Pattern) -> str:
    """Takes a backslash from each control string; there must be no plain one."""
    return controls.sub(lambda m: m[0][1:], s)


class NotInGrammar(ValueError):
    pass


def _plain(s: str, at: int, controls: re.Pattern) -> re.Match:
    """The first control string from ``at`` on without a backslash."""
    for m in controls.finditer(s, at):
        if not m[1]:
            return m
    raise NotInGrammar(f"no control string after {at}")


def parse(s: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are where the escaped text stands."""
    at = 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise NotInGrammar(f"no turn starts at {at}")
        line = _plain(s, at + len(OPEN), _ROLE)
        colon = line.start() - 1
        if colon < at + len(OPEN) or not s.startswith(BETWEEN, colon):
            raise NotInGrammar(f"{line[2]!r} in a role at {line.start()}")
        close = _plain(s, line.end(), _TEXT)
        last = close.start() - 1
        if last < line.end() or not s.startswith(END, last):
            raise NotInGrammar(f"{close[2]!r} in a text at {close.start()}")
        yield unescaped(s[at + len(OPEN):colon], _ROLE), unescaped(s[line.end():last], _TEXT), line.end(), last
        at = last + len(END)


def _comes_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except NotInGrammar:
        return False


def render(role: str, text: str) -> str:
    """The turn in the form, with as little escaped as needed, that parses to itself."""
    for a, b in ((role, text), (role, escaped(text, _TEXT)), (escaped(role, _ROLE), escaped(text, _TEXT))):
        rendered = f"{OPEN}{a}{BETWEEN}{b}{END}"
        if _comes_back(rendered, role, text):
            return rendered
    raise NotInGrammar(f"a turn of {len(text)} characters does not come back")


# ---- formatting -------------------------------------------------------------
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.large_string()), ("mask", _SPANS)])
PARTS = "conv_id bigint, part bigint, text string, mask array<struct<start: bigint, end: bigint>>"


def _parts(turns: Iterator[tuple], task: int, most: int, trained: tuple[str, ...]) -> Iterator[dict]:
    """Parts of (conv_id, role, text) that come in order."""
    conv, rendered, spans, size, made = None, [], [], 0, task << 33
    for c, role, text in turns:
        if rendered and (c != conv or size >= most):
            yield {"conv_id": conv, "part": made, "text": "".join(rendered), "mask": spans}
            rendered, spans, size = [], [], 0
            made += 1
        conv, turn = c, render(role or "", text or "")
        if (role or "") in trained:
            *_, start, end = next(parse(turn))
            spans.append({"start": size + start, "end": size + end})
        rendered.append(turn)
        size += len(turn)
    if rendered:
        yield {"conv_id": conv, "part": made, "text": "".join(rendered), "mask": spans}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` characters of text, or 4096 rows."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r["text"] or "")
        if size >= most or len(some) == 4096:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def format_turns(conversations: DataFrame, trained: tuple[str, ...] = TRAINED, most: int = PART) -> DataFrame:
    """(conv_id, part, text, mask): parts of a conversation follow each other by ``part``, which rises within a task."""
    def formatted(batches):
        from pyspark import TaskContext

        turns = _rows(batches, ["conv_id", "role", "text"])
        return _batches(_parts(turns, TaskContext.get().partitionId(), most, trained), _PARTS)

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_text"))
    rows = in_order(rows, [F.col(c) for c in ("conv_id", "turn", "role", "_text")])
    return rows.select("conv_id", "role", "text").mapInArrow(formatted, PARTS)


# ---- reading back -----------------------------------------------------------
FOUND = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(),
         "formatted_chars": pa.int64()}
_READ = pa.schema([*_PARTS, *FOUND.items()])
READ = PARTS + ", n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
#: Parts of one conversation that a task keeps in case the conversation goes on in another task.
HOLD = 16


class Reader:
    """What is read back from one conversation's parts, given in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def take(self, text: str, mask: list[dict]) -> None:
        said, bodies = [], set()
        for role, words, start, end in parse(text):
            said += [role, "\n", words, "\n"]
            bodies.add((start, end))
            self.n_turns += 1
        self.turns.update("".join(said).encode())
        for span in mask:
            if (span["start"], span["end"]) not in bodies:
                raise NotInGrammar(f"the mask has {span}, which is no turn's text")
            words = unescaped(text[span["start"]:span["end"]], _TEXT)
            self.loss.update(words.encode())
            self.loss_chars += len(words)
        self.chars += len(text)

    def row(self, conv: int | None) -> dict:
        return {"conv_id": conv, "part": None, "text": None, "mask": None, "n_turns": self.n_turns,
                "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read(parts: list[tuple], conv: int | None) -> dict:
    r = Reader()
    for _, _, text, mask in parts:
        r.take(text, mask)
    return r.row(conv)


def _near(parts: Iterator[tuple], hold: int) -> Iterator[dict]:
    """Reads the conversations that begin and end here; parts of others go on as they are."""
    def on(some: list[tuple]) -> Iterator[dict]:
        return (dict(zip(_PARTS.names, p)) | dict.fromkeys(FOUND) for p in some)

    conv, held, foreign = None, [], None
    for p in parts:
        if foreign is None:
            conv, foreign = p[0], True  # the task's first conversation may have begun in another
        if p[0] != conv:
            if held:
                yield _read(held, conv)
            conv, held, foreign = p[0], [], False
        held.append(p)
        if foreign or len(held) > hold:
            yield from on(held)
            held, foreign = [], True
    yield from on(held)


def _far(rows: Iterator[tuple]) -> Iterator[dict]:
    """Reads each conversation whose parts come in order; rows already read are returned as they are."""
    conv, reader = None, None
    for row in rows:
        if row[2] is None:
            yield dict(zip(_READ.names, row))
            continue
        if reader is None or row[0] != conv:
            if reader:
                yield reader.row(conv)
            conv, reader = row[0], Reader()
        reader.take(row[2], row[3])
    if reader:
        yield reader.row(conv)


def _mapped(f: Callable[[Iterator[tuple]], Iterator[dict]], names: list[str]) -> Callable:
    return lambda batches: _batches(f(_rows(batches, names)), _READ)


def read_back(parts: DataFrame, dealt: bool = False, hold: int = HOLD) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation in ``parts``.

    ``dealt``: parts come straight from ``format_turns``, so a task has them in
    order and all of each conversation between its first and its last; those
    are read where they are.  Else (say, from a file) all parts are shuffled.
    A conversation's own digests are made by one task, as SHA-256 has to be.
    """
    if dealt:
        near = _mapped(lambda rows: _near(rows, hold), _PARTS.names)
        rows = parts.mapInArrow(near, READ)
    else:
        rows = parts.select("*", *[F.lit(None).cast(t).alias(n) for n, t in
                                   zip(FOUND, ("bigint", "string", "bigint", "string", "bigint"))])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_mapped(_far, _READ.names), READ).select("conv_id", *FOUND)
