"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing is assumed about
it: successive prefixes of a conversation are rendered, and what one rendering adds to
the one before is the turn's span. Where the earlier rendering is not the beginning of
the later one, the template has rewritten history, and the turn says so. Inside a span,
the text of a turn is located by rendering the same prefix with two probe texts that
differ in every place: what both share before and behind is the template's.

Turns stream through each task in order, one conversation after the other, so that a
conversation of any length is never gathered. A prefix of a black box is rendered from its
first turn, however long it is. A template that declares itself local (each turn reads alike
with and without the turns before it) is rendered in windows; each begins with turns of
the one before, whose spans must come out the same, or ``rewrites`` says that they do not.

Defined results: null texts and null roles count as empty; turns go by turn, nulls first,
then by role and text; repeated rows are turns of their own; rows with a null id are one
conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

WINDOW = 32
#: Two private-use characters that no template writes.
PROBES = "\ue000", "\ue001"

HEAD, TAIL = "### ", "\n</turn>\n"
CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ROLE_CONTROL = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
READ = re.compile(r"### ((?:\\.|[^\\:])*+):\n((?:\\.|(?!\n</turn>\n)[^\\#<]|#(?!##)|<(?!/turn>))*+)\n</turn>\n", re.DOTALL)


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    """Control strings, and the backslash itself, behind a backslash."""
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """The template of this library: ``### role:``, the text, ``</turn>``; each on its lines."""
    return "".join(f"{HEAD}{escaped(role, ROLE_CONTROL)}:\n{escaped(text)}{TAIL}" for role, text in turns)


#: Declares that a turn reads alike with and without the turns before it.
turn_template.local = True


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; anything that is not a turn raises."""
    turns, at = [], 0
    while at < len(formatted):
        match = READ.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        turns.append((unescaped(match[1]), unescaped(match[2])))
        at = match.end()
    return turns


@dataclass
class Piece:
    """What a turn added: its characters and where in them its text stands."""

    added: str
    text_start: int
    text_end: int
    rewrites: bool


class Renderer:
    """Renders one conversation turn by turn.

    Each turn is seen as what the prefix up to it adds to the prefix before, whatever the
    number of turns. With ``window``, for a template that is known to write each turn by
    itself, rendering starts again from the last turn after so many.
    """

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.before = ""
        self.last = ""

    def add(self, role: str, text: str) -> Piece:
        moved = False
        if self.window is not None and len(self.turns) >= self.window:
            # Start again from the last turn; it must read as it did with all before it.
            self.turns = self.turns[-1:]
            self.before = self.template(self.turns)
            moved = self.before != self.last
        now = self.template([*self.turns, (role, text)])
        rewrites = moved or not now.startswith(self.before)
        shared = len(commonprefix([self.before, now])) if rewrites else len(self.before)
        added = now[shared:]
        one, two = (self.template([*self.turns, (role, p)])[shared:] for p in PROBES)
        start = len(commonprefix([one, two]))
        behind = len(commonprefix([one[::-1], two[::-1]]))
        end = max(start, len(added) - behind)
        self.turns.append((role, text))
        self.before, self.last = now, added
        return Piece(added, min(start, len(added)), min(end, len(added)), rewrites)


def formatted(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    template: Template = turn_template,
    window: int | None = None,
    trained_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn: (conv_id, seq, role, piece, start, end, loss_start, loss_end, rewrites).

    The pieces of a conversation in the order of ``seq`` are its formatted text; the
    positions are code points of that text, and the loss span, null for roles that are
    not trained, holds the escaped text alone. A black-box template sees every prefix as it
    is, at a cost that grows with the square of a conversation's length; a template with a
    true attribute ``local``, as ``turn_template`` has, is rendered in windows.
    """
    if window is None and getattr(template, "local", False):
        window = WINDOW
    rows = conversations.select(
        F.col(conv_id).alias("id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, seq, at = object(), Renderer(template, window), 0, 0
        for batch in batches:
            out = []
            for own, who, said in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["role"], batch["text"], strict=True):
                if own != current:
                    current, state, seq, at = own, Renderer(template, window), 0, 0
                piece = state.add(who, said)
                loss = who in trained_roles
                out.append((own, seq, who, piece.added, at, at + len(piece.added), at + piece.text_start if loss else None,
                            at + piece.text_end if loss else None, piece.rewrites))
                seq, at = seq + 1, at + len(piece.added)
            yield pd.DataFrame(out, columns=COLUMNS)

    kind = dict(conversations.dtypes)[conv_id]
    schema = (
        f"id {kind}, seq bigint, role string, piece string, start bigint, end bigint, loss_start bigint, "
        "loss_end bigint, rewrites boolean"
    )
    return ordered.mapInPandas(each, schema).withColumnRenamed("id", conv_id)


COLUMNS = ["id", "seq", "role", "piece", "start", "end", "loss_start", "loss_end", "rewrites"]


def digests(pieces: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the formatted text of each conversation reads like, from the output alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites).
    The hashes run over all turns in order, so a conversation is one stream; it is read
    piece by piece and never held.
    """
    ordered = pieces.withColumnRenamed(conv_id, "id").repartition("id").sortWithinPartitions("id", "seq")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, done = None, []
        for batch in batches:
            batch["id"] = batch["id"].astype(object).where(batch["id"].notna(), None)
            for row in batch.itertuples(index=False):
                if reader is None or row.id != reader.id:
                    done += [reader.result()] if reader else []
                    reader = _Reader(row.id)
                reader.take(row)
            yield pd.DataFrame(done, columns=DIGESTS)
            done = []
        if reader:
            yield pd.DataFrame([reader.result()], columns=DIGESTS)

    schema = (
        f"id {dict(pieces.dtypes)[conv_id]}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, rewrites boolean"
    )
    return ordered.mapInPandas(each, schema).withColumnRenamed("id", conv_id)


DIGESTS = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]


class _Reader:
    def __init__(self, own):
        self.id, self.n_turns, self.loss_chars, self.chars, self.rewrites = own, 0, 0, 0, False
        self.turns, self.loss = sha256(), sha256()

    def take(self, row) -> None:
        self.chars += len(row.piece)
        self.rewrites |= bool(row.rewrites)
        for role, text in read_back(row.piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if not pd.isna(row.loss_start):
            text = unescaped(row.piece[int(row.loss_start) - row.start : int(row.loss_end) - row.start])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def result(self) -> tuple:
        return (self.id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites)
