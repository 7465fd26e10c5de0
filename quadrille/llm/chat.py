"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive turn prefixes are rendered; where one
output begins with the one before, the rest is the turn's span, else the template rewrites history. Within a span,
the text is located by rendering the turn again with a mark in place of its text. Nothing is assumed of the template but
that what surrounds a text doesn't depend on it, which is checked.

A template may declare that it is ``concatenative`` (a conversation's output is that of its parts in a row). Then a long
conversation is rendered in blocks of BLOCK turns, in linear time and bounded memory, and the claim is checked at each
seam; otherwise every prefix is rendered from the first turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
BLOCK = 32
_MARK = "\ue000"


@dataclass(frozen=True)
class Template:
    """A renderer, and how to read texts back from its output."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Turn]]
    concatenative: bool = False


class DependsOnText(ValueError):
    """What surrounds the text of turn ``turn`` depends on it, so its place in the output can't be told."""

    def __init__(self, turn: int):
        super().__init__(f"the surroundings of turn {turn} depend on its text")
        self.turn = turn


class RewritesHistory(ValueError):
    """The output for the first ``turn`` + 1 turns doesn't begin with that for the first ``turn``."""

    def __init__(self, turn: int):
        super().__init__(f"the template rewrites history at turn {turn}")
        self.turn = turn


_ESCAPE = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c", "\n": "\\n"}
_UNESCAPE = {"\\": "\\", "l": "<", "h": "#", "c": ":", "n": "\n"}


def escape(text: str, role: bool = False) -> str:
    """Without '<', '#' (in a role also ':' and line ends), so that no control string can occur; see unescape."""
    return re.sub(r"[\\<#:\n]" if role else r"[\\<#]", lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPE[m[1]], text)


def _render(turns: list[Turn]) -> str:
    return "".join(f"### {escape(r, True)}: {escape(t)}</turn>\n" for r, t in turns)


def _parse(output: str) -> list[Turn]:
    found = [m for m in re.finditer(r"### ([^:<#\n]*): ([^<#]*)</turn>\n", output)]
    if sum(m.end() - m.start() for m in found) != len(output):
        raise ValueError("not an output of this template")
    return [(unescape(m[1]), unescape(m[2])) for m in found]


#: "### role: text</turn>" lines; backslash escapes keep "###" and "</turn>" out of texts and roles.
MARKED = Template(_render, unescape, _parse, concatenative=True)


def locate(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The whole output, and for each turn (start, end) of its span and (start, end) of its text within the output."""
    before, spans = render([]), []
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            raise RewritesHistory(k)
        probe = render([*turns[:k], (role, _MARK)])
        at = probe.rfind(_MARK)
        tail = len(probe) - at - len(_MARK)
        end = len(now) - tail
        if at < len(before) or end < at or now[:at] != probe[:at] or now[end:] != probe[at + len(_MARK) :]:
            raise DependsOnText(k)
        spans.append((len(before), len(now), at, end))
        before = now
    return before, spans


def rewrites(turns: list[Turn], render: Callable[[list[Turn]], str]) -> list[int]:
    """The turns at which the template rewrites what it made of the turns before."""
    outs = [render(turns[:k]) for k in range(len(turns) + 1)]
    return [k for k in range(len(turns)) if not outs[k + 1].startswith(outs[k])]


class Formatter:
    """Formats one conversation, fed turn by turn, and digests what can be read back from the output."""

    def __init__(self, template: Template, roles: frozenset[str], keep: bool):
        self.template, self.roles, self.keep = template, roles, keep
        self.held: list[Turn] = []
        self.last: list[Turn] = []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.n_loss = self.n_out = 0
        self.rewritten: int | None = None
        self.depends: int | None = None
        self.output: list[str] = []
        self.spans: list[tuple[int, int]] = []

    def feed(self, role: str, text: str) -> None:
        self.held.append((role, text))
        if self.template.concatenative and len(self.held) == BLOCK:
            self._block()

    def _block(self) -> None:
        render, block = self.template.render, self.held
        self.held = []
        if self.last and block and render([*self.last, block[0]]) != render(self.last) + render(block[:1]):
            raise ValueError("the template isn't concatenative")
        self.last = block[-1:]
        try:
            output, spans = locate(block, render)
        except (RewritesHistory, DependsOnText) as e:
            if self.rewritten is None and self.depends is None:
                self.rewritten, self.depends = (self.n + e.turn if isinstance(e, kind) else None for kind in (RewritesHistory, DependsOnText))
            self.n += len(block)
            return
        for role, text in self.template.parse(output):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for (role, _), (_, _, a, b) in zip(block, spans, strict=True):
            if role in self.roles:
                text = self.template.unescape(output[a:b])
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.n_loss += len(text)
                if self.keep:
                    self.spans.append((self.n_out + a, self.n_out + b))
        self.n += len(block)
        self.n_out += len(output)
        if self.keep:
            self.output.append(output)

    def finish(self) -> tuple:
        self._block()
        if self.rewritten is not None or self.depends is not None:
            out = (self.n, None, None, None, None, self.rewritten, self.depends)
            return (*out, None, None) if self.keep else out
        out = (self.n, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_out, None, None)
        return (*out, "".join(self.output), [{"start": a, "end": b} for a, b in self.spans]) if self.keep else out


def format_chats(turns: DataFrame, template: Template = MARKED, loss_roles: frozenset[str] = frozenset({"assistant"}), with_output: bool = False) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text), its rows in order of turn.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten_at, depends_at[, output,
    loss_spans]. Digests are of what is read back from the output. If the template rewrites history, rewritten_at is
    the first such turn; if it surrounds a text by what depends on the text, depends_at is; and the rest is null. Null roles and texts are empty; null turns come first; equal turns are
    ordered by role and text; rows that repeat are turns of their own; rows with a null conv_id are one
    conversation. Other columns are ignored. An empty table gives an empty result.

    Rows stream through partitions sorted by conversation. A conversation is one task's work, as its digest runs over
    its turns in order, but not more than BLOCK of its turns are held (without ``with_output``).
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at", "depends_at", "output", "loss_spans"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long, depends_at long"
    if with_output:
        schema += ", output string, loss_spans array<struct<start:long,end:long>>"
    else:
        names, types = names[:8], types[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chat = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chat is None or conv != now:
                    if chat is not None:
                        out.append((now, *chat.finish()))
                    now, chat = conv, Formatter(template, loss_roles, with_output)
                chat.feed(role, text)
            yield batch(out)
        if chat is not None:
            yield batch([(now, *chat.finish())])

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, schema)
