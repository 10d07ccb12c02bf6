"""Chat formatting with loss masks found by incremental black-box rendering."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

#: Control strings of the standard template.
MARK, END = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every control string and every backslash, so that no text can end a turn or open another."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


ROLES = ("system", "user", "assistant", "tool")


def standard_template(turns: list[Turn]) -> str:
    """``### Role: text </turn>`` per turn; a role beyond the usual ones is written after ``=``."""
    head = {r: r.capitalize() for r in ROLES}
    return "".join(f"{MARK}{head.get(role) or '=' + escape(role).replace(':', chr(92) + ':')}: {escape(text)}{END}" for role, text in turns)


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*) </turn>\n", re.S)


def read_turns(formatted: str) -> list[Turn]:
    """The turns in an output of ``standard_template``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.group(1)
        turns.append((unescape(role[1:]) if role.startswith("=") else role.lower(), unescape(m.group(2))))
        at = m.end()
    return turns


def _common(a: str, b: str, ahead: bool = True) -> int:
    """Length of the common start (or end) of two strings."""
    n = min(len(a), len(b))
    if not ahead:
        a, b = a[len(a) - n :][::-1], b[len(b) - n :][::-1]
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the start of length low agrees, that of length high does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Located:
    """Where the turns of one output are: spans of whole turns and of the trained texts, and the first turn that a later one rewrote."""

    def __init__(self, text: str, turns: list[tuple[int, int]], loss: list[tuple[int, int]], rewritten: int | None):
        self.text, self.turns, self.loss, self.rewritten = text, turns, loss, rewritten


def _by_prefixes(template: Template, turns: list[Turn], begin: int, trained: frozenset[str]) -> Located:
    """Render ``turns[:begin]``, then one turn more at a time, and compare consecutive outputs.

    What a turn adds is its span.  A turn's text is found with two renderings
    in which only its text differs: their common start and end are the
    template's.  Where an output does not continue the one before, the turns
    behind the change lose their loss spans: their text is not in the final
    output as it was located.
    """
    before = template(turns[:begin])
    spans: list[tuple[int, int]] = []
    loss: list[tuple[int, tuple[int, int]]] = []
    rewritten = None
    for i in range(begin, len(turns)):
        now = template(turns[: i + 1])
        start = len(before) if now.startswith(before) else _common(before, now)
        if start < len(before):
            changed = [n for n, s in enumerate(spans) if s[1] > start]
            first = begin + (changed[0] if changed else 0)
            rewritten = first if rewritten is None else min(rewritten, first)
            loss = [(n, s) for n, s in loss if s[1] <= start]
            spans = [(min(a, start), min(b, start)) for a, b in spans]
        if turns[i][0] in trained:
            one, two = (template(turns[:i] + [(turns[i][0], probe)]) for probe in ("x", "y"))
            head, tail = _common(one, two), _common(one, two, ahead=False)
            if now[:head] == one[:head] and len(now) - tail >= head and now[len(now) - tail :] == one[len(one) - tail :]:
                loss.append((i, (head, len(now) - tail)))
        spans.append((start, len(now)))
        before = now
    return Located(before, spans, [s for _, s in loss], rewritten)


def locate(template: Template, turns: list[Turn], trained: frozenset[str] = frozenset({"assistant"}), block: int = 64) -> Located:
    """Spans of the turns in ``template(turns)`` by rendering successive prefixes.

    A long conversation is cut into blocks of ``block`` turns whose prefixes
    start one turn before the block.  The blocks' pieces must make up the
    rendering of the whole, and nothing in them may be rewritten; else every
    prefix of the whole is rendered.
    """
    if len(turns) <= block:
        return _by_prefixes(template, turns, 0, trained)
    spans: list[tuple[int, int]] = []
    loss: list[tuple[int, int]] = []
    whole, at, parts = template(turns), 0, []
    for begin in range(0, len(turns), block):
        known = min(begin, 1)
        part = _by_prefixes(template, turns[begin - known : begin + block], known, trained)
        skip = part.turns[0][0]
        if part.rewritten is not None:
            return _by_prefixes(template, turns, 0, trained)
        parts.append(part.text[skip:])
        spans += [(a - skip + at, b - skip + at) for a, b in part.turns]
        loss += [(a - skip + at, b - skip + at) for a, b in part.loss]
        at += len(part.text) - skip
    if "".join(parts) != whole:
        return _by_prefixes(template, turns, 0, trained)
    return Located(whole, spans, loss, None)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def format_chats(conversations: DataFrame, template: Template = standard_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, turn_spans, loss_spans, rewritten_from`` per conversation.

    Rows of a conversation are put in the order of ``turn`` (nulls first; ties
    by role, then text; repeated rows are turns of their own).  A null role or
    text is empty; rows with a null conv_id are one conversation; other
    columns are not read; an empty table gives no row.  Offsets are code
    points.  ``loss_spans`` cover the trained roles' texts as the template
    wrote them; ``rewritten_from`` is the first turn that a later turn
    rewrote, null for templates that only append.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles = frozenset(trained)
        for b in batches:
            ids, found = b.column(0), []
            for turns in b.column(1).to_pylist():
                found.append(locate(template, [(t["role"], t["text"]) for t in turns], roles))
            spans = lambda get: pa.array([[{"start": a, "end": z} for a, z in get(x)] for x in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x.text for x in found], pa.string()), spans(lambda x: x.turns), spans(lambda x: x.loss), pa.array([x.rewritten for x in found], pa.int64())],
                ["conv_id", "formatted", "turn_spans", "loss_spans", "rewritten_from"],
            )

    empty = F.lit("")
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    # A conversation is one training text: like a text, it is held by one task.
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return grouped.mapInArrow(run, "conv_id long, formatted string, turn_spans array<struct<start:bigint,end:bigint>>, loss_spans array<struct<start:bigint,end:bigint>>, rewritten_from long")


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts read back from outputs of the standard template, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = read_turns(text)
                trained = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                of_turns = hashlib.sha256()
                for role, said in turns:
                    of_turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), of_turns.hexdigest(), len(trained), hashlib.sha256(trained.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
