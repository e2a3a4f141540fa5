"""Chat formatting: records of many layouts into canonical turns, and turns into one template with a loss mask.

A record is a JSON object. The set of its nested field paths that any layout knows (`messages[].content`), hashed, is its schema
fingerprint; the fingerprint selects the layout, a declaration of where roles and texts are. Every layout is entered under the
fingerprint of its required paths with each choice of its optional ones, so selecting is one lookup. A record whose fingerprint no
layout has isn't guessed at: `unmapped` counts such records by fingerprint and shows their paths, for a layout to be added.

The template is `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. In roles and texts a backslash goes before the `|` of `<|`,
and one more where there are some already, so no text can hold a control string and every text can be read back. Roles write `%` and
line feeds as %25 and %0A.

The output is a row for each turn: its piece of the conversation's formatted text, where the piece begins, and the masked span of
assistants' texts (code points from the conversation's start). Turns are sorted by one range exchange, so a conversation may lie on
many tasks; a task adds up its own turns, and the sums of the tasks before are added to conversations that began there (at most one a task).

Defined cases: null roles and texts are empty; turns go by turn (null first), place in their record, role and text, so repeated
rows are turns of their own; a null conversation id is a conversation; an empty table gives no rows; lists of messages may be empty; values
that are no strings are taken as JSON; malformed JSON and records that are no object are unmapped, with a null fingerprint; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are trained on.
TRAINED = "assistant"


@dataclass(frozen=True)
class Layout:
    """turns: for each turn its role (a path if it starts with `@`) and the paths whose texts it joins with an empty line. With `each`,
    every item of that list is a turn of the kinds with a path as role, whose paths start from the item; turns of fixed roles come
    before them. Paths in `optional` may be absent; those in `beside` are in the record and aren't used. roles: other names of the
    canonical roles."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    each: str = ""
    order: str = ""
    optional: tuple[str, ...] = ()
    beside: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        found = set(self.beside) | ({self.order} if self.order else set())
        for role, texts in self.turns:
            found |= {f"{self.each}[].{p}" if self.each else p for p in (role[1:], *texts)} if role[0] == "@" else set(texts)
        return found

    def choices(self) -> Iterator[set[str]]:
        """The path sets that the layout is entered under."""
        for n in range(len(self.optional) + 1):
            for absent in itertools.combinations(self.optional, n):
                yield self.paths() - set(absent)


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("row", (("@role", ("text",)),), order="turn", optional=("turn",)),
    Layout("messages", (("@role", ("content",)),), each="messages", optional=("messages[].content",)),
    Layout("message_parts", (("@role", ("content", "content[].text")),), each="messages", optional=("messages[].content",), beside=("messages[].content[].type",)),
    Layout("from_value", (("@from", ("value",)),), each="conversations", roles=_SPEAKERS),
    Layout("from_value_system", (("system", ("system",)), ("@from", ("value",))), each="conversations", roles=_SPEAKERS),
    Layout("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("instruction_response", (("user", ("instruction", "context")), ("assistant", ("response",))), optional=("context",)),
    Layout("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("preferred", (("@role", ("content",)),), each="chosen", optional=("prompt",), beside=("prompt", "rejected[].role", "rejected[].content")),
    Layout("prompt_preferred", (("user", ("prompt",)), ("assistant", ("chosen",))), beside=("rejected",)),
)


def paths_of(record: dict) -> set[str]:
    """The paths of a record's values; `[]` stands for the items of a list. Nulls have no path."""
    found, left = set(), [("", record)]
    while left:
        path, value = left.pop()
        if isinstance(value, dict):
            left += [(f"{path}.{_key(k)}" if path else _key(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            left += [(path + "[]", v) for v in value]
        elif value is not None:
            found.add(path)
    return found


def _key(name: str) -> str:
    return re.sub(r"[.\[\\]", lambda m: "\\" + m[0], name)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


class Registry:
    """Layouts by fingerprint."""

    def __init__(self, layouts: Sequence[Layout]):
        self.known = {p for x in layouts for p in x.paths()}
        self.by_fingerprint: dict[str, Layout] = {}
        for x in layouts:
            for choice in x.choices():
                other = self.by_fingerprint.setdefault(fingerprint(choice), x)
                if other is not x:
                    raise ValueError(f"layouts {other.name} and {x.name} have the same paths {sorted(choice)}")

    def select(self, paths: set[str]) -> tuple[str, Layout | None]:
        print_ = fingerprint(paths & self.known)
        return print_, self.by_fingerprint.get(print_)


def _values(value: object, path: str) -> list:
    """What stands at a path, in order."""
    found = [value]
    for step in path.split("."):
        name, depth = step.rstrip("[]"), step.count("[]")
        found = [x[name] for x in found if isinstance(x, dict) and x.get(name) is not None]
        for _ in range(depth):
            found = [y for x in found if isinstance(x, list) for y in x if y is not None]
    return found


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _joined(value: object, path: str) -> list[str]:
    """The text at a path: of a list of parts, all of them; nothing where another path reaches further down."""
    found = [x for x in _values(value, path) if not isinstance(x, (dict, list))]
    return ["".join(map(_text, found))] if found else []


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn. A turn of fixed role whose paths are all absent is none."""
    for role, texts in layout.turns:
        if role[0] != "@":
            found = [t for p in texts for t in _joined(record, p)]
            if found:
                yield role, "\n\n".join(t for t in found if t)
    for item in _values(record, layout.each + "[]") if layout.each else [record]:
        for role, texts in layout.turns:
            if role[0] == "@":
                name = "".join(_joined(item, role[1:]))
                yield layout.roles.get(name, name), "\n\n".join(t for p in texts for t in _joined(item, p) if t)


TURNS = "turn long, part int, role string, text string, layout string, fingerprint string, paths string"


def _canonical(batches: Iterator[pa.RecordBatch], layouts: Sequence[Layout]) -> Iterator[pa.RecordBatch]:
    registry = Registry(layouts)
    utf8 = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731  escaped surrogates have no UTF-8
    for batch in batches:
        row, out = [], []
        for i, raw in enumerate(batch.column("record").to_pylist()):
            try:
                record = json.loads(raw) if raw is not None else None
            except (ValueError, RecursionError):
                record = None
            if not isinstance(record, dict):
                row.append(i)
                out.append((None, None, None, None, None, None, None))
                continue
            paths = paths_of(record)
            print_, layout = registry.select(paths)
            if layout is None:
                row.append(i)
                out.append((None, None, None, None, None, print_, utf8(", ".join(sorted(paths)))))
                continue
            order = _values(record, layout.order) if layout.order else []
            for part, (role, text) in enumerate(turns_of(record, layout)):
                row.append(i)
                out.append((order[0] if order else None, part, utf8(role), utf8(text), layout.name, print_, None))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id").take(pa.array(row, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["conv_id", "turn", "part", "role", "text", "layout", "fingerprint", "paths"],
        )


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """The turns of records: conv_id, turn, part, role, text, layout, fingerprint. An unmapped record is a row without a layout."""
    rows = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).cast("string").alias("record"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    Registry(layouts)  # so that layouts that clash are told at once
    return rows.mapInArrow(functools.partial(_canonical, layouts=tuple(layouts)), f"conv_id {kind}, {TURNS}")


def unmapped(turns: DataFrame) -> DataFrame:
    """fingerprint, records, paths (of one of them)."""
    return turns.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("records"), F.min("paths").alias("paths"))


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def piece_of(role: str, text: str) -> tuple[str, int, int]:
    """A turn's part of the formatted text, and the span of its text in it."""
    head = f"{START}{escaped(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
    body = escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_PIECE = re.compile(re.escape(START) + r"([^\n]*)\n((?:(?!<\|).)*)" + re.escape(END) + "\n", re.S)


def turn_of(piece: str) -> tuple[str, str]:
    """The role and text of a piece."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError(f"no turn: {piece[:100]!r}")
    return unescaped(found[1]).replace("%0A", "\n").replace("%25", "%"), unescaped(found[2])


PIECES = "turn long, part int, piece string, begin long, loss_begin long, loss_end long, chars long, task int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats sorted turns; offsets count from the conversation's first turn in this task."""
    last, begin, task = object(), 0, TaskContext.get().partitionId()
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            begin, last = (begin if conv == last else 0), conv
            piece, low, high = piece_of(role, text)
            trained = role == TRAINED
            out.append((piece, begin, begin + low if trained else None, begin + high if trained else None, len(piece), task))
            begin += len(piece)
        kinds = (pa.string(), *[pa.int64()] * 4, pa.int32())
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "part")), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["conv_id", "turn", "part", "piece", "begin", "loss_begin", "loss_end", "chars", "task"],
        )


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, piece, begin, loss_begin, loss_end (null: nothing of this turn is trained on), chars, in the order of conv_id and begin."""
    rows = turns.where("layout is not null").select("conv_id", "turn", "part", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "part", "role"]
    # Range bounds are samples of the keys, which the driver holds: the start of a text is enough to part them.
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    pieces = written(ranged.mapInArrow(_pieces, f"conv_id {kind}, {PIECES}"))
    sums = pieces.groupBy("conv_id", "task").agg(F.sum("chars").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("sum")
    shifts = sums.select(F.col("conv_id").alias("of"), F.col("task").alias("in"), before.alias("shift")).where("shift > 0")  # one a task at most
    joined = pieces.join(F.broadcast(shifts), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in")), "left")
    shift = F.coalesce("shift", F.lit(0))
    return joined.select("conv_id", "turn", "part", "piece", *((F.col(c) + shift).alias(c) for c in ("begin", "loss_begin", "loss_end")), "chars")


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """What the formatted text of one conversation says, piece after piece."""

    def __init__(self, conv: object):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, begin: int, loss_begin: int | None, loss_end: int | None) -> None:
        if begin != self.chars:
            raise ValueError(f"conversation {self.conv}: a piece at {begin}, {self.chars} expected")
        role, text = turn_of(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if loss_begin is not None:
            masked = unescaped(piece[loss_begin - begin : loss_end - begin])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.n_turns, self.chars = self.n_turns + 1, self.chars + len(piece)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, done, kind = None, [], pa.int64()

    def rows(kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*done)) if done else [()] * len(kinds)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, piece, *span in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "begin", "loss_begin", "loss_end"))):
            if reader is None or reader.conv != conv:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv)
            reader.add(piece, *span)
        yield rows(kind)
    if reader:
        done.append(reader.row())
        yield rows(kind)


def read_back(pieces: DataFrame) -> DataFrame:
    """Of each conversation, from its pieces: n_turns, digest of its turns, length and digest of the masked texts, formatted length.

    A digest of a whole conversation is one chain, so its pieces go to one task; they pass through it in order and aren't held there."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    rows = pieces.select("conv_id", "piece", "begin", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "begin")
    return rows.mapInArrow(_read, f"conv_id {kind}, {READ}")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as records of the layout `row`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("conv_id", F.to_json(F.struct("turn", text("role"), text("text"))).alias("record"))
