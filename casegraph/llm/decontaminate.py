"""Benchmark decontamination with one Aho-Corasick automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the A-Z-lower-cased text: ASCII letters and digits, and
every character beyond ASCII. A window is `size` consecutive words of an item; an item with fewer words, but
not none, is one window.

The automaton reads word numbers, as a few letters of a small alphabet each. Its patterns are the short items, and each item
cut into pieces of size / 2 words: every window holds a whole piece, so wherever one occurs, the windows around it are
looked up in a sorted list of all windows and compared word by word. A trie of all windows' characters would need
some 450 bytes a byte of benchmark text, this model needs about 32 (measured: 162 MB for 5 MB). A text is read once. A hit word is mapped back to byte offsets of the original text.

The model is broadcast. Items are taken in blocks of at most `block_bytes` UTF-8 bytes, so its size has a bound. A benchmark
of several blocks costs as many passes over a written copy of the documents, whose rows carry a number.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; an item
without an id marks words but is not listed; items with equal ids count once; repeated rows are judged one by one;
empty tables give empty or clean results; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8, written

#: Separators become spaces, A-Z become a-z, other bytes stay.
NORMAL = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: An odd multiplier for the hash of a window.
ODD = 0x9E3779B97F4A7C15
#: Letters: the automaton searches a node's children one by one, so a letter is one of few.
BASE = 128


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(NORMAL).split() if raw else []


class Matcher:
    """The automaton over (item id, text) pairs and the sorted windows of the longer items."""

    def __init__(self, items: list[tuple[str | None, str]], size: int) -> None:
        self.size, self.piece = size, size // 2
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        numbered = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(t.encode("utf-8", "replace"))] for _, t in items]
        pieces: set[tuple[int, ...]] = set()
        short: dict[tuple[int, ...], list[int]] = {}
        for k, words in enumerate(numbered):
            if len(words) >= size:
                pieces.update(tuple(words[i : i + self.piece]) for i in range(0, len(words) - self.piece + 1, self.piece))
            elif words:
                short.setdefault(tuple(words), []).append(k)
        self.width = 1
        while BASE**self.width <= len(self.number):
            self.width += 1
        spelled = lambda k: "".join(chr(1 + k // BASE**j % BASE) for j in reversed(range(self.width)))
        self.spelling = {w: spelled(k) for w, k in self.number.items()}
        self.unknown = "\0" * self.width
        names = list(self.spelling.values())
        self.automaton = ahocorasick.Automaton()
        for p in pieces | short.keys():
            self.automaton.add_word("".join(names[k - 1] for k in p), (len(p), p in pieces, short.get(p)))
        if pieces or short:
            self.automaton.make_automaton()

        long = [k for k, words in enumerate(numbered) if len(words) >= size]
        self.words = np.array([w for k in long for w in numbered[k]], np.uint32)
        lengths = np.array([len(numbered[k]) for k in long], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        self.begin = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(starts, starts[1:])]) if long else np.zeros(0, np.int64)
        self.owner = np.repeat(np.array(long, np.int64), lengths - size + 1) if long else np.zeros(0, np.int64)
        at = np.zeros(len(self.begin), np.uint64)
        for i in range(size):
            at = at * np.uint64(ODD) + self.words[self.begin + i] + np.uint64(1)
        order = np.argsort(at, kind="stable")
        self.at, self.begin, self.owner = at[order], self.begin[order], self.owner[order]

    def owners(self, window: list[int]) -> set[int]:
        """The items that hold these words."""
        at = 0
        for w in window:
            at = (at * ODD + w + 1) & 0xFFFFFFFFFFFFFFFF
        low, high = np.searchsorted(self.at, np.uint64(at)), np.searchsorted(self.at, np.uint64(at), "right")
        own = np.array(window, np.uint32)
        return {int(self.owner[j]) for j in range(low, high) if np.array_equal(self.words[self.begin[j] : self.begin[j] + self.size], own)}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, number of words, items) of each window in a text; repeated where several pieces lead to it."""
        if not len(self.automaton):
            return
        spelling, unknown, seen = self.spelling, self.unknown, -1
        for end, (n, piece, items) in self.automaton.iter("".join([spelling.get(w, unknown) for w in words])):
            if (end + 1) % self.width:
                continue  # not the end of a word
            first = (end + 1) // self.width - n
            if items:
                yield first, n, set(items)
            if piece:
                # Windows that begin up to a piece earlier; those before `seen` were looked up for the last piece.
                low, high = max(first - self.size + self.piece, seen + 1, 0), min(first, len(words) - self.size)
                for a in range(low, high + 1):
                    found = self.owners([self.number.get(w, 0) for w in words[a : a + self.size]])
                    if found:
                        yield a, self.size, found
                seen = max(seen, high)


@functools.lru_cache(maxsize=1)
def _matcher(items: Broadcast, size: int) -> Matcher:
    return Matcher(items.value, size)


def _runs(words: list[bytes], matcher: Matcher) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs [from, to) of hit words, and the items found."""
    pairs: list[tuple[int, int]] = []
    items: set[int] = set()
    for first, n, owners in matcher.find(words):
        pairs.append((first, first + n))
        items |= owners
    runs: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs, items


def _spans(raw: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte offsets in the original text of runs of words."""
    flags = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, a bounded block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.octet_length(F.col(text_col).cast("string"))).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text, n in rows.toLocalIterator():
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start: long, end: long>>, runs array<struct<a: long, b: long>>"


def _scan(batches: Iterator[pa.RecordBatch], items: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(items, size)
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("n_words", "items", "spans", "runs")}
        for raw in utf8(batch.column("text")):
            words = words_of(raw)
            runs, found = _runs(words, matcher)
            out["n_words"].append(len(words))
            out["items"].append(sorted({matcher.ids[k] for k in found if matcher.ids[k] is not None}))
            out["spans"].append(_spans(raw, runs) if runs else [])
            out["runs"].append([{"a": a, "b": b} for a, b in runs])
        pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(out["n_words"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pair("start", "end")), pa.array(out["runs"], pair("a", "b"))],
            ["doc_id", "row", "n_words", "items", "spans", "runs"],
        )


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted strings), spans (byte offsets, merged), contaminated."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, "item_id", "text", block_bytes)]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A row's number is only needed where the results of several blocks meet; all passes read it from one written table.
    several = len(blocks) > 1
    narrow = written(narrow.withColumn("row", F.monotonically_increasing_id())) if several else narrow.withColumn("row", F.lit(0).cast("long"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_words long, items array<string>, spans array<struct<start: long, end: long>>, runs array<struct<a: long, b: long>>"
    parts = [narrow.mapInArrow(functools.partial(_scan, items=b, size=size), schema) for b in blocks]
    found = functools.reduce(DataFrame.union, parts)
    if len(parts) > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            _merged(F.flatten(F.collect_list("spans")), "start", "end").alias("spans"),
            _merged(F.flatten(F.collect_list("runs")), "a", "b").alias("runs"),
        )
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("runs") > 0).alias("contaminated"))


def _merged(pieces, start: str, end: str):
    """Overlapping or touching intervals as one, in order."""
    empty = F.expr(f"cast(array() as array<struct<{start}: bigint, {end}: bigint>>)")
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.sort_array(pieces),
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x[start] <= F.coalesce(F.get(acc, F.size(acc) - 1)[end], F.lit(-1))),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(last(acc)[start].alias(start), F.greatest(last(acc)[end], x[end]).alias(end))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def filtered(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of docs without any window of the benchmark, with all their columns; no shuffle."""
    sc = docs.sparkSession.sparkContext
    for k, items in enumerate(_blocks(benchmark, "item_id", "text", block_bytes)):
        shared = sc.broadcast(items)
        docs = written(docs) if k else docs  # so that one task holds one automaton at a time

        def keep(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, size)
            for batch in batches:
                clean = [next(matcher.find(words_of(raw)), None) is None for raw in utf8(batch.column(text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def items_sha256(items):
    """Lower-case hex of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
