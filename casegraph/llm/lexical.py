"""Ranked lexical search over a length-stratified index.

The index is a table. A row is a stratum block: documents of one normaliser m (at most BLOCK_DOCS of them, from one
segment of SEGMENT_BYTES of text), the terms they hold (parted by spaces, which no term has), and for each term its postings grouped by tf. Documents of equal m
and equal tf have one impact, so an impact is computed once for each term and tf of a block, not for each posting. Tasks build
segments from the partitions they read: no exchange, and a stratum with a third of all documents is just many blocks.

A search knows of each block the largest tf of each term, so the sum of their impacts bounds every score in the block.
Bounds order the visits: the blocks with the largest bounds of each item are scored first and give the item's floor (its k-th best
score there, which the final k-th best can't be below); all other blocks are visited in the order of their bounds, and a block is
skipped for an item whose floor it can't reach. Ties at the floor are kept, so the result is exact.

Index rows stay where they are; the query set comes to them in blocks of QUERY_BYTES (of text), one pass over the index for each.
From a task go k rows an item at most.

Defined cases: a null, empty or termless text is no document of the index (N doesn't count it) and as an item has no rows; each row of
documents and of items counts for itself, repeated ids too; equal scores go by doc_id, null first; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, utf8, written

TOP, SEGMENT_BYTES, BLOCK_DOCS, QUERY_BYTES = 50, 12 << 20, 512, 4 << 20
#: Row groups of the index: a row is some 50 kB.
GROUP_BYTES = 2 << 20
#: Blocks that are scored first for each item, and numbers in a scoring matrix.
FIRST, CELLS = 4, 1 << 20

#: Lower-cases A-Z; ASCII other than letters and digits parts terms.
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TERMS = ASCII_LOWER.translate(_PARTED)

INDEX = "block long, m long, docs array<long>, terms binary, groups array<smallint>, tfs array<int>, sizes array<smallint>, places array<smallint>"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for raw in utf8(batch.column("text")):
            k = len(terms_of(raw or b""))
            n, total = n + (k > 0), total + k
    yield pa.RecordBatch.from_pydict({"n_docs": [n], "n_terms": [total]})


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def _segment(docs: list, lengths: list[int], ids: array, vocabulary: list[bytes], n_docs: int, n_terms: int, first: int) -> pa.RecordBatch:
    """The stratum blocks of some documents: ids are their terms, one document after the other."""
    ms = np.array([50 + 50 * n * n_docs // n_terms for n in lengths], np.int64)
    order = np.argsort(ms, kind="stable")
    ms = ms[order]
    # A block ends where m changes, or is full.
    start = np.flatnonzero(np.r_[True, ms[1:] != ms[:-1]])
    place = np.arange(len(ms)) - np.repeat(start, np.diff(np.r_[start, len(ms)]))
    new = place % BLOCK_DOCS == 0
    block, place = np.cumsum(new) - 1, place % BLOCK_DOCS
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    v = len(vocabulary)
    keys, tf = np.unique(np.repeat(rank, lengths) * v + np.frombuffer(ids, np.int32), return_counts=True)
    doc, top = keys // v, int(tf.max()) + 1
    key = (block[doc] * v + keys % v) * top + tf
    del keys, tf
    by = np.argsort(key, kind="stable")
    key, doc = key[by], doc[by]
    g = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # first posting of each (block, term, tf)
    sizes, key = np.diff(np.r_[g, len(key)]), key[g]
    of_term = key // top
    t = np.flatnonzero(np.r_[True, of_term[1:] != of_term[:-1]])  # first group of each (block, term)
    groups, of_block = np.diff(np.r_[t, len(key)]), of_term[t] // v
    n_blocks = int(block[-1]) + 1
    ends_t = np.searchsorted(of_block, np.arange(n_blocks), "right")
    ends_g = np.r_[t, len(key)][ends_t]
    ends_p = np.r_[g, len(doc)][ends_g]
    rows = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first + np.arange(n_blocks)),
            pa.array(ms[rows]),
            pa.ListArray.from_arrays(pa.array(np.r_[rows, len(ms)].astype(np.int32)), pa.array([docs[i] for i in order], pa.int64())),
            pc.binary_join(_lists(pa.array(vocabulary, pa.binary()).take(pa.array(of_term[t] % v)), ends_t), b" "),
            _lists(pa.array(groups.astype(np.int16)), ends_t),
            _lists(pa.array((key % top).astype(np.int32)), ends_g),
            _lists(pa.array(sizes.astype(np.int16)), ends_g),
            _lists(pa.array(place[doc].astype(np.int16)), ends_p),
        ],
        ["block", "m", "docs", "terms", "groups", "tfs", "sizes", "places"],
    )


def _segments(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    docs, lengths, ids, size = [], [], array("i"), 0
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal docs, lengths, ids, size, first
        if docs:
            rows = _segment(docs, lengths, ids, list(numbers), n_docs, n_terms, first)
            first += len(rows)
            for k in range(0, len(rows), 64):
                yield rows.slice(k, 64)
        docs, lengths, ids, size = [], [], array("i"), 0
        numbers.clear()
        numbers.default_factory = itertools.count().__next__

    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            before = len(ids)
            ids.extend(map(numbers.__getitem__, terms_of(raw or b"")))
            if len(ids) > before:
                docs.append(doc)
                lengths.append(len(ids) - before)
                size += len(raw)
            if size >= segment_bytes:
                yield from flushed()
    yield from flushed()


@dataclass(frozen=True)
class Index:
    """The table of stratum blocks, and the documents it holds."""

    blocks: DataFrame
    n_docs: int


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Index:
    """The index of all rows of docs, written to the shared folder. Two passes over the text: its size, then the blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = rows.select("text").mapInArrow(_lengths, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    build = functools.partial(_segments, n_docs=n_docs or 0, n_terms=n_terms or 0, segment_bytes=segment_bytes)
    return Index(written(rows.mapInArrow(build, INDEX), GROUP_BYTES), n_docs or 0)


@dataclass(frozen=True)
class Queries:
    """A block of items: their terms' numbers in the vocabulary, one item after the other, each item from its start on."""

    items: list
    vocabulary: list[bytes]
    terms: np.ndarray
    starts: np.ndarray

    def weighted(self, df: dict[int, int], n_docs: int) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(v, 0) + 1))) for v in range(len(self.vocabulary))], np.int64)


def _queries(items: DataFrame, query_bytes: int) -> Iterator[Queries]:
    """The items that have terms, a bounded block at a time."""
    numbers: dict[bytes, int] = {}
    ids, terms, starts, size = [], [], [], 0

    def block() -> Queries:
        return Queries(ids, list(numbers), np.array(terms, np.int64), np.array(starts, np.int64))

    for item, text in items.toLocalIterator():
        found = dict.fromkeys(terms_of(text.encode()))
        if found:
            if ids and size + len(text) > query_bytes:
                yield block()
                numbers, ids, terms, starts, size = {}, [], [], [], 0
            ids.append(item)
            starts.append(len(terms))
            terms += [numbers.setdefault(t, len(numbers)) for t in found]
            size += len(text)
    if ids:
        yield block()


class _Blocks:
    """The blocks of one batch of the index, with the numbers that their terms have in the vocabulary (-1: none)."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: pa.Array):
        flat = lambda name: np.asarray(batch.column(name).flatten())
        ends = lambda name: np.r_[0, np.cumsum(np.asarray(batch.column(name).value_lengths()))]
        self.m, self.block = np.asarray(batch.column("m")), np.asarray(batch.column("block"))
        terms = pc.split_pattern(batch.column("terms"), b" ").flatten()
        self.numbers = np.asarray(pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1))
        self.term_ends, self.group_ends = ends("groups"), ends("tfs")
        self.flat_groups, self.flat_tfs, self.flat_sizes = flat("groups"), flat("tfs"), flat("sizes")
        if "places" in batch.schema.names:
            self.flat_places, self.place_ends = flat("places"), ends("places")
            self.docs, self.doc_ends = batch.column("docs").flatten(), ends("docs")

    def terms(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a block's terms in the vocabulary: numbers, first groups, and the groups' number."""
        t0, t1 = self.term_ends[r], self.term_ends[r + 1]
        numbers = self.numbers[t0:t1]
        t = np.flatnonzero(numbers >= 0)
        n = self.flat_groups[t0:t1].astype(np.int64)
        return numbers[t], (np.cumsum(n) - n)[t], n[t]

    def sizes(self, r: int) -> np.ndarray:
        return self.flat_sizes[self.group_ends[r] : self.group_ends[r + 1]].astype(np.int64)

    def impacts(self, r: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block's terms in the vocabulary: numbers, all their groups, the groups' number of each, and each group's weighted impact."""
        number, first, n = self.terms(r)
        g = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        tf = self.flat_tfs[self.group_ends[r] + g].astype(np.int64)
        return number, g, n, (1_000_000_000 * tf) // (1000 * tf + 20 * self.m[r]) * np.repeat(weights[number], n)

    def postings(self, r: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all postings of some groups, and how many each group has."""
        sizes = self.sizes(r)
        first, n = (np.cumsum(sizes) - sizes)[g], sizes[g]
        return self.flat_places[self.place_ends[r] + np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _bounds(number: np.ndarray, n: np.ndarray, impacts: np.ndarray, queries: Queries) -> np.ndarray:
    """Of each item, what no score in the block exceeds: the impact of each term's largest tf, its last group."""
    most = np.zeros(len(queries.vocabulary), np.int64)
    most[number] = impacts[np.cumsum(n) - 1]
    return np.add.reduceat(most[queries.terms], queries.starts)


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = pa.array(shared.value.vocabulary, pa.binary())
    df = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        rows = _Blocks(batch, vocabulary)
        for r in range(len(rows.m)):
            number, first, n = rows.terms(r)
            postings = np.r_[0, np.cumsum(rows.sizes(r))]
            df[number] += postings[first + n] - postings[first]  # a term is in a block once
    yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(df), "df": df[df > 0]})


def _best_blocks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Of each item, the FIRST blocks with the largest bounds that this task has."""
    queries, weights, _ = shared.value
    vocabulary = pa.array(queries.vocabulary, pa.binary())
    n = len(queries.items)
    bounds, blocks = np.zeros((0, n), np.int64), np.zeros((0, n), np.int64)
    for batch in batches:
        rows = _Blocks(batch, vocabulary)
        new = np.zeros((len(rows.m), n), np.int64)
        for r in range(len(rows.m)):
            number, _, each, impacts = rows.impacts(r, weights)
            if len(number):
                new[r] = _bounds(number, each, impacts, queries)
        bounds, blocks = np.vstack([bounds, new]), np.vstack([blocks, np.repeat(rows.block[:, None], n, 1)])
        best = np.argsort(-bounds, axis=0, kind="stable")[:FIRST]
        bounds, blocks = np.take_along_axis(bounds, best, 0), np.take_along_axis(blocks, best, 0)
    q = np.tile(np.arange(n), len(bounds))
    found = bounds.ravel() > 0
    yield pa.RecordBatch.from_pydict({"q": q[found], "block": blocks.ravel()[found], "bound": bounds.ravel()[found]})


class _Best:
    """The k best of each item so far, and the score that a further one must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.held = floors.copy(), k, 0
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.rows.append((q, score, doc, known))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.floors):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        q, score, doc, known = map(np.concatenate, zip(*self.rows))
        by = np.lexsort((doc, known, -score, q))
        q = q[by]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        by = by[rank < self.k]
        last = rank == self.k - 1
        self.floors[q[last]] = np.maximum(self.floors[q[last]], score[by][last[rank < self.k]])
        q = q[rank < self.k]
        self.rows, self.held = [(q, score[by], doc[by], known[by])], len(q)
        return self.rows[0]


def _visit(rows: _Blocks, r: int, number: np.ndarray, g: np.ndarray, n: np.ndarray, impacts: np.ndarray, active: np.ndarray, queries: Queries, best: _Best) -> None:
    """Scores the block's documents for the active items."""
    d0, d1 = rows.doc_ends[r], rows.doc_ends[r + 1]
    docs = rows.docs.slice(d0, d1 - d0)
    known = np.asarray(docs.is_valid())
    docs = np.asarray(docs.fill_null(0))
    places, sizes = rows.postings(r, g)
    lines, values = np.repeat(np.repeat(np.arange(len(number)), n), sizes), np.repeat(impacts, sizes)
    line = np.full(len(queries.vocabulary), len(number))
    line[number] = np.arange(len(number))
    ends = np.r_[queries.starts[1:], len(queries.terms)]
    width = max(1, CELLS // (len(number) + 1))
    for low in range(0, len(docs), width):
        here = (places >= low) & (places < low + width)
        cells = np.zeros((len(number) + 1, min(width, len(docs) - low)), np.int64)  # the last line is of the absent terms
        cells[lines[here], places[here] - low] = values[here]
        step = 0
        while step < len(active):
            lengths = np.cumsum(ends[active[step:]] - queries.starts[active[step:]])
            some = active[step : step + max(1, int(np.searchsorted(lengths, CELLS // cells.shape[1], "right")))]
            step += len(some)
            each = ends[some] - queries.starts[some]
            first = np.r_[0, np.cumsum(each)[:-1]]
            terms = queries.terms[np.repeat(queries.starts[some] - first, each) + np.arange(each.sum())]
            scores = np.add.reduceat(cells[line[terms]], first, axis=0)
            a, b = np.nonzero((scores >= best.floors[some][:, None]) & (scores > 0))
            if len(a):
                best.add(some[a], scores[a, b], docs[low + b], known[low + b])


def _search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    queries, weights, floors = shared.value
    vocabulary = pa.array(queries.vocabulary, pa.binary())
    best = _Best(floors, k)
    for batch in batches:
        rows = _Blocks(batch, vocabulary)
        found = []
        for r in range(len(rows.m)):
            number, g, n, impacts = rows.impacts(r, weights)
            if len(number):
                bounds = _bounds(number, n, impacts, queries)
                if (bounds >= best.floors).any():
                    found.append((int(bounds.max()), r, bounds, number, g, n, impacts))
        for _, r, bounds, number, g, n, impacts in sorted(found, key=lambda x: (-x[0], x[1])):
            active = np.flatnonzero((bounds >= best.floors) & (bounds > 0))
            if len(active):
                _visit(rows, r, number, g, n, impacts, active, queries, best)
        best.settle()
    q, score, doc, known = best.settle()
    yield pa.RecordBatch.from_pydict({"q": q, "doc_id": pa.array(doc, mask=~known), "score": score})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _found(at: Index, queries: Queries, k: int) -> DataFrame:
    """q, rank, doc_id, score of one block of items."""
    sc, blocks = at.blocks.sparkSession.sparkContext, at.blocks
    narrow = blocks.select("block", "m", "terms", "groups", "tfs", "sizes")
    frequencies = narrow.mapInArrow(functools.partial(_frequencies, shared=sc.broadcast(queries)), "term long, df long")
    df = dict(frequencies.groupBy("term").agg(F.sum("df")).collect())  # the terms of this block of items at most
    weights = queries.weighted(df, at.n_docs)
    floors = np.zeros(len(queries.items), np.int64)
    shared = sc.broadcast((queries, weights, floors))
    bounds = narrow.mapInArrow(functools.partial(_best_blocks, shared=shared), "q long, block long, bound long")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("order", order).where(F.col("order") <= FIRST).select("block").distinct()  # FIRST blocks an item at most
    scored = blocks.join(F.broadcast(first), "block", "left_semi").mapInArrow(functools.partial(_search, shared=shared, k=k), "q long, doc_id long, score long")
    for q, score in _ranked(scored, k).where(F.col("rank") == k).select("q", "score").collect():
        floors[q] = score
    shared = sc.broadcast((queries, weights, floors))
    return _ranked(blocks.mapInArrow(functools.partial(_search, shared=shared, k=k), "q long, doc_id long, score long"), k)


def search(at: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    parts: list[DataFrame] = []
    for queries in _queries(rows.where("text is not null"), query_bytes):
        if parts:
            parts[-1] = written(parts[-1])  # so that the driver holds one block of items at a time
        ids = spark.createDataFrame(list(enumerate(queries.items)), f"q long, item_id {kind}")
        parts.append(_found(at, queries, k).join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
