"""Pairs and signals within investigations of bounded size: one row holds the distinct ids of an investigation, and what is found in it needs no
further shuffle. Investigations over the bound are left to the joins of findings and risk, which give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph as g

INV = "investigation_id"
#: Rows of found paths that are sent on at once.
ROWS = 50_000


def _ways(ends: np.ndarray, others: np.ndarray, n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, first): for each two of n nodes the distance, 0 beyond `longest`, and the first step of the smallest of the shortest paths."""
    distance, first = np.zeros((n, n), np.int8), np.full((n, n), -1, np.int32)
    near = [np.unique(x) for x in np.split(others[np.argsort(ends, kind="stable")], np.cumsum(np.bincount(ends, minlength=n))[:-1])]
    distance[ends, others], first[ends, others] = 1, others
    np.fill_diagonal(distance, -1)
    middles = [y for y in range(n - 1, -1, -1) if len(near[y]) > 1]
    for d in range(2, longest + 1):
        step = np.full((n, n), -1, np.int32)
        for y in middles:  # the smallest comes last and stays
            to = np.flatnonzero(distance[y] == d - 1)
            if len(to):
                step[np.ix_(near[y], to)] = y
        step[distance != 0] = -1
        new = step >= 0
        if not new.any():
            break
        distance[new], first[new] = d, step[new]
    return distance, first


def _found(a: np.ndarray, b: np.ndarray, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes of each path with -1 behind its end, distance, weight) of the pairs a < b that are 2 to `longest` apart. Weight: n of the path's nodes (rows a = b) less n
    of its edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    own, edge = x == y, x != y
    distance, first = _ways(np.concatenate([x[edge], y[edge]]), np.concatenate([y[edge], x[edge]]), len(ids), longest)
    s, t = np.nonzero(np.triu(distance > 1, 1))
    of = np.zeros(len(ids), np.int64)
    of[x[own]] = n[own]
    between = {}
    if n[edge].any():
        between = np.zeros((len(ids), len(ids)), np.int64)
        between[x[edge], y[edge]] = between[y[edge], x[edge]] = n[edge]
    path, weight, here = np.full((len(s), longest + 1), -1, np.int64), of[s], s
    path[:, 0] = ids[s]
    for d in range(1, longest + 1):
        on = np.flatnonzero(here != t)
        if not len(on):
            break
        step = first[here[on], t[on]]
        weight[on] += of[step]
        if len(between):
            weight[on] -= between[here[on], step]
        path[on, d] = ids[step]
        here = here.copy()
        here[on] = step
    return path, distance[s, t].astype(np.int32), weight


def paths(pairs: DataFrame, longest: int) -> DataFrame:
    """(investigation_id, a, b, distance, path, n): pairs a < b that are 2 to `longest` edges apart, with the smallest of their shortest paths and its
    weight. pairs (investigation_id, a, b, n), distinct: edges, and nodes as rows with a = b."""
    rows = g.dealt(pairs, INV).groupBy(INV).agg(F.collect_list(F.struct("a", "b", "n")).alias("l")).select(INV, F.col("l.a").alias("a"), F.col("l.b").alias("b"), F.col("l.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            inv, (path, distance, weight) = np.concatenate([x[0] for x in held]), (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            ends = np.concatenate([[0], np.cumsum(distance + 1)]).astype(np.int32)
            flat = path[np.arange(path.shape[1]) <= distance[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(inv), pa.array(path[:, 0]), pa.array(path[np.arange(len(path)), distance]), pa.array(distance), lists, pa.array(weight)], [INV, "a", "b", "distance", "path", "n"])

        held, size = [], 0
        for batch in batches:
            lists = [batch.column(c) for c in ("a", "b", "n")]
            for i, inv in enumerate(batch.column(INV).to_pylist()):
                path, distance, weight = _found(*(x[i].values.to_numpy(zero_copy_only=False) for x in lists), longest)
                for k in range(0, len(path), ROWS):
                    part = slice(k, k + ROWS)
                    held.append((np.full(len(path[part]), inv, np.int64), path[part], distance[part], weight[part]))
                    size += len(path[part])
                    if size >= ROWS:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    return rows.mapInArrow(run, f"{INV} long, a long, b long, distance int, path array<long>, n long")


#: Wedges that are tried at once.
WEDGES = 2_000_000


def _closed(of: np.ndarray, a: np.ndarray, b: np.ndarray, wedges: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(investigation, its three nodes in order) of the triangles of distinct edges a < b, of[i] being the investigation of the i-th. Edges run from lower to higher degree, so a hub
    opens few wedges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own, at = np.unique(np.concatenate([of, of]) * len(ids) + at, return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    known = np.sort(x * len(own) + y)
    degree = np.bincount(at, minlength=len(own))
    swap = degree[x] > degree[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rest = np.searchsorted(x, x, side="right") - np.arange(len(x)) - 1
    total = np.concatenate([[0], np.cumsum(rest)])
    begin = 0
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + wedges, side="right")) - 1)
        n = rest[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], n)
        code = y[i] * len(own) + y[j]  # y ascends within x
        hit = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
        three = np.sort(np.stack([x[i[hit]], y[i[hit]], y[j[hit]]], axis=1), axis=1)
        yield own[three[:, 0]] // len(ids), ids[own[three] % len(ids)]
        begin = end


def triangles(pairs: DataFrame, wedges: int = WEDGES) -> DataFrame:
    """(investigation_id, p, q, w) with p < q < w of the distinct edges (investigation_id, a, b), a < b."""
    rows = g.dealt(pairs, INV).groupBy(INV).agg(F.collect_list(F.struct("a", "b")).alias("l")).select(INV, F.col("l.a").alias("a"), F.col("l.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("a")
            if not batch.num_rows:
                continue
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for inv, three in _closed(of, a, b, wedges):
                yield pa.RecordBatch.from_arrays([batch.column(INV).take(pa.array(inv)), *(pa.array(three[:, k]) for k in range(3))], [INV, "p", "q", "w"])

    return rows.mapInArrow(run, f"{INV} long, p long, q long, w long")


#: Pairs that are worked on at once.
PAIRS = 500_000


def _parts(rows: DataFrame, *columns: str) -> DataFrame:
    """Each investigation's pairs (of these columns) as lists in one row."""
    one = g.dealt(rows, INV).groupBy(INV).agg(F.collect_list(F.struct(*columns)).alias("l"))
    return one.select(INV, *(F.col(f"l.{c}").alias(c) for c in columns))


def _table(pairs: DataFrame, *columns: str) -> T.StructType:
    """The investigation and these columns of whole numbers."""
    return T.StructType([pairs.schema[INV], *(T.StructField(c, T.LongType()) for c in columns)])


def _slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(investigations, the row among them of each pair, the pairs' columns) of up to PAIRS pairs, or of one investigation."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(columns[0]).value_lengths().to_numpy(zero_copy_only=False)
        total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
            part = batch.slice(begin, end - begin)
            yield part.column(INV), np.repeat(np.arange(end - begin), sizes[begin:end]), *(part.column(c).flatten() for c in columns)
            begin = end


def _numbered(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id) of each node, in their order, and the pairs' ends as places among these."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own, at = np.unique(np.concatenate([of, of]) * len(ids) + at, return_inverse=True)
    return own // len(ids), ids[own % len(ids)], at[: len(a)], at[len(a) :]


def _labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' component: roots take the smallest root next to them, ways to the root are halved."""
    label = np.arange(n)
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up


def components(pairs: DataFrame) -> DataFrame:
    """(investigation_id, x, component, size): the smallest node of each node's component, from one row of an investigation. pairs (investigation_id, a, b), a node
    without edges as a row with a = b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for inv, of, a, b in _slices(batches, "a", "b"):
            row, node, x, y = _numbered(of, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
            label = _labels(x, y, len(node))
            size = np.bincount(label, minlength=len(node))[label]
            yield pa.RecordBatch.from_arrays([inv.take(pa.array(row)), pa.array(node), pa.array(node[label]), pa.array(size.astype(np.int64))], [INV, "x", "component", "size"])

    return _parts(pairs, "a", "b").mapInArrow(run, _table(pairs, "x", "component", "size"))


def _tree(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(parent, levels) of the breadth-first trees from the smallest node of each component; a root is its own parent. x, y: all edges, both ways."""
    front = np.flatnonzero(_labels(x, y, n) == np.arange(n))
    order = np.argsort(x, kind="stable")
    y, begin = y[order], np.searchsorted(x[order], np.arange(n + 1))
    parent = np.full(n, -1)
    parent[front] = front
    levels = []
    while len(front):
        levels.append(front)
        size = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        to, by = y[at], np.repeat(front, size)
        new = parent[to] < 0
        to, by = to[new], by[new]
        front, first = np.unique(to, return_index=True)
        parent[front] = by[first]
    return parent, levels


def _cut(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The nodes that lie in more than one block (Tarjan and Vishkin): x, y are distinct edges x < y of n nodes."""
    parent, levels = _tree(np.concatenate([x, y]), np.concatenate([y, x]), n)
    size, pre = np.ones(n, np.int64), np.zeros(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    root = levels[0]
    pre[root] = np.cumsum(size[root]) - size[root]
    for level in levels[1:]:
        level = level[np.argsort(parent[level], kind="stable")]
        before, own = np.cumsum(size[level]) - size[level], parent[level]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        pre[level] = pre[own] + 1 + before - np.repeat(before[first], np.diff(np.r_[first, len(level)]))
    other = (parent[x] != y) & (parent[y] != x)
    p, q = x[other], y[other]
    low, high = pre.copy(), pre.copy()
    for least, f in ((low, np.minimum), (high, np.maximum)):
        f.at(least, p, pre[q])
        f.at(least, q, pre[p])
        for level in levels[:0:-1]:
            f.at(least, parent[level], least[level])
    # A node stands for the edge to its parent. Its edge is in its parent's block if a way from below it leaves the parent's subtree.
    up = parent
    inner = np.flatnonzero((up != np.arange(n)) & (up[up] != up))
    inner = inner[(low[inner] < pre[up[inner]]) | (high[inner] >= pre[up[inner]] + size[up[inner]])]
    block = _labels(np.concatenate([p, inner]), np.concatenate([q, up[inner]]), n)
    child = np.flatnonzero(up != np.arange(n))
    of = np.unique(np.concatenate([child * n + block[child], up[child] * n + block[child]])) // n
    return np.flatnonzero(np.bincount(of, minlength=n) > 1)


def articulation_points(pairs: DataFrame) -> DataFrame:
    """(investigation_id, x) of the nodes in more than one block, from one row of an investigation. pairs (investigation_id, a, b), distinct, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for inv, of, a, b in _slices(batches, "a", "b"):
            row, node, x, y = _numbered(of, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
            cut = _cut(x, y, len(node))
            yield pa.RecordBatch.from_arrays([inv.take(pa.array(row[cut])), pa.array(node[cut])], [INV, "x"])

    return _parts(pairs, "a", "b").mapInArrow(run, _table(pairs, "x"))


def wedges(pairs: DataFrame, most: int = WEDGES) -> DataFrame:
    """(investigation_id, p, q, w) with p < q < w, each once: three nodes of which one has two edges that are not of the same single kind. pairs (investigation_id, a, b, kind), distinct,
    a < b; kind is null where an edge has several kinds.

    Three nodes come more than once only if all three are neighbours; of their middles the smallest stands for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for inv, of, a, b, kind in _slices(batches, "a", "b", "kind"):
            row, node, x, y = _numbered(of, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
            kind = kind.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            n = len(node)
            order = np.argsort(x * n + y)
            known, kind_of = (x * n + y)[order], kind[order]
            m, o, k = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([kind, kind])
            order = np.lexsort((o, m))
            m, o, k = m[order], o[order], k[order]
            rest = np.searchsorted(m, m, side="right") - np.arange(len(m)) - 1
            total, begin = np.concatenate([[0], np.cumsum(rest)]), 0
            while begin < len(m):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
                i = np.repeat(np.arange(begin, end), rest[begin:end])
                j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], rest[begin:end])
                begin = end
                fits = (k[i] != k[j]) | (k[i] < 0)
                i, j = i[fits], j[fits]
                p, q, mid = o[i], o[j], m[i]  # p < q
                code = p * n + q
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                closed = np.flatnonzero(known[at] == code)
                third = kind_of[at[closed]]
                of_p = (p[closed] < mid[closed]) & ((third != k[i[closed]]) | (third < 0))
                of_q = (q[closed] < mid[closed]) & ((third != k[j[closed]]) | (third < 0))
                once = np.ones(len(i), bool)
                once[closed] = ~(of_p | of_q)
                three = np.sort(np.stack([p[once], mid[once], q[once]], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([inv.take(pa.array(row[three[:, 0]])), *(pa.array(node[three[:, c]]) for c in range(3))], [INV, "p", "q", "w"])

    return _parts(pairs, "a", "b", "kind").mapInArrow(run, _table(pairs, "p", "q", "w"))


def _signals(same: list[int], rel: list[list[int]], ev: list[list[int]], w: list[float], c: list[float]) -> tuple[int, float, float]:
    """(signals, sum of weight * confidence, sum of weights) of findings in order; `same` is equal for equal findings."""
    by_rel: dict[int, list[int]] = {}
    by_ev: dict[int, list[int]] = {}
    alone = []
    for i in range(len(same)):
        for x in rel[i]:
            by_rel.setdefault(x, []).append(i)
        if not len(rel[i]):
            for x in ev[i]:
                by_ev.setdefault(x, []).append(i)
            if not len(ev[i]):
                alone.append((w[i], c[i]))
    strongest = lambda group: max((w[i] * c[i], w[i], c[i]) for i in group)[1:]
    taken, found = set(), []
    # Groups in order of their first finding, then id. Equal findings are next to each other, so the first of them stands for all.
    first = {}
    for i, s in enumerate(same):
        first.setdefault(s, i)
    for _, x in sorted((first[same[group[0]]], x) for x, group in by_rel.items()):
        own = {same[i] for i in by_rel[x]}
        if not own & taken:
            taken |= own
            found.append(strongest(by_rel[x]))
    groups: dict[int, list[int]] = {}
    settled = set()
    for _, x in sorted((first[same[group[0]]], x) for x, group in by_ev.items()):
        mine = [i for i in by_ev[x] if same[i] not in settled]
        if mine:
            # Of equal findings one counts, as they are one finding.
            groups[x] = list({same[i]: i for i in reversed(mine)}.values())
            settled |= {same[i] for i in mine}
    found += [strongest(g) for g in groups.values()] + alone
    return len(found), sum(a * b for a, b in found), sum(a for a, _ in found)


@F.pandas_udf(T.StructType([T.StructField("signals", T.LongType()), T.StructField("strength", T.DoubleType()), T.StructField("weight", T.DoubleType())]))
def signals(same: pd.Series, rel: pd.Series, ev: pd.Series, w: pd.Series, c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_signals(*x) for x in zip(same, rel, ev, w, c)], columns=["signals", "strength", "weight"])
