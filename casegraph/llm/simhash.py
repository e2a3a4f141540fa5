"""SimHash near-copies through an inverted index over byte positions with count filtering.

A fingerprint has 64 bits in 8 positional bytes. Two fingerprints at `max_bits` (4) or fewer differing bits share
at least 4 positional bytes, as a bit spoils one byte at most. A posting list of one byte position would hold a
256th of all fingerprints, so the index holds the lists' intersections by three positions: 20 of the 56 triples
meet every set of 4 positions. A list's pairs get the tally of all their shared positional bytes; those that reach
4 are verified by their differing bits. No list and no shared byte is skipped.

Equal fingerprints meet before the index. A list longer than `block` is dealt into blocks of pairs of parts, each
compared in its own task; long blocks yield a spanning forest of the linked pairs, so rows grow with a list's
length, not its square, while connectivity is exact. Components come from star rounds in Spark.

Words are `[^\\x20\\x09-\\x0D]+` of the A-Z-lower-cased text. Defined cases: a null or wordless text has fingerprint
zero and links like any other; a text of fewer words than a shingle has one; a row without an id is linked but
never names a component (a component of such rows has a null id); repeated rows get one row each; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, components, join_hot, utf8, written

WORDS, SEED, MAX_BITS, BLOCK = 4, 42, 4, 4096
#: Lists up to this length have all their pairs compared at once; each member then meets a bounded number of others.
SHORT = 24


def _triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any 4 positions contain one: Turan's three groups in a ring."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for t in combinations(range(8), 3):
        count = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3)):
            found.append(t)
    return found


TRIPLES = _triples()


def shingle_hashes(raw: bytes | None, size: int) -> list[int]:
    """The hashes of the text's shingles in order."""
    words = raw.translate(ASCII_LOWER).split() if raw else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(raw: bytes | None, size: int = WORDS) -> int:
    """Unsigned 64-bit SimHash; a bit is set where over half of the shingles' hashes have it."""
    hashes = shingle_hashes(raw, size)
    if not hashes:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(fingerprints: list[int]) -> pa.Array:
    return pa.array(np.array(fingerprints, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(found)], ["doc_id", "fp"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], T.StructField("fp", T.LongType())]))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _key(t: int, positions: tuple[int, int, int]) -> Column:
    """The posting list of three positional bytes: the triple's number and the bytes."""
    key = F.lit(t)
    for p in positions:
        key = key * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)).cast("int")
    return key


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: pairs sharing at least 8 - max_bits positional bytes, at most max_bits apart."""
    differ = a ^ b
    shared = (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(1)
    passed = np.flatnonzero(shared >= 8 - max_bits)
    return passed[np.bitwise_count(differ[passed]) <= max_bits]


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of one list's links: each member is compared with all that are not reached yet."""
    edges, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _linked(np.broadcast_to(x, rest.shape), rest, max_bits)
            if len(near):
                reached = rest[near]
                edges.append((np.full(len(reached), x), reached))
                rest = np.delete(rest, near)
                front.extend(reached)
    return edges


def _compare(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Links within runs of equal keys (rows are sorted by key)."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for s, n in zip(start[length > SHORT], length[length > SHORT]):
        edges += _forest(np.unique(fps[s : s + n]), max_bits)
    short = np.repeat(length <= SHORT, length)
    k, x = np.repeat(np.arange(len(start)), length)[short], fps[short]
    for d in range(1, SHORT):
        near = np.flatnonzero(k[d:] == k[:-d])
        if not len(near):
            break
        a, b = x[near], x[near + d]
        hit = _linked(a, b, max_bits)
        edges.append((a[hit], b[hit]))
    a = np.concatenate([e[0] for e in edges]) if edges else np.empty(0, np.uint64)
    b = np.concatenate([e[1] for e in edges]) if edges else np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p).view(np.int64)) for p in pairs], ["a", "b"])


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) of distinct fingerprints: linked pairs that connect all that max_bits connects."""
    if max_bits != 4:
        raise ValueError("the index's triples are made for 4 bits")
    postings = distinct.select("fp", F.explode(F.array(*(_key(t, p) for t, p in enumerate(TRIPLES)))).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        join_hot(postings, lists, ["key"], "n", len(TRIPLES) * distinct.count())
        .select("key", "fp", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "fp")
        .repartition("block")
        .sortWithinPartitions("block", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("block").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on in the next batch
            if cut:
                yield _compare(keys[:cut], fps[:cut], max_bits)
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _compare(keys, fps, max_bits)

    return dealt.mapInArrow(run, "a long, b long")


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fp, root (one fingerprint for all of a component), component_id (its smallest doc_id)."""
    rows = written(fingerprints(docs, id_col, text_col))
    return rooted(rows, links(written(rows.select("fp").distinct())))


def rooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows(doc_id, fp) with the root and component_id of their components over linked(a, b)."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    roots = components(linked).select(F.col("node").alias("fp"), F.col("component"))
    found = written(distinct.join(roots, "fp", "left").select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("root")))
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(found, smallest, ["root"], "members", found.count()).select("fp", "copies", "root", "component_id")
    return join_hot(rows, named, ["fp"], "copies", rows.count()).select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, the one with the smallest id, with all its columns."""
    return one_each(docs, clustered(docs, id_col, text_col), fingerprint, id_col, text_col)


def one_each(docs: DataFrame, clusters: DataFrame, hashed: Callable[[bytes | None], int], id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each component of clusters, whose fp is the texts' `hashed`.

    Ids that several rows share, and null ids, are settled by the rows' fingerprints, so that such a row stands or
    falls with its own component.
    """
    rows = written(clusters)
    ids = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    single = ids.where("doc_id is not null and n = 1").select(F.col("doc_id").alias("kept_id"))
    out = docs.join(single, docs[id_col] == F.col("kept_id"), "left_semi")
    several = ids.where("doc_id is null or n > 1").select(F.col("doc_id").alias("kept_id"))
    if not several.isEmpty():
        extra = "fp"
        while extra in docs.columns:
            extra += "_"
        some = docs.join(several, docs[id_col].eqNullSafe(F.col("kept_id")), "left_semi")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _signed([hashed(x) for x in utf8(batch.column(text_col).cast(pa.string()))])
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, extra])

        some = some.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(extra, T.LongType())]))
        roots = rows.groupBy(F.col("fp").alias("root_fp")).agg(F.first("root").alias("root_of"), F.first("component_id").alias("root_id"))
        some = some.join(roots, (F.col(extra) == F.col("root_fp")) & F.col(id_col).eqNullSafe(F.col("root_id")))
        out = out.union(some.dropDuplicates(["root_of"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out
