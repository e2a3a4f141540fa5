"""Near copies by the exact Jaccard similarity of word shingles: SIMILARITY (4 of 5) or more of shingles of 5 words.

Texts of equal words meet first, as one node. Nodes whose SimHash fingerprints link (simhash: 4 of 64 bits, byte-position index) form groups next, and
each is verified by its exact shingle sets against its group's smallest node. What this leaves open is found by MinHash. The distinct shingles of a node give MinHash values in 32 bands of 4: a
pair at similarity 0.8 agrees in no band with probability (1 - 0.8**4)**32, under 5e-8, and less above it. (A
SimHash radius would have to be over 20 of 64 bits to cover such pairs.) What agrees in a band is only a candidate; every link is
verified by its exact shingle sets.

Members of a bucket are first verified against the bucket's smallest node. Buckets that the links leave in several components have
all their pairs across components compared: short ones as rows of pairs, others dealt into blocks of pairs of parts of bounded
size, each compared in its own task, where links that the block's earlier links imply are left out. In a block, pairs that agree in
under half of the 128 MinHash values are passed over (at similarity 0.8 the chance of that is under 1e-12). No bucket is
skipped or cut.

Words and defined cases are those of simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import ASCII_LOWER, components, join_hot, utf8, written

WORDS, BANDS, ROWS = 5, 32, 4
SIMILARITY = (4, 5)
#: Buckets up to SHORT members are compared as rows of pairs; a part of a longer one has about PART shingles; a pivot's pairs are dealt by SALT.
SHORT, PART, SALT = 24, 500_000, 256
_R = np.random.default_rng(42)
_A, _B, _C = ((_R.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, ROWS))
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def node_of(raw: bytes | None) -> int:
    """Unsigned 64-bit hash of the text's words; 0 for a text without words."""
    words = raw.translate(ASCII_LOWER).split() if raw else []
    return xxhash.xxh64_intdigest(b" ".join(words), simhash.SEED) if words else 0


def shingle_set(raw: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(np.array(simhash.shingle_hashes(raw, WORDS), np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[None, i : i + 512] * _A[:, None] + _B[:, None]).min(1), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    return (values.reshape(BANDS, ROWS) * _C).sum(1, dtype=np.uint64) + _BAND


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is SIMILARITY or more; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


def signed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, size, keys, sim): the node, the number of its distinct shingles, its band keys and its SimHash fingerprint."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, sims = [], [], [], []
            for raw in utf8(batch.column("text")):
                found = shingle_set(raw)
                nodes.append(node_of(raw))
                sizes.append(len(found))
                keys.append(band_keys(signature(found)))
                sims.append(simhash.fingerprint(raw))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), simhash._signed(nodes), pa.array(sizes, pa.int64()), lists, simhash._signed(sims)], ["doc_id", "fp", "size", "keys", "sim"])

    kinds = [T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sim", T.LongType())]
    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], *kinds]))


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame, total: int) -> DataFrame:
    """(node, text): one text for each wanted node (node, copies), of `total` documents. Copies of one text stay where they are read until
    each task has dropped all of them but one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([simhash._signed([node_of(x) for x in utf8(batch.column("text"))]), batch.column("text")], ["node", "text"])

    hashed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, text string")
    return written(join_hot(hashed, wanted, ["node"], "copies", total).select("node", "text").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of (a, b) whose texts are similar. A node with many pairs has them dealt over several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    first = texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a").join(parts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"))
    both = salted.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b").join(first.drop("parts"), ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hits = []
            for i, (x, y) in enumerate(zip(utf8(batch.column("text_a")), utf8(batch.column("text_b")))):
                if a[i] != known:
                    known, own = a[i], shingle_set(x)
                if similar(own, shingle_set(y)):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hits], pa.int64()), pa.array([b[i] for i in hits], pa.int64())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _compare(nodes: list[int], labels: list[int], texts: list[bytes | None]) -> list[tuple[int, int]]:
    """Links across the labels of one block that connect all that its similar pairs connect."""
    sets = [shingle_set(x) for x in texts]
    size = np.array([len(x) for x in sets])
    values = np.array([signature(x) for x in sets]).astype(np.uint32)
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    own, found = np.array(labels), []
    for i in range(len(nodes) - 1):
        rest = np.arange(i + 1, len(nodes))
        fits = np.minimum(size[i], size[rest]) * SIMILARITY[1] >= np.maximum(size[i], size[rest]) * SIMILARITY[0]
        rest = rest[fits & (own[rest] != own[i])]
        for j in rest[2 * (values[rest] == values[i]).sum(1) >= BANDS * ROWS]:
            x, y = root(labels[i]), root(labels[j])
            if x != y and similar(sets[i], sets[j]):
                parent[x] = y
                found.append((nodes[i], nodes[j]))
    return found


def _in_blocks(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) within the buckets of members (key, node, label, total), total being the bucket's shingles."""
    parts = F.ceil(F.col("total") / size).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = (
        members.select("key", "node", "label", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "node", "label")
        .join(texts, "node")
        .repartition("block")
        .sortWithinPartitions("block", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        block, nodes, labels, held = None, [], [], []
        for batch in batches:
            for x, node, label, text in zip(batch.column("block").to_pylist(), batch.column("node").to_pylist(), batch.column("label").to_pylist(), utf8(batch.column("text"))):
                if x != block and nodes:
                    yield out(_compare(nodes, labels, held))
                    nodes, labels, held = [], [], []
                block = x
                nodes.append(node)
                labels.append(label)
                held.append(text)
        if nodes:
            yield out(_compare(nodes, labels, held))

    return dealt.select("block", "node", "label", "text").mapInArrow(run, "a long, b long")


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """(a, b): each node b of nodes(fp, sim) with the smallest node a of those that links of their SimHash fingerprints reach."""
    sims = written(nodes.select(F.col("sim").alias("fp")).distinct())
    roots = components(simhash.links(sims)).select(F.col("node").alias("sim"), "component")
    grouped = written(nodes.select("fp", "sim").join(roots, "sim", "left").select(F.col("fp").alias("b"), F.coalesce("component", "sim").alias("group")))
    first = grouped.groupBy("group").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return join_hot(grouped, first, ["group"], "n", grouped.count()).where("b > a").select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, text_col: str = "text", short: int = SHORT, part: int = PART) -> DataFrame:
    """(a, b): similar pairs of nodes(fp, size, keys, and copies, 1 if missing, and sim, if known) that connect all that similar pairs connect."""
    nodes = nodes if "copies" in nodes.columns else nodes.withColumn("copies", F.lit(1))
    total, distinct = nodes.agg(F.sum("copies"), F.count("*")).first()
    copies = nodes.select(F.col("fp").alias("node"), "copies")
    grouped, label = None, F.col("fp")
    if "sim" in nodes.columns:
        near = written(simhash_groups(nodes))
        wanted = copies.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        grouped = written(_verified(near, _texts(docs, text_col, wanted, total or 0)))
        nodes = nodes.join(components(grouped).select(F.col("node").alias("fp"), F.col("component").alias("label")), "fp", "left")
        label = F.coalesce("label", "fp")
    # A bucket whose nodes are in one component already has nothing to add.
    postings = nodes.select(F.col("fp").alias("node"), "size", label.alias("known"), F.explode("keys").alias("key"))
    counts = [F.count("*").alias("n"), F.sum("size").alias("total"), F.min(F.struct("node", "size", "known")).alias("pivot")]
    buckets = postings.groupBy("key").agg(*counts, F.min("known").alias("l"), F.max("known").alias("m")).where("n > 1 and l <> m").drop("l", "m")
    members = written(join_hot(postings, buckets, ["key"], "n", BANDS * distinct))
    texts = _texts(docs, text_col, copies.join(members.select("node").distinct(), "node", "left_semi"), total or 0)
    allowed = _sizes_allow(F.col("size"), F.col("pivot.size"))
    star = members.where(F.col("node") > F.col("pivot.node")).where(allowed).where(F.col("known") != F.col("pivot.known"))
    star = written(star.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct())
    found = written(_verified(star, texts) if grouped is None else _verified(star, texts).union(grouped))

    labels = components(found).select("node", F.col("component").alias("label"))
    labelled = members.join(labels, "node", "left").select("key", "node", "size", "n", "total", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    open_ = written(labelled.join(mixed, "key", "left_semi"))
    few = open_.where(F.col("n") <= short)
    x, y = few.alias("x"), few.alias("y")
    across = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")))
        .where(_sizes_allow(F.col("x.size"), F.col("y.size")))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    more = _verified(written(across), texts)
    blocks = _in_blocks(open_.where(F.col("n") > short), texts, part)
    return found.union(more).union(blocks)


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fp (its node), root (one node for all of a component), component_id (its smallest doc_id)."""
    rows = written(signed_rows(docs, id_col, text_col))
    nodes = written(rows.groupBy("fp").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sim").alias("sim"), F.count("*").alias("copies")))
    return simhash.rooted(rows.select("doc_id", "fp"), links(nodes, docs, text_col))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, the one with the smallest id, with all its columns."""
    return simhash.one_each(docs, clustered(docs, id_col, text_col), node_of, id_col, text_col)
