"""Histogram sort: documents into shards of near equal bytes.

Rows have a sort key of two parts, the text's hash and the id's hash, so equal texts lie side by side. The bytes below
candidate boundaries are counted exactly over all partitions: a round counts the bytes of every bin of each interval
that still holds a splitter, and only the bin that the splitter falls into is refined in the next round. A splitter is
settled once a boundary between bins is within `tolerance` of its target, or no finer boundary exists. A group of
equal texts is cut only where it is larger than the tolerance allows; then the id's hash takes over inside that text.
Rows with equal text and id are dealt by a third part, which is their place in the written table of keys.

A round brings at most (shards - 1) * 2**BITS counts to the driver, whatever the size of the input. Then one exchange
brings each shard's rows together by key, in pieces of the key's range, so no task needs a whole shard.

Defined cases: a null text has no bytes, checksum 0, and is a group of its own with the empty text; rows with a null id are
dealt like others; an empty table gives no rows; other columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, OVERHEAD, TOLERANCE, BITS = 40, 16, 0.005, 12
#: The parts of the sort key in order, as signed longs whose unsigned value is the order.
PARTS = ["h_text", "h_id", "h_row"]
#: A shard's rows are brought together in this many pieces of the key (bits of the text's and of the id's hash).
PIECE_BITS = (10, 6)


@dataclass(frozen=True)
class Interval:
    """Keys that start with `above` (whole parts) and then the `bits` leading bits `prefix` of the next part."""

    above: tuple[int, ...] = ()
    bits: int = 0
    prefix: int = 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the sort key of each row, and a struct of the columns to carry."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h_text"),
        F.xxhash64(F.col(id_col)).alias("h_id"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    return rows.withColumn("h_row", F.xxhash64(F.monotonically_increasing_id()))


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _within(interval: Interval) -> Column:
    test = F.lit(True)
    for part, value in zip(PARTS, interval.above):
        test = test & (F.col(part) == F.lit(_signed(value)))
    if interval.bits:
        test = test & (F.shiftrightunsigned(PARTS[len(interval.above)], 64 - interval.bits) == F.lit(interval.prefix))
    return test


def _histogram(rows: DataFrame, intervals: list[Interval]) -> dict[Interval, list]:
    """Per interval its bins in order: (number of the bin, bytes, whether the bin has one value of the part, that value)."""
    which, bins, part_of = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, x in enumerate(intervals):
        part = F.col(PARTS[len(x.above)])
        take = min(BITS, 64 - x.bits)
        of_bin = F.shiftrightunsigned(part, 64 - x.bits - take).bitwiseAND(F.lit((1 << take) - 1))
        which, bins, part_of = (F.when(_within(x), y).otherwise(z) for y, z in ((F.lit(i), which), (of_bin, bins), (part, part_of)))
    found = (
        rows.select(which.alias("i"), bins.alias("bin"), part_of.alias("part"), "size")
        .where("i is not null")
        .groupBy("i", "bin")
        .agg(F.sum("size").alias("bytes"), F.min("part").alias("low"), F.max("part").alias("high"))
    )
    out: dict[Interval, list] = {x: [] for x in intervals}
    for r in found.collect():  # at most len(intervals) * 2**BITS rows
        out[intervals[r.i]].append((r.bin, r.bytes, r.low == r.high, _unsigned(r.low)))
    for x in out.values():
        x.sort()
    return out


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """shards - 1 boundaries in order: a row is at or past a boundary if its key is not below it (parts as unsigned)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # Of each open splitter: the interval it is in, and the bytes below that interval.
    open_: dict[int, tuple[Interval, int]] = {k: (Interval(), 0) for k in range(1, shards)} if total else {}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        counts = _histogram(rows, sorted({x for x, _ in open_.values()}, key=lambda x: (x.above, x.bits, x.prefix)))
        for k, (x, below) in list(open_.items()):
            target = total * k / shards
            take = min(BITS, 64 - x.bits)
            start = lambda b: (*x.above, (x.prefix << (64 - x.bits) if x.bits else 0) + (b << (64 - x.bits - take)))  # noqa: B023, E731
            for b, size, single, value in counts[x]:
                if below + size >= target:
                    break
                below += size
            low, high = target - below, below + size - target  # of the boundaries before and after this bin
            last = single and len(x.above) == len(PARTS) - 1
            if min(low, high) <= slack or last:
                done[k] = start(b) if low <= high else start(b + 1) if b + 1 < 1 << take else _next(start(b), x.bits + take)
                del open_[k]
            elif single:
                open_[k] = (Interval((*x.above, value)), below)
            else:
                open_[k] = (Interval(x.above, x.bits + take, (x.prefix << take) + b), below)
    return [done[k] for k in sorted(done)]


def _next(start: tuple[int, ...], bits: int) -> tuple[int, ...]:
    """The start of the bin after the one of `bits` leading bits that starts here; it may pass the part's end."""
    value = start[-1] + (1 << (64 - bits))
    return (*start[:-1], value)


def _at_or_past(boundary: tuple[int, ...]) -> Column:
    """key >= boundary, part by part as unsigned."""
    flip = F.lit(-(1 << 63))
    part, value = F.col(PARTS[len(boundary) - 1]).bitwiseXOR(flip), boundary[-1]
    test = F.lit(False) if value >= 1 << 64 else part >= F.lit(_signed(value) ^ -(1 << 63))
    for i in range(len(boundary) - 2, -1, -1):
        part, value = F.col(PARTS[i]).bitwiseXOR(flip), _signed(boundary[i]) ^ -(1 << 63)
        test = (part > F.lit(value)) | ((part == F.lit(value)) & test)
    return test


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law `bytes`, shard, slot (gapless in a shard; by pieces, in key order inside a piece), and
    `carried`, a struct of the columns named in carry."""
    rows = written(keyed(docs, id_col, text_col, carry))
    shard = F.lit(0)
    for boundary in splitters(rows, shards, tolerance):
        shard = shard + _at_or_past(boundary).cast("int")
    a, b = PIECE_BITS
    piece = F.shiftrightunsigned("h_text", 64 - a).cast("int") * (1 << b) + F.shiftrightunsigned("h_id", 64 - b).cast("int")
    # Inside a piece rows go by the whole key; pieces of a shard follow each other by their number.
    dealt = rows.select("*", shard.alias("shard"), piece.alias("piece"))
    pieces = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    offsets = pieces.select("shard", "piece", before.alias("before"))  # at most 2**16 + shards rows
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*(flip(c) for c in PARTS)))
    return (
        dealt.withColumn("place", place)
        .join(F.broadcast(offsets), ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), *(["carried"] if carry else []))
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of docs as Parquet folders shard=0, shard=1, ..., each row with its slot."""
    rows = sharded(docs, shards, id_col=id_col, text_col=text_col, carry=docs.columns)
    rows.select("shard", "slot", "carried").write.partitionBy("shard").parquet(path)
