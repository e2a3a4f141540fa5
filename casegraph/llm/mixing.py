"""Temperature mixing: source shares raised to an exponent, realised as budgeted block permutations.

Weights are w_s = p_s**a / sum(p**a) for token shares p. The exponent a in [0, 1] is bisected: the largest one whose
weights reach a target entropy (a fraction of the logarithm of the number of sources), then, if a source would repeat
more often than `max_epochs`, the smallest larger one that keeps the limit. Only sums over sources reach the driver.

A source's budget is its weight times the total budget, in tokens. Its rows are dealt into up to 2**BIN_BITS blocks by
hash. An epoch reads all blocks in an order of its own; the last epoch stops where the budget ends. A row's copy is in
the mix if its first token is within the budget. Its `position` is the token it starts at in its source's budget,
and position / budget orders the whole mix: any stretch of that order has the sources in their target weights.

The total budget is a number of tokens, "corpus" (as many as there are), or "cover" (the least that reads every source
once at least, so that no row is left out).

Defined cases: a null source is a source of its own; a null or wordless text has no tokens and exactly one copy; a
source without tokens has weight zero, and one copy of each row; with one source, or none, the exponent is 1; where no exponent keeps
the repetition limit, it is 1; repeated rows are mixed one by one. Columns of any name are carried whole.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TARGET_ENTROPY, MAX_EPOCHS, BIN_BITS, MIX_BLOCKS = 0.95, 4.0, 12, 1000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Shares:
    """What the bisection needs of the sources' token shares."""

    sources: DataFrame  # key, tokens, share (of sources with tokens)
    n: int
    total: int
    low: float
    high: float

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """Per exponent: sum of share**a, sum of share**a * ln(share)."""
        terms = [F.sum(F.pow("share", F.lit(a)) * x) for a in exponents for x in (F.lit(1.0), F.log("share"))]
        row = self.sources.agg(*(t.alias(f"s{i}") for i, t in enumerate(terms))).first()
        return list(zip(row[::2], row[1::2]))


def _bisect(shares: Shares, holds, low: float, high: float, rounds: int = 7, parts: int = 16) -> tuple[float, float]:
    """The last exponent that holds and the first that doesn't, by dividing the interval again and again; holds(low) is true."""
    for _ in range(rounds):
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        for a, (z, s) in zip(grid, shares.sums(grid)):
            if holds(a, z, s):
                low = a
            else:
                high = a
                break
    return low, high


def exponent(shares: Shares, budget: str | float, target_entropy: float, max_epochs: float) -> float:
    if shares.n < 2:
        return 1.0

    def flat(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= target_entropy * math.log(shares.n)

    def over(a: float, z: float, s: float) -> bool:
        """Whether the source that repeats most does so more than max_epochs times."""
        if budget == "cover":
            times = (shares.low / shares.high) ** (a - 1)
        else:
            times = (shares.total if budget == "corpus" else budget) / shares.total * shares.low ** (a - 1) / z
        return times > max_epochs

    at = dict(zip((0.0, 1.0), shares.sums([0.0, 1.0])))
    a = 1.0 if flat(1.0, *at[1.0]) else _bisect(shares, flat, 0.0, 1.0)[0] if flat(0.0, *at[0.0]) else 0.0
    z, s = shares.sums([a])[0]
    if over(a, z, s):
        a = 1.0 if over(1.0, *at[1.0]) else _bisect(shares, over, a, 1.0)[1]
    return a


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, carried: Column) -> DataFrame:
    """Each row's key (its source, null apart from any name), tokens, and place in its source's permutation."""
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    hashed = F.xxhash64(F.col(id_col), text)
    return docs.select(
        carried.alias("row"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.shiftrightunsigned(hashed, 64 - BIN_BITS).cast("int").alias("bin"),
        hashed.alias("h"),
    )


def budgets(bins: DataFrame, budget: str | float, target_entropy: float, max_epochs: float) -> tuple[DataFrame, float]:
    """Per key: tokens, weight, budget. And the exponent."""
    sources = bins.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    n, total, low, high = sources.where("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    total = total or 0
    if not n:
        return sources.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget")), 1.0
    shares = Shares(sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(total)), n, total, low / total, high / total)
    a = exponent(shares, budget, target_entropy, max_epochs)
    z = shares.sums([a])[0][0]
    whole = total * shares.high ** (1 - a) * z if budget == "cover" else total if budget == "corpus" else budget
    share = F.col("tokens") / F.lit(total)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(0.0)
    tokens = F.round(weight * F.lit(float(whole))).cast("long")
    if budget == "cover":
        tokens = F.greatest(tokens, F.col("tokens"))
    return sources.select("key", "tokens", weight.alias("weight"), tokens.alias("budget")), a


def _realised(rows: DataFrame, bins: DataFrame, plan: DataFrame) -> DataFrame:
    """row, key, tokens, weight, budget, epoch, position: one row per copy in the mix."""
    epochs = F.greatest(F.lit(1), F.when(F.col("total") > 0, F.ceil(F.col("budget") / F.col("total"))).otherwise(1)).cast("int")
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64("bin", "epoch"), "bin")
    starts = (
        bins.withColumnRenamed("tokens", "in_bin")
        .join(plan.withColumnRenamed("tokens", "total"), "key")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
        .withColumn("start", F.col("epoch") * F.col("total") + F.sum("in_bin").over(order) - F.col("in_bin"))
        .where("start < budget or epoch = 0")
        .select("key", "bin", "epoch", "start", "weight", "budget")
    )
    before = F.sum("tokens").over(Window.partitionBy("key", "bin").orderBy("h", "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = rows.withColumn("before", before)
    return (
        placed.join(starts, ["key", "bin"])
        .withColumn("position", F.col("start") + F.col("before"))
        .where("(tokens > 0 and position < budget) or (tokens = 0 and epoch = 0)")
        .select("row", "key", "tokens", "weight", "budget", "epoch", "position")
    )


def _bins(rows: DataFrame) -> DataFrame:
    return checkpointed(rows.groupBy("key", "bin").agg(F.sum("tokens").alias("tokens")))


def planned(docs: DataFrame, budget: str | float = "corpus", target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, blocks: int = MIX_BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per copy in the mix: doc_id, source, n_tokens, epoch, position, block, weight, budget, exponent.

    `block` is the copy's place in the mix, cut into equal parts: each part has the target weights.
    """
    rows = checkpointed(_rows(docs, id_col, text_col, source_col, F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))))
    bins = _bins(rows)
    plan, a = budgets(bins, budget, target_entropy, max_epochs)
    block = F.when(F.col("budget") > 0, F.least(F.floor(F.col("position") / F.col("budget") * blocks), F.lit(blocks - 1))).otherwise(0)
    return _realised(rows, bins, plan).select(
        "row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), "epoch", "position", block.cast("int").alias("block"), "weight", "budget", F.lit(a).alias("exponent")
    )


def mixed(docs: DataFrame, budget: str | float = "cover", target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix has them."""
    rows = _rows(docs, id_col, text_col, source_col, F.struct("*"))
    bins = _bins(rows.drop("row"))
    plan, _ = budgets(bins, budget, target_entropy, max_epochs)
    return _realised(rows, bins, plan).select("row.*")
