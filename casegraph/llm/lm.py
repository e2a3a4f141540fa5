"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are the A-Z-lower-cased words `[^\\x20\\x09-\\x0D]+` of a text, then one end. With the two tokens before, b and then a, a
token w of class k has the probability

    P(w | a, b) = softmax(bias + W[b] + W[a b] + W[a])[k] * softmax(bias_k + U_k[b] + U_k[a b] + U_k[a])[slot of w in k] * leaf(w)

W and the U_k are tables of weights by hashed features: the n-gram features (the word before, the two words before) and the
skip feature (the word before that). The OWN most frequent tokens are classes of their own, without a second factor; all
others share SHARED classes by their last bytes. In each of these the OWN most frequent tokens have slots of their own, and
the others share SHARED slots by their last bytes. leaf(w) is 1 for a token with a class or slot of its own, and
(c(w) + 1) / (N + V + 1) for one that shares its slot, with counts over all training texts; a token that training has not
seen has c = 0.

W has a row for every 2**ROW_BITS distinct training tokens or so, 2**MIN_BITS at least and 2**MAX_BITS at most (the model is broadcast, so
its size has a bound: 52 MB); the U_k together have twice as many.

Training: token counts (one shuffle of per-task sums), then EPOCHS over all training texts. In an epoch each task starts from the
weights so far and follows the gradient of the log-likelihood of its own tokens, some (STEP_A_ROW for each row of W) at a time, with AdaGrad steps.
A row's new weights are the mean of the tasks' weights for it, weighted by their numbers of tokens with that
feature; the sums are made in Spark, and only the model reaches the driver. A task has TOKENS_A_ROW tokens a row of W at least
where there are that many, so that the sums stay small beside the texts. The result depends on how the input is partitioned, not on
the order in which tasks run, or run again.

Scoring is one pass in numpy batches. The HEAD most frequent tokens travel with the model, so their counts are at hand; the
other tokens of a text are joined with the counts. No token is dropped.

Defined cases: a null text is empty: its only token is the end; a null id is not held out; repeated rows get a row each; with
no training texts counts are zero and classes equally likely; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, utf8, written

END = b"\n"  # no word holds it
OWN, SHARED = 16, 16
SLOTS = OWN + SHARED
ROW_BITS, MIN_BITS, MAX_BITS = 8, 14, 17
HEAD, HEAD_BYTES = 1 << 17, 64
EPOCHS, RATE, SHRINK = 1, 0.6, 10.0
TOKENS_A_ROW, STEP_A_ROW, STEP, KEPT_WORDS = 128, 2, 1 << 15, 400_000
#: Odd multipliers of the features' hashes.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BLOCK_ROWS = 64


def tokens_of(raw: bytes | None) -> list[bytes]:
    words = raw.translate(ASCII_LOWER).split() if raw else []
    words.append(END)
    return words


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def counts(texts: DataFrame) -> DataFrame:
    """(token, c) of a table of texts: sums of each task's counts, which it sends on when they grow large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "c"])
            seen.clear()
            return out

        for batch in batches:
            for raw in utf8(batch.column("text")):
                seen.update(tokens_of(raw))
                if len(seen) > KEPT_WORDS:
                    yield rows()
        yield rows()

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def suffix(token: bytes) -> tuple[int, int]:
    """The shared class of a token and its shared slot there."""
    k = zlib.crc32(token[-3:])
    return k % SHARED, k // SHARED % SHARED


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    head: list[bytes]  # most frequent first; the first OWN are classes of their own
    head_c: np.ndarray
    slot: np.ndarray  # by place in the head: the own slot in its shared class, or -1
    leaf: np.ndarray  # [shared class, shared slot]: N + V + 1
    bias: np.ndarray  # [class]
    slot_bias: np.ndarray  # [shared class, slot]
    weights: np.ndarray  # W: [feature, class]
    slot_weights: np.ndarray  # the U: [shared class * rows + feature, slot]
    place: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}}

    def known(self) -> dict[bytes, int]:
        if not self.place:
            self.place = {w: i for i, w in enumerate(self.head)}
        return self.place

    def with_weights(self, weights: np.ndarray, slot_weights: np.ndarray) -> Model:
        return replace(self, weights=weights.astype("<f4"), slot_weights=slot_weights.astype("<f4"), place={})


class Words:
    """Numbers for the words of a task, with hash, class, slot, leaf and head place of each; 0 is what stands before a text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b" ": 0}
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros((4, 0), np.int64)

    def grow(self) -> None:
        new = list(self.number)[self.at.shape[1] :]
        known, slot = self.model.known(), self.model.slot
        rows = []
        for w in new:
            p = known.get(w, -1)
            if 0 <= p < OWN:
                rows.append((p, 0, 0, p))
            else:
                k, shared = suffix(w)
                own = int(slot[p]) if p >= 0 else -1
                rows.append((OWN + k, own if own >= 0 else OWN + shared, k * SHARED + shared, p))
        self.hash = np.concatenate([self.hash, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)])
        self.at = np.concatenate([self.at, np.array(rows, np.int64).reshape(-1, 4).T], 1)


def _numbered(batches: Iterator[pa.RecordBatch], words: Words, size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of a batch, their tokens' numbers one after the other, with two zeros before each text, and lengths."""
    for batch in batches:
        flat: list[int] = []
        lengths: list[int] = []
        begin = 0
        texts = utf8(batch.column("text"))
        for i, raw in enumerate(texts):
            tokens = tokens_of(raw)
            number = words.number
            flat += (0, 0)
            flat += [number.setdefault(w, len(number)) for w in tokens]
            lengths.append(len(tokens))
            if len(flat) >= size or i == len(texts) - 1:
                words.grow()
                yield batch.slice(begin, i + 1 - begin), np.array(flat, np.int64), np.array(lengths, np.int64)
                flat, lengths, begin = [], [], i + 1
                if len(words.number) > KEPT_WORDS:
                    words.clear()


def _mixed(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of the tokens at these places, of hashes in text order."""
    one, two = h[at - 1], h[at - 2]
    mixed = (one * MIX[0], (one * MIX[1]) ^ (two * MIX[2] + MIX[0]), two * MIX[2])
    return [(m ^ (m >> np.uint64(29))) * MIX[1] for m in mixed]


def _rows(mixed: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """The features' rows in a table of `rows`, a power of two."""
    shift = np.uint64(65 - int(rows).bit_length())
    return [(m >> shift).astype(np.int64) for m in mixed]


def _odds(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """[token, slot] in proportion to the probabilities; bounded weights keep the exponents in range."""
    x = table.take(rows[0], 0)
    x += table.take(rows[1], 0)
    x += table.take(rows[2], 0)
    x += bias
    return np.exp(x, out=x)


class _Learner:
    """A table's weights in one task, the squares of its gradients, and how often each row was used."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table.copy()
        self.squares = np.full(table.shape, 1.0, "f4")
        self.used = np.zeros(len(table))

    def learn(self, rows: list[np.ndarray], bias: np.ndarray, y: np.ndarray, rate: float) -> None:
        p = _odds(self.table, rows, bias)
        p /= -p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] += 1
        n = len(self.table)
        gradient = np.empty(self.table.shape, "f4")
        p = np.ascontiguousarray(p.T)
        for k in range(SLOTS):
            gradient[:, k] = sum(np.bincount(r, p[k], n) for r in rows)
        for r in rows:
            self.used += np.bincount(r, minlength=n)
        self.squares += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(self.squares)
        self.table += gradient
        np.clip(self.table, -10, 10, self.table)


def _learned(batches: Iterator[pa.RecordBatch], shared: Broadcast, rate: float, step: int) -> Iterator[pa.RecordBatch]:
    """A task's weights times the use of each row, and that use, in blocks of rows of both tables."""
    model: Model = shared.value
    words = Words(model)
    first, second = _Learner(model.weights), _Learner(model.slot_weights)
    n = len(model.slot_weights) // SHARED
    for _, flat, _ in _numbered(batches, words):
        h, (cls, slot, *_) = words.hash[flat], words.at[:, flat]
        places = np.flatnonzero(flat)
        for a in range(0, len(places), step):
            at = places[a : a + step]
            mixed = _mixed(h, at)
            first.learn(_rows(mixed, len(first.table)), model.bias, cls[at], rate)
            inner = cls[at] >= OWN
            k = cls[at[inner]] - OWN
            second.learn([r + k * n for r in _rows([m[inner] for m in mixed], n)], model.slot_bias[k], slot[at[inner]], rate)
    both = np.concatenate([np.column_stack([x.table * x.used[:, None], x.used]) for x in (first, second)]).astype("<f4")
    blocks = both.reshape(-1, BLOCK_ROWS * (SLOTS + 1))
    used = np.flatnonzero(blocks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], ["block", "sums"])


def _added(sums: DataFrame, rows: int) -> np.ndarray:
    """[row, slots and use]: the blocks of all tasks added up in Spark, each block in one place and one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(raw, "<f4").astype(float)
                total[block] = total[block] + part if block in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    out = np.zeros((rows // BLOCK_ROWS, BLOCK_ROWS * (SLOTS + 1)), "f4")
    # A row for each block of the model's two tables, so what is collected has the model's size.
    for r in sums.repartition("block").mapInArrow(run, "block int, sums binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.sums, "<f4")
    return out.reshape(rows, SLOTS + 1)


def _head(counted: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens and their counts: as many whole sixteenths of a power of two, from the top, as `head` tokens allow."""
    short = counted.where((F.octet_length("token") <= HEAD_BYTES) & (F.col("c") > 1))
    step = F.floor(F.log2("c") * 16).cast("int")
    # At most 16 rows for each of 63 powers of two.
    least, total = 1 << 30, 0
    for k, n in sorted(map(tuple, short.groupBy(step.alias("k")).count().collect()), reverse=True):
        total += n
        if total > head:
            break
        least = k
    top = short.where(step >= least).toArrow()
    found = sorted(zip(top.column("token").to_pylist(), top.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in found], np.array([c for _, c in found], float)


def _log_share(n: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (n + 1).sum(-1, keepdims=True)).astype("<f4")


def start(counted: DataFrame, head: int = HEAD) -> Model:
    """The model before training: classes, slots and biases from the counts, and no weights."""
    n, v = counted.agg(F.sum("c"), F.count("*")).first()
    words, head_c = _head(counted, head)
    group = (F.crc32(F.substring("token", -3, 3)) % (SHARED * SHARED)).cast("int")
    # crc % SHARED**2 is shared class + SHARED * shared slot.
    leaf = np.zeros((2, SHARED, SHARED))
    for r in counted.groupBy(group.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        leaf[:, r.k % SHARED, r.k // SHARED] = r.n, r.v
    slot = np.full(len(words), -1, np.int64)
    class_n, slot_n, taken = np.zeros(SLOTS), np.zeros((SHARED, SLOTS)), np.zeros(SHARED, np.int64)
    for i, w in enumerate(words):
        k, shared = suffix(w)
        if i < OWN:
            class_n[i] = head_c[i]
        elif taken[k] < OWN:
            slot[i] = taken[k]
            slot_n[k, slot[i]] = head_c[i]
            taken[k] += 1
        else:
            continue
        leaf[:, k, shared] -= head_c[i], 1
    slot_n[:, OWN:] = leaf[0]
    class_n[OWN:] = slot_n.sum(1)
    bits = min(max((v or 0).bit_length() - ROW_BITS, MIN_BITS), MAX_BITS)
    zero = lambda rows: np.zeros((rows, SLOTS), "<f4")
    return Model(n or 0, v or 0, words, head_c, slot, leaf.sum(0) + 1, _log_share(class_n), _log_share(slot_n), zero(1 << bits), zero(2 << bits))


def train(texts: DataFrame, epochs: int = EPOCHS, head: int = HEAD, rate: float = RATE, shrink: float = SHRINK, step_a_row: float = STEP_A_ROW) -> tuple[Model, DataFrame]:
    """The model, and the counts (token, c) of all training texts. `shrink` is how many tokens with weight zero each row's mean has besides."""
    spark = texts.sparkSession
    counted = written(counts(texts))
    model = start(counted, head)
    n, rows = len(model.weights), len(model.weights) + len(model.slot_weights)
    tasks = max(2 * spark.sparkContext.defaultParallelism, model.tokens // (TOKENS_A_ROW * n))
    texts = texts.select("text").coalesce(tasks)
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(model)
        sums = _added(texts.mapInArrow(lambda batches, shared=shared: _learned(batches, shared, rate, int(step_a_row * n)), "block int, sums binary"), rows)
        mean = sums[:, :SLOTS] / (sums[:, SLOTS:] + shrink)
        model = model.with_weights(mean[:n], mean[n:])
    return model, counted


def _scored(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    words = Words(model)
    row = TaskContext.get().partitionId() << 40
    log_c = np.append(np.log10(model.head_c + 1), 0.0)  # the last: a token outside the head
    log_n = np.log10(model.tokens + model.distinct + 1)
    log_leaf = np.log10(model.leaf).reshape(-1)
    n = len(model.slot_weights) // SHARED
    for batch, flat, lengths in _numbered(batches, words):
        h, (cls, slot, leaf, place) = words.hash[flat], words.at[:, flat]
        at_all = np.flatnonzero(flat)
        factors = np.empty(len(at_all))
        for a in range(0, len(at_all), STEP):
            at = at_all[a : a + STEP]
            mixed = _mixed(h, at)
            p = _odds(model.weights, _rows(mixed, len(model.weights)), model.bias)
            out = np.log10(p[np.arange(len(at)), cls[at]] / p.sum(1))
            inner = np.flatnonzero(cls[at] >= OWN)
            k = cls[at[inner]] - OWN
            p = _odds(model.slot_weights, [r + k * n for r in _rows([m[inner] for m in mixed], n)], model.slot_bias[k])
            out[inner] += np.log10(p[np.arange(len(k)), slot[at[inner]]] / p.sum(1))
            factors[a : a + STEP] = out
        cls, slot, leaf, place = cls[at_all], slot[at_all], leaf[at_all], place[at_all]
        of_row = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(of_row, x, len(lengths))
        within = np.where((cls < OWN) | (slot < OWN), 0.0, log_c[place] - log_leaf[leaf])
        base, score, known = add(log_c[place] - log_n), add(factors + within), add(place >= 0)

        # Tokens outside the head, once for each text with their number there.
        rest = np.flatnonzero(place < 0)
        pair, times = np.unique((of_row[rest] << 32) | flat[at_all][rest], return_counts=True)
        names = list(words.number)
        offsets = np.searchsorted(pair >> 32, np.arange(len(lengths) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays(
            [pa.array([names[i] for i in (pair & 0xFFFFFFFF).tolist()], pa.binary()), pa.array(times, pa.int64())], ["token", "n"]
        )
        ids = pa.array(np.arange(row, row + len(lengths)), pa.int64())
        row += len(lengths)
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("doc_id"), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), entries)],
            ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
        )


def score(docs: DataFrame, model: Model, counted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, base_score, score (log10 of the text's probability)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, rest array<struct<token: binary, n: bigint>>"
    found = written(narrow.mapInArrow(lambda batches: _scored(batches, shared), schema))
    rest = found.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n")
    seen = rest.join(counted, "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_c"))
    log_c = F.coalesce("log_c", F.lit(0.0))
    return found.drop("rest").join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + log_c).alias("base_score"), (F.col("score") + log_c).alias("score")
    )


def by_fold(docs: DataFrame, folds: Callable[[Column], Column] = held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and scores all rows."""
    texts = docs.where(~folds(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    model, counted = train(texts)
    return score(docs, model, counted, id_col, text_col).select(
        "doc_id", folds(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
