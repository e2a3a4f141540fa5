"""Language ID by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. A word's probability is the sum over all its
segmentations into pieces, by a forward recursion; a text's is the product over its words. Texts go to the language
with the largest value (priors equal); the score is its posterior per word of the text, a number from 0 to 1.

Words are runs of letters, with the marks on them, of the lower-cased text, whole, whatever their length (digits, fractions and number
signs are no letters); the vocabulary is that of a public tokenizer, lower-cased, all its pieces of letters and marks. Every
single letter or mark seen in training is a piece as well, and one never seen has the same small probability in each language.

The probabilities come from expectation-maximisation over words of at most `train_docs` labelled texts a language (a
hash of the id picks them, so the bound holds on average at any size); words of over WORD_CHARS letters are learned in
stretches of that length, and scored whole. A round is one pass of tasks, each of which
sends expected counts for (language, piece): at most languages times pieces, whatever the input.

Defined cases: a null text, and one without a letter, is `und` with score 0; learning rows with a null lang or text are
skipped; ties go to the language that sorts first; with no learning rows all are `und`; repeated rows get a row each;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_CHARS, TRAIN_DOCS, ROUNDS = 24, 1500, 3
WORD, PIECE = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"[\p{L}\p{M}]+")
BASE = np.uint64(1_000_003)
FLOOR = 1e-7
#: A task keeps this many scores of words at most (beyond those of its last batch).
KEPT_SCORES = 2_000_000


def public_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters and marks only, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if PIECE.fullmatch(p))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words, a row each, padded with 0; and their lengths."""
    longest = max(map(len, words))
    codes = np.array(words, dtype=f"<U{longest}").view("<u4").reshape(len(words), longest)
    return codes, (codes != 0).sum(1)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c)) & ((1 << 64) - 1)
    return h


@dataclass
class Model:
    """Pieces in order of their hash, and probabilities [piece, language]; the last row is for an unknown letter."""

    languages: list[str]
    hashes: np.ndarray
    lengths: np.ndarray
    probabilities: np.ndarray

    def __post_init__(self) -> None:
        self.longest = int(self.lengths.max()) if len(self.lengths) else 1
        # A table by the hash's leading bits with a few slots each.
        bits = max(8, int(np.ceil(np.log2(len(self.hashes) + 1))) + 3)
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.hashes)
        depth = int(np.bincount(slot.astype(np.int64)).max()) if len(slot) else 1
        self.table = np.full((depth, 1 << bits), -1, np.int32)
        fill: dict[int, int] = {}
        for k, s in enumerate(slot.tolist()):
            self.table[fill.get(s, 0), s] = k
            fill[s] = fill.get(s, 0) + 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, or -1."""
        slot, found = self._slot(h), np.full(h.shape, -1, np.int32)
        for row in self.table:
            k = row[slot]
            found = np.where((k >= 0) & (self.hashes[k] == h), k, found)
        return found

    def places(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, place, word]: the piece that ends at a place and has this length, or -1; every letter is a piece."""
        n, width = codes.shape
        prefix = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * BASE + codes[:, j]
        sizes = max(1, min(self.longest, width))
        out = np.full((sizes, width, n), -1, np.int32)
        for size in range(1, sizes + 1):
            power = np.uint64(pow(int(BASE), size, 1 << 64))
            for j in range(size - 1, width):
                k = self.find(prefix[j + 1] - prefix[j + 1 - size] * power)
                out[size - 1, j] = np.where(codes[:, j] == 0, -1, k)
        unknown = (out[0] < 0) & (codes.T != 0)
        out[0][unknown] = len(self.hashes)
        return out

    def forward(self, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[place, word, language] sums over segmentations up to a place, and [word, language] for whole words."""
        sizes, width, n = places.shape
        table = np.vstack([self.probabilities, np.zeros((1, len(self.languages)))])  # -1: no such piece
        alpha = np.zeros((width + 1, n, len(self.languages)))
        alpha[0] = 1.0
        for j in range(width):
            for size in range(1, min(sizes, j + 1) + 1):
                k = places[size - 1, j]
                if (k >= 0).any():
                    alpha[j + 1] += alpha[j + 1 - size] * table[k]
        return alpha, alpha[lengths, np.arange(n)]

    def whole(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[word, language]: logarithms of the forward sums of whole words. Sums are rescaled on the way, so long words don't underflow."""
        sizes, width, n = places.shape
        table = np.vstack([self.probabilities, np.zeros((1, len(self.languages)))])
        recent, log = [np.ones((n, len(self.languages)))], np.zeros((n, 1))
        out = np.empty((n, len(self.languages)))
        for j in range(width):
            now = np.zeros((n, len(self.languages)))
            for size in range(1, min(sizes, j + 1) + 1):
                k = places[size - 1, j]
                if (k >= 0).any():
                    now += recent[-size] * table[k]
            recent = [*recent[-sizes + 1 :], now] if sizes > 1 else [now]
            ended = lengths == j + 1
            if ended.any():
                out[ended] = np.log(np.maximum(now[ended], 1e-300)) + log[ended]
            if j % 16 == 15:
                scale = now.max(1, keepdims=True)
                scale[scale <= 0] = 1.0
                recent, log = [x / scale for x in recent], log + np.log(scale)
        return out

    def batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Places in words, codes and lengths of some words of like length, so that sums for all languages stay within a few MB."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        step = max(256, 32768 // len(self.languages))
        a = 0
        while a < len(order):
            b = min(a + step, len(order))
            while b > a + 1 and (b - a) * len(words[order[b - 1]]) > step * WORD_CHARS:
                b = a + (b - a) // 2
            part = order[a:b]
            yield part, *_codes([words[i] for i in part])
            a = b

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: logarithm of the probability of each word."""
        out = np.empty((len(words), len(self.languages)))
        for part, codes, lengths in self.batches(words):
            out[part] = self.whole(self.places(codes), lengths)
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """[piece, language]: expected uses of each piece, where times [word, language] counts the words."""
        total = np.zeros_like(self.probabilities)
        for part, codes, lengths in self.batches(words):
            places = self.places(codes)
            alpha, whole = self.forward(places, lengths)
            table = np.vstack([self.probabilities, np.zeros((1, len(self.languages)))])
            sizes, width, n = places.shape
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(n)] = 1.0
            share = times[part] / np.maximum(whole, 1e-300)
            for j in range(width - 1, -1, -1):
                for size in range(1, min(sizes, j + 1) + 1):
                    k = places[size - 1, j]
                    known = np.flatnonzero(k >= 0)
                    if len(known):
                        p = table[k[known]] * beta[j + 1, known]
                        uses = alpha[j + 1 - size, known] * p * share[known]
                        beta[j + 1 - size, known] += p
                        for language in range(len(self.languages)):
                            total[:, language] += np.bincount(k[known], uses[:, language], len(total))
        return total


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _stretches(words: list[str]) -> list[str]:
    """For learning: words of over WORD_CHARS letters in stretches."""
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)] if any(len(w) > WORD_CHARS for w in words) else words


def _learning(docs: DataFrame, languages: dict[str, int], train_docs: int) -> DataFrame:
    """(lang, text) of at most train_docs rows a language on average, by a hash of the id."""
    share = F.lit(0.0)
    for name, n in languages.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_docs / n))).otherwise(share)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.where("lang is not null and text is not null").where(part < share).select("lang", "text")


def _start(pieces: list[str], letters: list[str], languages: list[str]) -> Model:
    known = {_hash(p): len(p) for p in [*pieces, *letters]}
    hashes = np.array(sorted(known), np.uint64)
    lengths = np.array([known[int(h)] for h in hashes])
    # Before the first round a piece is as likely as its letters at 1/16 each would make it, so that every length is tried.
    first = np.append(16.0 ** -lengths.astype(float), FLOOR)
    return Model(languages, hashes, lengths, np.repeat((first / first.sum())[:, None], len(languages), axis=1))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model | None:
    """The model of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    counted = docs.where("lang is not null and text is not null").groupBy("lang").count().collect()  # a row per language
    languages = {r["lang"]: r["count"] for r in sorted(counted, key=lambda r: r["lang"])}
    if not languages:
        return None
    names = list(languages)
    sample = checkpointed(_learning(docs, languages, train_docs).repartition(max(2, spark.sparkContext.defaultParallelism)))

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set().union(*(w for text in batch.column("text").to_pylist() for w in _words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["letter"])

    letters = [r.letter for r in sample.mapInArrow(alphabet, "letter string").distinct().collect()]  # Unicode's letters at most
    model = _start(public_pieces(vocabulary), letters, names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            now, total = shared.value, 0
            for batch in batches:
                number: dict[str, int] = {}
                uses: list[np.ndarray] = []
                which = batch.column("lang").to_pylist()
                ids = [np.array([number.setdefault(w, len(number)) for w in _stretches(_words(t))], np.int64) for t in batch.column("text").to_pylist()]
                times = np.zeros((len(number), len(names)))
                for lang, x in zip(which, ids):
                    times[:, names.index(lang)] += np.bincount(x, minlength=len(number))
                if number:
                    uses.append(now.expected(list(number), times))
                    total = total + uses[-1]
            if isinstance(total, np.ndarray):
                piece, language = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], ["piece", "language", "uses"])

        summed = sample.mapInArrow(expect, "piece long, language long, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full_like(model.probabilities, 1e-2)  # a little for pieces without use, so that none is impossible
        for r in summed:
            uses[r.piece, r.language] += r.uses
        uses[-1] = 0
        probabilities = uses / uses.sum(0)
        probabilities[-1] = FLOOR
        model = Model(names, model.hashes, model.lengths, probabilities)
    return model


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score. Reads the text alone."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Model | None = shared.value
        known: dict[str, int] = {}
        values: np.ndarray | None = None
        for batch in batches:
            if now is not None and len(known) * len(now.languages) > KEPT_SCORES:  # words are scored again when they come back
                known, values = {}, None
            before = len(known)
            ids = [np.array([known.setdefault(w, len(known)) for w in _words(t)], np.int64) for t in batch.column("text").to_pylist()]
            names, scores = [], []
            if now is not None and len(known) > before:
                new = now.scores(list(known)[before:])
                values = new if values is None else np.vstack([values, new])
            for x in ids:
                if now is None or not len(x):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = values[x].sum(0)
                best = int(total.argmax())
                names.append(now.languages[best])
                scores.append(float(1 / np.exp((total - total[best]) / len(x)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([narrow.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(run, schema)
