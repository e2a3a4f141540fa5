"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one failure bit per rule
(set: the rule fails). Policies are versioned sets of rules, so that a new policy, or an ablation of an old
one, is bit arithmetic on the ledger and never reads the texts again.

Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as empty: it has no words and fails `too_short`.
Repeated rows, null ids and extra columns (whatever their names) are carried through row by row; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_exclaimed",
    "n_upper",
    "n_lower",
]

#: name: the rule fails where this SQL condition on the measurements holds. A rule's place is its bit; new rules go last.
RULES = {
    "too_short": f"n_words < {MIN_WORDS}",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_exclaimed > 3 * n_words",
    "capitals": "n_upper > n_lower",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "few_lines": "n_lines < 2 and n_words > 5000",
}

#: Versioned policies: the rules that a text may not fail.
POLICIES = {
    "base-1": ["too_short", "repetitive"],
    "web-1": ["too_short", "repetitive", "symbols", "dup_lines", "shouting", "capitals", "short_words", "long_words"],
    "web-1-strict": list(RULES),
}
DEFAULT_POLICY = "web-1"


def mask(rules: list[str]) -> int:
    """The bits of these rules."""
    place = {name: i for i, name in enumerate(RULES)}
    return sum(1 << place[r] for r in set(rules))


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, total, covered = Counter(windows), 0, -1
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 2 - max(covered, i - 1)
            covered = i + 2
    return total


def _measure(raw: bytes | None) -> tuple[int, ...]:
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()  # bytes.split() cuts at \x20 and \x09-\x0D, no more
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        without(b"!"),
        without(UPPER),
        without(LOWER),
    )


def _with_measures(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_measure(x) for x in utf8(batch.column(text))]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names if n != text] + columns, [n for n in names if n != text] + MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed_bits`: one row per row of docs, in one pass without a shuffle."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = narrow.mapInArrow(lambda batches: _with_measures(batches, "text", ["doc_id", "text"]), schema)
    return measured.withColumn("failed_bits", failed_bits())


def failed_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def passes(policy: str = DEFAULT_POLICY, bits: Column | None = None) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def judged(docs: DataFrame, policy: str = DEFAULT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy."""
    base = passes("base-1")
    return ledger(docs, id_col, text_col).withColumns({"base_failed": ~base, "kept": base & passes(policy)})


def ablations(ledger_rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it rejects, rows that the policy would keep without it.

    The ledger is first summed to one row per bit pattern (at most 2 to the number of rules).
    """
    rules = POLICIES[policy]
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    every = F.lit(mask(rules))
    one = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in rules))).alias("r")
    long = patterns.select("n", F.col("failed_bits").bitwiseAND(every).alias("bits"), one).select("n", "bits", "r.rule", "r.bit")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return long.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def filtered(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the policy, with all their columns; no shuffle."""
    extra = "measured"  # a struct next to the row, under a name that no column of docs has
    while extra in docs.columns:
        extra += "_"
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dict(zip(MEASURES, _measure(x))) for x in utf8(batch.column(text_col))]
            struct = pa.array(found, pa.struct([(m, pa.int64()) for m in MEASURES]))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, extra])

    measured = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(extra, kind)]))
    # The row as a struct, so that no column of docs clashes with a measurement.
    book = measured.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), f"{extra}.*").withColumn("failed_bits", failed_bits())
    return book.where(passes("base-1") & passes(policy)).select("row.*")
