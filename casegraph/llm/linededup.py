"""Line dedup by a log-template tree of fixed depth.

A line's tokens are `[^\\x20\\x09-\\x0D]+`; tokens with a digit are variable fields, `<*>`. The tree's path is the number of
tokens and the leading token. At a leaf a line is a row of up to SEGMENTS stretches: its tokens if they are that few, else
equal stretches of them. How many lines of the leaf have a stretch at its place is counted over the whole table. A
template's fixed parts are in all of its lines, a variable field's values in fewer, so a line's candidates for its template
are its stretches in falling order of that count, cut wherever the count falls, the others generalised to variable
fields. Candidates whose fixed part has under FIXED of the tokens are too loose and are left out.

A template recurs if it is in `min_docs` different texts, or if it is a whole line of `long_tokens` or more in `long_docs`, or, for
lines of one or two tokens, in `short_docs`. The lines that fit a recurring template are dropped. (A file that is merely
copied as a whole is one text, and does not make its lines recur.)

Stretches are 64-bit hashes, a template is two 64-bit hashes over its stretches, and a row two over its id and text: a false match
needs two lines of equal length, leading token and other stretches, or a collision in 128 bits. Only hashes are shuffled
until the dropped lines are known; they are then joined with the texts by row. A stretch or template that holds
more than one in HOT of all rows is joined by broadcast (there are HOT at most), the others by a shuffle. DataFrame functions only.

Defined cases: a null text has no lines and stays null; an empty text has no lines; a blank line stays; rows of equal id and text get
equal results, a row each; null ids are allowed; an empty table gives an empty table; other columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

SEGMENTS, FIXED = 8, 0.6


@dataclass(frozen=True)
class Support:
    """In how many different texts a template must be."""

    min_docs: int = 5
    short_docs: int = 20
    long_docs: int = 2
    long_tokens: int = 40

    def needed(self, n: Column, whole: Column) -> Column:
        return F.when(n <= 2, self.short_docs).when((n >= self.long_tokens) & whole, self.long_docs).otherwise(self.min_docs)


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.xxhash64(F.lit(1), F.col(text_col)).alias("text_key")]


def _cut(n: Column, j: Column | int) -> Column:
    """The number of tokens before stretch j."""
    j = F.lit(j) if isinstance(j, int) else j
    return F.greatest(F.floor(n * j / SEGMENTS).cast("int"), F.least(j, n))


def _stretches(words: Column, n: Column, low: int, high: int) -> list[Column]:
    """Stretches low to high - 1 of words, which holds just these, by halving."""
    if high - low == 1:
        return [words]
    mid = (low + high) // 2
    left, right = _cut(n, mid) - _cut(n, low), _cut(n, high) - _cut(n, mid)
    half = lambda count: F.call_function("substring_index", words, F.lit(" "), count)
    return _stretches(half(left), n, low, mid) + _stretches(half(-right), n, mid, high)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, text_key, line, n, stretches) of each line with tokens; lines count from 0."""
    text = F.col(text_col)
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    plain = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    each = docs.select(*_row_keys(id_col, text_col), F.posexplode(F.split(plain, "\n")).alias("line", "raw"))
    squeezed = F.trim(F.when(F.col("raw").contains("  "), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw")))
    masked = F.when(F.col("words").rlike("[0-9]"), F.regexp_replace("words", "[^ 0-9]*[0-9][^ ]*", "<*>")).otherwise(F.col("words"))
    each = each.select("row_key", "text_key", "line", squeezed.alias("words")).where("words <> ''").withColumn("words", masked)
    each = each.withColumn("n", F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    lead = F.substring_index("words", " ", 1)
    hashed = [F.when(F.col("n") > j, F.xxhash64(F.lit(j), "n", lead, s)) for j, s in enumerate(_stretches(F.col("words"), F.col("n"), 0, SEGMENTS))]
    return each.select("row_key", "text_key", "line", "n", F.array_compact(F.array(*hashed)).alias("stretches"))


def _candidates(met: DataFrame, support: Support) -> DataFrame:
    """(row_key, text_key, line, a, b, needed): the templates that a line may fit, from the counts of its stretches."""
    n = F.col("n")
    width = _cut(n, F.col("j") + 1) - _cut(n, F.col("j"))
    of_line = met.withColumn("width", width).groupBy("row_key", "text_key", "line", "n").agg(F.collect_list(F.struct("c", "j", "width", "stretch")).alias("m"))
    tokens = lambda m: F.aggregate(m, F.lit(0), lambda s, x: s + x["width"])
    fixed = F.transform(F.array_distinct(F.transform("m", lambda x: x["c"])), lambda c: F.filter("m", lambda x: x["c"] >= c))
    found = of_line.where(tokens(F.col("m")) >= FIXED * n).withColumn("fixed", F.explode(F.filter(fixed, lambda m: tokens(m) >= FIXED * n)))
    found = found.withColumn("parts", F.transform(F.array_sort(F.transform("fixed", lambda x: F.struct(x["j"], x["stretch"]))), lambda x: x["stretch"]))
    whole = F.size("parts") == F.least(n, F.lit(SEGMENTS))
    return found.select("row_key", "text_key", "line", F.xxhash64(F.lit(1), "parts").alias("a"), F.xxhash64(F.lit(2), "parts").alias("b"), support.needed(n, whole).alias("needed"))


def recurring_lines(docs: DataFrame, support: Support = Support(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, text_key, dropped): for rows with lines of recurring templates, those lines' numbers."""
    parsed = written(lines(docs, id_col, text_col))
    each = parsed.select("row_key", "text_key", "line", "n", F.posexplode("stretches").alias("j", "stretch"))
    total = parsed.agg(F.sum(F.size("stretches"))).first()[0] or 0
    least = support.needed(F.col("n"), F.lit(True))
    often = written(each.groupBy("stretch", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("stretch", "c"))
    found = written(_candidates(join_hot(each, often, ["stretch"], "c", total), support))
    texts = found.groupBy("a", "b", "needed").agg(F.count_distinct("text_key").alias("n"), F.count("*").alias("c")).where("n >= needed").select("a", "b", "c")
    dropped = join_hot(found, written(texts), ["a", "b"], "c", found.count())
    return dropped.groupBy("row_key", "text_key").agg(F.collect_set("line").alias("dropped"))


def cleaned(docs: DataFrame, support: Support = Support(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of recurring templates: `row` (the whole input row), `clean_text`, `n_lines`, `n_dropped`."""
    found = written(recurring_lines(docs, support, id_col, text_col))
    keyed = docs.select(F.struct("*").alias("row"), *_row_keys(id_col, text_col))
    text = F.col("row").getField(text_col)
    parts = F.split(text, "\n")
    has = F.length(text) > 0
    joined = keyed.join(found, ["row_key", "text_key"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped"))
    return joined.select("row", "dropped", F.when(has & F.col("dropped").isNotNull(), parts).alias("parts"), F.when(has, F.size(parts)).otherwise(0).cast("long").alias("n_lines")).select(
        "row",
        F.when(F.col("parts").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n")).alias("clean_text"),
        "n_lines",
        F.when(F.col("parts").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )
