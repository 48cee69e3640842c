"""Quality rules: measures of the text itself, then how often its lines occur in other documents of the host.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed) and hashed. For every host and
line the distinct documents are counted; copies of a document count once, also those that differ only in
what is normalised, because a document is told apart by a hash of all its normalised lines in order. Lines
above the limit are taken out, and a document that has too little left is rejected. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.runtime import SPACE_CLASS, SPACES, landed, let

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(grams: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""
    by_hash = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, other: F.coalesce(other["g"] == x["g"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(by_hash, lambda s: let(starts(s), total))


def _repeat_words(words: Column) -> Column:
    def from_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_covered(g)))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def base_measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: without(x, SPACES) != "")
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
    return let(
        F.struct(from_words.alias("w"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        lambda m: F.struct(
            m["w"]["n"].cast("long").alias("n_words"),
            F.length(without(text, SPACES)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            m["dup"].cast("long").alias("n_dup_lines"),
            m["w"]["again"].cast("long").alias("n_repeat_words"),
            ((m["w"]["n"] < MIN_WORDS) | (100 * m["w"]["again"].cast("long") > MAX_REPEAT_PERCENT * m["w"]["n"].cast("long"))).alias("base_failed"),
        ),
    )


def normalised(line: Column) -> Column:
    plain = F.translate(line, _UPPER + _DIGITS, _UPPER.lower() + "0" * 10)
    return F.trim(F.regexp_replace(plain, f"[{SPACE_CLASS}]+", " "))


def _lines(own: DataFrame) -> DataFrame:
    """A row for each line with a word: whose it is, its number, its hash with the host, its words, and the hash of all lines of its document."""
    norms = F.filter(F.transform(F.split("text", "\n", -1), normalised), lambda x: x != "")
    whole = own.select(*_KEY, norms.alias("norms"))
    each = whole.select(*_KEY, F.xxhash64("norms").alias("lines"), F.posexplode("norms").alias("at", "norm"))
    return each.select(*_KEY, "lines", "at", F.xxhash64("host", "norm").alias("line"), F.size(F.split("norm", " ")).alias("words"))


def frequent_lines(docs: DataFrame, limit: int) -> DataFrame:
    """Hashes of (host, normalised line) in more than limit different documents of the host."""
    counted = _lines(docs).select("line", "lines").distinct().groupBy("line").count()
    return counted.filter(F.col("count") > limit).select("line")


_KEY = ["doc_id", "host", "text_hash"]


def _own(docs: DataFrame) -> DataFrame:
    """What tells rows apart: doc_id, host, text_hash; and text and source."""
    text = F.coalesce("text", F.lit(""))
    host = F.xxhash64(F.col("source").isNull(), "source")
    return docs.select("doc_id", host.alias("host"), F.xxhash64(text).alias("text_hash"), text.alias("text"), "source")


def _same(a: DataFrame, b: DataFrame, prefix: str) -> Column:
    return a.doc_id.eqNullSafe(b[f"{prefix}doc_id"]) & (a.host == b[f"{prefix}host"]) & (a.text_hash == b[f"{prefix}text_hash"])


def _judged(docs: DataFrame, limit: int, least_percent: int) -> DataFrame:
    """The key of each row, m (the base measures), removed_words and kept."""
    own = _own(docs)
    frequent = landed(frequent_lines(own, limit), "frequent-lines")
    # dealt out by document, so that both steps use one shuffle; equal rows of the table count once
    taken = _lines(own).join(frequent, "line").select(*_KEY, "at", "words").repartition(*_KEY)
    taken = taken.dropDuplicates([*_KEY, "at"]).groupBy(*(F.col(c).alias(f"of_{c}") for c in _KEY)).agg(F.sum("words").alias("words"))
    times = own.select(*_KEY, base_measures(F.col("text")).alias("m"))
    removed = F.coalesce("words", F.lit(0))
    enough = 100 * (F.col("m.n_words") - removed) >= least_percent * F.col("m.n_words")
    return times.join(taken, _same(times, taken, "of_"), "left").select(*_KEY, "m", removed.alias("removed_words"), (~F.col("m.base_failed") & enough).alias("kept"))


def quality_rules(docs: DataFrame, limit: int = 50, least_percent: int = 20) -> DataFrame:
    """Per row doc_id, the base measures, removed_words, and kept.

    docs: doc_id, text, source (the host). A null text has no words; a null host is a host of its own.
    Rows that repeat give equal rows, a null doc_id stays null, an empty table gives no rows, other
    columns are not read. A line counts as frequent when more than limit different documents of its
    host have it (those with the same normalised lines are one); kept is false if the base rules fail or if fewer than least_percent of a document's
    words lie outside frequent lines.
    """
    return _judged(docs, limit, least_percent).select("doc_id", "m.*", "removed_words", "kept")


def kept_documents(docs: DataFrame, limit: int = 50, least_percent: int = 20) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    rejected = landed(_judged(docs, limit, least_percent).filter("NOT kept").select(*(F.col(c).alias(f"__{c}") for c in _KEY)).distinct(), "rejected")
    host, text_hash = F.xxhash64(F.col("source").isNull(), "source"), F.xxhash64(F.coalesce("text", F.lit("")))
    same = docs.doc_id.eqNullSafe(rejected["__doc_id"]) & (host == rejected["__host"]) & (text_hash == rejected["__text_hash"])
    return docs.join(rejected, same, "left_anti")
