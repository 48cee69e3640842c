"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that have them, bucketed and sorted by hash,
so that it meets each new batch without a shuffle of its own. Each batch counts its lines, takes
away by merge-anti-joins what a run has already settled (a line that has reached the limit needs no more
counting), and adds the rest as a run of level 0. When a level has FANOUT runs they are compacted into one of
the next level, which adds up the counts of equal hashes. Built-in functions only.

With a limit of 1 every line in a run is settled, and what a batch adds are its new lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.runtime import SPACES, landed, let, shared_dir

#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Batches in which a whole table is taken in.
BATCHES = 8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A line's hash has two parts of 64 bits each.
HASH = ["h1", "h2"]
_DOC = ["doc_id", "text_hash"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def document_lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """A row for each line whose key has least_chars code points: doc_id, text_hash, at (from 0), h1, h2, and first: no earlier line of the document has the key."""
    text = F.coalesce("text", F.lit(""))

    def hashed(x: Column, i: Column) -> Column:
        return let(line_key(x), lambda k: F.struct(
            F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("at"), (F.length(k) >= least_chars).alias("counts"),
        ))

    def marked(s: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            again = F.coalesce((before["h1"] == x["h1"]) & (before["h2"] == x["h2"]), F.lit(False))
            return F.struct(x["at"].alias("at"), x["h1"].alias("h1"), x["h2"].alias("h2"), (~again).alias("first"))

        return F.transform(s, row)

    each = let(F.sort_array(F.filter(F.transform(_lines_of(text), hashed), lambda x: x["counts"])), marked)
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.inline(each))


class LineRuns:
    """Levelled sorted runs of line hashes in a folder that all executors share.

    A batch that fails half way leaves files that no run names; the runs so far stay as they are.
    """

    def __init__(self, spark: SparkSession, limit: int, folder: str | None = None, fanout: int = FANOUT):
        if limit < 1 or fanout < 2:
            raise ValueError("limit must be 1 or more, fanout 2 or more")
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, counted: DataFrame, level: int) -> str:
        """counted is grouped by hash already, so that a bucket lies in one task."""
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        counted.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def settled(self) -> list[DataFrame]:
        """Per run the hashes (run_h1, run_h2) that have reached the limit in it."""
        done = F.col("docs") >= self.limit
        return [self.spark.table(name).filter(done).select(*(F.col(c).alias(f"run_{c}") for c in HASH)) for name in self._runs()]

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """The rows of counted (h1, h2, docs) whose hash no run has settled: one merge-anti-join a run."""
        for run in self.settled():
            # the condition on docs holds for every row; it keeps the join above the count, so that a frequent line comes as one row, not one a document
            same = (counted.h1 == run.run_h1) & (counted.h2 == run.run_h2) & (counted.docs > 0)
            counted = counted.hint("merge").join(run.hint("merge"), same, "left_anti")
        return counted

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of lines (h1, h2, one row for each document that has the line)."""
        counted = lines.groupBy(*HASH).agg(F.count("*").alias("docs"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.unsettled(counted), 0))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._summed(runs), level + 1))
            self.levels[level] = []
            self._forget(runs)

    def _summed(self, runs: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for grouped by hash though it isn't
        paths = [f"{self.folder}/{name}" for name in runs]
        every = self.spark.read.schema("h1 long, h2 long, docs long").parquet(*paths)
        return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def _forget(self, runs: list[str]) -> None:
        """Out of the catalogue; the files stay for jobs that still read them."""
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self) -> DataFrame:
        """Hashes of lines that limit documents or more have, over all runs."""
        runs = self._runs()
        return self._summed(runs).filter(F.col("docs") >= self.limit).select(*HASH)

    def close(self) -> None:
        self._forget(self._runs())
        self.levels = []


def new_lines(runs: LineRuns, docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """Lines (doc_id, text_hash, at, h1, h2) of a batch that no earlier batch has; the batch is then added to the runs. For runs of limit 1."""
    lines = landed(document_lines(docs, least_chars), "lines")
    counted = lines.filter("first").groupBy(*HASH).agg(F.count("*").alias("docs"))
    fresh = landed(lines.join(landed(runs.unsettled(counted), "new-hashes"), HASH, "left_semi").drop("first"), "new-lines")
    runs.add(lines.filter("first").select(*HASH))
    return fresh


def frequent_lines(lines: DataFrame, limit: int, batches: int = BATCHES) -> DataFrame:
    """Hashes of lines that limit documents or more have; lines (in folders by batch) are taken in batch by batch."""
    runs = LineRuns(lines.sparkSession, limit)
    for i in range(batches):
        runs.add(lines.filter((F.col("batch") == i) & F.col("first")).select(*HASH))
    found = landed(runs.frequent(), "frequent-lines")
    runs.close()
    return found


def _without(lines: Column, gone: Column) -> Column:
    """The lines at places that gone (sorted, from 0) doesn't name."""
    def between(g: Column) -> Column:
        def part(end: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(g, i - 1) + 1, F.lit(0))
            return F.struct(begin.alias("begin"), (end - begin).alias("n"))

        return F.filter(F.transform(g, part), lambda x: x["n"] > 0)

    return let(lines, lambda ls: let(F.concat(gone, F.array(F.size(ls))), lambda g: F.flatten(F.transform(between(g), lambda x: F.slice(ls, x["begin"] + 1, x["n"])))))


def drop_frequent_lines(docs: DataFrame, limit: int = 10, least_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped and kept, the text without lines whose key limit documents or more have.

    docs: doc_id, text. A null or empty text is one empty line. Every row is a document, also one that
    repeats another or has a null doc_id; a line that stands twice in one document counts once. Lines whose
    key has fewer than least_chars code points stay. A text that loses all its lines becomes empty. An
    empty table gives no rows; other columns are not read.
    """
    batch = F.pmod(F.xxhash64(*_DOC), F.lit(batches)).cast("int")
    lines = landed(document_lines(docs, least_chars).withColumn("batch", batch), "lines", by=["batch"])
    found = frequent_lines(lines, limit, batches)
    gone = lines.join(found, HASH).select(*_DOC, "at")
    gone = gone.groupBy(*(F.col(c).alias(f"of_{c}") for c in _DOC)).agg(F.sort_array(F.collect_set("at")).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = own.join(gone, own.doc_id.eqNullSafe(gone.of_doc_id) & (own.text_hash == gone.of_text_hash), "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(_lines_of(F.col("text")), F.col("gone")), "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select("doc_id", (breaks + 1).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digests(docs: DataFrame, limit: int = 10, least_chars: int = 1) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped and kept_sha256, the digest of the text without frequent lines. Odd cases as drop_frequent_lines has them."""
    return drop_frequent_lines(docs, limit, least_chars).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
