"""Spelling variant grouping by dynamic programming over sorted lists of words.

Two words one edit apart share their first f or their last L - f code points, L being the length of the
shorter one and f half of it. So every word stands in four sorted lists: forwards and backwards, under its own
length and under one less, and only words of a list that share that beginning are compared.

A list is cut into shards of bounded size. In a shard all words are looked up at once: a word moves along the
list as a range of words that share a prefix, with the row of the edit matrix for that prefix (three cells, as
more than one edit is of no use). The lengths of the common prefixes of neighbours (LCPs) cut a range where its
next code points differ; each part goes on from the row it has got, and a range whose row has no cell below 2 is
left out with all its words. A beginning that goes over several shards sends its words from each shard to
the later ones, but for those that the common prefix of that shard's words already rules out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.llm.runtime import landed, python_ready

#: Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]"
SLIP = 31  # one run in so many loses a code point
LEAST_CHARS = 7
LEAST_TIMES = 2
MORE = 10  # a form is at least so many times as frequent

#: List entries in a shard, and words looked up together.
SHARD_ENTRIES = 100_000
TOGETHER = 2_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIRECTIONS = "FR"


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: runs of letters in lower case, some with a code point lost, of LEAST_CHARS or more that occur LEAST_TIMES or more."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"),
    )
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _UPPER.lower())).alias("run"))
    low = low.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = low.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _shared(rule: Column, direction: str) -> Column:
    """Code points that words of a list share: f forwards, the rest backwards."""
    half = F.floor(rule / 2)
    return (half if direction == "F" else rule - half).cast("int")


def list_entries(words: DataFrame) -> DataFrame:
    """Four rows a word: part (direction and rule), head (the beginning that it shares), word as the list has it, n."""
    rows = []
    for direction in _DIRECTIONS:
        shown = F.col("word") if direction == "F" else F.reverse("word")
        for less in (0, 1):
            rule = F.length("word") - less
            part = F.concat(F.lit(direction), F.lpad(rule.cast("string"), 10, "0"))
            rows.append(F.struct(part.alias("part"), F.substring(shown, F.lit(1), _shared(rule, direction)).alias("head"), shown.alias("word"), F.col("n").alias("n")))
    return words.select(F.inline(F.array(*rows)))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in one array (they are below 256), and where each begins and the last ends."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw) + b"\0", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _common_prefixes(letters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per word the length of the prefix that it shares with the word before (0 for the first)."""
    sizes = np.diff(begins)
    found = np.zeros(len(sizes), np.int64)
    going = np.arange(1, len(sizes))
    depth = 0
    while len(going):
        going = going[(sizes[going] > depth) & (sizes[going - 1] > depth)]
        going = going[letters[begins[going] + depth] == letters[begins[going - 1] + depth]]
        depth += 1
        found[going] = depth
    return found


class SortedList:
    """Different words in order, cut into sections; words are looked up one edit away."""

    def __init__(self, words: pa.Array, section: np.ndarray):
        """section: a number for each word, equal for words of a section; sections lie one after another."""
        self.letters, self.begins = _letters(words)
        self.sizes = np.diff(self.begins)
        self.lcp = _common_prefixes(self.letters, self.begins)
        self.lcp[1:][section[1:] != section[:-1]] = 0
        self.cuts: dict[int, np.ndarray] = {}

    def _cuts(self, depth: int) -> np.ndarray:
        """Where neighbours share no more than depth code points."""
        if depth not in self.cuts:
            self.cuts = {k: v for k, v in self.cuts.items() if k < 64} | {depth: np.flatnonzero(self.lcp <= depth)}
        return self.cuts[depth]

    def near(self, asked: "SortedList", i: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j): word i of asked and word j of this list at one edit, j from low to high (excluded), where all share depth code points with word i."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        order = np.argsort(depth, kind="stable")
        last_depth = int(depth.max(initial=-1))
        joining = np.searchsorted(depth[order], np.arange(last_depth + 2))
        q, lo, hi = (np.zeros(0, np.int64) for _ in range(3))
        row = np.zeros((3, 0), np.int8)
        d = int(depth.min(initial=0))
        while d <= last_depth or len(q):
            if d <= last_depth:  # words whose shared beginning ends here start with the row of an equal prefix
                new = order[joining[d] : joining[d + 1]]
                new = new[low[new] < high[new]]
                q, lo, hi = (np.concatenate(x) for x in ((q, i[new]), (lo, low[new]), (hi, high[new])))
                row = np.concatenate([row, np.repeat(np.array([[1], [0], [1]], np.int8), len(new), 1)], 1)
            # a word that ends here comes first in its range; its distance stands in the cell of the asked word's end
            ends = self.sizes[lo] == d
            cell = asked.sizes[q] - d + 1
            hit = np.flatnonzero(ends & (cell >= 0) & (cell <= 2))
            hit = hit[row[cell[hit], hit] == 1]
            found.append((q[hit], lo[hit]))
            lo = lo + ends
            # cut each range where its words differ in the next code point; parts keep the row
            cuts = self._cuts(d)
            first, last = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "left")
            parts = np.where(lo < hi, last - first + 1, 0)
            of = np.repeat(np.arange(len(q)), parts)
            number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            at = first[of] + number
            lo = np.where(number == 0, lo[of], cuts[np.maximum(at - 1, 0)])
            hi = np.where(number == parts[of] - 1, hi[of], cuts[np.minimum(at, len(cuts) - 1)])
            q, row = q[of], self._next_row(asked, q[of], row[:, of], lo, d)
            alive = row.min(0) < 2
            q, lo, hi, row = q[alive], lo[alive], hi[alive], row[:, alive]
            d += 1
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _next_row(self, asked: "SortedList", q: np.ndarray, row: np.ndarray, word: np.ndarray, d: int) -> np.ndarray:
        """The band's cells in columns d, d + 1, d + 2 from those in d - 1, d, d + 1, for the words' code point at d."""
        letter = self.letters[self.begins[word] + d]
        size, begin = asked.sizes[q], asked.begins[q]

        def differs(at: int) -> np.ndarray:
            inside = (at < size) if at >= 0 else np.zeros(len(q), bool)
            return (asked.letters[np.where(inside, begin + at, 0)] != letter) | ~inside

        x = np.minimum(row[0] + differs(d - 1), row[1] + 1)
        y = np.minimum(np.minimum(row[1] + differs(d), row[2] + 1), x + 1)
        z = np.minimum(row[2] + differs(d + 1), y + 1)
        cells = np.stack([np.where(size < d + k, 2, cell) for k, cell in enumerate((x, y, z))])
        return np.minimum(cells, 2).astype(np.int8)


def _belongs(rule: np.ndarray, backwards: bool, a: SortedList, i: np.ndarray, b: SortedList, j: np.ndarray) -> np.ndarray:
    """Whether a pair is this list's to report: the shorter word has the list's length, and backwards the beginning is not shared, else the forward list has it too."""
    mine = np.minimum(a.sizes[i], b.sizes[j]) == rule
    if not backwards:
        return mine
    equal = mine.copy()
    for k in range(int((rule // 2).max(initial=0))):
        inside = equal & (k < rule // 2)
        at = np.flatnonzero(inside)
        equal[at] = a.letters[a.begins[i[at] + 1] - 1 - k] == b.letters[b.begins[j[at] + 1] - 1 - k]
    return mine & ~equal


def _pairs(a_words: pa.Array, a_n: np.ndarray, i: np.ndarray, b_words: pa.Array, b_n: np.ndarray, j: np.ndarray, backwards: bool) -> pa.RecordBatch:
    """Both ways round: word, other, other_n."""
    x, y = a_words.take(pa.array(i)), b_words.take(pa.array(j))
    if backwards:
        x, y = pc.utf8_reverse(x), pc.utf8_reverse(y)
    other_n = np.concatenate([b_n[j], a_n[i]])
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), pa.array(other_n)], names=["word", "other", "other_n"])


def _looked_up(batches):
    """A shard's own entries in order, then words that earlier shards send: pairs at one edit."""
    own, blocks = [], None
    for batch in batches:
        sent = batch.column("sent").to_numpy(zero_copy_only=False)
        split = int(np.searchsorted(sent, True))
        if split:
            own.append(batch.slice(0, split))
        if split < len(sent):
            if blocks is None:
                blocks = list(_blocks(own))
                for block in blocks:
                    yield from block.own_pairs()
            yield from blocks[0].sent_pairs(batch.slice(split))
    if blocks is None and own:
        for block in _blocks(own):
            yield from block.own_pairs()


def _blocks(batches: list[pa.RecordBatch]):
    """Lists of words to go through at once: those of one direction and up to 64 code points, longer ones by length."""
    table = pa.Table.from_batches(batches).combine_chunks()
    column = {c: table.column(c).chunk(0) for c in ("part", "head", "word", "n")}
    parts = column["part"].dictionary_encode()
    names = parts.dictionary.to_pylist()
    codes: dict[tuple, int] = {}
    kind = np.array([codes.setdefault((x[0], max(int(x[1:]), 64)), len(codes)) for x in names])[parts.indices.to_numpy()]
    bounds = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
    for begin, end in zip(bounds, bounds[1:]):
        yield _Block({c: x.slice(begin, end - begin) for c, x in column.items()})


class _Block:
    def __init__(self, column: dict[str, pa.Array]):
        self.words, self.n = column["word"], column["n"].to_numpy()
        part, head = column["part"], column["head"]
        self.backwards = part[0].as_py()[0] == "R"
        self.rule = pc.utf8_slice_codeunits(part, 1).cast(pa.int64()).to_numpy()
        self.depth = pc.utf8_length(head).to_numpy().astype(np.int64)
        new = np.ones(len(part), bool)
        new[1:] = pc.or_(pc.not_equal(part[1:], part[:-1]), pc.not_equal(head[1:], head[:-1])).to_numpy(zero_copy_only=False)
        section = np.cumsum(new)
        self.ends = np.append(np.flatnonzero(new)[1:], len(new))[section - 1]
        self.list = SortedList(self.words, section)

    def own_pairs(self):
        for begin in range(0, len(self.words), TOGETHER):
            i = np.arange(begin, min(begin + TOGETHER, len(self.words)))
            i, j = self.list.near(self.list, i, i + 1, self.ends[i], self.depth[i])
            mine = _belongs(self.rule[i], self.backwards, self.list, i, self.list, j)
            if mine.any():
                yield _pairs(self.words, self.n, i[mine], self.words, self.n, j[mine], self.backwards)

    def sent_pairs(self, batch: pa.RecordBatch):
        """Words sent here belong to the section that goes on from the shard before: the first one."""
        for begin in range(0, len(batch), TOGETHER):
            words = batch.column("word").slice(begin, TOGETHER)
            n = batch.column("n").slice(begin, TOGETHER).to_numpy()
            asked = SortedList(words, np.arange(len(words)))
            i = np.arange(len(words))
            i, j = self.list.near(asked, i, np.zeros_like(i), np.repeat(self.ends[0], len(i)), np.repeat(self.depth[0], len(i)))
            mine = _belongs(np.repeat(self.rule[0], len(i)), self.backwards, asked, i, self.list, j)
            if mine.any():
                yield _pairs(words, n, i[mine], self.words, self.n, j[mine], self.backwards)


def _sent_on(entries: DataFrame) -> DataFrame:
    """Words of a beginning that goes on in later shards, for each of these that may have a word one edit away."""
    pieces = entries.groupBy("part", "head", "shard").agg(F.min("word").alias("least"), F.max("word").alias("most"))
    spread = F.count("*").over(Window.partitionBy("part", "head"))
    pieces = pieces.withColumn("pieces", spread).filter("pieces > 1")
    # the prefix that all words of the piece have: as far as its first and last word agree
    agree = F.expr("aggregate(sequence(1, length(least)), 0, (a, k) -> if(a = k - 1 and substring(least, 1, k) = substring(most, 1, k), k, a))")
    pieces = pieces.select("part", "head", F.col("shard").alias("to"), F.substring("least", F.lit(1), F.least(agree, F.lit(64))).alias("prefix"))
    pieces = landed(pieces, "pieces")
    likely = F.lit(False)
    for more in (-1, 0, 1):
        likely |= F.levenshtein("prefix", F.substring("word", F.lit(1), F.length("prefix") + more), 1) >= 0
    sent = entries.join(pieces, ["part", "head"]).filter((F.col("shard") < F.col("to")) & likely)
    return sent.select(F.col("to").alias("shard"), F.lit(True).alias("sent"), "part", "head", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: all pairs of words at exactly one edit, both ways round. words: word (different ones, code points below 256), n."""
    spark = words.sparkSession
    python_ready(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // SHARD_ENTRIES))
    entries = list_entries(words).repartitionByRange(shards, "part", "word").withColumn("shard", F.spark_partition_id())
    entries = landed(entries, "word-lists")
    own = entries.select("shard", F.lit(False).alias("sent"), "part", "head", "word", "n")
    every = own.unionByName(_sent_on(entries))
    dealt = every.repartitionById(shards, F.col("shard")).sortWithinPartitions("sent", "part", "word")
    return dealt.mapInArrow(_looked_up, "word string, other string, other_n long")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root: the last of the forms that follow each other. Each is MORE times as frequent as the one before, which bounds the chain."""
    chain = landed(forms.select("word", F.col("form").alias("root")), "forms")
    length = len(str(most))
    reach = 1
    while reach < length:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = landed(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        reach *= 2
    return chain


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Per word its form, root, n, n_near and form_n.

    docs: doc_id, text. A null text has no words; a null doc_id counts as an empty one. Rows that repeat count again. Of forms equally frequent the
    first in code-point order is taken. A table without words gives no rows; other columns are not read.
    """
    words = landed(word_counts(docs), "words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    form_n = -F.col("best.less")
    enough = form_n >= MORE * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, form_n).alias("form_n"),
    )
    found = landed(found, "word-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    roots = _roots(found.filter("form IS NOT NULL"), most)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
