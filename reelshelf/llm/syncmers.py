"""Document fingerprints from closed syncmers.

A string of k bytes is an anchor if, of the s-byte strings inside it, the first least one (by hash) is the first
or the last. That depends on nothing outside the string, so equal passages have equal anchors wherever they
stand. A fingerprint holds the anchors with the least hashes and where they lie. Two fingerprints are alike by
the share of common anchors among the least of both, counting those that lie at one distance from each other.

Anchors of 16 bytes are too rare in short texts, so texts of fewer than BOTH bytes have anchors of 6 bytes as
well. Two texts that both have them are compared by these, others by the long ones, which every text
of BOTH bytes has many of: no length is a border between texts that can't be compared.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.runtime import python_ready
from reelshelf.llm.shingles import followed, mixed, slices, text_bytes

#: Lengths (k, s) of anchors and of the strings inside them, and those that texts of fewer than BOTH bytes have, too.
SCALE, SHORT_SCALE, BOTH = (16, 8), (6, 2), 512
ANCHORS = 48
#: Bytes by which places of matching anchors may differ from the common distance.
TOLERANCE = 64

_KIND = np.dtype([("hash", ">u4"), ("at", ">u4")])
_NULL_ID = -(1 << 63)


def _anchors(data: np.ndarray, offsets: np.ndarray, scale: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all closed syncmers of all texts."""
    k, s = scale
    if len(data) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    x = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < s:
        x = followed(x[:-size], x[size:])
        size *= 2
    n = len(data) - k + 1
    inner = k - s + 1
    first, last = x[:n], x[inner - 1 : inner - 1 + n]
    least, span = x, 1
    while span < inner - 1:
        step = min(span, inner - 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # least of all but the last, and of all but the first
    closed = (first <= least[:n]) & (first <= last) | (last < least[:n])
    place = np.flatnonzero(closed)
    text = np.searchsorted(offsets, place, side="right") - 1
    inside = place + k <= offsets[text + 1]
    place, text = place[inside], text[inside]
    return text, place - offsets[text], followed(x[place] + np.uint64(k), x[place + k - s])


def _least(data: np.ndarray, offsets: np.ndarray, scale: tuple[int, int]) -> list[bytes]:
    """Of each text its ANCHORS least anchors as (hash, place) in order of hash."""
    text, place, full = _anchors(data, offsets, scale)
    order = np.lexsort((place, full, text))
    text, place, full = text[order], place[order], full[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (full[1:] != full[:-1])
    # an anchor's second time in a text is an anchor of its own, so that texts that repeat themselves keep their weight
    time = np.arange(len(text)) - np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
    short = (mixed(full + time.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((place, short, text))
    text, place, short = text[order], place[order], short[order]
    new[1:] = (text[1:] != text[:-1]) | (short[1:] != short[:-1])
    text, place, short = text[new], place[new], short[new]
    begins = np.searchsorted(text, np.arange(len(offsets)))
    out = np.zeros(len(text), _KIND)
    out["hash"], out["at"] = short, place
    return [out[a : min(b, a + ANCHORS)].tobytes() for a, b in zip(begins[:-1], begins[1:])]


def fingerprints(column: pa.Array) -> list[bytes]:
    """Of each text the number of its long anchors in a byte, these, and after them its short ones if it has fewer than BOTH bytes.

    A text without any anchor has its whole as a short one, an empty text has no fingerprint (b"").
    """
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    long_ = _least(data, offsets, SCALE)
    few = size < BOTH
    few_offsets = np.concatenate([[0], np.cumsum(size[few])])
    short = iter(_least(data[np.repeat(few, size)], few_offsets, SHORT_SCALE))
    found = []
    for i, n in enumerate(size):
        own = next(short) if few[i] else b""
        if n and n < BOTH and not own:
            own = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=4).digest() + bytes(4)
        found.append(bytes([len(long_[i]) // _KIND.itemsize]) + long_[i] + own if n else b"")
    return found


def _scales(fingerprint: bytes) -> tuple[bytes, bytes]:
    """The long and the short anchors."""
    end = 1 + fingerprint[0] * _KIND.itemsize
    return fingerprint[1:end], fingerprint[end:]


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1; 1 for equal ones, also for two empty ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (a_long, a_short), (b_long, b_short) = _scales(a), _scales(b)
    a, b = (a_short, b_short) if a_short and b_short else (a_long, b_long)
    if a == b:
        return float(bool(a))
    x, y = np.frombuffer(a, _KIND), np.frombuffer(b, _KIND)
    both, i, j = np.intersect1d(x["hash"], y["hash"], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # the least anchors of the union are known as far as the shorter list goes
    least = np.union1d(x["hash"], y["hash"])[:ANCHORS]
    away = x["at"][i].astype(np.int64) - y["at"][j]
    away = np.sort(away[both <= least[-1]])
    if not len(away):
        return 0.0
    together = np.searchsorted(away, away + TOLERANCE, side="right") - np.arange(len(away))
    return float(together.max() / len(least))


def _text(fingerprint: bytes) -> str:
    return base64.b64encode(fingerprint).decode()


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter] if quarter else text


def _place_among(column: str, bounds: list[int], low: int, high: int) -> str:
    """SQL for how many of the sorted bounds lie below the column, as a search tree."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    more, fewer = _place_among(column, bounds, middle + 1, high), _place_among(column, bounds, low, middle)
    return f"CASE WHEN {column} > {bounds[middle]}L THEN {more} ELSE {fewer} END"


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in partitions and order so that each row's next one follows it; the first of a later part is repeated as a last row with peek true.

    Parts are ranges of the id between quantiles, one to a task; only their bounds and first ids are on the driver. Rows
    of one id, however many, lie in one part: their order is that of the result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = own.select(F.percentile_approx("id", shares, 10_000)).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    own = own.withColumn("part", F.expr(_place_among("id", bounds, 0, len(bounds))))
    firsts = sorted(own.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")).collect())
    own = own.withColumn("peek", F.lit(False))
    if not firsts:
        return own
    # the part before it sees the first row of each part; the last part sees the first of all
    pairs = [(firsts[i - 1][0], *first) for i, (_, first) in enumerate(firsts)]
    seen = spark.createDataFrame(pairs, "part int, id long, tie long")
    peeks = own.drop("part", "peek").join(F.broadcast(seen), ["id", "tie"]).dropDuplicates(["part"]).select("doc_id", "id", "text", "tie", "part", F.lit(True).alias("peek"))
    return own.unionByName(peeks).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "peek", "id", "tie")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger doc_id, after the last the first; null ids come first, of rows with one id the text's digest
    decides; rows that repeat follow each other. A null text is empty. The only row of a table is its own
    next. An empty table gives no rows; other columns are not read.
    """
    python_ready(docs.sparkSession)

    def rows(batches):
        held = None  # the last row so far, waiting for its next one: (doc_id, part, text, fingerprint)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, parts, peeks = (batch.column(c).to_pylist() for c in ("doc_id", "part", "peek"))
            texts = batch.column("text").to_pylist()
            prints = fingerprints(batch.column("text"))
            ready = []
            for row in zip(ids, parts, texts, prints, peeks):
                if held is not None and held[1] == row[1]:
                    ready.append((held, row))
                held = None if row[4] else row
            if not ready:
                continue
            changed = [edited(a[2], b[2]) for a, b in ready]
            marks = fingerprints(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in ready], batch.column("doc_id").type),
                    pa.array([len(a[2]) for a, _ in ready], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([_text(a[3]) for a, _ in ready], pa.string()),
                    pa.array([_text(m) for m in marks], pa.string()),
                    pa.array([likeness(a[3], m) for (a, _), m in zip(ready, marks)], pa.float64()),
                    pa.array([likeness(a[3], b[3]) for a, b in ready], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = _in_order(docs).select("doc_id", "part", "text", "peek")
    return ordered.mapInArrow(
        rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
