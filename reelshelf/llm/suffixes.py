"""Suffix-array dedup: the byte windows of a threshold length that occur twice, found by radix passes.

Two suffixes are alike through the threshold exactly when their windows are equal, so only windows are
sorted, most significant digit first, and a window that is alone in its group leaves the sort. The digits:

1. the window's anchor, the 32-byte string with the least hash in it. Neighbouring windows share it, so a
   row stands for a whole run of windows (about 35 bytes of text), not for one suffix;
2. for runs whose anchor occurs in different surroundings: the 93 bytes common to 8 neighbouring windows;
3. for such blocks that still differ: the remaining bytes on both sides, window by window.

Digits are hashes of their bytes, which aren't compared again: equal are runs and blocks whose two hashes of 64 bits
agree, and windows of digit 3 whose 93 common bytes agree in one such hash and the others in two.

After each digit, equal groups are settled (all but the first place are repeats), lone groups are dropped,
and only groups with the digit in common but not the rest go on. Before every shuffle a task puts equal
entries of its chunk together, so a group that holds a third of all rows arrives as one or two rows a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.llm.runtime import landed, python_ready

WIDTH = 100  # threshold in bytes
ANCHOR = 32
BLOCK = 8  # windows in a block
CORE = WIDTH - BLOCK + 1
CHUNK = 4 << 20  # bytes of text that a task looks at together

_ALONE, _REPEAT, _SPLIT, _WITNESS = 0, 1, 2, 3
#: Multipliers of the hash: odd numbers from the golden ratio and the square roots of 2 and 3.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B))
_ID = "__id"
_ITEM = f"slot long, key long, full long, {_ID} long, __th long, at long, kind byte"
_EDGES = "left_edge long, right_edge long"


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring strings from their hashes."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """For each place the hash of the ANCHOR bytes from there."""
    x = (data.astype(np.uint64) + np.uint64(1)) * _C
    size = 1
    while size < ANCHOR:
        x = _joined(x[:-size], x[size:])
        size *= 2
    return x


def _span_hash(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of data[start:start+length], lengths from 64 to 192, from anchor hashes: three overlapping spans of 64."""
    wide = lambda at: _joined(h[at], h[at + ANCHOR])
    last = start + length - 64
    return _joined(_joined(wide(start), wide((start + last) // 2)), _joined(wide(last), length.astype(np.uint64)))


def _least_places(h: np.ndarray) -> np.ndarray:
    """For each window its anchor's place: the leftmost least hash (upper 33 bits) among its anchors."""
    best = (h & ~np.uint64((1 << 31) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, wanted = 1, WIDTH - ANCHOR + 1
    while span < wanted:
        step = min(span, wanted - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & np.uint64((1 << 31) - 1)).astype(np.int64)


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (first window, anchor, number, anchor hashes). ends: of the documents in data."""
    h = _anchor_hashes(data)
    n = len(data) - WIDTH + 1
    anchor = _least_places(h)[:n]
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int8)  # windows that lie in one document
    good = ends - starts >= WIDTH
    inside[starts[good]] += 1
    np.subtract.at(inside, ends[good] - WIDTH + 1, 1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, h
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]])
    first = at[new]
    number = np.diff(np.append(np.flatnonzero(new), len(at)))
    return first, anchor[first], number, h


def _presorted(key, full, doc, th, at) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of a chunk go on, and as what; all are arrays of integers, compared within the chunk."""
    order = np.lexsort((at, th, doc, full, key))
    k, f = key[order], full[order]
    place = (doc[order], th[order], at[order])
    n = len(order)
    if not n:
        return order, np.zeros(0, np.int8)
    differs = lambda x: np.append(True, x[1:] != x[:-1])
    new_key = differs(k)
    new_full = new_key | differs(f)
    new_place = new_full | differs(place[0]) | differs(place[1]) | differs(place[2])
    # the same place again (a repeated row) is of the same kind as its first time
    first_of_full = np.maximum.accumulate(np.where(new_full, np.arange(n), 0))
    same_as_first = (place[0] == place[0][first_of_full]) & (place[1] == place[1][first_of_full]) & (place[2] == place[2][first_of_full])
    group = np.cumsum(new_key) - 1
    fulls = np.bincount(group, weights=new_full).astype(np.int64)
    kind = np.where(new_full, np.where(fulls[group] > 1, _SPLIT, _ALONE), _REPEAT).astype(np.int8)
    keep = new_place & ~(same_as_first & ~new_full)
    # of a key with several surroundings, the first and last are shown to other chunks
    lead = new_key & (fulls[group] > 1)
    ends = np.append(np.flatnonzero(new_key)[1:], n) - 1
    tail = np.maximum.accumulate(np.where(new_full, np.arange(n), 0))[ends[fulls > 1]]
    shown = np.concatenate([np.flatnonzero(lead), tail])
    kept = np.flatnonzero(keep)
    return np.concatenate([order[kept], order[shown]]), np.concatenate([kind[kept], np.full(len(shown), _WITNESS, np.int8)])


def _items(key, full, doc, th, at, *more) -> pa.RecordBatch:
    """The rows that leave a chunk. slot: what they are dealt out by, the key only where it is needed."""
    chosen, kind = _presorted(key, full, doc, th, at)
    key, full, doc, th, at = (x[chosen].astype(np.int64, copy=False) for x in (key, full, doc, th, at))
    spread = _joined(_joined(doc.view(np.uint64), th.view(np.uint64)), at.view(np.uint64)).view(np.int64)
    slot = np.where((kind == _ALONE) | (kind == _WITNESS), key, spread)
    columns = [slot, key, full, doc, th, at, kind, *(x[chosen] for x in more)]
    names = ["slot", "key", "full", _ID, "__th", "at", "kind", *["left_edge", "right_edge"][: len(more)]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins and the last ends."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, rows, places): parts of texts that together have about CHUNK bytes, whose row each is of and where it begins there.

    A longer text is cut; parts overlap by a window less a byte, so each window lies in exactly one.
    """
    data, offsets = _text_bytes(batch.column("text"))
    lengths = np.diff(offsets)
    row, begin = 0, 0
    while row < len(lengths):
        parts, rows, places, room = [], [], [], CHUNK
        while row < len(lengths) and room > 0:
            left = lengths[row] - begin
            take = min(left, room + WIDTH - 1)
            if take >= WIDTH:
                parts.append(data[offsets[row] + begin : offsets[row] + begin + take])
                rows.append(row)
                places.append(begin)
            room -= take
            if take == left:
                row, begin = row + 1, 0
            else:
                begin += take - WIDTH + 1
        if parts:
            yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(places)


def _first_pass(batches):
    """Digit 1. at: first window << 16 | anchor's distance from it << 8 | number of windows."""
    for batch in batches:
        ids = batch.column(_ID).to_numpy(zero_copy_only=False)
        th = batch.column("__th").to_numpy(zero_copy_only=False)
        for data, ends, rows, places in _chunks(batch):
            first, anchor, number, h = _runs(data, ends)
            if not len(first):
                continue
            part = np.searchsorted(ends, first, side="right")
            place = first - np.concatenate([[0], ends[:-1]])[part] + places[part]
            full = _joined(_span_hash(h, first, number + WIDTH - 1), ((anchor - first) << 8 | number).astype(np.uint64))
            at = place << 16 | (anchor - first) << 8 | number
            yield _items(h[anchor].view(np.int64), full.view(np.int64), ids[rows[part]], th[rows[part]], at)


def _edge(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """BLOCK - 1 bytes from start as a number, the first byte lowest; 0 beyond the data."""
    out = np.zeros(len(start), np.int64)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    for i in range(BLOCK - 1):
        out |= padded[np.minimum(start + i, len(data))].astype(np.int64) << (8 * i)
    return out


def _second_pass(batches):
    """Digit 2, from texts with the runs that need it. at: first window << 16 | its place in the block << 8 | number of windows."""
    for batch in batches:
        ids = batch.column(_ID).to_numpy(zero_copy_only=False)
        th = batch.column("__th").to_numpy(zero_copy_only=False)
        data, offsets = _text_bytes(batch.column("text"))
        found = []
        size = 0

        def flushed():
            key, full, row, at, left, right = (np.concatenate(x) for x in zip(*found))
            return _items(key, full, ids[row], th[row], at, left, right)

        for row, runs in enumerate(batch.column("__runs")):
            packed = np.unique(runs.values.to_numpy(zero_copy_only=False))
            for piece in np.array_split(packed, max(1, len(packed) >> 14)):
                own = data[offsets[row] : offsets[row + 1]]
                first, away, number = piece >> 16, piece >> 8 & 255, piece & 255
                base = int(first[0])
                own = own[base : int(first[-1]) + 2 * WIDTH + 2 * ANCHOR]
                first = first - base
                anchor = first + away
                low, high = (first - anchor) // BLOCK, (first + number - 1 - anchor) // BLOCK
                count = high - low + 1
                of = np.repeat(np.arange(len(first)), count)
                block = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                begin = anchor[of] + block * BLOCK  # of the whole block, which can begin before the run
                start = np.maximum(begin, first[of])
                stop = np.minimum(begin + BLOCK, first[of] + number[of])
                h = _anchor_hashes(own)
                core = begin + BLOCK - 1
                key = _joined(_span_hash(h, core, np.full(len(of), CORE)), (block + 64).astype(np.uint64)).view(np.int64)
                full = _joined(_span_hash(h, start, stop - start + WIDTH - 1), ((start - begin) << 8 | (stop - start)).astype(np.uint64)).view(np.int64)
                at = (start + base) << 16 | (start - begin) << 8 | (stop - start)
                left = _edge(own, np.maximum(begin, 0))
                short = np.maximum(-begin, 0)  # bytes of the left edge that lie before this piece and in no window of the run
                left = np.where(short < 8, left << (8 * np.minimum(short, 7)), 0) & ((1 << 56) - 1)
                found.append((key, full, np.full(len(of), row), at, left, _edge(own, begin + WIDTH)))
                size += len(of)
            if size > CHUNK // 32:
                yield flushed()
                found, size = [], 0
        if size:
            yield flushed()


def _third_pass(batches):
    """Digit 3, from blocks: a row for each window, told apart by the bytes beside the core."""
    for batch in batches:
        key, left, right, at, ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "left_edge", "right_edge", "at", _ID, "__th"))
        number = at & 255
        of = np.repeat(np.arange(len(at)), number)
        step = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        place = (at[of] >> 8 & 255) + step
        own_left = left[of] >> (8 * place)  # the bytes from the window's begin to the core
        own_right = right[of] & ((np.int64(1) << (8 * place)) - 1)
        sides = _joined(own_left.astype(np.uint64) * _C, own_right.astype(np.uint64) * _A)
        core = key[of].view(np.uint64)
        window = _joined(core, _joined(sides, place.astype(np.uint64))).view(np.int64)
        again = _joined(_joined(own_right.astype(np.uint64) * _B, own_left.astype(np.uint64) * _C), _joined(place.astype(np.uint64), core)).view(np.int64)
        yield _items(window, again, ids[of], th[of], ((at[of] >> 16) + step) << 16 | 1)


def _settled(items: DataFrame) -> DataFrame:
    """items that are repeats, or that must go on to the next digit (kind)."""
    # edges follow from the place; as part of the order they keep the shuffle the same for all that read it
    edges = [c for c in items.columns if c.endswith("_edge")]
    places = Window.partitionBy("slot", "full").orderBy(_ID, "__th", "at", *edges)
    around = Window.partitionBy("slot")
    ranked = items.repartition("slot").withColumn("__rank", F.rank().over(places))
    ranked = ranked.withColumn("__many", F.min("full").over(around) < F.max("full").over(around))
    found = F.when(F.col("kind") != _ALONE, F.col("kind")).when(F.col("__rank") > 1, F.lit(_REPEAT)).when(F.col("__many"), F.lit(_SPLIT))
    return ranked.withColumn("kind", found.cast("byte")).filter(F.col("kind").isin(_REPEAT, _SPLIT)).drop("__rank", "__many", "slot")


def _named(docs: DataFrame) -> DataFrame:
    """docs with __id (a null doc_id is the smallest) and __th, which tells apart different texts under one doc_id."""
    digest = F.xxhash64(F.col("text").isNull(), "text")
    twice = docs.select("doc_id", digest.alias("d")).groupBy("doc_id").agg((F.min("d") < F.max("d")).alias("many")).filter("many")
    th = digest if twice.limit(1).count() else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(_ID), th.alias("__th"), *(F.col(f"`{c}`") for c in docs.columns))


def repeated_runs(texts: DataFrame) -> DataFrame:
    """__id, __th and __runs (packed: first window << 16 | number of windows) of windows that also start earlier. texts: __id, __th, text, and more."""
    item = _ITEM
    first = landed(_settled(texts.select(_ID, "__th", "text").mapInArrow(_first_pass, item)).select("key", "full", _ID, "__th", "at", "kind"), "suffix-digit-1")
    open_runs = first.filter(F.col("kind") == _SPLIT).groupBy(_ID, "__th").agg(F.collect_list("at").alias("__runs"))
    # all columns stay, so that this join and the one with the result share one shuffle of the texts
    again = texts.join(open_runs, [_ID, "__th"]).mapInArrow(_second_pass, f"{item}, {_EDGES}")
    second = _settled(again)
    third = _settled(second.filter(F.col("kind") == _SPLIT).drop("kind", "full").mapInArrow(_third_pass, item))
    repeats = [x.filter(F.col("kind") == _REPEAT).select(_ID, "__th", "at") for x in (first, second, third)]
    return repeats[0].union(repeats[1]).union(repeats[2]).groupBy(_ID, "__th").agg(F.collect_list("at").alias("__runs"))


def _removed_spans(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal byte spans under the windows."""
    packed = np.sort(runs)
    begin, end = packed >> 16, (packed >> 16) + (packed & 255) - 1 + WIDTH
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:], len(begin)) - 1]


def _kept(data: np.ndarray, runs) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the spans."""
    if runs is None or not len(runs):
        return data.tobytes(), 0, 0
    begin, end = _removed_spans(runs.to_numpy(zero_copy_only=False))
    edges = np.concatenate([[0], np.stack([begin, end], 1).ravel(), [len(data)]]).reshape(-1, 2)
    return b"".join(data[a:b].tobytes() for a, b in edges), int((end - begin).sum()), len(begin)


def _with_runs(docs: DataFrame) -> DataFrame:
    python_ready(docs.sparkSession)
    named = _named(docs)
    return named.join(repeated_runs(named), [_ID, "__th"], "left")


def suffix_digests(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the text without bytes under windows that start earlier, too.

    A null text is empty, a text shorter than a window stays whole. Earlier: smaller doc_id (null first),
    then the smaller digest of the text where a doc_id has several texts, then the earlier start; rows that
    repeat as a whole are one document and get equal rows. An empty table gives no rows; other columns are
    not read.
    """

    def digests(batches):
        for batch in batches:
            data, offsets = _text_bytes(batch.column("text"))
            runs = batch.column("__runs")
            rows = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                kept, removed, spans = _kept(own, runs[i].values)
                rows.append((len(own), removed, spans, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = _with_runs(docs.select("doc_id", "text"))
    return whole.mapInArrow(digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars (if there) counted anew; a character that is cut through goes as a whole."""
    names = docs.columns

    def cut(batches):
        for batch in batches:
            data, offsets = _text_bytes(batch.column("text"))
            runs = batch.column("__runs")
            texts = [
                None if not valid else _kept(data[offsets[i] : offsets[i + 1]], runs[i].values)[0].decode("utf-8", "ignore")
                for i, valid in enumerate(batch.column("text").is_valid().to_pylist())
            ]
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                made["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return _with_runs(docs).mapInArrow(cut, docs.schema)
