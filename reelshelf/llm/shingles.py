"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5

#: Odd multipliers from the square roots of 5, 7 and 11.
_A, _B, _C = (np.uint64(x | 1) for x in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence a and its next member b."""
    return mixed(a * _C + b)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) in one array, and where each begins and the last ends."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about so many bytes together (a longer text is a part of its own)."""
    sizes = np.diff(text_bytes(batch.column("text"))[1])
    begin, room = 0, most
    for i, size in enumerate(sizes):
        if size > room and i > begin:
            yield batch.slice(begin, i - begin)
            begin, room = i, most
        room -= size
    yield batch.slice(begin)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts in order, and how many each text has.

    A word's hash is the sum of a number for each of its bytes and its place in the word.
    """
    n = len(data)
    count = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), count
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]  # a text's first word does not go on from the text before
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), count
    at = np.flatnonzero(inside)
    word = np.cumsum(begins)[at] - 1
    place = at - start[word]
    value = mixed((place.astype(np.uint64) << np.uint64(8) | _LOWER[data[at]]) + _C)
    first = np.searchsorted(at, start)
    hashes = mixed(np.add.reduceat(value, first))
    count = np.diff(np.searchsorted(start, offsets))
    return hashes, count


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin and the last end.

    A text with fewer than WORDS words has its whole sequence as one; without words it has none.
    """
    data, offsets = text_bytes(column)
    words, count = word_hashes(data, offsets)
    begin = np.concatenate([[0], np.cumsum(count)])
    number = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), number)
    at = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    size = np.minimum(count[text], WORDS)
    shingle = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        shingle = np.where(size > k, followed(shingle, padded[at + k]), shingle)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[new], text[new]
    return shingle, np.searchsorted(text, np.arange(len(count) + 1))
