"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text knows every substring of it. A text is parsed
against each: the longest stretch that the automaton knows is a phrase, then parsing goes on behind it.
Phrases times the log of the training length, per character, estimate the entropy of the text under the
language; the least wins.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.llm.runtime import python_ready

#: Bounds of the sample that is learned from: labelled rows of each language, in the order of a hash of their
#: id, and characters of each row and of a language in all.
ROWS = 200
CHARS_OF_ROW = 600
CHARS_OF_LANGUAGE = 60_000

#: Letters, the most frequent ones, that have a column in the tables; all others have entries of a sorted list.
NEAR = 126

#: Below so many texts at once a step of numpy costs more than one of Python.
FEW = 12

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Automaton:
    """The suffix automaton of a text as one table: state * width + letter gives the next state's first cell, 0 none.

    Moves by letters of width or more are in far, by the state's first cell and the letter.
    """

    def __init__(self, codes: list[int], width: int):
        after: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table, self.width = array("i", bytes(4 * width * len(after))), width
        self.far: dict[tuple[int, int], int] = {}
        for state, moves in enumerate(after):
            for c, to in moves.items():
                if c < width:
                    self.table[state * width + c] = to * width
                else:
                    self.far[state * width, c] = to * width
        self.cost = math.log2(len(codes) + 2)

    def phrases(self, codes: list[int], state: int = 0) -> int:
        """How many longest matches, one behind the other, the codes fall into, going on from a state."""
        table, far, width, count = self.table, self.far, self.width, 0
        for c in codes:
            after = table[state + c] if c < width else far.get((state, c), 0)
            if after:
                state = after
            else:
                count += state > 0
                state = table[c] if c < width else far.get((0, c), 0)
                count += state == 0  # a letter that the language doesn't have
        return count + (state > 0)


class Model:
    """Automata of all languages over one alphabet. texts: language to texts."""

    def __init__(self, texts: dict[str, list[str]], memory: int = 200_000):
        joined = {lang: f" {' '.join(w for t in found for w in words_of(t))} "[:CHARS_OF_LANGUAGE] for lang, found in sorted(texts.items())}
        often = Counter(c for t in joined.values() for c in t)
        letters = sorted(often, key=lambda c: (-often[c], c))
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: a letter that no language has
        self.kind, self.width = np.min_scalar_type(len(letters)), min(len(letters), NEAR) + 1
        self.automata = {lang: Automaton([self.code[c] for c in t], self.width) for lang, t in joined.items() if t.strip()}
        tables = [np.frombuffer(a.table, np.int32) for a in self.automata.values()]
        #: All tables behind one another; a language's root is where its own begins.
        self.roots = np.cumsum([0, *map(len, tables)])[:-1].astype(np.int32)
        self.table = np.concatenate([np.where(t > 0, t + r, np.int32(0)) for t, r in zip(tables, self.roots)] or [np.zeros(0, np.int32)])
        far = [(self._far_key(state + int(r), c), to + int(r)) for a, r in zip(self.automata.values(), self.roots) for (state, c), to in a.far.items()]
        far = np.array(sorted(far), np.int64).reshape(-1, 2)
        self.far_keys, self.far_to = far[:, 0].copy(), far[:, 1].astype(np.int32)
        self.words: dict[str, bytes] = {}
        self.memory = memory

    def _far_key(self, state, c):
        return state * (len(self.code) + 1) + c

    def _after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states by language and text, 0 none; c has a letter of each text."""
        far = np.flatnonzero(c >= self.width)
        if not len(far):
            return self.table[state + c]
        after = self.table[state + np.where(c < self.width, c, 0)]
        if len(self.far_keys):
            keys = self._far_key((state[:, far] if state.shape[1] > 1 else state).astype(np.int64), c[far].astype(np.int64))
            at = np.minimum(np.searchsorted(self.far_keys, keys), len(self.far_keys) - 1)
            after[:, far] = np.where(self.far_keys[at] == keys, self.far_to[at], 0)
        return after

    def _coded(self, text: str) -> bytes:
        return np.array([self.code.get(c, 0) for c in text], self.kind).tobytes()

    def _codes_of(self, text: str | None) -> np.ndarray:
        known, parts = self.words, []
        for word in words_of(text or ""):
            coded = known.get(word)
            if coded is None:
                coded = self._coded(f" {word}")
                if len(word) < 40:
                    if len(known) >= self.memory:
                        known.clear()
                    known[word] = coded
            parts.append(coded)
        return np.frombuffer(b"".join(parts), self.kind)

    def _phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases by text and language. All texts of a batch take a step at a time; the few longest ones end on their own."""
        by_length = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
        lengths = np.array([len(coded[i]) for i in by_length])
        flat = np.concatenate([coded[i] for i in by_length] or [np.zeros(0, self.kind)])
        begins = np.cumsum(lengths) - lengths
        state = np.repeat(self.roots[:, None], len(coded), 1)
        count = np.zeros_like(state)
        active, at, roots = len(coded), 0, self.roots[:, None]
        while True:
            while active and lengths[active - 1] <= at:
                active -= 1
            if active < FEW:
                break
            c = flat[begins[:active] + at]
            after = self._after(state[:, :active], c)
            missed = after == 0
            if missed.any():
                again = self._after(roots, c)
                count[:, :active] += missed & (state[:, :active] != roots)
                count[:, :active] += missed & (again == 0)
                after = np.where(missed, np.where(again == 0, roots, again), after)
            state[:, :active] = after
            at += 1
        out = np.empty_like(count)
        out[:, by_length] = count + (state != roots)
        for k in range(active):
            i = by_length[k]
            rest = coded[i][at:].tolist()
            for n, automaton in enumerate(self.automata.values()):
                out[n, i] = count[n, k] + automaton.phrases(rest, int(state[n, k] - self.roots[n]))
        return out.T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and how far it is ahead of the second, from 0 to 1; ties go to the smaller name."""
        coded = [self._codes_of(t) for t in texts]
        if not self.automata:
            return [(UNKNOWN, 0.0)] * len(texts)
        languages = list(self.automata)
        costs = self._phrases(coded) * np.array([a.cost for a in self.automata.values()])
        out = []
        for codes, cost in zip(coded, costs):
            if not len(codes):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(cost.argmin())
            others = np.delete(cost, best)
            out.append((languages[best], float(1 - cost[best] / others.min()) if len(others) else 1.0))
        return out


def training_texts(docs: DataFrame) -> dict[str, list[str]]:
    """A bounded sample of labelled rows that are not held out, by language."""
    labelled = docs.filter(~held_out()).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    text = F.substring("text", 1, CHARS_OF_ROW).alias("text")
    ranked = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("digest"), text)
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "digest")
    # at most ROWS rows of each language, also where a doc_id repeats
    rows = ranked.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= ROWS).select("lang", "doc_id", "text")
    found: dict[str, list[tuple]] = {}
    for row in rows.collect():
        found.setdefault(row["lang"], []).append((row["doc_id"], row["text"]))
    return {lang: [t for _, t in sorted(texts)] for lang, texts in found.items()}


def held_out():
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


_models: dict[int, Model] = {}


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per row doc_id, held_out, lang_pred, score.

    docs: doc_id, text, lang; lang is read only of rows that are not held out, to learn. A text that is null
    or has no letter is und with score 0, so is every text if no row has a label. A letter that a
    language doesn't have is a phrase of its own. Repeated rows give equal rows; other columns are not read.
    """
    python_ready(docs.sparkSession)
    texts = training_texts(docs.select("doc_id", "text", "lang"))
    key = hash(str(sorted(texts.items())))

    def predicted(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Model(texts)
        model = _models[key]
        for batch in batches:
            rows = model.predict(batch.column("text").to_pylist())
            lang, score = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", held_out().alias("held_out"), "text")
    return own.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
