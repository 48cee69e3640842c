"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list alone says how far to the right of a token's start a symbol can still change what is
merged there (`sufficient_lookahead`: 146 symbols for a list of 48,894 merges). The transducer holds a
window of that order, emits a token as soon as the scan is the lookahead past its start, and so needs
the same memory for a word of any length. Clashes of neighbours and short words are remembered in
tables of bounded size.

Decoding is a state machine over bytes: each id appends its bytes, complete characters leave at once,
an unfinished character waits for the next id, bytes that can't be text become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from reelshelf.llm.runtime import SPACES, python_ready

#: The visible stand-ins of bytes in byte-level vocabularies are these ranges themselves ...
_SELF_BYTES = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
#: ... and, for the other bytes in order, the characters from here on.
_FIRST_STAND_IN = 0x100

_END = 256  # added to a byte that ends a word
_NEVER = 1 << 60
_PIECES = regex.compile(f"[^{SPACES}]+")
_SPACE = re.compile(f"[{SPACES}]".encode())
#: Words above so many characters, and pieces above so many bytes, are taken in as a stream.
LONG = 4096


def byte_stand_ins() -> list[str]:
    own = {b for low, high in _SELF_BYTES for b in range(low, high + 1)}
    others = iter(range(_FIRST_STAND_IN, _FIRST_STAND_IN + 256))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]]) -> int:
    """How many symbols from a token's start on can decide whether it comes to be.

    merges: (left, right, result) by rank. A merge depends on its own span, and on merges of lower
    rank that could take one of its parts away to the right; those depend on still lower ranks. One
    pass in rank order follows every such chain.
    """
    width: dict[int, int] = {}
    reach: dict[int, int] = {}
    for left, right, result in merges:
        own = width.get(left, 1)
        here = max(reach.get(left, 1), own + reach.get(right, 1))
        width[result] = own + width.get(right, 1)
        reach[result] = max(reach.get(result, 0), here)
        reach[left] = max(reach.get(left, 1), here)
    return max(reach.values(), default=1)


class Vocabulary:
    """Merges over bytes, a word's last byte being a symbol of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        #: No word that is in lower case equals a special token in upper case.
        self.upper_special = {x.upper(): i for x, i in self.special.items()}
        self.split_pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.spans: dict[int, tuple[int, ...]] = {}
        for b, c in enumerate(byte_stand_ins()):
            self.spans[ids[c]] = (b,)
            self.spans[ids[c + suffix]] = (b + _END,)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the rank that joins them
        self.lookahead = 0
        steps = []
        for at, (left, right) in enumerate(model["merges"]):
            pair, result = (ids[left], ids[right]), ids[left + right]
            if result in self.parts or result in self.spans:
                raise ValueError("two merges make the same token")
            if pair[0] not in self.spans or pair[1] not in self.spans:
                raise ValueError("a merge uses a token that a later one makes")
            self.rank[pair] = at
            self.parts[result] = (*pair, at)
            self.spans[result] = self.spans[pair[0]] + self.spans[pair[1]]
            steps.append((*pair, result))
        self.lookahead = sufficient_lookahead(steps)
        #: By symbol the longer beginnings of tokens: [their own trie, the token that ends there or None].
        self.trie: dict[int, list] = {}
        sound: dict[int, bool] = {}
        for token, span in self.spans.items():  # in rank order, so parts come first
            if token in self.parts:
                left, right, at = self.parts[token]
                sound[token] = sound[left] and sound[right] and not self.clash(left, right, at)
            else:
                sound[token] = True
            if sound[token]:
                children, node = self.trie, None
                for symbol in span:
                    node = children.get(symbol)
                    if node is None:
                        node = children[symbol] = [{}, None]
                    children = node[0]
                node[1] = token
        self.width = {token: len(span) for token, span in self.spans.items()}
        self.longest = max(self.width.values())
        #: The longest token that is the beginning of another one.
        self.shorter: dict[int, int | None] = {}
        for token, span in self.spans.items():
            children, found = self.trie, None
            for symbol in span[:-1]:
                node = children.get(symbol)
                if node is None:
                    break
                children, ends = node
                if ends is not None:
                    found = ends
            self.shorter[token] = found

    def _edge(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The tokens that lie at the edge one after another, each with the rank that ends it."""
        found = [(token, until)]
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            found.append((token, until))
        return found

    def clash(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether a merge across the border of two tokens would come before those that make them (and before rank until)."""
        rank = self.rank
        heads = self._edge(right, 0, until)
        for a, a_until in self._edge(left, 1, until):
            for b, b_until in heads:
                at = rank.get((a, b))
                # of equal ranks the one further left goes first
                if at is not None and at < a_until and at <= b_until and at < until:
                    return True
        return False


def symbols_of(word: bytes) -> Iterator[int]:
    """A word's bytes one by one, the last one marked."""
    last = len(word) - 1
    for i, b in enumerate(word):
        yield b if i < last else b + _END


class Transducer:
    """Symbols in, stable tokens out.

    The scan goes on with the longest token that fits the one before, and steps back where none does:
    a segmentation without a clash is the only one, so what it has at any place is the encoding of all
    before it. A token that starts the lookahead or more before that place is stable and leaves.
    """

    def __init__(self, vocabulary: Vocabulary, memory: int = 1 << 20):
        self.v = vocabulary
        self.memory = memory
        self.clashes: dict[int, bool] = {}

    def _clash(self, left: int, right: int) -> bool:
        """As the vocabulary's clash, remembered for a bounded number of pairs."""
        key = left << 20 | right
        known = self.clashes.get(key)
        if known is None:
            if len(self.clashes) >= self.memory:
                self.clashes.clear()
            known = self.clashes[key] = self.v.clash(left, right)
        return known

    def stream(self, symbols: Iterable[int]) -> Iterator[list[int]]:
        """Tokens of one word as they become stable; holds twice the lookahead and a token's length of symbols at most."""
        v, source = self.v, iter(symbols)
        trie, width, shorter = v.trie, v.width, v.shorter
        step = v.lookahead + v.longest
        window = list(islice(source, 2 * step))
        ended = len(window) < 2 * step
        last, pos = -1, 0
        tokens: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        while True:
            if not ended and pos + v.longest > len(window):
                stable = 0
                while stable < len(starts) and starts[stable] + v.lookahead <= pos:
                    stable += 1
                if stable:
                    yield tokens[:stable]
                    last = tokens[stable - 1]
                    gone = starts[stable] if stable < len(starts) else pos
                    del tokens[:stable], window[:gone]
                    starts = [x - gone for x in starts[stable:]]
                    dead = {x - gone for x in dead if x >= gone}
                    pos -= gone
                more = list(islice(source, step))
                ended = len(more) < step
                window += more
            n = len(window)
            if pos == n:
                if tokens:
                    yield tokens
                return
            children, token = trie, None
            for symbol in window[pos : pos + v.longest]:
                node = children.get(symbol)
                if node is None:
                    break
                children, ends = node
                if ends is not None:
                    token = ends
            before = tokens[-1] if tokens else last
            while True:
                if token is None:
                    dead.add(pos)
                    token, pos = tokens.pop(), starts.pop()
                    before = tokens[-1] if tokens else last
                elif pos + width[token] not in dead and (before < 0 or not self._clash(before, token)):
                    break
                token = shorter[token]
            tokens.append(token)
            starts.append(pos)
            pos += width[token]

    def word(self, word: bytes) -> list[int]:
        """The tokens of one word, as a whole."""
        v = self.v
        n = len(word)
        if n > v.lookahead + v.longest:
            return [t for part in self.stream(symbols_of(word)) for t in part]
        # a word within the window: the same scan, nothing leaves before the end
        trie, width, clashes = v.trie, v.width, self.clashes
        symbols = list(word)
        symbols[-1] += _END
        tokens: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        pos, before = 0, -1
        while pos < n:
            children, token = trie, None
            for symbol in symbols[pos:]:
                node = children.get(symbol)
                if node is None:
                    break
                children, ends = node
                if ends is not None:
                    token = ends
            while True:
                if token is None:
                    dead.add(pos)
                    token, pos = tokens.pop(), starts.pop()
                    before = tokens[-1] if tokens else -1
                elif pos + width[token] not in dead:
                    if before < 0:
                        break
                    known = clashes.get(before << 20 | token)
                    if known is None:
                        known = self._clash(before, token)
                    if not known:
                        break
                token = v.shorter[token]
            tokens.append(token)
            starts.append(pos)
            pos += width[token]
            before = token
        return tokens


class Decoder:
    """Ids in, text out; keeps at most one unfinished character.

    plain: text, the word-end mark being a space. Otherwise, as a vocabulary without a decoder is read
    back: the tokens' own spellings with a space between.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        v = vocabulary
        self.between = b"" if plain else b" "
        if plain:
            self.bytes = {t: bytes(s % _END for s in span) + b" " * (span[-1] >= _END) for t, span in v.spans.items()}
            self.bytes |= {i: text.encode() for text, i in v.special.items()}
        else:
            self.bytes = {i: text.encode() for i, text in v.texts.items()}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

        self.reset()

    def reset(self) -> None:
        self.started = False
        self.machine.reset()

    def waits(self) -> bool:
        """Whether a character is unfinished."""
        return bool(self.machine.buffer)

    def feed(self, ids: Iterable[int]) -> str:
        new = self.between.join([self.bytes[i] for i in ids])
        if new:
            new = self.between + new if self.started else new
            self.started = True
        return self.machine.decode(new)

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


class Encoder:
    """Whole texts to ids: pieces between white space, special tokens, normal form, lower case, words, transducer."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.transducer = Transducer(vocabulary)

    def words(self, piece: str) -> Iterator[str]:
        """The words and special tokens of a piece without ASCII white space; a word is in lower case, a special token isn't."""
        if "<|" in piece and self.v.special_pattern.search(piece):
            at = 0
            for found in self.v.special_pattern.finditer(piece):
                yield from self._ordinary(piece[at : found.start()])
                yield found[0].upper()
                at = found.end()
            yield from self._ordinary(piece[at:])
        else:
            yield from self._ordinary(piece)

    def _ordinary(self, piece: str) -> Iterable[str]:
        if not piece.isascii():
            # letter by letter: the end of a word changes nothing, unlike in str.lower()
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if piece.isalpha():
            return (piece,)
        if len(piece) <= LONG:
            return self.v.split_pattern.findall(piece)
        return (found[0] for found in self.v.split_pattern.finditer(piece))

    def ids(self, word: str) -> list[int]:
        """The ids of what words() gives."""
        special = self.v.upper_special.get(word)
        return self.transducer.word(word.encode()) if special is None else [special]

    def stable(self, word: str) -> Iterator[list[int]]:
        """The same ids in parts, as they become stable: for long words, in constant memory beside the word."""
        return self.transducer.stream(symbols_of(word.encode()))

    def encode(self, text: str | None) -> Iterator[int]:
        for found in _PIECES.finditer(text or ""):
            for word in self.words(found[0]):
                if len(word) <= LONG:
                    yield from self.ids(word)
                else:
                    for part in self.stable(word):
                        yield from part


#: Some ids in decimal form and what they decode to, both joined by spaces; two empty ones for no ids.
_Made = tuple[bytes, bytes]


class Memory(dict):
    """What was made of a key, for the latest keys: two generations of so many entries; of keys longer than longest nothing is kept."""

    def __init__(self, make: Callable[[Any], _Made], size: int, longest: int):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def known(self, key) -> _Made | None:
        return self.get(key) or self.older.get(key)

    def __missing__(self, key) -> _Made:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Digests:
    """Per text the number of ids and the digests of ids and of what they decode to; words and pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary, size: int = 150_000, longest: int = 48):
        self.encoder = Encoder(vocabulary)
        self.decoder = Decoder(vocabulary)
        self.decimal = {i: str(i).encode() for i in self.decoder.bytes}
        self.words = Memory(self._word, size, longest)
        self.pieces = Memory(self._piece, size, longest)

    def _made(self, ids: list[int]) -> _Made:
        decimal, decoder = self.decimal, self.decoder
        decoder.started = False
        text = decoder.feed(ids)
        if decoder.waits():
            text += decoder.end()
        return b" ".join([decimal[i] for i in ids]), text.encode()

    def _word(self, word: str) -> _Made:
        """A word of its own that stands in a text as it is, is among the pieces."""
        return self.pieces.known(word.encode()) or self._made(self.encoder.ids(word))

    def _piece(self, piece: bytes) -> _Made:
        text = piece.decode()
        words = [*self.encoder.words(text)]
        if len(words) == 1:
            return self._made(self.encoder.ids(text)) if words[0] == text else self.words[words[0]]
        made = [x for x in map(self.words.__getitem__, words) if x[0]]
        return b" ".join([x[0] for x in made]), b" ".join([x[1] for x in made])

    def _long_piece(self, piece: bytes) -> Iterator[_Made]:
        """Its words, and of a long one its stable parts, one after another."""
        for word in self.encoder.words(piece.decode()):
            if len(word) <= LONG:
                yield self.words[word]
            else:
                for part in self.encoder.stable(word):
                    yield self._made(part)

    def _parts(self, text: bytes, block: int) -> Iterator[list[_Made]]:
        """What is made of the text's pieces, so many bytes at a time. White space of the word rule is what bytes.split() cuts at."""
        remembered = self.pieces.__getitem__
        at = 0
        while at < len(text):
            end = len(text)
            if at + block < end:
                space = _SPACE.search(text, at + block)
                end = space.start() if space else end
            pieces = text[at:end].split()
            at = end
            if max(map(len, pieces), default=0) <= LONG:
                yield list(map(remembered, pieces))
            else:
                for piece in pieces:
                    if len(piece) <= LONG:
                        yield [remembered(piece)]
                    else:
                        for made in self._long_piece(piece):
                            yield [made]

    def of(self, text: bytes | str | None, block: int = 1 << 18) -> tuple[int, str, str]:
        """block: so many bytes are cut into words at once, whatever the text's length."""
        text = (text or b"") if not isinstance(text, str) else text.encode()
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for made in self._parts(text, block):
            if not made:
                continue
            ids, texts = zip(*made)
            if b"" in ids:
                ids, texts = (list(filter(None, x)) for x in (ids, texts))
                if not ids:
                    continue
            if n:
                ids_sha.update(b" ")
                text_sha.update(b" ")
            ids = b" ".join(ids)
            n += ids.count(b" ") + 1
            ids_sha.update(ids)
            text_sha.update(b" ".join(texts))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


_loaded: dict[str, Vocabulary] = {}
_digests: dict[str, Digests] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def digests_of(path: str) -> Digests:
    """One per process: later tasks find what earlier ones have remembered. Its memories have a bound."""
    if path not in _digests:
        _digests[path] = Digests(vocabulary(path))
    return _digests[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids array<int>; a null or empty text has no ids. Other columns stay, one called ids is replaced."""
    python_ready(docs.sparkSession)
    names = [c for c in docs.columns if c != ids]

    def encoded(batches):
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            made = pa.array([list(encoder.encode(t)) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, ids])

    docs = docs.select(*(f"`{c}`" for c in names))
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])
    return docs.mapInArrow(encoded, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the column text decoded from ids (null: empty) as plain text; a text column there before is replaced."""
    python_ready(docs.sparkSession)
    names = [c for c in docs.columns if c != text]

    def decoded(batches):
        decoder = Decoder(vocabulary(path), plain=True)
        for batch in batches:
            made = []
            for row in batch.column(ids).to_pylist():
                decoder.reset()
                made.append(decoder.feed(row or ()) + decoder.end())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.string())], names=[*names, text])

    docs = docs.select(*(f"`{c}`" for c in names))
    schema = StructType([*docs.schema.fields, StructField(text, StringType())])
    return docs.mapInArrow(decoded, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of the empty string. Repeated rows give
    repeated results, a null doc_id stays null, an empty table gives no rows, other columns are not read.
    """
    python_ready(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digested(batches):
        digests = digests_of(path)
        for batch in batches:
            rows = [digests.of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
