"""BPE encoding and decoding: longest token matches checked against a pair-compatibility table.

A token sequence is the one that the merges give exactly when each neighbouring pair is
compatible, that is, when merging the two texts would leave their border untouched. So a
word is encoded from left to right: take the longest token that an Aho-Corasick trie
finds at the position, fall back to its longest prefix that is a token while it does not
fit its predecessor, and step back when none does. Positions from which no way leads on
are marked, so that each is given up once and the work stays linear in the text.

Decoding looks token texts up in one byte string through an offset table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.llm.common import as_bytes, as_text, map_texts, worker_value

END_OF_WORD = "</w>"
#: Word endings are other symbols than the same bytes inside a word.
ENDING = 0xF0000
#: Bytes of the entries that a memory of words takes up in a worker, at most, about.
CACHED_BYTES = 36 << 20
CACHED_PAIRS = 100_000
CACHED_CHARS = 64
#: White space as the regular expressions of the tokenizer files see it; str.split() also splits at U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
INFORMATION_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizer file with word ends (a byte-level BPE in JSON), as plain values.

    The file is read on the driver and has a fixed size. Raises ValueError when it describes
    other steps than this module takes.
    """
    text = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = text["model"], text["pre_tokenizer"]["pretokenizers"][0]
    steps = [x["type"] for x in text["normalizer"]["normalizers"]]
    if steps != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != END_OF_WORD or text["decoder"]:
        raise ValueError(f"{path} is not a lower-case byte-level BPE with word ends")
    special = {x["content"]: x["id"] for x in text["added_tokens"]}
    return {"vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]], "pattern": split["pattern"]["Regex"], "special": special}


def _symbols(token: str) -> str:
    """A token over the symbol alphabet, in which the last byte of a word is a symbol of its own."""
    if token.endswith(END_OF_WORD):
        body = token[: -len(END_OF_WORD)]
        return body[:-1] + chr(ENDING + ord(body[-1]))
    return token


class Recent:
    """Results for the latest keys, and those before them until as many new ones have come; ``size`` bytes together."""

    #: Bytes of an entry besides its characters and ids: the slot in the dictionary, the key and the tuple.
    ENTRY_BYTES = 230

    def __init__(self, make: Callable, size: int = CACHED_BYTES):
        self.make, self.half = make, size // 2
        self.new: dict = {}
        self.old: dict = {}
        self.held = 0

    def forget(self) -> None:
        self.new, self.old, self.held = {}, {}, 0

    def missing(self, key):
        """The value of a key that is not among the latest."""
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= self.half:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = value
        self.held += self.ENTRY_BYTES + len(key) + 8 * len(value)
        return value


class Decoder:
    """Token texts in one byte string, with their offsets and sizes."""

    def __init__(self, vocabulary: dict):
        tokens = {**vocabulary["vocab"], **vocabulary["special"]}
        texts = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            texts[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(x) for x in texts], np.int32)
        self.offsets = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts, one space between them; an id outside the vocabulary has no text."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends) or not ends[-1]:
            return b""
        places = np.arange(ends[-1])
        places += np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[places].tobytes()[:-1]


class Encoder:
    """Encoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        vocab, special = vocabulary["vocab"], vocabulary["special"]
        self.split = regex.compile(vocabulary["pattern"]).findall
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        size = max(vocab.values()) + 1
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in vocabulary["merges"]:
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            self.parts[whole] = pair
        self.compatible: dict[int, bool] = {}
        symbols = {_symbols(token): i for token, i in vocab.items()}
        # A token that earlier merges would cut in another way never occurs in an encoding.
        self.usable = {s: i for s, i in symbols.items() if self.parts[i][0] == i or self.fits(*self.parts[i], below=i)}
        self.length, self.shorter = [0] * size, [-1] * size
        self.trie = ahocorasick.Automaton()
        for s, i in self.usable.items():
            self.trie.add_word(s, i)
            self.length[i] = len(s)
            self.shorter[i] = next((self.usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.usable), -1)
        self.trie.make_automaton()
        self.inside = byte_alphabet()
        self.words = Recent(self._encode_word)
        self.chunks = Recent(self._encode_chunk)

    def fits(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge joins the two tokens' texts across their border; with ``below``, no merge before that one.

        The merges that make the tokens are undone from the last one on, down to the pair of
        symbols at the border. A pair at the border merges if its merge comes before the
        one that took one of its sides away.
        """
        key = left << 20 | right
        if below is None and (known := self.compatible.get(key)) is not None:
            return known
        bound = 1 << 60 if below is None else below
        good = True
        while True:
            if self.merged.get((left, right), bound) < bound:
                good = False
                break
            inner_left, inner_right = self.parts[left][1], self.parts[right][0]
            # Undo the later of the two; on the right side an equal merge would still have come first.
            if inner_left != left and (left > right or inner_right == right):
                bound, left = left, inner_left
            elif inner_right != right:
                bound, right = right + 1, inner_right
            else:
                break
        if below is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            self.compatible[key] = good
        return good

    def encode_symbols(self, symbols: str) -> list[int]:
        """Tokens of one word over the symbol alphabet."""
        known, fits, length, size = self.compatible.get, self.fits, self.length, len(symbols)
        tokens: list[int] = []
        dead = bytearray(size + 1)
        at, last, token = 0, -1, -1
        while True:
            # The longest token after the longest token, as far as each fits the one before.
            for _, token in self.trie.iter_long(symbols, at):
                end = at + length[token]
                if dead[end] or last >= 0 and not (known(last << 20 | token) or fits(last, token)):
                    break
                tokens.append(token)
                at, last = end, token
            if at == size:
                return tokens
            # Shorter tokens there, or else another token before.
            while True:
                token = self.shorter[token]
                while token < 0:
                    dead[at] = 1
                    token = tokens.pop()
                    at -= length[token]
                    last = tokens[-1] if tokens else -1
                    token = self.shorter[token]
                end = at + length[token]
                if not dead[end] and (last < 0 or known(last << 20 | token) or fits(last, token)):
                    break
            tokens.append(token)
            at, last = end, token

    def _encode_word(self, word: str) -> tuple[int, ...]:
        inside = self.inside
        plain = word.isascii() and word.isprintable()
        symbols = word if plain else "".join([inside[b] for b in word.encode("utf-8")])
        return tuple(self.encode_symbols(symbols[:-1] + chr(ENDING + ord(symbols[-1]))))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a text without white space."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            # Each character by itself: the small letter of a sigma does not depend on its place.
            text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        if len(text) > CACHED_CHARS:
            return tuple(chain.from_iterable(map(self._encode_word, self.split(text))))
        known, missing = self.words.new.get, self.words.missing
        if text.isascii() and text.isalpha():
            return known(text) or missing(text)
        return tuple([i for w in self.split(text) for i in (known(w) or missing(w))])

    def _encode_plain(self, text: str) -> list[int]:
        chunks = filter(None, SPACE.split(text)) if INFORMATION_SEPARATORS.search(text) else text.split()
        known, missing = self.chunks.new.get, self.chunks.missing
        ids: list[int] = []
        for c in chunks:
            found = known(c)
            if found is None:
                found = missing(c) if len(c) <= CACHED_CHARS else self._encode_chunk(c)
                known = self.chunks.new.get
            ids += found
        return ids

    def forget(self) -> None:
        """Drop what was kept of earlier words."""
        self.words.forget()
        self.chunks.forget()
        self.compatible.clear()

    def encode(self, text: str) -> list[int]:
        if self.special_split is None or "<|" not in text:
            return self._encode_plain(text)
        ids: list[int] = []
        for part in self.special_split(text):
            ids += [self.special[part]] if part in self.special else self._encode_plain(part)
        return ids


def _id_lists(encoder: Encoder, column: pa.Array) -> pa.ListArray:
    """The ids of each text of a column."""
    found = [encoder.encode(as_text(t)) for t in as_bytes(column)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(found), np.int32, offsets[-1])))


def _texts_of(decoder: Decoder, lists: pa.ListArray) -> pa.Array:
    """The text of each list of ids; null of a null."""
    texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode_texts(df: DataFrame, vocabulary: dict, text: str = "text", into: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and the token ids of each whole text, as an array named ``into``.

    Null and empty texts, and texts of white space, have no ids. Row-local: repeated rows
    stay, and an empty table gives an empty table. A column of the name ``into`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        return [_id_lists(worker_value(shared, Encoder), columns[0])]

    def ended() -> None:
        worker_value(shared, Encoder).forget()

    return map_texts(df, df.columns if keep is None else keep, [F.col(f"`{text}`").cast("string")], f"`{into}` array<int>", work, ended=ended)


def decode_ids(df: DataFrame, vocabulary: dict, ids: str = "ids", into: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and the decoded text as ``into``; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        return [_texts_of(worker_value(shared, Decoder), columns[0])]

    return map_texts(df, df.columns if keep is None else keep, [F.col(f"`{ids}`").cast("array<int>")], f"`{into}` string", work, sized=False)


def round_trip(df: DataFrame, vocabulary: dict, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), the ids of each text and what they decode to, in one pass of the workers.

    ``ids`` and ``decoded`` are those of :func:`encode_texts` and :func:`decode_ids`.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        encoder, decoder = worker_value(shared, lambda v: (Encoder(v), Decoder(v)))
        ids = _id_lists(encoder, columns[0])
        return [ids, _texts_of(decoder, ids)]

    def ended() -> None:
        worker_value(shared, lambda v: (Encoder(v), Decoder(v)))[0].forget()

    return map_texts(df, df.columns if keep is None else keep, [F.col(f"`{text}`").cast("string")], "ids array<int>, decoded string", work, ended=ended)
