"""Benchmark decontamination: documents streamed through a suffix automaton of the test items.

The automaton recognises every run of words that occurs in an item. For each word of a
document it gives the length of the longest such run that ends there; runs as long as the
window are contamination. Items go into automata in blocks of bounded size, documents
pass through each block, and the results of the blocks are united by document only when
there is more than one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalweave.llm.common import as_bytes, map_texts, worker_value

WINDOW = 10
#: Items of a block have this many bytes together, at most, unless one item alone has more; its automaton takes some 200 times as much in a worker.
BLOCK_BYTES = 1 << 20
#: Bytes as words see them: A-Z in lower case, ASCII letters and digits and all others beyond ASCII kept, the rest a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text; none of a null."""
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over words of items, with the items that hold each window."""

    def __init__(self, items: Sequence[tuple[int, bytes]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [-1], [0]
        words = [(item, words_of(text)) for item, text in items]
        for _, run in words:
            last = 0
            for word in run:
                last = self._extend(last, word)
        #: By state: the items for which the run of ``window`` words that ends there, or all words of a shorter item, is a window.
        self.items: dict[int, dict[int, set]] = {}
        for item, run in words:
            size = min(window, len(run))
            state = length = 0
            for i, word in enumerate(run):
                state, length = self.next[state][word], length + 1
                state, length = self.cut(state, length, size)
                if length == size and i + 1 >= size:
                    self.items.setdefault(state, {}).setdefault(size, set()).add(item)
        # The windows that end wherever a state is reached: its own and those of the states it links to.
        self.ends: list[list[tuple[int, frozenset]]] = [[] for _ in self.link]
        for state in sorted(range(len(self.link)), key=self.longest.__getitem__):
            above = self.ends[self.link[state]] if state else []
            own = self.items.get(state)
            self.ends[state] = above if not own else sorted([*above, *((n, frozenset(x)) for n, x in own.items())], key=lambda x: x[0])

    def _state(self, longest: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, target: int, word: bytes) -> int:
        """A state of its own for the runs of ``target`` that are no longer than those of ``state`` and the word."""
        copy = self._state(self.longest[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, known, word)
        new = self._state(self.longest[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            exact = self.longest[target] == self.longest[state] + 1
            self.link[new] = target if exact else self._split(state, target, word)
        return new

    def cut(self, state: int, length: int, most: int) -> tuple[int, int]:
        """State and length after a run is cut to its last ``most`` words."""
        while length > most:
            if self.longest[self.link[state]] < most:
                return state, most
            state = self.link[state]
            length = self.longest[state]
        return state, length

    def matches(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Spans of words inside windows (first, end), the items whose windows occur, and the longest match."""
        following, link, longest, ends = self.next, self.link, self.longest, self.ends
        spans: list[tuple[int, int]] = []
        items: set = set()
        seen: set[int] = set()
        state = length = most = 0
        for i, word in enumerate(words):
            target = following[state].get(word)
            if target is not None:
                state, length = target, length + 1
            else:
                while state and word not in following[state]:
                    state = link[state]
                if word in following[state]:
                    length = longest[state] + 1
                    state = following[state][word]
                else:
                    length = 0
                    continue
            if length > most:
                most = length
            if ends[state]:
                reach = 0
                for size, who in ends[state]:
                    if size > length:
                        break
                    reach = size
                    if id(who) not in seen:
                        seen.add(id(who))
                        items |= who
                if reach:
                    reach = length if length >= self.window else reach
                    first = i + 1 - reach
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first:
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((first, i + 1))
        return spans, items, most


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Distinct non-empty items in blocks of bounded size, of which the driver holds one at a time."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for row in rows.filter("text IS NOT NULL").distinct().toLocalIterator():
        content = bytes(row.text)
        if block and size + len(content) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, content))
        size += len(content)
    yield block


FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>, longest long"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def united(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order with the same words."""
    done: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if done and done[-1][1] >= first:
            done[-1] = (done[-1][0], max(done[-1][1], end))
        else:
            done.append((first, end))
    return done


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` of each row and what the items have in common with its text.

    ``n_words``; ``spans``, the words inside occurring windows as disjoint (first, end)
    in order; ``items``, the sorted distinct ids (as text) of the items whose windows
    occur; ``longest``, the length of the longest run shared with an item. A kept column
    of one of these names is replaced.

    A null or empty text has no words; an item without words matches nothing; the windows
    of an item with a null id are hit but add no id. Repeated rows stay. Row-local: each
    block of items is one more pass over the rows, without a shuffle.
    """
    return _hits(docs, items, keep, text, item_id, item_text, window, block_bytes, False)


def _hits(
    docs: DataFrame, items: DataFrame, keep: Sequence[str], text: str, item_id: str, item_text: str, window: int, block_bytes: int, cleaned: bool
) -> DataFrame:
    """:func:`find_hits`; with ``cleaned``, also the text without the hit spans as ``cleaned``, made in the last pass."""
    context = docs.sparkSession.sparkContext
    names = [f.name for f in StructType.fromDDL(FOUND)]
    keep = [c for c in keep if c not in names]

    def through(rows: DataFrame, shared, text: Column, before: Sequence[Column], clean: bool) -> DataFrame:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            automaton = worker_value(shared, lambda x: SuffixAutomaton(*x))
            earlier = [c.to_pylist() for c in columns[1:]]
            counts, spans, found, longest = [], [], [], []
            contents = as_bytes(columns[0])
            for row, content in enumerate(contents):
                words = words_of(content)
                hit, who, most = automaton.matches(words)
                who = who - {None}
                if earlier:
                    hit = united([*hit, *((x["first"], x["end"]) for x in earlier[0][row])])
                    who = who.union(earlier[1][row])
                    most = max(most, earlier[2][row])
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in hit])
                found.append(sorted(who))
                longest.append(most)
            made = [pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.int64())]
            if not clean:
                return made
            if not any(spans):
                return [*made, columns[0]]
            texts = [without_words(t, n, s) if s else t for t, n, s in zip(contents, counts, spans)]
            return [*made, pa.array(texts, pa.binary()).cast(pa.string())]

        return map_texts(rows, rows.columns, [text, *before], FOUND + ", cleaned string" * clean, work)

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    before: list[Column] = []
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        later = next(blocks, None)
        rows = through(rows, context.broadcast((block, window)), F.col("_text"), before, cleaned and later is None)
        before = [F.col(n) for n in names[1:]]
        block = later
    return rows.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(keep)], *names, *["cleaned"] * cleaned)


def hit_words() -> Column:
    """Number of words inside the spans of :func:`find_hits`."""
    return F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.first)")


def remove_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: float = 0.5,
) -> DataFrame:
    """``docs`` without the contaminated spans of ``text``; documents of which more than ``coverage`` is hit go.

    What stands between the words of a span goes with them, and one space stands for it
    when text is left on both sides. Rows without hits, null texts too, stay as they are.
    """
    columns = docs.columns
    place = columns.index(text)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    names = plain.columns
    found = _hits(plain, items, [n for n in names if n != names[place]], names[place], item_id, item_text, window, BLOCK_BYTES, True)
    found = found.filter(hit_words() <= F.lit(coverage) * F.col("n_words"))
    return found.select(*[F.col("cleaned" if i == place else n).alias(c) for i, (n, c) in enumerate(zip(names, columns))])


def without_words(content: bytes, n_words: int, spans: Sequence[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    plain = np.frombuffer(content.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) != n_words:
        raise ValueError("the spans belong to another text")
    parts, at = [], 0
    for span in spans:
        parts.append(content[at : starts[span["first"]]])
        at = ends[span["end"] - 1]
    parts.append(content[at:])
    kept = [p.strip(b" ") for p in parts]
    return b" ".join(p for p in kept if p)
