"""Jaro-Winkler similarity over batches of text, for use inside Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the measure: prefix length that counts and weight per shared prefix byte.
PREFIX_LIMIT = 4
PREFIX_WEIGHT = 0.1
# Byte classes of the overlap bound; merging bytes into classes only loosens the bound.
_CLASSES = 64
# Bytes that no UTF-8 text contains: padding of the left side, padding and used bytes of the right side.
_LEFT_PAD, _GONE = 0xFE, 0xFF
_PAIRS = 65_536


class TextBatch:
    """Texts as byte columns: row i of ``codes`` holds byte i of every text."""

    def __init__(self, texts: Sequence[str]):
        raw = [t.encode("utf-8") for t in texts]
        self.lengths = np.array([len(r) for r in raw], dtype=np.int64)
        width = max(1, int(self.lengths.max(initial=0)))
        packed = b"".join(r.ljust(width, bytes([_LEFT_PAD])) for r in raw)
        self.codes = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(len(raw), width).T)
        self.counts = np.zeros((len(raw), _CLASSES), dtype=np.uint16 if width < 2**16 else np.uint32)
        places, rows = np.nonzero(np.arange(width)[:, None] < self.lengths)
        np.add.at(self.counts, (rows, self.codes[places, rows] % _CLASSES), 1)
        #: Equal for texts with the same bytes in any order.
        self.keys = np.array([hash(bytes(sorted(r))) for r in raw], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, rows: np.ndarray) -> "TextBatch":
        part = object.__new__(TextBatch)
        part.lengths, part.codes, part.counts, part.keys = self.lengths[rows], self.codes[:, rows], self.counts[rows], self.keys[rows]
        return part

    def right_side(self) -> np.ndarray:
        """Byte columns with the padding of the other side."""
        return np.where(self.codes == _LEFT_PAD, np.uint8(_GONE), self.codes)


def _prefix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared leading bytes, up to the limit, of byte columns whose paddings differ."""
    width = min(PREFIX_LIMIT, left.shape[0], right.shape[0])
    return np.cumprod(left[:width] == right[:width], axis=0).sum(axis=0)


def _boost(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


def _in_order(codes: np.ndarray, hit: np.ndarray, height: int) -> np.ndarray:
    """Matched bytes of each text, moved to the top of its column."""
    lined = np.zeros((height, hit.shape[1]), dtype=np.uint8)
    places, rows = np.nonzero(hit)
    lined[(np.cumsum(hit, axis=0) - 1)[places, rows], rows] = codes[places, rows]
    return lined


def scores(left: TextBatch, right: TextBatch) -> np.ndarray:
    """Similarity of text i of ``left`` with text i of ``right``; the loops run over byte places."""
    fixed = right.right_side()
    free = fixed.copy()
    reach = np.maximum(np.maximum(left.lengths, right.lengths) // 2 - 1, 0)
    near, far = int(reach.min(initial=0)), int(reach.max(initial=0))
    hit_left = np.zeros(left.codes.shape, dtype=bool)
    hit_right = np.zeros(free.shape, dtype=bool)
    for i in range(left.codes.shape[0]):
        open_ = hit_left[i]
        for j in range(max(0, i - far), min(free.shape[0], i + far + 1)):
            pair = (left.codes[i] == free[j]) & ~open_
            if abs(i - j) > near:
                pair &= reach >= abs(i - j)
            open_ |= pair
            hit_right[j] |= pair
            free[j] |= np.negative(pair.view(np.uint8))
    matches = hit_left.sum(axis=0)
    height = max(1, int(matches.max(initial=0)))
    moved = (_in_order(left.codes, hit_left, height) != _in_order(fixed, hit_right, height)).sum(axis=0) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / left.lengths + matches / right.lengths + (matches - moved) / matches) / 3
    result = np.where(matches > 0, _boost(np.nan_to_num(jaro), _prefix(left.codes, fixed)), 0.0)
    return np.where((left.lengths == 0) & (right.lengths == 0), 1.0, result)


def _bounds(left: TextBatch, right: TextBatch) -> np.ndarray:
    """Greatest score that each left text could reach with each right text, from shared byte counts and prefixes."""
    fixed = right.right_side()
    found = np.empty((len(left), len(right)))
    empty = right.lengths == 0
    for i in range(len(left)):
        length = left.lengths[i]
        shared = np.minimum(left.counts[i], right.counts).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.nan_to_num((shared / length + shared / right.lengths + 1) / 3)
        best = np.where(shared > 0, _boost(jaro, _prefix(left.codes[:, i : i + 1], fixed)), 0.0)
        found[i] = np.where(empty & (length == 0), 1.0, best)
    return found + 1e-9


def pair_bounds(left: TextBatch, right: TextBatch, fixed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Greatest score of text i of ``left`` with text j of ``right``, of pairs that miss at most one byte of each other.

    Texts of one size are taken to miss one byte each, unless they have the same bytes. Those with the same
    bytes lose by each two bytes that change places, or by the two that are too far off to match.
    """
    a, b = left.lengths[i], right.lengths[j]
    shared = np.where(a == b, a - (left.keys[i] != right.keys[j]), np.minimum(a, b))
    jaro = (shared / a + shared / b + 1) / 3
    same = np.flatnonzero((shared == a) & (a == b))
    if len(same):
        height = min(left.codes.shape[0], fixed.shape[0])
        x, y = i[same], j[same]
        apart = np.zeros(len(same), np.int64)
        for place in range(height):
            # Both paddings count as different, so they are left out by size.
            apart += (left.codes[place, x] != fixed[place, y]) & (place < a[same])
        jaro[same] = 1 - np.minimum(apart // 2, 2) / (3 * a[same])
    return _boost(jaro, _prefix(left.codes[:, i], fixed[:, j])) + 1e-9


def best_matches(texts: Sequence[str], many: TextBatch, floor: float | Sequence[float], probe: int = 16) -> list[tuple[int, float] | None]:
    """For each text the row of ``many`` with the highest score of at least ``floor`` (or its own floor); the lowest row wins a tie.

    Rows are scored in rounds by falling bound, until no row left could reach the best
    score found so far. None that could win is skipped.
    """
    left = TextBatch(texts)
    bounds = _bounds(left, many)
    best = np.array(np.broadcast_to(floor, len(left)), dtype=float)
    rows = np.full(len(left), -1, dtype=np.int64)
    active, width = np.arange(len(left)), min(probe, len(many))
    while len(active) and width:
        part = bounds[active]
        chosen = np.argpartition(-part, width - 1, axis=1)[:, :width]
        live = np.take_along_axis(part, chosen, axis=1) >= best[active][:, None]
        at, place = np.nonzero(live)
        asked, row = active[at], chosen[at, place]
        for start in range(0, len(asked), _PAIRS):
            some, ref = asked[start : start + _PAIRS], row[start : start + _PAIRS]
            value = np.round(scores(left.take(some), many.take(ref)), 10)
            # First of each text in the order of falling score and rising row.
            order = np.lexsort((ref, -value, some))
            first = order[np.concatenate(([True], some[order][1:] != some[order][:-1]))]
            text, ref, value = some[first], ref[first], value[first]
            wins = (value > best[text]) | ((value == best[text]) & ((rows[text] < 0) | (ref < rows[text])))
            best[text[wins]], rows[text[wins]] = value[wins], ref[wins]
        bounds[asked, row] = -1.0
        active = active[bounds[active].max(axis=1) >= best[active]]
        width = min(width * 4, len(many))
    return [(int(r), float(b)) if r >= 0 else None for r, b in zip(rows, best)]


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two text columns; null when either is null."""
    known = left.notna() & right.notna()
    result = pd.Series(np.nan, index=left.index, dtype="float64")
    if known.any():
        result[known] = scores(TextBatch(left[known].tolist()), TextBatch(right[known].tolist()))
    return result.where(known, None)
