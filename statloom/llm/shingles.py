"""Words and word shingles of whole batches, as digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from statloom.llm.common import mixed, powers, text_bytes

#: A word is a run of ASCII letters and digits and of all code points beyond ASCII.
IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
BASE = 0x9E3779B97F4A7C15
NEXT = np.uint64(0xD6E8FEB86659FD93)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts and where each begins."""
    return text_bytes(pc.utf8_lower(column.fill_null("")))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of each word, and the first word of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = IN_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < n]
    opens[heads] = inside[heads]
    begin = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = starts[1:][starts[1:] > 0] - 1
    closes[tails] = inside[tails]
    end = np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    letters = mixed(np.arange(1, 257, dtype=np.uint64))
    np.cumsum(letters[data] * powers(BASE, n), out=sums[1:])
    back = powers(pow(BASE, -1, 1 << 64), n)
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)), np.searchsorted(begin, starts)


def chained(digests: np.ndarray, width: int) -> np.ndarray:
    """The digest of each `width` neighbouring words."""
    n = len(digests) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = digests[:n]
    for k in range(1, width):
        out = mixed(out * NEXT + digests[k : k + n])
    return out


def shingles(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, how often) of each different shingle, by text and digest.

    A text of fewer words than `width` has one shingle, of all its words; one
    without words has none.
    """
    digest, first = words(data, starts)
    count = np.diff(first)
    full = chained(digest, width)
    owner = np.repeat(np.arange(len(count)), count)
    usable = np.arange(len(full)) + width <= first[1:][owner[: len(full)]]
    rows, hashes = owner[: len(full)][usable], full[usable]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        alone = np.array([chained(digest[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, alone])
    order = np.argsort(hashes)
    rows, hashes = rows[order], hashes[order]
    narrow = rows.astype(np.uint16) if len(count) < 1 << 16 else rows
    order = np.argsort(narrow, kind="stable")
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))
