"""Byte-level BPE without a regular expression.

Texts of a batch become one array of code points and then one of symbols: the
class of the code point (letter, number, other, white space) together with the
little that the split rule looks ahead for. Each symbol is a function from
state to state. Functions compose associatively, and only a few dozen differ,
so the composition of all symbols before a position is found by table lookups
over whole arrays: rows of symbols are scanned side by side, then the rows'
totals. A second lookup tells where pieces begin. The pieces are cut from the
bytes and looked up in a cache of merged pieces that lives as long as the
worker.

Defined results: NULL text is encoded as the empty text and decoded as such; an
empty text has no ids. Repeated rows are encoded alike. Extra columns are kept;
a result column's name that is taken is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import long_texts, mixed, row_slices, text_bytes, worker_store

LETTER, NUMBER, OTHER, LAST_BLANK, LAST_WHITE, WHITE, SHORT, LONG = range(8)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
#: Added to a symbol that begins a text.
FIRST = 8
#: Fixed values of the split rule: white space, and what an apostrophe joins with.
WHITE_POINTS = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
#: Symbols scanned one after another, for all rows of symbols at once.
SPAN = 256
#: Different pieces that a worker remembers.
CACHE_PIECES = 250_000
#: Bytes of a piece that is merged side by side with others; longer ones are merged alone.
LANES = 32
#: Bytes of text encoded at a time.
ENCODED_BYTES = 2 << 20


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at the symbol."""
    if symbol >= FIRST:
        state, symbol, first = CLOSED, symbol - FIRST, True
    else:
        first = False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (LETTER, NUMBER, OTHER):
        to = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return to, first or state not in (to, AFTER_BLANK)
    if symbol == WHITE:
        return IN_WHITE, first or state != IN_WHITE
    return (AFTER_BLANK if symbol == LAST_BLANK else CLOSED), True


class Scanner:
    """Finds where pieces begin in arrays of code points."""

    def __init__(self) -> None:
        known = np.zeros(0x110000, np.uint8) + np.uint8(OTHER)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))[0]
            if kind == "L":
                known[point] = LETTER
            elif kind == "N":
                known[point] = NUMBER
        known[list(WHITE_POINTS)] = WHITE
        self.classes = known
        basic = [tuple(step(s, symbol)[0] for s in range(8)) for symbol in range(2 * FIRST)]
        found = {tuple(range(8)): 0}
        queue = [tuple(range(8))]
        for f in queue:
            for g in basic:
                h = tuple(g[s] for s in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        self.count = len(queue)
        self.symbol_of = np.array([found[g] for g in basic], np.uint16)
        self.apply = np.array(queue, np.uint8)
        self.then = np.array([[found[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
        self.begins = np.array([[step(s, symbol)[1] for symbol in range(2 * FIRST)] for s in range(8)])

    def prefixes(self, functions: np.ndarray) -> np.ndarray:
        """The composition of functions[0] to functions[i], for each i."""
        n = len(functions)
        if n <= SPAN:
            out = np.empty(n, np.uint16)
            last = 0
            for i, f in enumerate(functions.tolist()):
                last = out[i] = self.then[last, f]
            return out
        rows = -(-n // SPAN)
        padded = np.zeros(rows * SPAN, np.uint16)
        padded[:n] = functions
        across = np.ascontiguousarray(padded.reshape(rows, SPAN).T)
        flat, width = self.then.ravel(), np.uint32(self.count)
        for j in range(1, SPAN):
            across[j] = flat[across[j - 1] * width + across[j]]
        before = np.zeros(rows, np.uint16)
        before[1:] = self.prefixes(across[-1])[:-1]
        return flat[(before * width)[None, :] + across].T.ravel()[:n]

    def pieces(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin; `starts` holds where each text that is not empty begins."""
        n = len(points)
        kinds = self.classes[points]
        white = kinds == WHITE
        last = np.zeros(n, bool)
        last[starts[1:] - 1] = True
        last[n - 1] = True
        follows = np.empty(n, bool)
        follows[:-1] = ~white[1:]
        follows[last] = False
        symbols = kinds
        edge = white & follows
        symbols[edge] = np.where(points[edge] == 32, LAST_BLANK, LAST_WHITE)
        self._contractions(points, last, symbols)
        first = np.zeros(n, np.uint8)
        first[starts] = FIRST
        symbols = symbols + first
        after = self.apply[self.prefixes(self.symbol_of[symbols]), CLOSED]
        state = np.empty(n, np.uint8)
        state[0] = CLOSED
        state[1:] = after[:-1]
        return np.flatnonzero(self.begins[state, symbols])

    @staticmethod
    def _contractions(points: np.ndarray, last: np.ndarray, symbols: np.ndarray) -> None:
        at = np.flatnonzero(points == ord("'"))
        at = at[~last[at]]
        following = points[at + 1]
        one = np.isin(following, [ord(c) for c in ONE_LETTER])
        symbols[at[one]] = SHORT
        at, following = at[~one], following[~one]
        keep = ~last[at + 1] if len(at) else np.zeros(0, bool)
        at, following = at[keep], following[keep]
        second = points[at + 2] if len(at) else np.zeros(0, points.dtype)
        for a, b in TWO_LETTERS:
            symbols[at[(following == ord(a)) & (second == ord(b))]] = LONG


class Vocabulary:
    """Merges pieces, many at a time, and remembers what it has merged.

    `pairs` maps two ids to that of their union; a union's id is its rank. With
    `whole`, a piece that is a token is not merged at all.
    """

    NONE = np.int64(1 << 40)

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], int], whole: dict[bytes, int] | None) -> None:
        self.whole = whole or {}
        self.byte_ids = np.zeros(256, np.int64)
        for i, token in enumerate(tokens):
            if len(token) == 1:
                self.byte_ids[token[0]] = i
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self._table(pairs)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.held = self.used = 0

    def _table(self, pairs: dict[tuple[int, int], int]) -> None:
        """Open addressing with linear steps, filled a step at a time."""
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int64)
        self.keys = np.full(self.mask + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(self.mask + 1, self.NONE)
        slot = self._slot(keys)
        self.reach = 0
        while len(keys):
            self.reach += 1
            free = np.flatnonzero(self.values[slot] == self.NONE)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) & np.uint64(self.mask)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for what does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), self.NONE)
        todo = np.arange(len(keys))
        for _ in range(self.reach):
            hit = self.keys[slot] == keys
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (self.values[slot] != self.NONE)
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & self.mask
            if not len(todo):
                break
        return out

    def rank(self, left: int, right: int) -> int | None:
        """The rank of one pair."""
        key = (left << 32) | right
        x = key ^ (key >> 30)
        x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        slot = (x ^ (x >> 31)) & self.mask
        for _ in range(self.reach):
            value = self.values[slot]
            if value == self.NONE:
                return None
            if self.keys[slot] == key:
                return int(value)
            slot = (slot + 1) & self.mask
        return None

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.

        Each round merges, in every piece at once, the leftmost pair of lowest rank.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        done_ids, done_owner = [], []
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(ids)))
            open_ = best < self.NONE
            if not open_.all():
                kept = np.repeat(open_, sizes)
                done_ids.append(ids[~kept])
                done_owner.append(owner[~kept])
                ids, owner, rank = ids[kept], owner[kept], rank[kept]
                best, sizes = best[open_], sizes[open_]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[hits] = best
            kept = np.ones(len(ids), bool)
            kept[hits + 1] = False
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
            at = hits - np.arange(len(hits))
            after = at[(at + 1 < len(ids))]
            after = after[owner[after + 1] == owner[after]]
            rank[at] = self.NONE
            rank[after] = self.ranks(ids[after], ids[after + 1])
            before = at[at > 0]
            before = before[owner[before - 1] == owner[before]] - 1
            rank[before] = self.ranks(ids[before], ids[before + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length, with a heap of pairs and linked parts."""
        n, get = len(piece), self.rank
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a, b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := get(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
            if k < n:
                before[k] = i
        return [i for i in ids if i >= 0]

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Places of pieces, merging those not met before."""
        if self.held + len(pieces) > CACHE_PIECES and self.held:
            self.forget()
        get = self.place.get
        places = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            known = [[self.whole[p]] if p in self.whole else self.merge_long(p) if len(p) > LANES else None for p in new]
            ids, counts = self.merge([p if k is None else b"" for p, k in zip(new, known)])
            counts = np.where([k is None for k in known], counts, [len(k or ()) for k in known])
            if any(k is not None for k in known):
                ends = np.cumsum(counts)
                full = np.zeros(int(ends[-1]), np.int64)
                own = np.repeat([k is None for k in known], counts)
                full[own] = ids
                full[~own] = [i for k in known if k is not None for i in k]
                ids = full
            places[missing] = self._keep(new, ids, counts)
        return places

    def _keep(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first, room = self.held, self.held + len(pieces)
        while room > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[first:room] = self.used + np.cumsum(counts) - counts
        self.count[first:room] = counts
        self.held, self.used = room, self.used + len(ids)
        self.place.update(zip(pieces, range(first, room)))
        return np.arange(first, room)


class ByteBpe:
    """A vocabulary of byte strings with ranks, and special texts that have an id of their own."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None, special: dict[str, int] | None = None) -> None:
        self.special = dict(special or {})
        self.source = pickle.dumps((tokens, merges, self.special))
        self.key = hashlib.sha256(self.source).hexdigest()

    @classmethod
    def from_ranks(cls, path: str, special: dict[str, int] | None = None) -> ByteBpe:
        """A file with a base64 token and its rank on each line; any two tokens whose union is one merge."""
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(a): int(b) for a, b in lines}, None, special)

    @classmethod
    def from_merges(cls, path: str) -> ByteBpe:
        """A byte-level BPE in JSON; its ids must be in the order of its merges.

        Only listed merges are made. Added special tokens are taken wherever
        their text stands, as that format's own library does.
        """
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte_of = _printable_bytes()
        added = {t["content"]: t["id"] for t in held.get("added_tokens", []) if t.get("special")}
        ids = held["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in held["model"]["merges"]]
        order = [ids[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the ids do not follow the order of the merges")
        raw = {token: bytes(byte_of[c] for c in token) for token in ids if token not in added}
        return cls({raw[t]: i for t, i in ids.items() if t in raw}, [(raw[a], raw[b]) for a, b in merges], added)

    def open(self) -> tuple[Scanner, Vocabulary]:
        """What encoding needs, built once in each worker."""
        store = worker_store("bpe")
        if "scanner" not in store:
            store["scanner"] = Scanner()
        if self.key not in store:
            ids, merges, _ = pickle.loads(self.source)
            if merges is None:
                splits = ((t[:k], t[k:], i) for t, i in ids.items() for k in range(1, len(t)))
                pairs = {(ids[a], ids[b]): i for a, b, i in splits if a in ids and b in ids}
            else:
                pairs = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
            store[self.key] = Vocabulary(self.tokens(), pairs, ids if merges is None else None)
        return store["scanner"], store[self.key]

    def tokens(self) -> list[bytes]:
        """The bytes of each id, all that decoding needs."""
        ids, _, special = pickle.loads(self.source)
        out = [b""] * (max([*ids.values(), *special.values()], default=-1) + 1)
        for token, i in [*ids.items(), *((text.encode(), i) for text, i in special.items())]:
            out[i] = token
        return out

    def encode_slice(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit words."""
        scanner, vocabulary = self.open()
        raw = data.tobytes()
        for text in self.special:
            if text.encode() in raw:
                return self._encode_special(raw, starts)
        return _encode(scanner, vocabulary, raw, data, starts)

    def _encode_special(self, raw: bytes, starts: np.ndarray) -> list[bytes]:
        """Texts are cut at the special texts, leftmost first, and the longest of two."""
        names = sorted(self.special, key=len, reverse=True)
        parts: list[bytes] = []
        owner: list[int] = []
        fixed: dict[int, bytes] = {}
        for row, (a, b) in enumerate(zip(starts, starts[1:])):
            text, at = raw[a:b], 0
            while True:
                hits = [(text.find(s.encode(), at), i, s) for i, s in enumerate(names)]
                hit = min((h for h in hits if h[0] >= 0), default=None)
                parts.append(text[at:] if hit is None else text[at : hit[0]])
                owner.append(row)
                if hit is None:
                    break
                fixed[len(parts)] = np.array([self.special[hit[2]]], "<u4").tobytes()
                parts.append(b"")
                owner.append(row)
                at = hit[0] + len(hit[2].encode())
        scanner, vocabulary = self.open()
        joined = b"".join(parts)
        ends = np.cumsum([0] + [len(p) for p in parts])
        found = _encode(scanner, vocabulary, joined, np.frombuffer(joined, np.uint8), ends)
        out = [b""] * (len(starts) - 1)
        for i, row in enumerate(owner):
            out[row] += fixed.get(i, found[i])
        return out


def _printable_bytes() -> dict[str, int]:
    """The format's letters for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _encode(scanner: Scanner, vocabulary: Vocabulary, raw: bytes, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    rows = len(starts) - 1
    if not len(raw):
        return [b""] * rows
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    begins = np.unique(starts[:-1][starts[1:] > starts[:-1]])
    cuts = heads[scanner.pieces(points, np.searchsorted(heads, begins))]
    ends = np.append(cuts[1:], len(raw))
    first, which = _distinct(data, cuts, ends - cuts)
    places = vocabulary.learn(list(map(raw.__getitem__, map(slice, cuts[first].tolist(), ends[first].tolist()))))[which]
    count = vocabulary.count[places]
    stop = np.cumsum(count)
    ids = vocabulary.ids[np.arange(int(stop[-1])) + np.repeat(vocabulary.begin[places] - stop + count, count)]
    packed = ids.astype("<u4").tobytes()
    bounds = (4 * np.append(0, stop)[np.searchsorted(cuts, starts)]).tolist()
    return [packed[a:b] for a, b in zip(bounds, bounds[1:])]


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different piece, and for all pieces which of these it equals.

    Pieces of up to LANES bytes are sorted by a hash and then compared in full;
    longer ones, and any two that share a hash, stay apart.
    """
    padded = np.concatenate([data, np.zeros(LANES, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, LANES)[begin]
    lanes *= np.arange(LANES) < size[:, None]
    words = np.ascontiguousarray(lanes).view("<u8")
    key = size.astype(np.uint64)
    for j in range(words.shape[1]):
        key = mixed(key + words[:, j])
    long = size > LANES
    key[long] = mixed(begin[long].astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    same = (size == size[first][which]) & (words == words[first][which]).all(axis=1) & (~long | (first[which] == np.arange(len(size))))
    apart = np.flatnonzero(~same)
    which[apart] = len(first) + np.arange(len(apart))
    return np.concatenate([first, apart]), which


def _out(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    taken = {c.lower() for c in df.columns}
    for name, _ in added:
        if name.lower() in taken:
            raise ValueError(f"column {name!r} is there already; rename it or choose another result name")
    return T.StructType([*df.schema.fields, *[T.StructField(n, t, False) for n, t in added]])


def encode(df: DataFrame, bpe: ByteBpe, text: str = "text", ids: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """Add the ids of `text` and the byte at which each token begins, packed as 32-bit words."""
    added = [(ids, T.BinaryType())] + ([(offsets, T.BinaryType())] if offsets else [])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = bpe.open()[1].lengths.astype(np.uint32)
        for batch in batches:
            data, starts = text_bytes(batch.column(place))
            for a, b in row_slices(starts, ENCODED_BYTES):
                own = starts[a : b + 1]
                found = bpe.encode_slice(data[own[0] : own[-1]], own - own[0])
                columns = [*batch.slice(a, b - a).columns, pa.array(found, pa.binary())]
                if offsets:
                    columns.append(pa.array([_token_starts(x, lengths) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[n for n, _ in added]])

    return long_texts(df).mapInArrow(run, _out(df, *added))


def _token_starts(ids: bytes, lengths: np.ndarray) -> bytes:
    each = lengths[np.frombuffer(ids, "<u4")]
    return (np.cumsum(each, dtype=np.uint32) - each).astype("<u4").tobytes()


def decode(df: DataFrame, bpe: ByteBpe, ids: str = "ids", offsets: str | None = "offsets", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for.

    With offsets, all tokens of a row are put in place at once; without, their
    lengths are summed first. NULL ids give empty bytes; an id that the
    vocabulary lacks is an error.
    """
    place = df.columns.index(ids)
    at = df.columns.index(offsets) if offsets else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.tokens()
        lengths = np.array([len(t) for t in tokens], np.int64)
        blob = np.frombuffer(b"".join(tokens), np.uint8)
        homes = np.cumsum(lengths) - lengths
        for batch in batches:
            data, starts = text_bytes(batch.column(place))
            where = text_bytes(batch.column(at))[0] if at is not None else None
            for a, b in row_slices(starts, 1 << 20):
                first, last = starts[a], starts[b]
                each = np.frombuffer(data[first:last].tobytes(), "<u4")
                size = lengths[each]
                ends = np.cumsum(size)
                begin = ends - size
                edges = np.concatenate([[0], ends])[(starts[a : b + 1] - first) // 4]
                if where is not None:
                    kept = np.frombuffer(where[first:last].tobytes(), "<u4").astype(np.int64)
                    begin = kept + np.repeat(edges[:-1], np.diff(starts[a : b + 1]) // 4)
                total = int(ends[-1]) if len(ends) else 0
                source = np.arange(total) + np.repeat(homes[each] - begin, size)
                raw = blob[source].tobytes()
                out = [raw[x:y] for x, y in zip(edges.tolist(), edges[1:].tolist())]
                columns = [*batch.slice(a, b - a).columns, pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, decoded])

    return long_texts(df).mapInArrow(run, _out(df, (decoded, T.BinaryType())))


def token_count(ids: str) -> F.Column:
    return (F.length(ids) / 4).cast("long")
