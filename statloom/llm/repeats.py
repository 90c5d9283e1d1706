"""Removal of long byte strings that occur more than once, by radix passes over suffixes.

The suffixes of all texts are ordered only through their first `window` bytes,
most significant digit first, and only as far as needed; suffixes that are still
together after the last pass are the repeated windows, exactly.

* First digit. Suffixes that begin in a row share most of their bytes, so they
  are kept in runs: of the `gram`-byte strings within a window, the one of least
  hash is its anchor, which depends on the window's bytes alone. All windows of a
  run have the same anchor, a run holds about half of `window - gram` windows,
  and two equal windows have equal anchors at equal distances. The digest of the
  anchor is the digit; a run whose digit occurs once is done.
* Second digit: the digest of all bytes of the run. Runs that agree in it are
  repeated as a whole. They count as one from here on, so groups of copies shrink
  to one run with a weight before anything else is moved.
* Last digit, only for runs that share an anchor with a different run: the
  digest of each window. A task sends them in sheets, cut by part of their range:
  a row holds all digests of a sheet in a part, in the order of the windows, and
  is answered with a bit for each. What a sheet is made of goes along, so texts
  are not read again for the answers.

The first two are a grouped count with partial sums before the shuffle. Texts are
shuffled once, by a key of the row. A digest has 64 bits, drawn from two rolling
hashes for the second and last digits.

A second, shorter window can be asked for beside the first. It is the one that all
suffixes are ordered by; a repeated long window has only repeated short ones, so the
long ones are looked for where short ones were found.

Defined results: a NULL text is empty. Strings never cross texts; bytes are
judged on the input. Texts shorter than the window lose nothing of their own.
Rows are known by their content, so repeated rows count as separate texts and
lose all that is long enough. An empty table gives an empty table. Extra columns
are kept; taken result names are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import fresh, long_texts, mixed, powers, quoted, row_key, text_bytes

#: Bytes of the shortest passage that is reported where it repeats: fifty words of average length.
PASSAGE = 250
#: Window starts that are worked on at a time.
PIECE = 1 << 20
#: Kinds of runs that a task holds before it passes them on.
MOST_KINDS = 1 << 20
#: Windows whose digests make a sheet, at least; a sheet has its last runs whole.
SHEET = 1 << 20
#: Bytes of text for which there is one part of the digests' range.
PART = 8 << 20
#: Bits for the windows of a run beside its begin; a window has fewer bytes than they can count.
COUNT_BITS = 20
#: Odd multipliers of the two rolling hashes.
FIRST_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PLACE_BITS = np.uint64(0xFFFFFF)


class Rolling:
    """Digests of any stretch of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int, salt: int) -> None:
        n = len(data)
        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(salt))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data] * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])

    def every(self, length: int) -> np.ndarray:
        """The digests of all stretches of a length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from least values up to and from block borders."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def runs(data: np.ndarray, starts: np.ndarray, window: int, gram: int, limits: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor: (row, begin in the row, windows, digest of the anchor, digest of the run).

    `limits` are the stretches of window starts to look at, in order: (row, first, end); all of them, if missing.
    """
    out = []
    if limits is None:
        limits = np.arange(len(starts) - 1), starts[:-1], starts[:-1] + np.maximum(np.diff(starts) - window + 1, 0)
    # Window starts of all rows, taken in pieces; a run that is cut there only takes one more pass.
    first = 0
    while first < len(data):
        last = min(first + PIECE, len(data))
        held = data[first : min(last + window - 1, len(data))]
        if len(held) >= window:
            out.append(_runs(held, first, last, starts, limits, window, gram))
        first = last
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(held: np.ndarray, first: int, last: int, starts: np.ndarray, limits: tuple[np.ndarray, ...], window: int, gram: int) -> tuple[np.ndarray, ...]:
    mine = slice(int(np.searchsorted(limits[2], first, "right")), int(np.searchsorted(limits[1], last, "left")))
    rows, low, high = limits[0][mine], np.maximum(limits[1][mine], first), np.minimum(limits[2][mine], last)
    rows, low, high = rows[high > low], low[high > low], high[high > low]
    if not len(rows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    one, two = Rolling(held, FIRST_BASE, 3), Rolling(held, SECOND_BASE, 5)
    grams = one.every(gram)
    keyed = (grams & ~PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keyed, window - gram + 1) & PLACE_BITS).astype(np.int64)
    change = np.zeros(len(held) + 1, bool)
    change[1 : len(anchor)] = anchor[1:] != anchor[:-1]
    change[low - first] = True
    valid = np.zeros(len(held) + 1, np.int8)
    np.add.at(valid, low - first, 1)
    np.add.at(valid, high - first, -1)
    inside = np.cumsum(valid, dtype=np.int8) > 0
    begin = np.flatnonzero(change & inside)
    owner = np.searchsorted(low - first, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(held)), (high - first)[owner])
    count = end - begin
    at = anchor[begin]
    whole = one(begin, end - 1 + window) * np.uint64(SECOND_BASE) + two(begin, end - 1 + window)
    shape = (count.astype(np.uint64) << np.uint64(32)) | (at - begin).astype(np.uint64)
    return rows[owner], begin + first - starts[rows[owner]], count, grams[at], mixed(whole + mixed(shape))


def _required(**kinds: T.DataType) -> T.StructType:
    """A schema without NULLs; filters against them would make equal shuffles differ."""
    return T.StructType([T.StructField(name, kind, False) for name, kind in kinds.items()])


KIND = _required(digit=T.LongType(), k=T.LongType(), n=T.LongType())
RUN = _required(rid=T.LongType(), begin=T.IntegerType(), count=T.IntegerType(), k=T.LongType())
#: Digests of a sheet (known by its first run) in a part; a sheet's own row has a spot below 0, its runs and the parts of its windows.
SHEETS = "spot long, rid long, begin int, digests binary, weights binary"
STRETCH = _required(rid=T.LongType(), at=T.LongType())


def remove_repeats(
    df: DataFrame,
    text: str = "text",
    ids: tuple[str, ...] = ("doc_id",),
    window: int = 400,
    kept: str = "kept",
    spans: str = "spans",
    shorter: int | None = None,
    passages: str = "passages",
) -> DataFrame:
    """Add the bytes of each text that no repeated window covers, and the runs of bytes removed.

    `ids` only helps to tell rows apart, so that copies of a text are spread over the tasks.
    With `shorter`, 2 bytes at least and less than `window`, `passages` has the runs of bytes that
    repeated strings of that length cover; they are only listed, not removed.
    """
    taken = {c.lower() for c in df.columns}
    for name in (kept, spans) if shorter is None else (kept, spans, passages):
        if name.lower() in taken:
            raise ValueError(f"column {name!r} is there already; choose another result name")
    if not 1 <= window < 1 << COUNT_BITS:
        raise ValueError(f"a window has 1 to {(1 << COUNT_BITS) - 1} bytes")
    if shorter is not None and not 2 <= shorter < window:
        raise ValueError(f"the shorter window has 2 to {window - 1} bytes")
    rid, found, short = fresh(df, "_rid", "_found", "_short")
    size = df.agg(F.sum(F.octet_length(F.col(quoted(text)).cast("binary")))).first()[0] or 0
    parts = -(-size // PART) or 1
    # The one shuffle of texts; all passes read it.
    texts = long_texts(df).withColumn(rid, row_key(*ids, text)).repartition(rid)
    place, key = texts.columns.index(text), len(df.columns)
    joined = texts
    if shorter is not None:
        listed = _by_row(_repeated(texts, texts, place, shorter, parts), rid, short)
        joined = texts.join(listed, rid, "left").select(*[F.col(quoted(c)) for c in texts.columns], short)
        limited = texts.join(listed, rid).select(*[F.col(quoted(c)) for c in texts.columns], short)
        covered = _repeated(limited, texts, place, window, parts, shorter)
    else:
        covered = _repeated(texts, texts, place, window, parts)
    others = [c for c in joined.columns if c != rid]
    joined = joined.join(_by_row(covered, rid, found), rid, "left").select(*[F.col(quoted(c)) for c in others], found)
    span = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
    added = [T.StructField(kept, T.BinaryType(), False), T.StructField(spans, T.ArrayType(span, False), False)]
    if shorter is not None:
        added.append(T.StructField(passages, T.ArrayType(span, False), False))
    names = [*df.columns, *(field.name for field in added)]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [*batch.columns[:key], *_removed(batch.column(place), batch.column(len(others)), window)]
            if shorter is not None:
                out.append(_removed(batch.column(place), batch.column(key), shorter)[1])
            yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.mapInArrow(remove, T.StructType([*df.schema.fields, *added]))


def _by_row(covered: DataFrame, rid: str, name: str) -> DataFrame:
    return covered.groupBy("rid").agg(F.collect_set("at").alias(name)).withColumnRenamed("rid", rid)


def _repeated(source: DataFrame, texts: DataFrame, place: int, window: int, parts: int, shorter: int | None = None) -> DataFrame:
    """(rid, at): stretches of starts of repeated windows, as first start and number in one value.

    `texts` ends in the rows' keys. `source` is the same, or has those rows that hold repeated
    windows of `shorter` bytes with the stretches of these as one more column.
    """
    gram = max(1, window // 2)
    key = len(texts.columns) - 1
    rid, found = texts.columns[key], fresh(texts, "_found")[0]

    def every(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, starts = text_bytes(batch.column(place))
        limits = None if shorter is None else _limits(batch.column(key + 1), starts, shorter, window)
        return runs(data, starts, window, gram, limits)

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, begin, count, _, whole = every(batch)
            columns = [batch.column(key).take(pa.array(row)), pa.array(begin, pa.int32()), pa.array(count, pa.int32())]
            columns.append(pa.array(whole.view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "begin", "count", "k"])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()
        for batch in batches:
            _, _, _, digit, whole = every(batch)
            held.add(digit, whole)
            if held.waiting > MOST_KINDS:
                yield held.drain()
        yield held.drain()

    # Tasks sum up their own copies first, so a hot anchor comes in as few rows as there are tasks.
    each = source.mapInArrow(kinds, KIND).repartition("digit").groupBy("digit", "k").agg(F.sum("n").alias("n"))
    told = each.withColumn("kinds", F.count("*").over(Window.partitionBy("digit"))).where("n > 1 or kinds > 1").select("k", "n", (F.col("kinds") > 1).alias("mixed"))
    known = source.mapInArrow(all_runs, RUN).join(told, "k")
    # Grouped by a digest of the key, so that the join before it may still split a hot one.
    first = F.min(F.struct("rid", "begin", "count", "n")).alias("one")
    rest = known.where("mixed").groupBy(F.xxhash64("k")).agg(first).select("one.*")
    listed = rest.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("begin", "count", "n"))).alias(found))
    # All columns stay, so that the shuffle of texts is the same one again; sorted, so that sheets are the same if a task runs again.
    held = texts.join(listed.withColumnRenamed("rid", rid), rid).sortWithinPartitions(rid).select(*[F.col(quoted(c)) for c in texts.columns], found)
    sheets = held.mapInArrow(lambda batches: _sheets(batches, place, key, window, parts), SHEETS)
    told = sheets.groupBy("spot").applyInArrow(_answered, SHEETS)
    last = told.groupBy("rid", "begin").applyInArrow(_solved, STRETCH)
    return known.where("n > 1").select("rid", (F.col("begin").cast("long") * F.lit(1 << COUNT_BITS) + F.col("count")).alias("at")).union(last)


def _limits(lists: pa.Array, starts: np.ndarray, shorter: int, window: int) -> tuple[np.ndarray, ...]:
    """The stretches of window starts with repeated shorter windows alone: (row, first, end)."""
    packed = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    begin = starts[owner] + (packed >> COUNT_BITS)
    change = np.zeros(int(starts[-1]) + 2, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (packed & ((1 << COUNT_BITS) - 1)), -1)
    edges = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False)).reshape(-1, 2)
    # A row's last bytes begin no window, so stretches of two rows never touch.
    low, high = edges[:, 0], edges[:, 1] - (window - shorter)
    low, high = low[high > low], high[high > low]
    return np.searchsorted(starts, low, "right") - 1, low, high


class Counted:
    """How often each pair of digests came in."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, digit: np.ndarray, whole: np.ndarray) -> None:
        self.parts.append((digit, whole, np.ones(len(digit), np.int64)))
        self.waiting += len(digit)
        if len(self.parts) >= 32:
            self._sum()

    def _sum(self) -> None:
        digit, whole, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((whole, digit))
        digit, whole, n = digit[order], whole[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (digit[1:] != digit[:-1]) | (whole[1:] != whole[:-1])])[: len(digit)])
        self.parts = [(digit[new], whole[new], np.add.reduceat(n, new) if len(new) else n)]
        self.waiting = len(new)

    def drain(self) -> pa.RecordBatch:
        self.add(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self._sum()
        digit, whole, n = self.parts[0]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(digit.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(n)], names=["digit", "k", "n"])


def _sheets(batches: Iterator[pa.RecordBatch], place: int, key: int, window: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The digest of each window of the listed runs, as sheets; rows come in the order of their keys."""
    held, size = [], 0
    for piece in _windows(batches, place, key, window):
        held.append(piece)
        size += len(piece[-1])
        if size >= SHEET:
            yield _sheet(held, parts)
            held, size = [], 0
    if size:
        yield _sheet(held, parts)


def _sheet(held: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    rid, begin, count, weight, digest = (np.concatenate(x) for x in zip(*held))
    part = ((digest >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    digest, several = digest[order], np.repeat(weight > 1, count)[order]
    spots = np.flatnonzero(np.diff(bounds))
    # The sheet's own row passes the parts under a spot of its own.
    own = np.stack([rid, begin, count, weight]).astype(np.int64).tobytes()
    digests = [own, *(digest[bounds[p] : bounds[p + 1]].tobytes() for p in spots)]
    weights = [part.astype(np.uint8 if parts <= 1 << 8 else np.uint16 if parts <= 1 << 16 else np.uint32).tobytes()]
    weights += [np.packbits(several[bounds[p] : bounds[p + 1]]).tobytes() for p in spots]
    n = len(spots) + 1
    spot = np.concatenate([[-1 - (abs(int(rid[0])) >> 1)], spots])
    columns = [pa.array(spot, pa.int64()), pa.array(np.full(n, rid[0], np.int64)), pa.array(np.full(n, begin[0], np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), pa.array(weights, pa.binary())], names=["spot", "rid", "begin", "digests", "weights"])


def _answered(rows: pa.Table) -> pa.Table:
    """In place of digests, a bit for each: whether its window is there more than once."""
    if rows["spot"][0].as_py() < 0:
        return rows
    digests = [np.frombuffer(x.as_py(), np.uint64) for x in rows["digests"]]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(d)) for x, d in zip(rows["weights"], digests)]
    every = np.concatenate(digests)
    order = np.argsort(every)
    new = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
    times = np.add.reduceat(np.concatenate(several)[order].astype(np.int64) + 1, new)
    twice = np.empty(len(every), bool)
    twice[order] = np.repeat(times > 1, np.diff(np.append(new, len(every))))
    ends = np.cumsum([len(d) for d in digests])
    bits = [np.packbits(twice[end - len(d) : end]).tobytes() for end, d in zip(ends, digests)]
    return rows.set_column(rows.schema.get_field_index("digests"), "digests", pa.array(bits, pa.binary()))


def _solved(rows: pa.Table) -> pa.Table:
    """The stretches of repeated windows of a sheet, but of runs that are known to be repeated as a whole."""
    rows = rows.sort_by("spot")
    own, bits = rows["digests"][0].as_py(), rows["digests"][1:]
    rid, begin, count, weight = np.frombuffer(own, np.int64).reshape(4, -1)
    n = int(count.sum())
    raw = rows["weights"][0].as_py()
    part = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n])
    sizes = np.bincount(part)
    told = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(size)) for x, size in zip(bits, sizes[sizes > 0])]
    hit = np.zeros(n, bool)
    hit[np.argsort(part, kind="stable")] = np.concatenate(told) > 0
    hit &= np.repeat(weight == 1, count)
    # A stretch ends where its run does.
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    opens = hit.copy()
    opens[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    closes = hit.copy()
    closes[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    low, high = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    run = owner[low]
    at = ((begin[run] + low - first[run]) << COUNT_BITS) + high - low
    return pa.table([pa.array(rid[run]), pa.array(at)], schema=pa.schema([pa.field("rid", pa.int64(), False), pa.field("at", pa.int64(), False)]))


def _windows(batches: Iterator[pa.RecordBatch], place: int, key: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key of the row, begin, windows, weight) of listed runs, and the digests of all their windows; once for rows of one key."""
    before = None
    for batch in batches:
        data, starts = text_bytes(batch.column(place))
        lists = batch.column(key + 1)
        fields = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        begin, count, weight = (fields.field(i).to_numpy() for i in range(3))
        ids = batch.column(key).to_numpy()
        fresh_row = np.concatenate([ids[:1] != before if before is not None else [True], ids[1:] != ids[:-1]])
        before = ids[-1] if len(ids) else before
        # Rows of about a piece, so that the prefix sums stay small.
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, "right")) - 1)
            one, two = (Rolling(data[starts[row] : starts[end]], b, salt) for b, salt in ((FIRST_BASE, 3), (SECOND_BASE, 5)))
            mine = np.flatnonzero((owner >= row) & (owner < end) & fresh_row[owner])
            for part in np.array_split(mine, -(-max(1, len(mine)) // 5000)):
                c = count[part].astype(np.int64)
                step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                at = np.repeat(starts[owner[part]] - starts[row] + begin[part], c) + step
                both = mixed(one(at, at + window) * np.uint64(SECOND_BASE) + two(at, at + window))
                if len(part):
                    yield ids[owner[part]], begin[part], c, weight[part], both
            row = end


def _removed(texts: pa.Array, lists: pa.Array, window: int) -> tuple[pa.Array, pa.Array]:
    data, starts = text_bytes(texts)
    kept, cuts = [], []
    ends = lists.offsets.to_numpy()
    packed = lists.flatten().to_numpy()
    begins, counts = packed >> COUNT_BITS, packed & ((1 << COUNT_BITS) - 1)
    ends = ends - ends[0]
    for i in range(len(texts)):
        own = data[starts[i] : starts[i + 1]]
        if ends[i] == ends[i + 1]:
            kept.append(own.tobytes())
            cuts.append([])
            continue
        change = np.zeros(len(own) + 1, np.int32)
        b, c = begins[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
        np.add.at(change, b, 1)
        np.add.at(change, b + c - 1 + window, -1)
        gone = np.cumsum(change)[:-1] > 0
        kept.append(own[~gone].tobytes())
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        cuts.append([{"start": a, "end": z} for a, z in edges.reshape(-1, 2).tolist()])
    span = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]), False))
    return pa.array(kept, pa.binary()), pa.array(cuts, span)


def whole_characters(column: str) -> Column:
    """Bytes as text, without the parts of characters that were cut in two."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return decoded(column)
