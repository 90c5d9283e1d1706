"""Stupid-backoff scores of documents by an n-gram model of the whole corpus.

A word's score is the logarithm of c(context word) / c(context) for the longest
context whose n-gram with the word occurs `least` times or more in the corpus; each
shortening of the context multiplies by `ALPHA`, and the shortest is the word's share
of all words. Documents are dealt into slices of about `SLICE` bytes of text, and a
slice asks for the counts it needs:

* it sends each different n-gram of its documents once, with how often it occurs
  there (beyond two words only where beginning and end are frequent enough, as
  otherwise it is not either): a sorted run of 64-bit digests for each part of their range,
  as differences, so that a row holds a run and an n-gram takes six to seven bytes;
* a part adds up the runs of all slices and answers each with the corpus' counts in
  the order of its run, nothing for what is not frequent enough;
* the slice, read again from the same shuffle of texts, finds its n-grams in the same
  order and scores its words position by position, so that beginnings and ends of
  n-grams are neither sent nor looked up.

A slice asks for an n-gram once at most, so frequent ones make no part large. Slices and
parts are groups of bounded size; their number grows with the texts.

Logarithms are whole numbers of millionths, so sums do not depend on their order.

Words are runs of ASCII letters and digits and of all code points beyond ASCII,
lower-cased. Defined results: a text that is NULL, empty or without words has no
words and a score of 0, mean NULL. Repeated rows count as often as they occur in the corpus
and are scored alike; they share a slice. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import mixed, quoted, row_key, row_slices
from statloom.llm.shingles import NEXT, lowered, words

ALPHA = 0.4
#: No n-gram is handled apart for being frequent any more; the name stays for callers that set it.
HOT = 20_000
#: Bytes of text whose documents make a slice, and for which there is one part of the digests' range at each level.
SLICE = 8 << 20
#: Levels that are asked for at once; of higher ones, one by one, only what can be frequent enough by the level below.
AT_ONCE = 2

ASKED = "n int, part int, slice long, size int, keys binary, times binary, words long"
ANSWERED = "n int, part int, slice long, size int, known binary, counts binary, words long"


def keys(digest: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each n-gram that lies in one document, and its key; a word's key is its digest."""
    key = digest
    for _ in range(1, n):
        key = mixed(key[:-1] * NEXT + key[1:])
    usable = np.ones(len(key), bool)
    for k in range(1, n):
        # A document that begins at word i ends the n-grams that begin 1 to n - 1 words earlier.
        at = first[1:-1] - k
        usable[at[(at >= 0) & (at < len(key))]] = False
    start = np.flatnonzero(usable)
    return start, key[start]


def read_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of each word of all texts, and the first word of each text."""
    digests, firsts, before = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for chunk in texts.chunks:
        data, starts = lowered(chunk)
        for a, b in row_slices(starts):
            own = starts[a : b + 1]
            digest, first = words(data[own[0] : own[-1]], own - own[0])
            digests.append(digest)
            firsts.append(first[1:] + before)
            before += len(digest)
    return np.concatenate(digests), np.concatenate(firsts)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by significance of their bytes, without the bytes that are zero in all."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if data:
        held = np.frombuffer(data, np.uint8).reshape(-1, size)
        out[:, : len(held)] = held.T
    return out.view(np.uint64).ravel()


def part_edges(parts: int) -> np.ndarray:
    """The least digest of each part."""
    return np.array([-((-p << 64) // parts) for p in range(parts)], np.uint64)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys and how often each occurs."""
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return key[at], np.diff(np.append(at, len(key)))


def worth_asking(start: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Which n-grams can be frequent enough: from three words on those whose beginning and end are, by where these start."""
    return known[start] & known[start + 1] if n > AT_ONCE else np.ones(len(start), bool)


def told_counts(told: pa.Table, n: int, key: np.ndarray) -> np.ndarray:
    """The corpus' count of each key of a level, from the answers to a slice; 0 where it is not frequent enough."""
    own = told.filter(pc.equal(told["n"], n)).sort_by("part")
    bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=size.as_py()) for x, size in zip(own["known"], own["size"])]
    counts = [unpacked(x.as_py(), int(each.sum())) for x, each in zip(own["counts"], bits)]
    every = np.concatenate(bits).astype(np.int64)
    every[every > 0] = np.concatenate(counts)
    return every[counted(key)[0]]


def asked(placed: DataFrame, levels: range, parts: int, answers: DataFrame | None = None) -> DataFrame:
    """A row for each slice, level and part of the range: its different keys and how often each occurs in the slice.

    From three words on `answers` has the counts of the levels below, and tells which n-grams need not be asked for.
    """

    def ask(texts: pa.Table, told: pa.Table | None = None) -> pa.Table:
        digest, first = read_words(texts["text"])
        edges = part_edges(parts)
        columns: list[list] = [[] for _ in range(7)]
        known = np.zeros(len(digest) + 1, bool)
        for n in range(min(levels.start, AT_ONCE), levels.stop):
            start, key = keys(digest, first, n)
            worth = worth_asking(start, n, known)
            start, key = start[worth], key[worth]
            if n not in levels:
                known = np.zeros(len(digest) + 1, bool)
                if len(key):
                    known[start] = told_counts(told, n, key) > 0
                continue
            key, times = runs(key)
            bounds = np.append(np.searchsorted(key, edges), len(key))
            for part, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                # Each part of the words gets to know how many words there are.
                if b > a or (n == 1 and len(digest)):
                    steps = np.diff(key[a:b], prepend=edges[part])
                    row = (n, part, texts["slice"][0].as_py(), b - a, packed(steps), packed(times[a:b] - 1), len(digest) if n == 1 else 0)
                    for column, value in zip(columns, row):
                        column.append(value)
        return _table(columns, ASKED)

    if answers is None:
        return placed.groupBy("slice").applyInArrow(lambda texts: ask(texts), ASKED)
    return placed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda texts, told: ask(texts, told), ASKED)


def answered(asks: DataFrame, least: int, parts: int) -> DataFrame:
    """Each row of `asks` with the corpus' counts of its keys; n-grams of two words or more that occur less than `least` times have 0."""

    def answer(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n, part = (x.as_py() for x in group)
        edge = part_edges(parts)[part]
        sizes = rows["size"].to_pylist()
        key = [np.cumsum(unpacked(x.as_py(), size)) + edge for x, size in zip(rows["keys"], sizes)]
        times = [unpacked(x.as_py(), size) + np.uint64(1) for x, size in zip(rows["times"], sizes)]
        which, count = counted(np.concatenate(key), np.concatenate(times))
        if n > 1:
            count[count < least] = 0
        count = count[which]
        ends = np.cumsum(sizes)
        each = [count[end - size : end] for size, end in zip(sizes, ends)]
        known, data = [np.packbits(x > 0).tobytes() for x in each], [packed(x[x > 0]) for x in each]
        total = sum(rows["words"].to_pylist())
        return _table([[n] * len(sizes), [part] * len(sizes), rows["slice"].combine_chunks(), sizes, known, data, [total] * len(sizes)], ANSWERED)

    return asks.groupBy("n", "part").applyInArrow(answer, ANSWERED)


def counted(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted different ones, and the sum of `times` of each of these (its rows, without)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([np.ones(min(len(key), 1), bool), ranked[1:] != ranked[:-1]])
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    if times is None:
        return which, np.diff(np.append(at, len(key)))
    return which, np.add.reduceat(times[order], at) if len(at) else times[:0]


def micro_log(x: np.ndarray | float) -> np.ndarray:
    """The natural logarithm in millionths."""
    return np.floor(np.log(x) * 1e6 + 0.5).astype(np.int64)


def scored(placed: DataFrame, answers: DataFrame, order: int, ids: list[T.StructField]) -> DataFrame:
    """The documents' ids with n_words, n_found and score_micro."""
    names = [field.name for field in ids]
    schema = T.StructType([*ids, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_found", "score_micro"))])

    def solve(texts: pa.Table, told: pa.Table) -> pa.Table:
        digest, first = read_words(texts["text"])
        value, found = np.zeros(len(digest), np.int64), np.zeros(len(digest), np.int64)
        before, frequent = value, np.zeros(len(digest) + 1, bool)
        for n in range(1, order + 1):
            start, key = keys(digest, first, n)
            if not len(start):
                break
            count, worth = np.zeros(len(start), np.int64), worth_asking(start, n, frequent)
            if worth.any():
                count[worth] = told_counts(told, n, key[worth])
            known = count > 0
            log, frequent = np.zeros(len(digest), np.int64), np.zeros(len(digest) + 1, bool)
            log[start[known]], frequent[start[known]] = micro_log(count[known]), True
            last = start + n - 1
            if n == 1:
                value = log - micro_log(float(told["words"][told["n"].index(1).as_py()].as_py()))
            else:
                value[last[~known]] += micro_log(ALPHA)
                value[last[known]] = (log - before)[start[known]]
                found[last[known]] += 1
            before = log
        sums = [np.diff(np.append(0, np.cumsum(x))[first]) for x in (found, value)]
        out = [np.diff(first), *sums]
        return pa.Table.from_arrays([*(texts[c] for c in names), *(pa.array(x) for x in out)], names=schema.names)

    return placed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(solve, schema)


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: column if isinstance(column, pa.Array) else pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)})


def score(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), order: int = 2, least: int = 2) -> DataFrame:
    """(ids, n_words, n_found, score_micro, mean_score): words, n-grams of two words or more that were frequent, and the sum of log scores."""
    size = df.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    slices = -(-size // SLICE) or 1
    own = [F.col(quoted(c)).alias(f"id_{k}") for k, c in enumerate(ids)]
    place = F.pmod(row_key(*ids, text), F.lit(slices)).alias("slice")
    # Asking and scoring read one and the same shuffle, so both take all columns from it.
    placed = df.select(*own, F.col(quoted(text)).alias("text"), place).repartition("slice")
    answers = answered(asked(placed, range(1, min(order, AT_ONCE) + 1), slices), least, slices)
    for n in range(AT_ONCE + 1, order + 1):
        answers = answers.union(answered(asked(placed, range(n, n + 1), slices, answers), least, slices))
    out = scored(placed, answers, order, placed.schema.fields[: len(ids)])
    out = out.select(*[F.col(f"id_{k}").alias(c) for k, c in enumerate(ids)], "n_words", "n_found", "score_micro")
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score_micro") / F.col("n_words") / 1e6))
