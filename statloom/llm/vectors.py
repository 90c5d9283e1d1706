"""Searches of many queries against many vectors, in blocks; shared by the two searches.

Candidates are dealt by a hash of their id into shards of about `shard` rows, and
shards and queries into parts. A task meets the shards of one part with the
queries of another: it holds those queries, whose numbers are bounded, reads one
shard after the other as plain rows in the order of the shards, and keeps the best
`k` of each query so far. So its memory is bounded whatever the tables hold, and a
row is moved only as often as the other side has parts. The best of all tasks are
taken per query. Equal vectors of a shard are one vector with its `k + 1` least ids,
which is all that an answer of `k` without the query's own can need; a vector that a
third of all rows share costs no more than another.

Only vectors of equal length meet. Rows whose id or vector is NULL, or whose vector
is empty or holds NULL or non-finite components, take no part. Rows that share
an id are no candidates of a query with that id, and one query: that of the least
vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import quoted

#: Rows of a shard, and queries that meet it at a time.
SHARD, GROUP = 8192, 2048
#: Numbers of the queries that a task holds, and shards that a part of them has at most.
HELD_NUMBERS, PART_SHARDS = 1 << 23, 64

#: (query ids, queries, candidate ids, candidates) -> for each query, rows of candidates and their scores.
Search = Callable[[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def usable(vector: str) -> Column:
    """The vector is there, and so are all its components, which are finite."""
    v = F.col(quoted(vector))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, find: Callable, score_type: str, descending: bool, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `k` that `find` reports for each query, ties to the smaller id.

    `find(query_ids, queries, candidate_ids, candidates)` yields (place of the
    query, candidate places, scores); a candidate place is that of a distinct vector.
    """
    keep = F.col(quoted(id_col)).isNotNull() & usable(vector)
    pair = [F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")]
    rows = rows.where(keep).select(*pair)
    queries = queries.where(keep).select(*pair).groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, -(-rows.count() // shard))
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    query_parts = max(1, -(-asked["n"] * (asked["dim"] or 0) // HELD_NUMBERS))
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_parts = min(shards, max(-(-wanted // query_parts), -(-shards // PART_SHARDS)))

    # Queries have shard -1, so that they come before the shards of their length.
    s = F.pmod(F.xxhash64(F.lit("s"), "id"), F.lit(shards)).cast("int")
    g = F.pmod(F.xxhash64(F.lit("g"), "id"), F.lit(query_parts)).cast("int")
    dealt = rows.select((s % row_parts).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("j"), s.alias("s"), "id", "v")
    held = queries.select(F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))).alias("i"), g.alias("j"), F.lit(-1).alias("s"), "id", "v")
    both = held.unionByName(dealt).select((F.col("i") * query_parts + F.col("j")).alias("part"), F.size("v").alias("dim"), "s", "id", "v")
    met = both.repartitionById(row_parts * query_parts, F.col("part")).sortWithinPartitions("part", "dim", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for (part, dim, s), ids, vectors in _runs(batches):
            if s < 0:
                if best is not None:
                    yield best.answers()
                best = _Best((part, dim), ids, vectors, k, find, descending, group)
            elif best is not None and best.key == (part, dim):
                best.meet(ids, vectors)
        if best is not None:
            yield best.answers()

    found = met.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = [F.desc("score") if descending else F.asc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
    """((part, length, shard), ids, vectors) of rows that follow each other with these three, across batches."""
    now, ids, vectors = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            key = tuple(int(x) for x in keys[start])
            if key != now:
                if now is not None:
                    yield now, np.concatenate(ids), np.concatenate(vectors)
                now, ids, vectors = key, [], []
            ids.append(batch.column(3).slice(start, end - start).to_numpy())
            vectors.append(batch.column(4).slice(start, end - start).flatten().to_numpy().reshape(-1, key[1]))
    if now is not None:
        yield now, np.concatenate(ids), np.concatenate(vectors)


class _Best:
    """Queries of one length and part, and the best `k` answers of each so far."""

    def __init__(self, key: tuple[int, int], ids: np.ndarray, queries: np.ndarray, k: int, find: Search, descending: bool, group: int) -> None:
        self.key, self.ids, self.queries, self.k, self.find, self.descending, self.group = key, ids, queries, k, find, descending, group
        self.query, self.vec_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64 if descending else np.float64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a shard."""
        # Equal vectors are taken together; their least ids are all that can be among the best.
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]))
        least = [x[: self.k + 1] for x in np.split(ids, new[1:])]
        query, vec_id, score = [], [], []
        for g in range(0, len(self.ids), self.group):
            asked = self.ids[g : g + self.group]
            for i, places, scores in self.find(asked, self.queries[g : g + self.group], least, vectors[new], self.k):
                own = [(v, s) for p, s in zip(places.tolist(), scores.tolist()) for v in least[p].tolist() if v != asked[i]]
                own.sort(key=lambda x: (-x[1] if self.descending else x[1], x[0]))
                query += [g + i] * min(self.k, len(own))
                vec_id += [v for v, _ in own[: self.k]]
                score += [s for _, s in own[: self.k]]
        query = np.concatenate([self.query, np.array(query, np.int64)])
        vec_id = np.concatenate([self.vec_id, np.array(vec_id, np.int64)])
        score = np.concatenate([self.score, np.array(score, self.score.dtype)])
        # The complement reverses the order of all longs.
        order = np.lexsort((vec_id, ~score if self.descending else score, query))
        query = query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.vec_id, self.score = query[kept], vec_id[order][kept], score[order][kept]

    def answers(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec_id), pa.array(self.score)], names=["query_id", "vec_id", "score"])
