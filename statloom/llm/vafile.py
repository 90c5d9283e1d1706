"""Exact search for the largest inner products by vector approximations.

Each component of a shard's vectors is quantised to one of `CELLS` cells between
the least and the largest value that the component has there. A query reads the
cells first: the middle and the half width of a vector's cells bound its score
from above. Exact vectors are then read in the order of that bound, in rounds
that grow, until the worst of the best `k` scores exceeds the bound of the next
vector; only then is the result certain.

Components are turned into whole numbers, floor(scale * x), and scores are exact
whole numbers. Where they could exceed 2 ** 53 they are summed without bound and,
beyond the range of a long, end at its limits. See `vectors` for the blocks, and
for what becomes of NULLs, copies and ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm import vectors as V
from statloom.llm.common import quoted

CELLS = 64
#: Vectors read exactly in the first round, for each answer.
FIRST_READ = 8
LARGEST = (1 << 63) - 1


class Approximations:
    """Cells of vectors, a byte a component."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.low = vectors.min(axis=0)
        self.width = np.maximum((vectors.max(axis=0) - self.low) / CELLS, 1e-300)
        self.cells = np.clip((vectors - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a query and a vector exceeds this."""
        # The middle of a cell is low + (cell + 1/2) * width, and no component is further from it than width / 2.
        scaled = queries * self.width
        middle = (queries @ self.low + 0.5 * scaled.sum(axis=1))[:, None] + scaled @ self.cells.T.astype(np.float64)
        half = 0.5 * np.abs(scaled).sum(axis=1)
        size = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.low + CELLS * self.width))
        # Room for the rounding of the sums.
        return middle + (half + 1e-9 * size + 1e-6)[:, None]


def _certain(queries: np.ndarray, vectors: np.ndarray, answers: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    bounds = Approximations(vectors).bounds(queries)
    n, open_ = len(vectors), np.arange(len(queries))
    read = min(n, FIRST_READ * answers)
    while len(open_):
        own = bounds[open_]
        if read < n:
            places = np.argpartition(-own, read, axis=1)
            places, following = places[:, :read], np.take_along_axis(own, places[:, read : read + 1], 1)[:, 0]
        else:
            places, following = np.broadcast_to(np.arange(n), (len(open_), n)), np.full(len(open_), -np.inf)
        scores = np.empty(places.shape)
        for i, q in enumerate(open_):
            scores[i] = vectors[places[i]] @ queries[q]
        worst = np.partition(scores, -answers, axis=1)[:, -answers] if answers <= read else np.full(len(open_), -np.inf)
        # Equal scores go to the smaller id, so a bound that only equals the worst score is still read.
        done = worst > following
        for i in np.flatnonzero(done | (read == n)):
            best = scores[i] >= worst[i]
            yield int(open_[i]), places[i][best], scores[i][best].astype(np.int64)
        if read == n:
            return
        open_, read = open_[~done], min(n, 4 * read)


def _unbounded(queries: np.ndarray, vectors: np.ndarray, answers: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    for i, q in enumerate(queries.tolist()):
        q = [int(x) for x in q]
        scores = np.array([max(-LARGEST - 1, min(LARGEST, sum(a * b for a, b in zip(q, v)))) for v in whole], np.int64)
        worst = np.sort(scores)[-answers] if answers <= len(scores) else -LARGEST - 1
        best = np.flatnonzero(scores >= worst)
        yield i, best, scores[best]


def largest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, shard: int = V.SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products of whole-number vectors for each query."""

    def find(query_ids: np.ndarray, asked: np.ndarray, ids: list[np.ndarray], vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        size = float(np.abs(asked).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        # One answer more than asked, as the query itself may be among them.
        return (_certain if size < 2.0**53 else _unbounded)(asked, vectors, k + 1)

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        # floor() gives a long; doubles beyond 2 ** 52 are whole already.
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    v = F.transform(F.col(quoted(vector)), whole)
    rows, asked = (x.where(V.usable(vector)).select(F.col(quoted(id_col)).alias("id"), v.alias("v")) for x in (df, queries))
    return V.search(rows, asked, "id", "v", k, find, "long", descending=True, shard=shard)
