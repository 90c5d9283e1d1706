"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is the weighted set of its word shingles, a shingle weighing as much as
it occurs. Similarity is the probability Jaccard of two such sets, which is the
Jaccard similarity where all weights are equal. Every shingle sends exponential
arrivals at the rate of its weight, each to a random register; a register keeps
the shingle of its earliest arrival. Two texts agree in a register with the
probability of their similarity. A text is done once no shingle's next arrival
can come before the latest register, so long texts draw little more than one
number a shingle.

Texts of equal shingles are one content from then on. Contents that agree in all
registers of a band share a bucket, and links are sought in this order, each time
leaving out pairs that are in one class already:

1. each content with the one of its buckets' least members it shares most bands with;
2. each content with the least members of its other buckets;
3. all pairs of a bucket that are still in different classes. Buckets are dealt
   into pairs of blocks of bounded size, in which tasks compare the registers of
   pairs that may reach the threshold, in the first band they share. First each
   content is held against the most alike one of other classes, of all its groups;
   then tasks verify what is left on the sets themselves, and report links that
   join two classes. Pairs never become rows.

Candidates are verified on their whole shingle sets. Classes are the connected
components of the links, found by alternating large and small stars. Groups of
copies shrink to one content with partial sums, a large group of near copies is
linked to its least member, and no list of all partners is ever built.

With 32 bands of 4 a pair of similarity 0.8 shares a bucket but for one time in
2e7, and stage 3 leaves out a pair of that similarity about once in 3e4 (the
registers' share within four deviations).

Defined results: NULL texts are empty. A text without words has no shingles and
is a class by itself; one of fewer words than a shingle has one shingle of all its
words. The class id is the least id in the class, NULL where none has one.
Repeated rows are of one class. An empty table gives an empty table. Extra columns are
kept; taken result names are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import Scratch, fresh, long_texts, mixed, quoted, row_key, row_slices, text_bytes
from statloom.llm.shingles import lowered, shingles

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Members of a block of a bucket.
BLOCK = 1024
#: Deviations of the registers' share below the threshold that are still verified.
SLACK = 4.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """For each text and register, the shingle of the earliest arrival: time in the upper half, shingle in the lower."""
    reg = np.full(count * REGISTERS, FULL)
    alive = np.arange(len(rows))
    time = np.zeros(len(rows))
    done = 0
    while len(alive):
        # Arrivals drawn at once: one for many shingles, more for the few that are left.
        block = max(1, min(64, 20_000 // len(alive)))
        steps = np.arange(done + 1, done + block + 1, dtype=np.uint64) * GOLDEN
        drawn = mixed(hashes[alive][:, None] + steps)
        gaps = -np.log((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[alive][:, None]
        times = time[alive][:, None] + np.cumsum(gaps, axis=1)
        slot = (rows[alive] * REGISTERS)[:, None] + (mixed(drawn) % np.uint64(REGISTERS)).astype(np.int64)
        stamp = times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        key = stamp | (hashes[alive] >> np.uint64(32))[:, None]
        early = key < reg[slot]
        np.minimum.at(reg, slot[early], key[early])
        latest = reg.reshape(count, REGISTERS).max(axis=1) >> np.uint64(32)
        going = (stamp[:, -1] >> np.uint64(32)) <= latest[rows[alive]]
        time[alive] = times[:, -1]
        alive, done = alive[going], done + block
    return reg.reshape(count, REGISTERS)


def similarity(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """The probability Jaccard of two sorted shingle sets; weights of None are ones."""
    union = np.union1d(a, b)
    if wa is None and wb is None:
        return (len(a) + len(b) - len(union)) / len(union) if len(union) else 0.0
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a)] = 1 if wa is None else wa
    y[np.searchsorted(union, b)] = 1 if wb is None else wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # The sum over all j of max(x_j / x_i, y_j / y_i) splits where the ratios pass that of i.
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(y))
    both = np.flatnonzero((x > 0) & (y > 0))
    split = np.searchsorted(ratio, ratio[both], "left")
    return float((1 / (above[split] / x[both] + below[split] / y[both])).sum())


def signed(df: DataFrame, text: str, width: int, content: str, signature: str) -> DataFrame:
    """Add the key of the text's shingles and its registers; both NULL for a text without words."""
    place = df.columns.index(text)
    names = [*df.columns, content, signature]
    schema = T.StructType([*df.schema.fields, T.StructField(content, T.LongType()), T.StructField(signature, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = lowered(batch.column(place))
            for a, b in row_slices(starts):
                own = starts[a : b + 1]
                rows, hashes, weights = shingles(data[own[0] : own[-1]], own - own[0], width)
                low = (registers(rows, hashes, weights, b - a) & np.uint64(0xFFFFFFFF)).astype("<u4")
                first = np.searchsorted(rows, np.arange(b - a))
                some = np.diff(np.append(first, len(rows))) > 0
                keys = np.zeros(b - a, np.uint64)
                if len(rows):
                    terms = mixed(hashes + weights.astype(np.uint64) * GOLDEN)
                    keys[some] = mixed(np.add.reduceat(terms, first[some]))
                made = [pa.array(keys.view(np.int64), mask=~some), pa.array([x.tobytes() if s else None for x, s in zip(low, some)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *made], names=names)

    return long_texts(df).mapInArrow(run, schema)


def near_classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, width: int = SHINGLE, class_id: str = "class_id", stays: str = "stays") -> DataFrame:
    """Each row's id with a key of the row, its class, and whether it is the one that stays of its class."""
    tables = Scratch(df.sparkSession)
    key = row_key(id_col, text)
    base = df.select(F.col(quoted(id_col)).alias("id"), key.alias("rid"), F.col(quoted(text)).alias("text"))
    rows = tables.settle(signed(base, "text", width, "c", "signature").drop("text"))
    contents = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("rid").alias("rid"), F.first("signature").alias("signature"))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * F.lit(4 * ROWS) + F.lit(1), F.lit(4 * ROWS)))
    )
    members = contents.select("c", "rid", "signature", F.posexplode(bands).alias("band", "bucket"))
    heads = members.groupBy("bucket").agg(F.min("c").alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select(F.xxhash64("bucket").alias("k"), "head", "size")
    # Contents of a bucket of two or more; all later steps look at no others.
    shared = tables.settle(members.select("c", "band", "bucket").withColumn("k", F.xxhash64("bucket")).join(heads, "k").drop("k"))
    stars = shared.where("c <> head").groupBy("c", "head").agg(F.count("*").alias("n"))
    sought = shared.select("c").distinct()
    sets = tables.settle(_sets(base, contents.join(sought, "c").select("c", "rid"), width))
    best = stars.groupBy("c").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    links = _verified(tables.settle(best.select(F.col("c").alias("a"), F.col("head").alias("b"))), sets, threshold, tables)
    labels = components(links, tables)
    open_ = _apart(stars.select(F.col("c").alias("a"), F.col("head").alias("b")), labels)
    links, labels = _extended(links, labels, open_, sets, threshold, tables)
    links, labels = _extended(links, labels, _closest(_placed(shared, labels, contents), threshold), sets, threshold, tables)
    more = tables.settle(_linked(_placed(shared, labels, contents), sets, threshold))
    labels = labels if more.isEmpty() else components(_with_links(labels, more), tables)
    told = rows.select("id", "rid", "c").join(labels.select(F.col("node").alias("c"), "label"), "c", "left")
    # A text without words is alone: its row is its class.
    told = told.withColumn("label", F.coalesce("label", "c", F.xxhash64(F.lit("alone"), "rid")))
    kept = told.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("m"), F.count("*").alias("n"))
    kept = kept.select(F.xxhash64("label").alias("k"), F.col("m.id").alias(class_id), F.col("m.rid").alias("head"))
    joined = told.withColumn("k", F.xxhash64("label")).join(kept, "k")
    result = joined.select(F.col("id").alias(id_col), "rid", class_id, (F.col("rid") == F.col("head")).alias(stays))
    kept = Scratch(df.sparkSession).settle(result)
    tables.clear()
    return kept


def drop_near(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """The rows of `df` without those that resemble another: of each class the row of least id stays, once."""
    rid, turn = fresh(df, "_rid", "_turn")
    stays = near_classes(df, text, id_col, threshold, width).where("stays").select(F.col("rid").alias(rid)).distinct()
    kept = df.withColumn(rid, row_key(id_col, text)).join(stays, rid, "left_semi")
    # Rows of one id and text are alike; one of them stays.
    return kept.dropDuplicates([rid]).drop(rid)


def _sets(base: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, h, w): the shingles of each wanted content, sorted, and their weights where some exceed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = lowered(batch.column(1))
            for a, b in row_slices(starts):
                own = starts[a : b + 1]
                rows, hashes, weights = shingles(data[own[0] : own[-1]], own - own[0], width)
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                h = [hashes[x:y].tobytes() for x, y in zip(cut, cut[1:])]
                w = [weights[x:y].astype("<u4").tobytes() if (weights[x:y] > 1).any() else b"" for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h, pa.binary()), pa.array(w, pa.binary())], names=["c", "h", "w"])

    # Repeated rows share a key, and lie together after the join.
    texts = base.select("rid", "text").join(wanted, "rid").dropDuplicates(["rid"]).select("c", "text")
    return long_texts(texts).mapInArrow(run, "c long, h binary, w binary")


def _extended(
    links: DataFrame, labels: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: float, tables: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Links and labels after those of the pairs that are similar have joined them."""
    pairs = tables.settle(pairs.distinct())
    if pairs.isEmpty():
        return links, labels
    more = _verified(pairs, sets, threshold, tables)
    return links.union(more), components(_with_links(labels, more), tables)


def _with_links(labels: DataFrame, more: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """The pairs (a, b) of that similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            good = []
            for ha, wa, hb, wb in zip(*columns[2:]):
                good.append(similarity(*_weighted(ha, wa), *_weighted(hb, wb)) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    right = sets.select(F.col("c").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    left = sets.select(F.col("c").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "wa", "hb", "wb")
    return tables.settle(long_texts(both).mapInArrow(run, "a long, b long"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _placed(shared: DataFrame, labels: DataFrame, contents: DataFrame) -> DataFrame:
    """Members of buckets that hold different classes, dealt into pairs of blocks (i, j), each member beside every block."""
    told = shared.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    split = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.xxhash64("bucket").alias("k"))
    told = told.withColumn("k", F.xxhash64("bucket")).join(split, "k", "left_semi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = told.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "c"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"))
    )
    placed = dealt.select("bucket", "band", "c", "label", "own", F.explode(pairs).alias("p")).select("bucket", "band", "c", "label", "own", "p.i", "p.j")
    return placed.join(contents.select("c", "signature"), "c").select(*MEMBER)


MEMBER = ("bucket", "i", "j", "band", "c", "label", "own", "signature")


def _by_group(members: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`work` on each pair of blocks, which are bounded and follow each other in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group of a batch may go on in the next.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            group = np.stack([table.column(k).to_numpy() for k in ("bucket", "i", "j")])
            edges = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            if len(edges):
                yield work(table.slice(0, int(edges[-1])), [0, *edges.tolist()])
                held = table.slice(int(edges[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield work(table, [0, table.num_rows])

    sorted_ = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return long_texts(sorted_).mapInArrow(run, schema)


def _candidates(table: pa.Table, bounds: list[int], threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row of the group, row, later rows, registers in common): rows of other classes that may reach the threshold.

    A pair is looked at in the first band it shares, so that it comes once, and
    within each block or across the two of its group.
    """
    i, j, band, label, own = (table.column(k).to_numpy() for k in ("i", "j", "band", "label", "own"))
    data, _ = text_bytes(table.column("signature").combine_chunks())
    sig = data.view("<u4").reshape(-1, REGISTERS)
    least = REGISTERS * threshold - SLACK * math.sqrt(REGISTERS * threshold * (1 - threshold))
    for low, high in zip(bounds, bounds[1:]):
        for k in range(low, high - 1):
            other = np.arange(k + 1, high)
            other = other[(label[other] != label[k]) & ((i[low] == j[low]) | (own[other] != own[k]))]
            if len(other):
                equal = sig[other] == sig[k]
                first = equal.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1)
                common = equal.sum(axis=1)
                good = (common >= least) & (first == band[k])
                if good.any():
                    yield low, k, other[good], common[good]


def _closest(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): for each content the most alike of the classes of smaller label that share a bucket with it."""

    def work(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        c, label = table.column("c").to_numpy(), table.column("label").to_numpy()
        best: dict[int, tuple[int, int]] = {}
        for _, k, other, common in _candidates(table, bounds, threshold):
            for o, n in zip(other.tolist(), common.tolist()):
                a, b = (k, o) if label[o] < label[k] else (o, k)
                best[a] = max(best.get(a, (0, 0)), (n, int(c[b])))
        columns = [[int(c[a]) for a in best], [b for _, b in best.values()], [n for n, _ in best.values()]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "n"])

    found = _by_group(members, work, "a long, b long, n long")
    return found.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def _linked(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join classes, found by verifying all candidates of a group but those that it has joined already."""
    names = [*MEMBER]

    def involved(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        rows: set[int] = set()
        for _, k, other, _ in _candidates(table, bounds, threshold):
            rows.update((k, *other.tolist()))
        kept = table.take(pa.array(sorted(rows), pa.int64())).select(names).combine_chunks()
        return pa.RecordBatch.from_arrays([x.combine_chunks() for x in kept.columns], names=names)

    def work(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        c, label = table.column("c").to_numpy(), table.column("label").to_numpy()
        h, w = table.column("h"), table.column("w")
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def root(x: tuple[int, int]) -> tuple[int, int]:
            while x in parent:
                x = parent[x]
            return x

        left, right = [], []
        for low, k, other, common in _candidates(table, bounds, threshold):
            mine = _weighted(h[k].as_py(), w[k].as_py())
            for o in other[np.argsort(-common)].tolist():
                x, y = root((low, int(label[k]))), root((low, int(label[o])))
                if x != y and similarity(*mine, *_weighted(h[o].as_py(), w[o].as_py())) >= threshold:
                    parent[x] = y
                    left.append(int(c[k]))
                    right.append(int(c[o]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    fields = "bucket long, i int, j int, band int, c long, label long, own int, signature binary"
    held = _by_group(members, involved, fields).join(sets, "c").select(*MEMBER, "h", "w")
    return _by_group(held, work, "a long, b long").distinct()


def _weighted(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(h, np.uint64), np.frombuffer(w, "<u4") if w else None


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """(node, label): the least node each node is connected with, for all ends of links but the labels themselves."""
    edges = tables.settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _all_stars(edges):
        # Large stars: all larger neighbours of a node go to its least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.xxhash64("a").alias("k"), "m")
        large = both.where("b > a").withColumn("k", F.xxhash64("a")).join(least, "k").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small stars: all smaller neighbours of a node, and itself, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.withColumn("k", F.xxhash64("a")).join(least.select(F.xxhash64("a").alias("k"), "m"), "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tables.settle(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _all_stars(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, or only edges from larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()
