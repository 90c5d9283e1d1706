"""Growth of decision trees whose nodes and rows are written tables.

A level of large nodes is one job: its split scores stay in Spark, the chosen splits become
a table, and each row is sent to a child by a join with it. Nothing of it passes the driver
but counts of nodes and the root's classes. A node whose rows fit one task leaves that loop: all such nodes
are finished together in one grouped job, each by a builder that makes the same choices
on arrays. So the number of jobs follows the depth of the large nodes only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import session
from statloom.operators.encode import number_rows
from statloom.operators.joins import lookup_join
from statloom.operators.quantile import SINGLE_CHUNK_ROWS, bucket_index, chunk_count, cut_points
from statloom.plans import tree as tree_plan
from statloom.plans.tree import MI_DIGITS, Node, TreeModel

#: Numbers (rows x features and classes) of a node that one task finishes.
LOCAL_CELLS = 400_000
#: Nodes of a tree that may be turned into expressions and arrays of its own.
MODEL_NODES = 500_000
#: Rows that walk down one finished subtree in one task.
WALK_ROWS = 100_000

LEAF, SMALL, LARGE = 0, 1, 2
SPLIT = "mi double, f int, categorical boolean, threshold double, level string, null_left boolean"
TOP_SCHEMA = f"node long, parent long, depth int, counts array<long>, {SPLIT}, left long, right long, finished boolean"
UNDER_SCHEMA = f"root long, place int, parent int, depth int, counts array<long>, {SPLIT}, left int, right int"


@dataclass
class Rules:
    """When a node splits, and by which score."""

    max_samples: int
    max_mutual_inf: float
    criterion: str
    max_depth: int | None
    local_rows: int

    def kind(self, counts: str, depth: str) -> str:
        """SQL: whether a node is a leaf by its counts, small or large."""
        n = f"aggregate({counts}, 0L, (a, c) -> a + c)"
        open_ = f"size(filter({counts}, c -> c > 0)) > 1 AND {n} >= {self.max_samples}"
        if self.max_depth is not None:
            open_ += f" AND {depth} < {self.max_depth}"
        return f"CASE WHEN NOT ({open_}) THEN {LEAF} WHEN {n} <= {self.local_rows} THEN {SMALL} ELSE {LARGE} END"

    def may_split(self, counts: np.ndarray, depth: int) -> bool:
        return (counts > 0).sum() > 1 and counts.sum() >= self.max_samples and (self.max_depth is None or depth < self.max_depth)

    def accepts(self, mi: str) -> str:
        """SQL: whether the best split of a node is good enough."""
        tests = [f"{mi} IS NOT NULL"]
        if self.max_mutual_inf != 0:
            tests.append(f"{mi} >= {session.literal_sql(float(self.max_mutual_inf))}")
        if self.criterion == "full":
            tests.append(f"round({mi}, {MI_DIGITS}) > 0")
        return " AND ".join(tests)

    def takes(self, mi: float) -> bool:
        return not (self.max_mutual_inf != 0 and mi < self.max_mutual_inf) and not (self.criterion == "full" and round(mi, MI_DIGITS) <= 0)


@dataclass
class StoredTree:
    """Large nodes by id (root 1) in `top`; `under` holds the subtrees of finished ones, by root and place (0 is the root)."""

    numeric: list[str]
    categorical: list[str]
    target: str
    classes: list[Any]
    label_type: T.DataType
    top: DataFrame
    under: DataFrame
    #: Kept by growth, so that small trees are read once.
    held: TreeModel | None = None

    @property
    def spark(self) -> SparkSession:
        return self.top.sparkSession

    def nodes(self) -> int:
        """How many nodes there are."""
        return self.top.count() + self.under.where("place > 0").count()

    def model(self, limit: int = MODEL_NODES) -> TreeModel:
        """The tree as one object with nodes numbered level by level; refused for trees of more nodes than `limit`."""
        if self.held is None:
            self.held = self._collected(limit)
        return self.held

    def _collected(self, limit: int) -> TreeModel:
        top = {(r.node, None): r for r in session.bounded_rows(self.top, limit, "nodes of a tree")}
        under = {(r.root, r.place): r for r in session.bounded_rows(self.under, limit, "nodes of a tree")}
        model = TreeModel(self.numeric, self.categorical, self.target, self.classes, self.label_type)
        pending, made = deque([((1, None), None, 0)]), 1
        model.nodes[1] = Node(1, None, 0, [])
        number = 1
        while pending:
            key, parent, depth = pending.popleft()
            row = under.get((key[0], 0)) if key[1] is None and top[key].finished else None
            row = row or (top[key] if key[1] is None else under[key])
            node = Node(number, parent, depth, list(row.counts), row.mi)
            model.nodes[number] = node
            if row.left is not None:
                names = self.categorical if row.categorical else self.numeric
                node.feature, node.categorical, node.threshold, node.level, node.null_left = names[row.f], row.categorical, row.threshold, row.level, row.null_left
                node.left, node.right = made + 1, made + 2
                for child in (row.left, row.right):
                    pending.append((((child, None) if hasattr(row, "node") else (row.root, child)), number, depth + 1))
                made += 2
            number += 1
        return model

    def transform(self, df: DataFrame, output: str = tree_plan.PREDICTION) -> DataFrame:
        """Add the predicted class: by an expression or a batch walk where the tree has at most MODEL_NODES nodes, by joins beyond."""
        if self.held is not None or self.nodes() <= MODEL_NODES:
            return self.model().transform(df, output)
        return self.routed(df, output)

    def routed(self, df: DataFrame, output: str = tree_plan.PREDICTION, depth_output: str | None = None) -> DataFrame:
        """The same by joins with the tree's tables, of trees of any size; `depth_output` adds the depth of a row's leaf."""
        spark, kept = self.spark, df.columns
        tables = session.Tables(spark)
        at, known, place, deep = session.unused_names(df, ["_node", "_walked", "_class", "_depth"])
        numbers, texts, to = session.unused_names(df, ["_numbers", "_texts", "_to"])
        rows = tables.settle(
            df.select(
                "*",
                F.lit(1).cast("long").alias(at),
                F.array(*[session.number(c) for c in self.numeric]).cast("array<double>").alias(numbers),
                F.array(*[F.col(session.quoted(c)) for c in self.categorical]).cast("array<string>").alias(texts),
            )
        )
        done = []
        deepest = self.top.where("left IS NOT NULL").agg(F.max("depth")).first()[0]
        for depth in range(-1 if deepest is None else deepest + 1):
            splits = self.top.where(F.col("depth") == depth).where("left IS NOT NULL")
            moved = tables.settle(_sent(rows, splits, at, numbers, texts, to))
            rows = moved.where(F.col(to).isNotNull()).withColumn(at, F.col(to)).drop(to)
            done.append(moved.where(F.col(to).isNull()).drop(to))
        for part in done:
            rows = rows.unionByName(part)
        leaf = self.top.where("NOT finished").select(F.col("node").alias(at), _majority("counts").alias(place), F.col("depth").alias(deep))
        above = lookup_join(rows, leaf, [at])
        ended = above.where(F.col(place).isNotNull()).drop(at, numbers, texts)
        waiting = tables.settle(above.where(F.col(place).isNull()).drop(place, deep))
        below = self._walked(waiting, at, known, place, deep, numbers, texts)
        both = ended.unionByName(below)
        classes = F.array(*[F.lit(c).cast(self.label_type) for c in self.classes])
        added = [F.get(classes, F.col(place)).alias(output), *([F.col(deep).alias(depth_output)] if depth_output else [])]
        return both.select(*[F.col(session.quoted(c)) for c in kept], *added)

    def _walked(self, rows: DataFrame, at: str, salt: str, place: str, deep: str, numbers: str, texts: str) -> DataFrame:
        """Rows down the finished subtrees; a subtree meets its rows in parts of about WALK_ROWS."""
        (count,) = session.unused_names(rows, ["_parts"])
        parts = rows.groupBy(at).agg(F.ceil(F.count("*") / WALK_ROWS).cast("int").alias(count))
        dealt = lookup_join(rows, parts, [at]).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.col(count)).cast("int")).drop(count)
        copies = lookup_join(self.under, parts.withColumnRenamed(at, "root"), ["root"]).where(F.col(count).isNotNull())
        copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
        names = [c for c in dealt.columns if c not in (at, salt, numbers, texts)]
        schema = T.StructType([*[dealt.schema[c] for c in names], T.StructField(place, T.IntegerType()), T.StructField(deep, T.IntegerType())])

        def walk(rows: pa.Table, nodes: pa.Table) -> pa.Table:
            ended, depths = _walk(nodes.to_pydict(), rows[numbers].to_pylist(), rows[texts].to_pylist())
            return pa.Table.from_arrays([*[rows[c].combine_chunks() for c in names], pa.array(ended, pa.int32()), pa.array(depths, pa.int32())], names=[*names, place, deep])

        return dealt.groupBy(at, salt).cogroup(copies.groupBy("root", "_salt")).applyInArrow(walk, schema)

    def save(self, path: str) -> None:
        """Write the tables below `path`."""
        self.top.write.mode("overwrite").parquet(f"{path}/top")
        self.under.write.mode("overwrite").parquet(f"{path}/under")
        about = T.StructType.fromDDL("target string, numeric array<string>, categorical array<string>").add("classes", T.ArrayType(self.label_type))
        row = (self.target, self.numeric, self.categorical, self.classes)
        session.small_frame(self.spark, [row], about).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredTree:
        about = spark.read.parquet(f"{path}/about")
        row, label_type = about.first(), about.schema["classes"].dataType.elementType
        top, under = (spark.read.parquet(f"{path}/{name}") for name in ("top", "under"))
        return StoredTree(list(row.numeric), list(row.categorical), row.target, list(row.classes), label_type, top, under)


def _majority(counts: str):
    """The class of most rows, the first on a tie."""
    return (F.array_position(F.col(counts), F.array_max(counts)) - 1).cast("int")


def _walk(nodes: dict[str, list], numbers: list[list[float | None]], texts: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The class that each row of features ends in, for one subtree, and the depth of its leaf."""
    size = max(nodes["place"], default=-1) + 1
    order = np.argsort(np.array(nodes["place"], np.int64))
    at = lambda name: [nodes[name][i] for i in order]
    left = np.array([-1 if v is None else v for v in at("left")], np.int64)
    right = np.array([-1 if v is None else v for v in at("right")], np.int64)
    f = np.array([0 if v is None else v for v in at("f")], np.int64)
    textual = np.array([bool(v) for v in at("categorical")], bool)
    null_left = np.array([bool(v) for v in at("null_left")], bool)
    threshold = np.array([np.nan if v is None else v for v in at("threshold")])
    level = np.array([*at("level"), None], dtype=object)[:size]
    counts = at("counts")
    x = np.array([[np.nan if v is None else v for v in row] for row in numbers], float).reshape(len(numbers), -1)
    t = np.empty((len(texts), len(texts[0]) if texts else 0), dtype=object)
    for i, row in enumerate(texts):
        t[i] = row
    place = np.zeros(len(numbers), np.int64)
    active = np.flatnonzero(left[place] >= 0)
    while len(active):
        node = place[active]
        go = np.zeros(len(active), bool)
        for texted in (False, True):
            mine = np.flatnonzero(textual[node] == texted)
            if len(mine):
                value = (t if texted else x)[active[mine], f[node[mine]]]
                missing = np.array([v is None for v in value], bool) if texted else np.isnan(value)
                test = value == level[node[mine]] if texted else value <= threshold[node[mine]]
                go[mine] = np.where(missing, null_left[node[mine]], test.astype(bool))
        place[active] = np.where(go, left[node], right[node])
        active = active[left[place[active]] >= 0]
    depths = np.array(at("depth"), np.int32)
    return np.array([int(np.argmax(counts[p])) for p in place], np.int32), depths[place]


def _sent(rows: DataFrame, splits: DataFrame, at: str, numbers: str, texts: str, to: str = "_to") -> DataFrame:
    """Rows with `to`, the child that a split of their node sends them to; NULL where their node has none."""
    (split,) = session.unused_names(rows, ["_split"])
    table = splits.select(F.col("node").alias(at), F.struct("f", "categorical", "threshold", "level", "null_left", "left", "right").alias(split))
    joined = lookup_join(rows, table, [at])
    s = session.quoted(split)
    test = f"IF({s}.categorical, get({session.quoted(texts)}, {s}.f) = {s}.level, get({session.quoted(numbers)}, {s}.f) <= {s}.threshold)"
    return joined.withColumn(to, F.expr(f"IF(coalesce({test}, {s}.null_left), {s}.left, {s}.right)")).drop(split)


def grow(
    df: DataFrame,
    target: str,
    numeric: list[str],
    categorical: list[str] | None = None,
    classes: list[Any] | None = None,
    max_samples: int = 2,
    max_mutual_inf: float = 0.0,
    criterion: str = "full",
    max_depth: int | None = None,
    max_bins: int | None = None,
    chunk_rows: int = SINGLE_CHUNK_ROWS,
    local_rows: int | None = None,
    folder: str | None = None,
) -> StoredTree:
    """Grow a tree into tables below `folder` (default: a new one in the shared folder).

    A node is a leaf when its best information is below `max_mutual_inf` (if not 0), it
    holds one class, has fewer than `max_samples` rows, or no split helps. `max_bins`
    restricts numeric thresholds to equal-frequency bucket ends. Nodes of at most
    `local_rows` rows are finished in one task each.
    """
    if criterion not in tree_plan.CRITERIA:
        raise ValueError(f"criterion must be one of {tree_plan.CRITERIA}")
    categorical, spark = list(categorical or []), df.sparkSession
    classes = tree_plan.class_labels(df, target) if classes is None else list(classes)
    local_rows = max(1, LOCAL_CELLS // (len(numeric) + len(categorical) + len(classes))) if local_rows is None else local_rows
    rules = Rules(max_samples, max_mutual_inf, criterion, max_depth, local_rows)
    tables = session.Tables(spark, folder)
    # Features go by their place, so that none is called like a column that growth adds.
    xs, ts = [f"x{i}" for i in range(len(numeric))], [f"t{i}" for i in range(len(categorical))]
    placed = df.select(*[F.col(session.quoted(c)).alias(a) for c, a in zip([*numeric, *categorical], [*xs, *ts])], F.col(session.quoted(target)).alias("label"))
    data = tree_plan.prepare(placed, "label", classes, xs, ts)
    if numeric and max_bins is not None:
        data = tree_plan.binned(data, xs, max_bins)
    data = tables.settle(data, "rows")
    by_class = dict(data.groupBy("_y").count().collect())
    counts = [by_class.get(c, 0) for c in range(len(classes))]
    if not sum(counts):
        raise ValueError("no rows with a target to fit")
    open_ = session.small_frame(spark, [(1, None, 0, counts)], "node long, parent long, depth int, counts array<long>")
    open_ = open_.withColumn("kind", F.expr(rules.kind("counts", "depth")))
    kind = open_.first()["kind"]
    chunks, routed = None, data
    if kind == LARGE and numeric and max_bins is None and (pieces := chunk_count(sum(counts), chunk_rows)) > 1:
        chunks = {c: f"_chunk_{i}" for i, c in enumerate(xs)}
        routed = bucket_index(data, cut_points(data, xs, pieces), chunks)
    rows = routed.withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0), "kind": F.lit(kind)})
    growth = _Growth(tables, rules, xs, ts, len(classes), chunks)
    top, small = growth.levels(open_, rows)
    under = growth.finish(small)
    return StoredTree(list(numeric), categorical, target, classes, df.schema[target].dataType, top, under)


@dataclass
class _Growth:
    tables: session.Tables
    rules: Rules
    numeric: list[str]
    categorical: list[str]
    classes: int
    chunks: dict[str, str] | None

    def levels(self, open_: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Split large nodes level by level; all nodes met, and the rows of small ones."""
        made, depth, top, small = 1, 0, [], [rows.where(f"kind = {SMALL}")]
        while True:
            level = self.tables.settle(open_, f"open-{depth}")
            large = level.where(f"kind = {LARGE}")
            count = large.count()
            ended = level.where(f"kind <> {LARGE}").select("node", "parent", "depth", "counts", F.expr(f"kind = {SMALL}").alias("finished"))
            top.append(ended)
            if not count:
                break
            split = self.tables.settle(self._split(large, rows.where(f"kind = {LARGE}"), made, count), f"top-{depth}")
            top.append(split.select(*[c for c in split.columns if not c.endswith("_kind") and not c.endswith("_counts")]))
            found = split.where("left IS NOT NULL")
            made += 2 * found.count()
            sides = [F.struct(F.col(s).alias("node"), F.col(f"{s}_counts").alias("counts"), F.col(f"{s}_kind").alias("kind")) for s in ("left", "right")]
            open_ = found.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.inline(F.array(*sides))).select("node", "parent", "depth", "counts", "kind")
            rows = self.tables.settle(self._route(rows.where(f"kind = {LARGE}"), found), f"rows-{depth}")
            small.append(rows.where(f"kind = {SMALL}"))
            depth += 1
        merged = top[0]
        for part in top[1:]:
            merged = merged.unionByName(part, allowMissingColumns=True)
        wanted = T.StructType.fromDDL(TOP_SCHEMA)
        for field in wanted.fields:
            if field.name not in merged.columns:
                merged = merged.withColumn(field.name, F.lit(None).cast(field.dataType))
        return merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields]), small

    def _split(self, large: DataFrame, rows: DataFrame, made: int, count: int) -> DataFrame:
        """Large nodes with their split, their children's ids, counts and kinds; NULLs where they end."""
        best = self._best(rows, count)
        accepted = f"({self.rules.accepts('mi')})"
        joined = large.drop("kind").join(best.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").drop("n_").withColumn("right_part", F.expr("zip_with(whole, left_part, (w, l) -> w - l)"))
        total = lambda a: f"aggregate({a}, 0L, (s, c) -> s + c)"
        sided = joined.withColumn("null_left", F.expr(f"{total('left_part')} >= {total('right_part')}"))
        missing = "zip_with(counts, whole, (n, w) -> n - w)"
        grown = lambda side, own: F.expr(f"IF({own}, zip_with({side}_part, {missing}, (a, m) -> a + m), {side}_part)")
        full = sided.withColumns({"left_counts": grown("left", "null_left"), "right_counts": grown("right", "NOT null_left")})
        split, ends = full.where(accepted), full.where(f"NOT coalesce({accepted}, false)")
        numbered = number_rows(split, ["node"], "number")
        first = F.lit(made) + 2 * F.col("number") - 1
        numbered = numbered.withColumns({"left": first, "right": first + 1, **{f"{s}_kind": F.expr(self.rules.kind(f"{s}_counts", "depth + 1")) for s in ("left", "right")}})
        kept = ["node", "parent", "depth", "counts", "mi"]
        added = ["f", "categorical", "threshold", "level", "null_left", "left", "right", "left_counts", "right_counts", "left_kind", "right_kind"]
        both = numbered.select(*kept, *added).unionByName(ends.select(*kept), allowMissingColumns=True)
        return both.withColumn("finished", F.lit(False))

    def _best(self, rows: DataFrame, count: int) -> DataFrame:
        """(node, f, categorical, threshold, level, mi, left_part, whole): the best split of each node."""
        parts = []
        if self.numeric:
            counted = tree_plan.value_counts(rows, self.numeric, self.classes, self.chunks)
            found = tree_plan.best_splits(tree_plan.numeric_scores(counted, self.classes, self.rules.criterion, self.chunks is not None))
            parts.append(found.select("node", F.lit(False).alias("categorical"), "f", F.col("x").alias("threshold"), F.lit(None).cast("string").alias("level"), "mi", F.col("left").alias("left_part"), "whole"))
        if self.categorical:
            counted = tree_plan.value_counts(rows, self.categorical, self.classes)
            found = tree_plan.best_splits(tree_plan.categorical_scores(counted, self.classes, self.rules.criterion, count * len(self.categorical)))
            parts.append(found.select("node", F.lit(True).alias("categorical"), "f", F.lit(None).cast("double").alias("threshold"), F.col("x").alias("level"), "mi", F.col("left").alias("left_part"), "whole"))
        if len(parts) == 1:
            return parts[0]
        order = F.struct((-F.round("mi", MI_DIGITS)).alias("score"), "categorical", "f")
        rest = F.struct("f", "categorical", "threshold", "level", "mi", "left_part", "whole")
        return parts[0].unionByName(parts[1]).groupBy("node").agg(F.min_by(rest, order).alias("s")).select("node", "s.*")

    def _route(self, rows: DataFrame, splits: DataFrame) -> DataFrame:
        """Rows of split nodes in their children, with the child's kind; rows of leaves are done with."""
        numbers, texts = F.array(*[F.col(session.quoted(c)) for c in self.numeric]).cast("array<double>"), F.array(*[F.col(session.quoted(c)) for c in self.categorical]).cast("array<string>")
        kinds = splits.select(F.explode(F.array(*[F.struct(F.col(s).alias("node"), F.col(f"{s}_kind").alias("kind")) for s in ("left", "right")])).alias("c")).select("c.*")
        sent = _sent(rows.drop("kind").withColumns({"_numbers": numbers, "_texts": texts}), splits, "node", "_numbers", "_texts").drop("_numbers", "_texts", "node")
        moved = sent.where("_to IS NOT NULL").withColumnRenamed("_to", "node").withColumn("depth", F.col("depth") + 1)
        return lookup_join(moved, kinds.where(f"kind <> {LEAF}"), ["node"]).where("kind IS NOT NULL")

    def finish(self, small: list[DataFrame]) -> DataFrame:
        """The subtrees of all small nodes, each grown in one task."""
        names = [*self.numeric, *self.categorical]
        held = [part.select("node", "depth", "_y", *[F.col(session.quoted(c)) for c in names]) for part in small]
        rows = held[0]
        for part in held[1:]:
            rows = rows.unionByName(part)
        rules, classes, numbers, texts = self.rules, self.classes, len(self.numeric), len(self.categorical)
        columns_ = T.StructType.fromDDL(UNDER_SCHEMA).names

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            columns = [frame.iloc[:, 3 + i] for i in range(numbers + texts)]
            x = [c.to_numpy(dtype=float) for c in columns[:numbers]]
            t = [c.to_numpy(dtype=object) for c in columns[numbers:]]
            grown = Local(rules, classes, x, t, frame["_y"].to_numpy()).grow(int(frame["depth"].iloc[0]))
            return pd.DataFrame([(int(frame["node"].iloc[0]), *row) for row in grown], columns=columns_, dtype=object)

        return self.tables.settle(rows.groupBy("node").applyInPandas(build, UNDER_SCHEMA), "under")


class Local:
    """A subtree grown on arrays, by the same scores, ties and rules as the levels."""

    def __init__(self, rules: Rules, classes: int, numbers: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray) -> None:
        self.rules, self.classes, self.numbers, self.y = rules, classes, numbers, y
        self.levels, self.codes = [], []
        for column in texts:
            found = sorted({v for v in column if v is not None})
            place = {v: i for i, v in enumerate(found)}
            self.levels.append(found)
            self.codes.append(np.array([-1 if v is None else place[v] for v in column], np.int64))

    def grow(self, depth: int) -> Iterator[tuple]:
        """Rows of UNDER_SCHEMA without the root's id, level by level."""
        pending, made, place = deque([(np.arange(len(self.y)), None, depth)]), 1, 0
        while pending:
            rows, parent, depth = pending.popleft()
            counts = np.bincount(self.y[rows], minlength=self.classes)
            best = self.best(rows) if self.rules.may_split(counts, depth) else None
            split = (None,) * 5
            left = right = None
            if best is not None and self.rules.takes(best[0]):
                mi, categorical, f, value = best
                if categorical:
                    codes = self.codes[f][rows]
                    missing, go = codes < 0, codes == value
                else:
                    x = self.numbers[f][rows]
                    missing = np.isnan(x)
                    with np.errstate(invalid="ignore"):
                        go = x <= value
                null_left = bool((go & ~missing).sum() >= (~go & ~missing).sum())
                go = np.where(missing, null_left, go)
                split = (f, categorical, None if categorical else float(value), self.levels[f][value] if categorical else None, null_left)
                left, right = made, made + 1
                pending += [(rows[go], place, depth + 1), (rows[~go], place, depth + 1)]
                made += 2
            yield (place, parent, depth, counts.tolist(), None if best is None else float(best[0]), *split, left, right)
            place += 1

    def best(self, rows: np.ndarray) -> tuple[float, bool, int, Any] | None:
        """(mi, categorical, feature, value) of the best split, None if no value has rows on both sides."""
        y, found = self.y[rows], None
        for categorical, columns in ((False, self.numbers), (True, self.codes)):
            for f, column in enumerate(columns):
                values = column[rows]
                present = values >= 0 if categorical else ~np.isnan(values)
                kinds, at = np.unique(values[present], return_inverse=True)
                if len(kinds) < 2:
                    continue
                here = np.zeros((len(kinds), self.classes))
                np.add.at(here, (at, y[present]), 1)
                left = here if categorical else np.cumsum(here, axis=0)
                scores = self._scores(left, here.sum(axis=0), here)
                inside = np.flatnonzero(left.sum(axis=1) < here.sum())
                rounded = np.round(scores[inside], MI_DIGITS)
                first = inside[int(np.argmax(rounded))]
                if found is None or round(scores[first], MI_DIGITS) > round(found[0], MI_DIGITS):
                    found = (scores[first], categorical, f, int(kinds[first]) if categorical else kinds[first])
        return found

    def _scores(self, left: np.ndarray, whole: np.ndarray, here: np.ndarray) -> np.ndarray:
        """`split_score` of every candidate."""
        n, nl = whole.sum(), left.sum(axis=1)
        if self.rules.criterion == "partial":
            with np.errstate(divide="ignore", invalid="ignore"):
                terms = left / n * np.log2((left / n) / (whole / n * (nl / n)[:, None]))
            return np.where(here > 0, terms, 0.0).sum(axis=1)
        sides = _xlog2x(left).sum(axis=1) + _xlog2x(whole - left).sum(axis=1)
        return (sides - _xlog2x(nl) - _xlog2x(n - nl) - _xlog2x(whole).sum() + _xlog2x(n)) / n


def _xlog2x(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    return np.where(v > 0, v * np.log2(np.where(v > 0, v, 1.0)), 0.0)
