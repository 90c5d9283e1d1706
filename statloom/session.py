"""Session helpers shared by all modules."""

from __future__ import annotations

import logging
import math
import os
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

logger = logging.getLogger("statloom")

LOG_LEVELS = {"INFO": logging.INFO, "DEBUG": logging.DEBUG, "NONE": logging.CRITICAL + 1}


def local_session(app: str = "statloom", cpus: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench, with `shared` as its checkpoint folder; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 8
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def set_log_level(level: str) -> None:
    """Accept INFO, DEBUG or NONE and refuse anything else."""
    if level not in LOG_LEVELS:
        raise ValueError(f"log level must be one of {sorted(LOG_LEVELS)}, not {level!r}")
    logger.setLevel(LOG_LEVELS[level])


def as_frame(spark: SparkSession, table: DataFrame | str) -> DataFrame:
    """A DataFrame as given, or the table or view of that name."""
    return spark.table(table) if isinstance(table, str) else table


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Fitted parameters as a local relation, which needs no Python worker to be read."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    arrays = [pa.array(values, type=f.type) for values, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="statloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Pin `df` in reliable storage so that lost executors cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written below a folder that all executors share, each read back with a known size."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/statloom-{uuid.uuid4()}"
        self.written: list[str] = []

    def settle(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write `df` and read it back."""
        path = f"{self.folder}/{name or len(self.written)}"
        df.write.mode("overwrite").parquet(path)
        self.written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Empty what was written so far."""
        for path in self.written:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.written = []


def number(column: str | Column) -> Column:
    """A numeric column as DOUBLE with NaN turned into NULL."""
    value = (F.col(quoted(column)) if isinstance(column, str) else column).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def number_sql(column: str) -> str:
    """The same as SQL text."""
    return f"nanvl(CAST({quoted(column)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def literal_sql(value: float) -> str:
    """A number as an exact DOUBLE literal; NaN stands for a missing value."""
    if math.isnan(value):
        return "CAST(NULL AS DOUBLE)"
    if math.isinf(value):
        return f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
    return f"({float(value)!r}D)"


def known(columns: list[str | Column]) -> Column:
    """All columns have a value.

    Written as one IS NOT NULL per column: a single predicate over many
    computed columns makes the optimizer derive it once per subset of them.
    """
    tests = [(F.col(quoted(c)) if isinstance(c, str) else c).isNotNull() for c in columns]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def quoted(name: str) -> str:
    """A column name safe to use in an expression string."""
    return "`" + name.replace("`", "``") + "`"


def unused_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, with underscores in front of those that columns of `df` have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def is_categorical(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def split_features(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of `df`, by declared type."""
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, T.StringType):
            categorical.append(field.name)
    return numeric, categorical


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result that must be small; refuse it, whole, when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
