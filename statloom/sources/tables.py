"""Reading, naming and writing tables."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.session import quoted, small_frame

# JDBC URL forms and driver classes of the supported databases.
JDBC = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; without a schema the types are inferred in an extra pass."""
    reader = spark.read.option("header", True)
    return reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)


def jdbc_options(
    kind: str,
    database: str,
    table: str,
    host: str = "localhost",
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
) -> dict[str, str]:
    """Options for Spark's JDBC source; the driver jar is the user's to supply."""
    if kind not in JDBC:
        raise ValueError(f"database kind must be one of {sorted(JDBC)}, not {kind!r}")
    url, driver, default_port = JDBC[kind]
    options = {
        "url": url.format(host=host, port=port or default_port, database=database),
        "driver": driver,
        "dbtable": table,
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 16,
) -> DataFrame:
    """A database table, read in parallel ranges of `partition_column` when it is given."""
    reader = spark.read.format("jdbc").options(**options)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "overwrite") -> None:
    df.write.format("jdbc").options(**options).mode(mode).save()


def register(spark: SparkSession, data: DataFrame | pd.DataFrame, name: str, saved: bool = False) -> DataFrame:
    """Name a frame as a table, replacing an older one; `saved` also stores it."""
    frame = spark.createDataFrame(data) if isinstance(data, pd.DataFrame) else data
    if saved:
        frame.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    frame.createOrReplaceTempView(name)
    return frame


def materialise(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Store a query's result as a table of that (qualified) name, replacing an older one."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(query).write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same columns and types."""
    return df.where(F.lit(False))


def drop(spark: SparkSession, name: str) -> None:
    """Remove a temporary view or a stored table of that name, if there is one."""
    if not spark.catalog.dropTempView(name):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def append_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """`df` and the given rows, which follow its column order."""
    return df.unionByName(small_frame(df.sparkSession, rows, df.schema))


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All rows, of all or the named columns."""
    return df if columns is None else df.select(*[F.col(quoted(c)) for c in columns])


def lookup(df: DataFrame, id_col: str, value: Any) -> DataFrame:
    """The rows with that id."""
    return df.where(F.col(quoted(id_col)) == F.lit(value))


def column_types(df: DataFrame) -> DataFrame:
    """Column names, types and whether a column counts as categorical."""
    rows = [
        (n, f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType))
        for n, f in enumerate(df.schema.fields, start=1)
    ]
    return small_frame(df.sparkSession, rows, "position int, name string, type string, categorical boolean")


def tables_like(spark: SparkSession, pattern: str) -> list[str]:
    """Names of tables and views that match a pattern such as `*model`."""
    return sorted(t.name for t in spark.catalog.listTables(pattern=pattern))


def run(spark: SparkSession, statement: str, as_pandas: bool = False) -> DataFrame | pd.DataFrame:
    """Run a SQL statement; the result stays distributed unless pandas is asked for."""
    result = spark.sql(statement)
    return result.toPandas() if as_pandas else result


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A model's text, one line per row, in a folder of text files."""
    small_frame(spark, [(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
