"""Tables that are replaced and updated as a whole: readers see one version or the next, never a part.

A version is written to a folder of its own, and a line of an append-only log says which
folder holds which bucket of rows; what no line names does not exist. Rows are dealt to
buckets by a hash of their keys, so an update or a removal rewrites only the buckets that its
keys fall in, each by a join inside it.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import bounded_rows, quoted, small_frame, unused_names

MOST_BUCKETS = 10_000


class Log:
    """Lines of text below a folder, each written once to a folder of its own, so that writers cannot clash."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, **line: Any) -> dict[str, Any]:
        line = {"at": time.time_ns(), "token": str(uuid.uuid4()), **line}
        text = small_frame(self.spark, [(json.dumps(line, default=str),)], "value string")
        text.coalesce(1).write.mode("error").text(f"{self.folder}/{line['token']}")
        return line

    def lines(self) -> list[dict[str, Any]]:
        """All lines, oldest first."""
        try:
            rows = self.spark.read.text(f"{self.folder}/*").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        return sorted((json.loads(r.value) for r in rows), key=lambda x: (x["at"], x["token"]))


class PublishedTable:
    """A table of unique keys below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def _latest(self) -> dict[str, Any]:
        lines = self.log.lines()
        if not lines:
            raise KeyError(f"nothing was published in {self.folder}")
        return lines[-1]

    def _bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, str]:
        (bucket,) = unused_names(df, ["_bucket"])
        return df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in keys]), F.lit(buckets)).cast("int")), bucket

    def _stage(self, df: DataFrame, bucket: str, sorted_by: list[str]) -> str:
        """Write rows, a folder a bucket, where nobody reads yet."""
        version = str(uuid.uuid4())
        named = df.withColumnRenamed(bucket, "bucket_of_row")
        dealt = named.repartition("bucket_of_row").sortWithinPartitions("bucket_of_row", *[quoted(k) for k in sorted_by])
        dealt.write.partitionBy("bucket_of_row").parquet(f"{self.folder}/versions/{version}")
        return version

    def write(self, df: DataFrame, keys: list[str], buckets: int = 16) -> "PublishedTable":
        """Publish `df` in place of what was there."""
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
        if "bucket_of_row" in {c.lower() for c in df.columns}:
            raise ValueError("column 'bucket_of_row' is the table's own")
        dealt, bucket = self._bucketed(df, keys, buckets)
        version = self._stage(dealt, bucket, keys)
        self._publish(keys, buckets, df, {str(b): version for b in self._held(version)})
        return self

    def _held(self, version: str) -> list[int]:
        try:
            found = self.spark.read.parquet(f"{self.folder}/versions/{version}")
        except AnalysisException:
            return []
        return sorted(r[0] for r in bounded_rows(found.select("bucket_of_row").distinct(), MOST_BUCKETS, "buckets"))

    def _publish(self, keys: list[str], buckets: int, like: DataFrame, places: dict[str, str]) -> None:
        self.log.append(keys=keys, buckets=buckets, schema=like.schema.jsonValue(), places=places)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows last published, or those of some buckets."""
        from pyspark.sql.types import StructType

        latest = self._latest()
        schema = StructType.fromJson(latest["schema"])
        paths = [f"{self.folder}/versions/{v}/bucket_of_row={b}" for b, v in latest["places"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, changes: DataFrame) -> "PublishedTable":
        """Rows of known keys take the values of `changes` (which may have some of the columns), new keys are added."""
        return self._rewrite(changes, remove=False)

    def remove(self, keys: DataFrame) -> "PublishedTable":
        """Rows of these keys go."""
        return self._rewrite(keys, remove=True)

    def _rewrite(self, changes: DataFrame, remove: bool) -> "PublishedTable":
        latest = self._latest()
        keys, buckets = latest["keys"], latest["buckets"]
        told, bucket = self._bucketed(changes, keys, buckets)
        touched = sorted(r[0] for r in bounded_rows(told.select(bucket).distinct(), buckets, "buckets"))
        old = self.read(touched)
        unknown = set(changes.columns) - set(old.columns)
        if not remove and unknown:
            raise ValueError(f"columns {sorted(unknown)} are not in the table")
        same = [F.col(f"o.{quoted(k)}").eqNullSafe(F.col(f"c.{quoted(k)}")) for k in keys]
        if remove:
            new = old.alias("o").join(changes.select(*keys).distinct().alias("c"), same, "left_anti")
        else:
            (mark,) = unused_names(changes, ["_changed"])
            met = old.alias("o").join(changes.withColumn(mark, F.lit(True)).alias("c"), same, "full")
            value = lambda c: F.when(F.col(f"c.{mark}"), F.col(f"c.{quoted(c)}")).otherwise(F.col(f"o.{quoted(c)}"))
            kinds = {f.name: f.dataType for f in old.schema.fields}
            new = met.select(*[(value(c) if c in changes.columns else F.col(f"o.{quoted(c)}")).cast(kinds[c]).alias(c) for c in old.columns])
        dealt, bucket = self._bucketed(new, keys, buckets)
        version = self._stage(dealt, bucket, keys)
        places = {b: v for b, v in latest["places"].items() if int(b) not in touched}
        self._publish(keys, buckets, old, {**places, **{str(b): version for b in self._held(version)}})
        return self
