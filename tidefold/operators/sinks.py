"""Writers of a run's output, chunk by chunk."""

from __future__ import annotations

from types import TracebackType
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineIOError


class OutputWriter(Protocol):
    def initialize(self, variables: list[str]) -> None: ...
    def append(self, chunk: DataFrame) -> None: ...
    def finalize(self) -> DataFrame | None: ...
    def close(self) -> None: ...


class _Writer:
    def __init__(self) -> None:
        self.variables: list[str] | None = None

    def initialize(self, variables: list[str]) -> None:
        self.variables = list(variables)

    def _check(self, chunk: DataFrame) -> DataFrame:
        if self.variables is None:
            raise EngineIOError("append before initialize")
        if missing := [v for v in self.variables if v not in chunk.columns]:
            raise EngineIOError(f"the chunk lacks {', '.join(missing)}")
        keys = [c for c in chunk.columns if c in ("E", "T", "F", "C", "Z", "Y", "X", "t_idx")]
        return chunk.select(*keys, *self.variables)

    def close(self) -> None:
        self.variables = None

    def __enter__(self):
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()


class MemoryWriter(_Writer):
    """Keeps chunks as lazy tables; one table at the end, none without variables or chunks."""

    def __init__(self) -> None:
        super().__init__()
        self.chunks: list[DataFrame] = []

    def append(self, chunk: DataFrame) -> None:
        self.chunks.append(self._check(chunk))

    def finalize(self) -> DataFrame | None:
        out = None
        for c in self.chunks if self.variables else []:
            out = c if out is None else out.unionByName(c)
        return out


class DiskWriter(_Writer):
    """Parquet partitioned by time bucket, replaced at the first chunk and appended to after; floats if asked."""

    def __init__(self, spark: SparkSession, path: str, bucket_steps: int = 365, single: bool = False):
        super().__init__()
        self.spark, self.path, self.bucket_steps, self.single, self.begun = spark, path, bucket_steps, single, False

    def append(self, chunk: DataFrame) -> None:
        rows = self._check(chunk).withColumn("t_bucket", F.floor(F.col("t_idx") / self.bucket_steps).cast("int"))
        if self.single:
            rows = rows.withColumns({v: F.col(v).cast("float") for v in self.variables or [] if dict(rows.dtypes)[v] == "double"})
        rows.write.mode("append" if self.begun else "overwrite").partitionBy("t_bucket").parquet(self.path)
        self.begun = True

    def finalize(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self.begun else None


class NullWriter(_Writer):
    """Runs every chunk and keeps nothing."""

    def append(self, chunk: DataFrame) -> None:
        self._check(chunk).write.format("noop").mode("overwrite").save()

    def finalize(self) -> DataFrame | None:
        return None


def build_writer(spark: SparkSession, variables: list[str], path: str | None = None) -> MemoryWriter | DiskWriter:
    writer = DiskWriter(spark, path) if path else MemoryWriter()
    writer.initialize(variables)
    return writer
