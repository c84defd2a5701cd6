"""Tables as Parquet files of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.kinds import Kind, kind_of
from sparkloom.plans.select import Source, from_


class ParquetFolder:
    """``name`` is ``<folder>/<name>.parquet``. Filters and columns of a query reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def source(self, name: str) -> Source:
        """The table with its columns declared from its schema, so that references are checked."""
        return described(name, self.table(name))


def described(name: str, df: DataFrame) -> Source:
    columns: list[tuple[str, Kind]] = [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
    return from_(name, *columns)
