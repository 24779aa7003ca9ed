"""Readers. Everything is lazy: column pruning and filters reach the scan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, types as T


def read_json_records(spark: SparkSession, path: str, schema: T.StructType,
                      array_file: bool = False) -> DataFrame:
    """Typed JSON scan. JSON lines split across tasks; a file holding one top-level
    array needs ``array_file`` and is read by a single task, so keep those small."""
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


class Tables:
    """The given parquet tables of one folder, by name."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.counts: dict[str, int] = {}
        self.written: dict[str, DataFrame] = {}  # what was derived and written once for all that use it

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """How many rows a table has, from its files' footers."""
        if name not in self.counts:
            self.counts[name] = self.read(name).count()
        return self.counts[name]

    @cached_property
    def region(self) -> DataFrame:
        return self.read("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.read("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")
