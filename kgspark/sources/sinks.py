"""Table sinks for node, edge, inferred-edge and violation frames."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_RECORDS_PER_FILE = 5_000_000


def publish(df: DataFrame, folder: str, part: str) -> None:
    """Replace one part (a rule, a check) of the table in ``folder``, as one step for readers.

    Rows are written aside; then one row (part, version, path) joins the manifest, in a single file, which
    Spark moves into place as a whole. Until then, and if the run fails, the part's old rows stay readable;
    a part without rows is published as empty. Of two runs at once the later version counts. Old data are
    left for a retention job.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/data/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(path)
    known = manifest(spark, folder)
    version = 1 + (known.where(F.col("part") == part).agg(F.max("version")).first()[0] or 0)
    row = spark.createDataFrame([(part, version, path)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")


MANIFEST = "part string, version bigint, path string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, version, path) of everything ever published to ``folder``; empty if nothing was."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def published(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the newest version of every part."""
    newest = manifest(spark, folder).groupBy("part").agg(F.max_by("path", F.struct("version", "path")).alias("path"))
    paths = [r.path for r in newest.collect()]  # one per rule or check
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _writer(df: DataFrame):
    return df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)


def write_by_type(df: DataFrame, path: str, type_col: str) -> None:
    """Type-partitioned table; only the types present in ``df`` are replaced. Rows are dealt out by type first,
    a hot type to many tasks, so that a task does not write a small file per type."""
    spread = F.pmod(F.spark_partition_id(), F.lit(16))
    (_writer(df.repartition(type_col, spread)).option("partitionOverwriteMode", "dynamic")
     .partitionBy(type_col).parquet(path))


def write_nodes(df: DataFrame, path: str) -> None:
    write_by_type(df, path, "node_type")


def write_edges(df: DataFrame, path: str) -> None:
    write_by_type(df, path, "edge_type")


def refresh_rule(inferred: DataFrame, path: str, rule_id: str) -> None:
    """Replace the rows of one rule. The rule's folder is overwritten, so a rule that
    no longer infers anything leaves no stale rows behind."""
    _writer(inferred.where(F.col("rule_id") == rule_id).drop("rule_id")).parquet(
        f"{path}/rule_id={rule_id}")


def write_inferred(df: DataFrame, path: str) -> None:
    """Replace the whole inferred table after a full run."""
    _writer(df).partitionBy("rule_id").parquet(path)


def write_violations(df: DataFrame, path: str, run_id: str, check_name: str) -> None:
    """One folder per run and check: running a check again never doubles its rows."""
    _writer(df.where(F.col("check_name") == check_name).drop("check_name")).parquet(
        f"{path}/run_id={run_id}/check_name={check_name}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
