"""Top-level JSON arrays read by many tasks, and records that do not load kept with the reason.

A file holding one array, however large, is split at every closing brace, which Spark's text reader does in
parallel. Running counts of quotes, of braces outside strings and of records, first within a block of the
file and then over its few blocks, tell which pieces make up which record. Records of one piece stay where
they are; only those with nested objects or with braces in strings are put together by a shuffle.

Empty files and empty arrays hold no records. A record cut off by the end of its file is one of its own and
does not load. An unbalanced quote spoils what follows it in its file, as for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from kgspark.session import cut_lineage


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _running(pieces: DataFrame, **names: str) -> DataFrame:
    """Adds sums of columns over all earlier pieces of the file, as name=column; block sums first."""
    blocks = cut_lineage(pieces.groupBy("file", "block").agg(*[F.sum(c).alias(f"_{n}") for n, c in names.items()]))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = blocks.select("file", "block", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names])
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(before, ["file", "block"]).withColumns(
        {n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in names.items()}).drop(*[f"_{n}" for n in names])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of every element of the arrays in the files of ``path``."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"\\.", "")  # without escaped signs
    pieces = cut_lineage(read.withColumns({"quotes": _count(plain, '"'), "bytes": F.octet_length("value") + 1}))
    known = _running(pieces, quotes_before="quotes", bytes_before="bytes")
    in_string = F.col("quotes_before") % 2 == 1
    outside = F.regexp_replace(F.regexp_replace(F.concat(F.when(in_string, '"').otherwise(""), plain), '"[^"]*"', ""), '"[^"]*$', "")
    braced = F.col("bytes_before") + F.col("bytes") <= F.col("file_size")  # all but what follows a file's last brace
    closed = (braced & ((F.col("quotes_before") + F.col("quotes")) % 2 == 0)).cast("int")
    known = cut_lineage(known.withColumns({"braced": braced, "step": _count(outside, "{") - closed}))
    known = cut_lineage(_running(known, depth="step").withColumn("ends", (F.col("depth") + F.col("step") <= 0).cast("int")))
    known = cut_lineage(_running(known, number="ends"))
    text = F.concat("value", F.when(F.col("braced"), "}").otherwise(""))
    alone = (F.col("depth") <= 0) & (F.col("ends") == 1)
    single = known.where(alone).select("file", text.alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", text.alias("text"))))  # the pieces of one record
    joined = known.where(~alone).groupBy("file", "number").agg(parts.alias("parts")).select(
        "file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("record"))
    trimmed = F.regexp_replace("record", r"^[\s\[\],]+", "")
    return single.unionByName(joined).select("file", trimmed.alias("record")).where(F.startswith("record", F.lit("{")))


CORRUPT = "_corrupt"


def load_records(records: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): typed rows, and (file, record, reason) of what did not load: MALFORMED text or values
    of another type, or MISSING and the required field that is null."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json("record", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = records.select("file", "record", row.alias("row"))
    reason = F.when(F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull(), "MALFORMED")
    for name in required:
        reason = reason.when(F.col(f"row.{name}").isNull(), f"MISSING {name}")
    judged = parsed.withColumn("reason", reason)
    return (judged.where("reason IS NULL").select([F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields]),
            judged.where("reason IS NOT NULL").select("file", "record", "reason"))


def write_arrays(rows: DataFrame, path: str) -> None:
    """JSON records (one string column) as files that hold a top-level array each."""
    text = rows.columns[0]
    held = rows.select(F.col(text).alias("value"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    held = cut_lineage(held)
    first = Window.partitionBy("task").orderBy("at")
    last = F.lead("at").over(first).isNull()
    (held.select("task", "at", F.concat(F.when(F.lag("at").over(first).isNull(), "[").otherwise(" "), "value",
                                        F.when(last, "]").otherwise(",")).alias("value"))
     .sortWithinPartitions("task", "at").select("value").write.text(path))
