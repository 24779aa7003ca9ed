"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines (split at line ends, compared as they are) form a window with a 128-bit
hash of its lines. Windows found more than once in the whole table keep their first occurrence, by
(id, text hash, place); the lines under any later occurrence go, overlapping occurrences merged. A
removed line always has a copy at an earlier place that stays: its place in the first occurrence is
earlier, and so on to the first of all. Windows of blank lines alone don't count.

Null text is empty; texts of fewer than three lines have no window and stay as they are; rows that
repeat id and text share their windows, so neither loses lines to the other; equal ids with other
texts are documents of their own; a null id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import cut_lineage

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, me, text): all columns, the id with a hash of the text, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.struct(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("print")).alias("me"),
                       text.alias("text"))


def windows(rows: DataFrame) -> DataFrame:
    """(me, place, w1, w2) of rows (me, text): the place and hash of every window of three lines."""
    hashes = rows.select("me", F.transform(_lines(F.col("text")), lambda line: F.struct(
        F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"),
        (F.trim(F.translate(line, "\t\r", "  ")) == "").alias("blank"))).alias("h"))
    places = F.sequence(F.lit(0), F.size("h") - WINDOW)
    at = [F.element_at(F.col("h"), F.col("place") + 1 + k) for k in range(WINDOW)]
    return (hashes.where(F.size("h") >= WINDOW)
            .select("me", "h", F.explode(places).alias("place"))
            .where(~(at[0]["blank"] & at[1]["blank"] & at[2]["blank"]))
            .select("me", "place", F.xxhash64(*[x["a"] for x in at]).alias("w1"),
                    F.xxhash64(*[x["b"] for x in at]).alias("w2")))


def covered_places(rows: DataFrame) -> DataFrame:
    """(me, gone): the places of lines under later occurrences of repeated windows."""
    found = cut_lineage(windows(rows))
    first = cut_lineage(found.groupBy("w1", "w2").agg(F.min(F.struct("me", "place")).alias("first"),
                                                      F.count("*").alias("times"))
                        .where("times > 1").drop("times"))
    later = (found.join(first, ["w1", "w2"])
             .where((F.col("me") != F.col("first.me")) | (F.col("place") != F.col("first.place"))))
    return (later.groupBy("me").agg(F.collect_set("place").alias("starts"))
            .select("me", F.array_distinct(F.flatten(F.transform(
                "starts", lambda i: F.array(*[i + k for k in range(WINDOW)])))).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_removed, text): all columns of ``docs`` in ``row``, and the text that stays."""
    rows = _identified(docs, id_col, text_col)
    gone = cut_lineage(covered_places(rows.select("me", "text")).withColumnRenamed("me", "of"))
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    # both sides grow with the data: a merge join at every size
    return (rows.join(gone.hint("merge"), F.col("me") == F.col("of"), "left")
            .select("row", "text", "gone", F.when(F.col("gone").isNotNull(), lines).alias("lines"), F.size(lines).alias("n_lines"))
            .select("row", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
                    F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text")))
