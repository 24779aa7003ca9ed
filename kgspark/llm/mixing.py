"""Mixing sources to target weights.

Words are counted per source; the sources, by code point with null last, weigh 1, 2, 3, 1, ... and
share the whole word count by weight. A target stops at ``most`` times its source's size and the
excess is shared anew by weight: with sources in order of cap / weight the stopped ones are a prefix,
found from running sums over the (one row per source) table. A document's repetition rate is its
source's target over its source's size: it is emitted floor(rate) times, plus once more if a hash of
its id, uniform in [0, 1), lies under the fraction. Reruns give the same mix.

Null text has no words; a source without words has rate 0; a null source is a source; a null id
hashes like the empty string; rows with equal ids share the extra copy; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: int = 3, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighted = per.withColumn("place", place).select(
        "source", "source_size", "place", ((F.col("place") - 1) % cycle + 1).cast("long").alias("weight"),
        F.sum("source_size").over(whole).alias("total"),
        (F.col("source_size") * F.lit(most)).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("capped_before")) / (F.col("weights") - F.col("weight_before"))
    stopped = (weighted.select("*", F.sum("weight").over(whole).alias("weights"),
                               F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped_before"),
                               F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"))
               .withColumn("stopped", F.col("cap") / F.col("weight") <= level))
    rest = stopped.select(
        "*", F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(whole), F.lit(0.0)).alias("spent"),
        F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole).alias("open"))
    share = F.col("weight") * ((F.col("total") - F.col("spent")) / F.col("open"))
    return rest.select("source", "source_size",
                       F.when(F.col("stopped"), F.col("cap")).otherwise(share).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: str = "mix", cycle: int = 3, most: float = 3.0) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, with size, source_size, target, rate and copies."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    sized = rows.select("row", F.col(f"row.`{source_col}`").alias("source"),
                        word_count(F.col(f"row.`{text_col}`").cast("string")).alias("size"))
    # a written table of one row per source: its size is known when the join is planned
    plan = cut_lineage(source_targets(sized.select("source", "size"), cycle, most)).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    extra = uniform(F.col(f"row.`{id_col}`"), seed) < F.col("rate") - F.floor("rate")
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
            .select("row", "size", "source_size", "target", "rate",
                    (F.floor("rate") + extra.cast("long")).alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``."""
    return (with_copies(docs, **options).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select([F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
