"""Values at the edge: wide keys, fractional quantities, malformed dates."""

import datetime as dt

from pyspark.sql import functions as F

from kgspark.plans import binding as b
from kgspark.sources.ingest import LinkSource, ObjectSource, ingest_links, ingest_objects


class Lines:
    """Stands for the given tables with a few order lines."""

    def __init__(self, spark, rows):
        self.lineitem = spark.createDataFrame(
            rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, "
                  "l_quantity double, l_returnflag string")


def test_wide_supplier_keys(spark):
    wide = (1 << 32) + 5
    t = Lines(spark, [(1, 1, wide, 1, 10.0, 1.0, "N"), (1, 2, 7, 1, 3.25, 1.0, "N"), (2, 1, 7, 1, 1.0, 1.0, "N"),
                      (2, 1, wide, 1, 2.0, 1.0, "N"), (3, 4, wide, 1, 5.0, 1.0, "N")])
    assert sorted(map(tuple, b.order_sides(t).collect())) == [
        (1, wide, 7, 1000, 325), (2, 7, wide, 100, 200), (3, wide, wide, 500, 500)]


def test_quantities_are_cut_after_the_sum(spark):
    t = Lines(spark, [(1, i, 1, 9, 1.0, 0.75, "R") for i in range(4)] + [(1, 5, 1, 9, 1.0, 0.5, "A")])
    row = b.in_order(t).first()
    assert (row.quantity, row.returned, row.accepted) == (3, 4, 1)


def test_malformed_dates_load_as_null(spark):
    rows = spark.createDataFrame([(1, "2020-13-45", "soon"), (2, "2020-02-03", "2020-02-03 04:05:06")],
                                 "k bigint, day string, at string")
    links = ingest_links({"s": rows}, [LinkSource("R", "s", "A", "k", "B", "k", "day", "day", ingested="at")])
    got = {r.src_id: (r.effective_start, r.effective_end, r.ts_ingested) for r in links.collect()}
    assert got == {"A:1": (None, None, None), "A:2": (dt.date(2020, 2, 3), dt.date(2020, 2, 3), dt.datetime(2020, 2, 3, 4, 5, 6))}
    nodes = ingest_objects({"s": rows}, [ObjectSource("A", "s", "k", "day", ingested="at")])
    assert nodes.where(F.col("ts_ingested").isNull()).count() == 1
