"""Actions on tenures as batch jobs: move, engage (open a first tenure) and record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kgspark.session import cut_lineage


def decide_moves(tenures: DataFrame, requests: DataFrame, entity: str, member: str) -> DataFrame:
    """Requests (entity, from_key, to_key, move_date) with a status.

    APPLIED needs an open tenure at ``from_key`` that began on or before the move date. Of
    several such requests for one tenure the earliest counts, then the smallest target;
    the others are SUPERSEDED. A request given twice counts once.
    """
    open_now = tenures.where(F.col("end_date").isNull()).groupBy(
        entity, F.col(member).alias("from_key")).agg(F.min("start_date").alias("_open_since"))
    asked = requests.dropDuplicates([entity, "from_key", "to_key", "move_date"])
    found = asked.join(open_now, [entity, "from_key"], "left").withColumn(
        "_usable", F.coalesce((F.col("_open_since") <= F.col("move_date"))
                              & (F.col("from_key") != F.col("to_key")), F.lit(False)))
    first = found.where("_usable").groupBy(entity, "from_key").agg(
        F.min(F.struct("move_date", "to_key")).alias("_first"))
    wins = F.col("_first") == F.struct("move_date", "to_key")
    return found.join(first, [entity, "from_key"], "left").withColumn(
        "status", F.when(F.col("from_key") == F.col("to_key"), "SAME_SUPPLIER")
        .when(~F.col("_usable"), "NO_OPEN_TENURE").when(wins, "APPLIED").otherwise("SUPERSEDED")).drop(
        "_open_since", "_usable", "_first")


def apply_moves(tenures: DataFrame, decided: DataFrame, entity: str, member: str) -> DataFrame:
    """Tenures after the accepted moves, with a tenure number per (entity, member) by start date:
    the old one closed, the new one opened, the rest kept. A target where the entity already has
    an open tenure gets no second one."""
    accepted = decided.where("status = 'APPLIED'")
    closing = accepted.select(entity, F.col("from_key").alias(member), F.col("move_date").alias("_closed"))
    is_open = F.col("end_date").isNull()
    kept = tenures.join(closing, [entity, member], "left").withColumn(
        "end_date", F.when(is_open, F.col("_closed")).otherwise(F.col("end_date"))).drop("_closed")
    still_open = kept.where(is_open).select(entity, member).distinct()
    opened = accepted.groupBy(entity, F.col("to_key").alias(member)).agg(
        F.min("move_date").alias("start_date")).join(still_open, [entity, member], "left_anti").withColumn(
        "end_date", F.lit(None).cast("date"))
    # a few tenures per (entity, member) at most: one per return
    number = F.row_number().over(Window.partitionBy(entity, member).orderBy("start_date", "end_date"))
    return kept.select(entity, member, "start_date", "end_date").unionByName(opened).withColumn("tenure", number)


def replay_moves(tenures: DataFrame, requests: DataFrame, entity: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(decided, tenures after): requests (entity, from_key, to_key, move_date) in time order, each on what the
    ones before left, so that A to B and B to C in one batch both apply.

    Statuses as in ``decide_moves``; SUPERSEDED are requests for a tenure that an earlier one closed. On one day the
    smaller from_key and then to_key goes first; a request given twice counts once. Rows of an entity come
    sorted to one task, which holds that entity's open tenures only, however many requests it has.
    """
    none = F.lit(None)
    open_now = tenures.where(F.col("end_date").isNull()).groupBy(entity, member).agg(F.min("start_date").alias("move_date"))
    rows = open_now.select(F.col(entity).alias("e"), F.lit(0).alias("kind"), "move_date", F.col(member).alias("from_key"),
                           none.cast("bigint").alias("to_key")).unionByName(
        requests.dropDuplicates([entity, "from_key", "to_key", "move_date"]).select(
            F.col(entity).alias("e"), F.lit(1).alias("kind"), "move_date", "from_key", "to_key"))
    key = dict(tenures.dtypes)[entity]
    done = cut_lineage(rows.repartition("e").sortWithinPartitions("e", "kind", "move_date", "from_key", "to_key").mapInPandas(
        _fold, f"e {key}, from_key bigint, to_key bigint, move_date date, status string, start_date date, end_date date"))
    decided = done.where("status <> 'TENURE'").select(F.col("e").alias(entity), "from_key", "to_key", "move_date", "status")
    changed = done.where("status = 'TENURE'").select(F.col("e").alias(entity), F.col("from_key").alias(member), "start_date",
                                                     "end_date", F.col("to_key").alias("is_new"))
    closed = changed.where("is_new = 0").select(entity, member, F.col("end_date").alias("_closed"))
    kept = tenures.select(entity, member, "start_date", "end_date").join(closed, [entity, member], "left").withColumn(
        "end_date", F.coalesce("end_date", "_closed")).drop("_closed")
    return decided, kept.unionByName(changed.where("is_new = 1").drop("is_new"))


def _fold(frames):
    """Requests with their status, and a TENURE row (to_key: 1 if new) per tenure closed or opened."""
    now, held = None, {}  # member: (start of the open tenure, whether it is new)
    moved: set = set()
    for frame in frames:
        out = []

        def settle():
            out.extend((now, m, 1, None, "TENURE", start, None) for m, (start, new) in held.items() if new)

        for e, kind, day, source, target in frame.itertuples(index=False, name=None):
            if e != now:
                settle()
                now, held, moved = e, {}, set()
            if kind == 0:
                held[source] = (day, False)
                continue
            since = held.get(source, (None, False))[0]
            if source == target:
                status = "SAME_SUPPLIER"
            elif since is None or since > day:
                status = "SUPERSEDED" if source in moved else "NO_OPEN_TENURE"
            else:
                status = "APPLIED"
                start, new = held.pop(source)
                moved.add(source)
                out.append((e, source, int(new), None, "TENURE", start, day))
                held.setdefault(target, (day, True))
            out.append((e, source, target, day, status, None, None))
        if out:
            yield _frame(out)
    if now is not None:
        out = [(now, m, 1, None, "TENURE", start, None) for m, (start, new) in held.items() if new]
        if out:
            yield _frame(out)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["e", "from_key", "to_key", "move_date", "status", "start_date", "end_date"])


def engage(tenures: DataFrame, requests: DataFrame, entity: str, member: str) -> DataFrame:
    """Open a tenure per requested (entity, member), at the earliest start_date asked for, unless one is
    already open there."""
    open_now = tenures.where(F.col("end_date").isNull()).select(entity, member)
    fresh = requests.groupBy(entity, member).agg(F.min("start_date").alias("start_date")).join(open_now, [entity, member], "left_anti")
    return tenures.unionByName(fresh.select(
        entity, member, "start_date", F.lit(None).cast("date").alias("end_date")))


def record(occasions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Add newly recorded occasions; a known key is left as it is, and of several results for one key
    the least by its columns in order counts."""
    first = results.groupBy(key).agg(F.min(F.struct(*occasions.columns)).alias("row")).select("row.*")
    return occasions.unionByName(first.join(occasions.select(key), key, "left_anti").select(occasions.columns))
