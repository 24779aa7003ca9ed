"""Career operators over tenure frames (entity, member, start_date, end_date).

None of them puts one entity's whole history into one window partition or joins it
with itself. Histories are first combined per (entity, day); a window over days is
bounded by the calendar, and the rows themselves are only ever grouped by
(entity, day).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.session import cut_lineage, dealt

START, END = 0, 1


def _events(tenures: DataFrame, columns: list[str]) -> DataFrame:
    """One row per start and per known end: columns, day, kind. Both come from one pass,
    so the tenures behind them are computed once."""
    points = F.filter(F.array(F.struct(F.col("start_date").alias("day"), F.lit(START).alias("kind")),
                              F.struct(F.col("end_date").alias("day"), F.lit(END).alias("kind"))),
                      lambda p: p["day"].isNotNull())
    return tenures.select(*columns, F.explode(points).alias("p")).select(*columns, "p.*")


def ranked_tenures(tenures: DataFrame, entity: list[str], member: str, rows: int | None = None) -> DataFrame:
    """Number each entity's tenures by (start_date, member) and attach the one before.

    Adds move_rank, prev_member, prev_start and prev_end. ``member`` is unique per entity. ``rows``: no fewer than
    there are tenures, if known; they are then dealt to as many tasks as these ask for.
    """
    tenures = dealt(tenures, rows, *entity, "start_date")
    by_day = Window.partitionBy(*entity).orderBy("start_date")
    days = tenures.groupBy(*entity, "start_date").agg(
        F.count("*").alias("_n"), F.max(member).alias("_last"), F.max_by("end_date", member).alias("_last_end"))
    days = (dealt(days, rows, *entity)
            .select(*entity, "start_date",
                    (F.sum("_n").over(by_day) - F.col("_n")).alias("_offset"),
                    F.lag("_last").over(by_day).alias("_day_prev"),
                    F.lag("start_date").over(by_day).alias("_day_prev_start"),
                    F.lag("_last_end").over(by_day).alias("_day_prev_end")))
    in_day = Window.partitionBy(*entity, "start_date").orderBy(member)
    numbered = tenures.withColumns({
        "_rn": F.row_number().over(in_day),
        "_same_prev": F.lag(member).over(in_day),
        "_same_prev_end": F.lag("end_date").over(in_day)})
    first = F.col("_rn") == 1
    return (numbered.join(dealt(days, rows, *entity, "start_date"), [*entity, "start_date"])
            .withColumns({
                "move_rank": (F.col("_offset") + F.col("_rn")).cast("int"),
                "prev_member": F.when(first, F.col("_day_prev")).otherwise(F.col("_same_prev")),
                "prev_start": F.when(first, F.col("_day_prev_start")).otherwise(F.col("start_date")),
                "prev_end": F.when(first, F.col("_day_prev_end")).otherwise(F.col("_same_prev_end"))})
            .drop("_rn", "_same_prev", "_same_prev_end", "_offset", "_day_prev",
                  "_day_prev_start", "_day_prev_end"))


def consecutive_moves(tenures: DataFrame, entity: list[str], member: str, rows: int | None = None) -> DataFrame:
    """Moves from one member to the next: the earlier tenure ended before the later began."""
    return (ranked_tenures(tenures, entity, member, rows)
            .where(F.col("prev_end") < F.col("start_date"))
            .select(*entity, F.col("prev_member").alias("from_member"),
                    F.col(member).alias("to_member"), F.col("prev_end").alias("left_date"),
                    F.col("start_date").alias("joined_date")))


def moves_between(tenures: DataFrame, entity: list[str], member: str, a, b,
                  in_time_order: bool = False) -> DataFrame:
    """Every pair of tenures of one entity at two named members, in both directions.

    An entity has one tenure per member, so this is a one-to-one join.
    """
    def side(value, s, e):
        return tenures.where(F.col(member) == value).select(
            *entity, F.col("start_date").alias(s), F.col("end_date").alias(e))

    def one_way(x, y):
        return side(x, "from_start", "left_date").join(
            side(y, "joined_date", "to_end"), entity).select(
            *entity, F.lit(x).alias("from_member"), F.lit(y).alias("to_member"),
            "left_date", "joined_date")

    both = one_way(a, b).unionByName(one_way(b, a))
    return both.where("joined_date > left_date") if in_time_order else both


def later_pair_counts(tenures: DataFrame, entity: list[str], place: str, places: Sequence | None = None,
                      rows: int | None = None, rows_per_task: int = 500_000) -> DataFrame:
    """How often an entity ended a tenure in one place and later began one in another.

    Exact count of all (ended, later started) tenure pairs per (from_place, to_place),
    without building the pairs: a start reads the running counts of earlier ends, one column per place.
    ``place`` must be a dimension of fixed size (nation, region); ``places`` are those that count as
    from_place, by default all there are, which reads the tenures once more. ``rows``: no fewer than there are
    tenures, if known; entities are then dealt to as many tasks as these ask for.
    """
    if places is None:
        places = [row[0] for row in tenures.select(place).where(F.col(place).isNotNull()).distinct().collect()]
    if not places:
        return tenures.select(F.col(place).alias("from_place"), F.col(place).alias("to_place"),
                              F.lit(0).cast("long").alias("move_count"), F.lit(0).cast("long").alias("entities_moved")).limit(0)
    kind_of_place = tenures.schema[place].dataType
    events = _events(tenures, [*entity, place]).groupBy(*entity, place, "day", "kind").agg(
        F.count("*").alias("n"))
    # both windows below are then in place
    events = events.repartition(*entity) if rows is None else events.repartition(max(rows // rows_per_task + 1, 8), *entity)
    started = F.col("kind") == START
    last = F.max(F.when(started, F.col("day"))).over(Window.partitionBy(*entity, place))
    # kind orders a day's starts before its ends: a start needs a strictly earlier end
    running = (Window.partitionBy(*entity).orderBy("day", "kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = [F.sum(F.when(~started & (F.col(place) == F.lit(p)), F.col("n")).otherwise(0)).over(running).alias(f"before{i}")
             for i, p in enumerate(places)]
    starts = events.withColumn("last", last).select(place, "day", "kind", "n", "last", *ended).where(started)
    # earlier ends only grow, so an entity has moved if they are there at its last start
    sums = starts.groupBy(place).agg(
        *(F.sum(F.col(f"before{i}") * F.col("n")).alias(f"pairs{i}") for i in range(len(places))),
        *(F.count_if((F.col("day") == F.col("last")) & (F.col(f"before{i}") > 0)).alias(f"moved{i}") for i in range(len(places))))
    pairs = F.array(*[F.struct(F.lit(p).cast(kind_of_place).alias("from_place"), F.col(f"pairs{i}").alias("move_count"),
                               F.col(f"moved{i}").alias("entities_moved")) for i, p in enumerate(places)])
    return (sums.select(F.col(place).alias("to_place"), F.explode(pairs).alias("p"))
            .where("p.move_count > 0 AND NOT p.from_place <=> to_place")
            .select("p.from_place", "to_place", "p.move_count", "p.entities_moved"))


def successors(tenures: DataFrame, group: str, member: str, rows: int | None = None) -> DataFrame:
    """For each ended tenure the next one to begin at the same group afterwards.

    Adds next_member (smallest among those starting on the same day), next_start and
    later_tenures, the number of tenures that begin at any later day. ``rows``: no fewer than there are
    tenures, if known; they are then dealt to as many tasks as these ask for.
    """
    twice = rows and 2 * rows  # a start and an end each
    events = dealt(_events(tenures, [group, member]), twice, group, "day", "kind").groupBy(group, "day", "kind").agg(
        F.count("*").alias("n"), F.min(member).alias("first_member"))
    events = dealt(events, twice, group)
    # newest day first; on one day the ends come before the starts, so a running value
    # over the rows so far sees only strictly later starts
    w = (Window.partitionBy(group).orderBy(F.desc("day"), F.desc("kind"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    started = F.col("kind") == START
    nearest = (events.withColumns({
        "next_start": F.last(F.when(started, F.col("day")), ignorenulls=True).over(w),
        "next_member": F.last(F.when(started, F.col("first_member")), ignorenulls=True).over(w),
        "later_tenures": F.sum(F.when(started, F.col("n")).otherwise(0)).over(w)})
        .where((F.col("kind") == END) & F.col("next_start").isNotNull())
        .select(group, F.col("day").alias("end_date"), "next_start", "next_member", "later_tenures"))
    ended = dealt(tenures.where("end_date IS NOT NULL"), rows, group, "end_date")
    return ended.join(dealt(nearest, rows, group, "end_date"), [group, "end_date"])


def later_members(ended: DataFrame, tenures: DataFrame, group: str, member: str, rows: int | None = None,
                  rows_per_split: int = 4000, rows_per_task: int = 100_000, ended_as: Mapping[str, Column] | None = None,
                  later_as: Mapping[str, Column] | None = None) -> DataFrame:
    """Each ended tenure with every tenure that begins at the same group at any later day.

    Adds later_member and later_start to ``ended`` (group, end_date and any others), one row per pair. The ended and
    the beginning tenures of a group are dealt to a grid with no more than about ``rows_per_split`` rows on a side of
    a cell, so that no task holds or pairs a whole large group. ``rows``: no fewer than there are tenures, if known.
    ``ended_as`` and ``later_as`` set columns of either side after rows were moved and before they become pairs.
    """
    def dealt_to(df, *keys):
        return dealt(df, rows, *keys, rows_per_task=rows_per_task)

    days = dealt_to(_events(tenures, [group]), group, "day", "kind").groupBy(group, "day", "kind").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    splits = lambda kind: F.ceil(F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).over(whole) / rows_per_split).cast("int")
    grid = cut_lineage(dealt_to(days, group).select(group, "day", "kind", F.greatest(splits(END), F.lit(1)).alias("_ends"),
                                                    F.greatest(splits(START), F.lit(1)).alias("_starts")))  # read from both sides

    def on_day(kind, day):
        return dealt_to(grid.where(F.col("kind") == kind).select(group, F.col("day").alias(day), "_ends", "_starts"), group, day)

    def part(splits):  # rows of one day and member may repeat: any even deal will do
        return F.pmod(F.xxhash64(F.col(member)), F.col(splits)).cast("int")

    def each(splits):
        return F.explode(F.sequence(F.lit(0), F.col(splits) - 1))

    first = dealt_to(ended, group, "end_date").join(on_day(END, "end_date"), [group, "end_date"])
    first = first.withColumn("_i", part("_ends")).withColumn("_j", each("_starts")).drop("_ends", "_starts")
    later = dealt_to(tenures.where("start_date IS NOT NULL").select(group, member, "start_date"), group, "start_date").join(
        on_day(START, "start_date"), [group, "start_date"])
    later = later.withColumn("_j", part("_starts")).withColumn("_i", each("_ends")).select(
        group, "_i", "_j", F.col(member).alias("later_member"), F.col("start_date").alias("later_start"))
    cell = [group, "_i", "_j"]
    return dealt_to(first, *cell).withColumns(ended_as or {}).join(dealt_to(later, *cell).withColumns(later_as or {}), cell).where(
        "later_start > end_date").drop("_i", "_j")


def peer_counts(tenures: DataFrame, group: str) -> DataFrame:
    """Per tenure: how many others share its group, and how many overlap it in time.

    overlapping = all - those ended before my start - those started after my end - me,
    each read from running counts per (group, day).
    """
    daily = _events(tenures, [group]).groupBy(group, "day").agg(
        F.count_if(F.col("kind") == START).alias("s"), F.count_if(F.col("kind") == END).alias("e"))
    upto = (Window.partitionBy(group).orderBy("day")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    calendar = daily.select(
        group, "day", (F.sum("e").over(upto) - F.col("e")).alias("ended_before"),
        F.sum("s").over(upto).alias("started_upto"),
        F.sum("s").over(Window.partitionBy(group)).alias("all_tenures"))
    at_start = calendar.select(group, F.col("day").alias("start_date"), "ended_before", "all_tenures")
    at_end = calendar.select(group, F.col("day").alias("end_date"), "started_upto")
    joined = (tenures.join(at_start, [group, "start_date"])
              .join(at_end, [group, "end_date"], "left"))
    started = F.coalesce(F.col("started_upto"), F.col("all_tenures"))
    return joined.withColumns({
        "peers": F.col("all_tenures") - 1,
        "overlapping_peers": started - F.col("ended_before") - 1,
    }).drop("ended_before", "started_upto", "all_tenures")


def peers_of(tenures: DataFrame, group: str, member: str, value) -> DataFrame:
    """Tenures of everyone who ever shared a group with one named member."""
    groups = tenures.where(F.col(member) == value).select(
        group, F.col("start_date").alias("own_start"), F.col("end_date").alias("own_end"))
    return tenures.where(F.col(member) != value).join(groups, group)


def same_place_pairs(tenures: DataFrame, group: str, member: str, bucket_days: int = 31,
                     rows_per_split: int = 20_000) -> DataFrame:
    """Pairs of members whose tenures at one group overlap in time (member1 < member2).

    The later-starting tenure of a pair is looked up in the month it starts in, the
    earlier one in every month it covers, so candidates are limited to tenures that meet
    in a month and each pair comes out exactly once. Crowded (group, month) cells are
    split into as many parts as their row count asks for.
    """
    tenures = cut_lineage(tenures.select(group, member, "start_date", "end_date"))  # read four times below
    month = lambda day: F.floor(F.unix_date(day) / bucket_days).cast("int")
    horizon = tenures.agg(F.max("start_date")).scalar()
    cells = tenures.groupBy(F.col(group).alias("g"), month(F.col("start_date")).alias("cell")).agg(
        F.ceil(F.count("*") / rows_per_split).cast("int").alias("splits"))
    late = tenures.select(F.col(group).alias("g"), F.col(member).alias("late"),
                          F.col("start_date").alias("late_start"), F.col("end_date").alias("late_end"),
                          month(F.col("start_date")).alias("cell"))
    late = late.join(cells, ["g", "cell"]).select(
        "*", F.pmod(F.xxhash64("late"), F.col("splits")).cast("int").alias("part")).drop("splits")
    last = F.least(F.coalesce("end_date", horizon), horizon)
    early = tenures.select(F.col(group).alias("g"), F.col(member).alias("early"),
                           F.col("start_date").alias("early_start"), F.col("end_date").alias("early_end"),
                           F.explode(F.sequence(month(F.col("start_date")), month(last))).alias("cell"))
    early = early.join(cells, ["g", "cell"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part")).drop("splits")
    before = (F.col("early_start") < F.col("late_start")) | (
        (F.col("early_start") == F.col("late_start")) & (F.col("early") < F.col("late")))
    still_there = F.col("early_end").isNull() | (F.col("early_end") >= F.col("late_start"))
    far = F.to_date(F.lit("9999-12-31"))
    end = F.least(F.coalesce("early_end", far), F.coalesce("late_end", far))
    return early.join(late, ["g", "cell", "part"]).where(before & still_there).select(
        F.col("g").alias(group), F.least("early", "late").alias("member1"),
        F.greatest("early", "late").alias("member2"),
        F.col("late_start").alias("overlap_start"), F.when(end < far, end).alias("overlap_end"))
