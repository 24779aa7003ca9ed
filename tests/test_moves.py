"""Career operators against brute force on small random histories."""

import datetime as dt
import random
from collections import Counter

import pytest

from kgspark.session import cut_lineage
from kgspark.operators import actions, moves

DAY0 = dt.date(2000, 1, 1)
FAR = dt.date(9999, 12, 31)
PLACE = {0: "N0", 1: "N0", 2: "N1", 3: "N2", 4: "N1", 5: "N3"}
SCHEMA = "part_key bigint, supp_key bigint, start_date date, end_date date, nation string"


def history(seed):
    rng = random.Random(seed)
    rows = []
    for part in range(8):
        for supp in rng.sample(range(6), rng.randint(1, 6)):
            start = rng.randint(0, 40)
            end = None if rng.random() < 0.25 else start + rng.choice([0, 0, 3, 10, 45])
            rows.append((part, supp, DAY0 + dt.timedelta(start),
                         None if end is None else DAY0 + dt.timedelta(end), PLACE[supp]))
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def tenures(request, spark):
    rows = history(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA)


def chains(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_ranked_tenures(tenures):
    rows, df = tenures
    got = {(r.part_key, r.supp_key): (r.move_rank, r.prev_member, r.prev_start, r.prev_end)
           for r in moves.ranked_tenures(df, ["part_key"], "supp_key").collect()}
    want = {}
    for chain in chains(rows).values():
        for i, r in enumerate(chain):
            prev = chain[i - 1] if i else (None,) * 4
            want[r[0], r[1]] = (i + 1, prev[1], prev[2], prev[3])
    assert got == want


def test_consecutive_moves(tenures):
    rows, df = tenures
    got = sorted(tuple(r) for r in moves.consecutive_moves(df, ["part_key"], "supp_key").collect())
    want = sorted((b[0], a[1], b[1], a[3], b[2]) for chain in chains(rows).values()
                  for a, b in zip(chain, chain[1:]) if a[3] and a[3] < b[2])
    assert got == want


def test_later_pair_counts(tenures):
    rows, df = tenures
    count, entities = Counter(), {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and a[3] and b[2] > a[3] and a[4] != b[4]:
                count[a[4], b[4]] += 1
                entities.setdefault((a[4], b[4]), set()).add(a[0])
    got = {(r.from_place, r.to_place): (r.move_count, r.entities_moved)
           for r in moves.later_pair_counts(df, ["part_key"], "nation").collect()}
    assert got == {k: (n, len(entities[k])) for k, n in count.items()}


def test_moves_between_named_members(tenures):
    rows, df = tenures
    got = sorted(tuple(r) for r in moves.moves_between(df, ["part_key"], "supp_key", 2, 3).select(
        "part_key", "from_member", "to_member").collect())
    both = {r[0] for r in rows if r[1] == 2} & {r[0] for r in rows if r[1] == 3}
    assert got == sorted([(p, 2, 3) for p in both] + [(p, 3, 2) for p in both])
    ordered = moves.moves_between(df, ["part_key"], "supp_key", 2, 3, in_time_order=True).collect()
    assert all(r.joined_date > r.left_date for r in ordered)


def test_successors(tenures):
    rows, df = tenures
    got = {(r.part_key, r.supp_key): (r.next_start, r.next_member, r.later_tenures)
           for r in moves.successors(df, "supp_key", "part_key").collect()}
    want = {}
    for a in rows:
        later = [b for b in rows if b[1] == a[1] and a[3] and b[2] > a[3]]
        if later:
            first = min(b[2] for b in later)
            want[a[0], a[1]] = (first, min(b[0] for b in later if b[2] == first), len(later))
    assert got == want


def test_later_members(tenures):
    """Every later tenure, not only the next, whether a group lies in one cell or in many."""
    rows, df = tenures
    want = sorted((a[0], a[1], a[3], b[0], b[2]) for a in rows for b in rows if a[1] == b[1] and a[3] and b[2] > a[3])
    ended = moves.successors(df, "supp_key", "part_key")
    for split, known in ((4000, None), (2, None), (3, 20_000_000)):
        got = moves.later_members(ended, df, "supp_key", "part_key", known, split).select(
            "part_key", "supp_key", "end_date", "later_member", "later_start")
        assert sorted(map(tuple, got.collect())) == want


def overlaps(a, b):
    return a[2] <= (b[3] or FAR) and b[2] <= (a[3] or FAR)


def test_peer_counts(tenures):
    rows, df = tenures
    got = {(r.part_key, r.supp_key): (r.peers, r.overlapping_peers)
           for r in moves.peer_counts(df, "supp_key").collect()}
    want = {}
    for a in rows:
        peers = [b for b in rows if b[1] == a[1] and b[0] != a[0]]
        want[a[0], a[1]] = (len(peers), sum(overlaps(a, b) for b in peers))
    assert got == want


@pytest.mark.parametrize("rows_per_split", [1, 1000])
def test_same_place_pairs(tenures, rows_per_split):
    """Every overlapping pair exactly once, however a crowded cell is split."""
    rows, df = tenures
    got = sorted((r.supp_key, r.member1, r.member2, r.overlap_start, r.overlap_end or FAR)
                 for r in moves.same_place_pairs(df, "supp_key", "part_key", bucket_days=7,
                                                 rows_per_split=rows_per_split).collect())
    want = sorted((a[1], a[0], b[0], max(a[2], b[2]), min(a[3] or FAR, b[3] or FAR))
                  for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and overlaps(a, b))
    assert got == want


def test_peers_of(tenures):
    rows, df = tenures
    got = sorted((r.part_key, r.supp_key) for r in moves.peers_of(df, "supp_key", "part_key", 0).collect())
    own = {r[1] for r in rows if r[0] == 0}
    assert got == sorted((r[0], r[1]) for r in rows if r[0] != 0 and r[1] in own)


def test_apply_moves(spark):
    day, soon = dt.date(2001, 12, 1), dt.date(2001, 11, 1)
    tenures = spark.createDataFrame(
        [(1, 10, DAY0, None), (2, 10, DAY0, day), (3, 10, DAY0, None), (4, 10, DAY0, None), (5, 10, DAY0, None),
         (5, 20, DAY0, day)], "part_key bigint, supp_key bigint, start_date date, end_date date")
    requests = spark.createDataFrame(
        [(1, 10, 20, day), (2, 10, 20, day), (3, 10, 10, day), (4, 10, 30, day), (4, 10, 20, soon), (4, 10, 40, soon),
         (4, 10, 20, soon), (5, 10, 20, day)], "part_key bigint, from_key bigint, to_key bigint, move_date date")
    decided = actions.decide_moves(tenures, requests, "part_key", "supp_key")
    assert {(r.part_key, r.to_key): r.status for r in decided.collect()} == {
        (1, 20): "APPLIED", (2, 20): "NO_OPEN_TENURE", (3, 10): "SAME_SUPPLIER", (4, 20): "APPLIED",
        (4, 30): "SUPERSEDED", (4, 40): "SUPERSEDED", (5, 20): "APPLIED"}
    after = {(r.part_key, r.supp_key, r.tenure): (r.start_date, r.end_date)
             for r in actions.apply_moves(tenures, decided, "part_key", "supp_key").collect()}
    assert after == {(1, 10, 1): (DAY0, day), (1, 20, 1): (day, None), (2, 10, 1): (DAY0, day), (3, 10, 1): (DAY0, None),
                     (4, 10, 1): (DAY0, soon), (4, 20, 1): (soon, None), (5, 10, 1): (DAY0, day),
                     (5, 20, 1): (DAY0, day), (5, 20, 2): (day, None)}
    # the same requests again find nothing open to move
    written = cut_lineage(actions.apply_moves(tenures, decided, "part_key", "supp_key"))
    again = actions.decide_moves(written, requests, "part_key", "supp_key")
    assert again.where("status = 'APPLIED'").count() == 0
    engaged = actions.engage(tenures, spark.createDataFrame(
        [(1, 10, day), (6, 10, day)], "part_key bigint, supp_key bigint, start_date date"), "part_key", "supp_key")
    assert engaged.count() == 7  # part 1 already has an open tenure there
    known = spark.createDataFrame([(1, "a")], "k bigint, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k bigint, v string")
    assert sorted(tuple(r) for r in actions.record(known, new, "k").collect()) == [(1, "a"), (2, "c")]


def test_requests_that_follow_each_other(spark):
    """A batch in time order equals one request at a time."""
    import datetime as dt
    import random
    rng = random.Random(6)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    tenures = [(e, m, day(rng.randrange(40)), None if rng.random() < 0.6 else day(60)) for e in range(25) for m in rng.sample(range(6), 3)]
    requests = [(rng.randrange(26), rng.randrange(6), rng.randrange(6), day(rng.randrange(20, 90))) for _ in range(160)] * 2
    held = {(e, m): s for e, m, s, end in tenures if end is None}
    rows, moved, want = {(e, m, s): end for e, m, s, end in tenures}, set(), []
    for e, a, b, d in sorted(set(requests), key=lambda r: (r[0], r[3], r[1], r[2])):
        if a == b:
            status = "SAME_SUPPLIER"
        elif (e, a) not in held or held[e, a] > d:
            status = "SUPERSEDED" if (e, a) in moved else "NO_OPEN_TENURE"
        else:
            status = "APPLIED"
            rows[e, a, held.pop((e, a))] = d
            moved.add((e, a))
            if (e, b) not in held:
                held[e, b] = d
                rows[e, b, d] = None
        want.append((e, a, b, d, status))
    frame = spark.createDataFrame(tenures, "part_key bigint, supp_key bigint, start_date date, end_date date")
    asked = spark.createDataFrame(requests, "part_key bigint, from_key bigint, to_key bigint, move_date date").repartition(3)
    decided, after = actions.replay_moves(frame, asked, "part_key", "supp_key")
    assert sorted(map(tuple, decided.collect())) == sorted(want) and {w[4] for w in want} >= {"APPLIED", "SUPERSEDED"}
    got = [tuple(r) for r in after.collect()]
    assert len({g[:3] for g in got}) <= len(got) and {g[:3]: g[3] for g in got} == rows
    none, same = actions.replay_moves(frame, asked.limit(0), "part_key", "supp_key")
    assert none.count() == 0 and sorted(map(repr, same.collect())) == sorted(map(repr, frame.collect()))


def test_requests_given_twice(spark):
    import datetime as dt
    tenures = spark.createDataFrame([(1, 1, dt.date(2000, 1, 1), None)], "part_key bigint, supp_key bigint, start_date date, end_date date")
    asked = spark.createDataFrame([(1, 2, dt.date(2000, 3, 1)), (1, 2, dt.date(2000, 2, 1)), (1, 2, dt.date(2000, 2, 1)),
                                   (1, 1, dt.date(2000, 2, 1))], "part_key bigint, supp_key bigint, start_date date")
    assert sorted((r.supp_key, r.start_date.month) for r in actions.engage(tenures, asked, "part_key", "supp_key").collect()) == [(1, 1), (2, 2)]
    known = spark.createDataFrame([(1, "a")], "k bigint, v string")
    new = spark.createDataFrame([(2, "y"), (2, "x"), (2, "x"), (1, "b")], "k bigint, v string")
    assert sorted(map(tuple, actions.record(known, new, "k").collect())) == [(1, "a"), (2, "x")]


def test_later_pair_counts_keeps_rows_narrow(spark):
    """No start is repeated per place, named places only count as such, and ends of the same day do not."""
    day = lambda n: dt.date(2000, 1, n)
    own = spark.createDataFrame(
        [(1, 1, day(1), day(2), "a"), (1, 2, day(2), None, "b"), (1, 3, day(3), day(4), "b"), (1, 4, day(5), None, "a"),
         (1, 5, day(5), None, None), (2, 1, day(1), day(2), None), (2, 2, day(9), day(9), "a"), (2, 3, day(9), None, "b")],
        "part_key long, supp_key long, start_date date, end_date date, place string")
    plan = moves.later_pair_counts(own, ["part_key"], "place", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    found = lambda **o: sorted(tuple(r) for r in moves.later_pair_counts(own, ["part_key"], "place", **o).na.fill("-").collect())
    assert found() == [("a", "-", 1, 1), ("a", "b", 1, 1), ("b", "-", 1, 1), ("b", "a", 1, 1)]
    assert found(places=["a", "z"]) == [("a", "-", 1, 1), ("a", "b", 1, 1)]
    assert found(places=[]) == []
    assert found(rows=8, rows_per_task=1) == found()
    dealt = moves.later_pair_counts(own, ["part_key"], "place", ["a"], rows=1000, rows_per_task=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [part_key" in dealt and ", 101" in dealt  # tasks grow with the rows
