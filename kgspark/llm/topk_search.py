"""Exact top-k search by inner product with cover trees over queries and data.

Components become integers, floor(256 x). Rows are dealt to the nearest of a few pivots and each
pivot's rows to chunks of bounded size by a hash of the id, so that equal vectors spread over chunks.
A task builds a cover tree over each chunk, of data and of queries alike: children of a node lie in a
ball of half its radius around centres more than that apart. Two trees are searched together: a group
of queries meets the data nodes left to it, and a node pair is dropped when the largest inner product
its centres and radii allow is below the group's worst k-th score.

First every query chunk meets the data chunks of its own pivot, which gives each query a k-th score to
beat; then it meets the other chunks that the same bound, on whole chunks, cannot rule out. Blocks of
queries against blocks of data, all distributed; what is merged is k rows per query and chunk pair.

Scores are exact integers: products run in double precision below 2^53 and in Python integers beyond,
held to the range of a long. Ties go to the smaller id. Null vectors, vectors with a null or
non-finite component and null ids take no part; shorter vectors are padded with zeros; rows that share an
id are rows of their own, candidates for each other and, as queries, with answers of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import cut_lineage

PIVOTS, CHUNK, QUERY_CHUNK, LEAF, TILES = 32, 2048, 1024, 48, 32
SCALE = 256


class CoverTree:
    """Nodes level by level; the children of a node and the points of a leaf are contiguous."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None):
        """``rows`` tell apart points that share an id; by default ids do."""
        self.ids, self.rows = ids, ids if rows is None else rows
        real = points.astype(np.float64)
        centers, radii, children, spans, order = [], [], [], [], []
        pending = []
        if len(ids):
            first = int(np.argmin(((real - real.mean(axis=0)) ** 2).sum(axis=1)))
            pending.append((np.arange(len(ids)), first))
        at = 0
        while at < len(pending):
            members, center = pending[at]
            at += 1
            away = np.sqrt(((real[members] - real[center]) ** 2).sum(axis=1))
            radius = float(away.max())
            centers.append(center)
            radii.append(radius)
            if len(members) <= leaf or radius == 0:
                children.append((0, 0))
                spans.append((len(order), len(order) + len(members)))
                order.extend(members.tolist())
                continue
            # farthest-first centres until half the radius covers all; the node's own centre stays one
            chosen, owner = [center], np.zeros(len(members), np.int64)
            while away.max() > radius / 2:
                far = int(away.argmax())
                there = np.sqrt(((real[members] - real[members[far]]) ** 2).sum(axis=1))
                nearer = there < away
                owner[nearer], away[nearer] = len(chosen), there[nearer]
                chosen.append(int(members[far]))
            children.append((len(pending), len(pending) + len(chosen)))
            spans.append((0, 0))
            pending += [(members[owner == k], c) for k, c in enumerate(chosen)]
        self.points, self.centers = compact(points), np.array(centers, np.int64)
        self.center = real[centers] if centers else real[:0]
        self.radius, self.children, self.spans = np.array(radii), np.array(children), np.array(spans)
        self.norm = np.sqrt((self.center ** 2).sum(axis=1))
        self.order = np.array(order, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "center"}  # points already

    def __setstate__(self, state):
        self.__dict__ = state
        self.center = self.points[self.centers].astype(np.float64)


def compact(points: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them, for trees that travel."""
    low, high = int(points.min(initial=0)), int(points.max(initial=0))
    return points.astype(next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def bound(center, norm, radius, centers, norms, radii):
    """Largest inner product of a point of the first ball with one of each other ball, with room for rounding."""
    top = centers @ center + norm * radii + norms * radius + radius * radii
    return top + 1e-9 * (1 + np.abs(top) + (norm + radius) * (norms + radii))


class Search:
    """The k best of the points met so far, for each query of a tree."""

    def __init__(self, queries: CoverTree, k: int, low: np.ndarray):
        """``low``: scores that each query is known to reach k times elsewhere."""
        self.q, self.k = queries, k
        self.best = [([], []) for _ in queries.ids]  # scores, (id, row)
        self.low = low.astype(np.float64)

    def meet(self, data: CoverTree) -> None:
        if len(data.ids) and len(self.q.ids):
            most = float(np.abs(self.q.points.astype(np.float64)).max(initial=0)) * float(np.abs(data.points.astype(np.float64)).max(initial=0)) * self.q.points.shape[1]
            kind = np.float64 if most < 2.0 ** 53 else object
            self.exact, self.data = (self.q.points.astype(kind), data.points.astype(kind)), data
            self._visit(0, np.zeros(1, np.int64))

    def _visit(self, node: int, left: np.ndarray) -> None:
        """Let a query node meet the data nodes ``left`` to it."""
        q, d = self.q, self.data
        lo, hi = q.children[node]
        members = self._members(node)
        top = bound(q.center[node], q.norm[node], q.radius[node], d.center[left], d.norm[left], d.radius[left])
        left = left[np.argsort(-top, kind="stable")]
        if hi > lo:
            # open data nodes wider than the query node, then let its children go on
            left = left[np.sort(-top) <= -self.low[members].min()]
            wide = (d.radius[left] > q.radius[node]) & (d.children[left, 1] > 0)
            opened = [left[~wide], *(np.arange(*d.children[n]) for n in left[wide])]
            for child in range(lo, hi):
                self._visit(child, np.concatenate(opened))
            return
        while len(left):
            top = bound(q.center[node], q.norm[node], q.radius[node], d.center[left], d.norm[left], d.radius[left])
            keep = top >= self.low[members].min()
            left, top = left[keep], top[keep]
            leaves = left[d.children[left, 1] == 0]
            rows = [d.order[slice(*d.spans[n])] for n in leaves]
            if rows:
                self._score(members, np.concatenate(rows))
            inner = left[d.children[left, 1] > 0]
            left = np.concatenate([np.arange(*d.children[n]) for n in inner]) if len(inner) else inner

    def _members(self, node: int) -> np.ndarray:
        lo, hi = self.q.children[node]
        if hi == lo:
            return self.q.order[slice(*self.q.spans[node])]
        return np.concatenate([self._members(c) for c in range(lo, hi)])

    def _score(self, members: np.ndarray, rows: np.ndarray) -> None:
        queries, points = self.exact
        ids, numbers = self.data.ids[rows], self.data.rows[rows]
        for at in range(0, len(rows), 4096):
            part = rows[at:at + 4096]
            scores = queries[members] @ points[part].T
            for m, line in zip(members.tolist(), scores):
                near = np.flatnonzero(line >= self.low[m])
                if not len(near):
                    continue
                near = near[numbers[at:at + 4096][near] != self.q.rows[m]]
                if len(near) > self.k:  # all of the k-th score and above, then by id
                    near = near[line[near] >= np.sort(line[near])[-self.k]]
                own = zip(ids[at + near].tolist(), numbers[at + near].tolist())
                held = sorted(zip((-line[near]).tolist(), own))[:self.k]
                held = sorted(held + list(zip((-s for s in self.best[m][0]), self.best[m][1])))[:self.k]
                self.best[m] = ([-s for s, _ in held], [i for _, i in held])
                if len(held) == self.k:
                    self.low[m] = max(self.low[m], float(-held[-1][0]))

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(query row, id, row, score) of what each query has found."""
        top = (1 << 63) - 1
        return [(int(q), int(i), int(r), max(min(int(s), top), -top - 1)) for q, (scores, found) in zip(self.q.rows, self.best)
                for s, (i, r) in zip(scores, found)]


def _integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, row): the integer vectors that take part, each with a number of its own; number them once, in a written table."""
    x = F.col("x")
    valid = (x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("id").isNotNull() & valid)
            .select("id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("x"), F.monotonically_increasing_id().alias("row")))


def _assign(shared):
    """Nearest pivot of each row."""
    def run(batches):
        pivots = shared.value
        for batch in batches:
            lists = batch.column("x")
            points = np.zeros((batch.num_rows, pivots.shape[1]))
            for row, one in zip(points, lists):
                one = one.values.to_numpy()
                row[:len(one)] = one
            cell = (((pivots ** 2).sum(axis=1) - 2 * points @ pivots.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, batch.column("row"), pa.array(cell, pa.int32())],
                                             names=["id", "x", "row", "cell"])
    return run


def _trees(rows: DataFrame, width: int, size: int) -> DataFrame:
    """(cell, chunk, n, center, norm, radius, body): a cover tree per chunk of at most about ``size`` rows."""
    counts = cut_lineage(rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("chunks")))

    def build(key, frame):
        points = np.zeros((len(frame), width), np.int64)
        for row, one in zip(points, frame["x"]):
            row[:len(one)] = one
        tree = CoverTree(frame["id"].to_numpy(), points, rows=frame["row"].to_numpy())
        return pd.DataFrame({"cell": [key[0]], "chunk": [key[1]], "n": [len(frame)], "center": [tree.center[0].tolist()],
                             "norm": [tree.norm[0]], "radius": [tree.radius[0]], "body": [pickle.dumps(tree)]})

    dealt = rows.join(F.broadcast(counts), "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    return cut_lineage(dealt.groupBy("cell", "chunk").applyInPandas(
        build, "cell int, chunk int, n long, center array<double>, norm double, radius double, body binary"))


def _search(k: int):
    """Rows of one query chunk stand together: its tree is opened once and keeps its scores."""
    def run(batches):
        search = key = None
        out = []
        for batch in batches:
            columns = [batch.column(c) for c in ("q_cell", "q_chunk", "q_body", "low", "body")]
            for i in range(batch.num_rows):
                here = (columns[0][i].as_py(), columns[1][i].as_py())
                if here != key:
                    if search:
                        out += search.rows()
                    queries = pickle.loads(columns[2][i].as_buffer())
                    low = dict(columns[3][i].as_py() or [])
                    search = Search(queries, k, np.array([low.get(int(q), -np.inf) for q in queries.rows]))
                    key = here
                search.meet(pickle.loads(columns[4][i].as_buffer()))
            if len(out) > 10000:
                yield _answer(out)
                out = []
        if search:
            out += search.rows()
        yield _answer(out)
    return run


def _answer(rows: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query", "vec_id", "row", "score"])


def _best(rows: DataFrame, k: int) -> DataFrame:
    """(query, top): the k best of each query row; every task that met it has sent k rows at most."""
    ranked = F.struct((-F.col("score")).alias("less"), F.col("vec_id"), F.col("row"))
    return rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(ranked)), 1, k).alias("top"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over the column ``id``) holds."""
    spark = vectors.sparkSession
    rows = cut_lineage(_integers(vectors, id_col, vector_col))
    # a bounded sample of rows serves as pivots; any choice gives the same answers
    sample = [r.x for r in rows.orderBy(F.xxhash64("x"), "row").limit(PIVOTS).collect()]
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    pivots = np.zeros((max(len(sample), 1), width))
    for row, x in zip(pivots, sample):
        row[:len(x)] = x
    placed = cut_lineage(rows.mapInArrow(_assign(spark.sparkContext.broadcast(pivots)), "id long, x array<long>, row long, cell int"))
    data = _trees(placed, width, CHUNK).withColumn("tile", F.pmod(F.xxhash64("cell", "chunk"), F.lit(TILES)).cast("int"))
    queries = _trees(placed.where(is_query), width, QUERY_CHUNK)
    for c in queries.columns:
        queries = queries.withColumnRenamed(c, f"q_{c}")

    def search(pairs: DataFrame, lows: DataFrame) -> DataFrame:
        """Answers of chunk pairs (q_cell, q_chunk, cell, chunk); ``lows`` holds (query, cell, chunk, low)."""
        known = (lows.groupBy(F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"))
                 .agg(F.collect_list(F.struct("query", "low")).alias("low")))
        met = (pairs.join(data.select("cell", "chunk", "body"), ["cell", "chunk"])
               .join(queries.select("q_cell", "q_chunk", "q_body"), ["q_cell", "q_chunk"])
               .join(known, ["q_cell", "q_chunk"], "left"))
        part = F.pmod(F.xxhash64("cell", "chunk"), F.lit(8))  # a query chunk's pairs may go to eight tasks
        return cut_lineage(met.repartition("q_cell", "q_chunk", part).sortWithinPartitions("q_cell", "q_chunk")
                           .select("q_cell", "q_chunk", "q_body", "low", "body")
                           .mapInArrow(_search(k), "query long, vec_id long, row long, score long"))

    none = spark.createDataFrame([], "query long, cell int, chunk int, low double")
    own = data.join(queries, data.cell == queries.q_cell).select("q_cell", "q_chunk", "cell", "chunk")
    near = search(own, none)
    # the k-th score of each query so far, at its own chunk
    reached = (_best(near, k).where(F.size("top") == k)
               .select("query", (-F.element_at("top", k)["less"]).cast("double").alias("low")))
    chunks = F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks")
    per = cut_lineage(placed.where(is_query).groupBy("cell").agg(chunks))
    lows = cut_lineage(placed.where(is_query).select(F.col("row").alias("query"), "cell").join(F.broadcast(per), "cell")
                       .withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
                       .join(reached, "query", "left").select("query", "cell", "chunk", "low"))
    worst = lows.groupBy(F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk")).agg(
        F.min(F.coalesce("low", F.lit(float("-inf")))).alias("worst"))
    # chunks against chunks, tile by tile: a few numbers per chunk, not its rows
    outline = data.select("tile", "cell", "chunk", "center", "norm", "radius")
    asked = (queries.select("q_cell", "q_chunk", "q_center", "q_norm", "q_radius").join(worst, ["q_cell", "q_chunk"])
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))))
    middle = F.aggregate(F.zip_with("center", "q_center", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    spread = F.col("norm") * F.col("q_radius") + F.col("q_norm") * F.col("radius") + F.col("radius") * F.col("q_radius")
    room = F.lit(1e-9) * (F.abs("middle") + (F.col("norm") + F.col("radius")) * (F.col("q_norm") + F.col("q_radius")) + 1)
    pairs = (asked.join(outline, "tile").where("cell <> q_cell").withColumn("middle", middle)
             .where(F.col("middle") + spread + room >= F.col("worst")).select("q_cell", "q_chunk", "cell", "chunk"))
    far = search(cut_lineage(pairs), lows.where("low IS NOT NULL"))
    ids = placed.where(is_query).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return (_best(near.unionByName(far), k).join(ids, "query").select("query_id", F.posexplode("top").alias("at", "one"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"),
                    (-F.col("one.less")).alias("score")))
