"""Shortest-path counts and dependencies (Brandes 2001) on pair edges, many sources at a time.

A row holds a node's values for up to 256 sources, or bits for up to 1024. A step sends each row to the blocks of nodes its neighbours
lie in, and every (block, sources) tile adds up what it is sent as matrix products. So values are moved once per
block and not once per edge, and a task holds one tile at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.session import bucketed, cut_lineage, forget

SIDE = 2048  # nodes of a block
WIDTH = 256  # sources of a row
BITS = 1024  # sources of a row of bits
STEP = 1024  # rows multiplied at a time
MOST_BYTES = 1 << 32  # values sent in a step, before they are packed: more sources than that takes go in turns
MOST_PARTITIONS = 4096
ROWS = "node bigint, s bigint, v binary, a double, b double"


def _marks(slots: list[int], side: int) -> bytes:
    """Places within a block: a bit per place, or two bytes each if that is shorter or a place repeats."""
    if 16 * len(slots) <= side or len(set(slots)) < len(slots):
        return b"\1" + np.array(slots, "<u2").tobytes()
    marked = np.zeros(side, np.uint8)
    marked[slots] = 1
    return b"\0" + np.packbits(marked).tobytes()


def _edges(marks: list[bytes], side: int, kind) -> np.ndarray:
    """A column for each of ``marks``: how often it names each place."""
    out = np.zeros((side, len(marks)), kind)
    bits = [k for k, x in enumerate(marks) if x[0] == 0]
    if bits:
        packed = np.frombuffer(b"".join(marks[k][1:] for k in bits), np.uint8).reshape(len(bits), -1)
        out[:, bits] = np.unpackbits(packed, axis=1, count=side).T
    for k, x in enumerate(marks):
        if x[0]:
            np.add.at(out[:, k], np.frombuffer(x, "<u2", offset=1), 1)
    return out


def strips(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """(src, i, slots): the places of a node's neighbours within block i, packed, in buckets of src; nodes by number."""
    side = SIDE

    def pack(batches):
        for batch in batches:
            slots = [_marks(x, side) for x in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("i"), pa.array(slots, pa.binary())], names=["src", "i", "slots"])

    src, dst = numbers.toDF("src", "x"), numbers.toDF("dst", "y")
    numbered = links.join(src, "src").join(dst, "dst")
    return bucketed(numbered.groupBy(F.col("x").alias("src"), F.floor(F.col("y") / SIDE).alias("i")).agg(
        F.sort_array(F.collect_list((F.col("y") % SIDE).cast("int"))).alias("slots")).mapInArrow(pack, "src bigint, i bigint, slots binary"), "src")


def _vectors(column, width: int) -> np.ndarray:
    """The doubles of a binary column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), width)


def _batch(nodes, s, values, a=None, b=None) -> pa.RecordBatch:
    nothing = np.zeros(len(values))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(s, pa.int64()), pa.array([x.tobytes() for x in values], pa.binary()),
         pa.array(nothing if a is None else a), pa.array(nothing if b is None else b)], names=["node", "s", "v", "a", "b"])


def _bits(column, width: int) -> np.ndarray:
    """The bits of a binary column as zeros and ones, one row each."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=width)


def _starts(rows: DataFrame, width: int, bits: bool = False) -> DataFrame:
    """(node, s, place) -> level rows: one path from each source to itself."""
    def run(batches):
        for batch in batches:
            v = np.zeros((batch.num_rows, width), np.uint8 if bits else float)
            v[np.arange(batch.num_rows), batch.column("place").to_numpy()] = 1
            yield _batch(batch.column("node").to_numpy(), batch.column("s").to_numpy(), np.packbits(v, axis=1) if bits else v)
    return cut_lineage(rows.mapInArrow(run, ROWS))


def _shares(level: DataFrame, width: int) -> DataFrame:
    """1 / sigma of the last level, where no path goes on."""
    def run(batches):
        for batch in batches:
            sigma = _vectors(batch.column("v"), width)
            yield _batch(batch.column("node").to_numpy(), batch.column("s").to_numpy(),
                         np.divide(1.0, sigma, out=np.zeros_like(sigma), where=sigma > 0))
    return level.mapInArrow(run, ROWS)


def _step(values: DataFrame, known: list[DataFrame], around: DataFrame, width: int, tiles: int, back: bool, bits: bool = False) -> DataFrame:
    """Sums of ``values`` over neighbours. Forward: without the cells set in ``known``. Back: ``known`` (sigma) times
    its sums c give delta = sigma * c, of which v is (1 + delta) / sigma and a and b the sums of delta and its square.
    With ``bits``, forward only, values are one bit each: whether there is any path."""
    kind_of, vectors = (np.float32, _bits) if bits else (np.float64, _vectors)

    def finish(i, s, total, own):
        if back:
            for node, sigma in own:
                delta = sigma * total[node % SIDE]
                yield _batch(node, np.full(len(node), s), np.divide(1.0 + delta, sigma, out=np.zeros_like(sigma), where=sigma > 0),
                             delta.sum(axis=1), (delta * delta).sum(axis=1))
            return
        for node, sigma in own:
            for at, row in zip(node % SIDE, sigma):
                total[at][row > 0] = 0.0
        at = np.flatnonzero(total.any(axis=1))
        if len(at):
            yield _batch(i * SIDE + at, np.full(len(at), s), np.packbits(total[at] > 0, axis=1) if bits else total[at])

    def run(batches):
        here, total, own = None, None, []
        for batch in batches:
            i, s, kind, node = (batch.column(c).to_numpy() for c in ("i", "s", "kind", "node"))
            change = np.flatnonzero((np.diff(i) != 0) | (np.diff(s) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows]):
                if lo == hi:
                    continue
                if (i[lo], s[lo]) != here:
                    if here is not None:
                        yield from finish(*here, total, own)
                    here, total, own = (i[lo], s[lo]), np.zeros((SIDE, width), kind_of), []
                if kind[lo]:
                    own.append((node[lo:hi], vectors(batch.column("v").slice(lo, hi - lo), width)))
                    continue
                for first in range(lo, hi, STEP):
                    n = min(STEP, hi - first)
                    edges = _edges(batch.column("slots").slice(first, n).to_pylist(), SIDE, kind_of)
                    total += edges @ vectors(batch.column("v").slice(first, n), width).astype(kind_of, copy=False)
        if here is not None:
            yield from finish(*here, total, own)

    sent = values.withColumnRenamed("node", "src").join(around, "src").select(
        "i", "s", F.lit(0).alias("kind"), F.col("src").alias("node"), "slots", "v")
    stays = [x.select(F.floor(F.col("node") / SIDE).alias("i"), "s", F.lit(1).alias("kind"), "node",
                      F.lit(None).cast("binary").alias("slots"), "v") for x in known]
    rows = reduce(DataFrame.unionByName, [sent, *stays]).repartition(tiles, "i", "s").sortWithinPartitions("i", "s", "kind", "node")
    return cut_lineage(rows.mapInArrow(run, ROWS))


def turns(around: DataFrame, sources: DataFrame, most: int, bits: bool = False):
    """The sources (source, number from 0), ``most`` at a time, or as many as a step can send within ``MOST_BYTES``."""
    n, width = sources.count(), min(BITS if bits else WIDTH, most)
    sent = around.count() * ((width // 8 if bits else width * 8) + SIDE // 8 + 64)  # by one row of sources
    most = max(min(most, MOST_BYTES // max(sent, 1) * width), width)
    for first in range(0, n, most):
        yield sources.where((F.col("number") >= first) & (F.col("number") < first + most)).select(
            "source", (F.col("number") - first).alias("number"))


def _placed(numbers: DataFrame, sources: DataFrame, nodes: int, width: int) -> tuple[DataFrame, int]:
    """The sources' own rows (node, s, place), and the number of tasks that tiles of all nodes are dealt to."""
    tiles = min(MOST_PARTITIONS, 2 * -(-nodes // SIDE) * -(-sources.count() // width))
    return sources.toDF("id", "place").join(numbers, "id").select(
        F.col("number").alias("node"), F.floor(F.col("place") / width).alias("s"), (F.col("place") % width).cast("int").alias("place")), max(1, tiles)


def distance_counts(around: DataFrame, numbers: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(source, r, d): nodes reached from ``sources`` (source, number) and the sum of their distances, None if none is.

    numbers: id, number of all nodes with neighbours. A bit per source and node, as only whether there is a path counts.
    """
    width = -(-max(1, min(BITS, sources.count())) // 8) * 8
    first, tiles = _placed(numbers, sources, numbers.count(), width)

    def count(batches):
        reached = {}
        for batch in batches:
            s, v = batch.column("s").to_numpy(), _bits(batch.column("v"), width)
            for x in np.unique(s):
                reached[x] = reached.get(x, 0) + v[s == x].sum(axis=0, dtype=np.int64)
        for x, found in reached.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(x * width + at, pa.int64()), pa.array(found[at], pa.int64())], names=["number", "r"])

    levels, counts = [_starts(first, width, bits=True)], []
    while True:
        level = _step(levels[-1], levels[-2:], around, width, tiles, back=False, bits=True)
        found = cut_lineage(level.mapInArrow(count, "number bigint, r bigint").groupBy("number").agg(F.sum("r").alias("r")))
        if len(levels) > 1:
            forget(levels[-2])
        levels.append(level)
        if found.isEmpty():
            break
        counts.append(found.select("number", "r", (F.col("r") * (len(levels) - 1)).alias("d")))
    forget(*levels)
    if not counts:
        return None
    return cut_lineage(reduce(DataFrame.unionByName, counts).groupBy("number").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
                       .join(sources, "number").select("source", "r", "d"))


def dependency_sums(around: DataFrame, numbers: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(node, s, q): the dependencies of ``sources`` (source, number) on each node and their squares, summed.

    numbers: id, number of all nodes with neighbours. Undirected levels lie next to each other, so two are looked back at.
    """
    width = max(1, min(WIDTH, sources.count()))
    first, tiles = _placed(numbers, sources, numbers.count(), width)
    levels = [_starts(first, width)]
    while not levels[-1].isEmpty():
        levels.append(_step(levels[-1], levels[-2:], around, width, tiles, back=False))
    forget(levels.pop())
    if len(levels) < 3:
        forget(*levels)
    if len(levels) < 2:
        return None
    if len(levels) == 2:  # no path has a middle
        return numbers.select(F.col("id").alias("node"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    passed, found, done = _shares(levels[-1], width), [], []
    for level in levels[-2:0:-1]:
        passed = _step(passed, [level], around, width, tiles, back=True)
        done.append(passed)
        found.append(passed.select("node", "a", "b"))
    sums = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.sum("a").alias("s"), F.sum("b").alias("q"))
    sums = cut_lineage(sums.join(numbers.toDF("id", "node"), "node").select(F.col("id").alias("node"), "s", "q"))
    forget(*levels, *done)
    return sums
