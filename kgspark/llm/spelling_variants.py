"""Spelling variants: every frequent word with its near words, its form and its root.

Words come from runs of Latin letters. Two words are near if one insertion, deletion or replacement
of a code point makes them equal; a word's form is its most frequent near word, if that is much more
frequent, and its root is the last form of a chain of forms.

Near words share everything but a hole: a word of L code points is cut into two halves, and of two near
words at least one half is alike. Words are grouped by (length class, hole, what lies around the hole);
the class of length L holds the words of L and of L + 1 code points. Groups that are still large are
dealt anew with the hole cut in two, down to holes of one code point, where the alphabet bounds a group.
Within a group the words stand sorted. A query scans them in order and keeps one banded edit-matrix row
per depth: the next word reuses the rows up to the prefix it shares with the one before, and a range of
words goes when the row at their shared prefix already exceeds one edit. All queries of a block take
their scan steps together. A link is counted only in the hole that holds the leftmost difference, so
links are found once whatever the cuts.

Null text has no words; a null id stands as an empty string in the damage rule; repeated rows count
again; words tied in n stand by code point order; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import text_slices
from kgspark.session import cut_lineage

DAMAGE = 199  # a run whose checksum this number divides loses a code point
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 6, 5, 5
HELD = 400_000  # distinct words a task counts before it sends them on
GROUP_CELLS = 1 << 17  # code points in holes of a group, beyond which the hole is cut in two
BLOCK = 1 << 14  # rows of whole groups scanned together

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = crc_table()


def crc32_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each run data[start:end], continued from a seed; all runs advance together."""
    crc = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    long = np.flatnonzero(size > 64)
    order = np.argsort(-size, kind="stable")
    order = order[len(long):]
    at, state, count = starts[order], crc[order], size[order]
    left = np.searchsorted(-count, -np.arange(65), side="left")  # runs longer than k come first
    for k in range(int(count.max(initial=0))):
        n = left[k]
        now = state[:n]
        state[:n] = _CRC[(now ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    crc[order] = state
    crc ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        crc[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(seeds[i]))
    return crc


def count_runs(ids: list, rows: list[bytes], counts: Counter, min_length: int, damage: int) -> None:
    """Add the words of some texts to ``counts``, by their UTF-8 bytes."""
    joined = b" ".join(rows).translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    letter = _ALPHA[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    edge = np.diff((letter | second).view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    seconds = np.concatenate(([0], np.cumsum(second)))
    length = ends - starts - (seconds[ends] - seconds[starts])
    kept = length >= min_length
    starts, ends, length = starts[kept], ends[kept], length[kept]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    counts.update(np.where(np.cumsum(inside[:-1]).astype(bool), data, np.uint8(32)).tobytes().split())
    first = np.cumsum([len(r) + 1 for r in rows])
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc32_of_runs(data, starts, ends, seeds[np.searchsorted(first, starts, side="right")])
    for i in np.flatnonzero(crc % damage == 0).tolist():
        run = joined[starts[i]:ends[i]]
        counts[run] -= 1
        if length[i] > min_length:
            text, gone = run.decode(), int(crc[i] % length[i])
            counts[(text[:gone] + text[gone + 1:]).encode()] += 1


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    def count(batches):
        counts: Counter = Counter()

        def held():
            found = [(w.decode(), n) for w, n in counts.items() if n]
            counts.clear()
            for at in range(0, len(found), 50_000):
                words, n = zip(*found[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, rows in text_slices(batch.column("text")):
                count_runs(ids[first:first + len(rows)], rows, counts, min_length, damage)
                if len(counts) > HELD:
                    yield from held()
        yield from held()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def holes(words: DataFrame) -> DataFrame:
    """(length, from, to, around, hole, word, n): each word in both halves of its own length class and of the shorter one."""
    size = F.length("word")
    classes = F.array(*[F.struct((size - d).alias("length"), lo.alias("from"), hi.alias("to"))
                        for d in (0, 1) for mid in [F.floor((size - d) / 2).cast("int")]
                        for lo, hi in ((F.lit(0), mid), (mid, size - d))])
    return _cut(words.select("word", "n", F.inline(classes)).where("`from` < `to`"))


def _cut(rows: DataFrame) -> DataFrame:
    """Hole and surroundings of rows (word, n, length, from, to); a longer word's hole is longer by one."""
    width = F.expr("`to` - `from` + length(word) - length")
    return rows.select("length", "from", "to", F.concat(F.expr("substring(word, 1, `from`)"),
                                                        F.substring("word", F.col("from") + width + 1, F.length("word"))).alias("around"),
                       F.substring("word", F.col("from") + 1, width).alias("hole"), "word", "n")


KEY = ["length", "from", "to", "around"]


def bounded_groups(entries: DataFrame, cells: int = GROUP_CELLS) -> DataFrame:
    """The entries, with the holes of large groups cut in two until every group is small or its hole one code point."""
    done = None
    while True:
        large = cut_lineage(entries.groupBy(*KEY).agg(F.count("*").alias("members"))
                            .where((F.col("to") - F.col("from") > 1) & (F.col("members") * (F.col("to") - F.col("from")) > cells))
                            .drop("members"))
        if large.isEmpty():
            return entries if done is None else done.unionByName(entries)
        small = entries.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        mid = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
        halves = F.array(F.struct(F.col("from").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("to").alias("hi")))
        entries = cut_lineage(_cut(entries.join(large, KEY, "left_semi").select("word", "n", "length", F.inline(halves))
                                   .withColumnsRenamed({"lo": "from", "hi": "to"})))


class SortedWords:
    """Sorted words of many groups as the nodes that adjacent common prefixes leave, in scan order."""

    def __init__(self, group: np.ndarray, texts: list[str]):
        n = len(texts)
        self.size = np.fromiter(map(len, texts), np.int64, n)
        width = int(self.size.max(initial=0)) + 2
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes = np.zeros((n, width), np.uint32)
        self.codes[np.repeat(np.arange(n), self.size), place] = flat
        same = np.logical_and.accumulate(self.codes[1:] == self.codes[:-1], axis=1).sum(axis=1)
        shared = np.concatenate(([0], np.where(group[1:] == group[:-1], np.minimum(same, self.size[1:]), 0)))
        # a word's own nodes: one per code point beyond the prefix shared with the word before
        fresh = self.size - shared
        first = np.cumsum(fresh) - fresh
        word = np.repeat(np.arange(n), fresh)
        self.depth = np.arange(int(fresh.sum())) - first[word] + shared[word] + 1
        self.code = self.codes[word, self.depth - 1]
        self.word = np.where(self.depth == self.size[word], word, -1)  # the word that ends here
        # a range ends at the next word that shares less, or at the group's end
        self.skip = self._range_ends(word, shared, first, group, n)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        total = len(self.code)
        begin = first[starts]
        self.begin = dict(zip(group[starts].tolist(), begin.tolist()))
        self.end = dict(zip(group[starts].tolist(), np.append(begin[1:], total).tolist()))

    def _range_ends(self, word, shared, first, group, n):
        total = len(word)
        skip = np.full(total, total, np.int64)
        held: list[tuple[int, int]] = []  # (depth, node) whose ranges are still open, deepest last
        size, low, node = self.size.tolist(), shared.tolist(), first.tolist()
        fresh_group = (np.diff(group, prepend=-1) != 0).tolist()
        for i in range(n):
            keep = 0 if fresh_group[i] else low[i]
            while held and held[-1][0] > keep:
                skip[held.pop()[1]] = node[i]
            held += [(d, node[i] + d - keep - 1) for d in range(keep + 1, size[i] + 1)]
        return skip


def scan(words: SortedWords, queries: np.ndarray, group: np.ndarray, cells: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) at one edit within a group; ``queries`` are numbers of words."""
    found_q, found_w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    depth_max = words.codes.shape[1]
    step = max(1, cells // (3 * depth_max))
    for at in range(0, len(queries), step):
        block = queries[at:at + step]
        rows = np.full((len(block), depth_max, 3), 3, np.int8)  # cells query position depth - 1, depth, depth + 1
        rows[:, 0, 1], rows[:, 0, 2] = 0, 1
        live = np.arange(len(block))
        node = np.array([words.begin[g] for g in group[block].tolist()], np.int64)
        stop = np.array([words.end[g] for g in group[block].tolist()], np.int64)
        on = node < stop
        live, node, stop = live[on], node[on], stop[on]
        while len(live):
            mine = block[live]
            depth, code = words.depth[node], words.code[node]
            before = rows[live, depth - 1]
            length = words.size[mine]
            q = words.codes
            one = np.where(depth >= 2, q[mine, np.maximum(depth - 2, 0)] != code, True)
            two = q[mine, np.minimum(depth - 1, depth_max - 1)] != code
            three = q[mine, np.minimum(depth, depth_max - 1)] != code
            a = np.minimum(before[:, 0] + one, before[:, 1] + 1)
            a[(depth - 1 > length)] = 3
            b = np.minimum(np.minimum(before[:, 1] + two, before[:, 2] + 1), a + 1)
            b[depth > length] = 3
            c = np.minimum(before[:, 2] + three, b + 1)
            c[depth + 1 > length] = 3
            rows[live, depth, 0], rows[live, depth, 1], rows[live, depth, 2] = np.minimum(a, 3), np.minimum(b, 3), np.minimum(c, 3)
            word = words.word[node]
            distance = np.where(length == depth, b, np.where(length == depth - 1, a, np.where(length == depth + 1, c, 3)))
            hit = (word >= 0) & (distance == 1)
            if hit.any():
                found_q.append(mine[hit])
                found_w.append(word[hit])
            node = np.where(np.minimum(np.minimum(a, b), c) > 1, words.skip[node], node + 1)
            on = node < stop
            if not on.all():
                live, node, stop = live[on], node[on], stop[on]
    return np.concatenate(found_q), np.concatenate(found_w)


def _links_of(table: pa.Table) -> pa.RecordBatch:
    """(word, near, near_n) of whole groups in order."""
    table = table.combine_chunks()
    n = table.num_rows
    lengths, lo, hi = (table.column(c).to_numpy() for c in KEY[:3])
    around, texts = table.column("around").to_pylist(), table.column("hole").to_pylist()
    alike = np.fromiter((a == b for a, b in zip(around[1:], around)), bool, max(n - 1, 0))
    alike &= (np.diff(lengths) == 0) & (np.diff(lo) == 0) & (np.diff(hi) == 0)
    group = np.concatenate(([0], np.cumsum(~alike)))
    words = SortedWords(group, texts)
    own = words.size == hi - lo  # the words of the class's own length ask; those longer by one are only found
    big = np.bincount(group) > 1
    q, w = scan(words, np.flatnonzero(own & big[group]), group)
    last = hi[q] == lengths[q]  # only here may the hole's text be a prefix of the longer word's
    longer = ~own[w]
    prefix = np.fromiter((texts[b].startswith(texts[a]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
    keep = ~longer | last | ~prefix
    q, w, longer = q[keep], w[keep], longer[keep]
    word, count = table.column("word"), table.column("n")
    me, near = np.concatenate((q, w[longer])), np.concatenate((w, q[longer]))
    return pa.RecordBatch.from_arrays([word.take(pa.array(me)).combine_chunks(), word.take(pa.array(near)).combine_chunks(),
                                       count.take(pa.array(near)).combine_chunks()], names=["word", "near", "near_n"])


def _same_group(table: pa.Table, i: int, j: int) -> bool:
    return all(table.column(c)[i].as_py() == table.column(c)[j].as_py() for c in KEY)


def _scan_partition(batches):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        cut = rows - 1  # the last group may go on
        while cut and _same_group(table, cut - 1, rows - 1):
            cut -= 1
        if cut:
            yield _links_of(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield _links_of(pa.Table.from_batches(held))


def near_links(words: DataFrame, cells: int = GROUP_CELLS) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words at one edit, once each."""
    entries = bounded_groups(holes(words), cells)
    dealt = entries.repartition(*KEY).sortWithinPartitions(*KEY, "hole")
    return dealt.mapInArrow(_scan_partition, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last form of each chain, by doubling; forms never run in circles."""
    known = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = known.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        step = cut_lineage(known.join(nxt, F.col("root") == F.col("of"), "left")
                           .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(words: DataFrame, factor: int = FORM_FACTOR, cells: int = GROUP_CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    words = cut_lineage(words)
    links = near_links(words, cells)
    best = (links.groupBy("word").agg(F.count("*").alias("n_near"),
                                      F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")))
    has = -F.col("best.minus") >= F.lit(factor) * F.col("n")
    rows = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return (rows.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
