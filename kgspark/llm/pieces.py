"""Texts as runs of pieces, each distinct piece tokenized once.

A tokenizer that cuts a text into pieces first and then works on each piece alone gives a text the
tokens of its pieces in order. Here the cuts of many texts are found at once on arrays of code
points; equal pieces are met by a 64-bit hash, and only pieces not seen before go to the tokenizer.
The memo is bounded and forgets everything when full, which changes no result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from kgspark.llm.common import run_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)),
                            np.uint8, 0x110000)
        table[_SPACES] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def parts(texts: list[str], limit: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """Lists of (text number, part) of about ``limit`` characters together. A longer text is cut before
    a single space between two other characters, where every scheme below starts a piece."""
    held, size = [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            cut = _LONE_SPACE.search(text, start + limit) if len(text) - start > limit else None
            part = text[start:cut.start()] if cut else text[start:]
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
            if not cut:
                break
            start = cut.start()
    if held:
        yield held


def byte_level_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the matches of the byte-level scheme: 's|'t|'re|'ve|'m|'ll|'d, or runs of letters, of
    numbers or of other signs, each with one space before, or white space up to what a run can take.

    ``first`` marks the first character of each text.
    """
    n = len(codes)
    kind = char_classes()[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    inside = np.zeros(n, bool)  # the next character belongs to the same text
    inside[:-1] = ~first[1:]
    run_end = np.ones(n, bool)
    run_end[:-1] = start[1:]
    sign = np.flatnonzero((codes == 39) & start & run_end & inside)
    last = np.flatnonzero((kind == SPACE) & run_end & inside)
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    sign = sign[start[sign]]
    one, two = codes[sign + 1], np.where(sign + 2 < n, codes[np.minimum(sign + 2, n - 1)], 0)
    two[~inside[sign + 1]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[sign[short | long] + 1] = False
    after = np.concatenate((sign[short] + 2, sign[long] + 3))
    after = after[after < n]
    start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


def metaspace_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A piece starts at each text's first character and at each run of spaces (or of the space mark)."""
    space = (codes == 0x20) | (codes == 0x2581)
    start = space.copy()
    start[1:] &= ~space[:-1]
    return np.flatnonzero(start | first)


class PieceMemo:
    """Token ids of texts through their pieces."""

    def __init__(self, encode: Callable[[list[str]], list], starts: Callable, limit: int = 3_000_000):
        """``encode`` gives the ids of each piece; ``starts`` finds pieces in code points."""
        self.encode, self.starts, self.limit = encode, starts, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.recent: dict[int, int] = {}
        self.length, self.begin = np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int64)
        self.flat, self.used, self.count = np.empty(1 << 14, np.uint32), 0, 0

    def _slots_of(self, hashes: np.ndarray, text_of: Callable[[int], str]) -> np.ndarray:
        """Slots of distinct hashes; unknown ones are encoded, ``text_of`` gives their pieces."""
        if self.count + len(hashes) > self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        slots = np.full(len(hashes), -1, np.int64)
        slots[known] = self.slots[at[known]]
        missing = [(i, h) for i, h in zip(np.flatnonzero(~known).tolist(), hashes[~known].tolist())]
        new = []
        for i, h in missing:
            slot = self.recent.get(h, -1)
            slots[i] = slot
            if slot < 0:
                new.append((i, h))
        if new:
            found = self.encode([text_of(i) for i, _ in new])
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            ids = np.fromiter((x for one in found for x in one), np.uint32, int(lengths.sum()))
            self._append(lengths, ids)
            for k, (i, h) in enumerate(new):
                slots[i] = self.recent[h] = self.count - len(new) + k
            if len(self.recent) > 100_000:
                self.keys = np.concatenate((self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))))
                self.slots = np.concatenate((self.slots, np.fromiter(self.recent.values(), np.int64, len(self.recent))))
                order = np.argsort(self.keys)
                self.keys, self.slots, self.recent = self.keys[order], self.slots[order], {}
        return slots

    def _append(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.count + len(lengths) > len(self.length):
            self.length, self.begin = np.resize(self.length, 2 * len(self.length)), np.resize(self.begin, 2 * len(self.begin))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[self.count:self.count + len(lengths)] = lengths
        self.begin[self.count:self.count + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used:self.used + len(ids)] = ids
        self.count, self.used = self.count + len(lengths), self.used + len(ids)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, slot) of every piece of non-empty texts, in order."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(sizes) - sizes
        first = np.zeros(len(codes), bool)
        first[edges] = True
        begin = self.starts(codes, first)
        end = np.append(begin[1:], len(codes))
        hashes, sample, which = np.unique(run_hashes(codes, begin, end), return_index=True, return_inverse=True)
        slots = self._slots_of(hashes, lambda i: joined[begin[sample[i]]:end[sample[i]]])
        per = np.diff(np.searchsorted(begin, edges), append=len(begin))
        return np.repeat(np.arange(len(texts)), per), slots[which]

    def _runs(self, texts: list[str]):
        """(text numbers, slots) of the pieces of a bounded run of texts, run after run."""
        for held in parts(texts):
            held = [(i, part) for i, part in held if part]
            if held:
                of, slots = self._pieces([part for _, part in held])
                yield np.array([i for i, _ in held])[of], slots

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        for of, slots in self._runs(texts):
            total += np.bincount(of, self.length[slots], minlength=len(texts)).astype(np.int64)
        return total

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts in a row, tokens of each text)."""
        total, out = np.zeros(len(texts), np.int64), []
        for of, slots in self._runs(texts):
            lengths = self.length[slots].astype(np.int64)
            total += np.bincount(of, lengths, minlength=len(texts)).astype(np.int64)
            shift = self.begin[slots] - (np.cumsum(lengths) - lengths)
            out.append(self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())])
        return np.concatenate(out) if out else np.empty(0, np.uint32), total
