"""Words, near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from check_queries import compare
from kgspark.llm import q12_spelling_variants
from kgspark.llm.spelling_variants import bounded_groups, crc32_of_runs, holes, near_links, spelling_variants, vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, min_length=6, min_count=5, damage=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, factor=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return rows


def answered(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def vocabulary_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("cells", [1 << 17, 40, 1])
def test_links_against_brute_force(spark, cells):
    rng = random.Random(cells)
    made = {"".join(rng.choices("abé", k=rng.randint(2, 8))) for _ in range(350)}
    made |= {"x" * k for k in range(2, 12)} | {"x" * k + "y" for k in range(2, 9)} | {"é" * 70, "é" * 71, "é" * 70 + "z", "ÿ" * 3}
    words = {w: rng.choice([1, 2, 5, 10, 30, 200]) for w in made}
    got = answered(spelling_variants(vocabulary_of(spark, words), cells=cells))
    assert len(got) == len(set(got)) and set(got) == brute(words)


def test_words_sharing_one_half(spark):
    """A large group is dealt anew with smaller holes, and no link is lost or doubled."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choices("abcd", k=rng.choice([5, 6]))): 1 for _ in range(1500)}
    entries = bounded_groups(holes(vocabulary_of(spark, words)), 500)
    assert entries.where("to - from < 4").count() > 0
    assert entries.groupBy("length", "from", "to", "around").count().where("to - from > 1 AND count * (to - from) > 500").isEmpty()
    links = [(r.word, r.near) for r in near_links(vocabulary_of(spark, words), 500).collect()]
    index = {}
    for w in words:
        for i in range(len(w)):
            index.setdefault(w[:i] + w[i + 1:], set()).add(w)
    expected = {(w, x) for group in index.values() for w in group for x in group if one_edit(w, x)}
    expected |= {p for short in words for long in index.get(short, ()) for p in ((short, long), (long, short))}
    assert len(links) == len(set(links)) and set(links) == expected


def test_checksums():
    data = np.frombuffer(b"0123456789abcdef" * 20, np.uint8)
    starts = np.array([0, 3, 10, 40, 7])
    ends = np.array([1, 3, 10 + 64, 40 + 65, 200])
    seeds = np.array([zlib.crc32(s) for s in (b"", b"a", b"12:", b"-1:", b":")], np.uint32)
    got = crc32_of_runs(data, starts, ends, seeds)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(seed)) for s, e, seed in zip(starts, ends, seeds)]


def test_vocabulary(spark, awkward):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcÀéÿ×", k=rng.randint(4, 9))) for _ in range(60)]
    rows = [(i if i % 17 else None, rng.choice([" ", "_", "1", "Ā", "ʼ"]).join(rng.choices(words, k=80)) + "WORD" * 30)
            for i in range(120)] + [(5, None), (6, ""), (7, "letter" * 200_000 + " end")] * 5
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), damage=7).collect()}
    assert got == brute_words(rows, damage=7) and max(map(len, got)) >= 1_199_999
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = {r.word: r.n for r in vocabulary(awkward, min_length=2, min_count=1).collect()}
    assert got == brute_words(rows, 2, 1)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert answered(spelling_variants(vocabulary(empty))) == []
    assert answered(spelling_variants(spark.createDataFrame([("alone", 7)], "word string, n long"))) == [("alone", None, "alone", 7, 0, None)]


def test_query(spark, sf):
    df = q12_spelling_variants.op12_spelling_variants(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = brute_words(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {r[0]: r[3] for r in rows} == words
    cur = con.execute(q12_spelling_variants.SQL)
    assert compare(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None
