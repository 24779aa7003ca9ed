"""Licence scan: base phrases against a direct search, method labels on planted notices."""

import re

from kgspark.llm import license_scan as ls
from kgspark.llm.q04_license_scan import op4_license_scan

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in ls.BASE.items():
        parts = phrase.split()
        hits = [i for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    found = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    assert found == sorted(repr((k, *base_of(t))) for k, t in texts)
    for r in rows:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(r.base_labels.split(",")) - {""} <= set(labels) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(labels)


def test_op4(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_license_scan(spark, sf).collect()
    check(rows, docs)
    by = {r.doc_id: r.labels for r in rows}
    for key, text in docs:
        assert ("cc-by-nc" in by[key]) == ("CC BY-NC 4.0" in text)


def test_awkward_rows(spark, awkward):
    check(ls.license_rows(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    assert ls.license_rows(awkward.limit(0)).count() == 0


def test_spans(spark):
    gpl = "this program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    rows = [(1, "x y " + gpl + " z"), (2, gpl.replace("you can ", "").replace("terms", "very terms")), (3, "free software is fun"),
            (4, "MIT license. mit-license MIT/LICENSE"), (5, "Released under the MIT License.\n" * 2000), (6, "general public"),
            (7, "the license the license the license licensed under the apache license version 2 0 the license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in ls.license_rows(df).collect()}
    check(found.values(), rows)
    assert [found[i].labels for i in range(1, 8)] == ["gpl", "gpl", "", "mit", "mit", "", "apache"]
    assert found[5].n_base == 2000 and found[4].n_base == 3 and found[2].score >= 1.0
    texts, spans = ls.scan_licenses(df)
    assert texts.count() == 7
    first = [s for s in spans.where("id = 1 AND NOT is_base").collect()]
    assert [(s.label, s.start, s.end) for s in first] == [("gpl", 2, 2 + len(gpl.replace("/", " ").split()))]


def test_long_templates_and_chains(spark):
    """A template of more than 63 places, and many spans of one chain of neighbouring diagonals."""
    body = " ".join(f"w{i}" for i in range(200))
    short = "alpha beta alpha beta gamma"
    templates = [("long", body), ("short", short)]
    run = "alpha beta " * 40  # every second diagonal has votes
    rows = [(1, "x " + body + " y"), (2, body.replace("w77 ", "").replace("w150 ", "w150 extra ")), (3, " ".join(body.split()[:100])),
            (4, f"{short} {run} {short} {run} {short}"), (5, run), (6, body + " " + body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, spans = ls.scan_licenses(df, templates=templates)
    found = {}
    for s in spans.where("NOT is_base").collect():
        found.setdefault(s.id, []).append((s.label, s.start, s.end))
    assert found[1] == [("long", 1, 201)] and [x[0] for x in found[2]] == ["long"] and 3 not in found and len(found[6]) == 2
    # each notice of the chain lies in a span of its own
    words = rows[3][1].split()
    places = [i for i in range(len(words)) if words[i:i + 5] == short.split()]
    assert len(places) == 3 and all(any(s < p + 5 and p < e for _, s, e in found[4]) for p in places)
