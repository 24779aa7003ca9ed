"""Licence scan by diagonal voting.

Every run of two words of every text is hashed (rolling sums of word hashes) and joined with the
places of the same two words in short licence templates. A match votes for the diagonal (place in the
text less place in the template); votes of a diagonal are bit masks of the template's places, 63 to a block,
so repeats count once and a template may have any length. Neighbouring diagonals, as a word too many or too few makes them, are merged, and
a merged span is verified: the share of the template it covers, and its length. A chain of neighbours that
gets longer than a stretched template falls into windows of diagonals, each of them verified; a window that
covers too little still gives its best diagonal. A base phrase must
stand as it is: all places on one diagonal.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. Null text is empty. Rows that
repeat id and text are told apart by neither and get the same result each; equal ids with other texts
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kgspark.llm.common import LOWER, UPPER, Words, separator_table, text_slices
from kgspark.session import cut_lineage

K = 2
#: The phrases asked for and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of public licences and licence notices, opening sentences and parts of the body.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to "
            "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
            "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
            "contract tort or otherwise arising from out of or in connection with the software or the use or other "
            "dealings in the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied see "
               "the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the "
            "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license "
            "for more details"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied "
            "warranties including but not limited to the implied warranties of merchantability and fitness for a "
            "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
            "direct indirect incidental special exemplary or consequential damages"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including "
            "all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
            "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
COVERED, STRETCH, SLACK = 0.7, 1.5, 2
BLOCK = 63  # places of a vote mask
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
SEPARATORS = separator_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def template_table(templates: list[tuple[str, str]], base: dict[str, str]) -> list[tuple]:
    """(gram hash, template number, place, grams of the template, label, is a base phrase)."""
    rows = []
    listed = [(label, text, True) for text, label in base.items()] + [(label, text, False) for label, text in templates]
    for number, (label, text, is_base) in enumerate(listed):
        places, hashes = Words([text.lower().encode()], SEPARATORS).grams(K)
        if not len(places):
            raise ValueError(f"a template has two words at least: {text!r}")
        rows += [(h, number, p, len(places), label, is_base) for p, h in zip(places.tolist(), hashes.view(np.int64).tolist())]
    return rows


def _grams(batches):
    """Rows (id, text hash, place, gram hash); place -1 holds the number of words."""
    for batch in batches:
        keys, prints = batch.column("id"), batch.column("print")
        for first, texts in text_slices(batch.column("text"), 1 << 20):
            words = Words([t.translate(_FOLD) for t in texts], SEPARATORS)
            index, hashes = words.grams(K)
            row = words.row[index]
            take = pa.array(np.concatenate((np.arange(len(texts)), row)) + first)
            yield pa.RecordBatch.from_arrays(
                [keys.take(take), prints.take(take),
                 pa.array(np.concatenate((np.full(len(texts), -1), index - words.first[row]))),
                 pa.array(np.concatenate((words.count, hashes.view(np.int64))))],
                names=["id", "print", "place", "gram"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=tuple(TEMPLATES),
                  base: dict[str, str] = BASE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): one row (id, print, n_words) per row of docs, and one row (id, print, label,
    is_base, start, end, covered) per verified span; ``print`` tells texts of one id apart."""
    votes = cut_lineage(_votes(docs, id_col, text_col, templates, base))
    return (votes.where("template IS NULL").select("id", "print", F.col("word").alias("n_words"), F.explode(
                F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")).drop("copy"),
            _spans(votes.where("template IS NOT NULL")))


def _votes(docs: DataFrame, id_col: str, text_col: str, templates, base) -> DataFrame:
    """Per diagonal: its votes and the places they cover; and a row without template per text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    grams = (docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
             .mapInArrow(_grams, "id long, print long, place long, gram long"))
    # a fixed table of at most a few hundred rows
    table = docs.sparkSession.createDataFrame(
        template_table(list(templates), base),
        "hash long, template int, at int, n_grams int, label string, is_base boolean")
    matched = (grams.join(F.broadcast(table), (grams.gram == table.hash) & (grams.place >= 0), "left")
               .where("place < 0 OR template IS NOT NULL"))
    return (matched.groupBy("id", "print", "template", "n_grams", "label", "is_base",
                            (F.col("place") - F.col("at")).alias("diagonal"), F.expr(f"at div {BLOCK}").alias("block"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(at % {BLOCK} AS int))")).alias("mask"),
                 F.min("place").alias("start"), F.max("place").alias("last"),
                 F.max("gram").alias("word"), F.count("*").alias("rows")))


def _spans(votes: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals of a template and keep the spans that verify."""
    owner = ["id", "print", "template"]
    along = Window.partitionBy(*owner).orderBy("diagonal")
    apart = F.when(F.col("is_base"), F.lit(0)).otherwise(F.lit(SLACK))
    before = F.lag("diagonal").over(along)
    chained = votes.withColumn("chain", F.sum((before.isNull() | (F.col("diagonal") - before > apart)).cast("int")).over(
        along.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = Window.partitionBy(*owner, "chain")
    length = F.max("last").over(chain) + K - F.min("start").over(chain)
    width = F.greatest(F.lit(1), F.floor((STRETCH - 1) * F.col("n_grams")))
    window = F.floor((F.col("diagonal") - F.min("diagonal").over(chain)) / width)
    parted = chained.withColumn("part", F.when(length <= F.col("n_grams") * STRETCH + K, F.lit(0)).otherwise(window))
    # the blocks of a diagonal, and of a part of a chain, add up
    diagonals = (parted.groupBy(*owner, "chain", "part", "n_grams", "label", "is_base", "diagonal")
                 .agg((F.sum(F.bit_count("mask")) / F.col("n_grams")).alias("covered"), F.min("start").alias("start"),
                      F.max("last").alias("last"))
                 .groupBy(*owner, "chain", "part", "n_grams", "label", "is_base")
                 .agg(F.max(F.struct("covered", (-F.col("start")).alias("back"), "last")).alias("best"),
                      F.min("start").alias("start"), F.max("last").alias("last")))
    union = (parted.groupBy(*owner, "chain", "part", "block").agg(F.bit_or("mask").alias("mask"))
             .groupBy(*owner, "chain", "part").agg(F.sum(F.bit_count("mask")).alias("places")))
    covered = F.col("places") / F.col("n_grams")
    least = F.when(F.col("is_base"), 1.0).otherwise(COVERED)
    tight = F.col("last") + K - F.col("start") <= F.col("n_grams") * STRETCH + K
    spans = (diagonals.join(union, [*owner, "chain", "part"])
             .select("id", "print", "label", "is_base", least.alias("least"),
                     F.when(tight, F.col("start")).otherwise(-F.col("best.back")).alias("start"),
                     (F.when(tight, F.col("last")).otherwise(F.col("best.last")) + K).alias("end"),
                     F.when(tight, covered).otherwise(F.col("best.covered")).alias("covered")))
    return spans.where("covered >= least").drop("least")


def license_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=tuple(TEMPLATES),
                 base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: places of base phrases, labels and score, as the contract names them."""
    # both uses below read what the join found, a few rows per text
    votes = cut_lineage(_votes(docs, id_col, text_col, templates, base))
    spans = (_spans(votes.where("template IS NOT NULL"))
             .select("id", "print", "label", "is_base", "start", "covered",
                     F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("rows")))
    texts = (votes.where("template IS NULL")
             .select("id", "print", F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_base"),
                     F.lit(None).cast("long").alias("start"), F.lit(None).cast("double").alias("covered"),
                     F.col("word").alias("n_words"), "rows"))
    base = F.col("is_base")

    def listed(condition):
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    return (texts.unionByName(spans).groupBy("id", "print")
            .agg(F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
                 F.min(F.when(base, F.col("start"))).alias("first_word"),
                 F.max(F.when(base, F.col("start"))).alias("last_word"),
                 listed(base).alias("base_labels"), listed(F.col("label").isNotNull()).alias("labels"),
                 F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"), F.sum("rows").alias("rows"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
            .select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
