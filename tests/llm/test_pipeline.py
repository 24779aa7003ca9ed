"""The pipeline stage by stage on the smallest tables, against plain readings of each stage's rule."""

import numpy as np
import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as cp
from kgspark.llm.sentence_piece import ids_crc32
from kgspark.session import cut_lineage
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard_join import brute as near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(
        [(10**6, None, None, "src1", 0), (10**6 + 1, "12 34", "en", None, 5), (10**6 + 2, "", None, None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(cut_lineage(stage(spark, steps[-1], sf)))
    assert all(df.columns == COLUMNS for df in steps[:-1])
    rows = [{(r.doc_id, r.text) for r in df.collect()} for df in steps[:4]]
    assert rows[1] == {r for r in rows[0] if any(c.isalpha() for c in r[1] or "")}
    assert {k for k, _ in rows[2]} == {best for _, best, _, _ in copies(sorted(rows[1]))}
    linked = [eval(line) for line in near(sorted(rows[2]))]  # noqa: S307 - our own repr of tuples
    assert {k for k, _ in rows[3]} == {comp if n else key for key, n, comp in linked}
    mixed, known = steps[4].collect(), {k: t for k, t in rows[3]}
    assert {r.doc_id for r in mixed} <= set(known) and all(known[r.doc_id] == r.text for r in mixed)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, len(ids := library.encode(r.text)), ids_crc32(np.array(ids)), True, True) for r in mixed)
    assert sorted(map(tuple, steps[5].collect())) == want
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = cut_lineage(stage(spark, empty, sf))
    assert empty.count() == 0


def test_table_loaded_twice(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    nameless = docs.selectExpr("cast(null AS long) AS doc_id", "concat('zq ', text) AS text", "lang", "source", "n_chars").limit(20)
    once = cut_lineage(docs.unionByName(nameless))
    twice = cut_lineage(once.unionByName(once))
    for _, stage in cp.STAGES[1:3]:
        once, twice = (cut_lineage(stage(spark, df, sf)) for df in (once, twice))
        assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect()))


def test_registered():
    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
