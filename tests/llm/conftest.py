import os

import pytest


@pytest.fixture(scope="session")
def sf():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    return folder


AWKWARD = ["", None, "a", " ", "  two  spaces ", "don't we'll 'tis 's 're x'S", "Ünïcode 語 語　x y", "\n\n a\r\n\tb ",
           "end <|endoftext|> mid<|endoftext|>", "12 345abc_!? (…)", "▁mark ▁ <s> <0x41> </s>", "\U0001F600\U0001F600 �",
           "A" * 5000, "word " * 5000, "x​y ´ ʼs ﬁ Ⅳ ² ª", "mit license MIT License apache-license general public license"]


@pytest.fixture
def awkward(spark):
    """Rows with null, empty and repeated fields, and columns whose names clash with results."""
    rows = [(i if i != 3 else None, t, i) for i, t in enumerate(AWKWARD)] + [(2, "a", 0), (2, "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").selectExpr(
        "*", "'x' AS id", "1 AS size", "if(doc_id % 3 = 0, null, concat('s', doc_id % 3)) AS source", "'en' AS lang")
