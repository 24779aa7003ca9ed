"""Language identification: the folded matrix equals the kernel form, held-out accuracy, awkward rows."""

import zlib

import numpy as np

from kgspark.llm import language_id as li
from kgspark.llm.q03_language_id import op3_language_id


def test_matrix_equals_kernel():
    texts = [t.encode() for t in ["the cat sat on the mat", "le chat est sur la table", "der Hund und die Katze",
                                  "a dog and a cat", "une fille et un garçon", "das Kind ist müde"] * 2]
    labels = ["en", "fr", "de"] * 4
    model = li.Model.fit(texts, labels, landmarks=6)
    sets = [li.presence(t) for t in texts]
    by_hand = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets[:6]] for a in sets])
    assert np.allclose(by_hand, li.kernel(sets, sets[:6]))
    values, vectors = np.linalg.eigh(by_hand[:6])
    use = values > 1e-8 * values[-1]
    space = by_hand @ (vectors[:, use] / np.sqrt(values[use]))
    target = (np.array(labels)[:, None] == np.array(["de", "en", "fr"])).astype(float)
    ridge = space @ np.linalg.solve(space.T @ space + np.eye(use.sum()), space.T @ target)
    assert np.allclose(model.scores(texts), ridge, atol=1e-4)


def test_pieces_of_long_texts():
    text, whole, parts = b"abc Def " * 500, np.zeros(li.FEATURES, bool), np.zeros(li.FEATURES, bool)
    li.mark(whole, text, True)
    li.mark(parts, text, True, piece=100)
    assert (whole == parts).all()


def test_op3(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_learning_sees_no_held_out_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 'zzz zzz', text) AS text",
                            "if(crc32(cast(doc_id AS string)) % 5 = 0, 'xx', lang) AS lang")
    a, b = li.learn(docs), li.learn(other)
    assert a.labels == b.labels and (a.matrix == b.matrix).all()


def test_awkward_rows(spark, sf, awkward):
    model = li.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = li.predict(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        silent = not any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") == silent and (r.score == 0 or not silent)
    kept = li.identified(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    nothing = li.learn(awkward.where("lang = 'none'"))
    assert {r.lang_pred for r in li.predict(awkward, nothing).collect()} == {"und"}
    assert li.predict(awkward.limit(0), model).count() == 0


def test_languages_of_long_texts_only(spark):
    short, long = "the cat sat on the mat ", "le chat noir est couché sur la table "
    rows = [(i, short + str(i), "en") for i in range(60)] + [(100 + i, long * 1200 + str(i), "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert model.labels == ["en", "fr"]
    assert all(r.lang_pred == r.row.lang for r in li.predict(docs, model).collect())
    sets = [li.presence(t.encode()) for _, t, _ in rows[55:65]]
    packed = li.Masks([np.packbits(np.isin(np.arange(li.FEATURES), s)).tobytes() for s in sets])
    assert (li.kernel(sets, sets[:3]) == li.kernel(packed, packed[:3])).all()
    books = docs.where("lang = 'fr'")
    assert li.learn(books).labels == ["fr"]


def test_texts_with_letters_stay_when_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 34", None), (3, None, None), (4, "語", None)],
                                 "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert model.labels == [] and sorted(r.doc_id for r in li.identified(docs, model).collect()) == [1, 4]
