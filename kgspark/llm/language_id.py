"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of byte n-grams (n = 2, 3,
4; letters A-Z folded, other ASCII signs and digits as one space) that both hold, over the root of the
product of their numbers. N-grams are hashed to a fixed number of features per n. A Nystroem map on
landmark texts turns the kernel into vectors; one-versus-rest kernel ridge regression is solved on
them. As the kernel is linear in the presence vector, landmarks, map and weights fold into one matrix
(features x languages), and a batch of whole texts is scored by one matrix product.

Learning uses a bounded sample: at most MAX_ROWS labelled texts of any length, taken by a hash of the
id in equal numbers per label, LANDMARKS of them as landmarks. Executors turn them into feature sets,
bit masks of FEATURES places, and only these go to the driver. The matrix has at most FEATURES x
max_labels entries, a parameter; labels beyond it are reported in a warning. Prediction reads every text whole and nothing but the text.

A text that is null or without a letter gets ``und`` and score 0, as does every text if nothing was
learned. Ties go to the first label in order. Null ids count as the empty string in the held-out
rule. Repeated rows, empty tables and other columns need no care: one row out per row in.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kgspark.llm.common import LOWER, UPPER, text_slices
from kgspark.llm.mixing import uniform

BITS = {2: 13, 3: 15, 4: 16}
FEATURES = sum(1 << b for b in BITS.values())
MAX_ROWS, LANDMARKS, MAX_LABELS, RIDGE = 1200, 200, 512, 1.0
UNKNOWN = "und"
_FOLD = bytearray(range(256))
for _i in range(128):
    _FOLD[_i] = _i if chr(_i).isalpha() else 0x20
_FOLD = bytes(_FOLD).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def held_out(key: Column) -> Column:
    """True for rows that learning must not see: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def folded(text: bytes) -> bytes:
    return b" " + text.translate(_FOLD) + b" "


def ngram_features(part: bytes) -> np.ndarray:
    """Feature of every n-gram of a folded text or part of one, repeats included."""
    data = np.frombuffer(part, np.uint8).astype(np.uint32)
    out, base, value = [], 0, data
    for n, bits in BITS.items():
        value = (value[:-1] << np.uint32(8)) | data[n - 1:]  # four bytes at most
        out.append(base + ((value * np.uint32(2654435761)) >> np.uint32(32 - bits)))
        base += 1 << bits
    return np.concatenate(out)


def presence(text: bytes) -> np.ndarray:
    """The distinct features of a text."""
    seen = np.zeros(FEATURES, bool)
    mark(seen, text, True)
    return np.flatnonzero(seen)


def mark(row: np.ndarray, text: bytes, value, piece: int = 1 << 20) -> None:
    """Set a text's features in ``row``; long texts go piece by piece with three bytes shared."""
    data = folded(text)
    for start in range(0, len(data), piece):
        row[ngram_features(data[start:start + piece + 3])] = value


def kernel(sets: Sequence[np.ndarray], landmarks: Sequence[np.ndarray], together: int = 48) -> np.ndarray:
    """Normalised presence kernel of feature sets with landmarks; products of bounded batches of sets."""
    marks = np.zeros((len(landmarks), FEATURES), np.float32)  # counts of up to FEATURES are exact
    for row, one in zip(marks, landmarks):
        row[one] = 1
    out, seen = np.empty((len(sets), len(landmarks))), np.zeros((min(together, len(sets)), FEATURES), np.float32)
    for at in range(0, len(sets), together):
        n = min(together, len(sets) - at)
        seen[:] = 0
        for k in range(n):
            seen[k, sets[at + k]] = 1
        sizes = np.outer(seen[:n].sum(axis=1, dtype=float), marks.sum(axis=1, dtype=float))
        out[at:at + n] = (seen[:n] @ marks.T) / np.sqrt(sizes)
    return out


class Masks(Sequence):
    """Feature sets held as bit masks and opened one at a time."""

    def __init__(self, masks: list[bytes]):
        self.masks = masks

    def __len__(self) -> int:
        return len(self.masks)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Masks(self.masks[at])
        return np.flatnonzero(np.unpackbits(np.frombuffer(self.masks[at], np.uint8), count=FEATURES))


def _masks(batches):
    """The feature set of each text as a bit mask."""
    for batch in batches:
        for first, texts in text_slices(batch.column("text")):
            seen, out = np.zeros(FEATURES, bool), []
            for text in texts:
                seen[:] = False
                mark(seen, text, True)
                out.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(texts)) for c in ("lang", "draw")),
                                              pa.array(out, pa.binary())], names=["lang", "draw", "mask"])


class Model:
    """Labels in order and the folded matrix."""

    def __init__(self, labels: list[str], matrix: np.ndarray):
        self.labels, self.matrix = labels, matrix

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """Labels in equal numbers should alternate in ``texts``: the first ones become landmarks."""
        return cls.fit_sets([presence(t) for t in texts], labels, landmarks, ridge)

    @classmethod
    def fit_sets(cls, sets: Sequence[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """The same from feature sets."""
        known = sorted(set(labels))
        if not known:
            return cls([], np.zeros((FEATURES, 0), np.float32))
        marks = sets[:landmarks]  # the landmark texts
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        use = values > 1e-8 * values[-1]
        to_space = vectors[:, use] / np.sqrt(values[use])
        space = kernel(sets, marks) @ to_space
        target = (np.array(labels)[:, None] == np.array(known)[None, :]).astype(float)
        weights = np.linalg.solve(space.T @ space + ridge * np.eye(space.shape[1]), space.T @ target)
        per_mark = to_space @ weights / np.sqrt([[len(m)] for m in marks])
        matrix = np.zeros((FEATURES, len(known)))
        for one, row in zip(marks, per_mark):
            matrix[one] += row
        return cls(known, matrix.astype(np.float32))

    def scores(self, texts: list[bytes], together: int = 48) -> np.ndarray:
        """(text, label) regression values; presence rows times the matrix, batch by batch."""
        out = np.empty((len(texts), len(self.labels)), np.float32)
        seen = np.zeros((min(together, len(texts)), FEATURES), np.float32)
        for at in range(0, len(texts), together):
            batch = texts[at:at + together]
            seen[:] = 0
            for row, text in zip(seen, batch):
                mark(row, text, 1)
            sizes = seen[:len(batch)].sum(axis=1, keepdims=True)
            out[at:at + len(batch)] = seen[:len(batch)] @ self.matrix / np.sqrt(sizes)
        return out


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  max_rows: int = MAX_ROWS, max_labels: int = MAX_LABELS) -> list:
    """At most ``max_rows`` rows (mask, lang), or one per label, labels alternating, each label's rows by hash of the id."""
    key = F.col(id_col)
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(key))
            .select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                    uniform(key, "lang").alias("draw"))
            .where(F.col("text").rlike(r"\p{L}")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels + 1).collect()
    if not counts:
        return []
    if len(counts) > max_labels:
        warnings.warn(f"more than {max_labels} labels: only the most frequent are learned; raise max_labels to learn all")
        counts = counts[:max_labels]
    quota = max(1, max_rows // len(counts))
    spark = docs.sparkSession
    # some more than the quota, so that no label goes without
    limits = spark.createDataFrame([(r.lang, max(1.5 * quota, quota + 12.0) / r["count"]) for r in counts], "lang string, share double")
    # at most max_labels rows
    drawn = (rows.join(F.broadcast(limits), "lang").where("draw < share").select("lang", "draw", "text")
             .mapInArrow(_masks, "lang string, draw double, mask binary"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "mask"))
    return sorted(drawn.select("lang", "mask", place.alias("place")).where(F.col("place") <= quota).collect(),
                  key=lambda r: (r.place, r.lang))


def learn(docs: DataFrame, **columns) -> Model:
    rows = training_rows(docs, **columns)
    return Model.fit_sets(Masks([bytes(r.mask) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, as struct ``row``, with the predicted label and its regression value between 0 and 1.

    Only the text goes through Python; the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.matrix))  # bounded, see above

    @F.arrow_udf(T.StructType([T.StructField(label_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Model(*shared.value)
        for batch in batches:
            names, values = [UNKNOWN] * len(batch), [0.0] * len(batch)
            if scorer.labels:
                for first, texts in text_slices(batch):
                    found = scorer.scores(texts)
                    best = found.argmax(axis=1)
                    for k, (label, value) in enumerate(zip(best.tolist(), found.max(axis=1).tolist())):
                        names[first + k], values[first + k] = scorer.labels[label], min(max(value, 0.0), 1.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[label_col, score_col])

    judged = judged.asNondeterministic()  # else a filter on the label would have it run twice
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spoken = text.rlike(r"\p{L}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spoken.alias("spoken"), judged(text).alias("found"))
    return rows.select("row", F.when(F.col("spoken"), F.col(f"found.{label_col}")).otherwise(UNKNOWN).alias(label_col),
                       F.when(F.col("spoken"), F.col(f"found.{score_col}")).otherwise(0.0).alias(score_col))


def identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in some language: all but those predicted ``und``, or, if nothing was learned,
    those whose text holds a letter. A row without a language gets the predicted one."""
    if not model.labels:
        return docs.where(F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"\p{L}"))
    kept = predict(docs, model, text_col).where(F.col("lang_pred") != UNKNOWN)
    return kept.select([F.coalesce(f"row.`{c}`", F.col("lang_pred").cast(kind)).alias(c) if c == lang_col else F.col(f"row.`{c}`").alias(c)
                        for c, kind in docs.dtypes])
