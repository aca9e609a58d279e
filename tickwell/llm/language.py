"""Language identification by nearest centroid: TF-IDF vectors of character n-grams and cosine.

A text that lies too far from its nearest centroid is rejected. How far is too far depends on the
language and on the text's length (its distinct n-grams, by powers of two), as short texts lie far
from every centroid: the limit is learnt from training texts and from pieces cut out of them, for
each length the distance that one in a thousand exceeds, plus a margin, and for a shorter length
never less than for a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import slices, text_buffers
from tickwell.llm.work import crc_mod, small, table

UNKNOWN = "und"
#: Hashed n-grams of one to three bytes of the lower-cased text, with all that is no letter as one blank.
DIMENSIONS = 4096
#: Bound of the documents of a language that its centroids are fitted on (in expectation; ids of the smallest hashes).
TRAIN_ROWS = 2_000
CENTROIDS = 4
#: A text farther from its nearest centroid than this share of the training texts and pieces of its language and length, by this much, is rejected.
QUANTILE, MARGIN = 0.999, 0.1
#: Lengths: powers of two of distinct n-grams.
LENGTHS = DIMENSIONS.bit_length()
HELD_OUT_OF, HELD_OUT = 4, 2
#: Rows of a matrix of counts (8 MB).
_ROWS = 256

_BLANKED = np.arange(256, dtype=np.int64)
_BLANKED[:128] = 32
_BLANKED[97:123] = np.arange(97, 123)


def ngram_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """(rows, DIMENSIONS) counts for runs of rows of a string array."""
    raw, at = text_buffers(pc.utf8_lower(column))
    runs = [(a, min(a + _ROWS, j)) for i, j in slices(at, 1 << 18) for a in range(i, j, _ROWS)]
    for i, j in runs:
        own, place = _BLANKED[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
        row = np.repeat(np.arange(j - i), np.diff(place))
        keys = [(row * DIMENSIONS + own)[own != 32]]
        code = own
        for n in (2, 3):
            code = code[: len(own) - n + 1] * 256 + own[n - 1 :]
            low = (code * 0x9E3779B1 >> 7) % (DIMENSIONS - 256) + 256
            fits = (row[: len(low)] == row[n - 1 :]) & ((own[: len(low)] != 32) | (own[1 : len(low) + 1] != 32)) & (code & 0xFFFF != 0x2020)
            keys.append((row[: len(low)] * DIMENSIONS + low)[fits])
        yield np.bincount(np.concatenate(keys), minlength=(j - i) * DIMENSIONS).reshape(j - i, DIMENSIONS)


def length_of(counts: np.ndarray) -> np.ndarray:
    """Power of two of each row's distinct n-grams, rounded down; 0 without any."""
    return np.frexp(np.maximum((counts > 0).sum(axis=1), 1))[1] - 1


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a row without n-grams stays zero."""
    v = counts.astype(np.float32) * idf.astype(np.float32)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMENSIONS), unit
    radius: np.ndarray  # (n, LENGTHS): the largest cosine distance that is not rejected
    language: list[str]  # by centroid

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, whether rejected."""
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not len(self.language):
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        near, best, limit = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for counts in ngram_counts(column):
            cosine = vectors(counts, self.idf) @ self.centroids.T
            best.append(cosine.argmax(axis=1))
            limit.append(self.radius[best[-1], length_of(counts)])
            near.append(cosine[np.arange(len(cosine)), best[-1]])
        at, score = np.concatenate(best), np.clip(np.concatenate(near).astype(float), 0, 1) * lettered
        found = [self.language[c] if ok else UNKNOWN for c, ok in zip(at.tolist(), lettered.tolist(), strict=True)]
        return found, score, ~lettered | (1 - score > np.concatenate(limit))


def _clusters(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; each start is farther from the earlier ones than nine of ten rows, but no outlier."""
    mean = v.mean(axis=0)
    c = (mean / max(np.linalg.norm(mean), 1e-9))[None]
    while len(c) < min(k, len(v)):
        c = np.concatenate((c, v[np.argsort((v @ c.T).max(axis=1), kind="stable")[len(v) // 10]][None]))
    for _ in range(rounds):
        home = (v @ c.T).argmax(axis=1)
        c = np.stack([v[home == i].sum(axis=0) if (home == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def pieces(texts: list[str]) -> list[str]:
    """One run of words out of each text, of 1, 2, 4 ... 64 words in turn."""
    out = []
    for i, text in enumerate(texts):
        own, size = text.split(), 1 << i % 7
        at = i * 7919 % max(1, len(own) - size + 1)
        out.append(" ".join(own[at : at + size]))
    return out


def _known(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and lengths of the texts that have n-grams."""
    v, length = [np.zeros((0, DIMENSIONS), np.float32)], [np.zeros(0, np.int64)]
    for counts in ngram_counts(texts):
        some = counts[counts.any(axis=1)]
        v.append(vectors(some, idf))
        length.append(length_of(some))
    return np.concatenate(v), np.concatenate(length)


def limits(far: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By length: the QUANTILE of the distances of that length, or that of a longer one if it is larger, plus MARGIN."""
    out, least = np.empty(LENGTHS), 0.0
    for n in range(LENGTHS - 1, -1, -1):
        if (some := length == n).any():
            least = max(least, float(np.quantile(far[some], QUANTILE)))
        out[n] = least
    return out + MARGIN


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Document frequencies over all documents that may be learnt from; centroids and limits from about ``rows`` of each language at most.

    Rows without text, language or id are not learnt from; repeated rows count each. Other columns are
    not read. From an empty table nothing is learnt, and every text is ``und``.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod(F.col("id"), HELD_OUT_OF) != HELD_OUT, F.lit(False)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in small(batches):
            for counts in ngram_counts(batch.column(0)):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *total[some].tolist()], pa.int64())], ["dimension", "df"])

    got = {r[0]: r[1] for r in own.select("text").mapInArrow(frequencies, "dimension long, df long").groupBy("dimension").agg(F.sum("df")).collect()}
    n = got.pop(-1, 0)
    df = np.array([got.get(i, 0) for i in range(DIMENSIONS)], float)
    idf = np.log((1 + n) / (1 + df)) + 1

    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(min(1.0, rows / v)))]) if sizes else None
    if share is None:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, LENGTHS)), [])
    some = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    sample = some.select("lang", "text").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    centroids, radii, names = [], [], []
    for name in sorted(sizes):
        part = sample.filter(pc.equal(sample["lang"], name))
        if not len(part):
            continue
        v, length = _known(part["text"].combine_chunks(), idf)
        if len(v):
            c = _clusters(v, CENTROIDS)
            cut, cut_length = _known(pa.array(pieces(part["text"].to_pylist()), pa.string()), idf)
            far = [1 - (x @ c.T).max(axis=1) for x in (v, cut) if len(x)]
            centroids.append(c)
            radii.append(np.tile(limits(np.concatenate(far), np.concatenate((length, cut_length))), (len(c), 1)))
            names += [name] * len(c)
    if not names:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, LENGTHS)), [])
    return Model(idf, np.concatenate(centroids).astype(np.float32), np.concatenate(radii), names)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected, for every row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if
    there was nothing to learn from. A null id is not held out. Repeated rows come back once each;
    of centroids that are equally near, the first language by name is taken. Long texts are read
    whole. Other columns are not read, whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, score, rejected = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return named.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(~model.predict(batch.column(place).cast(pa.string()))[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
