"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm import boosting
from tickwell.llm.shingles import slices, text_buffers, word_hashes
from tickwell.llm.work import crc_mod, small, table

#: Bound of the labelled rows that the trees are fitted on: those of the smallest hashes of their ids.
TRAIN_ROWS = 20_000
HELD_OUT_OF, HELD_OUT = 3, 1

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": [32, 9], "line": [10], "bar": [124], "bang": [33], "stop": [46], "comma": [44], "symbol": [*range(35, 39), 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126], "beyond": range(128, 256)}
FEATURES = [*(f"share_{c}" for c in _CLASSES), "log_bytes", "entropy", "log_words", "word_bytes", "distinct_words", "same_as_before", "top_word", "lines_per_word", "distinct_lines", "longest_line"]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _k


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; an empty or null text has zeros."""
    raw, at = text_buffers(column)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    c = len(_CLASSES)
    for i, j in slices(at):
        part, place = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        hashes, words = word_hashes(part, place)
        end = np.cumsum(words)
        for r, (a, b, wa, wb) in enumerate(zip(place[:-1], place[1:], end - words, end, strict=True), i):
            own = part[a:b]
            size, n = len(own), wb - wa
            if not size:
                continue
            counts = np.bincount(own, minlength=256)
            out[r, :c] = np.bincount(_KIND, counts, c + 1)[:c] / size
            share = counts[counts > 0] / size
            lines = own.tobytes().split(b"\n")
            out[r, c : c + 3] = np.log1p(size), -(share * np.log2(share)).sum(), np.log1p(n)
            if n:
                w = hashes[wa:wb]
                same = int((w[1:] == w[:-1]).sum())
                _, times = np.unique(w, return_counts=True)
                out[r, c + 3 : c + 7] = size / n, len(times) / n, same / n, times.max() / n
            out[r, c + 7 : c + 10] = len(lines) / (n + 1), len(set(lines)) / len(lines), np.log1p(max(map(len, lines)))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> boosting.Forest:
    """Trees from at most ``rows`` rows of ``labels`` (id, 0/1) that are not held out; labels that are null or have no document count for nothing."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(f"y IN (0, 1) AND id IS NOT NULL")
    known = known.where(crc_mod(F.col("id"), HELD_OUT_OF) != HELD_OUT).orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    some = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = some.mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)
    return boosting.fit(x[order], got["y"].to_numpy().astype(float)[order])


def score(docs: DataFrame, model: boosting.Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, for every row; null texts are scored as empty ones. A null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: boosting.Forest, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(model.score(statistics(batch.column(place).cast(pa.string()))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
