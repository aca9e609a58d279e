"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest 64-bit hashes of a document's distinct shingles (all of them
where there are fewer). The union of two documents' sketches cut to k is the sketch of their
union, so parts can be sketched apart and merged. Estimates are exact while a document has no
more than k shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import WIDTH, shingle_sets
from tickwell.llm.work import small, table

K = 128
_RANGE = float(2**64)


def sketch(own: np.ndarray, k: int = K) -> np.ndarray:
    """Of a document's distinct hashes in ascending order."""
    return own[:k].copy()


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of Jaccard similarity; two empty sketches: 1."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of how many distinct shingles were sketched."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / _RANGE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has; an empty a: 1."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    """Base64 of the hashes, 8 bytes each, big-endian, ascending."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(texts: list[str], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """A sketch for each whole text."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    return [sketch(own, k) for own in shingle_sets(np.frombuffer(b"".join(data), np.uint8), at, width)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles (estimate) and fingerprint of every row; null and empty texts have an empty sketch. Rows pass through one by one: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = sketches([x or "" for x in batch.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([distinct_count(x, k) for x in made]), pa.array([encode(x) for x in made], pa.string())], ["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles double, fingerprint string")


def _edited(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in ascending order, then the row that follows the range (``guest``)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: tuple[int, str, np.ndarray] | None = None
    for batch in small(batches):
        ids, guests = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        texts = [x or "" for x in batch.column(1).to_pylist()]
        rows = list(zip(ids, texts, sketches(texts, k), guests, strict=True))
        done: list[tuple] = []
        for i, t, s, guest in rows:
            if held is not None:
                done.append((*held, t, s))
            held = None if guest else (i, t, s)
        edited = [t[: len(t) - len(t) // 4] + follow[: len(t) // 4] for _, t, _, follow, _ in done]
        made = sketches(edited, k)
        columns = [
            pa.array([i for i, *_ in done], pa.int64()),
            pa.array([len(t) for _, t, *_ in done], pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
            pa.array([encode(s) for _, _, s, _, _ in done], pa.string()),
            pa.array([encode(x) for x in made], pa.string()),
            pa.array([resemblance(s, x, k) for (_, _, s, _, _), x in zip(done, made, strict=True)], pa.float64()),
            pa.array([resemblance(s, follow, k) for _, _, s, _, follow in done], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter gives way to the next document's beginning.

    Ranges of ids, cut at quantiles of the id column, hold the rows in order; the first row of a
    range also goes, as a guest, to the range before it (the very first to the last range), so
    each task reads its rows once and holds little besides the batch at hand. One shuffle of the texts;
    only ids are read to find the cuts and the first rows.

    Null text: empty. Ties in doc_id are ordered by text; rows without an id come first, ordered by
    text. A table of one row is followed by itself. Other columns are not read. Empty table: no rows.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    ids = docs.select(order.alias("o"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.approxQuantile("o", [i / parts for i in range(1, parts)], 0.2 / parts)))

    def part(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("part", F.lit(0))
        at = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="cell").transform(df.withColumn("at", F.col("o").cast("double")))
        return at.withColumn("part", F.col("cell").cast("int")).drop("at", "cell")

    firsts = sorted((r[0], r[1]) for r in part(ids).groupBy("part").agg(F.min("o").alias("o")).collect())
    to = spark.createDataFrame([(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)], "o long, part int")
    rows = docs.select(order.alias("o"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    guests = rows.join(F.broadcast(to), "o").groupBy("part", "o").agg(F.min(F.struct("text", "doc_id")).alias("r")).select("part", "o", "r.doc_id", "r.text", F.lit(True).alias("guest"))
    rows = part(rows).select("part", "o", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartition(parts // 2, "part").sortWithinPartitions("part", "guest", "o", "text").select("doc_id", "text", "guest")
    return rows.mapInArrow(
        partial(_edited, k=k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
