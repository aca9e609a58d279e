"""LM scoring by masked pseudo-likelihood: a small window network predicts each word from both sides.

Words have classes: the most frequent words of the whole corpus have one each, all others share
``BUCKETS`` by their hash. There are ``FREQUENT`` frequent words, and ``MORE`` for each doubling of
the corpus beyond ``WORDS`` words. The network sees the two classes on either side of a masked word
(an edge class beyond the text), has one hidden layer, and gives a distribution over classes. A
text's score is the sum, over all its words, of the log-probability of the word's own class given
its neighbours and of the word given its class: its count in the corpus over that of its bucket,
both with one more for words that the corpus does not have; a frequent word is sure given its class.

The counts of all words make a table in the shared folder, which grows with the corpus. The most
frequent ones, ``COMMON`` at most, travel with the tasks (16 bytes each), so the join that looks up
the others has neither hot keys nor most of the words. A word seen once scores as a new one
(log 1 = 0), so the table holds words from two occurrences on, and none is lost by that.

Training is data-parallel and does not depend on how Spark has dealt the rows: each text belongs
to a shard of about ``SHARD_WORDS`` words by the hash of its id and classes, and is read there in
the order of these hashes. In each round every shard starts from the same parameters, runs Adagrad
over its texts (each ``STRIDE``-th word is a target, other words each round, until every word has
been one) and hands in its parameters, which are averaged by the number of targets in a grouped
sum. So all words are counted, learnt from and scored; text is read twice, once for the counts and
once for the classes, which are kept; and the driver holds one set of parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import mix64, slices, text_buffers, word_hashes
from tickwell.llm.work import small, stored, table

FREQUENT = 95
BUCKETS = 32
MORE = 32
WORDS = 1 << 22
CLASSES = 1 + FREQUENT + BUCKETS  # at least; class 0: beyond an edge
HIDDEN = 24
AROUND = (-2, -1, 1, 2)
ROUNDS = 2
STRIDE = 2
RATE = 0.1
#: Bound of the words whose counts travel with the tasks.
COMMON = 1 << 18
SHARD_WORDS = 1 << 22
_BATCH = 1024
_CHUNK = 1 << 10
_RUN = 1 << 18


def buckets(words: np.ndarray) -> np.ndarray:
    return (mix64(words) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Network:
    frequent: np.ndarray  # ascending word hashes (uint64); class 1 + place
    inner: np.ndarray  # (len(AROUND), classes, HIDDEN)
    inner_bias: np.ndarray
    outer: np.ndarray  # (HIDDEN, classes)
    outer_bias: np.ndarray
    totals: np.ndarray | None = None  # by bucket: occurrences of all its words in the corpus
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending word hashes
    log_times: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the common words
    words: DataFrame | None = None  # word, log_times: the others that occur twice or more in the corpus
    size: int = 0  # words of the corpus

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inner, self.inner_bias, self.outer, self.outer_bias)]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in (self.inner, self.inner_bias, self.outer, self.outer_bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return replace(self, **dict(zip(("inner", "inner_bias", "outer", "outer_bias"), out, strict=True)))

    def classes(self, words: np.ndarray) -> np.ndarray:
        bucket = len(self.outer_bias) - BUCKETS + buckets(words)
        if not len(self.frequent):
            return bucket
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, 1 + at, bucket)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.inner_bias + self.inner[0][context[0]]
        for k in range(1, len(AROUND)):
            total += self.inner[k][context[k]]
        return np.tanh(total, out=total)

    def log_probability(self, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of class ``own`` at each place, given ``context`` (a row for each of AROUND)."""
        out = np.empty(len(own), np.float32)
        ones, steep = np.ones(len(self.outer_bias), np.float32), _steep(self.outer, self.outer_bias)
        for a in range(0, len(own), _CHUNK):
            b = min(a + _CHUNK, len(own))
            p = self.hidden(context[:, a:b]) @ self.outer
            p += self.outer_bias
            out[a:b] = p[np.arange(b - a), own[a:b]]
            most = _exponentials(p, steep)
            out[a:b] -= np.log(p @ ones) + most
        return out.astype(np.float64)


def _steep(outer: np.ndarray, bias: np.ndarray) -> bool:
    """Whether a logit may be too large for an exponential in single precision; hidden units lie between -1 and 1."""
    return bool((np.abs(outer).sum(axis=0) + np.abs(bias)).max() > 60)


def _exponentials(logits: np.ndarray, steep: bool) -> np.ndarray | float:
    """Exponentials in place, of what is left after a number for each row, which is returned."""
    most = logits.max(axis=1) if steep else 0.0
    if steep:
        logits -= most[:, None]
    np.exp(logits, out=logits)
    return most


def start(frequent: np.ndarray) -> Network:
    rng = np.random.default_rng(1)
    classes = max(CLASSES, 1 + len(frequent) + BUCKETS)
    shape = (len(AROUND), classes, HIDDEN)
    return Network(frequent, rng.normal(0, 0.1, shape).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32), np.zeros(classes, np.float32))


def contexts(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The classes at AROUND of each word; ``counts``: words of each text."""
    edge = max(map(abs, AROUND))
    padded = np.zeros(len(classes) + edge * (len(counts) + 1), np.int16)  # edges before, between and after the texts
    place = np.arange(len(classes)) + edge * (1 + np.repeat(np.arange(len(counts)), counts))
    padded[place] = classes
    return np.stack([padded[place + k] for k in AROUND])


def parts_of(classes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``_RUN`` words (a longer text is a run of its own): first and last text, contexts, own classes."""
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, j in slices(at, _RUN):
        own = classes[at[i] : at[j]].astype(np.int64)
        yield i, j, contexts(own, counts[i:j]), own


def descend(net: Network, runs: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> tuple[Network, int]:
    """Adagrad over batches of (context, own class) from each run; the network and how many targets there were."""
    inner, inner_bias, outer, outer_bias = (x.astype(np.float32).copy() for x in (net.inner, net.inner_bias, net.outer, net.outer_bias))
    past = [np.full(x.shape, 1e-4, np.float32) for x in (inner, inner_bias, outer, outer_bias)]
    rows, row_past = inner.reshape(-1, HIDDEN), past[0].reshape(-1, HIDDEN)  # a row for each place of AROUND and class
    first = (np.arange(len(AROUND)) * inner.shape[1]).astype(np.int16)[:, None]
    ones = np.ones(len(outer_bias), np.float32)
    buffer = np.empty((_BATCH, len(outer_bias)), np.float32)
    seen = 0

    def step(x: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
        s += g * g
        x -= rate * g / np.sqrt(s)

    for context, own in runs:
        for a in range(0, len(own), _BATCH):
            c, y = context[:, a : a + _BATCH] + first, own[a : a + _BATCH]
            n = len(y)
            h = inner_bias + rows[c[0]]
            for k in range(1, len(AROUND)):
                h += rows[c[k]]
            np.tanh(h, out=h)
            p = np.matmul(h, outer, out=buffer[:n])
            p += outer_bias
            _exponentials(p, _steep(outer, outer_bias))
            p *= (1 / (p @ ones * np.float32(n)))[:, None]
            p[np.arange(n), y] -= np.float32(1 / n)
            back = p @ outer.T
            back *= 1 - h * h
            flat = c.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            touched, g = flat[starts], np.add.reduceat(back[order % n], starts, axis=0)
            s = row_past[touched] + g * g
            row_past[touched] = s
            rows[touched] -= rate * g / np.sqrt(s)
            step(inner_bias, back.sum(axis=0), past[1])
            step(outer, h.T @ p, past[2])
            step(outer_bias, np.ones(n, np.float32) @ p, past[3])
            seen += n
    parts = inner, inner_bias, outer, outer_bias
    return Network(net.frequent, *parts), seen


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (hash), times: of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            found, times = [], []
            for i, j in slices(at, 1 << 23):
                w, c = np.unique(word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])[0], return_counts=True)
                found.append(w)
                times.append(c)
            w, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
            c = np.bincount(back, np.concatenate([np.zeros(0), *times]), minlength=len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["word", "times"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def bucket_totals(counted: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """By bucket: occurrences of all its words but the frequent ones."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            words, times = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            rare = ~np.isin(words, frequent)
            total += np.bincount(buckets(words[rare]), times[rare], BUCKETS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "times"])

    got = {r[0]: r[1] for r in counted.select("word", "times").mapInArrow(add, "bucket long, times long").groupBy("bucket").agg(F.sum("times")).collect()}
    return np.array([got.get(i, 0) for i in range(BUCKETS)], np.int64)


def lexicon(docs: DataFrame, text: str = "text") -> Network:
    """The words of the corpus, in a network that is not yet trained. Of equally frequent words those of the smaller hash come first."""
    counted = stored(word_counts(docs, text), "words")
    # How many words there are by size of their counts, in steps of a sixteenth of a doubling: a few hundred rows.
    steps = {r["step"]: r for r in counted.groupBy(F.floor(16 * F.log2("times")).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("times").alias("times")).collect()}
    least, kept = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        kept += steps[step]["words"]
        if kept > COMMON:
            break
        least = step
    is_common = F.floor(16 * F.log2("times")) >= least
    top = sorted((-r["times"], r["word"]) for r in counted.where(is_common).collect())
    size = sum(r["times"] for r in steps.values())
    frequent = np.sort(np.array([w for _, w in top[: FREQUENT + MORE * max(0, (size // WORDS).bit_length() - 1)]], np.int64).view(np.uint64))
    common = np.array([w for _, w in top], np.int64).view(np.uint64)
    order = np.argsort(common)
    log_times = np.log(np.array([-t for t, _ in top], float))
    others = counted.where(~is_common & (F.col("times") > 1)).select("word", F.log("times").alias("log_times"))
    return replace(start(frequent), totals=bucket_totals(counted, frequent), common=common[order], log_times=log_times[order], words=others, size=size)


def classed(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, classes (uint16 each, little-endian), known (log-probability of the words given their classes, as far as the common words tell), rest (other words of buckets); kept in the shared folder."""
    bare = replace(net, words=None)  # what the tasks take along
    less = np.zeros(len(net.outer_bias))
    if net.totals is not None:
        less[-BUCKETS:] = np.log(net.totals + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, at = text_buffers(batch.column(2))
            classes, known, rest, sizes = [], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for i, j in slices(at):
                words, counts = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                own, row = bare.classes(words), np.repeat(np.arange(j - i), counts)
                bucketed = np.flatnonzero(own >= len(less) - BUCKETS)
                words = words[bucketed]
                place = np.minimum(np.searchsorted(bare.common, words), max(0, len(bare.common) - 1))
                found = bare.common[place] == words if len(bare.common) else np.zeros(len(words), bool)
                told = -less[own]
                told[bucketed[found]] += bare.log_times[place[found]]
                known.append(np.bincount(row, told, j - i))
                rest.append(words[~found])
                sizes.append(np.bincount(row[bucketed[~found]], minlength=j - i))
                end = np.cumsum(counts)
                raw_classes = own.astype("<u2").tobytes()
                classes += [raw_classes[2 * a : 2 * b] for a, b in zip((end - counts).tolist(), end.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(rest).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(np.concatenate(known)), lists], ["row", "doc_id", "classes", "known", "rest"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(own.mapInArrow(run, "row long, doc_id long, classes binary, known double, rest array<long>"), "classed")


def _classes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows of a binary column: classes, and how many each row has."""
    own = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    return np.concatenate([np.zeros(0, np.uint16), *own]), np.array([len(x) for x in own], np.int64)


def _learner(net: Network, first: int, stride: int) -> Callable[[pa.Table], pa.Table]:
    bare = replace(net, words=None, common=net.common[:0], log_times=net.log_times[:0])

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.take(pa.array(np.argsort(shard["place"].to_numpy(), kind="stable")))
        classes, counts = _classes(shard["classes"])
        new, seen = descend(bare, ((c[:, first::stride], own[first::stride]) for _, _, c, own in parts_of(classes, counts)))
        flat = new.flat()
        return pa.table({"at": np.arange(len(flat)), "value": flat * seen, "seen": np.full(len(flat), seen)})

    return learn


def train(rows: DataFrame, net: Network, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """The network after training over all words of ``rows``, as ``classed`` gives them; without words it keeps its first, random parameters.

    Each word is a target in one round at least: there are never more residues of ``stride`` than rounds.
    """
    stride = min(stride, rounds)
    key = F.xxhash64("doc_id", "classes")
    dealt = rows.where(F.length("classes") > 0).select(F.pmod(key, F.lit(max(1, net.size // SHARD_WORDS))).alias("shard"), key.alias("place"), "classes")
    for turn in range(rounds):
        learn = _learner(net, turn * stride // rounds, stride)
        got = dealt.groupBy("shard").applyInArrow(learn, "at long, value double, seen long").groupBy("at").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).where("seen > 0").toArrow().sort_by("at")
        if got.num_rows:
            net = net.like(got["value"].to_numpy() / got["seen"].to_numpy())
    return net


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """A network trained over all words of all texts. Null and empty texts add nothing; repeated rows count each; other columns are not read."""
    net = lexicon(docs, text)
    return train(classed(docs, net, doc_id, text), net, rounds, stride)


def scored(rows: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_words, log_probability and mean_log_probability of the rows that ``classed`` gives."""
    bare = replace(net, words=None, common=net.common[:0], log_times=net.log_times[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, counts = _classes(batch.column(2))
            total = batch.column(3).to_numpy().copy()
            for i, j, context, own in parts_of(classes, counts):
                total[i:j] += np.bincount(np.repeat(np.arange(j - i), counts[i:j]), bare.log_probability(context, own), j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(total)], ["row", "doc_id", "n_words", "log_probability"])

    out = rows.select("row", "doc_id", "classes", "known").mapInArrow(run, "row long, doc_id long, n_words long, log_probability double")
    if net.words is not None:
        more = rows.select("row", F.explode("rest").alias("word")).join(net.words, "word").groupBy("row").agg(F.sum("log_times").alias("more"))
        out = out.join(more, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_probability", mean.alias("mean_log_probability"))


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_probability (sum over all words) and mean_log_probability of every row; without words (null, empty) 0, 0 and null.

    Repeated rows come back once each, equal texts score the same, null ids stay null. Long texts are
    scored whole. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    return scored(classed(docs, net, doc_id, text), net)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = lexicon(docs)
    rows = classed(docs, net)
    return scored(rows, train(rows, net))
