"""Toxicity: a support vector machine with a gap-weighted subsequence string kernel.

Texts are cut into sentences. The kernel of two words counts their common subsequences of three
symbols, each occurrence weighted by ``DECAY`` to the power of the stretch it covers (``SPAN``
symbols at most), so an insult with letters put in between, or left in pieces by punctuation,
still shares most of its subsequences with the plain one. Word ends are symbols too. A sentence
is represented by its worst word. Nystroem landmarks (words) give it a finite feature vector, on
which a linear machine is trained; as the kernel is an inner product of subsequence weights, the
trained machine folds into one table of subsequence weights, and whole texts are scored by sums
over it.

The machine learns from labelled sentences. All sentences of a text of label 0 have that label. A
text of label 1 has one sentence at least that earns it: the one with its worst word, found anew
after each round of training; its other sentences stay without a label. A text scores as its worst
sentence. So an insult of several words, each of them common elsewhere, is not known as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import mix64
from tickwell.llm.work import crc_mod, small, table

#: Bound (in expectation) of the labelled texts of either label that are learnt from: ids of the smallest hashes.
TRAIN_ROWS = 2_000
LANDMARKS = 128
DECAY = 0.6
SPAN = 6
ROUNDS = 3
HELD_OUT_OF, HELD_OUT = 5, 0
#: Bounds of what the machine is trained on, besides the toxic sentences: words of clean ones (the most frequent, as many evenly spread over the rest, and those it was most wrong about in the rounds before).
CLEAN_WORDS, WRONG_WORDS = 3_000, 4_000
#: Texts are taken for copies of each other by words that so many of the learnt texts have at most.
RARE = 64

_BASE, _OPEN, _SHUT = 48, 46, 47
_SLICE_CHARS = 1 << 19
#: A sentence ends at a stop after a word of two letters at least (single letters with stops may be one word in pieces).
_STOP = re.compile(r"(?<=[^\W\d_]{2})[.!?\u2026\u3002\uff01\uff1f]+[\"'\u00bb\u201d)\]]*\s+")


def _symbols() -> np.ndarray:
    """By code point: 0 for white space, 255 for what is dropped, else the letter's symbol."""
    every = list(map(chr, range(0x110000)))
    point = np.arange(len(every))
    out = np.full(len(every), 255, np.uint8)
    out[np.fromiter(map(str.isspace, every), bool, len(every))] = 0
    letter = np.fromiter(map(str.isalpha, every), bool, len(every))
    out[letter] = (27 + point % 19)[letter]
    out[97:123] = np.arange(1, 27)
    return out


_symbol_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    if not _symbol_table:
        _symbol_table.append(_symbols())
    return _symbol_table[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, one after the other with their end marks; where each word starts; the text of each word.

    A word is what white space separates, with all but letters dropped; neighbouring words of one letter are one word.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = symbols()[points]
    size = np.array([len(x) + 1 for x in texts], np.int64)
    kept = kind != 255
    kind, text = kind[kept], np.repeat(np.arange(len(texts)), size)[kept]
    letter = kind != 0
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    word = np.cumsum(start)[letter] - 1
    own, text = kind[letter], text[start]
    length = np.bincount(word, minlength=len(text))
    if len(text) > 1:
        joined = np.concatenate(([False], (length[1:] == 1) & (length[:-1] == 1) & (text[1:] == text[:-1])))
        if joined.any():
            merged = np.cumsum(~joined) - 1
            word, text = merged[word], text[~joined]
            length = np.bincount(word, minlength=len(text))
    begin = np.concatenate(([0], np.cumsum(length + 2)))[:-1].astype(np.int64)
    out = np.empty(len(own) + 2 * len(text), np.int32)
    out[begin] = _OPEN
    out[begin + length + 1] = _SHUT
    out[np.arange(len(own)) + 2 * word + 1] = own
    return out, begin, text


def norms(length: np.ndarray) -> np.ndarray:
    """Of words by their number of symbols: root of the summed squared weights of all their subsequences."""
    b = np.arange(2, SPAN)
    total = np.maximum(np.asarray(length)[..., None] - b, 0) @ ((b - 1) * DECAY ** (2.0 * (b + 1)))
    return np.sqrt(np.maximum(total, 1e-9))


def word_sums(stream: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word, the weighted sum of ``weights`` over its subsequences, over its norm."""
    if not len(begin):
        return np.zeros(0)
    length = np.diff(np.append(begin, len(stream)))
    left = np.repeat(begin + length, length) - np.arange(len(stream))  # symbols from here to the word's end
    total = np.zeros(len(stream), np.float32)
    for b in range(2, SPAN):
        n = len(stream) - b
        if n <= 0:
            break
        fits = left[:n] > b
        outer = stream[:n] * (_BASE * _BASE) + stream[b:]
        part = np.zeros(n, np.float32)
        for a in range(1, b):
            part += weights[outer + stream[a : a + n] * _BASE]
        total[:n] += np.float32(DECAY ** (b + 1)) * part * fits
    return np.add.reduceat(total, begin).astype(np.float64) / norms(length)


def word_table(stream: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Each word as a table of its normed subsequence weights."""
    out = []
    for a, b in zip(begin, np.append(begin[1:], len(stream)), strict=True):
        w, own = np.zeros(_BASE**3, np.float32), stream[a:b]
        for i in range(len(own)):
            for k in range(i + 2, min(i + SPAN, len(own))):
                for j in range(i + 1, k):
                    w[own[i] * _BASE * _BASE + own[j] * _BASE + own[k]] += DECAY ** (k - i + 1)
        out.append(w / norms(np.array(len(own))))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text's worst word; -2 without a word."""
        out = np.full(len(texts), -2.0)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= _SLICE_CHARS):
                size += len(texts[j])
                j += 1
            stream, begin, text = words_of(texts[i:j])
            if len(begin):
                np.maximum.at(out, text + i, word_sums(stream, begin, self.weights) + self.bias)
            i = j
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active][:, None]
        new = np.linalg.solve(ridge + cost * xa.T @ x[active], cost * xa.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(texts: list[list[list[str]]], toxic: np.ndarray) -> Model:
    """From the sentences of each labelled text, each the list of its distinct words.

    Without words on the one side or the other, every text with a word is what the other side is.
    """
    vocabulary: dict[str, int] = {}
    cut = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sentence], np.int64) for sentence in own] for own in texts]
    ids = [np.unique(np.concatenate([np.zeros(0, np.int64), *own])) for own in cut]
    names = list(vocabulary)
    nothing = Model(np.zeros(_BASE**3, np.float32), -1.0, 4.0, 0.0)
    if not any(len(i) for i, t in zip(ids, toxic, strict=True) if t):
        return nothing
    if not any(len(i) for i, t in zip(ids, toxic, strict=True) if not t):
        return Model(nothing.weights, 1.0, 4.0, 0.0)
    of_toxic = [i for i, t in zip(ids, toxic, strict=True) if t]
    weight = np.concatenate([np.full(len(i), w) for i, w in zip(of_toxic, 1 / _copies(of_toxic, len(names)), strict=True)])
    in_toxic = np.bincount(np.concatenate(of_toxic), weight, minlength=len(names))  # copies of a text count once
    in_clean = np.bincount(np.concatenate([i for i, t in zip(ids, toxic, strict=True) if not t]), minlength=len(names))
    stream, begin, text = words_of(names)
    first = np.searchsorted(text, np.arange(len(names)))  # a name is one word again
    worth = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic).sum() + 1))
    # Words that so many toxic texts have, and no clean one, that chance would give less than one such word.
    in_all = np.bincount(np.concatenate(ids), minlength=len(names))
    chance = toxic.mean()
    least = next((k for k in range(1, len(ids) + 1) if (in_all >= k).sum() * chance**k < 0.5), len(ids) + 1)
    proven = np.flatnonzero((in_clean == 0) & (in_toxic >= least))
    sure = np.argsort(-in_clean, kind="stable")
    clean = sure[in_clean[sure] > 0]

    def part(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [stream[begin[first[i]] : begin[first[i] + 1] if first[i] + 1 < len(begin) else len(stream)] for i in of]
        return np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))[:-1]

    hard = np.union1d(clean[:CLEAN_WORDS], clean[:: max(1, len(clean) // CLEAN_WORDS)])
    weights, bias = nothing.weights, 0.0
    for _ in range(ROUNDS):
        worst = np.array([_worst(own, worth) for own, t in zip(cut, toxic, strict=True) if t and any(map(len, own))])
        found, times = np.unique(np.concatenate((worst, np.repeat(proven, np.ceil(in_toxic[proven]).astype(int)))), return_counts=True)
        often = (in_clean[found] == 0) | (in_toxic[found] > 20 * in_clean[found])
        found, times = found[often], times[often]
        if not len(found):
            return nothing
        marks = np.concatenate((found[np.argsort(-times, kind="stable")][: LANDMARKS * 2 // 3], hard[:: max(1, len(hard) // (LANDMARKS // 3))]))
        tables = word_table(*part(marks))
        gram = np.stack([word_sums(*part(marks), t) for t in tables], axis=1)
        value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(marks)))
        white = vector / np.sqrt(np.maximum(value, 1e-6))
        bent = _bent([names[i] for i in found])
        groups = [part(found), part(hard), *([words_of(bent)[:2]] if bent else [])]
        x = np.concatenate([np.stack([word_sums(*g, t) for t in tables], axis=1) for g in groups]) @ white
        y = np.concatenate((np.ones(len(found)), -np.ones(len(hard)), np.ones(len(x) - len(found) - len(hard))))
        share = np.concatenate((np.sqrt(times), np.ones(len(hard)), np.full(len(x) - len(found) - len(hard), 0.3)))
        w = _machine(np.column_stack((x, np.ones(len(x)))), y, share)
        weights = np.zeros(_BASE**3, np.float32)
        for share_of, t in zip((white @ w[:-1]).astype(np.float32), tables, strict=True):
            weights += share_of * t
        bias = float(w[-1])
        margin = word_sums(stream, begin, weights)[first] + bias
        wrong = clean[margin[clean] > -1]
        hard = np.union1d(hard, wrong[np.argsort(-margin[wrong], kind="stable")][:WRONG_WORDS])
        worth = worth + 2 * np.clip(margin, -1.5, 1.5)
    worst = np.array([margin[own].max() if len(own) else -2.0 for own in ids])
    slope, offset = _platt(worst, toxic)
    return Model(weights, bias, slope, offset)


def _worst(sentences: list[np.ndarray], worth: np.ndarray) -> int:
    """The worst word of the sentence that earns a text its label."""
    toxic = max((own for own in sentences if len(own)), key=lambda own: worth[own].max())
    return int(toxic[worth[toxic].argmax()])


def _copies(ids: list[np.ndarray], names: int) -> np.ndarray:
    """For each text, about how many have nearly the same words: those that share a min-hash of the words that few texts have."""
    df = np.bincount(np.concatenate(ids), minlength=names)
    some = [i[(df[i] > 1) & (df[i] <= RARE)] for i in ids]
    out = np.ones(len(ids))
    for seed in range(3):
        h = mix64(np.arange(names, dtype=np.uint64) + np.uint64((seed + 1) << 40))
        least = np.array([int(h[i].min()) if len(i) else n for n, i in enumerate(some)], np.uint64)
        _, group, size = np.unique(least, return_inverse=True, return_counts=True)
        out = np.maximum(out, size[group])
    return out


def _bent(words: list[str]) -> list[str]:
    """Words of five letters and more with one letter doubled, or another put in, at each place in turn."""
    return [w[:i] + x + w[i:] for w in words if len(w) >= 5 for i in range(1, len(w)) for x in (w[i], "xoz"[i % 3])]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset of margins, with smoothed targets; the slope is kept positive."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-4 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0.5 else (4.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """From about ``rows`` texts of either label at most that are not held out.

    Null labels, and labels without a document, count for nothing; a repeated row counts as often as
    it stands there. Whole texts are read, however long. Other columns are not read. Empty tables,
    and tables of one label, give a constant score.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    known = known.where(crc_mod(F.col("id"), HELD_OUT_OF) != HELD_OUT)
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    limit = F.when(F.col("y") == 1, min(1.0, rows / sizes.get(1, 1))).otherwise(min(1.0, rows / sizes.get(0, 1)))
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < limit * 1_000_000)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lists = [sentences(x or "") for x in pc.utf8_lower(batch.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.list_(pa.string()))), batch.column(1)], ["sentences", "y"])

    got = texts.mapInArrow(run, "sentences array<array<string>>, y int").toArrow()
    lists, y = got["sentences"].to_pylist(), got["y"].to_numpy() == 1
    order = sorted(range(len(lists)), key=lambda i: (bool(y[i]), lists[i]))
    return train([lists[i] for i in order], y[order])


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence of a text."""
    return [own for part in _STOP.split(text) if (own := _distinct(part))]


def _distinct(text: str) -> list[str]:
    """Distinct words as ``words_of`` takes them, letters only."""
    words = ["".join(filter(str.isalpha, x)) for x in text.split()]
    out, single = set(), ""
    for w in [*filter(None, words), "--"]:
        if len(w) == 1:
            single += w
            continue
        if single:
            out.add(single)
            single = ""
        out.add(w)
    return sorted(out - {"--"})


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, for every row.

    Null, empty and wordless texts score lowest. A null id is not held out. Repeated rows come back
    once each; equal texts score the same. Long texts are scored whole. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            margins = model.margins([x or "" for x in pc.utf8_lower(batch.column(1)).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(margins))], ["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
