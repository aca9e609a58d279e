"""Runs of words: stretches that repeat with a period, by partition refinement.

Positions are in one class at length L if the same L words start there. Classes are refined from L to L + 1 by the
smaller halves: of the parts that a class has split into, all but the largest separate the positions just before them.
Neighbours of a class that lie exactly L apart are squares (the root of such a square is primitive, since a shorter
period would put a nearer neighbour between), and squares that start side by side are one run. All documents of a slice
are refined together, a level at a time, in numpy; a document of n words takes part up to level n // 4, as a run here has
its period four times at least. Each position is moved O(log n) times, so the work is O(n log n) moves, sorted by class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import slices, text_buffers
from tickwell.llm.work import short_batches, table

#: A run has at least so many words, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Up to this length neighbours are looked through; beyond it few positions have any, and they are noted by their distance.
_LOOK = 4
_SLICE_BYTES = 1 << 22


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i, joined."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class _Partition:
    """Classes of equal factors of several sequences, refined a length at a time.

    A class is a stretch of ``order``; ``after`` and ``before`` are its members' neighbours by position (-1: none).
    A sequence is followed by an end mark of its own.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        n = len(ids)
        self.depth = np.repeat(counts // LEAST_TIMES, counts + 1)
        self.closes = np.zeros(n + 1, bool)
        self.closes[starts + counts] = True
        self.order = np.argsort(ids, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        head = np.flatnonzero(np.diff(ids[self.order], prepend=-1))
        self.classes = len(head)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(head)], self.size[: len(head)] = head, np.diff(head, append=n)
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.repeat(np.arange(len(head)), self.size[: len(head)])
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        a, b = self.order[:-1], self.order[1:]
        same = self.of[a] == self.of[b]
        self.after[a[same]], self.before[b[same]] = b[same], a[same]
        self.length = 1
        sequence = np.searchsorted(starts, self.order[head], side="right")
        largest = np.lexsort((self.size[: len(head)], sequence))
        last = np.append(sequence[largest][1:] != sequence[largest][:-1], True)
        self.small = largest[~last]
        self.noted: dict[int, list[np.ndarray]] = {}
        self.moved = np.zeros(n, bool)

    def note(self, at: np.ndarray, to: np.ndarray) -> None:
        """Keep neighbours for the level that equals their distance."""
        if self.length < _LOOK:
            return
        far = to - at
        use = (far >= self.length) & (far <= self.depth[at])
        at, far = at[use], far[use]
        if not len(at):
            return
        order = np.argsort(far, kind="stable")
        at, far = at[order], far[order]
        cut = np.flatnonzero(far[1:] != far[:-1]) + 1
        for d, part in zip(far[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
            self.noted.setdefault(d, []).append(part)

    def squares(self) -> np.ndarray:
        """Ascending positions where a square of the present length starts."""
        if self.length < _LOOK:
            at = np.flatnonzero(self.after == np.arange(len(self.after)) + self.length)
        elif self.length in self.noted:
            at = np.unique(np.concatenate(self.noted.pop(self.length)))
            at = at[self.after[at] == at + self.length]
        else:
            return np.zeros(0, np.int64)
        return at[self.depth[at] >= self.length]

    def refine(self) -> None:
        """To the next length."""
        self.length += 1
        if self.length == _LOOK:
            at = np.flatnonzero(self.after >= 0)
            self.note(at, self.after[at])
        right = self.order[_ranges(self.start[self.small], self.size[self.small])]
        self.small = self.small[:0]
        left = right - 1
        use = (left >= 0) & ~self.closes[left]
        left, right = left[use], right[use]
        use = (self.size[self.of[left]] > 1) & (self.depth[left] >= self.length)
        left, right = left[use], right[use]
        if not len(left):
            return
        mine, theirs = self.of[left], self.of[right]
        order = np.lexsort((left, theirs, mine))
        left, mine, theirs = left[order], mine[order], theirs[order]
        head = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (theirs[1:] != theirs[:-1])))
        size, owner = np.diff(head, append=len(left)), mine[head]
        # Of a class whose members all stand here, the largest group stays where it is.
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        whole = np.add.reduceat(size, first) == self.size[owner[first]]
        by_size = np.lexsort((size, owner))
        largest = by_size[np.append(first[1:], len(owner)) - 1]
        goes = np.ones(len(size), bool)
        goes[largest[whole]] = False
        if not goes.any():
            return
        left = left[np.repeat(goes, size)]
        size, owner = size[goes], owner[goes]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        split, total = owner[first], np.add.reduceat(size, first)
        # Members that go change places with those that stay, until they fill the end of the class.
        tail = self.start[split] + self.size[split] - total
        to = _ranges(tail, total)
        self.moved[left] = True
        gap = self.place[left]
        gap = gap[gap < np.repeat(tail, total)]
        stays = self.order[to]
        stays = stays[~self.moved[stays]]
        self.moved[left] = False
        self.order[gap], self.place[stays] = stays, gap
        self.order[to], self.place[left] = left, to
        # They leave the old chain of neighbours ...
        by_place = left[np.lexsort((left, np.repeat(owner, size)))]
        begins = np.append(True, self.before[by_place[1:]] != by_place[:-1])
        ends = np.append(self.after[by_place[:-1]] != by_place[1:], True)
        a, b = self.before[by_place[begins]], self.after[by_place[ends]]
        self.after[a[a >= 0]], self.before[b[b >= 0]] = b[a >= 0], a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self.note(a[both], b[both])
        # ... and form new ones.
        self.size[split] -= total
        new = self.classes + np.arange(len(size))
        self.classes += len(size)
        ends = np.cumsum(size)
        self.start[new], self.size[new] = to[ends - size], size
        self.of[left] = np.repeat(new, size)
        self.after[left], self.before[left] = np.append(left[1:], -1), np.append(-1, left[:-1])
        self.after[left[ends - 1]], self.before[left[ends - size]] = -1, -1
        near = self.after[left] >= 0
        self.note(left[near], self.after[left[near]])
        # The largest part of each class need not be looked at again.
        by_size = np.lexsort((size, owner))
        largest = by_size[np.append(first[1:], len(owner)) - 1]
        beats = size[largest] > self.size[split]
        small = np.ones(len(size), bool)
        small[largest[beats]] = False
        self.small = np.concatenate((new[small], split[beats]))


def find_runs(ids: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers, its runs as rows (start, length, period), by start and period."""
    counts = np.array([len(x) for x in ids], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
    if not len(ids):
        return []
    own, known = [], 0
    for x in ids:
        own += [np.asarray(x, np.int64) + known, [known + (top := int(np.max(x, initial=-1)) + 1)]]
        known += top + 1
    part = _Partition(np.concatenate(own).astype(np.int64), starts, counts)
    found = [np.zeros((0, 3), np.int64)]
    deepest = int(counts.max()) // LEAST_TIMES
    while part.length <= deepest:
        if len(at := part.squares()):
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            length = at[np.append(head[1:], len(at)) - 1] - at[head] + 2 * part.length
            long = length >= max(LEAST_WORDS, LEAST_TIMES * part.length)
            if long.any():
                found.append(np.stack((at[head][long], length[long], np.full(int(long.sum()), part.length)), axis=1))
        if not len(part.small):  # no class will split any more
            break
        part.refine()
    runs = np.concatenate(found)
    row = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[row]
    order = np.lexsort((runs[:, 2], runs[:, 0], row))
    return np.split(runs[order], np.searchsorted(row[order], np.arange(1, len(ids))))


def loop(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten run on in a loop: every word from a on is one of the p words from a."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _slice(doc_ids: list[int | None], texts: list[bytes]) -> Iterator[tuple]:
    words = [loop(text.split(), i) for i, text in zip(doc_ids, texts, strict=True)]
    ids = []
    for own in words:
        numbers: dict[bytes, int] = {}
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)))
    for doc_id, own, runs in zip(doc_ids, words, find_runs(ids), strict=True):
        best = (None, None, None)
        if len(runs):
            best = tuple(runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist())
            again = np.zeros(len(own) + 1, np.int64)
            np.add.at(again, runs[:, 0] + runs[:, 2], 1)
            np.subtract.at(again, runs[:, 0] + runs[:, 1], 1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(again[:-1]) == 0).tolist()]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        yield doc_id, list(map(tuple, runs.tolist())), *best, sha256(listed.encode()).hexdigest(), b" ".join(own).decode()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period), start, length and period of the longest run, runs_sha256, and the
    text collapsed to one period a run (kept words joined by one space), for every row, repeated rows each.

    Of several longest runs the first counts, of those the one of the smaller period. A null or empty text has no words and
    no runs; a null id stays null and its text is not looped; texts of any length are taken whole, a long one in a slice of its own.
    """

    names = ["doc_id", "runs", "start", "length", "period", "runs_sha256", "collapsed"]
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64(), pa.list_(one), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            for i, j in slices(at, _SLICE_BYTES):
                rows = list(_slice(batch.column(0)[i:j].to_pylist(), [raw[at[k] : at[k + 1]].tobytes() for k in range(i, j)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, runs_sha256 string, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """The runs as numbers and hashes."""
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return digests(periodic_runs(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The query in DuckDB's SQL. A run of at least max(6, 4 q) words has equal windows of five words q apart all along it, so pairs of equal windows give
    all candidates; one that lies inside a candidate of a smaller period has not its smallest period."""
    byte = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT)), lambda c, b: {byte}), 4294967295::UBIGINT)"
    empty = sha256(b"").hexdigest()
    return rf"""
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, CAST({crc} AS BIGINT) AS h FROM d), g AS (SELECT *, h // 10 AS g FROM h), a AS (SELECT *, g % nullif(n, 0) AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT doc_id, n, i, w[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
five AS (SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM five l JOIN five r ON l.doc_id = r.doc_id AND l.five = r.five AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
cand AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 5 + q AS length, q AS period FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island HAVING max(i) - min(i) + 5 + q >= greatest({LEAST_WORDS}, {LEAST_TIMES} * q)),
runs AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand s WHERE s.doc_id = c.doc_id AND s.period < c.period AND s.start <= c.start AND s.start + s.length >= c.start + c.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, '{empty}') AS runs_sha256, coalesce(collapsed_sha256, '{empty}') AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


SQL = _sql()
