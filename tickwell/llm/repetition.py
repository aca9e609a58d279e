"""Quality rules by repetition: how many characters of a text lie in n-grams and lines that it says again.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D, as it is written. Windows of 5 to 10 words
are known by a rolling hash (differences of a running polynomial sum modulo 2**64, in numpy, over whole slices of a
batch); windows of two documents never meet, since words are numbered by document. A longer window can only be repeated
where both windows of one word less are, so the longer lengths look at few places. Two different windows of a text share
a hash with a chance of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.shingles import mix64, slices, text_buffers
from tickwell.llm.work import short_batches, small, table

#: A text with fewer words, or with more than this percentage of its words in repeated windows of BASE words, has failed.
LEAST_WORDS, MOST_REPEATED, BASE = 10, 20, 5
#: Window lengths and the percentage of a text's word characters that may lie in windows of that length found earlier in it.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for the word characters of lines that equal an earlier line.
LINE_LIMIT = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LIMITS)]

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes occur more than once."""
    in_order = np.sort(hashes)
    again = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(again):
        return np.zeros(len(hashes), bool)
    return again[np.minimum(np.searchsorted(again, hashes), len(again) - 1)] == hashes


def _inside(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` words that starts at one of ``at``."""
    step = np.zeros(n + 1, np.int64)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step[:-1]) > 0


def covered(ids: np.ndarray, rows: np.ndarray, lengths: tuple[int, ...] = tuple(LIMITS)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length (ascending by one), which words lie in a window of that many words that their row has more than once,
    and which lie in one that it has earlier.

    ``ids`` are word numbers that no two rows share, ``rows`` the ascending row of each word.
    """
    n = len(ids)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64((ids + 1).astype(np.uint64)) * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    at = np.arange(max(0, n - lengths[0] + 1))
    for length in lengths:
        at = at[at + length <= n]
        at = at[rows[at] == rows[at + length - 1]]
        hashes = (sums[at + length] - sums[at]) * back[at]
        again = _repeated(hashes)
        at, hashes = at[again], hashes[again]
        order = np.argsort(hashes, kind="stable")
        later = at[order[1:]][hashes[order[1:]] == hashes[order[:-1]]]
        yield _inside(at, length, n), _inside(later, length, n)
        at = at[:-1][at[1:] == at[:-1] + 1]


def _between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[at])


def measures(column: pa.Array) -> np.ndarray:
    """A row of ``COUNTS`` for each text; a null text has zeros, as an empty one."""
    raw, at = text_buffers(column)
    out = np.zeros((len(at) - 1, len(COUNTS)), np.int64)
    for i, j in slices(at):
        part, place = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        ids, counts, known = [], np.zeros(j - i, np.int64), 0
        for r, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            own = part[a:b].tobytes()
            words = own.split()
            numbers: dict[bytes, int] = {}
            ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) + known)
            known += len(numbers)
            counts[r] = len(words)
            seen = set()
            for line in own.split(b"\n"):
                if line in seen:
                    out[i + r, 3] += 1
                    out[i + r, 5] += len(b"".join(line.split()).decode())
                elif line.strip():
                    seen.add(line)
        letters = ~_SPACE[part] & ((part & 0xC0) != 0x80)
        out[i:j, 0] = counts
        out[i:j, 1] = _between(letters, place)
        out[i:j, 2] = _between(_SYMBOL[part], place)
        if not counts.any():
            continue
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = place[:-1][counts > 0]
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        chars = _between(letters, np.append(starts, len(part)))
        words_at = np.concatenate(([0], np.cumsum(counts)))
        for k, (more, later) in enumerate(covered(np.concatenate(ids), np.repeat(np.arange(j - i), counts))):
            if k + min(LIMITS) == BASE:
                out[i:j, 4] = _between(more, words_at)
            out[i:j, 6 + k] = _between(chars * later, words_at)
    return out


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``COUNTS``, base_failed and kept for every row, repeated rows each.

    A null or empty text has no words and fails; a text of any length is measured as a whole, in one piece; a null id
    stays null. ``kept`` is false for a text that has failed, or whose share of characters in windows or lines that
    stand earlier in it is over a limit; a share that equals its limit is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    limits = {"dup_line_chars": LINE_LIMIT} | {f"dup_chars_{n}": most for n, most in LIMITS.items()}
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (100 * F.col(name) > most * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return judge(table(spark, sf_dir, "documents"))


_WORDS = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS words, text FROM d),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS seen
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}')),
by_line AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS dup_line_chars
            FROM lines WHERE seen > 1 GROUP BY doc_id),
grams AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS times, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS seen
          FROM (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
                FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, range({min(LIMITS)}, {max(LIMITS) + 1}) AS t(n)))),
inside AS (SELECT doc_id, n, i + k AS i, max(seen) > 1 AS later FROM grams, range(0, {max(LIMITS)}) AS t(k) WHERE times > 1 AND k < n GROUP BY ALL),
by_n AS (SELECT doc_id, count(*) FILTER (WHERE n = {BASE}) AS n_repeat_words, {', '.join(f'coalesce(sum(length(words[i])) FILTER (WHERE n = {n} AND later), 0)::BIGINT AS dup_chars_{n}' for n in LIMITS)}
         FROM inside JOIN w USING (doc_id) GROUP BY doc_id),
a AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
             {', '.join(f'coalesce(dup_chars_{n}, 0) AS dup_chars_{n}' for n in LIMITS)}
      FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN by_n USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
          AND {' AND '.join(f'100 * dup_chars_{n} <= {most} * word_chars' for n, most in LIMITS.items())} AS kept FROM b
"""
