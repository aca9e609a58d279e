"""Packing by concatenation and cutting: every document's ids, end id last, in fixed windows.

Pass one tokenises each document once and keeps the ids with the document's place: its split
(file, first byte there, partition) and the number of ids before it in the partition. The splits'
totals, summed up in the order of files and bytes, give each split's global offset; pass two adds
it and cuts documents where they cross a multiple of the window. So documents follow each other as
they stand in their files, however Spark deals splits to partitions. All windows are full but the
last, so padding is under one window for the whole corpus. Neither pass shuffles.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.work import stored, table

WINDOW = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers: a bound on its memory, not on what is encoded.
_REMEMBERED = 300_000
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}
#: Texts of these characters alone are split here, by the rule of the tokenizer's own file: a text is lower-cased
#: (they are all in normal form) and its contractions, runs of letters, digits and runs of other signs are encoded one by one.
#: A capital of the range whose small letter lies beyond it makes a text one of the others.
_PLAIN = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x250)) if max(c.lower()) < "\u0250")) + "\u2010-\u2027\u2030-\u203a\u20ac]*")
_LETTER, _DIGIT, _BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (little-endian uint16), the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Words of plain texts are encoded once and remembered; new ones go to the tokenizer together and
    are told apart by the ids that end a word. All other texts, and those that may hold a special
    token, go to the tokenizer whole.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids over 65535 are not supported")
    known: dict[str, bytes] = {}
    final = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a word
    suffix = tokenizer.model.end_of_word_suffix
    final[[i for t, i in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def learn(words: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(final[ids]) + 1
            if len(ends) != len(some):  # a vocabulary without word ends
                out.update((w, whole(w)) for w in some)
                continue
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, (2 * ends).tolist(), strict=True):
                out[w] = raw[begin:end]
                begin = end
        return out

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        later: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        for x in texts:
            if _PLAIN.fullmatch(x) is None or "<|" in x:
                out.append(whole(x))
                continue
            words = _WORD.findall(x.lower())
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                new.update([w for w in words if w not in known])
                later.append((len(out), words))
                out.append(b"")
        if later:
            got = learn(list(new))
            if len(known) + len(got) <= _REMEMBERED:
                known.update(got)
                got = {}
            for i, words in later:
                out[i] = b"".join([known[w] if w in known else got[w] for w in words])
        return out

    _encoders[path] = encode
    return encode


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, last, part, before = encoder(path), np.array([end], np.uint16).tobytes(), TaskContext.get().partitionId(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            ids = [x + last for x in encode([x or "" for x in some.column(3).to_pylist()])]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:3], pa.array(np.full(len(ids), part, np.int32)), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                ["file", "first", "doc_id", "part", "before", "doc_tokens", "ids"],
            )
            before += int(n.sum())


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    for batch in batches:
        doc, begin, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        pieces = (begin + n - 1) // window - begin // window + 1
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = begin[row] // window + nth
        at = np.maximum(begin[row], sequence * window)
        length = np.minimum(begin[row] + n[row], (sequence + 1) * window) - at
        start = at - begin[row]
        ids = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in batch.column(3)]
        cut = [ids[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *map(pa.array, (start, length, n[row], sequence, at - sequence * window)), pa.array(cut, pa.binary())], names)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    ``path``: the tokenizer's file, by default that of ``VOCABULARY``. Null and empty texts are
    the end id alone. Repeated rows are packed once each; null ids stay null. Other columns are not
    read, whatever their names. Empty table: no rows. Documents follow each other as they stand in
    the files of ``docs``, in the order of the files' names; where ``docs`` is not read from files, in
    the order of its partitions.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    docs = docs.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("first"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = stored(docs.mapInArrow(partial(_tokenise, path=path, end=end), "file string, first long, doc_id long, part int, before long, doc_tokens long, ids binary"), "tokens")
    splits = kept.groupBy("file", "first", "part").agg(F.sum("doc_tokens").alias("n"), F.min("before").alias("skip")).collect()  # a row for each split of the input
    splits.sort(key=lambda r: r[:3])
    bases = list(accumulate((r["n"] for r in splits), initial=0))
    base = docs.sparkSession.createDataFrame([(*r[:3], b - r["skip"]) for r, b in zip(splits, bases, strict=False)], "file string, first long, part int, base long")
    placed = kept.join(F.broadcast(base), ["file", "first", "part"]).select("doc_id", (F.col("base") + F.col("before")).alias("begin"), "doc_tokens", "ids")
    return placed.mapInArrow(partial(_cut, window=window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
