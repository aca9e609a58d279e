"""Conversation structure: faults are found, and the cheapest edits to a regular order of roles.

A conversation becomes a signature, a letter for each row: the initial of its role, as a capital where the row is cut
off, or ``x`` where it must go. Distinct signatures are sorted by range; a task walks through its range as through a
prefix trie, keeping the layers of a dynamic programme along the present path: a shared prefix is computed once, and
each terminal node gives its answer. A layer is the least cost for each state of the output (nothing, s, u, a), and the order
of the audits behind them, so it is of one size at any depth; what follows from a layer and a letter is remembered.

Rows of one conversation pass through one task in order, one at a time; what is kept of them is a letter a row, as long
as the audit that is the result. A message is known by the md5 of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.llm.work import short_batches, stored, table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
_STATES = NOTHING, S, U, A = range(4)
_NEXT = {NOTHING: U, S: U, U: A, A: U}  # the state after a row whose role may be chosen
_NAMES = {U: "user", A: "assistant"}
_KEPT = {("s", NOTHING): S, ("u", NOTHING): U, ("u", S): U, ("u", A): U, ("a", U): A}
#: A state that costs more than the best one by more than this is never on a best path: the best one can do as it does, for
#: one deletion (of a system row that only the empty output can keep) and one insert, or two inserts, at most.
_SLACK = max(DELETE + INSERT, 2 * INSERT)
_EMPTY = sha256(b"").hexdigest()


@cache
def step(layer: tuple, letter: str) -> tuple[int, tuple, tuple]:
    """The layer after one more row: what its least cost adds, the layer, and for each state (state before, edits) or None.

    A layer has for each state (cost above the least, place of its audit among those of the layer), or None. Every audit of
    a layer ends with the edit of its last row, so none is the beginning of another, and places decide between longer ones.
    """
    least_row = letter.lower()
    more = CUT_OFF if letter != least_row else 0
    best: dict[int, tuple] = {}
    for before in _STATES:
        if layer[before] is None:
            continue
        cost, place = layer[before]
        state, edits = before, ""
        for _ in range(3):
            ways = [(DELETE, state, "D")]
            if least_row != "x":
                ways.append((REROLE + more, _NEXT[state], "R"))
                if (to := _KEPT.get((least_row, state))) is not None:
                    ways.append((KEEP + more, to, "K"))
            for price, to, edit in ways:
                way = (cost + price, place, edits + edit, before)
                best[to] = min(best.get(to, way), way)
            cost, state, edits = cost + INSERT, _NEXT[state], edits + "I"
    least = min(cost for cost, *_ in best.values())
    best = {to: way for to, way in best.items() if way[0] - least <= _SLACK}
    places = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return (
        least,
        tuple((best[q][0] - least, places[q]) if q in best else None for q in _STATES),
        tuple((best[q][3], best[q][2]) if q in best else None for q in _STATES),
    )


@cache
def last(layer: tuple) -> tuple[int, str, int]:
    """Cost above the least, final inserts and state of the best audit that ends here."""
    ways = []
    for q in _STATES:
        if layer[q] is not None:
            inserts = {NOTHING: 0, A: 0, U: 1, S: 2}[q]
            ways.append((layer[q][0] + inserts * INSERT, layer[q][1], "I" * inserts, q))
    cost, _, edits, q = min(ways)
    return cost, edits, q


def answers(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of ascending signatures."""
    path, layers, costs, steps = "", [((0, 0), None, None, None)], [0], []
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :], costs[shared + 1 :], steps[shared:]
        for letter in signature[shared:]:
            more, layer, back = step(layers[-1], letter)
            layers.append(layer)
            costs.append(costs[-1] + more)
            steps.append(back)
        path = signature
        cost, edits, q = last(layers[-1])
        audit = [edits]
        for back in reversed(steps):
            q, edits = back[q]
            audit.append(edits)
        yield signature, costs[-1] + cost, "".join(reversed(audit))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows as they are after damage, a dropped one marked as gone. Null role or text: one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.expr("array_repeat(0, if(kind = 3, 2, 1))")))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one partition, by turn; equal turns by role and text."""
    return rows.sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of each conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    marks = rows.select(
        "conv_id", "turn", "role", "gone", F.md5(F.col("text").cast("binary")).alias("digest"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marks = _ordered(marks.withColumn("again", F.row_number().over(same) > 1)).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "gone", "blank", "again", "cut")
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, letters, counts, turns, before = none, [], [0] * 4, [None, None, 0], None
        done: list[tuple] = []

        def end() -> tuple:
            low, high, distinct = turns
            return now, "".join(letters), high - low + 1 - distinct if distinct else 0, *counts

        for batch in batches:
            for conv, turn, initial, gone, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is none or conv != now:
                    if now is not none:
                        done.append(end())
                    now, letters, counts, turns, before = conv, [], [0] * 4, [None, None, 0], None
                if gone:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    counts[3] += 1
                before = initial
                letter = initial if initial and initial in "sua" else "o"
                letters.append("x" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if now is not none:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(end(), kinds, strict=True)], names)

    return marks.mapInArrow(run, "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def audits(found: DataFrame) -> DataFrame:
    """``found`` with cost and audit, from its column signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in answers(s for batch in batches for s in batch.column(0).to_pylist()):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("signature", "cost", "audit"), r, strict=True)) for r in rows])
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("signature", "cost", "audit"), r, strict=True)) for r in rows])

    distinct = found.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return found.join(distinct.mapInArrow(run, "signature string, cost long, audit string"), "signature")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: what stands after the edits of ``plans`` (conv_id, audit), conversations in one piece and in order."""
    kept = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(None).cast("string").alias("audit"))
    plan = plans.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in kept.dtypes[2:6]], "audit")
    both = _ordered(kept.unionByName(plan).repartition("conv_id"), "kind").select("conv_id", "kind", "role", "text", "audit")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, at, state, place = None, "", 0, NOTHING, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                at, state, place = at + 1, _NEXT[state], place + 1
                yield conv, place - 1, "I", _NAMES[state], ""

        for batch in batches:
            for own, kind, role, text, plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    yield from inserted()
                    conv, audit, at, state, place = own, plan, 0, NOTHING, 0
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = _NEXT[state]
                    role = _NAMES[state]
                else:
                    state = _KEPT[role[0], state]
                place += 1
                yield conv, place - 1, edit, role, text
        yield from inserted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "edit", "role", "text"]
        out, size = [], 0
        for row in edits(batches):
            out.append(row)
            size += len(row[4])
            if len(out) == 1000 or size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return both.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def _hashes(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows of ``repaired``, which stand together and in order in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, hashed = none, None
        done: list[tuple] = []
        kinds = [pa.int64(), pa.string()]
        for batch in batches:
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if not place:
                    if now is not none:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = conv, sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(role.encode() + b":" + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "repaired_sha256"])
                done = []
        if now is not none:
            yield pa.RecordBatch.from_arrays([pa.array([now], kinds[0]), pa.array([hashed.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (conv_id, counts of faults, cost, audit) and repaired rows of conversations (conv_id, turn, role, text) after damage.

    Rows without a conversation are one conversation; rows without a turn come first; rows of equal turns stand by role
    and md5 of their text, so repeated rows are neighbours. Texts may be of any length; other columns are not read; no rows give no plans.
    """
    rows = damaged(conversations)
    plans = audits(stored(signatures(rows), "signatures"))
    return plans, repaired(rows, plans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    rows = damaged(table(spark, sf_dir, "conversations"))
    plans = stored(audits(stored(signatures(rows), "signatures")), "audits").drop("signature")
    hashes = _hashes(repaired(rows, plans)).withColumnRenamed("conv_id", "of")
    return plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(_EMPTY)))


def _sql() -> str:
    """The query in DuckDB's SQL: crc32 bit by bit, and the programme as a recursion over rows, a state being its cost and audit as one text that sorts so."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"(lpad((CAST({state}[1:9] AS INTEGER) + {cost})::VARCHAR, 9, '0') || {state}[10:] || '{edit}')"

    byte = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT)), lambda c, b: {byte}), 4294967295::UBIGINT)"
    u0 = f"least(u, {add('e', '3', 'I')}, {add('s', '3', 'I')}, {add('a', '3', 'I')})"
    keep = lambda initial, state: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(state, 'more', 'K')} END"
    other = lambda state: f"CASE WHEN NOT gone THEN {add(state, '3 + more', 'R')} END"
    return rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c1 AS (SELECT *, {crc} % 20 AS kind FROM c0),
c2 AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c1, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS body FROM c2),
c4 AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c3),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM c4),
p AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {add('e', '4', 'D')}, least({add('s', '4', 'D')}, {keep('s', 'e')}),
    least({add('u0', '4', 'D')}, {other('e')}, {other('s')}, {other('a0')}, {keep('u', 'e')}, {keep('u', 's')}, {keep('u', 'a0')}), least({add('a0', '4', 'D')}, {other('u0')}, {keep('a', 'u0')})
  FROM (SELECT *, least(a, {add('u0', '3', 'I')}) AS a0 FROM (SELECT p.conv_id, r.i, e, s, u, a, {u0} AS u0, initial, gone, more FROM p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
done AS (SELECT conv_id, least(e, a, {add('u', '3', 'I')}, {add(add('e', '3', 'I'), '3', 'I')}, {add(add('s', '3', 'I'), '3', 'I')}) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
audits AS (SELECT conv_id, CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit FROM done),
edits AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS o
  FROM (SELECT conv_id, k, audit[k:k] AS edit FROM audits, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (SELECT e.*, r.role, r.text, max(CASE WHEN o = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS h FROM kept GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, '{_EMPTY}') AS repaired_sha256
FROM audits x LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN hashed g ON g.conv_id IS NOT DISTINCT FROM x.conv_id
"""


SQL = _sql()
