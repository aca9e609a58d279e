"""Repetition rules, conversation repair and periodic runs against brute force, and the defined results of odd inputs."""

import hashlib
import heapq
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickwell.llm import conversations, repetition, runs

DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean, runs long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "w" * 5000 + " x" * 3000
ODD = [None, "", " \n\t ", "one", "one", "a\nb\na\n\n\n", "é ü z   #*" * 30, LONG]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0.5, True, 1) for i, t in rows], DOCS)


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if own := WORD.findall(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, own))
            seen.add(line)
    for n in range(5, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, met, more, later = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            more |= set(range(i, i + n)) if times[g] > 1 else set()
            later |= set(range(i, i + n)) if g in met else set()
            met.add(g)
        if n == 5:
            out["n_repeat_words"] = len(more)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in later)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    limits = {"dup_line_chars": 20, "dup_chars_5": 15, "dup_chars_6": 14, "dup_chars_7": 13, "dup_chars_8": 12, "dup_chars_9": 11, "dup_chars_10": 10}
    out["kept"] = not out["base_failed"] and all(100 * out[k] <= most * out["word_chars"] for k, most in limits.items())
    return out


def texts(rng, n=60):
    out = []
    for _ in range(n):
        own = [["a", "bb", "é", "d#", "E"][k] for k in rng.integers(0, rng.integers(1, 6), rng.integers(0, 120))]
        if rng.integers(0, 2):
            own = [f"w{k}" for k in rng.integers(0, 400, rng.integers(0, 200))]
            at = rng.integers(0, len(own) + 1)
            own = own[:at] + own[: rng.integers(0, 30)] + own[at:]
        out.append("".join(w + str(rng.choice([" ", "\n", " \t", "\r\n"])) for w in own))
    return out


def test_repetition_agrees_with_brute_force(spark):
    docs = [*ODD, *texts(np.random.default_rng(3))]
    got = {r.doc_id: r.asDict() for r in repetition.judge(frame(spark, enumerate(docs))).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        assert {k: got[i][k] for k in rules(text)} == rules(text), text


def test_long_words_are_judged_by_their_characters(spark):
    filler = [f"w{k}" for k in range(100)]
    link = [f"https://example.org/{k}/{'y' * 40}" for k in range(8)]
    got = {r.doc_id: r for r in repetition.judge(frame(spark, [(1, " ".join(filler + link + filler[:1] + link)), (2, " ".join(filler + link))])).collect()}
    assert not got[1].base_failed and not got[1].kept and got[2].kept


def test_repetition_of_empty_and_repeated_rows(spark):
    assert repetition.judge(frame(spark, [])).count() == 0
    assert repetition.judge(frame(spark, [(1, "x"), (1, "x"), (None, "y")])).count() == 3


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return {
        "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if found else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    }


def test_runs_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = dict(enumerate([*ODD, "b" + " a" * 9, " ".join("abcab" * 9), *texts(rng, 250)]))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in docs)
    got = {r.doc_id: r.asDict() for r in runs.digests(runs.periodic_runs(frame(spark, docs.items()))).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == run_row(i, text), text


def test_refinement_over_many_shapes():
    rng = np.random.default_rng(6)
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 9)):
            w = rng.integers(0, rng.choice([1, 2, 3, 40]), rng.integers(0, 130))
            if len(w) > 9 and rng.integers(0, 2):
                a, p = rng.integers(0, len(w)), rng.integers(1, 30)
                w[a:] = np.resize(w[a : a + p], len(w) - a)
            docs.append(w)
        assert [[tuple(r) for r in x.tolist()] for x in runs.find_runs(docs)] == [plain_runs(w.tolist()) for w in docs]
    assert runs.find_runs([]) == []


def test_refinement_of_a_long_loop_takes_few_moves():
    w = np.resize(np.arange(5000), 40_000)
    assert runs.find_runs([w, np.zeros(30_000, int)])[0].tolist() == [[0, 40_000, 5000]]


def test_runs_of_empty_tables_and_rows_without_id(spark):
    assert runs.periodic_runs(frame(spark, [])).count() == 0
    rows = runs.digests(runs.periodic_runs(frame(spark, [(None, "a a a a a a a"), (7, "b"), (7, "b")]))).collect()
    assert sorted(r.n_runs for r in rows) == [0, 0, 1]


def cheapest(rows):
    """Dijkstra over (rows read, state), by cost and then audit: (cost, audit, repaired rows). rows: role, text, fault."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        turn = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn, (*out, (name, ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, turn, (*out, (name, text))))
            if role[:1] and (role[:1] == turn or (role[:1] == "s" and state == "")):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation with its id in front."""
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faulty = set(), []
    for _, role, text in out:
        chars = re.sub(r"[\x20\x09-\x0D]", "", text)
        faulty.append((role, text, "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""))
        seen.add((role, text))
    turns = [t for t, *_ in out if t is not None]
    cost, audit, kept = cheapest(faulty)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def talks(rng, n=250):
    roles, said = ["user", "assistant", "system", "user", "assistant", "tool", "usher", "", None], ["Yes.", "No!", "cut off", "", " \n", "Hm?  ", None, "e" * 300 + ".", "Go. "]
    return [
        (c if c else None, None if rng.integers(0, 12) == 0 else int(rng.integers(0, 9)) if rng.integers(0, 3) == 0 else t * (1 + c % 3), roles[rng.integers(0, 5 if c % 2 else 9)], said[rng.integers(0, 9)] if c % 3 else f"t{t}.")
        for c in range(n)
        for t in range(rng.integers(1, 12))
    ]


def test_repair_agrees_with_brute_force(spark, tmp_path):
    rows = talks(np.random.default_rng(8))
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in conversations.query(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = plain_repair([r for r in rows if r[0] == conv])
        assert {k: got[conv][k] for k in want} == want, conv


def test_answers_share_prefixes_and_break_ties():
    rng = np.random.default_rng(9)
    signs = sorted({"".join(rng.choice(list("suaoSUAOx"), rng.integers(0, 9))) for _ in range(600)})
    rows = lambda s: [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], f"{i}", "blank" if c == "x" else "truncated" if c.isupper() else "") for i, c in enumerate(s)]
    assert list(conversations.answers(iter(signs))) == [(s, *cheapest(rows(s))[:2]) for s in signs]


def test_a_long_conversation_keeps_layers_of_one_size():
    conversations.step.cache_clear()
    signs = "uaSxoAuu" * 20_000
    (_, cost, audit), = conversations.answers(iter([signs]))
    assert cost > 0 and len(audit.replace("I", "")) == len(signs) and conversations.step.cache_info().currsize < 500


def test_repaired_rows_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    plans, rows = conversations.repair(spark.createDataFrame([], schema))
    assert plans.count() == rows.count() == 0
    whole = next(c for c in range(99) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    talk = [(whole, 0, "user", "Hello."), (whole, 1, "user", "Anyone?"), (whole, 2, "assistant", "Yes.")]
    plans, rows = conversations.repair(spark.createDataFrame(talk, schema))
    assert [(r.cost, r.audit) for r in plans.collect()] == [(3, "KIKK")]
    assert [tuple(r)[1:] for r in rows.orderBy("place").collect()] == [(0, "K", "user", "Hello."), (1, "I", "assistant", ""), (2, "K", "user", "Anyone?"), (3, "K", "assistant", "Yes.")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_over_the_smallest_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for r in repetition.query(spark, at).collect():
        assert {k: r[k] for k in rules(docs[r.doc_id])} == rules(docs[r.doc_id])
    short = {i: t for i, t in docs.items() if len(t or "") < 4000}
    for r in runs.query(spark, at).where(f"doc_id IN ({', '.join(map(str, short))})").collect():
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == run_row(r.doc_id, short[r.doc_id])
    talk = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for r in conversations.query(spark, at).collect():
        want = plain_repair([x for x in talk if x[0] == r.conv_id])
        assert {k: r[k] for k in want} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_conversation_repair", "op13_periodic_runs"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from tickwell.llm import queries

    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, at).toPandas()[list(want.columns)]
    key = want.columns[0]
    assert got.sort_values(key).reset_index(drop=True).astype(object).fillna(-1).astype(str).replace(r"\.0$", "", regex=True).equals(want.sort_values(key).reset_index(drop=True).astype(object).fillna(-1).astype(str).replace(r"\.0$", "", regex=True))


def test_repair_sql_agrees_on_odd_conversations():
    import duckdb
    import pandas as pd

    conversations_ = pd.DataFrame(talks(np.random.default_rng(12), 120), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations_)
    rows = talks(np.random.default_rng(12), 120)
    for r in con.sql(conversations.SQL).df().astype(object).to_dict("records"):
        conv = None if pd.isna(r["conv_id"]) else r["conv_id"]
        want = plain_repair([x for x in rows if x[0] == conv])
        assert {k: r[k] for k in want} == want, conv
