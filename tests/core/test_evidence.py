"""Documents, pointers, lineage, intervals and replay against plain Python on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tickwell.operators import documents as D
from tickwell.operators import intervals as V
from tickwell.operators import lineage as N

SCHEMA = {
    "type": "object", "required": ["a", "b/c"], "additionalProperties": False,
    "properties": {
        "a": {"type": ["integer", "null"], "minimum": 0, "exclusiveMaximum": 5}, "b/c": {"type": "string", "minLength": 2, "pattern": "^x"}, "d~": {"enum": [1, "one", None, [1]]},
        "when": {"type": "string", "format": "date-time"}, "list": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "maximum": 1.5}}}}, "k": {"const": True},
    },
}


def kind_of(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(v)]


def plain_validate(v, s, path=""):
    kinds = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    if kinds and kind_of(v) not in kinds and not (kind_of(v) == "integer" and "number" in kinds):
        return {(path, "type")}
    out, number, text = set(), kind_of(v) in ("integer", "number"), lambda x: json.dumps(x, sort_keys=True)
    checks = {
        "const": "const" in s and text(v) != text(s["const"]), "enum": "enum" in s and text(v) not in map(text, s["enum"]), "minLength": isinstance(v, str) and len(v) < s.get("minLength", 0), "pattern": isinstance(v, str) and "pattern" in s and not re.search(s["pattern"], v),
        "format": isinstance(v, str) and s.get("format") == "date-time" and v != "2024-02-29T10:00:00+01:00", "minimum": number and v < s.get("minimum", v), "maximum": number and v > s.get("maximum", v), "exclusiveMaximum": number and "exclusiveMaximum" in s and v >= s["exclusiveMaximum"],
        "minItems": isinstance(v, list) and len(v) < s.get("minItems", 0), "uniqueItems": isinstance(v, list) and s.get("uniqueItems") and len(set(map(text, v))) < len(v),
    }
    out |= {(path, rule) for rule, bad in checks.items() if bad}
    step = lambda k: f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
    if isinstance(v, dict):
        out |= {(step(k), "required") for k in s.get("required", []) if k not in v}
        out |= {(step(k), "additional") for k in v if s.get("additionalProperties") is False and k not in s["properties"]}
        for k, child in s.get("properties", {}).items():
            out |= plain_validate(v[k], child, step(k)) if k in v else set()
    if isinstance(v, list) and "items" in s:
        for i, x in enumerate(v):
            out |= plain_validate(x, s["items"], step(i))
    return out


def some(rng):
    leaf = lambda: rng.choice([None, True, 0, 3, 5, -1, 1.5, 2.25, "x", "xy", "no", "2024-02-29T10:00:00+01:00", "2023-02-29T10:00:00Z", "2024-02-29", [], {}, [1]])
    out = {k: leaf() for k in ("a", "b/c", "d~", "when", "k", "z") if rng.random() < 0.7}
    if rng.random() < 0.8:
        out["list"] = [{"n": leaf()} if rng.random() < 0.7 else leaf() for _ in range(rng.randrange(4))] if rng.random() < 0.8 else leaf()
    return out if rng.random() < 0.95 else leaf()


def test_contracts_agree_with_plain_python(spark):
    rng = random.Random(1)
    docs = [some(rng) for _ in range(150)]
    frame = spark.createDataFrame([(i, json.dumps(v), "c") for i, v in enumerate(docs)] + [(900, "{", "c"), (901, None, "c"), (902, "1", "other")], "doc long, value string, contract string")
    got = D.validate(D.nodes(frame, keep=("doc", "contract"), most=5), D.rule_table(spark, {"c": SCHEMA})).collect()
    want = {(i, *e) for i, v in enumerate(docs) for e in plain_validate(v, SCHEMA)} | {(900, "", "json"), (901, "", "json"), (902, "", "contract")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def plain_resolve(v, pointer):
    if pointer and not pointer.startswith("/"):
        return "malformed"
    for step in pointer.split("/")[1:]:
        if re.search("~(?![01])", step):
            return "invalid_escape"
        name = step.replace("~1", "/").replace("~0", "~")
        if isinstance(v, dict):
            if name not in v:
                return "missing_key"
            v = v[name]
        elif isinstance(v, list):
            if not re.fullmatch("0|[1-9][0-9]*", name):
                return "invalid_index"
            if int(name) >= len(v):
                return "out_of_range"
            v = v[int(name)]
        else:
            return "through_scalar"
    return "resolved"


def test_pointers_agree_with_plain_python(spark):
    rng = random.Random(2)
    docs = {i: {"a": [1, [2, {"~/": {"": 3}}], "s"], "": some(rng), "0": {"1": None}} for i in range(20)}
    asked = [(i, "".join(rng.choice(["", "/a", "/0", "/1", "/", "/~0~1", "/~", "/01", "/2", "/list", "/n", "x"]) for _ in range(rng.randrange(6)))) for i in range(20) for _ in range(40)]
    found = D.nodes(spark.createDataFrame([(i, json.dumps(v)) for i, v in docs.items()], "doc long, value string"), most=7)
    got = {(r.doc, r.pointer): r.status for r in D.resolve(found, spark.createDataFrame([*asked, (99, ""), (1, None)], "doc long, pointer string")).collect()}
    assert got == {(i, p): plain_resolve(docs[i], p) for i, p in asked} | {(99, ""): "no_document"}


def test_a_document_that_is_too_deep_raises(spark):
    with pytest.raises(Exception, match="nested deeper"):
        D.nodes(spark.createDataFrame([(1, "[[[1]]]")], "doc long, value string"), most=2).collect()


def test_points_meet_the_intervals_that_hold_them(spark):
    rng = random.Random(3)
    points = [(i, rng.randrange(3), rng.randrange(-40, 300)) for i in range(200)] + [(900, None, 5), (901, 1, None)]
    spans = [(i, rng.randrange(3), a := rng.randrange(-60, 300), rng.choice([None, a, a + 1, a - 5, a + rng.randrange(1, 90)])) for i in range(120)] + [(900, 1, None, 7), (901, 1, -10_000_000, 10_000_000), (902, None, 0, 9)]
    got = V.holding(spark.createDataFrame(points, "p long, k int, at int"), spark.createDataFrame(spans, "i long, k int, start int, end int"), ["k"])
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    pairs = [(r.p, r.i) for r in got.collect()]
    want = {(p, i) for p, k, at in points for i, k2, a, b in spans if None not in (k, at, k2, a) and k == k2 and a <= at and (b is None or at < b)}
    assert set(pairs) == want and len(pairs) == len(want)


def test_evidence_only_lowers(spark):
    rows = spark.createDataFrame([(a, b) for a in V.LADDER for b in (*V.LADDER, None)], "a string, b string").select("a", "b", V.lowered(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(V.LADDER.index(r.c) == max(V.LADDER.index(r.a), V.LADDER.index(r.b) if r.b else 0) for r in rows)


def test_values_are_carried_along_chains_and_cycles(spark):
    own = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3), ("d", None), ("e", 2), ("f", 9)], "node string, value int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("c", "f"), ("e", "x")], "src string, dst string")
    assert {r.node: r.value for r in N.carried(own, edges).collect()} == {"a": 9, "b": 9, "c": 9, "d": 2, "e": 2, "f": 9}
    with pytest.raises(ValueError, match="longer"):
        N.carried(own, edges, most=1)


def test_lineage_of_other_kinds_and_odd_documents(spark):
    calc = {
        "artifact_type": "calculation", "calculation_type": "comps-valuation", "entity_id": "E", "as_of_cutoff": "2024-01-02T00:00:00Z", "created_at": "2024-01-03T00:00:00Z", "inputs": [{"artifact_id": "s", "role": "subject"}],
        "parameters": {"peers": [{"name": "p", "included": True, "numerator": 2, "denominator": 1}, {"name": "q", "included": False, "exclusion_reason": "small"}, {"name": "r", "included": True, "numerator": 1}],
                       "subject_metric": 1, "basis": "equity", "diluted_shares": 1, "net_debt": 0, "non_operating_assets": 0, "statistic": "median", "explicit_multiple": None},
        "lineage": [{"parameter_pointer": "/parameters/peers/1/exclusion_reason", "artifact_id": "s", "target": "artifact", "json_pointer": "/why", "reported_value": "small", "normalization": {"operation": "negate"}}],
    }
    source = {"artifact_type": "source", "identifiers": {"entity_id": "E"}, "why": "small"}
    frame = spark.createDataFrame([("artifact", "c", json.dumps(calc)), ("artifact", "s", json.dumps(source)), ("artifact", "bad", "{")], "target string, doc string, value string")
    e = N.evidence(D.nodes(frame, keep=("target", "doc"), most=5))
    got = {(r.rule, r.at) for r in N.inventory_problems(e).collect()}
    assert ("parameter_missing", "/parameters/peers/2/denominator") in got and ("coverage_missing", "/parameters/peers/0/denominator") in got
    assert not any(r == "coverage_unexpected" or "peers/1/numerator" in a for r, a in got)
    assert {(r.rule, r.at) for r in N.citation_problems(e).collect()} == {("normalization", "/lineage/0"), ("role", "/lineage/0")}
    assert N.problems(D.nodes(frame.limit(0), keep=("target", "doc"), most=5)).count() == 0


def test_table_digests_know_types_order_and_values_but_not_partitions(spark):
    from tickwell.sources import digests as G

    rows = [(i, i % 7, f"s{i % 3}" if i % 5 else None, i / 3) for i in range(9000)]
    frame = spark.createDataFrame(rows, "at long, a int, b string, c double")
    told = lambda df: G.digest(df, "at").first().digest
    own = told(frame)
    assert own == told(frame.repartition(7)) == told(frame.orderBy(F.desc("at")).coalesce(1))
    assert own != told(frame.withColumn("a", F.col("a").cast("long"))) and own != told(frame.withColumnRenamed("a", "z"))
    swapped = frame.withColumn("at", F.when(F.col("at") == 5, 8000).when(F.col("at") == 8000, 5).otherwise(F.col("at")))
    assert own != told(swapped) and own != told(frame.where("at <> 8999")) and own != told(frame.fillna("", ["b"]))
    low, high = frame.where("at < 4096"), frame.where("at >= 4096")
    assert own == G.merged(G.ranges(low, "at").unionByName(G.ranges(high, "at")), frame.schema, "at").first().digest
    assert told(frame.limit(0)) == told(frame.limit(0).repartition(3)) and told(frame.limit(0)) != own
    with pytest.raises(TypeError):
        G.digest(frame.withColumn("x", F.array("a")), "at")


def test_shrinkage_in_columns_is_that_of_matrices(spark):
    import numpy as np

    from tickwell.operators import optimize as O

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 0.25
    rows = [(g, t, f"a{i}", float(x[t, i] * (1 + g))) for g in range(2) for t in range(40) for i in range(5)] + [(0, 99, "a1", 5.0), (0, 3, "a9", None)]
    frame = spark.createDataFrame(rows, "g int, t int, asset string, ret double")
    for method in ("constant_correlation", "diagonal"):
        got = {(r.g, r.i, r.j): (r.cov, r.alpha) for r in O.shrunk(frame, ("g",), method).collect()}
        for g in range(2):
            cov, alpha = O.shrink(x * (1 + g), method)
            assert all(abs(got[g, f"a{i}", f"a{j}"][0] - cov[i, j]) < 1e-9 and abs(got[g, f"a{i}", f"a{j}"][1] - alpha) < 1e-9 for i in range(5) for j in range(i, 5))
        assert len(got) == 30
    assert O.shrunk(frame.where("g = 0").drop("g")).count() == 15


def test_published_walk_step_by_step(spark):
    import math

    from tickwell.sources import bars as S

    def plain(start, seed, n=120):
        px, out = start, []
        for i in range(n):
            noise = (seed * 1103515245 + i * 12345) % 1000 / 1000 - 0.5
            c = max(1.0, px + (80 + 15 * math.sin(i / 3) if i < n // 2 else -90 + 10 * math.sin(i / 4)) + noise * 40)
            out.append((px, max(px, c) + abs(noise) * 20, min(px, c) - abs(noise) * 20, c, 100.0 + i % 17 * 3))
            px = c
        return out

    for start, seed in ((40_000.0, 42), (100.0, 3), (2500.0, 8)):
        got = S.synthetic(spark, start=start, seed=seed).orderBy("ts").collect()
        for r, w in zip(got, plain(start, seed), strict=True):
            assert all(abs(a - b) < 1e-7 for a, b in zip((r.open, r.high, r.low, r.close, r.volume), w))
