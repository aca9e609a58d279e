"""Nodes are made by many tasks however few bytes their documents have; what a node holds is told by its own value, without a shuffle."""

import json

import pytest
from pyspark.sql import functions as F

from tickwell.operators import documents as D
from tickwell.operators import lineage as N
from tickwell.plans import evidence as E

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("documents", [E.artifacts, E.conversations])
def test_documents_of_few_bytes_are_dealt_to_many_tasks(spark, documents):
    assert documents(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_members_are_told_as_nodes_are_without_a_shuffle(spark, capsys):
    odd = ["s", "", "5", 5, 2**63, 10**20, 1.5, 1e300, True, None, [], [1, "a"], {}, {"b": None, "a": 1}]
    docs = [("artifact", str(i), json.dumps({"list": [{"x": v, "y": {"z": v}}, v, {}]})) for i, v in enumerate(odd)] + [("artifact", "bad", "{")]
    found = D.nodes(spark.createDataFrame(docs, "target string, doc string, value string"), keep=("target", "doc"), most=5)
    names = {f"{w}_{n}{end}": s for n, s in (("x", "x"), ("z", "y/z"), ("none", "y/none")) for w, end in (("kind", "?"), ("text", ""), ("number", "#"))}
    got = N.members(found, "/list/~i", names)
    got.explain()
    assert "Exchange" not in capsys.readouterr().out
    rows = {(r.doc, r.at): r.asDict() for r in got.collect()}
    nodes = {(r.doc, r.path): r for r in found.collect()}
    assert len(rows) == 3 * len(odd)
    for (doc, at), row in rows.items():
        for name, steps in names.items():
            node = nodes.get((doc, f"{at}/{steps}"))
            assert row[name.rstrip("#?")] == (node[name.split("_")[0]] if node else None), (doc, at, name)


def test_several_values_are_carried_at_once(spark):
    own = spark.createDataFrame([("a", 1, None), ("b", 5, 7), ("c", 9, 1)], "node string, u int, v int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in N.carried(own, edges, values=("u", "v")).collect()} == {("a", 9, 7), ("b", 9, 7), ("c", 9, 1)}


def test_citations_of_a_document_that_is_there_twice_and_of_null_pointers(spark):
    cite = {"parameter_pointer": "/parameters/wacc", "artifact_id": "s", "target": "artifact", "json_pointer": "/rate", "reported_value": 0.1, "normalization": {"operation": "identity"}}
    calc = {"artifact_type": "calculation", "calculation_type": "dcf-valuation", "parameters": {"wacc": 0.1}, "inputs": [{"artifact_id": "s", "role": "assumption"}]}
    calc["lineage"] = [cite, cite | {"json_pointer": None}, cite | {"json_pointer": "rate"}, cite | {"artifact_id": "bad", "json_pointer": ""}, cite | {"reported_value": 0.2}, {}]
    docs = [("artifact", "c", json.dumps(calc)), ("artifact", "s", json.dumps({"artifact_type": "source", "rate": 0.1})), ("artifact", "bad", "{")]
    for times in (1, 2):
        e = N.evidence(D.nodes(spark.createDataFrame(docs * times, "target string, doc string, value string"), keep=("target", "doc"), most=5))
        got = sorted((r.rule, r.at) for r in N.citation_problems(e).collect())
        assert got == [("parameter_differs", "/lineage/4"), ("reported_differs", "/lineage/4"), *[("source_unresolved", f"/lineage/{i}") for i in (1, 2, 3)]]
        repeated = N.inventory_problems(e).where(F.col("rule") == "coverage_repeated").collect()
        assert [(r.doc, r["at"]) for r in repeated] == [("c", "/parameters/wacc")]
