"""Sealed tables are joined by merges, a set of rules at a time."""

from tickwell.operators import replay as P
from tickwell.plans import evidence as E

DATA = "/root/testdata/sf0.001"


def test_sealed_tables_are_not_broadcast(spark, monkeypatch, capsys):
    plans, kept = [], P.stored

    def told(df, name):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return kept(df, name)

    monkeypatch.setattr(P, "stored", told)
    sealed = E.sealed_studies(spark, DATA)
    assert P.violations(sealed, E.PARTS, E.FAMILIES).count() > 0
    assert len(plans) == 6
    assert all("BroadcastHashJoin" not in p for p in plans[:4])  # contracts, lineages, sessions, flags and diagnostics
