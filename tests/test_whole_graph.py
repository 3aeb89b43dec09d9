"""Queries over the whole graph take in every label and edge type."""

from graphloom.graph import Graph
from graphloom.plans import workload
from graphloom.sources import files
from graphloom.sources.tables import from_tables


def test_the_snapshot_holds_every_label_and_type(spark, data, monkeypatch):
    saved = []
    monkeypatch.setattr(files, "save", lambda g, path, version, save=files.save: (saved.append((path, version)), save(g, path, version)))
    workload.QUERIES["snapshot_roundtrip"](spark, data).collect()
    whole, back = from_tables(spark, data), files.load(spark, *saved[0])
    assert set(back.nodes) == set(whole.nodes) and set(back.edges) == set(whole.edges)
    count = lambda g: {(k, f.df.count()) for k, f in [*g.nodes.items(), *g.edges.items()]}
    assert count(back) == count(whole)


def test_every_label_and_type_is_validated(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(Graph, "validate", lambda self, validate=Graph.validate: (seen.append(self), validate(self))[1])
    assert workload.QUERIES["validate"](spark, data).count() == 0
    whole = from_tables(spark, data)
    assert set(seen[0].nodes) == set(whole.nodes) and set(seen[0].edges) == set(whole.edges)
