"""Graph queries on a graph of 580 nodes and 790 edges: a made-up one, written as DOT and read back, against plain loops;
and, if EXAMPLE_DOT names one, that of a real project against counts found by hand-written scripts."""

import os

import pytest
from pyspark.sql import functions as F

from lattiq.operators import graph as G
from lattiq.plans.render import to_dot
from lattiq.plans.sample import sample_graph
from lattiq.sources.dot import read_dot

#: A DOT file of 580 nodes and 790 edges; the counts below are of that graph.
GOLDEN = os.environ.get("EXAMPLE_DOT", "")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dot") / "sample.dot"
    path.write_text("\n".join(r.line for r in to_dot(sample_graph(spark), "sample").collect()))
    return read_dot(spark, str(path))


def test_dot_round_trip(spark, made):
    whole = sample_graph(spark)
    assert (made.nodes.count(), made.edges.count()) == (580, 790)
    columns = ["id", "name", "node_type", "contract_name", "visibility"]
    assert sorted(map(repr, made.nodes.select(*columns).collect())) == sorted(map(repr, whole.nodes.select(*columns).collect()))
    columns = ["source_node_id", "target_node_id", "edge_type"]
    assert sorted(made.edges.select(*columns).collect()) == sorted(whole.edges.select(*columns).collect())


def test_queries_of_the_made_graph(made):
    nodes = {r.id: r for r in made.nodes.collect()}
    edges = [(r.source_node_id, r.target_node_id, r.edge_type) for r in made.edges.collect()]
    for follow in (False, True):
        want = {}
        for i, n in nodes.items():
            if n.node_type == "Function" and n.visibility == "Public":
                seen, todo = {i}, [i]
                while todo:
                    x = todo.pop()
                    new = {b for a, b, t in edges if a == x and (t == "Call" or (follow and t.endswith("Branch")))} - seen
                    seen |= new
                    todo += new
                want[i] = tuple(sorted({b for a, b, t in edges if a in seen and t == kind}) for kind in ("StorageRead", "StorageWrite"))
        got = {r.entry: (r.reads, r.writes) for r in G.storage_summary(made.nodes, made.edges, follow).collect()}
        assert got == want and len(want) == 50


def test_projects_do_not_mix(spark):
    one, many = sample_graph(spark), sample_graph(spark, 3)
    own = sorted((r.endpoint, r.reads, r.writes) for r in G.storage_report(one.nodes, one.edges).collect())
    assert sorted((r.endpoint, r.reads, r.writes) for r in G.storage_report(many.nodes, many.edges).collect()) == sorted(own * 3)
    rolled = lambda g: sorted((r.contract, len(r.functions)) for r in G.contract_rollup(g.nodes).collect())
    assert rolled(many) == sorted(rolled(one) * 3)


real = pytest.mark.skipif(not os.path.exists(GOLDEN), reason="set EXAMPLE_DOT to the example graph")


@pytest.fixture(scope="module")
def golden(spark):
    g = read_dot(spark, GOLDEN)
    g.nodes, g.edges = g.nodes.cache(), g.edges.cache()
    return g


def counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


@real
def test_types(golden):
    assert counts(golden.nodes, "node_type") == {"Function": 155, "IfStatement": 152, "ThenBlock": 152, "StorageVariable": 69, "Constructor": 15, "ElseBlock": 12, "Interface": 11, "ForCondition": 5, "ForBlock": 5, "Modifier": 2, "Evm": 1, "EventListener": 1}
    assert counts(golden.edges, "edge_type") == {"StorageRead": 193, "IfConditionBranch": 152, "ThenBranch": 152, "StorageWrite": 115, "Call": 137, "Return": 19, "ElseBranch": 12, "ForConditionBranch": 5, "ForBodyBranch": 5}
    assert golden.edges.where("event_name is not null").count() == 80
    assert G.graph_metadata(golden.nodes, golden.edges).first().isolated_count == 90


@real
def test_queries(golden):
    assert G.entry_points(golden.nodes).count() == 55
    for follow, pairs, reads, writes in ((False, 172, 134, 67), (True, 555, 173, 85)):
        assert G.reachability(golden.nodes, golden.edges, follow).count() == pairs
        found = G.storage_summary(golden.nodes, golden.edges, follow).agg(F.sum(F.size("reads")), F.sum(F.size("writes"))).first()
        assert tuple(found) == (reads, writes)
    assert G.storage_summary(golden.nodes, golden.edges).where("size(reads) + size(writes) > 0").count() == 52
