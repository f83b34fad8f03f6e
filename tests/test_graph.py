import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattiq.operators import graph as G
from lattiq.operators import resolve as R
from lattiq.operators import sequence as Q
from lattiq.schema import EDGES, NODES, CodeGraph, ddl

N = [(0, "a_pub_func", "Function", "ContractA", "Public"), (1, "a_priv_func", "Function", "ContractA", "Private"), (2, "b_pub_func", "Function", "ContractB", "External"), (3, "b_internal_func", "Function", "ContractB", "Internal"), (4, "c_internal_func", "Function", "ContractC", "Internal"), (5, "ITest", "Interface", "ITest", "Default"), (6, "interface_func", "Function", "ITest", "External"), (7, "var1", "StorageVariable", "ContractA", "Default"), (8, "var2", "StorageVariable", "ContractB", "Default"), (9, "var3", "StorageVariable", "ContractC", "Default")]
E = [(0, 1, "Call", 1), (1, 3, "Call", 1), (2, 3, "Call", 1), (3, 4, "Call", 1), (0, 7, "StorageRead", 2), (1, 7, "StorageWrite", 2), (3, 8, "StorageRead", 2), (4, 9, "StorageWrite", 1), (2, 8, "StorageWrite", 2)]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame(N, "id bigint, name string, node_type string, contract_name string, visibility string")
    edges = spark.createDataFrame([(i, a, b, t, s, (0, 0)) for i, (a, b, t, s) in enumerate(E)], "edge_id bigint, source_node_id bigint, target_node_id bigint, edge_type string, sequence_number bigint, call_site_span struct<start:bigint,end:bigint>")
    return CodeGraph(nodes, edges)


def test_storage_summary(small):
    got = {r.entry: (r.reads, r.writes) for r in G.storage_summary(small.nodes, small.edges).collect()}
    assert got == {0: ([7, 8], [7, 9]), 2: ([8], [8, 9])}
    report = sorted((r.endpoint, r.reads, r.writes) for r in G.storage_report(small.nodes, small.edges).collect())
    assert report == [("ContractA.a_pub_func", "ContractA.var1, ContractB.var2", "ContractA.var1, ContractC.var3"), ("ContractB.b_pub_func", "ContractB.var2", "ContractB.var2, ContractC.var3")]


def test_trace_and_lookup(small, spark):
    seed = G.find_function(small.nodes, "ContractA.a_pub_func").select(F.col("id").alias("entry"), F.col("id").alias("node"))
    got = [(r.function_id, r.var, r.edge_type) for r in G.ordered_trace(small.nodes, small.edges, seed).orderBy("ord").collect()]
    assert got == [(0, 7, "StorageRead"), (1, 7, "StorageWrite"), (3, 8, "StorageRead"), (4, 9, "StorageWrite")]
    with pytest.raises(ValueError):
        G.find_function(small.nodes, "a.b.c")


def test_isolated_and_metadata(small):
    assert {r.id for r in G.isolated_nodes(small.nodes, small.edges).collect()} == {5, 6}
    assert tuple(G.graph_metadata(small.nodes, small.edges, True).first()) == (8, 9, 0)
    assert G.reach_agg(small.nodes, small.edges, F.col("node_type") == "Function", [F.count("*").alias("n")]).where("entry = 0").first().n == 4


def test_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    assert {tuple(r) for r in G.closure(edges, spark.createDataFrame([(1, 1)], "entry bigint, node bigint")).collect()} == {(1, 1), (1, 2)}


def dfs(adjacency, start):
    seen, out = set(), []

    def go(x):
        if x in seen:
            return
        seen.add(x)
        out.append(x)
        for y in adjacency.get(x, ()):
            go(y)

    go(start)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=16))
def test_closures_against_depth_first_search(spark, pairs):
    adjacency = {}
    for a, b in pairs:
        adjacency.setdefault(a, []).append(b)
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src bigint, dst bigint, ord bigint")
    seeds = spark.createDataFrame([(0, 0), (3, 3)], "entry bigint, node bigint")
    want = sorted((s, x) for s in (0, 3) for x in dfs(adjacency, s))
    totals = sorted((s, len(own), sum(own)) for s in (0, 3) for own in [dfs(adjacency, s)])
    for limit in (100, 0):  # walked at once, and in rounds
        assert sorted(tuple(r) for r in G.closure_totals(edges, seeds, limit).collect()) == totals
        assert sorted(tuple(r) for r in G.closure(edges, seeds, limit).collect()) == want
        rows = G.ordered_closure(edges, seeds, limit).orderBy("entry", "path").collect()
        assert [(r.entry, r.node) for r in rows] == [(s, x) for s in (0, 3) for x in dfs(adjacency, s)]


def test_member_cascade(spark):
    symbols = spark.createDataFrame([("I", "f", 1), ("A", "f", 2), ("L", "twice", 3), ("K", "g", 4), ("J", "h", 5)], "contract string, name string, id bigint")
    calls = spark.createDataFrame([(1, "K", "I", "f"), (2, "K", "uint", "twice"), (3, "K", "K", "g"), (4, "K", "uint256[]", "push"), (5, "K", "bool", "x"), (6, "K", "J", "h")], "call_id bigint, scope string, object_type string, property string")
    implements = spark.createDataFrame([("A", "I"), ("X", "J"), ("Y", "J")], "contract string, iface string")
    using = spark.createDataFrame([("K", "uint256", "L")], "contract string, type string, library string")
    faces = spark.createDataFrame([("I",), ("J",)], "iface string")
    got = {r.call_id: (r.target_kind, r.target_id, r.builtin) for r in R.resolve_member(calls, symbols, implements, using, faces).collect()}
    assert got == {1: ("Function", 2, None), 2: ("Function", 3, None), 3: ("Function", 4, None), 4: ("BuiltIn", None, "push"), 5: ("NotCallable", None, None), 6: ("Ambiguous", None, None)}


def test_ancestor_order(spark):
    inherits = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0)], "child string, parent string, ord int")
    got = [r.ancestor for r in R.ancestors(inherits).where("child = 'D'").orderBy("rank").collect()]
    assert got == ["A", "C", "B", "D"]


def test_mapping_text_and_returns(spark):
    rows = spark.createDataFrame([("mapping(address => uint256)",), ("mapping(a => mapping(b => C.D))",), ("uint",)], "t string")
    assert [r[0] for r in rows.select(R.mapping_value_type(F.col("t"))).collect()] == ["uint256", "C.D", None]


def test_dedup_is_adjacent_only(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")] + [(1, 9, None), (1, 10, None)], "o int, p int, x string")
    assert [r.p for r in Q.adjacent_dedup(rows, "o", "p", ["x"]).orderBy("p").collect()] == [0, 2, 4, 9]
    assert [r.id for r in Q.allocate_ids(rows.repartition(3), ["p"]).orderBy("p").collect()] == list(range(7))


def test_schema_texts(spark):
    assert spark.createDataFrame([], ddl(NODES)).columns == list(NODES) and spark.createDataFrame([], ddl(EDGES)).columns == list(EDGES)


def test_traces_have_a_total_order(spark):
    """Edges that share an id and a place come by type, then variable, however the input is laid out."""
    nodes = spark.createDataFrame(N, "id bigint, name string, node_type string, contract_name string, visibility string")
    rows = [(7, 0, v, t, 1, (0, 0)) for t in ("StorageWrite", "StorageRead") for v in (9, 8, 7)]
    kind = "edge_id bigint, source_node_id bigint, target_node_id bigint, edge_type string, sequence_number bigint, call_site_span struct<start:bigint,end:bigint>"
    seeds = spark.createDataFrame([(0, 0)], "entry bigint, node bigint")
    for order in (rows, rows[::-1]):
        got = G.ordered_trace(nodes, spark.createDataFrame(order, kind).repartition(3), seeds).orderBy("ord").collect()
        assert [(r.edge_type, r.var) for r in got] == [(t, v) for t in ("StorageRead", "StorageWrite") for v in (7, 8, 9)]


def test_totals_make_no_pairs(spark, monkeypatch):
    """A ring of n nodes, each an entry: n walks would make n * n pairs; one walk a task is enough."""
    n = 3000
    edges = spark.range(n).selectExpr("id as src", "(id + 1) % 3000 as dst")
    seeds = spark.range(n + 1).selectExpr("id as entry", "id as node")
    monkeypatch.setattr(G, "closure", None)
    got = {tuple(r)[1:] for r in G.closure_totals(edges, seeds).where(f"entry < {n}").collect()}
    assert got == {(n, n * (n - 1) // 2)} and tuple(G.closure_totals(edges, seeds).where(f"entry = {n}").first()) == (n, 1, n)


def test_joins_of_a_large_graph_are_cut_by_rows(small, monkeypatch):
    """A task's rows are bounded, whatever the settings; the result is the same."""
    want = [sorted(map(repr, f(small.nodes, small.edges).collect())) for f in (G.storage_summary, G.storage_report)]
    monkeypatch.setattr(G, "TASK_ROWS", 1)
    assert want == [sorted(map(repr, f(small.nodes, small.edges).collect())) for f in (G.storage_summary, G.storage_report)]
    assert G._tasks(small.edges) == len(E) + 1 and G.storage_access(small.nodes, small.edges).rdd.getNumPartitions() == len(E) + 1


def test_dot_lines_are_not_sorted_unless_asked(small):
    from lattiq.plans.render import dot_lines, to_dot

    plan = lambda df: df._jdf.queryExecution().toString()
    nodes = small.nodes.withColumn("span", F.struct(F.col("id").alias("start"), F.col("id").alias("end")))
    g = CodeGraph(nodes, small.edges)
    assert "Sort" not in plan(dot_lines(g, "G")) and "Sort" in plan(to_dot(g, "G")) and sorted(dot_lines(g, "G").collect()) == sorted(to_dot(g, "G").collect())


def test_large_shuffles_are_cut_by_rows(spark, monkeypatch):
    from lattiq import runtime

    rows = spark.range(100).selectExpr("id % 2 as k", "id as o")
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    assert runtime.cut_by_rows(rows, "k").rdd.getNumPartitions() == 11
    got = Q.place_in_runs(rows.repartition(3), ["k"], ["o"], "p", run=7).orderBy("o").collect()
    assert [r.p for r in got] == [i // 2 for i in range(100)]
