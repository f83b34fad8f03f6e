"""Named steps, display texts of accesses, single tests, builders, imports, manifests."""

import pytest
from pyspark.sql import functions as F

from lattiq.functions import natspec as N
from lattiq.operators import resolve as R
from lattiq.plans import testgen as T
from lattiq.plans.extract import STEPS, Project, extract
from lattiq.plans.pipeline import Pipeline, Step
from lattiq.schema import CodeGraph
from lattiq.sources import mermaid as M
from lattiq.sources import writer as W
from lattiq.sources.files import import_closure
from lattiq.sources.solidity import parse

ACCESS = """contract A { uint x; uint y; uint[] a; bool b; event E(uint n); function g(uint v) internal returns (uint) { return v; }
 function f() public returns (uint) { y = x + 1; uint z = x * 2; g(x + 1); emit E(x); require(x > 1, "m"); if (x > 2) { y = 1; } while (!b) { y = 2; } for (uint i = x; i < 3; i++) { y = 3; } a[x]; x; return x - 1; } }"""


def test_display_texts():
    p = Project([("a.sol", ACCESS.encode())])
    names = {n["id"]: n["name"] for n in p.nodes}
    edges = {e["edge_id"]: e for e in p.edges}
    shown = [(names[edges[r["edge_id"]]["target_node_id"]], edges[r["edge_id"]]["edge_type"][7:], r["operation"]) for k, r in p.relations() if k == "accesses" and names[edges[r["edge_id"]]["source_node_id"]] == "f"]
    reads = [op for v, kind, op in shown if kind == "Read" and v == "x"]
    assert reads[:4] == ["y = x + 1", "uint z = x * 2;", "g(x + 1)", "E(x)"] or reads[:2] == ["y = x + 1", "uint z = x * 2;"]
    for want in ("g(x + 1)", 'require(x > 1, "m")', "x > 2", "a[x]", "return x - 1;"):
        assert want in reads, (want, reads)
    assert any(op.startswith("emit E(x)") for op in reads) and ("b", "Read", "!b") in shown
    assert all(op.startswith("y = ") for v, kind, op in shown if kind == "Write")


def test_accesses_are_numbered_with_their_edges(spark):
    rows = [(p, "a.sol", ACCESS.replace("contract A", f"contract {p}").encode()) for p in ("P", "Q")]
    g = extract(spark.createDataFrame(rows, "project string, path string, content binary"))
    touch = g.edges.where("edge_type like 'Storage%'")
    both = touch.join(g.side["accesses"], "edge_id")
    assert both.count() == touch.count() == g.side["accesses"].count()
    inside = both.where((F.col("display_span.start") <= F.col("call_site_span.start")) & (F.col("display_span.end") >= F.col("call_site_span.end")))
    assert inside.count() == both.count()


def test_pipeline(spark):
    sources = spark.createDataFrame([("a.sol", b"contract A { uint x; function f() public { x = 1; } }")], "path string, content binary")
    seen = []

    def named(graph, config):
        seen.append(config)
        return CodeGraph(graph.nodes.withColumn("name", F.upper("name")), graph.edges, graph.side)

    pipe = Pipeline().add_step(Step("Upper", named))
    assert [s.name for s in pipe.enabled()] == [*STEPS, "Upper"]
    assert {r.name for r in pipe.run(sources, {"k": "v"}).nodes.collect()} == {"A", "F", "X"} and seen == [{"k": "v"}]
    off = pipe.disable_step("Upper").disable_step("Calls-Handling").run(sources)
    assert off.edges.count() == 0 and {r.name for r in off.nodes.collect()} == {"A", "f", "x"}
    assert pipe.enable_step("Calls-Handling").run(sources).edges.count() == 1


def test_single_tests_or_errors(spark):
    demo = b"""contract D { uint v; address owner; function f(uint n) public { require(n > 3, "small"); require(n != 7, "seven"); v = n; } function g(address who) public { require(who == owner || msg.sender == owner, "o"); } function h() public { } }"""
    g = extract(spark.createDataFrame([("D.sol", demo)], "path string, content binary"))
    assert T.revert_test(g, "D", "f").first().path == "DFRevertTest0.t.sol" and T.state_test(g, "D", "f").count() == 1 and T.access_test(g, "D", "g").count() == 1
    for f in (T.revert_test, T.state_test, T.access_test):
        with pytest.raises(ValueError):
            f(g, "D", "h")
    rows = spark.createDataFrame([({"b": "0x2", "a": "0x1", "n": "3"}, {"b": "Address", "a": "Address", "n": "UInt"}), ({"n": "3"}, {"n": "UInt"})], "assignment map<string,string>, kinds map<string,string>")
    assert sorted(str(r[0]) for r in rows.select(T.prank_address(F.col("assignment"), F.col("kinds"))).collect()) == ["0x1", "None"]


def test_diagram_builder():
    inner = lambda b: b.signal("A", "B", "->>+", "go")
    b = M.Builder().title("T").acc_title("for all").acc_descr("one line").participant("A").actor("B", "Bob").autonumber(1, 2).block("loop", "again", inner).deactivate("B").autonumber_off()
    assert b.statement_count() == 12
    text = b.build()
    again = M.Builder().process(text)
    assert again.build() == text and again.statement_count() == b.statement_count()
    assert M.Builder().process("A->>B: hi").statement_count() == 1
    with pytest.raises(M.DiagramError):
        M.Builder().process("nonsense here")


def test_text_helpers():
    assert W.binary(W.binary("a", "+", "b"), "*", "c") == "(a + b) * c" and W.binary("a", "-", "b - c") == "a - (b - c)" and W.binary("a * b", "+", "c") == "a * b + c"
    assert W.declared(W.array(W.uint()), "xs") == "uint256[] memory xs" and W.declared(W.mapping("address", "bool"), "m").startswith("mapping(address => bool) storage") and W.declared(W.integer(8), "i") == "int8 i"
    assert W.string_literal('a"b\n') == '"a\\"b\\n"' and W.boolean(True) == "true" and W.fixed_bytes(4) == "bytes4" and W.default_location("bytes32") is None
    text = W.Contract("C").function("f", (), *W.if_else("a > b", ("x = 1;",), ("x = 2;",))).build()
    assert not [n for n in parse(text).root.walk() if n.kind == "error"]


def test_imports(tmp_path):
    for name, text in {"src/A.sol": 'import "./B.sol";\nimport {X} from "@z/C.sol";\n// import "./no.sol";', "src/B.sol": "import * as D from 'D.sol';", "src/E.sol": "", "dep/z/C.sol": 'import "../../src/A.sol";', "lib/D.sol": 'import "gone.sol";', "other/F.sol": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = import_closure([str(tmp_path / "src")], str(tmp_path), ["@z/=dep/z/"])
    assert [p.removeprefix(str(tmp_path) + "/") for p in got] == ["dep/z/C.sol", "lib/D.sol", "src/A.sol", "src/B.sol", "src/E.sol"]
    assert import_closure([str(tmp_path / "src/E.sol")], str(tmp_path)) == [str(tmp_path / "src/E.sol")]


def test_documentation_helpers_and_bindings(spark):
    rows = spark.createDataFrame([("/// @return a\n/// @return b\n/// @dev d",), ("// no",)], "t string").select(N.natspec_items(F.col("t")).alias("i"))
    got = rows.select(N.count_returns(F.col("i")).alias("n"), N.is_empty(F.col("i")).alias("e"), F.size(N.append(F.col("i"), F.col("i"))).alias("twice")).collect()
    assert [(r.n, r.e, r.twice) for r in got][0] == (2, False, 6) and got[1].e and got[1].twice == 0
    kind = "key string, contract_name string, address string, notes string"
    old = spark.createDataFrame([("KeyA", None, "0x1", "original note")], kind)
    entries = spark.createDataFrame([(1, "Contract", "A", "KeyA", "f"), (2, "Contract", "B", "KeyB", "f"), (3, "Contract", "C", "KeyA", "f"), (4, "Interface", "I", "KeyA", "f")], "ord int, item_kind string, item_name string, key string, file_path string")
    got = {r.key: r for r in R.bindings_from_docs(old, entries).collect()}
    assert (got["KeyA"].contract_name, got["KeyA"].address, got["KeyB"].contract_name, len(got)) == ("C", "0x1", "B", 2)
    assert got["KeyA"].notes == "bound by C in f; before: bound by A in f; before: original note" and got["KeyB"].notes == "bound by B in f; before: first found on B"


def test_manifests_grow(spark):
    m = N.manifest(spark.createDataFrame([("c.sol", b"/// a\ncontract C { /// b\n uint x; }")], "path string, content binary"))
    more = N.extend_manifest(m, m)
    assert sorted(r.ord for r in more.collect()) == [0, 1, 2, 3]
    assert N.manifest_query(more, "Contract", "c").count() == 2
