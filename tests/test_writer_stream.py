from lattiq.sources.solidity import parse
from lattiq.sources.writer import Contract, normalize
from lattiq.streaming.sources import extract_stream, source_stream

TEXT = """pragma solidity ^0.8.0; abstract contract A is B, C(1) { struct S { uint a; } mapping(address => uint) public m; event E(uint indexed a);
modifier only() { require(msg.sender == owner, "no"); _; } constructor(uint x) B(x) { m[msg.sender] = x; }
function f(uint a, uint b) external view returns (uint) { if (a > b) return a; else { for (uint i = 0; i < 3; i++) { x += i ** 2; } } while (!done) { delete m[a]; } do { x--; } while (x > 0); (uint c, , ) = g{value: 1}(a); try this.f(1, 2) returns (uint z) { } catch { } emit E(a ? 1 : 2); return new uint[](3)[0]; } }
interface I { function g() external; } library L { function h() internal {} }"""


def test_written_source_parses_to_itself():
    once = normalize(TEXT)
    assert not [n for n in parse(once).root.walk() if n.kind == "error"] and normalize(once) == once
    kinds = lambda t: sorted(n.kind for n in parse(t).root.walk() if n.kind != "block")
    assert kinds(once) == kinds(TEXT)


def test_builder():
    text = Contract("T", ("Test",)).variable("uint256", "x", "public", "1").struct("S", "uint a").enum("E", "A", "B").event("V", "uint a").error("No").modifier("m", (), "_;").constructor(("uint a",), "x = a;").function("f", ("uint a",), "return a;", mutability="pure", returns="uint").build()
    tree = parse(text)
    assert [m.kind for m in tree.root["items"][1]["members"]] == ["state_variable", "struct", "enum", "event", "error_definition", "modifier", "constructor", "function"]
    assert not [n for n in tree.root.walk() if n.kind == "error"]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "p1").mkdir(parents=True)
    (src / "p1" / "a.sol").write_text("contract A { uint x; function f() public { x = 1; } }")
    go = lambda: extract_stream(source_stream(spark, str(src)), str(out), str(tmp_path / "cp"), str(tmp_path / "known")).awaitTermination()
    go()
    (src / "p1" / "b.sol").write_text("contract B { A a; function g() public { a.f(); } }")
    go()
    nodes = spark.read.parquet(str(out / "nodes"))
    assert nodes.where("batch = 0").count() == 3 and nodes.where("batch = 1").count() == 6
    assert spark.read.parquet(str(out / "edges")).where("batch = 1 and edge_type = 'Call'").count() == 1
