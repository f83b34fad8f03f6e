import pytest

from lattiq.plans.extract import extract
from lattiq.plans.testgen import all_tests, deployer_tests
from lattiq.sources import mermaid as M
from lattiq.sources.solidity import parse

DEMO = b"""contract Demo {
  string public message; uint256 public value; address public owner;
  constructor(string memory m, uint256 v) { message = m; value = v; }
  function setValue(uint256 newValue) public { require(newValue > 0, "must be positive"); value = newValue; }
  function setMessage(string memory m) public { message = m; }
  function stop() public { require(msg.sender == owner, "only owner"); value = 0; }
}"""


def test_generated_tests(spark):
    g = extract(spark.createDataFrame([("Demo.sol", DEMO)], "path string, content binary"))
    got = {r.path: r.text for r in all_tests(g).collect()}
    assert set(got) == {"DemoDeployerTest.t.sol", "DemoSetValueRevertTest0.t.sol", "DemoSetValueStateTest0.t.sol", "DemoSetMessageStateTest0.t.sol", "DemoStopStateTest0.t.sol", "DemoStopAccessTest0.t.sol"}
    assert 'new Demo("test", 42)' in got["DemoDeployerTest.t.sol"]
    assert 'vm.expectRevert(bytes("must be positive"));' in got["DemoSetValueRevertTest0.t.sol"] and "contractInstance.setValue(0);" in got["DemoSetValueRevertTest0.t.sol"]
    assert "keccak256(bytes(contractInstance.message()))" in got["DemoSetMessageStateTest0.t.sol"]
    assert "uint256 initialValue = contractInstance.value();" in got["DemoStopStateTest0.t.sol"]
    for text in got.values():
        assert not [n for n in parse(text).root.walk() if n.kind == "error"]
    assert deployer_tests(g).count() == 1


DIAGRAM = """sequenceDiagram
    title A diagram
    %% a comment
    participant A as "Some one"
    actor B
    autonumber 1 2
    A->>+B: call(x,   y)
    alt x > 0
        B-->>-A: yes
    else other
        Note over A,B: nothing
    end
    loop again
        A-xB: lost
    end
    create participant C
    A->C
    destroy C
"""


def test_diagram_round_trip():
    rows = M.parse(DIAGRAM)
    assert [r[2] for r in rows] == "title participant actor autonumber signal activate alt signal deactivate else note end loop signal end".split() + ["create participant", "signal", "destroy"]
    text = M.write(rows)
    again = M.parse(text)
    assert [r[2:] for r in again] == [(*r[2:6], " ".join(r[6].split()) if r[6] else r[6]) for r in rows] and M.write(again) == text


@pytest.mark.parametrize(("text", "kind"), [("  \n", "EmptyInput"), ("graph TD", "NotASequenceDiagram"), ("sequenceDiagram\n nonsense", "Syntax"), ("sequenceDiagram\n alt x", "Syntax"), ("sequenceDiagram\n end", "Syntax"), ("sequenceDiagram\n else", "Syntax")])
def test_diagram_errors(text, kind):
    with pytest.raises(M.DiagramError) as e:
        M.parse(text)
    assert e.value.kind == kind


def test_builder_and_rows(spark):
    b = M.Builder().title("T").participant("A").signal("A", "Bob", "->>+", text="go").begin("alt", "x").note("over", "A", "n").otherwise("y").end().autonumber()
    text = b.build()
    assert M.write(M.parse(text)) == text and "activate Bob" in text
    got = M.statements(spark.createDataFrame([(1, text), (2, "no")], "diagram bigint, text string")).collect()
    assert sum(r.diagram == 1 for r in got) == len(b.rows) and [r.a for r in got if r.kind == "error"] == ["NotASequenceDiagram"]
