"""Mermaid sequence diagrams: text to statement rows, and rows to text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

STATEMENTS = "ord bigint, depth int, kind string, a string, b string, arrow string, text string"
_ARROW = r"<<-->>|<<->>|-->>|->>|-->|->|--x|-x|--\)|-\)"
_RULES = [
    ("signal", re.compile(rf"([^:;]+?)\s*({_ARROW})\s*([+-]?)\s*([^:;]+?)\s*(?::\s*(.*))?\Z")),
    ("note", re.compile(r"[Nn]ote\s+(left of|right of|over)\s+([^:]+?)\s*:\s*(.*)\Z")),
    ("participant", re.compile(r"(participant|actor)\s+(\S.*?)(?:\s+as\s+(.*))?\Z")),
    ("create", re.compile(r"create\s+(participant|actor)\s+(\S+)(?:\s+as\s+(.*))?\Z")),
    ("word", re.compile(r"(activate|deactivate|destroy)\s+(\S+)\Z")),
    ("links", re.compile(r"(links|link|properties|details)\s+([^:]+?)\s*:\s*(.*)\Z")),
    ("open", re.compile(r"(loop|opt|alt|par_over|par over|par|rect|break|critical|box)\b\s*(.*)\Z")),
    ("part", re.compile(r"(else|and|option)\b\s*(.*)\Z")),
    ("autonumber", re.compile(r"autonumber(?:\s+(off|\d+(?:\s+\d+)?))?\Z")),
    ("title", re.compile(r"(title|accTitle|accDescr)\s*:?\s*(.*)\Z")),
]


class DiagramError(ValueError):
    """kind: EmptyInput, NotASequenceDiagram or Syntax."""

    def __init__(self, kind: str, line: str = ""):
        super().__init__(f"{kind}: {line}")
        self.kind = kind


def parse(text: str) -> list[tuple]:
    """(ord, depth, kind, a, b, arrow, text) of each statement; comments and empty lines are left out.

    A signal's '+' or '-' before the target becomes an activation or deactivation of its own.
    """
    if not text.strip():
        raise DiagramError("EmptyInput")
    lines = [x.strip() for line in text.split("\n") for x in ([line] if "%%" in line or "#" in line else line.split(";"))]
    lines = [x for x in lines if x and not x.startswith("%%")]
    if not lines or lines[0] != "sequenceDiagram":
        raise DiagramError("NotASequenceDiagram", lines[0] if lines else "")
    out: list[tuple] = []
    blocks: list[str] = []
    several: list[str] | None = None

    def put(kind, a=None, b=None, arrow=None, words=None):
        out.append((len(out), len(blocks), kind, a, b, arrow, words))

    for line in lines[1:]:
        if several is not None:
            if line == "}":
                put("accDescr", words="\n".join(several))
                several = None
            else:
                several.append(line)
            continue
        if re.fullmatch(r"accDescr\s*\{", line):
            several = []
            continue
        if line == "end":
            if not blocks:
                raise DiagramError("Syntax", line)
            kind = blocks.pop()
            put("end", kind)
            continue
        for rule, pattern in [*_RULES[1:], _RULES[0]]:
            m = pattern.match(line)
            if not m:
                continue
            if rule == "signal":
                source, arrow, mark, target, words = m.groups()
                put("signal", source, target, arrow, words)
                if mark:
                    put("activate" if mark == "+" else "deactivate", target if mark == "+" else source)
            elif rule == "note":
                put("note", m[2], arrow=m[1], words=m[3])
            elif rule in ("participant", "create"):
                put(m[1] if rule == "participant" else f"create {m[1]}", m[2], words=m[3])
            elif rule == "word":
                put(m[1], m[2])
            elif rule == "links":
                put(m[1], m[2], words=m[3])
            elif rule == "open":
                put(m[1].replace(" ", "_"), words=m[2] or None)
                blocks.append(m[1].replace(" ", "_"))
            elif rule == "part":
                wanted = {"else": "alt", "and": "par", "option": "critical"}[m[1]]
                if not blocks or not blocks[-1].startswith(wanted):
                    raise DiagramError("Syntax", line)
                out.append((len(out), len(blocks) - 1, m[1], None, None, None, m[2] or None))
            elif rule == "autonumber":
                put("autonumber", words=m[1])
            else:
                put(m[1], words=m[2])
            break
        else:
            raise DiagramError("Syntax", line)
    if blocks or several is not None:
        raise DiagramError("Syntax", "a block isn't ended")
    return out


def write(statements: list[tuple]) -> str:
    """The text of statement rows; white space in labels is one space each."""
    flat = lambda s: " ".join((s or "").split())
    out = ["sequenceDiagram"]
    for _, depth, kind, a, b, arrow, words in statements:
        label = flat(words)
        if kind == "signal":
            line = f"{a}{arrow}{b}" + (f": {label}" if words is not None else "")
        elif kind == "note":
            line = f"Note {arrow} {a}: {label}"
        elif kind in ("participant", "actor") or kind.startswith("create "):
            line = f"{kind} {a}" + (f" as {label}" if words else "")
        elif kind in ("activate", "deactivate", "destroy"):
            line = f"{kind} {a}"
        elif kind in ("links", "link", "properties", "details"):
            line = f"{kind} {a}: {label}"
        elif kind == "end":
            line = "end"
        elif kind in ("title", "accTitle", "accDescr"):
            line = f"{kind}{':' if kind != 'title' else ''} {label}"
        else:
            line = f"{kind.replace('_', ' ') if kind == 'par_over' else kind} {label}".rstrip()
        out.append("  " * depth + line)
    return "\n".join(out) + "\n"


def statements(diagrams: DataFrame, key: str = "diagram", column: str = "text") -> DataFrame:
    """Statement rows of diagrams(key, text), each with its key; a diagram that can't be parsed has one row of kind error."""
    kind = diagrams.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[column]):
                try:
                    rows += [(k, *r) for r in parse(t or "")]
                except DiagramError as e:
                    rows.append((k, 0, 0, "error", e.kind, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "ord", "depth", "kind", "a", "b", "arrow", "text"])

    return diagrams.select(key, column).mapInPandas(run, f"{key} {kind}, {STATEMENTS}")


class Builder:
    """Statements one by one, for diagrams that are not drawn from a graph."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.open: list[str] = []

    def _add(self, kind, a=None, b=None, arrow=None, text=None, depth=None):
        self.rows.append((len(self.rows), len(self.open) if depth is None else depth, kind, a, b, arrow, text))
        return self

    def title(self, text):
        return self._add("title", text=text)

    def acc_title(self, text):
        return self._add("accTitle", text=text)

    def acc_descr(self, text):
        """A description of one line or of several."""
        return self._add("accDescr", text=text)

    def statement_count(self) -> int:
        return len(self.rows)

    def process(self, text):
        """Adds the statements of a diagram's text, or of a single one."""
        rows = parse(text if text.lstrip().startswith("sequenceDiagram") else f"sequenceDiagram\n{text}")
        for _, depth, *rest in rows:
            self._add(*rest, depth=len(self.open) + depth)
        return self

    def actor(self, name, alias=None):
        return self.participant(name, alias, "actor")

    def create_actor(self, name, alias=None):
        return self.create(name, alias, "actor")

    def autonumber_off(self):
        return self._add("autonumber", text="off")

    def block(self, kind, text, inner):
        """A loop, opt or rect block whose statements inner(builder) adds."""
        self.begin(kind, text)
        inner(self)
        return self.end()

    def participant(self, name, alias=None, kind="participant"):
        return self._add(kind, name, text=alias)

    def create(self, name, alias=None, kind="participant"):
        return self._add(f"create {kind}", name, text=alias)

    def destroy(self, name):
        return self._add("destroy", name)

    def activate(self, name):
        return self._add("activate", name)

    def deactivate(self, name):
        return self._add("deactivate", name)

    def autonumber(self, start=None, step=None):
        return self._add("autonumber", text=" ".join(str(x) for x in (start, step) if x is not None) or None)

    def signal(self, a, b, arrow="->>", text=None):
        mark = arrow[-1] if arrow[-1] in "+-" and arrow[:-1] else ""
        self._add("signal", a, b, arrow.removesuffix(mark) if mark else arrow, text)
        return self._add("activate" if mark == "+" else "deactivate", b if mark == "+" else a) if mark else self

    def note(self, where, who, text):
        return self._add("note", who, arrow=where, text=text)

    def begin(self, kind, text=None):
        self._add(kind, text=text)
        self.open.append(kind)
        return self

    def otherwise(self, text=None):
        return self._add({"alt": "else", "par": "and", "critical": "option"}[self.open[-1]], text=text, depth=len(self.open) - 1)

    def end(self):
        kind = self.open.pop()
        return self._add("end", kind)

    def build(self) -> str:
        if self.open:
            raise DiagramError("Syntax", f"{self.open[-1]} isn't ended")
        return write(self.rows)
