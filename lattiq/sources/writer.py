"""Solidity text from syntax trees, and small builders for generated sources."""

from __future__ import annotations

from .solidity import Node, Tree, parse

INDENT = "    "


def expression(tree: Tree, n: Node) -> str:
    """One line for an expression; brackets only where the source has them."""
    go = lambda x: expression(tree, x)
    k = n.kind
    if k in ("assignment_expression", "augmented_assignment_expression", "binary_expression"):
        return f"{go(n['left'])} {n['operator']} {go(n['right'])}"
    if k == "unary_expression":
        return f"{n['operator']}{' ' if n['operator'] == 'delete' else ''}{go(n['argument'])}"
    if k == "update_expression":
        return n["operator"] + go(n["argument"]) if n["argument"].start > n.start else go(n["argument"]) + n["operator"]
    if k == "ternary_expression":
        return f"{go(n['condition'])} ? {go(n['then'])} : {go(n['otherwise'])}"
    if k == "member_expression":
        return f"{go(n['object'])}.{go(n['property'])}"
    if k == "array_access":
        return f"{go(n['base'])}[{go(n['index']) if n['index'] is not None else ''}]"
    if k in ("call_expression", "type_cast_expression"):
        text = tree.text(n)
        if "({" in text:
            return " ".join(text.split())
        return f"{go(n['function'])}({', '.join(go(a['value']) for a in n['args'])})"
    if k == "tuple_expression" and ",," not in tree.text(n).replace(" ", ""):
        return f"({', '.join(map(go, n['items']))})"
    if k == "inline_array":
        return f"[{', '.join(map(go, n['items']))}]"
    if k == "new_expression":
        return f"new {tree.text(n['type'])}"
    return " ".join(tree.text(n).split())


def statement(tree: Tree, n: Node, level: int) -> list[str]:
    pad, ex = INDENT * level, lambda x: expression(tree, x)
    k = n.kind
    if k == "block":
        return [x for s in n["statements"] for x in statement(tree, s, level)]
    if k == "expression_statement":
        return [f"{pad}{ex(n['expression'])};"]
    if k == "variable_declaration_statement" and len(n["names"]) == 1 and not tree.text(n).startswith("("):
        value = f" = {ex(n['value'])}" if n["value"] is not None else ""
        return [f"{pad}{' '.join(tree.text(n['names'][0]).split())}{value};"]
    if k == "return":
        return [f"{pad}return{' ' + ex(n['value']) if n['value'] is not None else ''};"]
    if k in ("emit", "revert"):
        return [f"{pad}{k} {ex(n['name'])}({', '.join(ex(a['value']) for a in n['args'])});"]
    if k == "if":
        out = [f"{pad}if ({ex(n['condition'])}) {{", *statement(tree, n["then"], level + 1)]
        if n["otherwise"] is not None:
            out += [f"{pad}}} else {{", *statement(tree, n["otherwise"], level + 1)]
        return [*out, f"{pad}}}"]
    if k == "while":
        return [f"{pad}while ({ex(n['condition'])}) {{", *statement(tree, n["body"], level + 1), f"{pad}}}"]
    if k == "do":
        return [f"{pad}do {{", *statement(tree, n["body"], level + 1), f"{pad}}} while ({ex(n['condition'])});"]
    if k == "for":
        first = statement(tree, n["init"], 0)[0] if n["init"] is not None else ";"
        test = ex(n["condition"]) if n["condition"] is not None else ""
        step = ex(n["update"]) if n["update"] is not None else ""
        return [f"{pad}for ({first} {test}; {step}) {{", *statement(tree, n["body"], level + 1), f"{pad}}}"]
    return [pad + x.strip() for x in tree.text(n).split("\n")]


def _head(tree: Tree, m: Node) -> str:
    end = m["body"].start if m["body"] is not None else m.end
    return " ".join(tree.text((m.start, end)).split()).rstrip(";").rstrip()


def source(tree: Tree) -> str:
    """The whole file, four spaces a level; comments are left out."""
    out: list[str] = []
    for x in tree.root["items"]:
        if x.kind in ("contract", "interface", "library"):
            end = tree.source.index("{", x["bases"][-1].end if x["bases"] else x["name"].end)
            out.append(f"{' '.join(tree.text((x.start, end)).split())} {{")
            for m in x["members"]:
                out += _member(tree, m, 1)
            out.append("}")
        else:
            out += _member(tree, x, 0)
        out.append("")
    return "\n".join(out).rstrip() + "\n" if out else ""


def _member(tree: Tree, m: Node, level: int) -> list[str]:
    pad = INDENT * level
    if m.kind in ("function", "modifier", "constructor", "fallback"):
        if m["body"] is None:
            return [f"{pad}{_head(tree, m)};"]
        return [f"{pad}{_head(tree, m)} {{", *statement(tree, m["body"], level + 1), f"{pad}}}"]
    return [f"{pad}{' '.join(tree.text(m).split())}"]


def normalize(text: str) -> str:
    return source(parse(text))


class Contract:
    """Builds a contract's text part by part."""

    def __init__(self, name: str, bases: tuple[str, ...] = (), kind: str = "contract"):
        self.head = f"{kind} {name}{' is ' + ', '.join(bases) if bases else ''}"
        self.parts: list[list[str]] = []

    def line(self, text: str) -> Contract:
        self.parts.append([text.rstrip(";") + ";"])
        return self

    def variable(self, kind: str, name: str, visibility: str = "", value: str | None = None) -> Contract:
        return self.line(" ".join(x for x in (kind, visibility, name) if x) + (f" = {value}" if value is not None else ""))

    def event(self, name: str, *params: str) -> Contract:
        return self.line(f"event {name}({', '.join(params)})")

    def error(self, name: str, *params: str) -> Contract:
        return self.line(f"error {name}({', '.join(params)})")

    def struct(self, name: str, *fields: str) -> Contract:
        self.parts.append([f"struct {name} {{", *(f"{INDENT}{f};" for f in fields), "}"])
        return self

    def enum(self, name: str, *values: str) -> Contract:
        self.parts.append([f"enum {name} {{ {', '.join(values)} }}"])
        return self

    def block(self, head: str, *body: str) -> Contract:
        self.parts.append([f"{head} {{", *(INDENT + b for b in body), "}"])
        return self

    def function(self, name: str, params: tuple[str, ...] = (), *body: str, visibility: str = "public", mutability: str = "", returns: str = "") -> Contract:
        words = [f"function {name}({', '.join(params)})", visibility, mutability, f"returns ({returns})" if returns else ""]
        return self.block(" ".join(w for w in words if w), *body)

    def constructor(self, params: tuple[str, ...] = (), *body: str) -> Contract:
        return self.block(f"constructor({', '.join(params)})", *body)

    def modifier(self, name: str, params: tuple[str, ...] = (), *body: str) -> Contract:
        return self.block(f"modifier {name}({', '.join(params)})", *body)

    def build(self, pragma: str | None = "^0.8.0", imports: tuple[str, ...] = ()) -> str:
        top = [f"pragma solidity {pragma};", ""] if pragma else []
        top += [f'import "{i}";' for i in imports] + [""] * bool(imports)
        body = [INDENT + x for p in self.parts for x in p]
        return "\n".join([*top, self.head + " {", *body, "}"]) + "\n"


# types and expressions as text


def uint(bits: int = 256) -> str:
    return f"uint{bits}"


def integer(bits: int = 256) -> str:
    return f"int{bits}"


def fixed_bytes(size: int) -> str:
    return f"bytes{size}"


def array(element: str, size: str | int | None = None) -> str:
    return f"{element}[{'' if size is None else size}]"


def mapping(key: str, value: str) -> str:
    return f"mapping({key} => {value})"


def needs_location(kind: str) -> bool:
    """Whether a variable of a type must say where its data lie."""
    return kind in ("string", "bytes") or kind.endswith("]") or kind.startswith("mapping(")


def default_location(kind: str) -> str | None:
    return ("storage" if kind.startswith("mapping(") else "memory") if needs_location(kind) else None


def declared(kind: str, name: str) -> str:
    """A parameter or local variable of a type, with its location where one is needed."""
    return " ".join(x for x in (kind, default_location(kind), name) if x)


def string_literal(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def boolean(value: bool) -> str:
    return "true" if value else "false"


#: How tightly operators bind; higher is tighter.
_BINDS = {op: k for k, ops in enumerate((["||"], ["&&"], ["==", "!="], ["<", ">", "<=", ">="], ["|"], ["^"], ["&"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"], ["**"])) for op in ops}


def binary(left: str, operator: str, right: str) -> str:
    """left operator right; operands that bind less tightly get parentheses."""

    def operand(text: str, tight: bool) -> str:
        e = parse(f"contract C {{ uint x = {text}; }}").root
        top = next((n["operator"] for n in e.walk() if n.kind == "binary_expression"), None)
        whole = top is None or text.startswith("(") or _BINDS[top] > _BINDS[operator] or (_BINDS[top] == _BINDS[operator] and not tight)
        return text if whole else f"({text})"

    return f"{operand(left, False)} {operator} {operand(right, True)}"


def if_else(condition: str, then: tuple[str, ...], otherwise: tuple[str, ...] = ()) -> list[str]:
    """The lines of an if statement, with an else branch if there is one."""
    out = [f"if ({condition}) {{", *(INDENT + x for x in then), "}"]
    return [*out[:-1], "} else {", *(INDENT + x for x in otherwise), "}"] if otherwise else out
