"""Graph exports: DOT, JSON and Markdown as ordered rows of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_dot
from ..operators.graph import connected_nodes, graph_metadata, qualified
from ..schema import CodeGraph

FILL = dict(
    zip(
        "Function Constructor Modifier Library Interface StorageVariable Evm EventListener RequireCondition IfStatement ThenBlock ElseBlock WhileStatement WhileBlock ForCondition ForBlock".split(),
        "lightblue lightgoldenrodyellow lightcoral lightgrey lightpink khaki gray lightcyan orange mediumpurple1 palegreen lightsalmon lightsteelblue lightseagreen darkseagreen1 darkolivegreen1".split(),
    )
)
#: edge type -> colour, style
STROKE = {"StorageRead": ("darkgreen", "dotted"), "StorageWrite": ("darkred", "bold"), "Require": ("orange", "dashed"), "IfConditionBranch": ("mediumpurple4", None), "ThenBranch": ("green4", None), "ElseBranch": ("salmon4", None), "ForConditionBranch": ("olivedrab", None), "ForBodyBranch": ("olivedrab", None)}
_HEAD = {"graph": {"rankdir": "LR", "fontname": '"Arial"', "splines": "true"}, "node": {"shape": "box", "style": '"rounded,filled"', "fontname": '"Arial"'}, "edge": {"fontname": '"Arial"'}}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def span_text(span: Column) -> Column:
    return F.concat(F.lit("("), span["start"], F.lit(", "), span["end"], F.lit(")"))


def node_attributes(nodes: DataFrame) -> list[tuple[str, Column]]:
    """The default attributes of a node, in order."""
    kind = F.col("node_type")
    label = F.concat(qualified(F.col("contract_name"), F.col("name")), F.lit("\n("), F.lower(kind), F.lit(")"))
    tip = F.concat(F.lit("Type: "), kind, F.lit("\\nVisibility: "), F.col("visibility"), F.lit("\\nSpan: "), span_text(F.col("span")))
    return [("label", escape_dot(label)), ("tooltip", escape_dot(tip)), ("fillcolor", _lookup(FILL, kind))]


def edge_attributes(edges: DataFrame) -> list[tuple[str, Column]]:
    """The default attributes of an edge, in order; null ones are left out.  While edges have none."""
    kind, span, seq = F.col("edge_type"), span_text(F.col("call_site_span")), F.col("sequence_number")
    args = F.coalesce(F.array_join(F.transform("argument_names", escape_dot), ", "), F.lit(""))
    first = escape_dot(F.get("argument_names", F.lit(0)))
    event = F.col("event_name")
    call, back = kind == "Call", kind == "Return"
    label = (
        F.when(call & event.isNotNull(), escape_dot(F.concat(F.lit("emit "), escape_dot(event), F.lit("("), args, F.lit(")\nSeq: "), seq)))
        .when(call, escape_dot(F.concat(F.lit("("), args, F.lit(")\n"), seq)))
        .when(back, F.concat(F.lit("ret"), F.coalesce(F.concat(F.lit(" "), escape_dot(F.col("returned_value"))), F.lit(""))))
        .when(kind == "StorageRead", "read")
        .when(kind == "StorageWrite", "write")
        .when(kind == "Require", escape_dot(F.concat(F.lit("require("), args, F.lit(")"))))
        .when(kind == "IfConditionBranch", F.concat(F.lit("if ("), F.coalesce(first, F.lit("condition")), F.lit(")")))
        .when(kind == "ThenBranch", "then")
        .when(kind == "ElseBranch", "else")
        .when(kind == "ForConditionBranch", F.coalesce(first, F.lit("for_cond")))
        .when(kind == "ForBodyBranch", "for_body")
    )
    tip = (
        F.when(call, F.concat(F.lit("Call Site Span: "), span, F.coalesce(F.concat(F.lit("\\nEvent: "), escape_dot(event)), F.lit("")), F.lit("\\nSequence: "), seq))
        .when(back, F.concat(F.lit("Return from function defined at "), span, F.lit("\\nReturn Statement Span: "), F.coalesce(span_text(F.col("return_site_span")), F.lit("(0, 0)")), F.lit("\\nSequence: "), seq))
        .when(kind == "StorageRead", F.concat(F.lit("Read Span: "), span))
        .when(kind == "StorageWrite", F.concat(F.lit("Write Span: "), span))
        .when(kind == "Require", F.concat(F.lit("Require Check Span: "), span))
        .when(kind == "IfConditionBranch", F.concat(F.lit("If Condition: "), F.coalesce(first, F.lit("condition")), F.lit("\\nSpan: "), span))
        .when(kind == "ThenBranch", F.concat(F.lit("Then branch taken\\nSpan: "), span))
        .when(kind == "ElseBranch", F.concat(F.lit("Else branch taken\\nSpan: "), span))
    )
    tip = F.concat(escape_dot(tip), F.when(back & F.col("returned_value").isNotNull(), F.concat(F.lit("\\nReturns: "), escape_dot(F.col("returned_value")))).otherwise(""))
    colour = F.when(call & event.isNotNull(), "blue").when(back, "grey").otherwise(_lookup({k: c for k, (c, _) in STROKE.items()}, kind))
    style = F.when(back, "dashed").otherwise(_lookup({k: s for k, (_, s) in STROKE.items() if s}, kind))
    return [("label", label), ("tooltip", tip), ("color", colour), ("fontcolor", F.when(~back, colour)), ("style", style), ("arrowhead", F.when(back, "empty"))]


def _bracket(attributes: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in attributes]), F.lit("];"))


def to_dot(graph: CodeGraph, name: str, **more) -> DataFrame:
    """(section, ord, line) of a DOT file; the file is the lines in that order.  For the rest see dot_lines."""
    return dot_lines(graph, name, **more).orderBy("section", "ord")


def dot_lines(graph: CodeGraph, name: str, exclude_isolated: bool = False, node_attrs: Callable = node_attributes, edge_attrs: Callable = edge_attributes) -> DataFrame:
    """The lines of to_dot in no order, made in one pass.

    node_attrs and edge_attrs take the table and give (attribute, column) pairs, so callers may format as they like.
    """
    nodes = connected_nodes(graph.nodes, graph.edges) if exclude_isolated else graph.nodes
    spark = nodes.sparkSession
    head = [f'digraph "{name}" {{', *[f"    {k} [{', '.join(f'{a}={b}' for a, b in v.items())}];" for k, v in _HEAD.items()], ""]
    fixed = [(0, i, s) for i, s in enumerate(head)] + [(2, 0, ""), (4, 0, "}")]
    rows = spark.createDataFrame(fixed, "section int, ord bigint, line string")
    drawn = nodes.select(F.lit(1).alias("section"), F.col("id").alias("ord"), F.concat(F.lit("    n"), "id", F.lit(" "), _bracket(node_attrs(nodes))).alias("line"))
    lines = graph.edges.select(F.lit(3).alias("section"), F.col("edge_id").alias("ord"), F.concat(F.lit("    n"), "source_node_id", F.lit(" -> n"), "target_node_id", F.lit(" "), _bracket(edge_attrs(graph.edges))).alias("line"))
    return rows.unionByName(drawn).unionByName(lines)


def to_json_rows(graph: CodeGraph, exclude_isolated: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, metadata), each a row of JSON text (nulls kept) by ord; metadata is one row."""
    nodes = connected_nodes(graph.nodes, graph.edges) if exclude_isolated else graph.nodes
    keep = {"ignoreNullFields": "false"}
    n = nodes.select(F.col("id").alias("ord"), F.to_json(F.struct(*[c for c in nodes.columns if c != "project"]), keep).alias("json"))
    e = graph.edges.select(F.col("edge_id").alias("ord"), F.to_json(F.struct(*[c for c in graph.edges.columns if c not in ("edge_id", "project")]), keep).alias("json"))
    return n.orderBy("ord"), e.orderBy("ord"), graph_metadata(graph.nodes, graph.edges, exclude_isolated).select(F.to_json(F.struct("*")).alias("json"))


def json_document(graph: CodeGraph, name: str, pretty: bool = True, include_metadata: bool = True, exclude_isolated: bool = False) -> str:
    """One project's graph as a JSON text.  For a graph that fits on the driver; larger ones are written by to_json_rows."""
    import json

    n, e, m = to_json_rows(graph, exclude_isolated)
    doc = {"name": name, "nodes": [json.loads(r.json) for r in n.collect()], "edges": [json.loads(r.json) for r in e.collect()]}
    if include_metadata:
        doc["metadata"] = json.loads(m.first().json)
    return json.dumps(doc, indent=2 if pretty else None, ensure_ascii=False)


def markdown_table(rows: DataFrame, titles: dict[str, str], order: list[str]) -> DataFrame:
    """(ord, line) of a pipe table of string columns, sorted by order."""
    from ..operators.sequence import allocate_ids

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")) for c in titles]), F.lit(" |"))
    body = allocate_ids(rows.select(*order, cells.alias("line")), order, "ord").select((F.col("ord") + 2).alias("ord"), "line")
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(titles.values()) + " |"), (1, "|" + "|".join("---" for _ in titles) + "|")], "ord bigint, line string")
    return head.unionByName(body).orderBy("ord")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes ordered lines as text; the order of the part files is the order of the lines."""
    lines.select("line").write.mode("overwrite").text(path)
