"""Documentation comments: parsing, counting, and the rows of a source's comments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.solidity import Node, Tree

ITEMS = "array<struct<kind:string,name:string,comment:string>>"
_TAG = re.compile(r"@(title|author|notice|dev|param|return|inheritdoc|custom:[\w-]+)(?=\s|\Z)[ \t]*")
_ITEM_KINDS = {"contract": "Contract", "interface": "Interface", "library": "Library", "function": "Function", "modifier": "Modifier", "constructor": "Constructor", "struct": "Struct", "enum": "Enum", "event": "Event", "error_definition": "Error", "state_variable": "StateVariable", "using": "UsingDirective"}


def parse(text: str) -> list[dict]:
    """The items (kind, name, comment) of a /// or /** */ comment; other comments raise ValueError.

    A line without a tag continues the item before it, or is a Notice; an empty Notice is left out.
    """
    s = text.strip()
    if s.startswith("///") and not s.startswith("////"):
        lines = [re.sub(r"^\s*///(?!/)", "", x).strip() for x in s.split("\n")]
    elif s.startswith("/**") and not s.startswith("/***") and s.endswith("*/") and len(s) >= 5:
        lines = [re.sub(r"^\s*\*? ?", "", x, count=1).strip() for x in s[3:-2].split("\n")]
    else:
        raise ValueError(f"no documentation comment: {s[:20]!r}")
    out: list[dict] = []
    for line in lines:
        m = _TAG.match(line)
        if not m:
            if out and line and out[-1]["tagged"]:
                out[-1]["comment"] = f"{out[-1]['comment']} {line}".strip()
            elif line:
                out.append({"kind": "Notice", "name": None, "comment": line, "tagged": False})
            continue
        kind, rest = m[1], line[m.end() :].strip()
        name = None
        if kind in ("param", "inheritdoc"):
            name, _, rest = rest.partition(" ")
        elif kind.startswith("custom:"):
            kind, name = "custom", kind[7:]
        out.append({"kind": kind.capitalize(), "name": name, "comment": rest.strip(), "tagged": True})
    return [{k: x[k] for k in ("kind", "name", "comment")} for x in out if x["kind"] != "Notice" or x["comment"]]


def name_returns(items: list[dict], names: list[str | None]) -> list[dict]:
    """Return items with the names of the function's return parameters, where a comment starts with its name."""
    out, k = [], 0
    for x in items:
        if x["kind"] == "Return" and k < len(names):
            name, k = names[k], k + 1
            if name and x["comment"].split(" ", 1)[0] == name:
                x = x | {"name": name, "comment": x["comment"].partition(" ")[2].strip()}
        out.append(x)
    return out


def count(items, kind: str, name: str | None = None):
    """How many items of a kind (and name) an items column holds."""
    return F.size(F.filter(items, lambda i: (i["kind"] == kind) & (i["name"].eqNullSafe(F.lit(name)) if name is not None else F.lit(True))))


def count_unnamed_returns(items):
    return F.size(F.filter(items, lambda i: (i["kind"] == "Return") & i["name"].isNull()))


def count_returns(items):
    return count(items, "Return")


def is_empty(items):
    """Whether a documentation has no item; null has none."""
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def append(items, more):
    """The items of one documentation after those of another."""
    none = F.array().cast(ITEMS)
    return F.concat(F.coalesce(items, none), F.coalesce(more, none))


def extend_manifest(entries: DataFrame, more: DataFrame) -> DataFrame:
    """A manifest with further entries, which come after the others of their file."""
    last = entries.groupBy("file_path").agg(F.max("ord").alias("__last"))
    later = more.join(last, "file_path", "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    return entries.unionByName(later.select(*entries.columns))


def has(items, kind: str, name: str | None = None):
    return count(items, kind, name) > 0


def natspec_items(column):
    """The items of a comment column, or null where it isn't a documentation comment."""

    def items(text):
        try:
            return parse(text) if text is not None else None
        except ValueError:
            return None

    return F.udf(items, ITEMS, useArrow=True)(column)


def parse_natspec(rows: DataFrame, column: str) -> DataFrame:
    """One row for each item: the columns of rows, ord, kind, name, comment."""
    return rows.select(*rows.columns, F.posexplode(natspec_items(column)).alias("ord", "i")).select(*rows.columns, "ord", "i.kind", "i.name", "i.comment")


def comments(source: bytes) -> list[dict]:
    """Comments directly before an item, with the item's kind, name and span; positions are (byte, line, column)."""
    tree = Tree(source)
    text = tree.source
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())

    def place(at: int) -> dict:
        import bisect

        line = bisect.bisect_right(starts, at) - 1
        return {"utf8": at, "line": line, "column": at - starts[line]}

    before: dict[int, tuple[int, int]] = {}
    for a, b in tree.comments:
        rest = text[b:]
        gap = len(rest) - len(rest.lstrip())
        before[b + gap] = (a, b)
    out = []
    for x in tree.root.walk():
        kind = _ITEM_KINDS.get(x.kind)
        if kind is None or x.start not in before:
            continue
        a, b = before[x.start]
        raw = tree.text((a, b))
        name = tree.text(x) if x.kind == "using" else _name(tree, x)
        out.append({"text": raw, "raw_comment_span": {"start": place(a), "end": place(b)}, "item_kind": kind, "item_name": name, "item_span": {"start": place(x.start), "end": place(x.end)}, "is_natspec": raw.startswith(("///", "/**"))})
    return sorted(out, key=lambda c: c["raw_comment_span"]["start"]["utf8"])


def _name(tree: Tree, x: Node) -> str | None:
    return tree.text(x["name"]) if x["name"] is not None else None


_POINT = "struct<utf8:bigint,line:bigint,column:bigint>"
MANIFEST = f"file_path string, ord bigint, text string, raw_comment_span struct<start:{_POINT},end:{_POINT}>, item_kind string, item_name string, item_span struct<start:{_POINT},end:{_POINT}>, is_natspec boolean"


def manifest(sources: DataFrame) -> DataFrame:
    """The manifest of sources(path, content): one row for each comment that belongs to an item; ord counts within a file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"file_path": p, "ord": i, **c} for p, b in zip(pdf["path"], pdf["content"]) for i, c in enumerate(comments(bytes(b or b"")))]
            yield pd.DataFrame(rows, columns=["file_path", "ord", "text", "raw_comment_span", "item_kind", "item_name", "item_span", "is_natspec"])

    return sources.select("path", "content").mapInPandas(run, MANIFEST)


def manifest_query(entries: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    """Entries of a kind, and with a name that holds the pattern in any case."""
    found = entries.where(F.col("item_kind") == kind)
    return found if pattern is None else found.where(F.contains(F.lower("item_name"), F.lit(pattern.lower())))


def binding_entries(entries: DataFrame) -> DataFrame:
    """Entries that bind: file_path, ord, item_kind, item_name, key of documentation with a binds-to tag (the first of a block)."""
    tags = parse_natspec(entries.where("is_natspec").select("file_path", F.col("ord").alias("entry"), "item_kind", "item_name", "text"), "text").where("kind = 'Custom' and name = 'binds-to'")
    return tags.groupBy("file_path", "entry", "item_kind", "item_name").agg(F.min_by("comment", "ord").alias("key")).withColumnRenamed("entry", "ord").where("key <> ''")


def binding_skeleton(entries: DataFrame) -> DataFrame:
    """ord, key, text of a bindings file that names each key once, in the order of its first entry, whatever kind of item has it."""
    keys = binding_entries(entries).groupBy("key").agg(F.min(F.struct("file_path", "ord")).alias("first"))
    return keys.select("first.file_path", "first.ord", "key", F.concat(F.lit("  - key: "), "key", F.lit("\n    contract_name: null\n    address: null\n    chain_id: null\n    notes: null")).alias("text")).orderBy("file_path", "ord")
