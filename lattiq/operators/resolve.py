"""Name resolution as joins; a priority is data (a prio column), so Catalyst may order the joins freely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable

#: name, object type, return type, whether it changes state
BUILTINS = [
    *[(n, "any_array", r, m) for n, r, m in (("push", "void", True), ("pop", "void", True), ("length", "uint256", False))],
    *[("length", t, "uint256", False) for t in ("bytes", "string")],
    *[(n, "address", r, m) for n, r, m in (
        ("balance", "uint256", False), ("code", "bytes", False), ("codehash", "bytes32", False), ("transfer", "void", True), ("send", "bool", True),
        ("call", "(bool,bytes)", True), ("delegatecall", "(bool,bytes)", True), ("staticcall", "(bool,bytes)", False),
    )],
    ("selector", "function", "bytes4", False), ("address", "function", "address", False), ("concat", "string", "string", False),
]


def builtins(spark) -> DataFrame:
    """builtin, object_type, return_type, mutates, ord: the catalog, a constant of 16 rows."""
    return spark.createDataFrame([(*b, i) for i, b in enumerate(BUILTINS)], "builtin string, object_type string, return_type string, mutates boolean, builtin_ord int")


def builtin_matches(name: Column, object_type: Column) -> Column:
    """Whether a catalog row (builtin, object_type) is meant by a name on an object type; array wildcards included."""
    array = object_type.endswith("[]")
    kind = F.col("builtin_type")
    return (F.col("builtin") == name) & ((kind == object_type) | ((kind == "any_array") & (array | object_type.isin("bytes", "string"))) | (kind.isin("bytes", "string") & array))


def match_builtins(calls: DataFrame, key: str = "call_id") -> DataFrame:
    """calls(key, property, object_type) with the first catalog row that fits: builtin, return_type, mutates; others are dropped."""
    table = F.broadcast(builtins(calls.sparkSession).withColumnRenamed("object_type", "builtin_type"))
    found = calls.join(table, builtin_matches(F.col("property"), F.col("object_type")))
    return found.groupBy(key).agg(F.min_by(F.struct("builtin", "return_type", "mutates"), "builtin_ord").alias("b")).select(key, "b.*")


def prioritized(candidates: list[DataFrame], key: str, order: list[str] | None = None) -> DataFrame:
    """Of the candidate rows of each key, the one from the earliest frame (then by order); frames share their columns."""
    ranked = [c.withColumn("prio", F.lit(i)) for i, c in enumerate(candidates)]
    rows = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("prio", *(order or []))).alias("r")).select(key, "r.*")


def resolve_simple(calls: DataFrame, symbols: DataFrame, inherits: DataFrame) -> DataFrame:
    """call_id, target_id, prio of plain calls(call_id, name, scope).

    0: own contract; 1: direct bases in their order; 2: free function; 3: constructor of a contract of that name.
    symbols(contract, name, id) holds one row a key; inherits(child, parent, ord).  Unresolved calls have no row.
    """
    s = symbols.select(F.col("contract").alias("s_contract"), F.col("name").alias("s_name"), F.col("id").alias("target_id"))
    own = calls.join(s, (F.col("scope") == F.col("s_contract")) & (F.col("name") == F.col("s_name"))).select("call_id", "target_id", F.lit(0).alias("base_ord"))
    bases = calls.join(inherits, F.col("scope") == F.col("child")).join(s, (F.col("parent") == F.col("s_contract")) & (F.col("name") == F.col("s_name"))).select("call_id", "target_id", F.col("ord").cast("int").alias("base_ord"))
    free = calls.join(s.where("s_contract is null"), F.col("name") == F.col("s_name")).select("call_id", "target_id", F.lit(0).alias("base_ord"))
    ctor = calls.join(s.where("s_contract = s_name"), F.col("name") == F.col("s_name")).select("call_id", "target_id", F.lit(0).alias("base_ord"))
    return prioritized([own, bases, free, ctor], "call_id", ["base_ord", "target_id"]).select("call_id", "target_id", "prio")


def implementation_choice(calls: DataFrame, implements: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """call_id, iface, contract, outcome for calls(call_id, iface) on an interface.

    bound: a documented binding names the contract; single: exactly one contract implements the interface;
    ambiguous: several and no binding; abstract: none, or several with a binding that names no contract.
    implements(contract, iface); bindings(iface, contract).
    """
    counted = implements.groupBy("iface").agg(F.count_distinct("contract").alias("n"), F.min("contract").alias("only"))
    if bindings is None:
        bindings = implements.limit(0).select("iface", "contract")
    named = bindings.select("iface", F.col("contract").alias("bound"), F.lit(True).alias("has_key"))
    rows = calls.join(counted, "iface", "left").join(named, "iface", "left")
    outcome = (
        F.when(F.col("bound").isNotNull(), "bound")
        .when(F.col("n") == 1, "single")
        .when((F.col("n") > 1) & F.coalesce("has_key", F.lit(False)), "abstract")
        .when(F.col("n") > 1, "ambiguous")
        .otherwise("abstract")
    )
    contract = F.when(F.col("bound").isNotNull(), F.col("bound")).when(F.col("n") == 1, F.col("only"))
    return rows.select("call_id", "iface", contract.alias("contract"), outcome.alias("outcome"))


def resolve_using_for(calls: DataFrame, using_for: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, target_id, library of calls(call_id, scope, object_type, property) through using-for rows.

    using_for(contract, type, library).  The type itself (uint means uint256 too) goes before '*'; of the
    libraries that have the function, the first by name.
    """
    alias = F.when(F.col("object_type") == "uint", "uint256").when(F.col("object_type") == "uint256", "uint")
    wanted = calls.select("call_id", "scope", "property", F.posexplode(F.filter(F.array("object_type", alias, F.lit("*")), lambda t: t.isNotNull())).alias("k", "type"), "object_type")
    wanted = wanted.withColumn("wild", (F.col("type") == "*").cast("int"))
    rows = wanted.join(using_for.select(F.col("contract").alias("scope"), "type", "library").distinct(), ["scope", "type"])
    found = rows.join(symbols.select(F.col("contract").alias("library"), F.col("name").alias("property"), F.col("id").alias("target_id")), ["library", "property"])
    return found.groupBy("call_id").agg(F.min(F.struct("wild", "library", "target_id")).alias("r")).select("call_id", "r.target_id", "r.library")


def resolve_member(calls: DataFrame, symbols: DataFrame, implements: DataFrame, using_for: DataFrame, interfaces: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """call_id, target_kind, target_id, builtin, outcome of member calls(call_id, scope, object_type, property).

    The cascade: interface rules (an implementation's function, else the interface's own), a direct member, using-for,
    a builtin; else NotCallable.  interfaces(iface).  Ambiguous interface calls have kind Ambiguous and no target.
    """
    s = symbols.select(F.col("contract").alias("s_contract"), F.col("name").alias("property"), F.col("id").alias("target_id"))
    on_face = calls.join(interfaces.select(F.col("iface").alias("object_type")).distinct(), "object_type", "left_semi")
    choice = implementation_choice(on_face.select("call_id", F.col("object_type").alias("iface")), implements, bindings)
    face = on_face.join(choice, "call_id")
    to_impl = face.where("contract is not null").join(s, [F.col("contract") == F.col("s_contract"), face["property"] == s["property"]]).select("call_id", F.lit("Function").alias("target_kind"), "target_id", F.lit(None).cast("string").alias("builtin"), "outcome")
    unclear = face.where("outcome = 'ambiguous'").select("call_id", F.lit("Ambiguous").alias("target_kind"), F.lit(None).cast("bigint").alias("target_id"), F.lit(None).cast("string").alias("builtin"), "outcome")
    abstract = face.join(s, [face["object_type"] == s["s_contract"], face["property"] == s["property"]]).select("call_id", F.lit("InterfaceMethod").alias("target_kind"), "target_id", F.lit(None).cast("string").alias("builtin"), "outcome")
    none = F.lit(None).cast("string")
    direct = calls.join(s, [calls["object_type"] == s["s_contract"], calls["property"] == s["property"]]).select("call_id", F.lit("Function").alias("target_kind"), "target_id", none.alias("builtin"), none.alias("outcome"))
    library = resolve_using_for(calls, using_for, symbols).select("call_id", F.lit("Function").alias("target_kind"), "target_id", none.alias("builtin"), F.lit("using").alias("outcome"))
    known = match_builtins(calls).select("call_id", F.lit("BuiltIn").alias("target_kind"), F.lit(None).cast("bigint").alias("target_id"), "builtin", none.alias("outcome"))
    rest = calls.select("call_id", F.lit("NotCallable").alias("target_kind"), F.lit(None).cast("bigint").alias("target_id"), none.alias("builtin"), none.alias("outcome"))
    return prioritized([to_impl, unclear, abstract, direct, library, known, rest], "call_id", ["target_id"]).drop("prio")


def ancestors(inherits: DataFrame) -> DataFrame:
    """(child, ancestor, rank) over inherits(child, parent, ord): breadth-first, then reversed, so the farthest is 0 and the child itself last.

    The order of a breadth-first walk is that of (depth, path of parent places); the smallest of each ancestor is kept.
    """
    edges = durable(inherits.select("child", "parent", F.col("ord").cast("bigint").alias("ord")).distinct())
    names = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).distinct()
    known = frontier = durable(names.select(F.col("n").alias("child"), F.col("n").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path")))
    while True:
        step = frontier.alias("f").join(edges.alias("e"), F.col("f.ancestor") == F.col("e.child"))
        new = step.select("f.child", F.col("e.parent").alias("ancestor"), (F.col("f.depth") + 1).alias("depth"), F.concat("f.path", F.array("e.ord")).alias("path"))
        new = new.groupBy("child", "ancestor").agg(F.min(F.struct("depth", "path")).alias("m")).select("child", "ancestor", "m.depth", "m.path")
        frontier = durable(new.join(known, ["child", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        known = durable(known.unionByName(frontier))
    order = Window.partitionBy("child").orderBy(F.desc("depth"), F.desc("path"))
    return known.select("child", "ancestor", (F.row_number().over(order) - 1).alias("rank"))


def resolve_storage(refs: DataFrame, ancestor_ranks: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, var of refs(ref_id, scope, name): the first storage variable of that name along the ancestors.

    symbols(contract, name, id, node_type).  Because the farthest ancestor comes first, its declaration wins.
    """
    variables = symbols.where("node_type = 'StorageVariable'").select(F.col("contract").alias("ancestor"), "name", F.col("id").alias("var"))
    found = refs.join(ancestor_ranks.withColumnRenamed("child", "scope"), "scope").join(variables, ["ancestor", "name"])
    return found.groupBy("ref_id").agg(F.min_by("var", "rank").alias("var"))


def call_return_types(calls: DataFrame, nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """call_id, return_type of calls(call_id, target_id): the declared type; of a public variable its mapping's value type or its own type; void is none."""
    n = nodes.select(F.col("id").alias("target_id"), "contract_name", "name", "node_type", "visibility", "declared_return_type")
    m = mappings.select(F.col("contract").alias("contract_name"), "name", "value_type")
    rows = calls.join(n, "target_id").join(m, ["contract_name", "name"], "left")
    getter = F.when((F.col("node_type") == "StorageVariable") & (F.col("visibility") == "Public"), F.coalesce("value_type", "declared_return_type"))
    kind = F.when(F.col("node_type") == "StorageVariable", getter).otherwise(F.col("declared_return_type"))
    return rows.select("call_id", F.nullif(kind, F.lit("void")).alias("return_type"))


def mapping_value_type(text: Column) -> Column:
    """The final value type of a mapping's text: what follows the last top-level arrow, less closing brackets."""
    return F.when(text.rlike(r"^\s*mapping\s*\("), F.trim(F.regexp_replace(F.element_at(F.split(text, "=>"), -1), r"\)\s*$|(\)\s*)+$", "")))


def bindings_from_docs(bindings: DataFrame, entries: DataFrame) -> DataFrame:
    """key, contract_name, address, chain_id, notes: the registry after the documents' binds-to tags.

    entries(ord, item_kind, item_name, key, file_path).  Only contracts bind; a key that isn't there is added; the last contract of a
    key (by file, then place) wins over what was there.  notes gathers what was found, the last first, before what was there; other fields stay.
    """
    of = F.col("file_path") if "file_path" in entries.columns else F.lit("")
    found = entries.where("item_kind = 'Contract' and key is not null and key <> '' and item_name is not null").select("key", F.struct(of.alias("file"), "ord", F.col("item_name").alias("name")).alias("e"))
    bound = found.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list("e"))).alias("__found"), F.lit(True).alias("__bound"))  # contracts that claim one key
    old = bindings.withColumn("__known", F.lit(True))
    merged = old.join(bound, "key", "full_outer")
    said = F.transform("__found", lambda e: F.concat(F.lit("bound by "), e["name"], F.when(e["file"] != "", F.concat(F.lit(" in "), e["file"])).otherwise("")))
    new = F.when(F.col("__known").isNull(), F.concat(F.lit("first found on "), F.element_at("__found", -1)["name"]))
    kept = F.col("notes").cast("string") if "notes" in bindings.columns else F.lit(None).cast("string")
    notes = F.when(F.col("__bound").isNull(), kept).otherwise(F.concat_ws("; before: ", said, F.coalesce(kept, new)))
    rest = [c for c in bindings.columns if c not in ("key", "contract_name", "notes")]
    return merged.select("key", F.coalesce(F.get("__found", F.lit(0))["name"], F.col("contract_name")).alias("contract_name"), *rest, notes.alias("notes"))


def first_entry(wanted: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the first manifest entry (by ord) that has equal keys."""
    rest = [c for c in manifest.columns if c not in keys]
    first = manifest.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("m")).select(*keys, "m.*")
    return wanted.join(first, keys, "left")


def return_edges(edges: DataFrame, returns: DataFrame, definitions: DataFrame) -> DataFrame:
    """Return edges: one for each return statement of a callee and each call of it, with the call's sequence number.

    returns(callee, ord, span, value), definitions(callee, span, declared_return_type).
    """
    calls = edges.where("edge_type = 'Call'").select(F.col("source_node_id").alias("caller"), F.col("target_node_id").alias("callee"), "sequence_number", F.col("edge_id").alias("call_edge"))
    rows = returns.select("callee", "ord", F.col("span").alias("return_site_span"), F.col("value").alias("returned_value")).join(calls, "callee").join(definitions.select("callee", F.col("span").alias("call_site_span"), "declared_return_type"), "callee")
    return rows.select(F.col("callee").alias("source_node_id"), F.col("caller").alias("target_node_id"), F.lit("Return").alias("edge_type"), "call_site_span", "return_site_span", "sequence_number", "returned_value", "declared_return_type", "ord", "call_edge")


def contained(inner: DataFrame, outer: DataFrame, owner: str) -> DataFrame:
    """inner rows whose (start, end) lie in an outer row's of the same owner: an equi-join on the owner narrows the range test."""
    o = outer.select(F.col(owner).alias("__owner"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    return inner.join(o, (F.col(owner) == F.col("__owner")) & (F.col("__start") <= F.col("start")) & (F.col("__end") >= F.col("end")), "left_semi")
