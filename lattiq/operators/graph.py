"""Graph queries over nodes and edges tables, whatever they were derived from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable, spread
from ..schema import BRANCHES, FUNCTION_LIKE, edge_type_ord

#: Edges that may be sent to every executor, at 16 or 24 bytes each; beyond it closures are rounds of joins.
BROADCAST_EDGES = 1 << 19
#: The same where only totals are asked for: 64 MB.
TOTAL_EDGES = 1 << 22
#: Rows that a task of a large join takes; fixed, so that a task's memory doesn't grow with the input.
TASK_ROWS = 1 << 18


def scoped_by_project(df: DataFrame) -> DataFrame:
    """df with a project column, empty where it has none: names are known inside one project only."""
    return df.withColumn("project", F.coalesce("project", F.lit("")) if "project" in df.columns else F.lit(""))


def entry_points(nodes: DataFrame, scoped: bool = True) -> DataFrame:
    """Public or External functions that no interface of their project declares.

    scoped: an interface counts only if it is its own scope (storage analysis); else by its name alone (diagrams).
    """
    own = scoped_by_project(nodes)
    faces = own.where("node_type = 'Interface'" + (" and name = contract_name" if scoped else "")).select(F.col("name").alias("__iface"), F.col("project").alias("__project")).distinct()
    found = own.where("node_type = 'Function' and visibility in ('Public', 'External')")
    return found.join(faces, (F.col("contract_name") == F.col("__iface")) & (F.col("project") == F.col("__project")), "left_anti").select(*nodes.columns)


class _Steps:
    """A bounded edge list by source: nodes are numbered, a node's edges follow each other in order."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, ord_: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((b, a) if ord_ is None else (b, ord_, a))
        self.dst, self.ord = b[order], None if ord_ is None else ord_[order]
        self.start = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def number(self, nodes: np.ndarray) -> np.ndarray:
        """The numbers of nodes, -1 for those without edges."""
        if not len(self.ids):
            return np.full(len(nodes), -1)
        k = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[k] == nodes, k, -1)

    def reach(self, seed: int | list[int], stamp: np.ndarray, mark: int) -> np.ndarray:
        """All that is reachable from a node (or distinct nodes), itself included; stamp holds the marks of the walks before."""
        stamp[seed] = mark
        parts = [now := np.atleast_1d(np.array(seed, np.int64))]
        while len(now):
            lo, n = self.start[now], self.start[now + 1] - self.start[now]
            ends = np.cumsum(n)
            found = self.dst[np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)]
            now = np.unique(found[stamp[found] != mark])
            stamp[now] = mark
            parts.append(now)
        return np.concatenate(parts)

    def components(self) -> np.ndarray:
        """The number of each node's strongly connected component."""
        start, dst, n = self.start.tolist(), self.dst.tolist(), len(self.ids)
        out, index, low, held, count, found = [-1] * n, [-1] * n, [0] * n, [], 0, 0
        for root in range(n):
            if index[root] >= 0:
                continue
            todo = [(root, start[root])]
            while todo:
                x, at = todo.pop()
                if index[x] < 0:
                    index[x] = low[x] = count
                    count += 1
                    held.append(x)
                while at < start[x + 1]:
                    y = dst[at]
                    if index[y] < 0:
                        todo += [(x, at), (y, start[y])]  # x looks at y again when y is done
                        break
                    if out[y] < 0:
                        low[x] = min(low[x], low[y])
                    at += 1
                else:
                    if low[x] == index[x]:
                        while True:
                            y = held.pop()
                            out[y] = found
                            if y == x:
                                break
                        found += 1
        return np.array(out, np.int64)

    def preorder(self, seed: int) -> Iterator[tuple[int, list[int]]]:
        """(node, ordinals of the edges to it) in the order of a depth-first walk."""
        seen, path = {seed}, []
        yield seed, []
        todo = [(int(self.start[seed]), int(self.start[seed + 1]))]
        while todo:
            at, end = todo[-1]
            if at == end:
                todo.pop()
                if path:
                    path.pop()
                continue
            todo[-1] = (at + 1, end)
            node = int(self.dst[at])
            if node not in seen:
                seen.add(node)
                path.append(int(self.ord[at]))
                yield node, list(path)
                todo.append((int(self.start[node]), int(self.start[node + 1])))


def _bounded(edges: DataFrame, limit: int) -> pa.Table | None:
    """The rows of edges if there are no more than limit of them."""
    rows = edges.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def _walker(steps: _Steps, ordered: bool):
    """mapInArrow function over seeds(entry, node)."""

    def run(batches):
        stamp, mark = np.zeros(len(steps.ids), np.int64), 0
        for b in batches:
            entries, nodes = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "node"))
            numbers = steps.number(nodes).tolist()
            out_entry, out_node, paths, held = [], [], [], 0
            for entry, node, k in zip(entries.tolist(), nodes.tolist(), numbers):
                if ordered:
                    walk = [(node, [])] if k < 0 else [(int(steps.ids[x]), path) for x, path in steps.preorder(k)]
                    found = np.array([x for x, _ in walk], np.int64)
                    paths += [path for _, path in walk]
                else:
                    mark += 1
                    found = np.array([node]) if k < 0 else steps.ids[steps.reach(k, stamp, mark)]
                out_entry.append(np.full(len(found), entry))
                out_node.append(found)
                held += len(found)
                if held >= 1 << 18:
                    yield _walked(out_entry, out_node, paths if ordered else None)
                    out_entry, out_node, paths, held = [], [], [], 0
            if held:
                yield _walked(out_entry, out_node, paths if ordered else None)

    return run


def _walked(entries: list, nodes: list, paths: list | None) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(entries)), pa.array(np.concatenate(nodes))] + ([] if paths is None else [pa.array(paths, pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays(columns, ["entry", "node", "path"][: len(columns)])


def closure(edges: DataFrame, seeds: DataFrame, limit: int = BROADCAST_EDGES) -> DataFrame:
    """(entry, node) reachable over edges(src, dst) from seeds(entry, node), the seeds included.

    A graph of at most ``limit`` edges is sent to every executor and walked from each seed there.  A larger one
    takes a frontier loop: each round joins only what the last one found, keeps what no round before has found,
    and writes that alone.  Rounds are as many as the longest shortest path.
    """
    steps = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src is not null and dst is not null").distinct()
    start = seeds.select(F.col("entry").cast("bigint").alias("entry"), F.col("node").cast("bigint").alias("node")).distinct()
    if (small := _bounded(steps, limit)) is not None:
        held = _Steps(small.column("src").to_numpy(), small.column("dst").to_numpy())
        return start.mapInArrow(_walker(held, False), "entry bigint, node bigint").distinct()
    steps = durable(steps)
    reach = frontier = durable(start)
    while True:
        found = frontier.join(steps, frontier["node"] == steps["src"]).select("entry", F.col("dst").alias("node")).distinct()
        frontier = durable(found.join(reach, ["entry", "node"], "left_anti"))
        if frontier.isEmpty():
            return reach
        reach = reach.unionByName(frontier)


def closure_totals(edges: DataFrame, seeds: DataFrame, limit: int = TOTAL_EDGES) -> DataFrame:
    """entry, n_reached, node_sum: how many nodes closure() gives an entry, and the sum of their ids.

    Of a graph of at most ``limit`` edges no pair is made: nodes of one strongly connected component reach the same,
    so a task walks once for each component that its entries begin in.  Totals of a larger graph are counted over the pairs.
    """
    steps = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src is not null and dst is not null").distinct()
    start = seeds.select(F.col("entry").cast("bigint").alias("entry"), F.col("node").cast("bigint").alias("node")).distinct()
    small = _bounded(steps, limit)
    if small is None:
        return closure(edges, seeds).groupBy("entry").agg(F.count("*").alias("n_reached"), F.sum("node").alias("node_sum"))
    held = _Steps(small.column("src").to_numpy(), small.column("dst").to_numpy())
    component = held.components()

    def run(batches):
        stamp, mark, known = np.zeros(len(held.ids), np.int64), 0, {}
        for b in batches:
            rows = []
            for entry, nodes in zip(b.column("entry").to_pylist(), b.column("nodes").to_pylist()):
                numbers = held.number(np.array(nodes, np.int64)).tolist()
                lone = [x for x, k in zip(nodes, numbers) if k < 0]
                inside = [k for k in numbers if k >= 0]
                key = tuple(sorted({int(component[k]) for k in inside}))
                if key not in known:
                    mark += 1
                    found = held.ids[held.reach(inside, stamp, mark)] if inside else held.ids[:0]
                    known[key] = len(found), int(found.sum())
                n, total = known[key]
                rows.append((entry, n + len(lone), total + sum(lone)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, ["entry", "n_reached", "node_sum"])

    starts = start.groupBy("entry").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return spread(starts, "entry").mapInArrow(run, "entry bigint, n_reached bigint, node_sum bigint")


def call_steps(edges: DataFrame, follow_control_flow: bool = False) -> DataFrame:
    """(src, dst) that reachability follows: calls, and branches if asked."""
    kinds = ["Call", *(BRANCHES if follow_control_flow else [])]
    return edges.where(F.col("edge_type").isin(kinds)).select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))


def reachability(nodes: DataFrame, edges: DataFrame, follow_control_flow: bool = False) -> DataFrame:
    """(entry, node) for every entry point, the entry itself included."""
    seeds = entry_points(nodes).select(F.col("id").alias("entry"), F.col("id").alias("node"))
    return closure(call_steps(edges, follow_control_flow), seeds)


def reach_agg(nodes: DataFrame, edges: DataFrame, node_filter: Column, aggs: list[Column], follow_control_flow: bool = False) -> DataFrame:
    """A fold over the nodes that each entry point reaches: any Spark aggregates of the nodes' columns."""
    pairs = reachability(nodes, edges, follow_control_flow)
    joined = pairs.join(nodes.where(node_filter), pairs["node"] == nodes["id"])
    return pairs.select("entry").distinct().join(joined.groupBy("entry").agg(*aggs), "entry", "left")


def ordered_closure(edges: DataFrame, seeds: DataFrame, limit: int = BROADCAST_EDGES) -> DataFrame:
    """(entry, node, path): depth-first pre-order is the order of path.

    edges(src, dst, ord).  A node's path is the smallest sequence of edge ordinals of a simple path to it; the
    depth-first tree consists of those, and a prefix of one is one itself, so only the minimum of each node is
    kept between rounds, and only labels that changed in a round go on.  A graph of at most ``limit`` edges is
    sent to every executor and walked there.
    """
    steps = edges.select(*[F.col(c).cast("bigint").alias(c) for c in ("src", "dst", "ord")]).where("src is not null and dst is not null")
    start = seeds.select(F.col("entry").cast("bigint").alias("entry"), F.col("node").cast("bigint").alias("node")).distinct()
    if (small := _bounded(steps, limit)) is not None:
        held = _Steps(*(small.column(c).to_numpy() for c in ("src", "dst", "ord")))
        return start.mapInArrow(_walker(held, True), "entry bigint, node bigint, path array<bigint>").groupBy("entry", "node").agg(F.min("path").alias("path"))
    steps = durable(steps)
    empty = F.array().cast("array<bigint>")
    best = lambda t: t.groupBy("entry", "node").agg(F.min(F.struct("path", "seen")).alias("l")).select("entry", "node", "l.path", "l.seen")
    labels = changed = durable(start.select("entry", "node", empty.alias("path"), F.array(F.col("node")).alias("seen")))
    while True:
        longer = (
            changed.join(steps, changed["node"] == steps["src"])
            .where(~F.array_contains("seen", F.col("dst")))
            .select("entry", F.col("dst").alias("node"), F.concat("path", F.array("ord")).alias("path"), F.concat("seen", F.array("dst")).alias("seen"))
        )
        old = best(labels).select("entry", "node", F.col("path").alias("old"))
        changed = durable(best(longer).join(old, ["entry", "node"], "left").where("old is null or path < old").drop("old"))
        if changed.isEmpty():
            return best(labels).select("entry", "node", "path")
        labels = labels.unionByName(changed)


def _tasks(edges: DataFrame) -> int:
    """How many tasks joins with the edges of a graph are cut into; 0 for a few, which Spark may choose."""
    n = edges.count() // TASK_ROWS + 1
    return n if n > 8 else 0


def _cut(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.repartition(n, key) if n else df


def storage_access(nodes: DataFrame, edges: DataFrame, follow_control_flow: bool = False, tasks: int | None = None) -> DataFrame:
    """(entry, var, edge_type) of the storage variables that an entry point's reachable functions touch, distinct."""
    pairs = reachability(nodes, edges, follow_control_flow)
    owners = FUNCTION_LIKE + (["ThenBlock", "ElseBlock", "WhileBlock", "ForBlock", "IfStatement", "WhileStatement", "ForCondition"] if follow_control_flow else [])
    sources = nodes.where(F.col("node_type").isin(owners)).select(F.col("id").alias("node"))
    variables = nodes.where("node_type = 'StorageVariable'").select(F.col("id").alias("var"))
    touch = edges.where("edge_type in ('StorageRead', 'StorageWrite')").select(F.col("source_node_id").alias("node"), F.col("target_node_id").alias("var"), "edge_type")
    n = _tasks(edges) if tasks is None else tasks
    touch = _cut(_cut(touch, n, "var").join(variables, "var", "left_semi"), n, "node").join(_cut(sources, n, "node"), "node", "left_semi").distinct()
    return _cut(_cut(pairs, n, "node").join(touch, "node").select("entry", "var", "edge_type"), n, "entry").distinct()


def storage_summary(nodes: DataFrame, edges: DataFrame, follow_control_flow: bool = False) -> DataFrame:
    """entry, reads, writes (sorted arrays of variable ids) for every entry point."""
    access = storage_access(nodes, edges, follow_control_flow)
    sets = [F.array_sort(F.collect_set(F.when(F.col("edge_type") == t, F.col("var")))).alias(n) for t, n in (("StorageRead", "reads"), ("StorageWrite", "writes"))]
    entries = entry_points(nodes).select(F.col("id").alias("entry"))
    none = F.array().cast("array<bigint>")
    return entries.join(access.groupBy("entry").agg(*sets), "entry", "left").select("entry", F.coalesce("reads", none).alias("reads"), F.coalesce("writes", none).alias("writes"))


def qualified(contract: Column, name: Column) -> Column:
    """Contract.name, or the name where there is no contract."""
    return F.when(contract.isNull(), name).otherwise(F.concat(contract, F.lit("."), name))


def storage_report(nodes: DataFrame, edges: DataFrame, follow_control_flow: bool = False) -> DataFrame:
    """entry, endpoint, reads, writes as text, in no order; variables sorted and joined by commas, empty where none."""
    n = _tasks(edges)
    access = storage_access(nodes, edges, follow_control_flow, n)
    label = nodes.select(F.col("id"), qualified(F.col("contract_name"), F.col("name")).alias("label"))
    named = _cut(_cut(access, n, "var").join(label.select(F.col("id").alias("var"), F.col("label").alias("variable")), "var"), n, "entry")
    text = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("edge_type") == t, F.col("variable")))), ", ").alias(n) for t, n in (("StorageRead", "reads"), ("StorageWrite", "writes"))]
    entries = entry_points(nodes).select(F.col("id").alias("entry"), qualified(F.col("contract_name"), F.col("name")).alias("endpoint"))
    out = entries.join(named.groupBy("entry").agg(*text), "entry", "left")
    return out.select("entry", "endpoint", *[F.coalesce(n, F.lit("")).alias(n) for n in ("reads", "writes")])


def find_function(nodes: DataFrame, qualified_name: str, project: str | None = None) -> DataFrame:
    """The first Function node of Contract.function (exactly two parts), in a project if one is named, or no row."""
    parts = qualified_name.split(".")
    if len(parts) != 2:
        raise ValueError(f"expected Contract.function, got {qualified_name!r}")
    if project is not None:
        nodes = nodes.where(F.col("project") == project)
    return nodes.where((F.col("node_type") == "Function") & (F.col("contract_name") == parts[0]) & (F.col("name") == parts[1])).orderBy("id").limit(1)


def ordered_trace(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """entry, ord, function_id, var, edge_type, edge_id: storage accesses in the order of a depth-first walk of calls.

    Functions come in pre-order; inside one, accesses are sorted by the start of its first edge with the same
    variable and type, then by edge, its type and its variable (ids of edges needn't be unique).
    """
    calls = edges.where("edge_type = 'Call'").select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), F.col("edge_id").alias("ord"))
    walk = ordered_closure(calls, seeds)
    functions = nodes.where(F.col("node_type").isin(FUNCTION_LIKE)).select(F.col("id").alias("node"))
    touch = edges.where("edge_type in ('StorageRead', 'StorageWrite')").select(F.col("source_node_id").alias("node"), F.col("target_node_id").alias("var"), "edge_type", "edge_id", F.col("call_site_span.start").alias("at"))
    same = Window.partitionBy("node", "var", "edge_type").orderBy("edge_id")
    touch = touch.withColumn("first_at", F.first("at").over(same)).join(functions, "node", "left_semi")
    order = Window.partitionBy("entry").orderBy("path", F.col("first_at").asc_nulls_first(), "edge_id", "edge_type", "var")
    return walk.join(touch, "node").withColumn("ord", F.row_number().over(order)).select("entry", "ord", F.col("node").alias("function_id"), "var", "edge_type", "edge_id")


def compare_traces(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """variable, ops_1, ops_2 of two traces(variable, ord, op), in no order: a full outer join; operations in order, '-' where none."""
    keys = [*(keys or []), "variable"]
    side = lambda t, n: t.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "op"))), lambda x: x["op"]), ", ").alias(n))
    return side(a, "ops_1").join(side(b, "ops_2"), keys, "full_outer").select(*keys, F.coalesce("ops_1", F.lit("-")).alias("ops_1"), F.coalesce("ops_2", F.lit("-")).alias("ops_2"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end of any edge."""
    return edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_semi")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_anti")


def graph_metadata(nodes: DataFrame, edges: DataFrame, exclude_isolated: bool = False) -> DataFrame:
    """One row: node_count (after filtering), edge_count, isolated_count (0 when filtered)."""
    kept = connected_nodes(nodes, edges) if exclude_isolated else nodes
    lone = nodes.limit(0) if exclude_isolated else isolated_nodes(nodes, edges)
    return kept.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(lone.agg(F.count("*").alias("isolated_count")))  # one row each


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def edge_totals(edges: DataFrame) -> DataFrame:
    """One row: total, calls, returns."""
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("edge_type") == "Call").alias("calls"), F.count_if(F.col("edge_type") == "Return").alias("returns"))


def contract_rollup(nodes: DataFrame) -> DataFrame:
    """project, contract, has_constructor, constructor_parameters (of the last), functions (in node order; none for interfaces)."""
    nodes = scoped_by_project(nodes)
    faces = nodes.where("node_type = 'Interface'").select("project", F.col("name").alias("contract_name")).distinct().withColumn("__face", F.lit(True))
    rows = nodes.where("contract_name is not null").join(faces, ["project", "contract_name"], "left")
    is_ctor = F.col("node_type") == "Constructor"
    functions = F.when((F.col("node_type") == "Function") & F.col("__face").isNull(), F.struct("id", "name", "parameters", F.lit("public").alias("visibility"), "declared_return_type"))
    return rows.groupBy("project", F.col("contract_name").alias("contract")).agg(
        F.bool_or(is_ctor).alias("has_constructor"),
        F.max_by(F.when(is_ctor, F.col("parameters")), F.when(is_ctor, F.col("id"))).alias("constructor_parameters"),
        F.array_sort(F.collect_list(functions)).alias("functions"),
    )


def require_edges_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, function_id, contract_name, function_name, edge_index (from 0), condition_id, condition_expression, revert_message.

    A function is the first node of its (project, contract, name).
    """
    nodes = scoped_by_project(nodes)
    first = nodes.where("node_type = 'Function'").groupBy("project", "contract_name", F.col("name").alias("function_name")).agg(F.min("id").alias("function_id"))
    needs = edges.where("edge_type = 'Require'").select(F.col("source_node_id").alias("function_id"), F.col("target_node_id").alias("condition_id"), "edge_id")
    place = Window.partitionBy("function_id").orderBy("edge_id", "condition_id")
    conditions = nodes.where("node_type = 'RequireCondition'").select(F.col("id").alias("condition_id"), "condition_expression", "revert_message")
    return first.join(needs.withColumn("edge_index", F.row_number().over(place) - 1), "function_id").join(conditions, "condition_id").select("project", "function_id", "contract_name", "function_name", "edge_index", "condition_id", "condition_expression", "revert_message")


ACCESS_WORDS = ["msg.sender", "owner", "admin", "role", "authorized", "permission"]


def is_access_control(condition: Column) -> Column:
    """Whether a condition's text speaks of who may call."""
    return F.lower(condition).rlike("|".join(w.replace(".", r"\.") for w in ACCESS_WORDS))


def needs_prank(condition: Column) -> Column:
    """Whether a condition compares the caller with a privileged account."""
    low = F.lower(condition)
    return low.rlike("sender|caller") & low.rlike("owner|admin|role")


def writes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, function_id, contract_name, function_name, var, variable, write_index: one row for each write edge, repeats kept."""
    nodes = scoped_by_project(nodes)
    functions = nodes.where("node_type = 'Function'").select("project", F.col("id").alias("function_id"), "contract_name", F.col("name").alias("function_name"))
    variables = nodes.where("node_type = 'StorageVariable'").select(F.col("id").alias("var"), F.col("name").alias("variable"), F.col("visibility").alias("variable_visibility"))
    writes = edges.where("edge_type = 'StorageWrite'").select(F.col("source_node_id").alias("function_id"), F.col("target_node_id").alias("var"), "edge_id")
    place = Window.partitionBy("function_id").orderBy("edge_id", "var")
    return writes.withColumn("write_index", F.row_number().over(place) - 1).join(functions, "function_id").join(variables, "var")


def source_path_map(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """project, contract, path: the file that the manifest names for the contract, else the contract's name plus .sol.

    A manifest without projects holds for all of them.
    """
    by = ["project", "contract"] if "project" in manifest.columns else ["contract"]
    named = manifest.where("item_kind = 'Contract'").withColumnRenamed("item_name", "contract").groupBy(*by).agg(F.min("file_path").alias("file_path"))
    own = scoped_by_project(units).select("project", F.col("name").alias("contract")).distinct()
    return own.join(named, by, "left").select("project", "contract", F.coalesce("file_path", F.concat("contract", F.lit(".sol"))).alias("path"))


def last_return(edges: DataFrame) -> DataFrame:
    """For each (callee, caller, sequence), its last return edge."""
    keys = ["source_node_id", "target_node_id", "sequence_number"]
    return edges.where("edge_type = 'Return'").groupBy(*keys).agg(F.max_by("returned_value", "edge_id").alias("returned_value"), F.max("edge_id").alias("edge_id"))


def outgoing_order(edges: DataFrame) -> DataFrame:
    """edges with their place among the edges of one source: by sequence number, then edge type."""
    order = Window.partitionBy("source_node_id").orderBy("sequence_number", edge_type_ord(), "edge_id")
    return edges.withColumn("place", F.row_number().over(order))
