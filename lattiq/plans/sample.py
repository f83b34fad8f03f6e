"""A made-up code graph of any size: what benchmarks and tests walk where no project is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CodeGraph

#: Shares of a graph of one unit: 150 functions, 80 variables, 150 conditions with a then block each, 50 interfaces.
FUNCTIONS, VARIABLES, BRANCHES, FACES = 150, 80, 150, 50


def sample_graph(spark: SparkSession, copies: int = 1) -> CodeGraph:
    """copies x (580 nodes, 790 edges), each copy a project with ids of its own.

    In a copy function k (contract k // 10, every third one public) calls (7k + 3) and (k + 1) modulo 150 for k
    divisible by 3 resp. 2, reads variable k modulo 80, and writes variable 3k modulo 80 if k is even; condition k hangs on function k.
    """
    unit = FUNCTIONS + VARIABLES + 2 * BRANCHES + FACES
    base = lambda n: spark.range(copies * n).select((F.col("id") / n).cast("bigint").alias("p"), (F.col("id") % n).alias("k"))
    at = lambda shift, k="k": F.expr(f"p * {unit} + {shift} + {k}")
    project = F.format_string("%06d", "p").alias("project")

    def nodes(n: int, shift: int, kind: str, name: str, contract, visibility) -> DataFrame:
        return base(n).select(at(shift).alias("id"), F.concat(F.lit(name), "k").alias("name"), F.lit(kind).alias("node_type"), contract.alias("contract_name"), visibility.alias("visibility"), F.struct((F.col("k") * 10).alias("start"), (F.col("k") * 10 + 9).alias("end")).alias("span"), project)

    of = F.concat(F.lit("C"), (F.col("k") / 10).cast("int"))
    public = F.when(F.col("k") % 3 == 0, "Public").otherwise("Internal")
    none, default = F.lit(None).cast("string"), F.lit("Default")
    v, b, t, i = FUNCTIONS, FUNCTIONS + VARIABLES, FUNCTIONS + VARIABLES + BRANCHES, FUNCTIONS + VARIABLES + 2 * BRANCHES
    all_nodes = nodes(FUNCTIONS, 0, "Function", "f", of, public)
    for part in (nodes(VARIABLES, v, "StorageVariable", "v", of, default), nodes(BRANCHES, b, "IfStatement", "if", none, default), nodes(BRANCHES, t, "ThenBlock", "then", none, default), nodes(FACES, i, "Interface", "I", F.concat(F.lit("I"), "k"), default)):
        all_nodes = all_nodes.unionByName(part)

    place = iter(range(10))

    def edges(n: int, kind: str, source, target, keep: str = "true") -> DataFrame:
        x = next(place)
        return base(n).where(keep).select(F.expr(f"(p * 1000 + k) * 10 + {x}").alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(kind).alias("edge_type"), F.lit(x + 1).cast("bigint").alias("sequence_number"), F.struct(F.col("k").alias("start"), F.col("k").alias("end")).alias("call_site_span"), project)

    f = at(0)
    parts = [
        edges(FUNCTIONS, "StorageRead", f, at(v, "k % 80")),
        edges(FUNCTIONS, "Call", f, at(0, "(7 * k + 3) % 150"), "k % 3 = 0"),
        edges(FUNCTIONS, "Call", f, at(0, "(k + 1) % 150"), "k % 2 = 0"),
        edges(FUNCTIONS, "StorageWrite", f, at(v, "(3 * k) % 80"), "k % 2 = 0"),
        edges(BRANCHES, "IfConditionBranch", f, at(b)),
        edges(BRANCHES, "ThenBranch", at(b), at(t)),
        edges(BRANCHES, "StorageRead", at(t), at(v, "(k + 1) % 80"), "k < 140"),
    ]
    all_edges = parts[0]
    for part in parts[1:]:
        all_edges = all_edges.unionByName(part)
    return CodeGraph(all_nodes, all_edges)
