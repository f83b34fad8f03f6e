"""Reads the DOT files that the exporter writes back into nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CodeGraph

_QUOTED = r'="((?:[^"\\]|\\.)*)"'


def _attribute(name: str):
    return F.nullif(F.regexp_extract("value", name + _QUOTED, 1), F.lit(""))


def read_dot(spark: SparkSession, path: str) -> CodeGraph:
    """Labels and tooltips carry type, visibility, spans and sequence numbers; what a label doesn't say stays null."""
    rows: DataFrame = spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id())
    n = rows.where(F.col("value").rlike(r"^\s*n\d+ \[")).select(
        F.regexp_extract("value", r"^\s*n(\d+)", 1).cast("bigint").alias("id"), _attribute("label").alias("label"), _attribute("tooltip").alias("tip")
    )
    title = F.regexp_extract("label", r"^(.*?)\\+n\([a-z]+\)$", 1)
    dotted = F.instr(title, ".")
    kind = F.regexp_extract("tip", r"Type: (\w+)", 1)
    scoped = ~kind.isin("Evm", "EventListener") & (dotted > 0)
    nodes = n.select(
        "id",
        F.when(scoped, F.regexp_extract(title, r"^[^.]*\.(.*)$", 1)).otherwise(title).alias("name"),
        kind.alias("node_type"),
        F.when(scoped, F.regexp_extract(title, r"^([^.]*)\.", 1)).alias("contract_name"),
        F.regexp_extract("tip", r"Visibility: (\w+)", 1).alias("visibility"),
        F.struct(F.regexp_extract("tip", r"Span: \((\d+)", 1).cast("bigint").alias("start"), F.regexp_extract("tip", r"Span: \(\d+, (\d+)\)", 1).cast("bigint").alias("end")).alias("span"),
    )
    e = rows.where(F.col("value").rlike(r"^\s*n\d+ -> n\d+ \[")).select(
        "line_id", F.regexp_extract("value", r"^\s*n(\d+)", 1).cast("bigint").alias("source_node_id"), F.regexp_extract("value", r"-> n(\d+)", 1).cast("bigint").alias("target_node_id"),
        F.coalesce(_attribute("label"), F.lit("")).alias("label"), F.coalesce(_attribute("tooltip"), F.lit("")).alias("tip"), F.coalesce(_attribute("color"), F.lit("")).alias("color"),
    )
    tip, label = F.col("tip"), F.col("label")
    kind = (
        F.when(tip.startswith("Call Site"), "Call").when(tip.startswith("Return from"), "Return").when(tip.startswith("Read Span"), "StorageRead").when(tip.startswith("Write Span"), "StorageWrite")
        .when(tip.startswith("Require Check"), "Require").when(tip.startswith("If Condition"), "IfConditionBranch").when(tip.startswith("Then branch"), "ThenBranch").when(tip.startswith("Else branch"), "ElseBranch")
        .when((F.col("color") == "olivedrab") & (label == "for_body"), "ForBodyBranch").when(F.col("color") == "olivedrab", "ForConditionBranch")
    )
    number = lambda p: F.nullif(F.regexp_extract("tip", p, 1), F.lit("")).cast("bigint")
    edges = e.select(
        F.col("line_id").alias("edge_id"), "source_node_id", "target_node_id", kind.alias("edge_type"),
        F.struct(number(r"(?:Span|defined at|Condition[^(]*): ?\(?(\d+),").alias("start"), number(r"Span: \(\d+, (\d+)").alias("end")).alias("call_site_span"),
        number(r"Sequence: (\d+)").alias("sequence_number"), F.nullif(F.regexp_extract("tip", r"Event: (\w+)", 1), F.lit("")).alias("event_name"),
    )
    return CodeGraph(nodes, edges)
