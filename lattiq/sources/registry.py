"""Manifest and binding files (YAML)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.natspec import MANIFEST

BINDINGS = "ord bigint, key string, contract_name string, address string, chain_id decimal(20,0), notes string"


def _yaml():
    import yaml

    return yaml


def load_bindings(spark: SparkSession, text: str) -> DataFrame:
    """key, contract_name, address, chain_id, notes of a bindings file; of a repeated key the last wins."""
    from decimal import Decimal

    rows = (_yaml().safe_load(text) or {}).get("bindings") or []
    data = [(i, r["key"], r.get("contract_name"), r.get("address"), None if r.get("chain_id") is None else Decimal(r["chain_id"]), r.get("notes")) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, BINDINGS)
    return df.groupBy("key").agg(F.max_by(F.struct("contract_name", "address", "chain_id", "notes"), "ord").alias("r")).select("key", "r.*")


def binding_map(bindings: DataFrame) -> dict[str, str | None]:
    """key -> contract (or None) for the extractor; a registry is a hand-written file, so small."""
    return {r["key"]: r["contract_name"] for r in bindings.select("key", "contract_name").collect()}


def load_manifest(spark: SparkSession, text: str) -> DataFrame:
    entries = (_yaml().safe_load(text) or {}).get("entries") or []
    rows = [json.dumps({"ord": i, **e}) for i, e in enumerate(entries)]
    df = spark.createDataFrame([(r,) for r in rows], "row string")
    return df.select(F.from_json("row", MANIFEST).alias("r")).select("r.*")


def manifest_yaml(entries: DataFrame) -> str:
    """The YAML text of a manifest, by file and place."""
    rows = [json.loads(r.j) for r in entries.orderBy("file_path", "ord").select(F.to_json(F.struct(*[c for c in entries.columns if c != "ord"]), {"ignoreNullFields": "false"}).alias("j")).collect()]
    return _yaml().safe_dump({"entries": rows}, sort_keys=False, allow_unicode=True)
