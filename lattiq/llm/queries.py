"""The registered queries of this subpackage, over whole tables, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

import os
import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .html import main_texts
from .language import detect, fold, train
from .licenses import scan
from .media import media
from .pieces import encode
from .records import token_records
from .shards import shard
from .surrogates import pseudonymize
from .simhash import hex_of, near_duplicates

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{WORD}'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{WORD}'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS t
       FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(k) WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, k, dw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
pos AS (SELECT rid, count(DISTINCT k + j) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) AS g(j) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in $TOKENIZER_DIR, else where the installed package has it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=1)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = [F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", "labels").alias("labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "n_near", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 2))
    return detect(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@lru_cache
def surrogate_key() -> bytes:
    """The secret of a deployment, $SURROGATE_KEY; where there is none, a random one that this process forgets."""
    return os.environ["SURROGATE_KEY"].encode() if os.environ.get("SURROGATE_KEY") else secrets.token_bytes(32)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key())
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_entities"), F.concat_ws(",", F.array_sort(F.array_distinct(F.col("spans.kind")))).alias("kinds"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), best=4, paths="none")
    scores = F.concat_ws(",", F.transform("scores", lambda s: s.cast("string")))
    joined = [F.concat_ws(",", F.col(f"paths.{c}").cast("array<string>")).alias(f"nbest_{c}") for c in ("n_pieces", "ids_crc32", "round_trip")]
    return found.select("doc_id", "n_pieces", "ids_crc32", scores.alias("nbest_scores"), F.size("paths").alias("n_best"), "round_trip", *joined)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_records, op3_media, op4_licenses, op5_simhash, op6_language, op7_surrogates, op8_pieces, op9_shards, op10_html)}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL}
