"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  run() applies them to a table directory, each stage written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import table, written
from lattiq.llm.decontaminate import contamination
from lattiq.llm.language import accept, fold, train
from lattiq.llm.pieces import encode
from lattiq.llm.queries import surrogate_key, tokenizer_file
from lattiq.llm.simhash import one_of_each
from lattiq.llm.surrogates import pseudonymize

#: A document goes if its language holds less of its letters.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or without one language that prevails, go.

    Null and empty texts have no letter and go; ties of languages go to the first in alphabetical order; repeated
    rows share a fate; the model is trained on docs itself, so a table without labelled rows keeps none; columns stay as they are.
    """
    return accept(docs, train(docs.where(fold() != 2)), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, null ids last.

    Null, empty and blank texts are one group (fingerprint 0); of repeated rows one stays; columns of any name stay; an
    empty table stays empty.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.  Texts are told apart by digest: equal texts share a fate.

    Null and empty texts have no words and stay, as do repeated rows and rows without an id; an empty benchmark takes none.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    found = contamination(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit.hint("shuffle_hash"), digest == F.col("__hit"), "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars, if there is one, follows the new text.

    No row goes; a null text stays null, equal texts stay equal, other columns stay as they are (a column named spans too).
    """
    spans = {"spans": "__spans"} if "spans" in docs.columns else {}
    out = pseudonymize(docs.withColumnsRenamed(spans), surrogate_key()).drop("spans").withColumnsRenamed({v: k for k, v in spans.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The two best segmentations of each text: doc_id, n_pieces, ids_crc32, ids, score, next_score, next_ids, round_trip (of both).

    A null text is an empty one: no pieces, and no second segmentation (null); repeated rows are encoded each; equal
    scores keep the search's order; other columns are left out; an empty table gives no rows.
    """
    found = encode(docs, tokenizer_file("piece_bpe_32k.model"), best=2)
    score, ids = ([F.try_element_at(c, F.lit(k)) for k in (1, 2)] for c in ("scores", "ids"))
    whole = F.forall("paths", lambda p: p["round_trip"])
    return found.select("doc_id", "n_pieces", "ids_crc32", ids[0].alias("ids"), score[0].alias("score"), score[1].alias("next_score"), ids[1].alias("next_ids"), whole.alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private", private), ("pieces", pieces)]

#: Fingerprints, Viterbi and lattice searches aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
