"""Helpers shared by the training-data operators: shared storage, text access, row keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import durable, shared_dir

__all__ = ["durable", "shared_dir"]  # handed on to the operators

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
CHUNK_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: computed once, pruned by column."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain local path; usable on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: Iterable[bytes]) -> None:
    """Writes a file under a passing name and renames it, so that a lost or repeated task leaves no half file."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(passing) as out:
        for x in data:
            out.write(x)
    files.move(passing, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it so that df has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str = "__rid") -> DataFrame:
    """A key for each row, also where ids are null or repeated.  Only for frames whose result is then written or checkpointed once."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def by_bytes(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes each; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_table() -> bytes:
    """bytes.translate table: lower-cases A-Z, keeps 0-9, a-z and bytes from 128 on, blanks the rest.

    On UTF-8 bytes, split() then gives the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text.
    """
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(128):
        if chr(c).isalnum():
            out[c] = ord(chr(c).lower())
    return bytes(out)


WORDS = word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def size_of(df: DataFrame, column: str) -> int:
    """Bytes in a string column (aggregated in Spark, one number comes back)."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
