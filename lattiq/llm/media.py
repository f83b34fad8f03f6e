"""Media columns in a content-addressed chunk store.

A payload is cut where a rolling gear hash (h = 2h + gear[byte], so the last 32 bytes decide) has its top
bits zero, between a least and a greatest chunk size; equal stretches of different payloads give equal
chunks.  Storing:

1. each task cuts its payloads, keeps one copy of a chunk for the task, compresses it, and appends it to its
   pack file in the shared folder; a payload's recipe lists its chunks in order by SHA-256 digest;
2. Spark joins the digests of all tasks: one place, the smallest, is canonical for each;
3. each pack that holds copies of chunks kept elsewhere is rewritten without them.

Only digests and places are shuffled, never payloads.  Reading joins the recipes to the canonical places,
fetches byte ranges from the packs, checks every chunk's digest and length, and puts the payload together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, put_file, shared_dir, text_bytes, with_row_key, written

#: Payload lengths are multiples of this.
FRAME = 576
PAD = b"\xff"
LEAST, GREATEST = 2048, 65536
#: Payload bytes that a reading task puts together, about.
TASK_BYTES = 64 << 20
#: Cuts come every 2^CUT_BITS bytes beyond the least size, on average.
CUT_BITS = 13
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, filled with 255 up to a positive multiple of FRAME."""
    t = text or b""
    return t + PAD * (max(1, -(-len(t) // FRAME)) * FRAME - len(t))


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, over the 32 bytes that end there."""
    h = _GEAR[data]
    for j in range(5):
        k = 1 << j
        if len(h) <= k:
            break
        new = h.copy()
        new[k:] += h[:-k] << np.uint32(k)
        h = new
    return h


def cuts(payload: bytes, least: int = LEAST, greatest: int = GREATEST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks, in order; a chunk is at least ``least`` long, but for the last, and at most ``greatest``."""
    n = len(payload)
    if n <= least:
        return [n]
    spots = []
    for s in range(0, n, 1 << 22):  # with the 31 bytes before, a block's hashes are those of the whole
        a = max(0, s - 31)
        h = _gear(np.frombuffer(payload, np.uint8, min(n, s + (1 << 22)) - a, a))[s - a :]
        spots.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + s + 1)
    spots = np.concatenate(spots)
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(spots, at + least))
        end = min(int(spots[k]) if k < len(spots) else n, at + greatest, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _store(folder: str):
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        name = f"{folder}/pack-{TaskContext.get().partitionId():08d}-0"
        seen: dict[bytes, tuple[int, int]] = {}
        recipes: list[tuple] = []

        def packed():
            at = 0
            for b in batches:
                for rid, doc_id, text in zip(b.column("__rid").to_pylist(), b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                    data, start, chunks = payload_of(text), 0, []
                    for end in cuts(data):
                        chunk = data[start:end]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in seen:
                            c = press.compress(chunk)
                            seen[digest] = (at, len(c))
                            at += len(c)
                            yield c
                        chunks.append((digest, end - start))
                        start = end
                    recipes.append((rid, doc_id, len(text or b""), hashlib.sha256(data).digest(), chunks))

        put_file(name, packed())
        for s in range(0, len(recipes), 5000):
            part = recipes[s : s + 5000]
            rid, doc_id, n, digest, chunks = zip(*part)
            chunks = [[{"digest": d, "length": k, "pack": name, "at": seen[d][0], "size": seen[d][1]} for d, k in c] for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(chunks, _CHUNKS)], ["__rid", "doc_id", "n_bytes", "sha256", "chunks"])

    return run


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int64()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))


def _compact(key, t):
    """Rewrites a pack with the chunks that stay, in order; done again after a failure, it finds its own result."""
    old = key[0].as_py()
    t = t.filter(t.column("digest").is_valid()).sort_by("at")
    at, size = t.column("at").to_numpy(), t.column("size").to_numpy()
    new = old[:-1] + "1"
    files, path = filesystem(old)
    _, to = filesystem(new)
    from pyarrow.fs import FileType

    if len(at) and files.get_file_info(to).type != FileType.File:
        with files.open_input_file(path) as f:

            def kept():
                for a, n in zip(at.tolist(), size.tolist()):
                    f.seek(a)
                    yield f.read(n)

            put_file(new, kept())
    if files.get_file_info(path).type == FileType.File:
        files.delete_file(path)
    place = np.cumsum(size) - size
    return pa.table({"digest": t.column("digest"), "pack": pa.array([new] * len(at), pa.string()), "at": pa.array(place, pa.int64()), "size": pa.array(size)})


def store(documents: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes the payloads of documents(doc_id, text) and returns (recipes, chunks).

    recipes(__rid, doc_id, n_bytes, sha256, chunks array<struct<digest,length>>), chunks(digest, length, pack,
    at, size): one row for each distinct chunk.  doc_id must be of an integer type, else a TypeError.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    docs = with_row_key(documents.select(F.col("doc_id").cast("long"), "text"))
    kind = T._parse_datatype_string("__rid long, doc_id long, n_bytes long, sha256 binary, chunks array<struct<digest:binary,length:long,pack:string,at:long,size:long>>")
    recipes = written(docs.mapInArrow(_store(folder), kind), "recipes")
    each = recipes.select(F.explode("chunks").alias("c")).select("c.*")
    canonical = each.groupBy("digest").agg(F.min(F.struct("pack", "at", "size", "length")).alias("p")).select("digest", "p.*")
    live = each.select("pack").distinct().join(canonical, "pack", "left")  # also packs of which nothing stays
    kept = written(live.groupBy("pack").applyInArrow(_compact, "digest binary, pack string, at long, size long"), "chunks")
    return recipes.select("__rid", "doc_id", "n_bytes", "sha256", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["length"].alias("length"))).alias("chunks")), kept


def _media(chunks: list[tuple[bytes, int]], frames: list[bytes]) -> bytes:
    """The stored form of one payload: its recipe, then its compressed chunks in order."""
    recipe = b"".join(d + struct.pack("<II", n, len(f)) for (d, n), f in zip(chunks, frames))
    return b"CHNK" + struct.pack("<I", len(chunks)) + recipe + b"".join(frames)


def feature_of(payload: bytes) -> str:
    """Count, mean, spread and zero-crossing share of the samples, and the shares of their 8 octants, in whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x, minlength=256)
    n, v = len(x), np.arange(256)
    mean = int((h * v).sum()) * 1000 // n
    spread = int((h * v * v).sum()) * 1000 // n
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))) * 1_000_000 // n
    return f"n={n};mean={mean};square={spread};cross={cross};octants=" + ",".join(str(int(c)) for c in h.reshape(8, 32).sum(axis=1))


def _read(batches):
    press = zstandard.ZstdDecompressor()
    open_: dict[str, object] = {}

    def fetch(pack: str, at: int, size: int) -> bytes:
        if pack not in open_:
            if len(open_) > 64:
                open_.popitem()[1].close()
            files, path = filesystem(pack)
            open_[pack] = files.open_input_file(path)
        f = open_[pack]
        f.seek(at)
        return f.read(size)

    for b in batches:
        out = []
        for doc_id, n, want, chunks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "sha256", "chunks"))):
            frames, parts = [], []
            for c in sorted(chunks, key=lambda c: c["n"]):
                frames.append(fetch(c["pack"], c["at"], c["size"]))
                parts.append(press.decompress(frames[-1], max_output_size=c["length"]))
                if len(parts[-1]) != c["length"] or hashlib.sha256(parts[-1]).digest() != c["digest"]:
                    raise ValueError(f"damaged chunk {c['digest'].hex()} in {c['pack']}")
            payload = b"".join(parts)
            digest = hashlib.sha256(payload)
            if digest.digest() != want:
                raise ValueError(f"the payload of {doc_id} is not what was stored")
            media = _media([(c["digest"], c["length"]) for c in sorted(chunks, key=lambda c: c["n"])], frames)
            out.append((doc_id, n, len(payload), digest.hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), len(parts)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], [c.split()[0] for c in RESULT.split(", ")])


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def read(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The payloads put together from the store, verified, with their digests and features (RESULT)."""
    each = recipes.select("__rid", "doc_id", "n_bytes", "sha256", F.posexplode("chunks").alias("n", "c")).select("__rid", "doc_id", "n_bytes", "sha256", "n", "c.digest", "c.length")
    size = recipes.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(recipes.sparkSession.sparkContext.defaultParallelism, ceil(size / TASK_BYTES))
    placed = each.join(chunks, "digest").repartition(tasks, "__rid")
    whole = placed.groupBy("__rid", "doc_id", "n_bytes", "sha256").agg(F.collect_list(F.struct("n", "digest", "length", "pack", "at", "size")).alias("chunks"))
    return whole.select("doc_id", "n_bytes", "sha256", "chunks").mapInArrow(_read, RESULT)


def media(documents: DataFrame) -> DataFrame:
    """Stores every row's payload, reads it back and describes it (RESULT), one row for each row of documents.

    A null text is stored as an empty one (FRAME bytes of 255); equal texts give equal values; null and
    repeated ids stay; other columns are ignored; no rows give no rows.
    """
    return read(*store(documents, shared_dir(documents.sparkSession, "media")))
