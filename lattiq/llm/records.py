"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard file is a row of frames; a frame is

    length of the payload (8 bytes) | masked CRC-32 of these 8 bytes (4) | payload | masked CRC-32 of the payload (4)

all little-endian.  The mask turns the checksum right by 15 bits and adds 0xA282EAD8, so that checksums
stored in a payload don't weaken it.  A payload is the document's id (8 bytes), a flag byte (0: no id,
1: an id), the width of a token in bytes (1 byte, 2 or 4: the least that the vocabulary fits in) and the
tokens.  Beside ``x.rec`` lies ``x.idx``: the frames' offsets as 8-byte integers, so that a reader can fetch
any record by one seek.

Documents are put in order by ranges of (doc_id, digest of the text, number of the row), so that an id, or no
id, that many rows have is cut like any other range.  The ranges are even in bytes: their bounds come from a
sample whose rows are drawn in proportion to their bytes, so many a range whatever the size of the input.  A task writes one range
as files of SHARD_BYTES each; a document's place among all tokens is its file's start plus its place in the file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, filesystem, put_file, shared_dir, size_of, text_bytes, written

#: Bytes of a shard file, about; a longer record stands alone.
SHARD_BYTES = 32 << 20
#: Bytes of text in a task where there are tasks enough for all cores; a task then writes several files.
TASK_BYTES = 128 << 20
#: Sampled rows for each bound of the ranges.
SAMPLE = 16
#: Units whose ids a Python worker keeps.
CACHE_WORDS = 1_200_000
_MASK = 0xA282EAD8
_LENGTH = struct.Struct("<Q")
_HEAD = struct.Struct("<QBB")
_SUM = struct.Struct("<I")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def read_frame(data, at: int = 0) -> tuple[bytes, int]:
    """(payload, offset of the next frame); raises ValueError on a wrong checksum or a cut frame."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or bytes(data[at + 8 : at + 12]) != _SUM.pack(masked(length)):
        raise ValueError(f"damaged length at {at}")
    (n,) = _LENGTH.unpack(length)
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or bytes(data[at + 12 + n : at + 16 + n]) != _SUM.pack(masked(payload)):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + n


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack((doc_id or 0) & (1 << 64) - 1, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype(np.uint32)
    return (doc_id - (1 << 64) * (doc_id >> 63) if known else None), ids


def _classes() -> np.ndarray:
    """1: ASCII letters and digits, 2: ASCII punctuation but the apostrophe, 0: the rest."""
    out = np.zeros(256, np.uint8)
    for c in range(33, 127):
        out[c] = 1 if chr(c).isalnum() else 2
    out[ord("'")] = 0
    return out


_CLASS = _classes()
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def units(text: bytes) -> list[bytes]:
    """Parts of a text that the word tokenizer treats apart: cut at white space and between ASCII letters or
    digits and punctuation, ASCII lower-cased (the tokenizer's own first step would do so)."""
    b = np.frombuffer(text.lower(), np.uint8)
    c = _CLASS[b]
    cut = np.flatnonzero(c[:-1] + c[1:] == 3)  # 1 beside 2: neither 0 beside 3 nor 3 beside 0 can be
    if len(cut):
        b = np.insert(b, cut + 1, 32)
    return b.tobytes().split()


class Encoder:
    """Encodes texts with a tokenizers file that lower-cases, splits at white space and drops it.

    A unit's ids are looked up in a cache that lasts as long as the Python worker.
    """

    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("an added token looks at what stands beside it; texts can't be encoded by units")
        #: Added tokens in a text are tokens; they are found before anything is lower-cased.
        self.added = re.compile(b"(" + b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content))) + b")") if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def units(self, text: bytes) -> list[bytes]:
        """units() of what stands between added tokens, which are units of their own."""
        if self.added is None or not self.added.search(text):
            return units(text)
        out: list[bytes] = []
        for k, part in enumerate(self.added.split(text)):
            out += [part] if k % 2 else units(part)
        return out

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _learn(self, new: list[bytes]) -> None:
        """Adds units; runs of letters are encoded many at a time, told apart by the tokens that close a word."""
        plain, other = [], []
        for u in new:
            (plain if _LETTERS.fullmatch(u) else other).append(u)
        flat, sizes = [], []
        for s in range(0, len(plain), 100_000):
            parts = [plain[i : i + 200] for i in range(s, min(s + 100_000, len(plain)), 200)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(part):
                    raise ValueError("the tokenizer doesn't close each word; it can't be encoded by units")
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        for s in range(0, len(other), 20_000):
            for e in self.tokenizer.encode_batch_fast([u.decode() for u in other[s : s + 20_000]], add_special_tokens=False):
                flat.append(np.array(e.ids, np.uint32))
                sizes.append(np.array([len(e.ids)]))
        known = len(self.place)
        self.place.update(zip(plain + other, range(known, known + len(new))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate([self.flat, *flat])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words = [self.units(t) for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.place)) if words else []
        if new:
            self._learn(new)
        get = self.place.__getitem__
        for own in words:
            k = np.fromiter(map(get, own), np.int64, len(own))
            at = self.start[k]
            n = self.start[k + 1] - at
            ends = np.cumsum(n)
            yield self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - n), n)]


def _write(path: str, folder: str, end: int, shard_bytes: int):
    def run(batches):
        coder = Encoder.of(path)

        def frames():
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), [t or b"" for t in text_bytes(b.column("text"))]
                for s, e in by_bytes(texts):
                    for doc_id, found in zip(ids[s:e], coder.encode(texts[s:e])):
                        yield frame(pack(doc_id, np.append(found, np.uint32(end)), coder.width)), len(found) + 1

        task, todo, part = TaskContext.get().partitionId(), frames(), 0
        kept = next(todo, None)
        while kept is not None:
            offsets, at, tokens = [], 0, 0

            def own():
                nonlocal kept, at, tokens
                while kept is not None and (not offsets or at + len(kept[0]) <= shard_bytes):
                    f, n = kept
                    offsets.append(at)
                    at += len(f)
                    tokens += n
                    yield f
                    kept = next(todo, None)

            name = f"{folder}/shard-{task:08d}-{part:06d}"
            put_file(name + ".rec", own())
            put_file(name + ".idx", [np.array(offsets, "<u8").tobytes()])
            row = [pa.array([task], pa.int64()), pa.array([part], pa.int64()), pa.array([name]), pa.array([len(offsets)], pa.int64()), pa.array([tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, ["shard", "part", "file", "records", "tokens"])
            part += 1

    return run


#: In order: whether there is an id, the id, the digest of the text, the number of the row.
_KEYS = ("__known", "__id", "__digest", "__row")


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the keys that put rows in order; equal rows are told apart, so they may lie in many ranges."""
    return documents.select(
        "doc_id",
        "text",
        F.col("doc_id").isNotNull().cast("long").alias(_KEYS[0]),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(_KEYS[1]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(_KEYS[2]),
        F.monotonically_increasing_id().alias(_KEYS[3]),
    )


def _bounds(keyed: DataFrame, size: int, ranges: int) -> np.ndarray:
    """At most ranges - 1 rows of keys (ascending) that cut keyed into ranges of about equal bytes.

    A row is sampled with a probability in proportion to its bytes; SAMPLE rows a range come to the driver, in
    four numbers each.
    """
    chance = F.octet_length(F.coalesce("text", F.lit(""))) * F.lit(SAMPLE * ranges / size)
    drawn = F.pmod(F.xxhash64(*_KEYS), F.lit(1 << 30)) < chance * F.lit(float(1 << 30))
    sample = keyed.where(drawn).select(*_KEYS, F.greatest(chance, F.lit(1.0)).alias("__weight")).toArrow()
    keys = np.stack([sample.column(k).to_numpy() for k in _KEYS], axis=1) if sample.num_rows else np.zeros((0, 4), np.int64)
    order = np.lexsort(keys.T[::-1])
    until = np.cumsum(sample.column("__weight").to_numpy()[order])
    if not len(order):
        return keys
    at = np.searchsorted(until, until[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[order][np.minimum(at, len(order) - 1)], axis=0)


def _of_range(bounds: np.ndarray):
    """The column that tells a row's range: how many bounds are not above its keys."""
    if len(bounds) <= 64:
        cuts = [F.struct(*[F.lit(int(x)).cast("long").alias(k) for k, x in zip(_KEYS, row)]) for row in bounds]
        return _search(F.struct(*_KEYS), cuts, 0, len(cuts)).cast("int")
    names = list(zip(_KEYS, bounds.T.tolist()))
    edges = np.rec.fromarrays([np.array(x, np.int64) for _, x in names])

    def of(known: pd.Series, own: pd.Series, digest: pd.Series, row: pd.Series) -> pd.Series:
        keys = np.rec.fromarrays([x.to_numpy(np.int64) for x in (known, own, digest, row)])
        return pd.Series(np.searchsorted(edges, keys, side="right").astype(np.int32))

    return F.pandas_udf(of, "int")(*_KEYS)


def write_records(documents: DataFrame, tokenizer: str, folder: str, end: int = 1, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encodes documents(doc_id, text), each followed by end, into shard files; returns shard, part, file, records, tokens.

    Files follow each other, by (shard, part), in ascending doc_id; null ids come first, rows of equal id follow
    each other by the xxHash64 (seed 42) of their text.  A null text is encoded as an empty one; strings of the
    tokenizer's added tokens are those tokens, as in its own encode(); other columns are ignored; no rows give no
    files.  doc_id must be of an integer type (8 bytes of a record hold it), else a TypeError.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    size = size_of(documents, "text")
    context = documents.sparkSession.sparkContext
    ranges = max(ceil(size / task_bytes), min(ceil(size / shard_bytes), 8 * context.defaultParallelism), 1)
    keyed = _keyed(documents)
    bounds = _bounds(keyed, size, ranges) if ranges > 1 else np.zeros((0, 4), np.int64)
    placed = keyed.repartitionById(len(bounds) + 1, _of_range(bounds)).sortWithinPartitions(*_KEYS[:3], F.asc_nulls_first("text"))
    return written(placed.select("doc_id", "text").mapInArrow(_write(tokenizer, folder, end, shard_bytes), "shard long, part long, file string, records long, tokens long"), "manifest")


def _search(x, cuts: list, lo: int, hi: int):
    """A tree of comparisons: how many of cuts[lo:hi] are <= x, plus lo."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x >= cuts[mid], _search(x, cuts, mid + 1, hi)).otherwise(_search(x, cuts, lo, mid))


def _read(batches):
    for b in batches:
        for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
            files, path = filesystem(name)
            with files.open_input_file(path + ".idx") as f:
                offsets = np.frombuffer(f.read(), "<u8").tolist()
            at, out = base, ([], [], [], [])
            with files.open_input_stream(path + ".rec") as f:
                for offset, until in zip(offsets, [*offsets[1:], None]):
                    data = f.read(until - offset) if until is not None else f.read()
                    payload, _ = read_frame(data)
                    doc_id, ids = unpack(payload)
                    for x, v in zip(out, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        x.append(v)
                    at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of a manifest's files; all checksums are verified.

    start counts the tokens of all records before, in the order of the shards.  One row of the manifest
    stands for a file of SHARD_BYTES, so its running sum is small.
    """
    ordered = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(ordered), F.lit(0)).cast("long")).select("file", "base")
    many = starts.sparkSession.sparkContext.defaultParallelism
    return starts.repartition(max(many, 1), "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(file: str, record: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record, by the offset index."""
    files, path = filesystem(file)
    with files.open_input_file(path + ".idx") as f:
        f.seek(8 * record)
        (offset,) = _LENGTH.unpack(f.read(8))
    with files.open_input_file(path + ".rec") as f:
        f.seek(offset)
        (n,) = _LENGTH.unpack(f.read(8))
        f.seek(offset)
        return unpack(read_frame(f.read(n + 16))[0])


def token_records(documents: DataFrame, tokenizer: str, end: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes documents as records into the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(documents.sparkSession, "records")
    return read_records(write_records(documents, tokenizer, folder, end, shard_bytes))
