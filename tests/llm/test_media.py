import hashlib
import zlib

import numpy as np
import pytest
import zstandard

from lattiq.llm import media as M
from lattiq.llm.common import filesystem, shared_dir, table


def slow_cuts(p, least, greatest, bits):
    out, at, h = [], 0, 0
    hashes = []
    for x in p:
        h = ((h << 1) + int(M._GEAR[x])) & 0xFFFFFFFF
        hashes.append(h)
    while at < len(p):
        end = min(len(p), at + greatest)
        if len(p) - at > least:
            end = next((i + 1 for i in range(at + least - 1, end) if hashes[i] >> (32 - bits) == 0), end)
        else:
            end = len(p)
        out.append(end)
        at = end
    return out


def test_cuts_against_a_byte_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 99, 100, 101, 5000, 20_000):
        p = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        for case in ((100, 1000, 6), (300, 400, 9)):
            assert M.cuts(p, *case) == (slow_cuts(p, *case) if n else [0])
    p = b"\xff" * 300_000
    assert M.cuts(p) == slow_cuts(p, M.LEAST, M.GREATEST, M.CUT_BITS)


def test_cuts_resynchronise():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    chunks = lambda x: {x[a:b] for a, b in zip([0, *M.cuts(x)], M.cuts(x))}
    assert len(chunks(p) & chunks(b"in front" + p)) > 0.8 * len(chunks(p))


def want(i, text):
    t = (text or "").encode()
    p = t + b"\xff" * (-len(t) % 576 if t else 576)
    return str(i), len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), M.feature_of(p)


def test_round_trip(spark):
    rng = np.random.default_rng(4)
    long = " ".join(map(str, rng.integers(0, 10**9, 30_000)))
    rows = [(1, None), (2, ""), (None, "é" * 288), (4, "x" * 577), (5, long), (5, long), (6, "front " + long), (7, long[:150_000])] + [(100 + i, "hot copy") for i in range(300)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string").repartition(3, "doc_id")
    folder = shared_dir(spark, "media")
    recipes, chunks = M.store(df, folder)
    got = M.read(recipes, chunks).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == sorted(want(i, t) for i, t in rows)
    by = {}
    assert all(by.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes)) == (r.media_sha256, r.media_bytes) for r in got)
    kept = chunks.collect()
    assert len({bytes(c.digest) for c in kept}) == len(kept) < recipes.selectExpr("sum(size(chunks)) as n").first().n
    files, path = filesystem(folder)
    from pyarrow.fs import FileSelector

    assert sum(f.size for f in files.get_file_info(FileSelector(path))) == sum(c.size for c in kept)


def test_damage_is_noticed(spark):
    recipes, chunks = M.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), shared_dir(spark, "media"))
    pack = chunks.first().pack
    files, path = filesystem(pack)
    data = bytearray(open(path, "rb").read())
    data[-9] ^= 1
    with files.open_output_stream(path) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="damaged|ZstdError|decompress"):
        M.read(recipes, chunks).collect()


def test_empty(spark):
    assert M.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def stored(text):
    """The stored form and the feature of one payload, put together by plain loops."""
    t = (text or "").encode()
    p = t + b"\xff" * (-len(t) % 576 if t else 576)
    ends = slow_cuts(p, M.LEAST, M.GREATEST, M.CUT_BITS)
    parts = [p[a:b] for a, b in zip([0, *ends], ends)]
    frames = [zstandard.ZstdCompressor(level=3).compress(x) for x in parts]
    head = b"CHNK" + len(parts).to_bytes(4, "little")
    data = head + b"".join(hashlib.sha256(x).digest() + len(x).to_bytes(4, "little") + len(f).to_bytes(4, "little") for x, f in zip(parts, frames)) + b"".join(frames)
    n = len(p)
    crossed = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:]))
    octants = ",".join(str(sum(k * 32 <= x < k * 32 + 32 for x in p)) for k in range(8))
    return len(data), hashlib.sha256(data).hexdigest(), f"n={n};mean={sum(p) * 1000 // n};square={sum(x * x for x in p) * 1000 // n};cross={crossed * 1_000_000 // n};octants={octants}"


def test_stored_form_against_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 30000").limit(60).collect()] + [(-1, None), (-2, "é"), (-3, "ab" * 40_000)]
    got = {r.doc_id: (r.media_bytes, r.media_sha256, r.feature) for r in M.media(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: stored(t) for i, t in docs}


def test_ids_of_other_types(spark):
    with pytest.raises(TypeError):
        M.media(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert M.media(spark.createDataFrame([(1, "b")], "doc_id int, text string")).first().n_bytes == 1
