import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lattiq.llm import records as R
from lattiq.llm.common import shared_dir, table
from lattiq.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


def plain():
    return Tokenizer.from_file(PATH)


def test_added_tokens_are_tokens():
    assert next(R.Encoder(PATH).encode([b"hello <|endoftext|> world"])).tolist() == [3306, 49407, 1002]


def test_encoder_is_the_whole_text_encoder():
    texts = ["", " ", "It's the <|endoftext|> end's", "x<|startoftext|>'s<|endoftext|><|ENDOFTEXT|>É <|endoftext",  "a b c\x0bd\x1ce\x85f", "É é ÉÉ 12ab!! don't", "x" * 5000, "́ lone", "ΣΑΣ ΣΣ.", "日本語 テスト\n\n\ttab", "I'LL we'RE 's"]
    got = [x.tolist() for x in R.Encoder(PATH).encode([t.encode() for t in texts])]
    assert got == [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]


def test_frames_notice_damage():
    f = bytearray(R.frame(b"payload") + R.frame(b""))
    assert R.read_frame(f)[0] == b"payload" and R.read_frame(f, R.read_frame(f)[1]) == (b"", len(f))
    for i in range(len(f) // 2):
        g = bytearray(f)
        g[i] ^= 1
        with pytest.raises(ValueError):
            R.read_frame(g, R.read_frame(g)[1])
    assert R.unpack(R.pack(-5, np.array([1, 70000], np.uint32), 4))[0] == -5
    assert R.unpack(R.pack(None, np.array([], np.uint32), 2)) [0] is None


def digest(text):
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + (1 << 63)) % (1 << 64)


@pytest.mark.parametrize("shard_bytes", [1 << 30, 100_000, 2000])
def test_whole_table_against_one_pass(spark, shard_bytes):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "null id"), (10**12, None), (3, "again"), (3, "again"), (-4, "")], "doc_id long, text string")
    df = docs.unionByName(extra).selectExpr("doc_id", "text", "1 as start")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in R.token_records(df, PATH, 1, shard_bytes).collect()))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]), r[1] is not None))
    t, at, want = plain(), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_random_access_and_empty(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(9)], "doc_id long, text string")
    manifest = R.write_records(df, PATH, shared_dir(spark, "t"), 1).collect()
    assert len(manifest) == 1 and R.read_one(manifest[0].file, 7)[0] == 7
    assert R.token_records(df.limit(0), PATH).count() == 0


def test_hot_ids_are_cut(spark):
    """Rows of one id, of no id, and equal rows lie in many files of even size, in order."""
    rows = [(None if i % 3 else 7, f"text {i % 5 if i % 2 else i} " * 20) for i in range(3000)] + [(-(1 << 63), "least"), (8, "long " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = R.write_records(df, PATH, shared_dir(spark, "hot"), 1, 20_000, 60_000).orderBy("shard", "part").collect()
    total = sum(len(t) for _, t in rows)
    by_task = {}
    for m in manifest:
        by_task[m.shard] = by_task.get(m.shard, 0) + m.tokens
    assert len(by_task) > 7 and max(by_task.values()) < 4 * sum(by_task.values()) / len(by_task)
    assert len(manifest) > len(by_task) and sum(m.records for m in manifest) == len(rows) and total
    found = [R.read_one(m.file, k)[0] for m in manifest for k in range(m.records)]
    key = lambda x: (x is not None, x or 0)
    assert found == sorted((d for d, _ in rows), key=key)
    t, at = plain(), 0
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in R.read_records(spark.createDataFrame(manifest)).collect())
    for (start, doc_id, n), (d, text) in zip(got, sorted(rows, key=lambda r: (*key(r[0]), digest(r[1])))):
        assert (start, doc_id, n) == (at, d, len(t.encode(text, add_special_tokens=False).ids) + 1)
        at += n


def test_ids_of_other_types(spark):
    with pytest.raises(TypeError):
        R.write_records(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH, "x")
    assert R.token_records(spark.createDataFrame([(1, "b")], "doc_id int, text string"), PATH).first().n_tokens == 2
