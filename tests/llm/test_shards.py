import zlib
from collections import defaultdict

import numpy as np
import pytest

from lattiq.llm import shards as S


def slow(sizes, counts, n):
    loads, out = [0] * n, []
    for size, c in zip(sizes, counts):
        row = [0] * n
        for _ in range(c):
            s = min(range(n), key=lambda i: (loads[i], i))
            loads[s] += size
            row[s] += 1
        out.append(row)
    return out, loads


def test_schedule_is_the_heap_rule():
    rng = np.random.default_rng(0)
    for n in (1, 3, 24):
        sizes = np.unique(rng.integers(1, 5000, 40))[::-1]
        counts = rng.integers(1, 900, len(sizes))
        sizes, counts = np.concatenate([[10**6], sizes]), np.concatenate([[1], counts])
        given, loads = S.schedule(sizes, counts, n)
        want, wanted = slow(sizes, counts, n)
        assert given.tolist() == want and loads.tolist() == wanted


@pytest.mark.parametrize("bucket", [100_000, 5])
def test_shards_against_one_heap(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(2)
    texts = ["é" * int(k) for k in rng.integers(0, 60, 150)] + ["hot copy"] * 100 + ["b" * i for i in (5, 5, 9000)] + [None, "", None]
    rows = [(i if i % 17 else None, t, 7) for i, t in enumerate(texts)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 5).collect()
    assert len(got) == len(rows)
    of, slots, loads = {}, defaultdict(list), defaultdict(int)
    for r in got:
        assert of.setdefault(bytes(r.digest), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    groups = defaultdict(int)
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 8
    order = sorted(groups.values(), reverse=True)
    assert [loads[s] for s in range(5)] == slow(order, [1] * len(order), 5)[1]


def test_empty(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
