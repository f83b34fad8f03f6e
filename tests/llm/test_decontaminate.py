import hashlib
import re

import numpy as np
import pytest

from lattiq.llm.common import table
from lattiq.llm.decontaminate import contamination

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC, ITEM = "doc_id long, text string, window string, length int", "item_id long, text string, key string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def slow(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def fast(spark, docs, items, size, **more):
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, "c") for i, t in items], ITEM)
    got = contamination(d, b, size, **more).collect()
    for r in got:
        spans = [(s["from"], s["to"]) for s in r.spans or []]
        assert sum(b - a for a, b in spans) == r.n_hit and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)


def corpus():
    rng = np.random.default_rng(9)
    pool = [f"W{i}" for i in range(30)] + ["Été", "naïve", "7"]
    items = [(i, " ".join(rng.choice(pool, int(n)))) for i, n in enumerate(rng.integers(1, 30, 25))]
    items += [(100, None), (101, ""), (102, "..."), (None, "W1 W2 W3 W4"), (3, "again an item of the same id"), (104, "uno"), (105, "uno due"), (106, items[0][1])]
    docs = []
    for i in range(60):
        text = list(rng.choice(pool, int(rng.integers(0, 80))))
        for _ in range(int(rng.integers(0, 3))):
            w = words(items[int(rng.integers(25))][1])
            a = int(rng.integers(0, max(1, len(w) - 5)))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = w[a : a + int(rng.integers(3, 20))]
        docs.append((i, ", ".join(text)))
    docs += [(None, None), (1, ""), (1, ""), (70, "Uno; DUE"), (71, items[0][1].upper() * 1), (72, "x " * 20_000 + items[2][1])] + [(80 + k, "hot " + items[4][1]) for k in range(40)]
    return docs, items


@pytest.mark.parametrize(("size", "limit"), [(10, 1 << 22), (10, 0), (4, 1 << 22)])
def test_against_every_position(spark, size, limit):
    docs, items = corpus()
    assert fast(spark, docs, items, size, broadcast_bytes=limit) == slow(docs, items, size)


@pytest.mark.parametrize("limit", [1 << 22, 0])
def test_empty_tables(spark, limit):
    assert fast(spark, [], [(1, "a b")], 10, broadcast_bytes=limit) == []
    assert fast(spark, [(1, "a b")], [], 10, broadcast_bytes=limit) == slow([(1, "a b")], [], 10)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    got = fast(spark, docs, items, 10)
    assert got == slow(docs, items, 10) and any(r[-1] for r in got)
