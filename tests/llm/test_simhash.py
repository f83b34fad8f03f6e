import numpy as np
import pytest
import xxhash

from lattiq.llm.simhash import _turn, fingerprint, links, near_duplicates, one_of_each, trie_pairs

SCHEMA = "doc_id long, text string, fp string, task int"


def slow_print(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow(rows):
    prints = [slow_print(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(rows[i][0]), prints[i], len(links[i]), str(min(ids, default=None))))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"Wörd{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words, 250))
        rows += [(len(rows), text)]
        for _ in range(int(rng.integers(0, 4))):
            t = text.split()
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = "changed"
            rows.append((len(rows), " ".join(t)))
    rows += [(None, rows[0][1]), (5, rows[0][1]), (1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "x " * 50_000)]
    return rows


@pytest.mark.parametrize("chunk", [16384, 7])
def test_near_duplicates_against_all_pairs(spark, chunk):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = [(str(r.doc_id), r.fp % (1 << 64), r.n_near, str(r.component_id)) for r in near_duplicates(df, chunk).collect()]
    assert sorted(got) == slow(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_of_edges():
    for t in ["", "a", "a b c d", "a b c d e", "É è  É\x0bè a"]:
        assert fingerprint(t.encode()) == slow_print(t)


@pytest.mark.parametrize("same", [True, False])
def test_trie_pairs_against_all_pairs(same):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for x in base for _ in range(3)]
    a = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = (a, a) if same else (a[::2], a[1::2])
    got = []
    for walk in (0, 1):
        x, y = np.sort(_turn(a, walk)), np.sort(_turn(b, walk))
        i, j = trie_pairs(x, y, same, walk)
        got += [tuple(sorted(map(int, p))) for p in zip(_turn(x[i], walk), _turn(y[j], walk))]
    want = {tuple(sorted((int(p), int(q)))) for p in a for q in b if p != q and (int(p) ^ int(q)).bit_count() <= 4}
    assert len(got) == len(want) and set(got) == want


def test_crowded_prefixes_are_cut_deeper(spark):
    """Thousands of fingerprints that share their first bits, in either half, among others: all links by brute force."""
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    hot = [(0xABCD << 48) | int(x) for x in rng.integers(0, 1 << 14, 300)] + [0x1234 | (int(x) << 40) for x in rng.integers(0, 1 << 20, 300)]
    near = [x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for x in base + hot[::10] for _ in range(4)]
    words = np.unique(np.array(base + hot + near, np.uint64))
    df = spark.createDataFrame([(int(x), 1) for x in words.view(np.int64)], "fp long, rows long")
    want = {int(x): int((np.bitwise_count(words ^ x) <= 4).sum()) - 1 for x in words}
    for chunk in (9, 100):
        got = {r.fp % (1 << 64): r.near for r in links(df, chunk).groupBy("fp").agg({"near": "sum"}).withColumnRenamed("sum(near)", "near").collect()}
        assert got == {x: n for x, n in want.items() if n}


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(2, "a b c d e", 7, "x", 1), (1, "a b c d e", 8, "y", 2), (3, "other words stand here now", 9, None, 3), (None, "a b c d e", 1, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp long, __kept_id string, __KEPT_FP int")
    got = one_of_each(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[1], rows[2]]
    assert one_of_each(df.limit(0)).count() == 0
