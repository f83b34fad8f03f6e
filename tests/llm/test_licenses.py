import re

from lattiq.llm.common import table
from lattiq.llm.licenses import COVER, GRAM, NEAR, PHRASES, TEMPLATES, scan

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def slow(text):
    w = words(text)
    base, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        base += at
        labels |= {label} if at else set()
    more, best = set(labels), 0.5 if base else 0.0
    for name, t in TEMPLATES.items():
        t = words(t)
        hits = sorted((i - j, i, j) for i in range(len(w) - GRAM + 1) for j in range(len(t) - GRAM + 1) if w[i : i + GRAM] == t[j : j + GRAM])
        groups, last = [], None
        for d, i, j in hits:
            if last is None or d - last > NEAR:
                groups.append(set())
            groups[-1] |= set(range(j, j + GRAM))
            last = d
        for g in groups:
            if len(g) / len(t) >= COVER:
                more.add(name.split("-")[0])
                best = max(best, len(g) / len(t))
    return len(w), len(base), min(base, default=None), max(base, default=None), sorted(labels), sorted(more), round(best, 9)


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base, r.labels, round(r.score, 9)


def test_against_all_positions(spark):
    changed = TEMPLATES["mit-grant"].replace("any person", "any kind person").replace("deal in", "deal with")
    rows = [(1, None), (1, ""), (None, "..."), (4, TEMPLATES["gpl-notice"] * 2), (5, "x " * 3000 + changed), (5, "x " * 3000 + changed), (6, "The MIT license. mit LICENSE, Apache License general public license"), (7, "Permission is hereby denied"), (8, "License " * 50)]
    got = scan(spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_words int, template string")).collect()
    assert sorted(map(repr, map(row, got))) == sorted(repr(slow(t)) for _, t in rows)
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: slow(r.text) for r in docs.collect()}
    got = {r.doc_id: row(r) for r in scan(docs).collect()}
    assert got == want and sum(bool(v[5]) for v in want.values()) >= 3
