import re

import pytest
from test_simhash import slow_print

import corpus_pipeline as C
from lattiq.llm.language import fold, label_texts, train
from lattiq.llm.pieces import Pieces
from lattiq.llm.queries import surrogate_key, tokenizer_file
from lattiq.llm.surrogates import Keyed, find, redraws, render

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def grams(w):
    return {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def slow(spark):
    """The pipeline's rows, one document at a time."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in table.collect())
    model = train(table.where(fold() != 2))
    docs = [(i, t) for i, t in docs for lang, share, _ in label_texts([(t or "").encode()], model) if lang != "und" and share >= C.LEAST_SHARE]
    prints = [slow_print(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    bad = set().union(*(grams(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    short = {g for g in bad if g.count(" ") < 9}
    docs = [(i, t) for i, t in docs if not bad & grams(words(t)) and not any(f" {g} " in f" {' '.join(words(t))} " for g in short)]
    again = {(r.kind, r.canonical): r.attempt for r in redraws(spark.createDataFrame(docs, "doc_id long, text string"), surrogate_key()).collect()}
    keyed, model, out = Keyed(surrogate_key()), Pieces(tokenizer_file("piece_bpe_32k.model"), 2), {}
    for i, t in docs:
        for a, e, kind, c in reversed(find(t)):
            t = t[:a] + render(kind, keyed.draw(kind, c, again.get((kind, c), 0)), t[a:e]) + t[e:]
        out[i] = model.nbest(t)[0]
    return out


def test_run_against_one_document_at_a_time(spark):
    want = slow(spark)
    got = C.run(spark, SF).collect()
    assert {r.doc_id: (r.score, r.ids) for r in got} == {i: (s, list(ids)) for i, (s, ids) in want.items()} and len(got) == len(want)
    assert all(r.round_trip for r in got) and 100 < len(got) < 200


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_take_hard_rows(spark, k):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    rows = [(1, None, "en", "s", 0), (1, "", None, None, None), (None, "the words of the text and of a place in it", None, "s", 5), (4, "same words here, four of them and more", "en", "s", 1), (4, "same words here, four of them and more", "en", "s", 1), (5, "12 34", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    got = C.STAGES[k][1](spark, docs, SF)
    assert got.columns == columns and got.dtypes == docs.dtypes
    kept = sorted(map(repr, ((r.doc_id, r.text) for r in got.collect())))
    whole = sorted(repr(r[:2]) for r in rows)
    if k == 1:  # of the two texts without words, which share an id, either may stay
        kept, whole = [[x.replace("None)", "'')") for x in v] for v in (kept, whole)]
        whole = sorted(set(whole))
    assert sorted(kept) == ([x for x in whole if "words" in x] if k == 0 else whole)
    assert C.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


def test_pieces_stage_takes_hard_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "the words of the text", None), (4, "the words of the text", "c"), (4, "the words of the text", "c"), (5, "word " * 30_000, "d"), (6, "\u2603\u0000\ud7ff x", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = C.pieces(spark, docs, SF).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert [(by_id[i].n_pieces, by_id[i].ids, by_id[i].next_ids, by_id[i].score) for i in (1, 2)] == [(0, [], None, 0.0)] * 2
    assert by_id[None].ids == by_id[4].ids and by_id[4].next_ids != by_id[4].ids and by_id[4].score >= by_id[4].next_score
    assert by_id[5].n_pieces >= 30_000
    assert C.pieces(spark, docs.limit(0), SF).count() == 0


def test_private_stage_keeps_a_column_named_spans(spark):
    docs = spark.createDataFrame([(1, "call +1 (269) 555-3296", "own")], "doc_id long, text string, spans string")
    got = C.private(spark, docs, SF)
    assert got.columns == docs.columns and got.first().spans == "own" and got.first().text != docs.first().text
