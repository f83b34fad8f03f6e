import zlib

import numpy as np
import pytest

from lattiq.llm import pieces as P
from lattiq.llm.common import table
from lattiq.llm.queries import op8_pieces, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.Pieces(PATH, 6)


def every(model, marked):
    """All paths of a whole marked text."""
    if not marked:
        return [(0.0, [])]
    out = []
    for e in range(1, len(marked) + 1):
        arcs = [a for a in model.arcs(marked[:e])[e] if a[0] == 0]
        for _, s, ids in arcs:
            out += [(s + t, [*ids, *rest]) for t, rest in every(model, marked[e:])]
    return out


@pytest.mark.parametrize("text", ["", "a", " ", "the cat", "  two", "ab\ncd", "né ☃x", "aaaaaa", "to be to", "a,b.", "\n(a\n"])
def test_against_all_paths(model, text):
    marked = "▁" + text.replace(" ", "▁") if text else ""
    want = sorted(every(model, marked), key=lambda x: -x[0])
    got = model.nbest(text)
    assert [s for s, _ in got] == [s for s, _ in want[: len(got)]] and len(got) == min(6, len(want))
    assert len({tuple(i) for _, i in got}) == len(got)
    assert all((s, list(i)) in want for s, i in got)
    assert all(model.decode(i) == text for _, i in got)


def test_long_unit_and_ties(model):
    got = model.nbest("a" * 3000)
    assert len(got) == 6 and all(model.decode(i) == "a" * 3000 for _, i in got)


def test_no_piece_reaches_over_a_cut(model):
    assert all(model.cut.findall(p) == [p] for p in model.score if not p.startswith("▁▁") and "▁" not in p[1:] and len(p) > 1)
    text = "It's (a) test,with.marks\n\tand tabs; é,ü! 3.14"
    assert "".join(model.units(text)) == "▁" + text.replace(" ", "▁") and len(model.units(text)) > 14


def test_whole_table(spark, model):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "x y", 1), (1, "x y", 1)], "doc_id long, text string, ids int")
    got = P.encode(docs.selectExpr("doc_id", "text", "1 as ids").unionByName(extra), PATH, 3).collect()
    assert len(got) == docs.count() + 4 and all(r.round_trip for r in got)
    few = P.Pieces(PATH, 3)
    texts = {r.doc_id: r.text for r in docs.limit(20).collect()}
    for r in got:
        if r.doc_id in texts and r.doc_id != 1:
            want = few.nbest(texts[r.doc_id])
            assert [s for s, _ in want] == r.scores and [i for _, i in want] == r.ids and list(np.sort(r.scores)[::-1]) == r.scores
    assert P.encode(extra.limit(0), PATH).count() == 0


def test_query_builds_every_path(spark):
    sf = "/root/testdata/sf0.001"
    four = P.Pieces(PATH, 4)
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = op8_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = four.nbest(texts[r.doc_id])
        crcs = [zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in want]
        assert r.n_best == len(want) and r.nbest_ids_crc32 == ",".join(map(str, crcs)) and len(set(crcs)) == len(crcs)
        assert r.nbest_n_pieces == ",".join(str(len(i)) for _, i in want) and r.nbest_round_trip == ",".join(["true"] * len(want))


def test_bytes_of_each_path_are_those_of_its_ids(spark, model):
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()] + ["", "né ☃x", "a,b. c"]
    assert all(data == model.joined(ids.tolist()) for t in texts for _, ids, data in model.paths(t))


def test_many_units_at_once_against_one_at_a_time(spark, model):
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()] + ["né ☃x 😀日本語", "a,b. c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    units = sorted({u for t in texts for u in model.units(t) if len(u) <= P.SHORT})
    scores, leads, ids, ends = model.firsts(units)
    begin = 0
    for u, score, lead, end in zip(units, scores, leads, ends):
        assert (score, lead, tuple(ids[begin:end].tolist())) == model.first(u), u
        best = model.search(u, 2)
        assert best[0] == (score, tuple(ids[begin:end].tolist())) and (len(best) == 1 or best[0][0] - best[1][0] == lead)
        begin = end
    assert [len(x) for x in model.firsts([])] == [0] * 4


def test_scores_are_log_probabilities(model):
    import sentencepiece

    assert sum(np.exp(s) for s, _ in model.score.values()) == pytest.approx(1, abs=1e-3)
    text = "the cat sat on the mat, internationalization of words"
    assert model.nbest(text)[0][1] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
