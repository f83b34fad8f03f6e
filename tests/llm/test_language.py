import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm.common import table
from lattiq.llm.language import OTHER, SCRIPTS, SWITCH, detect, fold, train, viterbi

SF = "/root/testdata/sf0.001"


def path_score(scores, labels, switch):
    return sum(scores[i, x] for i, x in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


def best_score(scores, switch):
    v = scores[0].copy()
    for s in scores[1:]:
        v = s + np.maximum(v, v.max() - switch)
    return v.max()


@pytest.mark.parametrize("segment", [3, 7, 512])
def test_viterbi_against_dynamic_programming(segment):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 0, 5, 40, 700, 3, 13, 0, 6])
    scores = (rng.normal(size=(sizes.sum(), 3)) * 4).astype(np.float32)
    labels = viterbi(scores, sizes, 5.0, segment)
    at = 0
    for n in sizes:
        if n:
            own = scores[at : at + n].astype(float)
            assert path_score(own, labels[at : at + n], 5.0) == pytest.approx(best_score(own, 5.0), abs=1e-2)
        at += n


@pytest.fixture(scope="module")
def model(spark):
    return train(table(spark, SF, "documents").where(fold() != 2))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents")
    got = detect(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold() == 2)
    n, good = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert good / n > 0.95


def test_edges_and_mixed_text(spark, model):
    docs = {r.lang: r.text for r in table(spark, SF, "documents").where("n_chars > 600").collect()}
    mixed = docs["en"][:400] + " " + docs["de"][:400]
    rows = [(1, None, 0), (2, "", 0), (3, "12 34 !?", 0), (None, docs["fr"], 0), (5, mixed, 0), (5, mixed, 0), (6, docs["es"] * 200, 0), (7, "Это", 0)]
    got = detect(spark.createDataFrame(rows, "doc_id long, text string, lang_pred int"), model).collect()
    assert [r.lang_pred for r in got[:4]] == ["und", "und", "und", "fr"]
    assert got[4] == got[5] and [s.lang for s in got[4].spans] == ["en", "de"]
    assert got[6].lang_pred == "es" and got[7].lang_pred != "und"
    assert detect(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_no_labelled_rows(spark):
    empty = train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert detect(spark.createDataFrame([(1, "words")], "doc_id long, text string"), empty).first().lang_pred == "und"


SCRIPTLESS = {"am": "ሰላም ለዓለም ሁሉ ይሁን እንዴት ነህ ደህና ነኝ", "km": "សួស្តី ពិភពលោក តើ អ្នក សុខសប្បាយ ទេ", "my": "မင်္ဂလာပါ ကမ္ဘာ နေကောင်းလား ကျေးဇူးတင်ပါတယ်", "bo": "བཀྲ་ཤིས་བདེ་ལེགས། ཁྱེད་རང་", "chr": "ᎣᏏᏲ ᎡᎶᎯ ᏙᎯᏧ", "got": "𐌰𐌱𐌲𐌳 𐌴𐌵𐌶𐌷", "dv": "ދިވެހި ބަސް", "en": "hello world how are you"}


def test_scripts_that_are_not_listed(spark):
    rows = [(i, t, k) for k, t in SCRIPTLESS.items() for i in range(3)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(SCRIPTLESS)
    got = detect(spark.createDataFrame([(i, t) for i, t in enumerate(SCRIPTLESS.values())], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == list(SCRIPTLESS) and all(r.score == 1 for r in got)
    signs = detect(spark.createDataFrame([(1, "— … € 😀 12"), (2, "😀")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in signs] == ["und", "und"]


def test_script_of_no_language_has_no_share(spark, model):
    got = detect(spark.createDataFrame([(1, SCRIPTLESS["km"]), (2, SCRIPTLESS["en"])], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in sorted(got, key=lambda r: r.doc_id)][0] == (model.langs[0], 0.0) and max(r.score for r in got) > 0.3


@pytest.mark.parametrize("text", ["฿", "・・・", "१२३", "٣٤", "๔๒", "़", "〇 ー"[:1]])
def test_signs_and_digits_of_scripts_are_no_letters(spark, model, text):
    assert (not any(c.isalpha() for c in text)) == (detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().lang_pred == "und")


def test_scripts_rule_languages_out(spark):
    rows = [(1, "привет мир как дела сегодня", "ru"), (2, "hello world how are you today", "en")] * 3
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "мир" * 3 + "цщъыэюяжзф" * 40  # seen in no training text, so that every trigram is as unlikely
    got = detect(spark.createDataFrame([(1, long + " hello " + long)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "ru" and [s.lang for s in got.spans] == ["ru", "en", "ru"]


def brute(text, model, switch):
    """One word, one language and one step at a time: (language, share of letters, 'und' where there are none)."""
    data = (text or "").encode()
    low = lambda i: data[i] + 32 if 65 <= data[i] <= 90 or (0x80 <= data[i] <= 0x9E and data[i] != 0x97 and i and data[i - 1] == 0xC3) else data[i]
    at = lambda i: low(i) if 0 <= i < len(data) and (data[i] >= 128 or chr(data[i]).isalpha()) else 0
    scores, sizes, known = [], [], []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+", data):
        word = m[0].decode()
        kinds = {next((k for k, rs in enumerate(SCRIPTS) if any(a <= ord(c) <= b for a, b in rs)), OTHER) for c in word if c.isalpha()}
        if not kinds:
            continue
        grams = [((at(i - 1) << 16 | at(i) << 8 | at(i + 1)) * 0x9E3779B1 % (1 << 32)) >> 17 for i in range(m.start(), m.end())]
        bits = sum(1 << k for k in kinds)
        scores.append([sum(float(model.logp[x][g]) for g in grams) + float(model.rule[bits][x]) for x in range(len(model.langs))])
        sizes.append(len(word))
        known.append(bool(model.known[bits]))
    if not scores:
        return "und", 0.0
    v, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(len(v)), key=lambda x: v[x])
        back.append([x if v[x] >= v[top] - switch else top for x in range(len(v))])
        v = [max(v[x], v[top] - switch) + s[x] for x in range(len(v))]
    x = max(range(len(v)), key=lambda x: v[x])
    labels = [x]
    for b in reversed(back):
        labels.append(x := b[x])
    labels.reverse()
    share = [sum(n for n, y, k in zip(sizes, labels, known) if y == x and k) for x in range(len(v))]
    best = max(range(len(v)), key=lambda x: share[x])
    return model.langs[best], share[best] / sum(sizes)


def test_whole_table_against_one_word_at_a_time(spark, model):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").where("n_chars < 6000").collect()] + [(-1, None), (-2, "Ça và ÉTÉ straße Это ฿ word"), (-3, "१२३")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in detect(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert len(docs) > 100
    for doc_id, text in docs:
        lang, score = brute(text, model, SWITCH)
        assert got[doc_id] == (lang, pytest.approx(score)), doc_id
