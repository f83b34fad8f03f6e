"""Language identification: script ranges narrow the candidates, Viterbi labels each word.

A word (a run of letters) scores for each language by the log-probabilities of its byte trigrams; languages
whose training text doesn't use the word's scripts, by code point, are out (scripts that aren't listed share one bit).  Viterbi over the words, with a penalty for each
switch, labels spans of mixed-language text.  Texts are cut into segments only for speed: a segment's
transfer matrix (best score from each state before it to each state at its end) makes the result that of
one walk over the whole text.

Training reads a bounded sample of labelled rows, at most ``ROWS_A_LANGUAGE`` of each language (about, by a
hash of doc_id); its counts are summed in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, text_bytes

ROWS_A_LANGUAGE = 4000
SWITCH = 9.0
BUCKETS = 1 << 15
SEGMENT = 512
#: Score of a word in a language whose scripts it isn't in: beyond what trigrams or switches can make up for.
_OUT = np.float32(-10_000.0)
#: Unicode ranges of scripts, from first to last code point; each script is a bit.
SCRIPTS = (
    ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),  # Latin
    ((0x370, 0x3FF), (0x1F00, 0x1FFF)),  # Greek
    ((0x400, 0x52F),),  # Cyrillic
    ((0x530, 0x58F), (0x10A0, 0x10FF)),  # Armenian, Georgian
    ((0x590, 0x5FF),),  # Hebrew
    ((0x600, 0x77F),),  # Arabic
    ((0x900, 0xDFF),),  # Indic
    ((0xE00, 0xEFF),),  # Thai, Lao
    ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),  # Hangul
    ((0x3040, 0x30FF),),  # Kana
    ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),  # Han
)

#: The bit of letters of all other scripts, exact by code point.
OTHER = len(SCRIPTS)
KINDS = OTHER + 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-casing word bytes or 0, script bits by the two bytes of a character of one or two, script bits by code point)."""
    low = np.zeros(256, np.uint8)
    low[128:] = np.arange(128, 256)
    for c in range(65, 91):
        low[c] = low[c + 32] = c + 32
    letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    points = np.where(letters, np.uint16(1 << OTHER), np.uint16(0))
    for k, ranges in enumerate(SCRIPTS):
        for a, b in ranges:
            points[a : b + 1] = np.where(letters[a : b + 1], np.uint16(1 << k), np.uint16(0))
    bits = np.zeros(65536, np.uint16)
    for c in range(0x800):
        e = chr(c).encode()
        if len(e) == 1:
            bits[e[0] << 8 : (e[0] + 1) << 8] = points[c]
        else:
            bits[e[0] << 8 | e[1]] = points[c]
    return low, bits, points


_LOW, _SCRIPT, _POINTS = _tables()


class Words:
    """Words of a run of texts: byte starts and ends, text of each, trigram codes and script bits of each byte."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        b = _LOW[raw]
        upper = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        b[1:][upper] += 0x20
        self.scripts = _SCRIPT[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        at = np.flatnonzero(raw[:-2] >= 0xE0)  # first bytes of characters of three and four bytes
        if len(at):
            c = np.zeros((4, len(at)), np.int32)
            for k in range(4):
                c[k] = raw[np.minimum(at + k, len(raw) - 1)]
            three = (c[0] & 0x0F) << 12 | (c[1] & 0x3F) << 6 | c[2] & 0x3F
            four = (c[0] & 0x07) << 18 | (c[1] & 0x3F) << 12 | (c[2] & 0x3F) << 6 | c[3] & 0x3F
            point = np.where(c[0] < 0xF0, three, np.minimum(four, 0x10FFFF))
            self.scripts[at] = _POINTS[point]
        inside = b[:-1] > 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        x = b.astype(np.uint32)
        code = (x[:-1] << 8) | x[1:]
        code[1:] |= x[:-2] << 16
        self.codes = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
        self.codes[~inside] = BUCKETS
        self.text = np.searchsorted(self.first, self.starts, side="right") - 1
        if len(self.starts):
            self.bits = np.bitwise_or.reduceat(self.scripts, self.starts)
            # characters, for weights: bytes that don't continue a character
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            self.letters = lead[self.ends] - lead[self.starts]
            some = self.bits > 0  # a run without any letter is no word
            self.keep = np.flatnonzero(some)
        else:
            self.bits, self.letters, self.keep = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _count(batches):
    for b in batches:
        texts = [t or b"" for t in text_bytes(b.column("text"))]
        langs = np.array(b.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = [t for t, x in zip(texts, langs) if x == lang]
            grams, scripts = np.zeros(BUCKETS + 1, np.int64), np.zeros(KINDS, np.int64)
            for s, e in by_bytes(own):
                w = Words(own[s:e])
                grams += np.bincount(w.codes, minlength=BUCKETS + 1)
                scripts += [(int(((w.scripts >> k) & 1).sum())) for k in range(KINDS)]
            at = np.flatnonzero(grams[:BUCKETS])
            sc = np.flatnonzero(scripts)
            keys = np.concatenate([at, -1 - sc])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(np.concatenate([grams[at], scripts[sc]]))], ["lang", "key", "n"])


class Model:
    """langs (sorted), log-probabilities of the trigram buckets, and what each set of scripts rules out."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = grams + 0.3
        self.logp = np.zeros((len(langs), BUCKETS + 1), np.float32)
        if langs:
            self.logp[:, :BUCKETS] = np.log(p / p.sum(axis=1, keepdims=True))
            self.logp[:, :BUCKETS] -= self.logp[:, :BUCKETS].max(axis=0)  # only differences count
        uses = scripts > 0.005 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        own = (uses * (1 << np.arange(KINDS))).sum(axis=1) if langs else np.zeros(0, np.int64)
        sets = np.arange(1 << KINDS)[:, None]
        whole, part = (sets & own) == sets, (sets & own) > 0
        ok = np.where(whole.any(axis=1, keepdims=True), whole, np.where(part.any(axis=1, keepdims=True), part, True)) if langs else np.zeros((len(sets), 0), bool)
        self.known = part.any(axis=1)  # sets of scripts of which any language uses one
        self.rule = np.where(ok, np.float32(0), _OUT)


def train(labelled: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """A model of labelled(doc_id, text, lang); rows without a language or text don't count."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, KINDS)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, rows_a_language * (1 << 20) // n))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()  # at most (BUCKETS + scripts) rows a language
    langs = sorted(set(counts.column("lang").to_pylist()))
    row = np.array([langs.index(x) for x in counts.column("lang").to_pylist()], np.int64)
    key, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    grams, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), KINDS))
    grams[row[key >= 0], key[key >= 0]] = n[key >= 0]
    scripts[row[key < 0], -1 - key[key < 0]] = n[key < 0]
    return Model(langs, grams, scripts)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float, segment: int = SEGMENT) -> np.ndarray:
    """The best label of every row of scores; sizes: rows of each sequence, one after the other; ties go to the lower label."""
    n, m = scores.shape
    sizes = sizes[sizes > 0]
    if not n:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // segment)
    seq = np.repeat(np.arange(len(sizes)), parts)
    ordinal = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[seq] + ordinal * segment
    length = np.minimum(segment, first[seq] + sizes[seq] - start)
    by = np.argsort(-length, kind="stable")
    start, length, seq, ordinal = start[by], length[by], seq[by], ordinal[by]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    active = np.searchsorted(-length, -np.arange(int(length[0])) - 1, side="right")  # segments longer than t
    head = np.cumsum(parts) - parts
    before = np.zeros((len(start), m), np.float32)  # best score of each state before the segment
    exit_from = np.zeros((len(start), m), np.int64)
    if parts.max() > 1:
        long = parts[seq] > 1
        lidx = np.flatnonzero(long)
        tr = np.full((len(lidx), m, m), np.float32(-1e30))
        tr[:, np.arange(m), np.arange(m)] = 0
        llen, lst, lord = length[lidx], start[lidx], ordinal[lidx]
        for t in range(int(llen[0])):
            k = int(np.searchsorted(-llen, -t - 1, side="right"))
            v = tr[:k]
            step = np.maximum(v, v.max(axis=2, keepdims=True) - np.float32(switch))
            if t == 0:  # nothing is paid before a sequence's first row
                step = np.where((lord[:k] == 0)[:, None, None], np.float32(0), step)
            tr[:k] = step + scores[lst[:k] + t][:, None, :]
        where = np.full(len(start), -1)
        where[lidx] = np.arange(len(lidx))
        for o in range(int(parts.max())):
            s = np.flatnonzero((parts > o) & (parts > 1))
            cur = place[head[s] + o]
            total = before[cur][:, :, None] + tr[where[cur]]
            exit_from[cur] = total.argmax(axis=1)
            more = parts[s] > o + 1
            after = total[more].max(axis=1)
            before[place[head[s[more]] + o + 1]] = after - after.max(axis=1, keepdims=True)
    stay = np.zeros((n, m), bool)
    best = np.zeros(n, np.int64)
    v = before.copy()
    for t in range(int(length[0])):
        k = int(active[t])
        at = start[:k] + t
        top = v[:k].argmax(axis=1)
        jump = v[np.arange(k), top][:, None] - np.float32(switch)
        keep = v[:k] >= jump
        new = np.where(keep, v[:k], jump)
        if t == 0:
            new = np.where((ordinal[:k] == 0)[:, None], np.float32(0), new)
        best[at], stay[at] = top, keep
        v[:k] = new + scores[at]
        if t % 64 == 63:
            v[:k] -= v[:k].max(axis=1, keepdims=True)
    state = np.zeros(len(start), np.int64)
    last = place[head + parts - 1]
    state[last] = v[last].argmax(axis=1)
    for o in range(int(parts.max()) - 2, -1, -1):
        s = np.flatnonzero(parts > o + 1)
        cur, nxt = place[head[s] + o], place[head[s] + o + 1]
        state[cur] = exit_from[nxt, state[nxt]]
    labels = np.empty(n, np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        k = int(active[t])
        at = start[:k] + t
        labels[at] = state[:k]
        state[:k] = np.where(stay[at, state[:k]], state[:k], best[at])
    return labels


def label_texts(texts: list[bytes], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of letters with it, spans (first byte, byte after the last, language)) of each text."""
    w = Words(texts)
    n, m = len(texts), len(model.langs)
    out: list = [("und", 0.0, [])] * n
    if not m:
        return out
    keep = w.keep
    share, total = np.zeros((n, m)), np.zeros(n)
    spans: list[list] = [[] for _ in range(n)]
    if len(keep):
        begins = w.starts
        scores = np.stack([np.add.reduceat(model.logp[x][w.codes], begins) for x in range(m)], axis=1)[keep] + model.rule[w.bits[keep]]
        text = w.text[keep]
        labels = viterbi(scores.astype(np.float32), np.bincount(text, minlength=n), switch)
        np.add.at(share, (text, labels), np.where(model.known[w.bits[keep]], w.letters[keep], 0))
        np.add.at(total, text, w.letters[keep])
        change = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        until = np.append(change[1:], len(labels)) - 1
        base = w.first[text[change]]
        for i, a, b, x in zip(text[change].tolist(), (begins[keep][change] - base).tolist(), (w.ends[keep][until] - base).tolist(), labels[change].tolist()):
            spans[i].append((a, b, model.langs[x]))
    for i in range(n):
        if total[i]:
            k = int(share[i].argmax())
            out[i] = (model.langs[k], float(share[i, k] / total[i]), spans[i])
    return out


def _detect(model: Model, switch: float):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in text_bytes(b.column("text"))]
            found = []
            for s, e in by_bytes(texts):
                found += label_texts(texts[s:e], model, switch)
            flat = [x for _, _, spans in found for x in spans]
            parts = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.string())], ["from", "to", "lang"])
            offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in found])]).astype(np.int32)
            own = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in own], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), parts)],
                [*own, "lang_pred", "score", "spans"],
            )

    return run


SPANS = "array<struct<from:bigint,to:bigint,lang:string>>"


def detect(documents: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans for each row: the language of most letters, its share of them, and labelled byte ranges.

    ``und`` (score 0, no spans) for a null text, one without a letter, or a model without languages; words
    in scripts that no language of the model uses count among the letters only.  Ties go to the first language in
    alphabetical order; repeated rows are labelled each; other columns are ignored; no rows give no rows.
    """
    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *T._parse_datatype_string(f"spans {SPANS}").fields])
    return documents.select("doc_id", "text").mapInArrow(_detect(model, switch), schema)


def _accepted(model: Model, least: float, switch: float):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in text_bytes(b.column("text"))]
            good = [lang != "und" and score >= least for s, e in by_bytes(texts) for lang, score, _ in label_texts(texts[s:e], model, switch)]
            yield b.filter(pa.array(good, pa.bool_()))

    return run


def accept(documents: DataFrame, model: Model, least: float, switch: float = SWITCH) -> DataFrame:
    """The rows of documents that have a language holding at least ``least`` of their letters, with all their columns.

    Rows with a null text, or one without letters, go; without a model all go; repeated rows share a fate.
    """
    return documents.mapInArrow(_accepted(model, least, switch), documents.schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out from training."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
