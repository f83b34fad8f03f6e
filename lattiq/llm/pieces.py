"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice of vocabulary pieces (white space as U+2581).  Viterbi, forward, gives the best score of
every position; backward A-star search over the lattice takes it as its heuristic, which is exact, so complete
paths come out in the order of their scores.  Characters that no piece covers are spelled with byte pieces,
each of which costs the least piece score less a penalty.

No piece of the vocabulary has white space after another character (checked when the model is loaded), and
none has most punctuation after a letter, so every path passes those places, and the text falls into units
there.  Units are searched once and cached; the N best paths of the text are the N least sums of the units' gaps,
enumerated by a heap over the N-1 units of least gaps: a path of the N best changes no other unit.

Many units are searched at once: the lattice of all of them is walked by position, and the first solution of each
search, which follows the best arc from every position back (the estimate being exact), is taken for all together.

A BPE model has no probabilities, but its merges are in the order of their frequency; scores are the log-probabilities of
the Zipf-Mandelbrot law, log(1 / (rank + SHIFT)) less the logarithm of their sum, so no tokenizer is trained.  They are
multiples of 2**-16, so sums are exact.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_bytes, ragged, text_bytes

SPACE = "▁"
PENALTY = 10.0
#: Ranks are shifted by so many in the law of their frequencies.
SHIFT = 100
#: Units that a task keeps; they are given up at its end, as a Python worker outlives it.
CACHE_UNITS = 200_000
#: Units searched in one step.
STEP_UNITS = 20_000
#: Bytes of text whose units are searched together.
BATCH_BYTES = 1 << 20
#: Characters of a unit that is searched together with others; longer ones are searched alone.
SHORT = 64
_NO = -1


class Pieces:
    held: dict[tuple[str, int], Pieces] = {}

    def __init__(self, path: str, best: int = 2):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.best = best
        self.score = {self.text[i]: (model.get_score(i), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has white space after another character")
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.plain = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.text)]
        ranks = {p: -v if v > -1e8 else inf for p, (v, _) in self.score.items()}  # symbols that only carry characters have no rank
        last = max(r for r in ranks.values() if r < inf)
        ranks = {p: min(r, last) for p, r in ranks.items()}
        mass = log(sum(1 / (r + SHIFT) for r in ranks.values()))
        self.score = {p: (-round(65536 * (log(ranks[p] + SHIFT) + mass)) / 65536, (i,)) for p, (_, i) in self.score.items()}
        self.byte_score = min(v for v, _ in self.score.values()) - PENALTY
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p))}
        self.cut = self._cutter()
        self.trie = {p: self.score.get(p, (0.0, ())) for p in self.prefixes | self.score.keys()}
        self._index()
        self._clear()

    @classmethod
    def of(cls, path: str, best: int) -> Pieces:
        if (path, best) not in cls.held:
            cls.held[path, best] = cls(path, best)
        return cls.held[path, best]

    def _cutter(self) -> re.Pattern:
        """What a unit is.  Cuts lie where no piece reaches over: before white space after another character,
        before a mark (ASCII punctuation) after a letter or digit that no piece has before any mark, and
        around control characters that no longer piece holds."""
        long = [p for p in self.score if len(p) > 1]
        inside = set("".join(long))
        alone = {c for c in map(chr, range(32)) if c not in inside}
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        before = {a for p in long for a, b in zip(p, p[1:]) if b in marks}
        letters = {c for c in map(chr, range(48, 0x530)) if c.isalnum()} - before
        one, mark, letter = ("".join(map(re.escape, sorted(x))) for x in (alone, marks, letters))
        other = f"[^{SPACE}{one}{mark}{letter}]"
        front = f"[^{SPACE}{one}{letter}]"
        return re.compile(f"{SPACE}*{front}*[{letter}]+(?:{other}{front}*[{letter}]*)*|{SPACE}*{front}+|{SPACE}+" + (f"|[{one}]" if one else ""))

    def _index(self) -> None:
        """The trie as arrays: sorted keys node * kinds + kind of the next character, the nodes they lead to, and the pieces at nodes."""
        chars = sorted({c for p in self.score for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        names = sorted(self.trie, key=len)
        node = {"": 0} | {p: k + 1 for k, p in enumerate(names)}
        self.kinds = len(chars) + 1
        keys = np.array([node[p[:-1]] * self.kinds + int(self.kind[ord(p[-1])]) for p in names], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], (order + 1).astype(np.int32)
        self.piece = np.array([_NO] + [self.score[p][1][0] if p in self.score else _NO for p in names], np.int32)
        self.value = np.array([0.0] + [self.score[p][0] if p in self.score else 0.0 for p in names])

    def units(self, text: str) -> list[str]:
        """The text with a space in front and white space marked, cut at places that every path passes."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def arcs(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position, the (start, score, ids) of the arcs that end there."""
        known, prefixes, n = self.score, self.prefixes, len(unit)
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            for e in range(a + 1, n + 1):
                part = unit[a:e]
                if part in known:
                    s, ids = known[part]
                    out[e].append((a, s, ids))
                if part not in prefixes:
                    break
            if unit[a] not in known:
                s, ids = self.spelled(unit[a])
                out[a + 1].append((a, s, ids))
        return out

    def search(self, unit: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The (score, ids) of the best paths, in falling order, by backward A-star.

        A state is the choice of an arc at a position, given the path behind it; its estimate is exact.  Taking
        a state follows the best arcs to the start, and at each position on the way the next best arc
        becomes a state.
        """
        arcs = self.arcs(unit)
        forward = [0.0]
        for e in range(1, len(unit) + 1):
            forward.append(max([forward[a] + s for a, s, _ in arcs[e]]))
        for e in range(1, len(unit) + 1):
            arcs[e].sort(key=lambda x: -forward[x[0]] - x[1])
        out: list[tuple[float, tuple[int, ...]]] = []
        heap: list = [(-forward[-1], 0, len(unit), 0, 0.0, None)]
        order = 0
        while heap and len(out) < best:
            f, _, at, k, g, path = heappop(heap)
            while at:
                here = arcs[at]
                if k + 1 < len(here):
                    a, s, _ = here[k + 1]
                    order += 1
                    heappush(heap, (-(g + s + forward[a]), order, at, k + 1, g, path))
                at, s, own = here[k]
                g, path, k = g + s, (own, path), 0
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((-f, tuple(ids)))
        return out

    def firsts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first() of many units: scores, leads, all ids one after the other, and where each unit's ids end."""
        if not units:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)
        point = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[point].astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(units)), sizes)
        place = ragged(sizes)
        left = sizes[unit] - place
        # arcs: from each character along the trie
        at, node, k = np.arange(len(point)), np.zeros(len(point), np.int64), 0
        arcs: list[list[np.ndarray]] = [[], [], [], []]  # first character, length, score, piece (or _NO - code point)
        while len(at):
            key = node * self.kinds + kind[at + k]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[where] == key
            found, node = at[hit], self.child[where[hit]].astype(np.int64)
            own = self.piece[node]
            good = own != _NO
            k += 1
            for x, v in zip(arcs, (found[good], np.full(int(good.sum()), k), self.value[node[good]], own[good].astype(np.int64))):
                x.append(v)
            if k == 1:
                alone = np.ones(len(point), bool)
                alone[found[good]] = False
                lone = np.flatnonzero(alone)
                c = point[lone].astype(np.int64)
                width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                for x, v in zip(arcs, (lone, np.ones(len(lone), np.int64), self.byte_score * (width if self.bytes else np.ones(len(c))), _NO - 1 - c)):
                    x.append(v)
            more = left[found] > k
            at, node = found[more], node[more]
        start, size, value, piece = map(np.concatenate, arcs)
        end = place[start] + size
        order = np.lexsort((start, end))  # by end, then unit, then start: of equal ones the earlier start comes first
        start, size, value, piece, end = start[order], size[order], value[order], piece[order], end[order]
        # slots: a unit's positions, from 0 to its length
        slot = start + unit[start]
        into = slot + size
        top, second, back = np.full(len(point) + len(units), -inf), np.full(len(point) + len(units), -inf), np.zeros(len(point) + len(units), np.int64)
        top[begin + np.arange(len(units))] = 0.0
        cuts = np.searchsorted(end, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            v = top[slot[lo:hi]] + value[lo:hi]
            own = into[lo:hi]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            best = np.maximum.reduceat(v, heads)
            width = np.diff(np.append(heads, hi - lo))
            pick = np.minimum.reduceat(np.where(v == np.repeat(best, width), np.arange(hi - lo), hi - lo), heads)
            v[pick] = -inf
            to = own[heads]
            top[to], second[to], back[to] = best, np.maximum.reduceat(v, heads), lo + pick
        last = begin + np.arange(len(units)) + sizes
        lead, steps, whose = np.full(len(units), inf), [], []
        now, live = last.copy(), np.arange(len(units))
        while len(live):
            here = now[live]
            lead[live] = np.minimum(lead[live], top[here] - second[here])
            arc = back[here]
            steps.append(arc)
            whose.append(live)
            now[live] = slot[arc]
            live = live[place[start[arc]] > 0]
        steps, whose = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (steps, whose))
        order = np.lexsort((start[steps], whose))
        ids, whose = piece[steps[order]], whose[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that no piece covers
            spelled = [self.spelled(chr(int(_NO - 1 - ids[x])))[1] for x in odd]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(x) for x in spelled]
            to = np.cumsum(n) - n
            ids, whose = np.repeat(ids, n), np.repeat(whose, n)
            for x, own in zip(to[odd].tolist(), spelled):
                ids[x : x + len(own)] = own
        return top[last], lead, ids.astype(np.int32), np.cumsum(np.bincount(whose, minlength=len(units)))

    def first(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        """(best score, its lead over the second best, ids): forward Viterbi, and the first deviations of the search."""
        n, get = len(unit), self.trie.get
        top, second, back = [-inf] * (n + 1), [-inf] * (n + 1), [None] * (n + 1)
        top[0] = 0.0
        for a in range(n):
            here, alone = top[a], True
            for e in range(a + 1, n + 1):
                hit = get(unit[a:e])
                if hit is None:
                    break
                s, ids = hit
                if ids:
                    if e == a + 1:
                        alone = False
                    v = here + s
                    if v > top[e]:
                        second[e], top[e], back[e] = top[e], v, (a, ids)
                    elif v > second[e]:
                        second[e] = v
            if alone:
                s, ids = self.spelled(unit[a])
                v, e = here + s, a + 1
                if v > top[e]:
                    second[e], top[e], back[e] = top[e], v, (a, ids)
                elif v > second[e]:
                    second[e] = v
        lead, path, at = inf, [], n
        while at:
            d = top[at] - second[at]
            if d < lead:
                lead = d
            at, ids = back[at]
            path.append(ids)
        path.reverse()
        return top[n], lead, tuple(chain.from_iterable(path))

    def spelled(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character that no piece covers."""
        data = char.encode("utf-8", "replace")
        ids = tuple(self.bytes[b] for b in data) if self.bytes else (self.unknown,)
        return self.byte_score * len(ids), ids

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.top, self.lead, self.start, self.flat = array("d"), array("d"), array("q", [0]), array("i")

    def _learn(self, new: set[str]) -> None:
        short = [u for u in new if len(u) <= SHORT]
        for s in range(0, len(short), STEP_UNITS):
            part = short[s : s + STEP_UNITS]
            score, lead, ids, ends = self.firsts(part)
            self.place.update(zip(part, range(len(self.top), len(self.top) + len(part))))
            base = len(self.flat)
            self.top.frombytes(score.tobytes())
            self.lead.frombytes(lead.tobytes())
            self.flat.frombytes(ids.tobytes())
            self.start.frombytes((base + ends).astype(np.int64).tobytes())
        for u in new:
            if len(u) > SHORT:
                score, lead, ids = self.first(u)
                self.place[u] = len(self.top)
                self.top.append(score)
                self.lead.append(lead)
                self.flat.extend(ids)
                self.start.append(len(self.flat))

    def prepared(self, texts: list[str]) -> list[list[str]]:
        """The units of some texts, all of which are then known."""
        parts = [self.units(t) for t in texts]
        new = set().union(*parts).difference(self.place)
        if new:
            if len(self.place) + len(new) > CACHE_UNITS:
                self._clear()
                new = set().union(*parts)
            self._learn(new)
        return parts

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The best segmentations of a whole text: (score, ids) in falling order; an empty text has one, empty."""
        return [(score, ids.tolist()) for score, ids, _ in self.paths(text)]

    def paths(self, text: str, parts: list[str] | None = None) -> Iterator[tuple[float, np.ndarray, bytes]]:
        """(score, ids, the bytes of all ids) of the best segmentations in falling order, each built when it is asked for.

        parts: the text's units if they are prepared.
        """
        parts = self.prepared([text])[0] if parts is None else parts
        total, ids, leads, ends = self.best_path(parts)
        data = self.joined(ids.tolist())
        yield total, ids, data
        if self.best > 1 and parts:
            yield from self.others(total, ids, data, leads, parts, ends)

    def best_path(self, parts: list[str]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(score, ids, the units' leads, where each one's ids end) of the best segmentation of prepared units."""
        if not parts:
            return 0.0, np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        k = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        start = np.frombuffer(self.start, np.int64)
        at = start[k]
        n = start[k + 1] - at
        ends = np.cumsum(n)
        ids = np.frombuffer(self.flat, np.int32)[np.arange(ends[-1]) + np.repeat(at - (ends - n), n)]
        return float(np.frombuffer(self.top)[k].sum()), ids, np.frombuffer(self.lead)[k], ends

    def others(self, total: float, ids: np.ndarray, data: bytes, leads: np.ndarray, parts: list[str], ends: np.ndarray) -> Iterator[tuple[float, np.ndarray, bytes]]:
        """The segmentations after the best one, from the units of least lead (of equal leads, the first in the text)."""
        wanted = self.best - 1
        near = np.flatnonzero(leads <= np.partition(leads, min(wanted, len(leads)) - 1)[min(wanted, len(leads)) - 1])
        near = near[np.argsort(leads[near], kind="stable")][:wanted]
        gaps = [(float(leads[k]), int(k)) for k in near if leads[k] < inf]
        found_of = {k: self.search(parts[k], self.best) for _, k in gaps}
        made = 0
        # least sums: a state changes some of these units; a step worsens its last one or brings in a later one
        heap = [(g, ((k, 1),), 0) for g, k in gaps[:1]]
        while heap and made < wanted:
            gap, change, x = heappop(heap)
            spliced, at, same = [], 0, True
            for k, j in sorted(change):
                own, begin = found_of[k][j][1], ends[k - 1] if k else 0
                spliced += [ids[at:begin], np.array(own, np.int32)]
                at = ends[k]
                same = same and self.joined(own) == self.joined(ids[begin:at].tolist())
            path = np.concatenate([*spliced, ids[at:]])
            yield total - gap, path, data if same else self.joined(path.tolist())
            made += 1
            k, j = change[-1]
            found = found_of[k]
            if j + 1 < len(found):
                heappush(heap, (gap + found[j][0] - found[j + 1][0], (*change[:-1], (k, j + 1)), x))
            if x + 1 < len(gaps):
                g, later = gaps[x + 1]
                heappush(heap, (gap + g, (*change, (later, 1)), x + 1))
                if j == 1:
                    heappush(heap, (gap - gaps[x][0] + g, (*change[:-1], (later, 1)), x + 1))

    def joined(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.plain.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.plain_text(self.joined(ids))

    @staticmethod
    def plain_text(data: bytes) -> str:
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _encode(path: str, best: int, keep: str):
    kinds = {"all": pa.list_(pa.list_(pa.int32())), "first": pa.list_(pa.int32())}
    of_path = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        model = Pieces.of(path, best)
        try:
            for b in batches:
                texts = [t or b"" for t in text_bytes(b.column("text"))]
                names = [c for c in b.schema.names if c != "text"]
                for s, e in by_bytes(texts, BATCH_BYTES):
                    scores, paths, kept = [], [], []
                    whole = [t.decode("utf-8", "replace") for t in texts[s:e]]
                    for text, parts in zip(whole, model.prepared(whole)):
                        sums, digests, held, before, good = [], [], [], None, False
                        for score, ids, data in model.paths(text, parts):
                            if data is not before:
                                before, good = data, model.plain_text(data) == text
                            sums.append(score)
                            digests.append({"n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.astype("<i4", copy=False)), "round_trip": good})
                            if keep == "all" or (keep == "first" and not held):
                                held.append(ids)
                        scores.append(sums)
                        paths.append(digests)
                        if keep != "none":
                            kept.append(held if keep == "all" else held[0])
                    more = [pa.array(kept, kinds[keep])] if keep != "none" else []
                    own = [b.column(c).slice(s, e - s) for c in names]
                    first = [pa.array([p[0][c] for p in paths], of_path.field(c).type) for c in ("n_pieces", "ids_crc32", "round_trip")]
                    yield pa.RecordBatch.from_arrays(
                        [*own, *first[:2], pa.array(scores, pa.list_(pa.float64())), *more, first[2], pa.array(paths, pa.list_(of_path))],
                        [*names, "n_pieces", "ids_crc32", "scores", *["ids"] * len(more), "round_trip", "paths"],
                    )
        finally:
            model._clear()

    return run


def encode(documents: DataFrame, path: str, best: int = 2, paths: str = "all") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, scores, ids, round_trip, paths of each row's text.

    scores: those of the best segmentations, in falling order.  paths: of each one, in the same order, n_pieces,
    ids_crc32 (little-endian 32-bit ids) and round_trip (decoding its ids gives the text), from its ids in full;
    n_pieces, ids_crc32 and round_trip beside it are the first one's.  ids: each one's ids (paths="all"), the
    ids of the first (paths="first"), or no such column (paths="none": they are built but don't leave the
    worker).  A null text is an empty one (one segmentation, no pieces); repeated rows are encoded each; ties
    keep the search's fixed order; other columns are ignored; no rows give no rows.
    """
    ids = {"all": "ids array<array<int>>, ", "first": "ids array<int>, ", "none": ""}[paths]
    of_path = "paths array<struct<n_pieces:bigint,ids_crc32:bigint,round_trip:boolean>>"
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string(f"n_pieces long, ids_crc32 long, scores array<double>, {ids}round_trip boolean, {of_path}").fields])
    return documents.select("doc_id", "text").mapInArrow(_encode(path, best, paths), schema)
