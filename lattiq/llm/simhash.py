"""SimHash near-duplicates: 64-bit fingerprints, joined with themselves by a binary trie.

The join walks pairs of trie nodes together from the top bit, adds the bits in which the two nodes'
prefixes differ, and drops a pair as soon as its error budget is exceeded.  Two walks cover all links
once each: at most ``BUDGET`` differing bits leave at most half of them in one half of the word, so one
walk starts with the high half under a budget of 2, the other with the low half under a budget of 1 and
keeps the links whose high half differs in 3 bits or more.

Spark's part: the trie's crown is counted level by level, only crowded nodes deeper, until every leaf of it holds
at most ``chunk`` distinct fingerprints (64 bits tell them apart, so that ends); at 2**MOST_LEAVES leaves or more
chunk grows with the table instead.  The driver walks pairs of leaves under the budget as the tasks do below
them, and each pair of leaves that stays is a task.  Copies are never expanded: a fingerprint carries how many rows have it, and a task returns,
for each fingerprint with links, the number of linked rows and a root of its local spanning forest.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, ragged, text_bytes, written
from .components import components

BUDGET = 4
SEED = 42
#: Distinct fingerprints of one side of a task at most; it only decides how the work is cut.
CHUNK = 16384
#: Leaves of the crown, about, as a power of two: what the driver holds of it.
MOST_LEAVES = 14
_HALF = ((0, 2), (1, 1))  # (walk, budget of its first half)
_FLUSH = 32
_BITS = 1 << 16


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text's 4-word shingles (fewer words: of all of them; none: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= 4:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-4] + 1]).tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[3:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BITS):
        h = np.array(hashes[i : i + _BITS], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        prints = np.array([fingerprint(t or b"") for t in text_bytes(b.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _turn(fp: np.ndarray, walk: int) -> np.ndarray:
    """The word with the half first that the walk starts with."""
    return fp if walk == 0 else (fp << np.uint64(32)) | (fp >> np.uint64(32))


def trie_pairs(a: np.ndarray, b: np.ndarray, same: bool, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted, turned words a[i], b[j] that this walk links; same: a is b, i < j."""
    first = dict(_HALF)[walk]
    low = np.uint64(0xFFFFFFFF)
    found_i, found_j = [], []
    alo, ahi, blo, bhi = (np.array([x], np.int64) for x in (0, len(a), 0, len(b)))
    dist, own = np.zeros(1, np.int8), np.array([same])
    for depth in range(65):
        flush = ((ahi - alo) * (bhi - blo) <= _FLUSH) | (depth == 64)
        if flush.any():
            na, nb = (ahi - alo)[flush], (bhi - blo)[flush]
            k = ragged(na * nb)
            n = na * nb
            width = np.repeat(nb, n)
            i, j = np.repeat(alo[flush], n) + k // width, np.repeat(blo[flush], n) + k % width
            keep = ~np.repeat(own[flush], n) | (i < j)
            i, j = i[keep], j[keep]
            x = a[i] ^ b[j]
            top, rest = np.bitwise_count(x >> np.uint64(32)), np.bitwise_count(x & low)
            ok = (top <= first) & (top + rest <= BUDGET)
            if walk:
                ok &= rest >= 3
            found_i.append(i[ok])
            found_j.append(j[ok])
            alo, ahi, blo, bhi, dist, own = (v[~flush] for v in (alo, ahi, blo, bhi, dist, own))
        if not len(alo):
            break
        bit = np.uint64(63 - depth)
        za, zb = (np.concatenate([[0], np.cumsum((x >> bit) & np.uint64(1) == 0)]) for x in (a, b))
        am, bm = alo + za[ahi] - za[alo], blo + zb[bhi] - zb[blo]
        budget = first if depth < 32 else BUDGET
        parts = []
        for l1, h1, l2, h2, differ, mine in ((alo, am, blo, bm, 0, own), (am, ahi, bm, bhi, 0, own), (alo, am, bm, bhi, 1, None), (am, ahi, blo, bm, 1, None)):
            go = (h1 > l1) & (h2 > l2) & (dist + differ <= budget)
            if mine is None and differ and l1 is am:
                go &= ~own  # the mirror image of the pair before
            parts.append((l1[go], h1[go], l2[go], h2[go], dist[go] + np.int8(differ), own[go] if mine is not None else np.zeros(int(go.sum()), bool)))
        alo, ahi, blo, bhi, dist, own = (np.concatenate(x) for x in zip(*parts))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(found_i), cat(found_j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _leaves(prints: DataFrame, walk: int, n: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, depth) of the crown's leaves, in the order of the words; none holds more than chunk fingerprints.

    Only crowded nodes are counted deeper, so at most n / chunk nodes a level come to the driver, 16 children each.
    """
    word = F.col("fp") if walk == 0 else F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    depth = min(MOST_LEAVES, max(4, ceil(log2(max(n, 1) / chunk))))
    rows = prints.select(word.alias("word"))
    starts, depths = [], []
    while True:
        found = rows.groupBy(F.shiftrightunsigned("word", 64 - depth).alias("top")).count().toArrow()
        top, held = found.column("top").to_numpy().view(np.uint64), found.column("count").to_numpy()
        done = held <= chunk
        starts.append(top[done] << np.uint64(64 - depth))
        depths.append(np.full(int(done.sum()), depth))
        crowded = top[~done]
        if not len(crowded):
            break
        names = rows.sparkSession.createDataFrame(pa.table({"__crowded": pa.array(np.sort(crowded).view(np.int64))}))
        rows = rows.join(F.broadcast(names), F.shiftrightunsigned("word", 64 - depth) == F.col("__crowded"), "left_semi")  # at most n / chunk numbers
        depth = min(depth + 4, 64)
    first, deep = np.concatenate(starts), np.concatenate(depths)
    order = np.argsort(first)
    return first[order], deep[order]


def _pairs(first: np.ndarray, deep: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf the others that it is paired with (itself too), one after the other, and where each leaf's begin.

    Two leaves are walked together from the root as words are; what they have in common is as deep as the shallower.
    """
    budget = dict(_HALF)[walk]
    i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(first):
        return j, np.zeros(1, np.int64)
    lo, hi, left, right, dist = (np.array([x], np.int64) for x in (0, len(first), 0, len(first), 0))
    for depth in range(65):
        whole = ((hi - lo == 1) & (deep[lo] <= depth)) | ((right - left == 1) & (deep[left] <= depth))  # one of them is a leaf
        if whole.any():
            na, nb = (hi - lo)[whole], (right - left)[whole]
            k, width = ragged(na * nb), np.repeat(nb, na * nb)
            i = np.concatenate([i, np.repeat(lo[whole], na * nb) + k // width])
            j = np.concatenate([j, np.repeat(left[whole], na * nb) + k % width])
            lo, hi, left, right, dist = (v[~whole] for v in (lo, hi, left, right, dist))
        if not len(lo):
            break
        zero = np.concatenate([[0], np.cumsum((first >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        m, w = lo + zero[hi] - zero[lo], left + zero[right] - zero[left]
        most = budget if depth < 32 else BUDGET
        parts = []
        for l1, h1, l2, h2, differ in ((lo, m, left, w, 0), (m, hi, w, right, 0), (lo, m, w, right, 1), (m, hi, left, w, 1)):
            go = (h1 > l1) & (h2 > l2) & (dist + differ <= most)
            parts.append((l1[go], h1[go], l2[go], h2[go], dist[go] + differ))
        lo, hi, left, right, dist = (np.concatenate(x) for x in zip(*parts))
    x, y = first[i], first[j]
    common = np.minimum(deep[i], deep[j])
    differ = np.bitwise_count((x ^ y) >> (np.uint64(64) - common.astype(np.uint64))) if len(i) else np.zeros(0)
    top = np.bitwise_count((x ^ y) >> (np.uint64(64) - np.minimum(common, 32).astype(np.uint64))) if len(i) else np.zeros(0)
    keep = (top <= budget) & (differ <= BUDGET)
    order = np.lexsort((j[keep], i[keep]))
    return j[keep][order], np.concatenate([[0], np.cumsum(np.bincount(i[keep], minlength=len(first)))])


def _spread(crowns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """mapInArrow function: a row for each task that a fingerprint takes part in."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rows = b.column("rows").to_numpy(zero_copy_only=False)
            for w, (first, other, begin) in enumerate(crowns):
                own = np.searchsorted(first, _turn(fp, w), side="right") - 1
                n = begin[own + 1] - begin[own]
                at = np.repeat(np.arange(len(fp)), n)
                theirs = other[np.repeat(begin[own], n) + ragged(n)]
                mine = own[at]
                key = (w << 62) | (np.minimum(mine, theirs) << 31) | np.maximum(mine, theirs)
                swap = mine > theirs
                for s in range(0, len(key), 1 << 18):
                    e = slice(s, s + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(key[e]), pa.array(swap[e]), pa.array(fp[at[e]].view(np.int64)), pa.array(rows[at[e]])], ["task", "right", "fp", "rows"])

    return run


def _task(key, t):
    k = key[0].as_py()
    walk, same = k >> 62 & 1, k >> 31 & 0x7FFFFFFF == k & 0x7FFFFFFF
    fp = t.column("fp").to_numpy().view(np.uint64)
    rows, right = t.column("rows").to_numpy(), t.column("right").to_numpy(zero_copy_only=False).astype(bool)
    turned = _turn(fp, walk)
    sides = []
    for side in (False, True):
        at = np.flatnonzero(right == side)
        sides.append(at[np.argsort(turned[at])])
    a, b = sides[0], sides[0] if same else sides[1]
    i, j = trie_pairs(turned[a], turned[b], same, walk)
    i, j = a[i], b[j]
    near = np.bincount(i, rows[j], len(fp)) + np.bincount(j, rows[i], len(fp)) if len(i) else np.zeros(len(fp))
    linked = np.flatnonzero(near > 0)
    root = _roots(len(fp), i, j)
    return pa.table({"fp": pa.array(fp[linked].view(np.int64)), "near": pa.array(near[linked].astype(np.int64)), "root": pa.array(fp[root[linked]].view(np.int64))})


def links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fp, near, root) partial rows: linked rows found in a task and the root of its local forest.

    prints(fp, rows) holds distinct fingerprints and the number of rows that have each.
    """
    n = prints.count()
    chunk = max(chunk, n >> MOST_LEAVES)
    crowns = []
    for walk, _ in _HALF:
        first, deep = _leaves(prints, walk, n, chunk)
        crowns.append((first, *_pairs(first, deep, walk)))
    spread = prints.mapInArrow(_spread(crowns), "task long, right boolean, fp long, rows long")
    return spread.groupBy("task").applyInArrow(_task, "fp long, near long, root long")


def _linked(docs: DataFrame, chunk: int) -> DataFrame:
    """(fp, n_near, component_id, root) for each distinct fingerprint of docs(doc_id, fp); root names the component."""
    prints = written(docs.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "prints")
    found = durable(links(prints.select("fp", "rows"), chunk).groupBy("fp", "root").agg(F.sum("near").alias("near")))
    root = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    known = prints.join(near, "fp", "left").join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(least, "root").select("fp", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id", "root")


def near_duplicates(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, n_near, component_id for each row of documents.

    Two rows are linked if their fingerprints differ in at most 4 bits; n_near counts the other rows linked
    directly, component_id is the smallest doc_id reachable.  A null or empty text has fingerprint 0 and is
    linked like any other; repeated rows are linked with each other; a null doc_id never is a component's
    name unless no other is there (then null).  Other columns are ignored; no rows give no rows.
    """
    docs = written(documents.select("doc_id", "text").mapInArrow(_fingerprints, T.StructType([documents.schema["doc_id"], T.StructField("fp", T.LongType())])), "fingerprints")
    return docs.join(_linked(docs, chunk), "fp").select("doc_id", "fp", "n_near", "component_id")


def _with_prints(name: str):
    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t or b"") for t in text_bytes(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], [*b.schema.names, name])

    return run


def one_of_each(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """documents without near-duplicates: of each component, the row of the smallest doc_id (then fingerprint).

    All columns stay, whatever their names.  Null ids count as greatest; of rows with equal id and fingerprint one stays.
    """
    own = fresh(documents, "__fp")
    docs = written(documents.mapInArrow(_with_prints(own), T.StructType([*documents.schema.fields, T.StructField(own, T.LongType())])), "printed")
    bare = docs.select("doc_id", F.col(own).alias("fp"))
    linked = bare.join(_linked(bare, chunk).select("fp", "root"), "fp")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp")).alias("k"), F.count("*"))
    kept_id, kept_fp = fresh(docs, "__kept_id"), fresh(docs, "__kept_fp")
    kept = durable(first.select(F.col("k.doc_id").alias(kept_id), F.col("k.fp").alias(kept_fp)))
    stay = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_fp)), "left_semi")
    same = bare.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col("fp") == F.col(kept_fp)), "left_semi")
    if not same.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():  # only then are whole rows compared
        stay = stay.dropDuplicates(["doc_id", own])
    return stay.drop(own)


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
