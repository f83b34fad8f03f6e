"""Benchmark decontamination as a prefix-filtered set join.

A window (``window`` consecutive words of an item; all words of a shorter one) is a set of word
shingles.  Containment needs every shingle of the window, so the prefix filter keeps one necessary
token of each window: its rarest shingle over the whole corpus.  Documents join the windows on that
shingle only; the shingle's place gives the one start that is possible (positional bound), which must
leave room for the window in the document (length bound).  Each candidate is then verified exactly.

Two ways to the documents' shingles, with equal results:
``broadcast``  the items' vocabulary is small (checked against ``BROADCAST_BYTES``): a document's words
               become vocabulary numbers, and only shingles of the vocabulary leave the Python worker;
``shuffle``    beyond it: every document shingle's 64-bit key joins the items' shingle table by a shuffle,
               and verification compares the keys of all shingles of a window in their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, size_of, text_bytes, with_row_key, words_of, written

#: Item text beyond this isn't shipped to every executor.
BROADCAST_BYTES = 4 << 20  # so that three vocabulary numbers fit in 63 bits
SHINGLE = 3
_SEP = b" "


def _windows(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield words[i : i + window]


def _window_rows(window: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column("item_id").to_pylist(), text_bytes(b.column("text"))
            rows = {(i, _SEP.join(w)) for i, t in zip(ids, texts) if i is not None for w in _windows(words_of(t or b""), window)}
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.binary()).cast(pa.string())], ["item_id", "window"])

    return run


def _shingle_rows(batches):
    """The shingles of each window, with their places and keys."""
    for b in batches:
        rows = []
        for window in b.column("window").to_pylist():
            words = window.split(" ")
            k = min(SHINGLE, len(words))
            for i in range(len(words) - k + 1):
                shingle = " ".join(words[i : i + k])
                rows.append((window, len(words), shingle, i, _key(shingle)))
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["window", "length", "shingle", "at", "key"])


def _key(shingle: str) -> int:
    return xxhash.xxh3_64_intdigest(shingle.encode()) - (1 << 63)


def _hits_by_vocabulary(shingles: list[str]):
    """mapInArrow function: the places of a bounded list of shingles in every document."""

    def run(batches):
        vocabulary: dict[bytes, int] = {}
        for s in shingles:
            for w in s.encode().split(_SEP):
                vocabulary.setdefault(w, len(vocabulary) + 1)
        base = len(vocabulary) + 1
        tables = {}
        for n in range(1, SHINGLE + 1):
            own = [s for s in shingles if s.count(" ") == n - 1]
            if own:
                codes = []
                for s in own:
                    c = 0
                    for w in s.encode().split(_SEP):
                        c = c * base + vocabulary[w]
                    codes.append(c)
                order = np.argsort(np.array(codes, np.int64))
                tables[n] = np.array(codes, np.int64)[order], np.array([_key(s) for s in own], np.int64)[order]
        get = vocabulary.get
        for b in batches:
            n_words, places, keys, counts = [], [], [], []
            for t in text_bytes(b.column("text")):
                words = words_of(t or b"")
                n_words.append(len(words))
                own = 0
                if words:
                    ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                    some = np.flatnonzero(ids)
                    for n, (codes, hashed) in tables.items():
                        at = some[some <= len(ids) - n]
                        for j in range(1, n):
                            at = at[ids[at + j] > 0]
                        if not len(at):
                            continue
                        c = ids[at]
                        for j in range(1, n):
                            c = c * base + ids[at + j]
                        k = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                        ok = codes[k] == c
                        places.append(at[ok])
                        keys.append(hashed[k[ok]])
                        own += int(ok.sum())
                counts.append(own)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield _hit_batch(b, n_words, cat(places), cat(keys), np.array(counts, np.int64))

    return run


def _hits_by_hash(sizes: list[int]):
    """mapInArrow function: the key of every shingle (of the sizes in use) of every document."""

    def run(batches):
        for b in batches:
            n_words, places, keys, counts = [], [], [], []
            for t in text_bytes(b.column("text")):
                words = words_of(t or b"")
                n_words.append(len(words))
                own = 0
                for n in sizes:
                    k = [xxhash.xxh3_64_intdigest(_SEP.join(words[i : i + n])) - (1 << 63) for i in range(len(words) - n + 1)]
                    places.extend(range(len(k)))
                    keys.extend(k)
                    own += len(k)
                counts.append(own)
            yield _hit_batch(b, n_words, np.array(places, np.int64), np.array(keys, np.int64), np.array(counts, np.int64))

    return run


def _hit_batch(b, n_words, places, keys, counts):
    return pa.RecordBatch.from_arrays(
        [b.column("__rid"), b.column("doc_id"), pa.array(n_words, pa.int64()), list_array(places, counts, pa.int64()), list_array(keys, counts, pa.int64())],
        ["__rid", "doc_id", "n_words", "places", "keys"],
    )


def contamination(documents: DataFrame, items: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the merged hit word ranges, array<struct<from,to>> (to exclusive).  Nulls and empty texts have
    no words (0, 0, 0, the digest of an empty string, false); repeated rows are reported each;
    items with a null id, or no word, have no window; other columns are ignored, whatever their names;
    empty tables give no rows or no hits.
    """
    docs = with_row_key(documents.select("doc_id", "text"))
    windows = written(items.select("item_id", "text").mapInArrow(_window_rows(window), "item_id string, window string").distinct(), "windows")
    # window -> its items; the number of a window is its text's digest, never a position
    of_window = windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    parts = written(of_window.select("window").mapInArrow(_shingle_rows, "window string, length long, shingle string, at long, key long"), "shingles")
    kinds = parts.select("shingle").distinct()
    schema = T.StructType([T.StructField("__rid", T.LongType()), documents.schema["doc_id"], *T._parse_datatype_string("n_words long, places array<long>, keys array<long>").fields])
    small = size_of(kinds, "shingle") <= broadcast_bytes
    if small:
        step = _hits_by_vocabulary([r[0] for r in kinds.collect()])  # bounded by the check above
    else:
        step = _hits_by_hash([r[0] for r in parts.select(F.size(F.split("shingle", " ")).alias("n")).distinct().collect()])
    per_doc = docs.mapInArrow(step, schema)
    exploded = lambda x: x.select("__rid", "n_words", F.explode(F.arrays_zip("places", "keys")).alias("h")).select("__rid", "n_words", F.col("h.places").alias("place"), F.col("h.keys").alias("key"))
    if small:
        base = written(per_doc, "hits")
        hits = exploded(base)
    else:
        full = written(per_doc, "hits")
        base = full.select("__rid", "doc_id", "n_words")
        hits = written(exploded(full).join(parts.select("key").distinct(), "key", "left_semi"), "matched")
    # rarity over all documents: partial counts before the shuffle
    rarity = hits.groupBy("key").count()
    first = F.min(F.struct(F.coalesce("count", F.lit(0)), "at", "key"))
    prefix = parts.join(rarity, "key", "left").groupBy("window", "length").agg(first.alias("p")).select("window", "length", F.col("p.key").alias("key"), F.col("p.at").alias("at"))
    candidates = (
        hits.join(prefix, "key")
        .withColumn("start", F.col("place") - F.col("at"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("__rid", "start", "window", "length")
    )
    # verification: every shingle of the window at its place
    need = candidates.join(parts.select("window", "key", "at"), "window").select("__rid", "window", "length", "start", "key", (F.col("start") + F.col("at")).alias("place"))
    there = need.join(hits.select("__rid", "place", "key").withColumn("there", F.lit(1)), ["__rid", "place", "key"], "left")
    verified = there.groupBy("__rid", "window", "length", "start").agg(F.min(F.coalesce("there", F.lit(0))).alias("whole")).where("whole = 1")
    # overlapping ranges of a document become one: a range opens where it begins after all before it have ended
    ranges = verified.select("__rid", F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to")).distinct()
    order = Window.partitionBy("__rid").orderBy("from", "to")
    ended = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("opens", F.when(ended >= F.col("from"), 0).otherwise(1))
    ranges = ranges.withColumn("range", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("__rid", "range").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = ranges.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    found = verified.select("__rid", "window").distinct().join(of_window, "window").select("__rid", F.explode("items").alias("item"))
    found = found.groupBy("__rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return (
        base.select("__rid", "doc_id", "n_words")
        .join(spans.join(found, "__rid"), "__rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.to - x.from)"), F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
            F.col("spans").isNotNull().alias("contaminated"),
            "spans",
        )
    )
